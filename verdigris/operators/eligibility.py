"""Eligibility gates: three nested flags and every reason that applies, in a fixed order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import vocab as V
from ..functions.numbers import on_or_after


def review_severity(codes: Column) -> Column:
    """Whether any parser warning code has severity review; a code that the vocabulary lacks is an error."""
    codes = F.coalesce(codes, F.array().cast("array<string>"))
    unknown = F.exists(codes, lambda c: ~F.coalesce(c.isin(list(V.WARNING_SEVERITY)), F.lit(False)))
    review = F.exists(codes, lambda c: c.isin([k for k, s in V.WARNING_SEVERITY.items() if s == "review"]))
    return F.when(unknown, F.raise_error(F.concat(F.lit("unknown warning code among "), F.to_json(codes))).cast("boolean")).otherwise(review)


def _dates(date: Column, window: str, missing: str, before: str) -> list[Column]:
    return [F.when(date.isNull(), missing), F.when(~on_or_after(date, window) & date.isNotNull(), before)]


def _filed(filed: Column, floor: str) -> list[Column]:
    return _dates(filed, floor, "filed_date_missing", "filed_date_before_floor")


def gate_outcomes(rows: DataFrame, *, window: str = V.DATA_START, floor: str = V.DATA_START) -> DataFrame:
    """Adds mvp_eligible, public_eligible, judge_specific_eligible, review_needed and reasons.

    Reads disposition_date, filed_date, charge_method, charge_warning, mapped, category_public,
    warning_codes and attribution.
    """
    clean = F.col("charge_method").isin(V.PUBLIC_METHODS)
    review, attributed = review_severity(F.col("warning_codes")), F.col("attribution") != "none"
    mvp = on_or_after(F.col("disposition_date"), window)
    public = mvp & on_or_after(F.col("filed_date"), floor) & clean & F.col("category_public") & ~review
    reasons = F.array_compact(
        F.array(
            *_dates(F.col("disposition_date"), window, "disposition_date_missing", "disposition_date_before_mvp_window"),
            *_filed(F.col("filed_date"), floor),
            F.when(~clean, "charge_not_normalized"),
            F.when(F.col("charge_warning") == V.NORM_STATUTE_TEXT_CONFLICT, "blocking_warning"),
            F.when(~F.col("mapped"), "disposition_not_mapped").when(~F.col("category_public"), "outcome_category_not_public"),
            F.when(review, "review_needed"),
            F.when(public & ~attributed, "judge_not_attributed"),
        )
    )
    return rows.withColumns({"mvp_eligible": mvp, "public_eligible": public, "judge_specific_eligible": public & attributed, "review_needed": review, "reasons": reasons})


def gate_components(rows: DataFrame, *, window: str = V.DATA_START, floor: str = V.DATA_START) -> DataFrame:
    """The same for sentence components.

    Reads sentence_date, filed_date, component (see ``matching.component``), duration_unparseable,
    parent_public and parent_attributed.
    """
    c = F.col("component")
    clean = c["method"] == V.EXACT
    review = ~c["mapped"] | c["ambiguous"] | c["money_unparseable"] | F.col("duration_unparseable") | (F.size(c["categories"]) > 1)
    mvp = on_or_after(F.col("sentence_date"), window)
    public = F.col("parent_public") & mvp & on_or_after(F.col("filed_date"), floor) & clean & c["public"] & ~review
    reasons = F.array_compact(
        F.array(
            *_dates(F.col("sentence_date"), window, "sentence_date_missing", "sentence_date_before_mvp_window"),
            *_filed(F.col("filed_date"), floor),
            F.when(~F.col("parent_public"), "parent_outcome_ineligible"),
            F.when(~clean, "sentencing_component_not_normalized"),
            F.when(c["mapped"] & ~c["public"], "sentencing_category_not_public"),
            F.when(review, "review_needed"),
            F.when(c["money_unparseable"], "money_amount_unparseable"),
            F.when(F.col("duration_unparseable"), "sentence_duration_unparseable"),
            F.when(public & ~F.col("parent_attributed"), "judge_not_attributed"),
        )
    )
    return rows.withColumns({"mvp_eligible": mvp, "public_eligible": public, "judge_specific_eligible": public & F.col("parent_attributed"), "review_needed": review, "reasons": reasons})


def broken_invariants(facts: DataFrame) -> DataFrame:
    """Facts whose flags are not nested, or that have reasons exactly where they should not."""
    return facts.where("judge_specific_eligible and not public_eligible or public_eligible and not mvp_eligible or judge_specific_eligible = (size(reasons) > 0)")


def unparseable_duration(sentence_type: Column, min_days: Column, max_days: Column, raw_text: Column) -> Column:
    return ~F.lower(sentence_type).isin(V.NO_DURATION_TYPES) & min_days.isNull() & max_days.isNull() & (F.coalesce(raw_text, F.lit("")) != "")


def disposed(raw: Column, date: Column, sentences: Column) -> Column:
    """A charge with a disposition, its date or a sentence has ended."""
    return raw.isNotNull() | date.isNotNull() | (F.coalesce(F.size(sentences), F.lit(0)) > 0)
