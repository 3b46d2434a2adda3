"""Fact builds: outcome facts from charges, component facts from sentences, and their tallies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import vocab as V
from .eligibility import gate_components, gate_outcomes, unparseable_duration
from .matching import component, disposition


def outcome_facts(charges: DataFrame, *, window: str, floor: str) -> DataFrame:
    """One fact for each charge with an outcome; held and undisposed charges have none.

    Reads charge_id (the row), normalized_charge_id, charge_method, charge_warning, disposition_raw,
    disposition_date, filed_date, warning_codes, judge_id, attribution and grade.
    """
    rows = charges.withColumn("_d", disposition(F.col("disposition_raw"))).where("_d.category is not null")
    rows = rows.withColumns({"mapped": F.col("_d.mapped"), "category_public": F.col("_d.public")})
    gated = gate_outcomes(rows, window=window, floor=floor)
    return gated.select(
        F.col("charge_id").alias("outcome_id"), "docket_id", F.col("normalized_charge_id").alias("charge_id"), F.col("_d.category").alias("outcome_category_code"), "disposition_date", "filed_date", "judge_id", "attribution", "charge_method", F.when(F.col("mapped"), V.EXACT).otherwise(V.UNMATCHED).alias("outcome_method"), "grade", "mvp_eligible", "public_eligible", "judge_specific_eligible", "review_needed", "reasons"
    )


def component_facts(sentences: DataFrame, outcomes: DataFrame, *, window: str, floor: str) -> DataFrame:
    """One fact for each sentence component of a charge that has an outcome fact."""
    parent = outcomes.select("outcome_id", "charge_id", "judge_id", "attribution", "filed_date", F.col("public_eligible").alias("parent_public"))
    rows = sentences.join(parent, "outcome_id").withColumn("component", component(F.col("sentence_type"), F.col("raw_text")))
    rows = rows.withColumns({"parent_attributed": F.col("attribution") != "none", "duration_unparseable": unparseable_duration(F.col("sentence_type"), F.col("min_days"), F.col("max_days"), F.col("raw_text"))})
    gated = gate_components(rows, window=window, floor=floor)
    return gated.select("sentence_id", "outcome_id", "charge_id", "judge_id", "attribution", F.col("component.category").alias("sentencing_category_code"), F.col("component.method").alias("component_method"), F.size("component.categories").alias("n_categories"), "sentence_date", "min_days", "max_days", "min_assumed", F.col("component.amount_cents").alias("amount_cents"), "mvp_eligible", "public_eligible", "judge_specific_eligible", "review_needed", "reasons")


def orphans(sentences: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Sentences whose charge has no outcome fact; any of them stops a build."""
    return sentences.join(outcomes.select("outcome_id"), "outcome_id", "left_anti")


def warned_charges(warnings: DataFrame, dockets: DataFrame, charges: DataFrame, codes: list[str]) -> DataFrame:
    """Warnings of the codes with their docket and, where docket and sequence name one, their charge."""
    rows = warnings.where(F.col("code").isin(codes)).join(dockets.select("docket_id", "docket_number"), "docket_id")
    own = charges.select("docket_id", F.col("sequence").alias("charge_sequence"), "charge_id")
    return rows.join(own, ["docket_id", "charge_sequence"], "left")


def with_warning_codes(charges: DataFrame, warnings: DataFrame) -> DataFrame:
    """Charges with warning_codes, all codes of warnings that name their docket and sequence, for the gate.

    Warnings (docket_id, charge_sequence, code) are gathered by charge before they meet the charges;
    those without a sequence belong to the docket and reach none.
    """
    codes = warnings.where("charge_sequence is not null").groupBy("docket_id", F.col("charge_sequence").alias("sequence")).agg(F.sort_array(F.collect_set("code")).alias("warning_codes"))
    rows = charges.drop("warning_codes").join(codes, ["docket_id", "sequence"], "left")
    return rows.withColumn("warning_codes", F.coalesce("warning_codes", F.array().cast("array<string>")))


def build_counts(charges: DataFrame) -> DataFrame:
    """One row: processed = facts + held + undisposed."""
    d = disposition(F.col("disposition_raw"))
    return charges.agg(F.count("*").alias("processed"), F.count_if(d["category"].isNotNull()).alias("facts"), F.count_if(d["held"]).alias("held"), F.count_if(F.col("disposition_raw").isNull()).alias("undisposed"))


def full_tally(facts: DataFrame) -> DataFrame:
    """Every reason of the vocabulary with the number of facts that carry it, zeros included."""
    named = facts.sparkSession.createDataFrame([(r,) for r in V.REASON_CODES], "reason string")
    seen = facts.select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))
    return named.join(seen, "reason", "left").select("reason", F.coalesce("n", F.lit(0)).alias("n"))


def lag_report(pairs: DataFrame, window: str) -> DataFrame:
    """One row on sentence_date against disposition_date."""
    lag = F.datediff("sentence_date", "disposition_date")
    before = lambda c: F.col(c) < F.lit(window).cast("date")
    return pairs.agg(F.count(lag).alias("dated_pairs"), F.count_if(lag != 0).alias("diverging"), F.count_if(lag < 0).alias("negative"), F.count_if(before("disposition_date") != before("sentence_date")).alias("straddling"), F.min(lag).alias("least_lag"), F.max(lag).alias("greatest_lag"))


def component_tallies(facts: DataFrame) -> DataFrame:
    """One row: components with several categories, unreadable money or durations, and their charges."""
    has = lambda r: F.array_contains("reasons", r)
    return facts.agg(F.count("*").alias("components"), F.count("amount_cents").alias("with_amount"), F.count_if(has("money_amount_unparseable")).alias("money_unparseable"), F.count_if(F.col("n_categories") > 1).alias("multi_category"), F.count_distinct(F.when(F.col("n_categories") > 1, F.col("outcome_id"))).alias("multi_category_charges"), F.count_if(has("sentence_duration_unparseable")).alias("duration_unparseable"))
