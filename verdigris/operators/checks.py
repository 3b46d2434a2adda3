"""Checks of aggregates before they are published: rows (table, code, violations), all zero if sound."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import vocab as V


def _tally(rows: DataFrame, table: str, flags: dict[str, Column]) -> DataFrame:
    """One pass over the rows for all flags."""
    counts = rows.agg(*[F.count_if(F.coalesce(flag, F.lit(True))).alias(code) for code, flag in flags.items()])
    pairs = F.array(*[F.struct(F.lit(code).alias("code"), F.col(code).alias("violations")) for code in flags])
    return counts.select(F.lit(table).alias("table"), F.explode(pairs).alias("c")).select("table", "c.code", "c.violations")


def union(checks: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, checks)


def verdict(checks: DataFrame) -> bool:
    """Whether nothing is violated."""
    return checks.where("violations > 0").isEmpty()


def misaligned(stored: Column, part: Column, whole: Column, tolerance: str) -> Column:
    """Whether a stored percentage is off by more than the tolerance, which itself is allowed; in decimals."""
    number = lambda c, digits: c.cast(f"decimal({digits + 14},{digits})")
    return F.abs(number(stored, 4) * number(whole, 0) - number(part, 0) * 100) > F.lit(tolerance).cast("decimal(6,3)") * number(whole, 0)


def distribution_integrity(rows: DataFrame, table: str, keys: list[str], *, sample: str = "sample_size", floor: str = V.DATA_START) -> DataFrame:
    """Row and cell checks of a distribution."""
    by_row = _tally(
        rows,
        table,
        {
            "percentage_misaligned": misaligned(F.col("percentage"), F.col("count"), F.col(sample), "0.005"),
            "sample_size_missing": F.col(sample).isNull() | (F.col(sample) <= 0),
            "date_range_missing": F.col("date_range_start").isNull() | F.col("date_range_end").isNull(),
            "date_range_start_before_window": F.coalesce(F.col("date_range_start") < F.lit(floor).cast("date"), F.lit(False)),
            "date_range_inverted": F.coalesce(F.col("date_range_start") > F.col("date_range_end"), F.lit(False)),
        },
    )
    cells = rows.groupBy(*keys).agg(F.sum("count").alias("total"), F.min(sample).alias("low"), F.max(sample).alias("high"))
    by_cell = _tally(cells, table, {"count_sum_mismatch": F.col("total") != F.col("high"), "sample_size_inconsistent": F.col("low") != F.col("high")})
    return by_row.unionByName(by_cell)


def baseline(judge_rows: DataFrame, charge_rows: DataFrame, table: str) -> DataFrame:
    """Charges with judge-grain rows need charge-grain rows."""
    missing = judge_rows.select("charge_id").distinct().join(charge_rows.select("charge_id"), "charge_id", "left_anti")
    return missing.agg(F.count("*").alias("violations")).select(F.lit(table).alias("table"), F.lit("baseline_missing").alias("code"), "violations")


def index_identities(summary: DataFrame, categories: DataFrame, keys: list[str], table: str) -> DataFrame:
    """sentenced + wedge = convictions and the wedge's share; category counts within sentenced; durations all or none."""
    rows = _tally(
        summary,
        table,
        {
            "wedge_identity_mismatch": F.col("sentenced_convictions") + F.col("wedge_count") != F.col("convictions"),
            "wedge_percentage_misaligned": misaligned(F.col("wedge_percentage"), F.col("wedge_count"), F.col("convictions"), "0.05"),
            "convictions_missing": F.col("convictions").isNull() | (F.col("convictions") <= 0),
            "date_range_missing": F.col("date_range_start").isNull() | F.col("date_range_end").isNull(),
            "date_range_inverted": F.coalesce(F.col("date_range_start") > F.col("date_range_end"), F.lit(False)),
        },
    )
    joined = categories.join(summary.select(*keys, "sentenced_convictions"), keys, "left")
    have = [F.col(c).isNotNull().cast("int") for c in ("median_min_days", "median_max_days", "min_assumed_percentage")]
    together = (have[0] + have[1] + have[2]).isin(0, 3)
    own = _tally(joined, table, {"summary_row_missing": F.col("sentenced_convictions").isNull(), "category_count_exceeds_sentenced": F.col("conviction_count") > F.col("sentenced_convictions"), "median_presence_mismatch": ~together, "median_days_invalid": F.coalesce((F.col("median_min_days") < 0) | (F.col("median_min_days") > F.col("median_max_days")), F.lit(False))})
    return rows.unionByName(own)


def grade_identity(grades: DataFrame, summary: DataFrame) -> DataFrame:
    """Grades of a charge add up to its convictions."""
    sums = grades.groupBy("charge_id").agg(F.sum("count").alias("graded"))
    joined = sums.join(summary.select("charge_id", "convictions"), "charge_id", "full_outer")
    return _tally(joined, "grade_mix", {"grade_mix_sum_mismatch": F.col("graded") != F.col("convictions")})


def conviction_reconciliation(distribution: DataFrame, summary: DataFrame, keys: list[str], table: str) -> DataFrame:
    """Convictions counted by the distribution and by the index agree in every cell of either."""
    counted = distribution.where(F.col("category_code").isin(V.CONVICTIONS)).groupBy(*keys).agg(F.sum("count").alias("left_n"))
    joined = counted.join(summary.select(*keys, "convictions"), keys, "full_outer")
    return _tally(joined, table, {"conviction_reconciliation_mismatch": F.coalesce("left_n", F.lit(0)) != F.coalesce("convictions", F.lit(0))})


def component_durations(outcomes: DataFrame, components: DataFrame) -> DataFrame:
    """Components that feed the index have both bounds or none, not negative, in order."""
    low, high = F.col("min_days"), F.col("max_days")
    bad = (low.isNull() != high.isNull()) | F.coalesce((low < 0) | (high < low), F.lit(False))
    fed = components.where("public_eligible").join(outcomes.where(F.col("public_eligible") & F.col("outcome_category_code").isin(V.CONVICTIONS)).select("outcome_id"), "outcome_id", "left_semi")
    return _tally(fed, "charge_sentences", {"component_duration_invalid": bad})


def index_against_facts(categories: DataFrame, outcomes: DataFrame, components: DataFrame, keys: list[str], table: str, *, eligible: str) -> DataFrame:
    """Index rows against the facts of their build, at one grain.

    component_duration_invalid counts public components on convictions of the grain with one bound
    only, a negative one or a least above the most; median_presence_mismatch counts index rows that have a
    median though no sound component of their cell and category bears a duration, or none though one does.
    """
    anchors = outcomes.where(F.col(eligible) & F.col("outcome_category_code").isin(V.CONVICTIONS)).select("outcome_id", *keys)
    fed = components.where("public_eligible").select("outcome_id", F.col("sentencing_category_code").alias("category_code"), "min_days", "max_days")
    return index_against_counts(categories, anchors.join(fed, "outcome_id").groupBy(*keys, "category_code", "min_days", "max_days").agg(F.count("*").alias("n")), keys, table)


def index_against_counts(categories: DataFrame, fed: DataFrame, keys: list[str], table: str) -> DataFrame:
    """The checks of ``index_against_facts`` on the facts counted by (keys, category_code, min_days, max_days): n public
    components on convictions of the grain. Several checks may so read the facts once."""
    low, high = F.col("min_days"), F.col("max_days")
    bad = (low.isNull() != high.isNull()) | F.coalesce((low < 0) | (low > high), F.lit(False))
    cells = fed.dropna(subset=keys).where("n > 0").groupBy(*keys, "category_code").agg(F.sum(F.when(bad, F.col("n")).otherwise(0)).alias("invalid"), F.bool_or(~bad & low.isNotNull()).alias("bears"))
    joined = cells.join(categories.select(*keys, "category_code", F.col("median_min_days").isNotNull().alias("stored")), [*keys, "category_code"], "full_outer")
    counts = joined.agg(F.coalesce(F.sum("invalid"), F.lit(0)).alias("component_duration_invalid"), F.count_if(F.col("stored") != F.coalesce("bears", F.lit(False))).alias("median_presence_mismatch"))
    return counts.select(F.lit(table).alias("table"), F.explode(F.array(*[F.struct(F.lit(c).alias("code"), F.col(c).alias("violations")) for c in counts.columns])).alias("c")).select("table", "c.*")


def volume(funnel: DataFrame, distribution: DataFrame, public_facts: DataFrame) -> DataFrame:
    """Closure of the funnel, and its outcomes against the distribution and the facts."""
    closure = F.col("outcomes_recorded") + F.col("held_for_court") + F.col("still_pending") + F.col("disposed_excluded")
    own = _tally(funnel, "charge_volume", {"volume_closure_mismatch": closure != F.col("charges_seen"), "volume_counts_invalid": F.col("charges_seen") <= 0})
    samples = distribution.groupBy("charge_id").agg(F.max("sample_size").alias("sample"))
    both = funnel.select("charge_id", "outcomes_recorded").join(samples, "charge_id", "full_outer")
    against = _tally(both, "charge_volume", {"volume_outcomes_mismatch": F.col("outcomes_recorded").isNotNull() & (F.col("outcomes_recorded") != F.coalesce("sample", F.lit(0))), "volume_row_missing": F.col("outcomes_recorded").isNull()})
    sums = funnel.agg(F.coalesce(F.sum("outcomes_recorded"), F.lit(0)).alias("a")).join(public_facts.where("public_eligible").agg(F.count("*").alias("b")))
    facts = _tally(sums, "charge_volume", {"volume_facts_mismatch": F.col("a") != F.col("b")})
    return union([own, against, facts])


def run_rows(rows: DataFrame, table: str, run_id: str) -> DataFrame:
    """Rows of a run carry its id and a taxonomy version."""
    return _tally(rows, table, {"run_id_mismatch": F.col("run_id") != run_id, "taxonomy_version_missing": F.coalesce("taxonomy_version", F.lit("")) == ""})


def build_stops(charges: DataFrame, outcomes: DataFrame, sentences: DataFrame, components: DataFrame, taxonomy_version: str) -> DataFrame:
    """code, violations of what stops a build of facts.

    Reads parser_version and taxonomy_version of the charges (a corpus is of one each), sentences whose
    charge is held or has no outcome, and component durations that differ from their sentence's.
    """
    corpus = charges.agg(
        F.when(F.count("*") == 0, 1).otherwise(0).cast("long").alias("empty_corpus"),
        F.greatest(F.count_distinct("parser_version") - 1, F.lit(0)).alias("mixed_corpus"),
        F.count_if(F.coalesce("taxonomy_version", F.lit("")) != taxonomy_version).alias("taxonomy_mismatch"),
    )
    orphans = sentences.join(outcomes.select("outcome_id"), "outcome_id", "left_anti").agg(F.count("*").alias("held_sentences"))
    same = F.col("min_days").eqNullSafe(F.col("own_min")) & F.col("max_days").eqNullSafe(F.col("own_max"))
    own = sentences.select("sentence_id", F.col("min_days").alias("own_min"), F.col("max_days").alias("own_max"))
    drift = components.join(own, "sentence_id").agg(F.count_if(~same).alias("duration_drift"))
    one = lambda df: df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("code"), F.col(c).alias("violations")) for c in df.columns])).alias("x")).select("x.*")
    return union([one(corpus), one(orphans), one(drift)])


def codes_outside(rows: DataFrame, column: str, allowed: list[str]) -> DataFrame:
    """The codes that rows carry and the vocabulary lacks, with how often."""
    return rows.groupBy(F.col(column).alias("code")).agg(F.count("*").alias("n")).where(~F.coalesce(F.col("code").isin(allowed), F.lit(False)))


def taxonomy_faults(rows: DataFrame, version: str, expected: list[str], banned: list[str]) -> DataFrame:
    """fault, value of a taxonomy (code, sort_order): repeated codes or orders, banned words in codes, codes
    beyond or short of the expected ones, and a version that is not three numbers."""
    fault = lambda df, name, c="code": df.select(F.lit(name).alias("fault"), F.col(c).cast("string").alias("value"))
    repeated = lambda c: rows.groupBy(c).agg(F.count("*").alias("n")).where("n > 1")
    listed = rows.sparkSession.createDataFrame([(c,) for c in expected], "code string")
    named = rows.sparkSession.createDataFrame([(version,)], "code string")
    holds = reduce(lambda a, w: a | F.contains(F.lower("code"), F.lit(w)), banned, F.lit(False))
    found = [fault(repeated("code"), "code_repeated"), fault(repeated("sort_order"), "order_repeated", "sort_order"), fault(rows.where(holds), "code_banned"), fault(rows.join(listed, "code", "left_anti"), "code_unexpected"), fault(listed.join(rows, "code", "left_anti"), "code_absent")]
    return union([*found, fault(named.where(~F.col("code").rlike(r"^\d+\.\d+\.\d+$")), "version_malformed")])


def taxonomy(rows: list[tuple[str, int, bool]], banned: list[str]) -> list[str]:
    """Faults of a taxonomy (code, order, public): repeated codes or orders, banned codes."""
    codes, orders = [r[0] for r in rows], [r[1] for r in rows]
    faults = [f"code {c} is repeated" for c in sorted({c for c in codes if codes.count(c) > 1})]
    faults += [f"order {o} is repeated" for o in sorted({o for o in orders if orders.count(o) > 1})]
    return faults + [f"code {c} is banned" for c in codes if c in banned]
