"""The operations panel: counts of the corpus, the facts, the queue and the active run.

Every function is one grouped aggregate, or a limit over one; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import vocab as V
from ..functions.numbers import share_1dp
from ..plans.runs import ACTIVE


def corpus(dockets: DataFrame) -> DataFrame:
    """For each court: dockets, those with a filing date, first and last one, distinct and ungraded case keys."""
    return dockets.groupBy("court").agg(F.count("*").alias("dockets"), F.count("filed_date").alias("filed"), F.min("filed_date").alias("first_filed"), F.max("filed_date").alias("last_filed"), F.count_distinct("otn").alias("otns"), F.count_distinct(F.when(F.col("grade").isNull(), F.col("otn"))).alias("ungraded_otns"))


def version_pairs(envelopes: DataFrame) -> DataFrame:
    """envelope, record, n: envelopes by the versions that made them."""
    return envelopes.groupBy(F.col("version.envelope").alias("envelope"), F.col("version.record").alias("record")).agg(F.count("*").alias("n"))


def source_status(documents: DataFrame, status: Column, size: Column) -> DataFrame:
    """status, n, bytes of source documents."""
    return documents.groupBy(status.alias("status")).agg(F.count("*").alias("n"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes"))


def source_days(documents: DataFrame, at: str, who: str, days: int = 14) -> DataFrame:
    """day, n, users of the last days that there are documents of."""
    counted = documents.groupBy(F.col(at).cast("date").alias("day")).agg(F.count("*").alias("n"), F.count_distinct(who).alias("users"))
    return counted.withColumn("latest", F.max("day").over(Window.partitionBy())).where(F.col("day") > F.date_sub("latest", days)).drop("latest")  # a row a day


def linkage(charges: DataFrame) -> DataFrame:
    """One row: charges, those of a docket that continues another, such origins, and those of pending charges."""
    origin = F.col("originating_docket_no")
    return charges.agg(F.count("*").alias("charges"), F.count(origin).alias("with_origin"), F.count_distinct(origin).alias("origins"), F.count_distinct(F.when(F.col("disposition_raw").isNull(), origin)).alias("pending_origins"))


def outcome_shares(distribution: DataFrame) -> DataFrame:
    """category_code, n, share of each category, and of dismissed and withdrawn together."""
    per = distribution.groupBy("category_code").agg(F.sum("count").alias("n"))
    both = per.where(F.col("category_code").isin("dismissed", "withdrawn")).agg(F.sum("n").alias("n")).where("n is not null").select(F.lit("dismissed_or_withdrawn").alias("category_code"), "n")
    total = per.agg(F.sum("n").alias("total"))
    return per.unionByName(both).join(total).select("category_code", "n", share_1dp(F.col("n"), F.col("total")).alias("share"))


def _cells(distribution: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each cell: its size and whether that is thin."""
    return distribution.groupBy(*keys).agg(F.max("sample_size").alias("n"), F.bool_or("is_thin_data").alias("thin"))


def charge_totals(distribution: DataFrame, funnel: DataFrame) -> DataFrame:
    """One row: charges, thin ones, and the sums of the funnel (0 where it is empty)."""
    seen = _cells(distribution, ["charge_id"]).agg(F.count("*").alias("charges"), F.count_if("thin").alias("thin_charges"))
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("charges_seen", "outcomes_recorded", "held_for_court", "still_pending", "disposed_excluded", "held_superseded")]
    return seen.join(funnel.agg(*sums))


def top_charges(distribution: DataFrame, limit: int = 12) -> DataFrame:
    """Charges with most outcomes, then by id."""
    return _cells(distribution, ["charge_id"]).orderBy(F.desc("n"), "charge_id").limit(limit)


def judge_totals(distribution: DataFrame) -> DataFrame:
    """One row: judges, pairs of charge and judge, thin pairs."""
    return _cells(distribution, ["charge_id", "judge_id"]).agg(F.count_distinct("judge_id").alias("judges"), F.count("*").alias("pairs"), F.count_if("thin").alias("thin_pairs"))


def top_judges(distribution: DataFrame, limit: int = 10) -> DataFrame:
    """Judges with most outcomes, then by id, with their charges and how many are thin."""
    sizes = _cells(distribution, ["charge_id", "judge_id"]).groupBy("judge_id").agg(F.sum("n").alias("n"), F.count("*").alias("charges"), F.count_if("thin").alias("thin"))
    return sizes.orderBy(F.desc("n"), "judge_id").limit(limit)


def top_values(counts: DataFrame, limit: int | None = 12) -> DataFrame:
    """The most frequent (value, n) of each column, or all, then by value; nulls last, with their place."""
    rows = counts.withColumn("place", F.row_number().over(Window.partitionBy("column").orderBy(F.desc("n"), F.asc_nulls_last("value"))))
    return rows if limit is None else rows.where(F.col("place") <= limit)


def queue_counts(queue: DataFrame) -> DataFrame:
    """status, reason, n of the review queue."""
    return queue.groupBy("status", "reason").agg(F.count("*").alias("n"))


def queue_summary(queue: DataFrame) -> DataFrame:
    """by, value, n: items by status, and open ones by type and by severity, from one pass."""
    sets = queue.groupBy("status", "item_type", "severity").agg(F.count("*").alias("n"))
    by = F.array(F.struct(F.lit("status").alias("by"), F.col("status").alias("value")), *[F.when(F.col("status") == "open", F.struct(F.lit(c).alias("by"), F.col(c).alias("value"))) for c in ("item_type", "severity")])
    return sets.select("n", F.explode(F.array_compact(by)).alias("x")).groupBy("x.by", "x.value").agg(F.sum("n").alias("n"))


def warning_counts(warnings: DataFrame) -> DataFrame:
    """code, severity, n, dockets of parser warnings, every code of the vocabulary."""
    names = warnings.sparkSession.createDataFrame(list(V.WARNING_SEVERITY.items()), "code string, severity string")
    seen = warnings.groupBy("code").agg(F.count("*").alias("n"), F.count_distinct("doc").alias("dockets"))
    return names.join(seen, "code", "left").select("code", "severity", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("dockets", F.lit(0)).alias("dockets"))


def live_checks(runs: DataFrame, volume: DataFrame, outcomes: DataFrame, summary: DataFrame, charges: DataFrame, processed: int | None, pointers: DataFrame) -> DataFrame:
    """name, left_n, right_n, passed of what must hold on a live system, counted by row.

    runs: the table of runs; volume, outcomes and summary: charge rows of the active run; charges: the live
    ones; processed: how many the latest completed build of facts saw (None: there is none); pointers:
    superseded charges (mc_charge_id, superseded_by). Without an active run its tables are not judged.
    One pass over each table.
    """
    n = F.count_if
    zero = F.lit(0).cast("long")
    active = runs.agg(n(F.coalesce(F.expr(ACTIVE), F.lit(False))).alias("active"))
    cells = outcomes.groupBy("charge_id").agg(F.sum("count").alias("total"), F.max("sample_size").alias("sample"))
    stages = F.col("outcomes_recorded") + F.col("held_for_court") + F.col("still_pending") + F.col("disposed_excluded")
    both = volume.withColumn("seen", F.lit(True)).join(cells, "charge_id", "full_outer").agg(
        n(stages != F.col("charges_seen")).alias("volume_closure"),
        n(F.col("seen") & (F.col("outcomes_recorded") != F.coalesce("sample", zero))).alias("volume_matches_percentages"),
        n(F.col("total") != F.col("sample")).alias("outcome_counts_sum_to_sample"),
    )
    wedge = summary.agg(n(F.col("sentenced_convictions") + F.col("wedge_count") != F.col("convictions")).alias("wedge_identity"))
    live = charges.agg(F.count("*").alias("live"))
    own = pointers.agg(n(F.col("mc_charge_id") == F.col("superseded_by")).alias("no_self_supersession"))
    row = active.join(both).join(wedge).join(live).join(own)  # a row each
    of_run = lambda c: F.when(F.col("active") > 0, F.struct(F.lit(c).alias("name"), F.col(c).alias("left_n"), zero.alias("right_n")))
    checks = [F.struct(F.lit("one_active_published_run").alias("name"), F.col("active").alias("left_n"), F.lit(1).cast("long").alias("right_n"))]
    checks += [of_run(c) for c in ("volume_closure", "volume_matches_percentages", "outcome_counts_sum_to_sample", "wedge_identity")]
    if processed:
        checks.append(F.struct(F.lit("corpus_unchanged_since_build").alias("name"), F.col("live").alias("left_n"), F.lit(processed).cast("long").alias("right_n")))
    checks.append(F.struct(F.lit("no_self_supersession").alias("name"), F.col("no_self_supersession").alias("left_n"), zero.alias("right_n")))
    return row.select(F.explode(F.array_compact(F.array(*checks))).alias("c")).select("c.*", (F.col("c.left_n") == F.col("c.right_n")).alias("passed"))
