"""Versioned aggregates over facts: distributions, the sentencing index, the volume funnel.

All take ``keys``, the grain: ``["charge_id"]`` or ``["charge_id", "judge_id"]``. A group-by counts
first, with partial sums before its shuffle, so a charge that holds a third of all facts costs a
task no more than a row for each category; shares are windows over those few rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import vocab as V
from ..functions.numbers import percent


def distribution(facts: DataFrame, keys: list[str], *, category: str, date: str, eligible: str, thin: int = V.THIN_SAMPLE, sample: str = "sample_size") -> DataFrame:
    """Count and share of each category in each cell, with the cell's size, dates and thin flag."""
    counted = facts.where(F.col(eligible)).groupBy(*keys, F.col(category).alias("category_code")).agg(F.count("*").alias("count"), F.min(date).alias("first"), F.max(date).alias("last"))
    cell = Window.partitionBy(*keys)
    size = F.sum("count").over(cell)
    rows = counted.withColumns({sample: size, "date_range_start": F.min("first").over(cell), "date_range_end": F.max("last").over(cell)})
    return rows.select(*keys, "category_code", "count", percent(F.col("count"), F.col(sample)).alias("percentage"), sample, "date_range_start", "date_range_end", (F.col(sample) < thin).alias("is_thin_data"))


def floor_violations(facts: DataFrame, *, date: str, eligible: str, floor: str = V.DATA_START) -> DataFrame:
    """One row: eligible facts without charge or date, or before the floor. Any of them stops a run."""
    bad = F.col("charge_id").isNull() | F.col(date).isNull() | (F.col(date) < F.lit(floor).cast("date"))
    return facts.where(F.col(eligible)).agg(F.count_if(F.coalesce(bad, F.lit(True))).alias("violations"))


def anchors(outcomes: DataFrame, eligible: str) -> DataFrame:
    """Convictions that count at a grain."""
    return outcomes.where(F.col(eligible) & F.col("outcome_category_code").isin(V.CONVICTIONS))


def _with_components(outcomes: DataFrame, components: DataFrame, keys: list[str], eligible: str) -> DataFrame:
    """Public components beside their convictions. Components keep their own flag at every grain."""
    own = components.where("public_eligible").select("outcome_id", "sentencing_category_code", "min_days", "max_days", "min_assumed")
    return anchors(outcomes, eligible).select("outcome_id", *keys).join(own, "outcome_id")


def index_summary(outcomes: DataFrame, components: DataFrame, keys: list[str], *, eligible: str, thin: int = V.THIN_SAMPLE) -> DataFrame:
    """Convictions, those with a sentence, the difference (wedge) and its share, dates and the thin flag."""
    sentenced = components.where("public_eligible").select("outcome_id").distinct().withColumn("has", F.lit(True))
    rows = anchors(outcomes, eligible).join(sentenced, "outcome_id", "left")
    cells = rows.groupBy(*keys).agg(F.count("*").alias("convictions"), F.count("has").alias("sentenced_convictions"), F.min("disposition_date").alias("date_range_start"), F.max("disposition_date").alias("date_range_end"))
    cells = cells.withColumn("wedge_count", F.col("convictions") - F.col("sentenced_convictions"))
    return cells.select(*keys, "convictions", "sentenced_convictions", "wedge_count", percent(F.col("wedge_count"), F.col("convictions"), 1).alias("wedge_percentage"), "date_range_start", "date_range_end", (F.col("sentenced_convictions") < thin).alias("is_thin_data"))


def histogram_median(histogram: DataFrame, cell: list[str], value: str, n: str) -> DataFrame:
    """The cell and its exact median, named as the value, from rows (cell, value, n): the mean of the two middle
    ranks, read off running counts. A cell costs as many rows as it has distinct values."""
    counted = histogram.where(F.col(value).isNotNull()).groupBy(*cell, value).agg(F.sum(n).alias("_n"))
    up_to, whole = Window.partitionBy(*cell).orderBy(value), Window.partitionBy(*cell)
    rows = counted.withColumns({"_to": F.sum("_n").over(up_to), "_all": F.sum("_n").over(whole)})
    reached = lambda rank: F.min(F.when(F.col("_to") >= rank, F.col(value)))
    div = lambda x: F.call_function("div", x, F.lit(2))
    return rows.groupBy(*cell).agg(((reached(div(F.col("_all") + 1)) + reached(div(F.col("_all")) + 1)) / 2.0).alias(value))


def index_categories(outcomes: DataFrame, components: DataFrame, keys: list[str], *, eligible: str) -> DataFrame:
    """For each category of a cell: distinct convictions, share of those sentenced, median bounds.

    Shares may add up to more than 100. The share of assumed minima is over all components of the
    category; the three duration figures are null together where no component bears a duration.

    Components meet their conviction once; there the first of each conviction, and of each category of
    it, is marked, so that all counts are sums over one pre-aggregate of (cell, category, days), of which
    the medians read the counts of days.
    """
    conviction = Window.partitionBy("outcome_id").orderBy("sentencing_category_code")
    rows = _with_components(outcomes, components, keys, eligible)
    rows = rows.withColumns({"_first": F.row_number().over(conviction) == 1, "_own": F.lag("sentencing_category_code").over(conviction).eqNullSafe(F.col("sentencing_category_code"))})
    cell = [*keys, "sentencing_category_code"]
    counted = rows.groupBy(*cell, "min_days", "max_days").agg(F.count("*").alias("n"), F.count_if("_first").alias("sentenced"), F.count_if(~F.col("_own")).alias("convictions"), F.count_if("min_assumed").alias("assumed"))
    return categories_of(counted, keys)


def categories_of(counted: DataFrame, keys: list[str]) -> DataFrame:
    """Index rows from counts by (keys, sentencing_category_code, min_days, max_days): n components, of them
    assumed, and those that are the first of their conviction (sentenced) and of its category (convictions)."""
    cell = [*keys, "sentencing_category_code"]
    bears = F.col("min_days").isNotNull()
    each = counted.groupBy(*cell).agg(F.sum("convictions").alias("conviction_count"), F.sum("n").alias("components"), F.sum("assumed").alias("assumed"), F.sum("sentenced").alias("_sentenced"), F.coalesce(F.sum(F.when(bears, F.col("n"))), F.lit(0)).alias("bearing"))
    each = each.withColumn("sentenced", F.sum("_sentenced").over(Window.partitionBy(*keys)))
    bearing = counted.where(bears)
    joined = each.join(histogram_median(bearing, cell, "min_days", "n"), cell, "left").join(histogram_median(bearing, cell, "max_days", "n"), cell, "left")
    return joined.select(*keys, F.col("sentencing_category_code").alias("category_code"), "conviction_count", percent(F.col("conviction_count"), F.col("sentenced"), 1).alias("percentage"), F.col("min_days").alias("median_min_days"), F.col("max_days").alias("median_max_days"), F.when(F.col("bearing") > 0, percent(F.col("assumed"), F.col("components"), 1)).alias("min_assumed_percentage"))


def grade_mix(outcomes: DataFrame) -> DataFrame:
    """Convictions of each charge by grade."""
    grades = anchors(outcomes, "public_eligible").groupBy("charge_id", F.coalesce("grade", F.lit(V.UNGRADED)).alias("grade")).agg(F.count("*").alias("count"))
    return grades.withColumn("percentage", percent(F.col("count"), F.sum("count").over(Window.partitionBy("charge_id")), 1))


def grades_in_order(grades: DataFrame) -> DataFrame:
    """Grade rows with their place within the charge: by count, then by grade."""
    return grades.withColumn("place", F.row_number().over(Window.partitionBy("charge_id").orderBy(F.desc("count"), "grade")))


def journey(raw: Column, held: Column, public: Column, superseded: Column, filed: Column, floor: str) -> Column:
    """Where a charge stands: before_floor, folded, pending, held, outcome or excluded."""
    return F.when(filed.isNull() | (filed < F.lit(floor).cast("date")), "before_floor").when(superseded & held, "folded").when(raw.isNull(), "pending").when(held, "held").when(public, "outcome").otherwise("excluded")


def volume_funnel(corpus: DataFrame) -> DataFrame:
    """Counts by stage for every clean charge identity with a counted journey.

    Reads charge_id (null where not clean) and stage (see ``journey``).
    """
    n = lambda stage: F.count_if(F.col("stage") == stage)
    counted = corpus.where("charge_id is not null and stage <> 'before_floor'").groupBy("charge_id").agg(F.count_if(F.col("stage") != "folded").alias("charges_seen"), n("outcome").alias("outcomes_recorded"), n("held").alias("held_for_court"), n("pending").alias("still_pending"), n("excluded").alias("disposed_excluded"), n("folded").alias("held_superseded"))
    return counted.where("charges_seen > 0")


def folded_preview(funnel: DataFrame, limit: int = 10) -> DataFrame:
    """Identities with most folded charges, then by id."""
    return funnel.select("charge_id", "held_superseded", "charges_seen").orderBy(F.desc("held_superseded"), "charge_id").limit(limit)


def volume_totals(corpus: DataFrame) -> DataFrame:
    """One row of corpus totals, unmatched and ambiguous charges included."""
    n = lambda cond: F.count_if(F.coalesce(cond, F.lit(False)))
    stage, inside = F.col("stage"), F.col("stage") != "before_floor"
    counted = inside & (stage != "folded")
    return corpus.agg(
        F.count("*").alias("rows_total"),
        n(~inside).alias("rows_pre_floor"),
        n(inside).alias("rows_in_universe"),
        n(stage == "folded").alias("superseded_folded"),
        n(counted & F.col("superseded")).alias("superseded_not_held_anomaly"),
        n(counted & (F.col("charge_method") == V.UNMATCHED)).alias("unmatched_rows"),
        n(counted & (F.col("charge_method") == V.AMBIGUOUS)).alias("ambiguous_rows"),
        n(stage == "outcome").alias("outcomes_total"),
        n(stage == "held").alias("held_total"),
        n(stage == "pending").alias("pending_total"),
        n(stage == "excluded").alias("excluded_total"),
        F.count_distinct(F.when(counted, F.col("charge_id"))).alias("identities_with_journeys"),
        (F.count_distinct(F.when(inside, F.col("charge_id"))) - F.count_distinct(F.when(counted, F.col("charge_id")))).alias("identities_fully_superseded"),
    )


def reason_tally(facts: DataFrame, eligible: str = "public_eligible") -> DataFrame:
    """How often each reason stands among facts that fail the gate."""
    return facts.where(~F.col(eligible)).select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def data_range(populations: list[DataFrame], floor: str = V.DATA_START) -> DataFrame:
    """One row: the floor and the latest end of several aggregate populations (the floor if none)."""
    ends = [p.select(F.max("date_range_end").alias("end")) for p in populations]
    every = ends[0]
    for e in ends[1:]:
        every = every.union(e)
    start = F.lit(floor).cast("date")
    return every.agg(F.coalesce(F.max("end"), start).alias("data_range_end")).select(start.alias("data_range_start"), "data_range_end")


def without_components(outcome_rows: DataFrame, component_rows: DataFrame) -> DataFrame:
    """Charges that have outcome aggregates and no sentencing aggregates."""
    return outcome_rows.select("charge_id").distinct().join(component_rows.select("charge_id").distinct(), "charge_id", "left_anti")
