"""Served queries over one published run: search, directories, results, coverage.

Text is ordered by bytes. Result sets are small by construction (a limit, or one charge).
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import vocab as V
from ..functions.numbers import months_of
from ..functions.text import match_rank

UUID = re.compile(r"[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}", re.I)


class InvalidQuery(ValueError):
    """A request outside what the interface takes."""


def _query(q: str, limit: int) -> str:
    q = q.strip()
    if not 1 <= len(q) <= 100 or not 1 <= limit <= 25:
        raise InvalidQuery("a query has 1 to 100 signs and a limit of 1 to 25")
    return q


def search(roster: DataFrame, q: str, limit: int = 10, *, by_statute: bool = True) -> DataFrame:
    """Active entries whose name, statute or alias holds ``q``: 1 equal, 2 begins so, 3 holds it.

    matched_alias is the alias that sorts first among those that fit, if the name does not fit.
    Columns of ``roster``: id, slug, display_name, aliases (array) and, for charges, statute.
    """
    q = _query(q, limit)
    name = match_rank(F.col("display_name"), q)
    aliases = F.transform("aliases", lambda a: F.struct(match_rank(a, q).alias("rank"), a.alias("alias")))
    hits = F.filter(aliases, lambda x: x["rank"].isNotNull())
    ranks = [name, F.array_min(F.transform(hits, lambda x: x["rank"]))] + ([match_rank(F.col("statute"), q)] if by_statute else [])
    rows = roster.withColumns({"match_rank": F.least(*ranks), "matched_alias": F.when(name.isNull(), F.array_min(F.transform(hits, lambda x: x["alias"])))})
    found = rows.where("match_rank is not null").select("id", "slug", "display_name", *(["statute"] if by_statute else []), "match_rank", "matched_alias")
    return found.orderBy("match_rank", "display_name", "slug").limit(limit)


def by_id_or_slug(roster: DataFrame, key: str) -> DataFrame:
    """The entry with this id if the key looks like one, else with this slug; never both."""
    return roster.where(F.col("id" if UUID.fullmatch(key) else "slug") == key)


def directory(roster: DataFrame, outcome_rows: DataFrame, component_rows: DataFrame) -> DataFrame:
    """Charges with outcomes: sample size and whether sentences are there; largest first."""
    sizes = outcome_rows.groupBy("charge_id").agg(F.max("sample_size").alias("sample_size"))
    sentenced = component_rows.select("charge_id").distinct().withColumn("s", F.lit(True))
    rows = roster.join(sizes, roster.id == sizes.charge_id).join(sentenced, "charge_id", "left")
    return rows.select("id", "slug", "display_name", "sample_size", F.col("s").isNotNull().alias("has_sentencing")).orderBy(F.desc("sample_size"), F.lower("display_name"), "slug")


def in_order(rows: DataFrame, categories: list[tuple[str, bool]]) -> DataFrame:
    """Rows of public categories in the order of presentation."""
    place = F.create_map(*[F.lit(x) for k, (code, shown) in enumerate(categories) if shown for x in (code, k + 1)])
    return rows.withColumn("sort_order", F.element_at(place, F.col("category_code"))).where("sort_order is not null").orderBy("sort_order")


def charge_state(charges: DataFrame, outcome_rows: DataFrame, volume: DataFrame) -> DataFrame:
    """charge_id, arm: success, volume_only or unavailable, for every charge at once."""
    has = lambda df, name: df.select("charge_id").distinct().withColumn(name, F.lit(True))
    rows = charges.join(has(outcome_rows, "o"), "charge_id", "left").join(has(volume, "v"), "charge_id", "left")
    return rows.select("charge_id", F.when(F.col("o").isNotNull(), "success").when(F.col("v").isNotNull(), "volume_only").otherwise("unavailable").alias("arm"))


def pair_state(pairs: DataFrame, charge_rows: DataFrame, judge_rows: DataFrame) -> DataFrame:
    """charge_id, judge_id, state by (baseline there, judge rows there); a judge without baseline is a fault."""
    base = charge_rows.select("charge_id").distinct().withColumn("b", F.lit(True))
    own = judge_rows.select("charge_id", "judge_id").distinct().withColumn("j", F.lit(True))
    rows = pairs.join(base, "charge_id", "left").join(own, ["charge_id", "judge_id"], "left")
    b, j = F.col("b").isNotNull(), F.col("j").isNotNull()
    return rows.select("charge_id", "judge_id", F.when(b & j, "success").when(b, "baseline_only").when(j, "integrity_error").otherwise("unavailable").alias("state"))


def _listed(rows: DataFrame, key: str | list[str], name: str, order: str, *fields: str) -> DataFrame:
    """The rows of each key as one array in their order; a few rows a key."""
    keys = [key] if isinstance(key, str) else key
    return rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(order, *fields))).alias(name))


def distribution_block(rows: DataFrame, keys: list[str], categories: list[tuple[str, bool]] = V.OUTCOME_CATEGORIES, sample: str = "sample_size") -> DataFrame:
    """keys, sample_size, is_thin_data (of any row), uniform (one sample size in all rows), outcomes in order."""
    shown = in_order(rows, categories)
    sizes = rows.groupBy(*keys).agg(F.max(sample).alias("sample_size"), F.bool_or("is_thin_data").alias("is_thin_data"), (F.min(sample) == F.max(sample)).alias("uniform"))
    return sizes.join(_listed(shown, keys, "outcomes", "sort_order", "category_code", "count", "percentage"), keys, "left")


def charge_result(roster: DataFrame, outcome_rows: DataFrame, summary: DataFrame, categories: DataFrame, grades: DataFrame, funnel: DataFrame) -> DataFrame:
    """One row for each charge of the roster: arm (success, volume_only, unavailable) and what it shows.

    success: the distribution block, the sentencing index with months, grades in order, volume;
    volume_only: volume alone. A key that is not in the roster has no row (not found).
    """
    block = distribution_block(outcome_rows, ["charge_id"])
    index = _listed(index_block(categories), "charge_id", "index", "category_code", "conviction_count", "percentage", "median_min_months", "median_max_months", "min_assumed_percentage")
    graded = _listed(grades.select("charge_id", (-F.col("count")).alias("by"), "grade", "count", "percentage"), "charge_id", "grades", "by", "grade", "count", "percentage")
    own = summary.select("charge_id", F.struct("convictions", "sentenced_convictions", "wedge_count", "wedge_percentage").alias("summary"))
    volume = funnel.select("charge_id", F.struct(*[c for c in funnel.columns if c != "charge_id"]).alias("volume"))
    rows = roster.select(F.col("id").alias("charge_id"), "slug", "display_name")
    for part in (block, own, index, graded, volume):
        rows = rows.join(part, "charge_id", "left")
    arm = F.when(F.col("outcomes").isNotNull(), "success").when(F.col("volume").isNotNull(), "volume_only").otherwise("unavailable")
    return rows.withColumn("arm", arm)


def judge_result(pairs: DataFrame, charge_rows: DataFrame, judge_rows: DataFrame) -> DataFrame:
    """One row for each pair: state, the judge's outcomes and, wherever they are there, the charge's as baseline."""
    base = distribution_block(charge_rows, ["charge_id"]).select("charge_id", F.col("outcomes").alias("baseline"), F.col("sample_size").alias("baseline_size"))
    own = distribution_block(judge_rows, ["charge_id", "judge_id"]).select("charge_id", "judge_id", "outcomes", "sample_size", "is_thin_data")
    rows = pair_state(pairs, charge_rows, judge_rows)
    return rows.join(base, "charge_id", "left").join(own, ["charge_id", "judge_id"], "left")


def integrity(rows: DataFrame, keys: list[str], judge_rows: DataFrame | None = None, index: DataFrame | None = None, categories: list[tuple[str, bool]] = V.OUTCOME_CATEGORIES) -> DataFrame:
    """code, violations of what is served: cells of several sample sizes, codes that are not public, index rows
    whose three duration figures are not all there or all absent, judge rows whose category the baseline lacks."""
    public = [code for code, shown in categories if shown]
    found = [
        rows.groupBy(*keys).agg((F.min("sample_size") != F.max("sample_size")).alias("bad")).agg(F.count_if("bad").alias("violations")).withColumn("code", F.lit("sample_size_not_uniform")),
        rows.agg(F.count_if(~F.col("category_code").isin(public)).alias("violations")).withColumn("code", F.lit("code_not_public")),
    ]
    if index is not None:
        there = [F.col(c).isNotNull().cast("int") for c in ("median_min_days", "median_max_days", "min_assumed_percentage")]
        found.append(index.agg(F.count_if(~(there[0] + there[1] + there[2]).isin(0, 3)).alias("violations")).withColumn("code", F.lit("duration_trio_broken")))
    if judge_rows is not None:
        outside = judge_rows.join(rows.select("charge_id", "category_code"), ["charge_id", "category_code"], "left_anti")
        found.append(outside.agg(F.count("*").alias("violations")).withColumn("code", F.lit("baseline_not_superset")))
    return reduce(DataFrame.unionByName, found).select("code", "violations")


def methodology(spark, facts: dict[str, str]) -> DataFrame:
    """key, value of what the served pages say of the method: the floors, thresholds and versions in force."""
    return spark.createDataFrame(sorted({"taxonomy_version": V.TAXONOMY_VERSION, "thin_sample": str(V.THIN_SAMPLE), **facts}.items()), "key string, value string")


def index_block(categories: DataFrame) -> DataFrame:
    """Category rows of the sentencing index with medians in months."""
    return categories.withColumns({"median_min_months": months_of(F.col("median_min_days")), "median_max_months": months_of(F.col("median_max_days"))})


def coverage(outcome_rows: DataFrame, component_rows: DataFrame, judge_rows: DataFrame) -> DataFrame:
    """One row: charges with outcomes, with sentences, (charge, judge) pairs, and availability."""
    one = lambda df, c, name: df.agg(F.count_distinct(c).alias(name))
    rows = one(outcome_rows, F.col("charge_id"), "charges_with_outcomes").join(one(component_rows, F.col("charge_id"), "charges_with_sentencing")).join(one(judge_rows, F.struct("charge_id", "judge_id"), "charge_judge_pairs"))
    return rows.withColumn("available", F.col("charges_with_outcomes") > 0)


def definitions(spark, categories: list[tuple[str, bool]] = V.OUTCOME_CATEGORIES) -> DataFrame:
    """Public categories with their order."""
    return spark.createDataFrame([(k + 1, code) for k, (code, shown) in enumerate(categories) if shown], "sort_order int, code string")


def contains_filter(rows: DataFrame, needle: str, *columns: str) -> DataFrame:
    """Rows that hold the needle in one of the columns; case does not count; a blank one keeps all."""
    low = needle.strip().lower()
    cond: Column = F.lit(not low)
    for c in columns:
        cond = cond | F.coalesce(F.contains(F.lower(c), F.lit(low)), F.lit(False))
    return rows.where(cond)
