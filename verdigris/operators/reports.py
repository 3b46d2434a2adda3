"""Coverage and distinct-value reports: counts of values, by distinct value and by row."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import vocab as V
from ..functions.numbers import percent
from ..functions.text import distinct_cents, fine_beyond_label, mentions_community_service, mentions_hours, mentions_restitution

NAME = re.compile(r"[a-z_][a-z0-9_]*(\.[a-z_][a-z0-9_]*)*")


def safe_column(name: str) -> Column:
    """A column by a plain lower-case name."""
    if not NAME.fullmatch(name):
        raise ValueError(f"{name!r} is no plain column name")
    return F.col(name)


def value_counts(rows: DataFrame, columns: list[str]) -> DataFrame:
    """column, value (as text, null kept), n: all columns in one pass."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), safe_column(c).cast("string").alias("value")) for c in columns])
    return rows.select(F.explode(pairs).alias("p")).groupBy("p.column", "p.value").agg(F.count("*").alias("n"))


def coverage_buckets(counts: DataFrame, floors: list[int] = V.COVERAGE_FLOORS) -> DataFrame:
    """For each column and floor: distinct values at least that frequent, the rows they cover, and the share."""
    levels = F.explode(F.array(*[F.lit(k) for k in floors])).alias("floor")
    each = counts.groupBy("column").agg(F.sum("n").alias("total"), *[F.struct(F.count_if(F.col("n") >= k).alias("d"), F.coalesce(F.sum(F.when(F.col("n") >= k, F.col("n"))), F.lit(0)).alias("c")).alias(f"at_{k}") for k in floors])
    at = lambda field: F.coalesce(*[F.when(F.col("floor") == k, F.col(f"at_{k}.{field}")) for k in floors])
    return each.select("*", levels).select("column", "floor", at("d").alias("distinct_values"), at("c").alias("rows_covered"), percent(at("c"), F.col("total"), 1).alias("coverage_pct"))


def value_summary(counts: DataFrame) -> DataFrame:
    """For each column: distinct values, null rows, blank rows."""
    return counts.groupBy("column").agg(F.count("*").alias("distinct_values"), F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("null_rows"), F.coalesce(F.sum(F.when(F.trim("value") == "", F.col("n"))), F.lit(0)).alias("blank_rows"))


def method_coverage(pairs: DataFrame) -> DataFrame:
    """method, distinct_pairs, rows of matched pairs (method, n), with every method of the vocabulary."""
    names = pairs.sparkSession.createDataFrame([(m,) for m in (V.EXACT, V.ALIAS, V.STATUTE, V.PATTERN, V.UNMATCHED, V.AMBIGUOUS)], "method string")
    seen = pairs.groupBy("method").agg(F.count("*").alias("distinct_pairs"), F.sum("n").alias("rows"))
    return names.join(seen, "method", "left").select("method", F.coalesce("distinct_pairs", F.lit(0)).alias("distinct_pairs"), F.coalesce("rows", F.lit(0)).alias("rows"))


def dominant_pairing(pairs: DataFrame) -> DataFrame:
    """The most frequent offense of each statute (ties: the text that sorts first), and the statute's rows."""
    by = Window.partitionBy("statute")
    ranked = pairs.withColumns({"rank": F.row_number().over(by.orderBy(F.desc("n"), F.asc_nulls_last("offense"))), "statute_rows": F.sum("n").over(by)})
    return ranked.where("rank = 1").select("statute", "offense", "n", "statute_rows")


def disposition_coverage(values: DataFrame) -> DataFrame:
    """kind (mapped, unmapped, held, absent), distinct_values, rows of raw dispositions (raw, n)."""
    known = [f for forms in V.DISPOSITIONS.values() for f in forms]
    raw = F.col("raw")
    kind = F.when(raw.isNull(), "absent").when(raw.isin(V.HELD_FORMS), "held").when(raw.isin(known), "mapped").otherwise("unmapped")
    return values.groupBy(kind.alias("kind")).agg(F.count("*").alias("distinct_values"), F.sum("n").alias("rows"))


def sentencing_recon(sentences: DataFrame) -> DataFrame:
    """For each sentence type: counts of money (0, 1, 2+ distinct amounts) and of telling words."""
    text = F.coalesce("raw_text", F.lit(""))
    cents = F.size(distinct_cents(text))
    restitution = mentions_restitution(text) | F.coalesce(mentions_restitution(F.col("sentence_type")), F.lit(False))
    n = F.count_if
    return sentences.groupBy(F.coalesce("sentence_type", F.lit("<null>")).alias("sentence_type")).agg(
        F.count("*").alias("rows"),
        n(cents == 0).alias("money_0"),
        n(cents == 1).alias("money_1"),
        n(cents >= 2).alias("money_2_more"),
        n(restitution).alias("restitution"),
        n(restitution & (cents == 0)).alias("restitution_without_money"),
        n(mentions_community_service(text)).alias("community_service"),
        n(~mentions_community_service(text) & mentions_hours(text)).alias("hours_only"),
        n(F.contains(text, F.lit("$"))).alias("has_dollar"),
        n(fine_beyond_label(text)).alias("fine_beyond_label"),
    )


def name_coverage(rows: DataFrame, fields: dict[str, str]) -> DataFrame:
    """field, kind, distinct_values, rows for judge fields ({raw column: method column}): absent (no name given)
    apart from unmatched, and every method, by distinct value and by row."""
    pairs = F.array(*[F.struct(F.lit(raw).alias("field"), F.col(raw).alias("value"), F.col(method).alias("method")) for raw, method in fields.items()])
    each = rows.select(F.explode(pairs).alias("p")).select("p.*").withColumn("kind", F.when(F.trim(F.coalesce("value", F.lit(""))) == "", "absent").otherwise(F.coalesce("method", F.lit(V.UNMATCHED))))
    by_value = each.groupBy("field", "kind", "value").agg(F.count("*").alias("n"))
    return by_value.groupBy("field", "kind").agg(F.count("*").alias("distinct_values"), F.sum("n").alias("rows"))


def sentencing_coverage(components: DataFrame) -> DataFrame:
    """kind, n: components of one category (base), of several (additive), of none or unknown (ambiguous), and of
    monetary ones those with and without an amount. Reads categories (array) and amount_cents."""
    size = F.size("categories")
    known = F.filter("categories", lambda c: c != V.UNKNOWN)
    money = F.exists("categories", lambda c: c.isin(V.MONETARY))
    kinds = {"base": (size == 1) & (F.size(known) == 1), "additive": F.size(known) > 1, "ambiguous": F.size(known) == 0, "money_with_amount": money & F.col("amount_cents").isNotNull(), "money_without_amount": money & F.col("amount_cents").isNull()}
    counts = components.agg(*[F.count_if(F.coalesce(cond, F.lit(False))).alias(k) for k, cond in kinds.items()])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("n")) for k in kinds])).alias("x")).select("x.*")


def search_report(windows: DataFrame, attempts: DataFrame) -> DataFrame:
    """One row for each court: windows by outcome, attempts, hits, and whether hits are all that windows found.

    windows: court, outcome, found; attempts: court, outcome.
    """
    a = windows.groupBy("court").agg(F.count("*").alias("windows"), *[F.count_if(F.col("outcome") == o).alias(o) for o in ("complete", "empty", "truncated", "blocked")], F.sum("found").alias("found"))
    b = attempts.groupBy("court").agg(F.count("*").alias("attempts"), F.count_if(F.col("outcome") == "hit").alias("hits"))
    return a.join(b, "court", "full_outer").withColumn("reconciles", F.coalesce("hits", F.lit(0)) == F.coalesce("found", F.lit(0)))


def refresh_report(changes: DataFrame) -> DataFrame:
    """One row: targets, new, changed, unchanged, and whether they add up."""
    n = lambda kind: F.count_if(F.col("change") == kind).alias(kind)
    row = changes.agg(F.count("*").alias("targets"), n("new"), n("changed"), n("unchanged"))
    return row.withColumn("reconciles", F.col("new") + F.col("changed") + F.col("unchanged") == F.col("targets"))


SPEC = re.compile(r"([a-z_][a-z0-9_]*)\.([a-z_][a-z0-9_]*)(?:\.([a-z_][a-z0-9_]*))?")


def spec_values(tables: dict[str, DataFrame], specs: list[str]) -> DataFrame:
    """column (the spec), value, n for specs ``table.column`` or ``table.column.key``, the key in a JSON text."""
    found = []
    for spec in specs:
        m = SPEC.fullmatch(spec)
        if not m or m[1] not in tables:
            raise ValueError(f"{spec!r} names no column of a known table")
        value = F.get_json_object(m[2], f"$.{m[3]}") if m[3] else F.col(m[2]).cast("string")
        found.append(tables[m[1]].groupBy(value.alias("value")).agg(F.count("*").alias("n")).select(F.lit(spec).alias("column"), "value", "n"))
    return reduce(DataFrame.unionByName, found)


def token_partition(tokens: DataFrame) -> DataFrame:
    """Disposition tokens by where they dispose: reads token and not_final_only (boolean) for each charge."""
    counted = tokens.groupBy("token").agg(F.count("*").alias("n"), F.count_if("not_final_only").alias("not_final_only"))
    return counted.withColumn("kind", F.when(F.col("not_final_only") == 0, "NON_TERMINAL").when(F.col("not_final_only") == F.col("n"), "ARD_CLASS").otherwise("MIXED"))


def outcome_pivot(attempts: DataFrame, outcomes: list[str]) -> DataFrame:
    """One row for each court: attempts, one column for each outcome, and whether they add up."""
    counts = [F.count_if(F.col("outcome") == o).alias(o) for o in outcomes]
    rows = attempts.groupBy("court").agg(F.count("*").alias("attempts"), *counts)
    total = sum((F.col(o) for o in outcomes), F.lit(0))
    return rows.withColumn("reconciles", total == F.col("attempts"))


def with_zeros(counts: DataFrame, key: str, values: list[str]) -> DataFrame:
    """Counts (key, n) in a fixed vocabulary, absent ones 0."""
    names = counts.sparkSession.createDataFrame([(i, v) for i, v in enumerate(values)], f"place int, {key} string")
    return names.join(counts, key, "left").select("place", key, F.coalesce("n", F.lit(0)).alias("n"))


def extraction_evaluation(pages: DataFrame, keywords: list[str]) -> DataFrame:
    """For each extractor: documents, pages, empty pages, mean signs a page, pages with each keyword."""
    size = F.length(F.trim("text"))
    return pages.groupBy("extractor").agg(F.count_distinct("document").alias("documents"), F.count("*").alias("pages"), F.count_if(size == 0).alias("empty_pages"), F.avg(size).alias("mean_signs"), *[F.count_if(F.contains(F.col("text"), F.lit(k))).alias(re.sub(r"\W+", "_", k.lower())) for k in keywords])
