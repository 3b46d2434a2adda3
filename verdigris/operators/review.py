"""The review queue: keyed items, first wins, kept status, and mechanical closing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import vocab as V
from ..functions.text import dedup_key

OPEN = ["open", "in_review"]


def produced(parts: dict[str, DataFrame]) -> DataFrame:
    """Items of several producers in one frame, each under its place (the first wins) and its name."""
    return reduce(DataFrame.unionByName, [rows.select("*", F.lit(k).alias("producer"), F.lit(name).alias("reason")) for k, (name, rows) in enumerate(parts.items(), 1)])


def build_items(outcomes: DataFrame, components: DataFrame, warnings: DataFrame, links: DataFrame) -> DataFrame:
    """The items that a build of facts gives to the queue: producer, dedup_key, item_type, severity,
    reason_code, entity_type, docket_id.

    Each table is read once, all items of a row coming from one array. Reads outcome facts, component facts
    with their docket_id, warnings (docket_id, charge_sequence or null, code) and resolved links (see
    ``linkage.resolve_links``). Keys are of the docket, the type and the place within; a component whose
    further categories would be lost has an item of its own only if it has no other but a duration's.
    """

    def items(rows: DataFrame, producer: int, *place: Column, **types: Column) -> DataFrame:
        made = F.array_compact(F.array(*[F.when(cond, F.lit(name.replace("__", "/"))) for name, cond in types.items()]))
        rows = rows.select(F.col("docket_id").cast("string").alias("docket_id"), *[p.cast("string").alias(f"_p{k}") for k, p in enumerate(place)], F.explode(made).alias("case"))
        rows = rows.withColumn("item_type", F.substring_index("case", "/", 1))
        key = dedup_key(F.col("docket_id"), F.col("item_type"))
        for k in range(len(place)):  # an unknown place is the docket's own
            key = F.when(F.col(f"_p{k}").isNull(), key).otherwise(F.concat_ws("\x1f", key, f"_p{k}"))
        return rows.select(F.lit(producer).alias("producer"), key.alias("dedup_key"), "item_type", "docket_id", "case")

    has = lambda r: F.array_contains("reasons", r)
    method, c_method = F.col("charge_method"), F.col("component_method")
    found = (c_method != V.EXACT) | has("money_amount_unparseable")
    wanted = F.col("code")
    every = [
        items(outcomes, 1, F.col("outcome_id"), unmapped_charge=method == V.UNMATCHED, ambiguous_charge=(method == V.AMBIGUOUS) & ~has("blocking_warning"), ambiguous_charge__conflict=(method == V.AMBIGUOUS) & has("blocking_warning"), unmapped_disposition=F.col("outcome_method") == V.UNMATCHED),
        items(components, 2, F.col("sentence_id"), unmapped_sentencing_component=c_method == V.UNMATCHED, ambiguous_sentencing_component=c_method == V.AMBIGUOUS, money_unparseable=has("money_amount_unparseable"), duration_unparseable=has("sentence_duration_unparseable"), additive_sentencing_category=(F.col("n_categories") > 1) & ~found),
        items(warnings, 3, F.col("charge_sequence"), missing_disposition_date=wanted == "MISSING_DISPOSITION_DATE", sentinel_collision=wanted == "SENTINEL_COLLISION"),
        items(links, 4, unresolvable_cross_court_reference=F.col("outcome").isin("malformed", "ambiguous_target")),
    ]
    about = F.create_map(*[F.lit(x) for k, v in V.REVIEW_ITEMS.items() for x in (k, "|".join(p or "" for p in v))])
    parts = F.split(about[F.col("case")], r"\|")
    rows = reduce(DataFrame.unionByName, every)
    return rows.withColumns({"severity": parts[0], "reason_code": parts[1], "entity_type": F.nullif(parts[2], F.lit(""))}).drop("case")


def candidate_context(candidates: Column) -> Column:
    """JSON of an item's candidates (array of structs normalized_id, display_name), in order of id."""
    return F.to_json(F.struct(F.array_sort(candidates).alias("candidates")))


def first_of_each(items: DataFrame, *order: Column) -> DataFrame:
    """One item for each dedup_key: the first in the order of producer, then of ``order``."""
    rank = F.row_number().over(Window.partitionBy("dedup_key").orderBy("producer", *order))
    return items.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def insert_absent(queue: DataFrame, items: DataFrame) -> DataFrame:
    """Items whose key the queue lacks, with status open. Items that it has keep their status."""
    return items.join(queue.select("dedup_key"), "dedup_key", "left_anti").withColumn("status", F.lit("open"))


def stale(queue: DataFrame, generated: DataFrame) -> DataFrame:
    """Open items that the latest build no longer gives."""
    return queue.where("status = 'open'").join(generated.select("dedup_key"), "dedup_key", "left_anti")


def held(queue: DataFrame, candidates: DataFrame) -> DataFrame:
    """Open items on charges that have been found to be held."""
    return queue.where("status = 'open'").join(candidates.select("dedup_key"), "dedup_key", "left_semi")


def close(queue: DataFrame, keys: DataFrame, status: str = "dismissed") -> DataFrame:
    """The queue with the named items closed; closed ones stay as they are."""
    hit = keys.select("dedup_key").distinct().withColumn("_hit", F.lit(True))
    rows = queue.join(hit, "dedup_key", "left")
    return rows.withColumn("status", F.when(F.col("_hit") & F.col("status").isin(OPEN), status).otherwise(F.col("status"))).drop("_hit")
