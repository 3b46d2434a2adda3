"""Life of a run: generated, validated, published, invalidated; one active run at a time.

The table of runs is small (a row a run) and is rewritten whole in one commit; aggregate tables are
written before, so a reader that goes through it never sees a part of a run.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ACTIVE = "published_at is not null and invalidated_at is null"


class RunRefused(Exception):
    """The run cannot take this step."""


def latest(runs: DataFrame, *, status: str = "completed", by: str = "completed_at") -> DataFrame:
    """The latest run of a status, as at most one row (ties: the smallest id)."""
    return runs.where(F.col("status") == status).orderBy(F.desc_nulls_last(by), "id").limit(1)


def recent(runs: DataFrame, n: int, by: str = "started_at") -> DataFrame:
    """The latest runs of any status, newest first."""
    return runs.orderBy(F.desc_nulls_last(by), "id").limit(n)


def active(runs: DataFrame) -> DataFrame:
    """The published run that is not invalidated, as at most one row."""
    return runs.where(ACTIVE).orderBy(F.desc("published_at"), "id").limit(1)


def validated(runs: DataFrame, run_id: str, sound: bool, at: str) -> DataFrame:
    """The runs with the verdict on one of them; a run that has failed stays failed."""
    own = (F.col("id") == run_id) & (F.col("status") == "in_progress")
    return runs.withColumns({"status": F.when(own, F.lit("completed" if sound else "failed")).otherwise(F.col("status")), "completed_at": F.when(own, F.lit(at).cast("timestamp")).otherwise(F.col("completed_at"))})


def published(runs: DataFrame, at: str, run_id: str | None = None) -> DataFrame:
    """The runs with one published and the run that was active invalidated, in one step.

    Without ``run_id`` the latest completed run is taken, unless the active one was validated later.
    Publishing the active run changes nothing.
    """
    pick = (runs.where(F.col("id") == run_id) if run_id else latest(runs)).select("id", "status", "completed_at", "invalidated_at").head()
    now = active(runs).select("id", "completed_at").head()
    if pick is None or pick["status"] != "completed":
        raise RunRefused("no completed run to publish")
    if pick["invalidated_at"] is not None:
        raise RunRefused("an invalidated run is not published again")
    if now is not None and now["id"] == pick["id"]:
        return runs
    if run_id is None and now is not None and pick["completed_at"] < now["completed_at"]:
        raise RunRefused("the active run was validated later than the candidate")
    time = F.lit(at).cast("timestamp")
    ends = F.expr(ACTIVE)
    rows = runs.withColumn("_ends", ends)
    return rows.withColumns(
        {
            "published_at": F.when(F.col("id") == pick["id"], time).otherwise(F.col("published_at")),
            "invalidated_at": F.when(F.col("_ends"), time).otherwise(F.col("invalidated_at")),
            "invalidated_reason": F.when(F.col("_ends"), "superseded").otherwise(F.col("invalidated_reason")),
        }
    ).drop("_ends")


def broken_constraints(runs: DataFrame) -> DataFrame:
    """code, violations: statuses, order of steps, and the single active run."""
    n = F.count_if
    flags = runs.agg(
        n(~F.col("status").isin("in_progress", "completed", "failed")).alias("status"),
        n(F.col("published_at").isNotNull() & (F.col("status") != "completed")).alias("published_not_completed"),
        n(F.col("invalidated_at").isNotNull() & F.col("published_at").isNull()).alias("invalidated_not_published"),
        n(F.col("invalidated_at").isNull() != F.col("invalidated_reason").isNull()).alias("reason_without_time"),
        F.greatest(n(F.expr(ACTIVE)) - 1, F.lit(0)).alias("several_active"),
    )
    return flags.select(F.explode(F.array(*[F.struct(F.lit(c).alias("code"), F.col(c).alias("violations")) for c in flags.columns])).alias("x")).select("x.*")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those with the same key."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def upsert_where_changed(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The same with a column ``change``: inserted, updated, unchanged, or kept where ``new`` has no such row."""
    rest = [c for c in old.columns if c != key]
    a = old.select(key, F.struct(*rest).alias("was"))
    b = new.select(key, F.struct(*rest).alias("now"))
    change = F.when(F.col("was").isNull(), "inserted").when(F.col("now").isNull(), "kept").when(F.col("was").eqNullSafe(F.col("now")), "unchanged").otherwise("updated")
    rows = a.join(b, key, "full_outer").withColumn("change", change).withColumn("row", F.coalesce("now", "was"))
    return rows.select(key, "row.*", "change")


def sweep(rows: DataFrame, registry: DataFrame, key: str, references: list[DataFrame]) -> DataFrame:
    """key, action of seeded rows: keep what the registry lists, delete the rest, blocked where a row of
    ``references`` (frames with the same key) still points at it. A preview; ``swept`` applies it."""
    listed = registry.select(key).distinct().withColumn("_listed", F.lit(True))
    used = reduce(DataFrame.union, [r.select(key) for r in references]).distinct().withColumn("_used", F.lit(True))
    out = rows.select(key).join(listed, key, "left").join(used, key, "left")
    return out.select(key, F.when(F.col("_listed"), "keep").when(F.col("_used"), "blocked").otherwise("delete").alias("action"))


def swept(rows: DataFrame, preview: DataFrame, key: str) -> DataFrame:
    """The rows that stay; none is deleted while one is blocked."""
    if not preview.where("action = 'blocked'").isEmpty():
        raise RunRefused("rows that would go are still in use")
    return rows.join(preview.where("action = 'delete'").select(key), key, "left_anti")
