"""Collection as streams: ledgers that only grow, daily windows, streaks and keyed merges.

Each has the batch form of ``operators.collector``; results of a finished stream equal it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.collector import COMPLETING, applied_versions, split_scopes, version_decision
from ..vocab import STREAK_STOP
from .buckets import Buckets


def daily_attempts(attempts: DataFrame, *, delay: str = "2 days") -> DataFrame:
    """day, outcome, n of a stream with ts; a day is final once the watermark has passed it."""
    return attempts.withWatermark("ts", delay).groupBy(F.window("ts", "1 day").alias("w"), "outcome").agg(F.count("*").alias("n")).select(F.col("w.start").cast("date").alias("day"), "outcome", "n")


def completed_windows(ledger: DataFrame) -> DataFrame:
    """day, court, done of a ledger stream. Completion is a maximum, so late and repeated entries are
    harmless and nothing is revoked; state is one row a day and court."""
    done = F.max((F.col("outcome").isin(COMPLETING) & (F.coalesce("fetch_failures", F.lit(0)) == 0)).cast("int"))
    return split_scopes(ledger).groupBy("day", "court").agg((done == 1).alias("done"))


def first_attempts(attempts: DataFrame, key: str, *, delay: str = "30 days") -> DataFrame:
    """Each key once; state is forgotten ``delay`` behind the watermark."""
    return attempts.withWatermark("ts", delay).dropDuplicatesWithinWatermark([key])


def folded(outcomes: np.ndarray, blocks: int, errors: int, stop: int) -> tuple[int, int, int, str]:
    """(attempts taken, block streak, error streak, stop reason) of outcomes that follow these streaks.

    The same summary as in the batch form: what a slice counts by itself, and the streak that reaches it
    up to the slice's first end.
    """
    live, blocked, error = np.isin(outcomes, ["hit", "miss"]), outcomes == "blocked", outcomes == "error"

    def streak(step: np.ndarray, ends: np.ndarray, before: int) -> np.ndarray:
        total = np.cumsum(step) + before
        return total - np.maximum.accumulate(np.where(ends, total, 0))

    b, e = streak(blocked, live, blocks), streak(error, live | blocked, errors)
    trips = np.flatnonzero((blocked & (b >= stop)) | (error & (e >= stop)))
    last = int(trips[0]) if len(trips) else len(outcomes) - 1
    return last + 1, int(b[last]), int(e[last]), "" if not len(trips) else "block_streak" if blocked[last] else "error_streak"


def streak_states(attempts: DataFrame, *, stop: int = STREAK_STOP) -> DataFrame:
    """run, attempts, block_streak, error_streak, stop_reason of a stream (run, ts, seq, outcome).

    State is four numbers a run. Rows of one trigger are taken in order of ts and seq, as one slice whose
    summary is folded into the state; a run that has stopped takes no more.
    """

    def advance(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, blocks, errors, reason = state.get if state.exists else (0, 0, 0, "")
        rows = pd.concat(list(frames)).sort_values(["ts", "seq"], kind="stable")
        if not reason and len(rows):
            taken, blocks, errors, reason = folded(rows["outcome"].to_numpy(object), blocks, errors, stop)
            n += taken
        state.update((n, blocks, errors, reason))
        yield pd.DataFrame({"run": [key[0]], "attempts": [n], "block_streak": [blocks], "error_streak": [errors], "stop_reason": [reason or None]})

    return attempts.groupBy("run").applyInPandasWithState(advance, f"run {attempts.schema['run'].dataType.simpleString()}, attempts long, block_streak long, error_streak long, stop_reason string", "n long, blocks long, errors long, reason string", "update", GroupStateTimeout.NoTimeout)


def merge_each(root: str, key: str, version: str, *, buckets: int = 64):
    """A ``foreachBatch`` function that keeps the highest version of each key below ``root``.

    A trigger reads and writes the buckets of its own keys only (see ``streaming.buckets``); one that is
    repeated changes nothing. Read with ``merged``.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        table = Buckets(batch.sparkSession, root, [key], buckets)
        touched = table.touched(batch)
        old = table.read(touched, batch_id - 1)
        rows = batch if old is None else old.select(*batch.columns).unionByName(batch)
        table.replace(rows.groupBy(key).agg(F.max_by(F.struct(*batch.columns), version).alias("r")).select("r.*"), touched, batch_id)

    return merge


def merged(spark: SparkSession, root: str, generation: int | None = None) -> DataFrame | None:
    """The rows after a generation that is still kept (the last, unless given); None before the first."""
    return Buckets(spark, root, ["_"]).read(generation=generation)


def apply_each(root: str, known_versions: list[tuple[int, int]], empty: DataFrame, *, buckets: int = 64):
    """A ``foreachBatch`` function that applies the version decisions of ``operators.collector`` to the table
    of loaded envelopes below ``root``: refused, skipped and stale ones change nothing, superseded ones are
    marked. ``empty`` has the table's columns. Read with ``loaded_envelopes``.

    Envelopes lie in buckets by file hash. A second table holds, in buckets by docket and court, the files
    that are parsed for each, so that what a new file supersedes is found without a look at other buckets.
    A trigger costs the buckets of its own files, of the files they supersede, and of their dockets; its
    decisions are added to a log, a folder a trigger.
    """
    docket = ["docket_number", "court"]

    def apply(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows, index = Buckets(spark, f"{root}/rows", ["file_hash"], buckets), Buckets(spark, f"{root}/index", docket, buckets)
        before = batch_id - 1  # what this trigger found, also if it stopped half-way and is repeated
        entry = rows.read(rows.touched(batch), before)
        entry = empty if entry is None else entry
        # dockets of this trigger, and those that its files were loaded for before
        mine = batch.select(*docket).unionByName(entry.join(batch.select("file_hash"), "file_hash", "left_semi").select(*docket)).distinct()
        places = index.touched(mine)
        known = index.read(places, before)
        known = empty.select("file_hash", *docket) if known is None else known
        same = known["docket_number"].eqNullSafe(mine["docket_number"]) & known["court"].eqNullSafe(mine["court"])
        twins = known.join(mine, same, "left_semi")
        touched = sorted({*rows.touched(batch), *rows.touched(twins)})
        old = rows.read(touched, before)
        old = (empty if old is None else old).select(*empty.columns)
        decided = version_decision(batch, old, known_versions).select("file_hash", "decision", F.lit(batch_id).cast("long").alias("trigger"))
        decided.write.mode("overwrite").parquet(f"{root}/log/trigger={batch_id}")
        new = applied_versions(batch, old, known_versions)
        parsed = new.where("raw_status = 'parsed'").select("file_hash", *docket)
        others = known.select("file_hash", *docket).join(old.select("file_hash"), "file_hash", "left_anti")
        inside = parsed.where(index.bucket().isin(places)) if places else parsed.limit(0)
        index.replace(others.unionByName(inside), places, batch_id)
        rows.replace(new, touched, batch_id)

    return apply


def loaded_envelopes(spark: SparkSession, root: str, generation: int | None = None) -> DataFrame | None:
    """The envelopes after a trigger that is still kept (the last, unless given)."""
    return Buckets(spark, f"{root}/rows", ["file_hash"]).read(generation=generation)


def decision_log(spark: SparkSession, root: str) -> DataFrame:
    """file_hash, decision, trigger of all triggers."""
    return spark.read.schema("file_hash string, decision string, trigger long").parquet(f"{root}/log")
