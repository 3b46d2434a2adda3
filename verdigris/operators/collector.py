"""Incremental collection: outcome classes, streaks, batches, daily windows, version decisions.

Order-dependent rules are windows over an explicit order within slices of a run, joined by a scan over the
slices' summaries; never loops.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import vocab as V


def fetch_outcome(*, error: Column, bot_check: Column, rate_limited: Column, unauthorized: Column, pdf_ok: Column, no_results: Column) -> Column:
    """error, then blocked, hit, miss; anything unknown is blocked."""
    return F.when(error, "error").when(bot_check | rate_limited | unauthorized, "blocked").when(pdf_ok, "hit").when(no_results, "miss").otherwise("blocked")


def search_outcome(*, error: Column, bot_check: Column, rate_limited: Column, unauthorized: Column, ui_present: Column, banner: Column, table: Column, row_count: Column) -> Column:
    """error, blocked, truncated, complete, empty; anything unknown is blocked."""
    blocked = bot_check | rate_limited | unauthorized | ~ui_present
    return F.when(error, "error").when(blocked, "blocked").when(banner, "truncated").when(table & (row_count >= 1), "complete").when(row_count == 0, "empty").otherwise("blocked")


#: Seconds of a slice of a run's time line, and slices of a chapter.
SLICE_SECONDS, CHAPTER = 3600, 1024


def _sliced(rows: DataFrame, first: str, seconds: int) -> DataFrame:
    """Adds _slice, the slice of the time line that an attempt lies in, unless it is there."""
    if "_slice" in rows.columns:
        return rows
    at, kind = F.col(first), rows.schema[first].dataType
    if isinstance(kind, T.TimestampNTZType):  # its own fields, as no zone orders it
        at = F.unix_date(at.cast("date")).cast("long") * 86_400 + F.hour(at) * 3600 + F.minute(at) * 60 + F.second(at)
    elif isinstance(kind, T.TimestampType):
        at = F.unix_seconds(at)
    elif isinstance(kind, T.DateType):
        at = F.unix_date(at).cast("long") * 86_400
    return rows.withColumn("_slice", F.coalesce(F.floor(at / seconds), F.lit(-(2**40))))


def _scan(parts: DataFrame, group: list[str], at: str, counters: list[str]) -> DataFrame:
    """Adds to each summary what each counter stands at before it (c_before) and whether nothing has ended
    it so far in its group (c_open).

    A summary says whether it ends the counter (c_reset) and what the counter then, or in all, rises by
    (c_tail): two in a row make one again, (b.reset or a.reset, b.tail if b.reset else a.tail + b.tail).
    """
    by = Window.partitionBy(*group).orderBy(at)
    for c in counters:
        parts = parts.withColumn("_g", F.sum(F.col(f"{c}_reset").cast("int")).over(by))
        parts = parts.withColumn(f"{c}_after", F.sum(f"{c}_tail").over(Window.partitionBy(*group, "_g").orderBy(at)))
        parts = parts.withColumns({f"{c}_before": F.coalesce(F.lag(f"{c}_after").over(by), F.lit(0)), f"{c}_open": F.coalesce(F.lag("_g").over(by), F.lit(0)) == 0, f"{c}_ended": F.col("_g")})
    return parts.drop("_g")


def _joined(rows: DataFrame, parts: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with the other columns of their part, null keys included."""
    parts = parts.withColumnsRenamed({k: f"_k_{k}" for k in keys})
    same = reduce(lambda x, y: x & y, [rows[k].eqNullSafe(parts[f"_k_{k}"]) for k in keys])
    return rows.join(parts, same, "left").drop(*[f"_k_{k}" for k in keys])


def before_slices(parts: DataFrame, run: list[str], counters: list[str]) -> DataFrame:
    """run, _slice and c_before of every counter: its value where the slice begins.

    A prefix scan over the summaries of slices (see ``_scan``) in two sweeps: within chapters of slices,
    then over the chapters of a run, so that no task orders more than one chapter.
    """
    parts = parts.withColumn("_chapter", F.call_function("div", F.col("_slice"), F.lit(CHAPTER)))
    inside = _scan(parts, [*run, "_chapter"], "_slice", counters)
    ends = [F.max(F.struct(f"{c}_ended", f"{c}_after")).alias(c) for c in counters]
    chapters = inside.groupBy(*run, "_chapter").agg(*ends)
    chapters = chapters.select(*run, "_chapter", *[x for c in counters for x in ((F.col(f"{c}.{c}_ended") > 0).alias(f"{c}_reset"), F.col(f"{c}.{c}_after").alias(f"{c}_tail"))])
    over = _scan(chapters, run, "_chapter", counters).select(*run, "_chapter", *[F.col(f"{c}_before").alias(f"{c}_far") for c in counters])
    both = _joined(inside, over, [*run, "_chapter"])
    return both.select(*run, "_slice", *[(F.col(f"{c}_before") + F.when(F.col(f"{c}_open"), F.col(f"{c}_far")).otherwise(0)).alias(f"{c}_before") for c in counters])


def streaks(attempts: DataFrame, run: list[str], *order: str, seconds: int = SLICE_SECONDS, keep_slice: bool = False) -> DataFrame:
    """Adds block_streak and error_streak after each attempt.

    A block lengthens the block streak and ends the error streak; an error lengthens the error
    streak and leaves the other; a hit or miss ends both; all else changes nothing.

    The first column of ``order`` is a time or a number. Slices of a run's time line are counted apart, each with a
    summary of what it does to a streak that reaches it; a scan of the summaries gives the streak at each
    slice's beginning, which is added up to the first end within the slice. So one long run is worked on
    slice by slice. ``keep_slice`` leaves the column _slice for the functions below.
    """
    o = F.col("outcome")
    live = o.isin("hit", "miss")
    rows = _sliced(attempts, order[0], seconds)
    by = Window.partitionBy(*run, "_slice").orderBy(*order)
    rows = rows.withColumns({"_b": F.count_if(live).over(by), "_e": F.count_if(live | (o == "blocked")).over(by)})
    own = lambda island: Window.partitionBy(*run, "_slice", island).orderBy(*order)
    rows = rows.withColumns({"block_streak": F.count_if(o == "blocked").over(own("_b")), "error_streak": F.count_if(o == "error").over(own("_e"))})
    parts = rows.groupBy(*run, "_slice").agg(F.max(F.struct("_b", "block_streak")).alias("b"), F.max(F.struct("_e", "error_streak")).alias("e"))
    parts = parts.select(*run, "_slice", (F.col("b._b") > 0).alias("b_reset"), F.col("b.block_streak").alias("b_tail"), (F.col("e._e") > 0).alias("e_reset"), F.col("e.error_streak").alias("e_tail"))
    rows = _joined(rows, before_slices(parts, run, ["b", "e"]), [*run, "_slice"])
    carried = lambda streak, island, c: F.col(streak) + F.when(F.col(island) == 0, F.col(f"{c}_before")).otherwise(0)
    rows = rows.withColumns({"block_streak": carried("block_streak", "_b", "b"), "error_streak": carried("error_streak", "_e", "e")})
    return rows.drop("_b", "_e", "b_before", "e_before", *([] if keep_slice else ["_slice"]))


def until_first_trip(rows: DataFrame, run: list[str], *order: str, stop: int = V.STREAK_STOP, seconds: int = SLICE_SECONDS) -> DataFrame:
    """The attempts of each run up to its first streak of ``stop``, with the reason on the last one.

    Slices after the first that trips go whole; in that one the attempts behind the trip.
    """
    tripped = F.when((F.col("outcome") == "blocked") & (F.col("block_streak") >= stop), "block_streak").when((F.col("outcome") == "error") & (F.col("error_streak") >= stop), "error_streak")
    rows = _sliced(rows, order[0], seconds).withColumn("stop_reason", tripped)
    before = Window.partitionBy(*run, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_past", F.count("stop_reason").over(before))
    parts = rows.groupBy(*run, "_slice").agg(F.count("stop_reason").alias("t_tail")).withColumn("t_reset", F.lit(False))
    rows = _joined(rows, before_slices(parts, run, ["t"]), [*run, "_slice"])
    return rows.where("_past = 0 and t_before = 0").drop("_past", "t_before", "_slice")


def batches(attempts: DataFrame, run: list[str], *order: str, size: int, seconds: int = SLICE_SECONDS) -> DataFrame:
    """Adds batch: a new one after ``size`` real requests; skipped rows carry the current one."""
    rows = _sliced(attempts, order[0], seconds)
    real = F.col("outcome") != "already_present"
    rows = rows.withColumn("_real", F.count_if(real).over(Window.partitionBy(*run, "_slice").orderBy(*order)))
    parts = rows.groupBy(*run, "_slice").agg(F.max("_real").alias("r_tail")).withColumn("r_reset", F.lit(False))
    rows = _joined(rows, before_slices(parts, run, ["r"]), [*run, "_slice"])
    return rows.withColumn("batch", F.greatest(F.call_function("div", F.col("_real") + F.col("r_before") - 1, F.lit(size)) + 1, F.lit(1))).drop("_real", "r_before", "_slice")


def daily_windows(spark: SparkSession, start: str, end: str) -> DataFrame:
    """One row for each day from start to end, both included."""
    if end < start:
        raise ValueError("the range ends before it starts")
    days = F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))
    return spark.range(1).select(F.explode(days).alias("day"))


def docket_range(spark: SparkSession, court: str, year: int, first: int, last: int) -> DataFrame:
    """Consecutive docket numbers of one court and year."""
    if not 0 <= first <= last <= 9_999_999:
        raise ValueError("docket sequences have seven digits")
    return spark.range(first, last + 1).select(F.format_string(f"{court}-51-CR-%07d-{year:04d}", "id").alias("docket_number"))


#: Consecutive numbers that one row of a range becomes: what a task makes at least.
RANGE_ROWS = 1 << 16


def docket_ranges(ranges: DataFrame) -> DataFrame:
    """docket_number, court, year of all consecutive numbers of ranges (court, year, first, last); numbers beyond
    seven digits have no docket. A range is dealt to tasks in slices, so the longest one uses all cores."""
    rows = ranges.select("court", "year", F.greatest("first", F.lit(0)).cast("int").alias("first"), F.least("last", F.lit(9_999_999)).cast("int").alias("last")).where("first <= last")
    parts = int(ranges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slices = rows.select("*", F.explode(F.sequence("first", "last", F.lit(RANGE_ROWS))).alias("at")).repartition(parts, "court", "year", "at")
    rows = slices.select("court", "year", F.explode(F.sequence("at", F.least("last", F.col("at") + (RANGE_ROWS - 1)))).alias("n"))
    return rows.select(F.concat_ws("-", "court", F.lit("51-CR"), F.lpad(F.col("n").cast("string"), 7, "0"), F.lpad(F.col("year").cast("string"), 4, "0")).alias("docket_number"), "court", "year")


COMPLETING = ["complete", "empty"]


def split_scopes(ledger: DataFrame) -> DataFrame:
    """Ledger entries by court; an entry for both courts counts for each."""
    return ledger.withColumn("court", F.explode(F.when(F.col("court") == "both", F.array(F.lit("CP"), F.lit("MC"))).otherwise(F.array("court"))))


def completed_windows(ledger: DataFrame) -> DataFrame:
    """day, court of windows that any entry completed. Order and repeats do not matter, nothing is revoked."""
    done = F.bool_or(F.col("outcome").isin(COMPLETING) & (F.coalesce("fetch_failures", F.lit(0)) == 0))
    return split_scopes(ledger).groupBy("day", "court").agg(done.alias("done")).where("done").select("day", "court")


def open_windows(days: DataFrame, ledger: DataFrame, courts: list[str]) -> DataFrame:
    """Days that are not complete for every one of the courts."""
    full = completed_windows(ledger).where(F.col("court").isin(courts)).groupBy("day").agg(F.count_distinct("court").alias("n")).where(F.col("n") == len(courts))
    return days.join(full, "day", "left_anti")


def daily_attempts(attempts: DataFrame) -> DataFrame:
    """day, outcome, n: attempts by calendar day."""
    return attempts.groupBy(F.col("ts").cast("date").alias("day"), "outcome").agg(F.count("*").alias("n"))


#: Docket ids of a slice of the corpus.
SLICE_IDS = 4096


def in_corpus_order(charges: DataFrame, scope: list[str], *, width: int = SLICE_IDS) -> DataFrame:
    """Charges with their place in the corpus, or in their part of it by ``scope``: by docket, sequence and id.

    Docket ids are numbers. Charges are numbered within slices of ``width`` ids; the counts of the slices, added
    up by a scan, say where each begins. So the order over all dockets is made without one task that sees them all.
    """
    rows = charges.withColumn("_slice", F.call_function("div", F.col("docket_id"), F.lit(width)))
    parts = rows.groupBy(*scope, "_slice").agg(F.count("*").alias("r_tail")).withColumn("r_reset", F.lit(False))
    # one key for window and join, so that charges are dealt once; nulls within it are equal
    key = F.struct(*scope, "_slice").alias("_key")
    begins = before_slices(parts, scope, ["r"]).select(key, "r_before")
    rows = rows.select(*charges.columns, key).withColumn("place", F.row_number().over(Window.partitionBy("_key").orderBy("docket_id", "sequence", "charge_id")))
    return rows.join(begins, "_key").withColumn("place", F.col("place") + F.col("r_before")).select(*charges.columns, "place")


def new_targets(targets: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    """Targets once each that no ledger knows."""
    return targets.dropDuplicates([key]).join(seen.select(key), key, "left_anti")


def refresh_targets(dockets: DataFrame, charges: DataFrame, prefix: str | None = None) -> DataFrame:
    """Dockets with an undisposed charge, oldest filing first, those without a date last."""
    pending = charges.where("disposition_raw is null").select("docket_id")
    rows = dockets.join(pending, "docket_id", "left_semi")
    rows = rows.where(F.startswith("docket_number", F.lit(prefix))) if prefix else rows
    return rows.select("docket_id", "docket_number", "filed_date").orderBy(F.asc_nulls_last("filed_date"), "docket_number")


def change_kind(old_hash: Column, new_hash: Column) -> Column:
    return F.when(old_hash.isNull(), "new").when(old_hash == new_hash, "unchanged").otherwise("changed")


def changes(known: DataFrame, fetched: DataFrame, key: str) -> DataFrame:
    """key, change (new, unchanged, changed) of refetched documents by hash."""
    old = known.select(key, F.col("hash").alias("old_hash"))
    return fetched.join(old, key, "left").select(key, change_kind(F.col("old_hash"), F.col("hash")).alias("change"))


def version_decision(incoming: DataFrame, loaded: DataFrame, known_versions: list[tuple[int, int]]) -> DataFrame:
    """What loading each incoming envelope does: reject, missing_import_record, raw_only, stale_skip,
    load, supersede, skip, replace or refuse.

    incoming: file_hash, docket_number, court, version (struct envelope, record), status, content_hash
    and imported (has an import record). loaded: the same with raw_status.
    """
    ours = loaded.select("file_hash", F.col("version").alias("old_version"), F.col("content_hash").alias("old_content"), "raw_status")
    same_docket = loaded.where("raw_status = 'parsed'").groupBy("docket_number", "court").agg(F.count("*").alias("twins"))
    rows = incoming.join(ours, "file_hash", "left")
    # an unknown court equals an unknown court
    rows = rows.join(same_docket.withColumnsRenamed({"docket_number": "d", "court": "c"}), (F.col("docket_number") == F.col("d")) & F.col("court").eqNullSafe(F.col("c")), "left").drop("d", "c")
    known = F.lit(False)
    for envelope, record in known_versions:
        known = known | ((F.col("version.envelope") == envelope) & (F.col("version.record") == record))
    fresh = F.col("old_version").isNull()
    decision = (
        F.when(~F.coalesce(known, F.lit(False)), "reject")
        .when(~F.col("imported"), "missing_import_record")
        .when(F.col("status") == "failed", "raw_only")
        .when(F.col("raw_status") == "parse_superseded", "stale_skip")
        .when(fresh & (F.coalesce("twins", F.lit(0)) > 0), "supersede")
        .when(fresh, "load")
        .when((F.col("version") == F.col("old_version")) & (F.col("content_hash") == F.col("old_content")), "skip")
        .when(F.col("version") == F.col("old_version"), "reject")
        .when(F.col("version") > F.col("old_version"), "replace")
        .otherwise("refuse")
    )
    return rows.withColumn("decision", decision).drop("old_version", "old_content", "raw_status", "twins")


def applied_versions(incoming: DataFrame, loaded: DataFrame, known_versions: list[tuple[int, int]]) -> DataFrame:
    """The loaded envelopes after the decisions: loaded, replaced and superseding ones are in, failed ones are
    in as such where their file is new, what they supersede is marked; all else stays as it was."""
    fields = ["file_hash", "docket_number", "court", "version", "content_hash"]
    decided = version_decision(incoming, loaded, known_versions).join(loaded.select("file_hash", F.lit(True).alias("_was")), "file_hash", "left")
    taken = decided.where(F.col("decision").isin("load", "supersede", "replace") | ((F.col("decision") == "raw_only") & F.col("_was").isNull()))
    rows = taken.select(*fields, F.when(F.col("decision") == "raw_only", "failed").otherwise("parsed").alias("raw_status"))
    gone = decided.where("decision = 'supersede'").select(F.col("docket_number").alias("_d"), F.col("court").alias("_c")).distinct().withColumn("_gone", F.lit(True))
    kept = loaded.select(*fields, "raw_status").join(rows.select("file_hash"), "file_hash", "left_anti")
    kept = kept.join(gone, (F.col("docket_number") == F.col("_d")) & F.col("court").eqNullSafe(F.col("_c")), "left")
    status = F.when(F.col("_gone") & (F.col("raw_status") == "parsed"), "parse_superseded").otherwise(F.col("raw_status"))
    return kept.select(*fields, status.alias("raw_status")).unionByName(rows)


def progress(windows: DataFrame, total: int, *, every: int = 5) -> DataFrame:
    """After every ``every`` windows of a run: mean seconds a window and seconds still to go."""
    by = Window.partitionBy("run").orderBy("day")
    rows = windows.withColumns({"done": F.row_number().over(by), "mean_seconds": F.avg("seconds").over(by.rowsBetween(Window.unboundedPreceding, 0))})
    return rows.where(F.col("done") % every == 0).withColumn("seconds_left", F.col("mean_seconds") * (F.lit(total) - F.col("done")))


def harvest(pages: DataFrame, html: str = "html") -> DataFrame:
    """page_id, href and text of every link, in order; what a search page's rows hold."""
    link = r'(?is)<a\s[^>]*href="([^"]*)"[^>]*>(.*?)</a>'
    href, text = F.regexp_extract_all(html, F.lit(link), F.lit(1)), F.regexp_extract_all(html, F.lit(link), F.lit(2))
    pairs = F.arrays_zip(href.alias("href"), text.alias("text"))
    return pages.select("page_id", F.posexplode(pairs).alias("place", "link")).select("page_id", "place", "link.href", F.trim(F.regexp_replace("link.text", "<[^>]*>", "")).alias("text"))
