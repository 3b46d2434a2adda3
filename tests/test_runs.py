"""Runs, stores, served queries, sources and streams."""

import json
from datetime import date

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verdigris.operators import collector
from verdigris.plans import bindings, runs, serve, tables
from verdigris.sources import files
from verdigris.streaming import collector as streams

RUNS = "id string, status string, started_at timestamp, completed_at timestamp, published_at timestamp, invalidated_at timestamp, invalidated_reason string"


def run_table(spark, rows):
    ts = lambda x: x and pd.Timestamp(x).to_pydatetime()
    return spark.createDataFrame([(i, s, ts("2025-01-01"), ts(c), ts(p), ts(x), r) for i, s, c, p, x, r in rows], RUNS)


def test_publish(spark):
    rows = run_table(spark, [("a", "completed", "2025-01-02", "2025-01-03", None, None), ("b", "completed", "2025-01-04", None, None, None), ("c", "failed", "2025-01-05", None, None, None), ("d", "in_progress", None, None, None, None)])
    after = runs.published(rows, "2025-02-01")
    got = {r.id: (r.published_at is not None, r.invalidated_reason) for r in after.collect()}
    assert got == {"a": (True, "superseded"), "b": (True, None), "c": (False, None), "d": (False, None)}
    assert runs.active(after).first().id == "b"
    assert runs.broken_constraints(after).where("violations > 0").isEmpty()
    assert runs.published(after, "2025-02-02").collect() == after.collect()
    with pytest.raises(runs.RunRefused):
        runs.published(rows, "2025-02-01", "c")
    with pytest.raises(runs.RunRefused):
        runs.published(after, "2025-02-01", "a")
    stale = run_table(spark, [("a", "completed", "2025-01-09", "2025-01-10", None, None), ("b", "completed", "2025-01-04", None, None, None)])
    assert runs.published(stale, "2025-02-01").collect() == stale.collect()
    done = {r.id: r.status for r in runs.validated(rows, "d", False, "2025-03-01").collect()}
    assert done["d"] == "failed" and done["a"] == "completed"
    two = run_table(spark, [(i, "completed", "2025-01-09", "2025-01-10", None, None) for i in "ab"])
    assert {r.code for r in runs.broken_constraints(two).where("violations > 0").collect()} == {"several_active"}


def test_store(spark, tmp_path):
    store = tables.RunStore(spark, str(tmp_path))
    df = spark.range(3).select(F.col("id").alias("charge_id"))
    store.write("t", df, "r1")
    store.write("t", df.limit(1), "r2")
    store.write("t", df, "r1")
    assert store.read("t", "r1").count() == 3 and store.read("t", "r2").count() == 1 and store.read("t").count() == 4
    store.write("t", df.limit(0), "r2")  # no rows replace the old ones
    assert store.read("t", "r2").count() == 0 and not store.has("t", "r9")
    with pytest.raises(Exception, match="already exists|ALREADY_EXISTS"):
        store.insert("t", df, "r1")
    store.rebuild("links", df)
    store.rebuild("links", df.limit(2))
    assert store.read("links").count() == 2
    assert [tuple(r) for r in store.row_counts(["t", "none"], "r1").collect()] == [("t", 3), ("none", 0)]
    assert "docket_number string" in tables.schema_of("dockets")


def test_runs_commit_whole_or_not_at_all(spark, tmp_path):
    store = tables.RunStore(spark, str(tmp_path))
    df = spark.range(3).select(F.col("id").alias("charge_id"))
    good = {"a": lambda: df, "b": lambda: df}
    violations = lambda n: lambda: spark.createDataFrame([("a", "code", n)], "table string, code string, violations bigint")
    assert store.build("r1", good, "2025-01-01", checks=violations(0), taxonomy_version="1.0.0") == "completed"
    assert store.build("r2", good, "2025-01-02", checks=violations(1)) == "failed"
    with pytest.raises(ZeroDivisionError):
        store.build("r3", {"a": lambda: df, "b": lambda: 1 / 0}, "2025-01-03")
    assert {r.id: r.status for r in store.runs().collect()} == {"r1": "completed", "r2": "failed", "r3": "failed"}
    assert not any(store.has(t, r) for t in "ab" for r in ("r2", "r3")) and store.runs().where("id = 'r1'").first().taxonomy_version == "1.0.0"
    store.publish("2025-01-04")
    assert store.active_id() == "r1"
    for refused in (["r1"], ["r2"], ["unknown"]):
        with pytest.raises(runs.RunRefused):
            store.prune(["a"], refused)
    store.build("r4", good, "2025-01-05")
    store.publish("2025-01-06", "r4")
    assert sorted(tuple(r) for r in store.prune(["a", "b"], ["r1"]).collect()) == [("r1", "a", 3), ("r1", "b", 3)] and store.has("a", "r1")
    assert store.prune(["a", "b"], ["r1"], dry_run=False).count() == 2 and not store.has("a", "r1")
    assert [r.id for r in runs.recent(store.runs(), 2).collect()] == ["r4", "r3"]


def test_two_writers_lose_no_change(spark, tmp_path):
    """A second store commits between the first one's read and commit."""
    one, two = tables.RunStore(spark, str(tmp_path)), tables.RunStore(spark, str(tmp_path))
    one.begin("a", "2025-01-01")
    seen = []

    def slow(rows):
        seen.append(sorted(r.id for r in rows.collect()))
        if len(seen) == 1:
            two.begin("b", "2025-01-02")
        return runs.validated(rows, "a", True, "2025-01-03")

    one.change_runs(slow)
    assert seen == [["a"], ["a", "b"]]
    assert {r.id: r.status for r in two.runs().collect()} == {"a": "completed", "b": "in_progress"}
    assert len([p for p in (tmp_path / "runs").iterdir()]) <= 3


def test_a_run_whose_builder_is_gone_fails(spark, tmp_path):
    store, df = tables.RunStore(spark, str(tmp_path)), spark.range(3)
    store.begin("dead", "2025-01-01 00:00:00")
    store.write("t", df, "dead")
    store.begin("young", "2025-01-01 11:30:00")
    assert store.fail_expired("2025-01-01 12:00:00", 3600) == ["dead"] and store.fail_expired("2025-01-01 12:00:00", 3600) == []
    assert {r.id: r.status for r in store.runs().collect()} == {"dead": "failed", "young": "in_progress"} and not store.has("t", "dead")

    def late():  # the lease of a run ends while it builds
        tables.RunStore(spark, str(tmp_path)).fail_expired("2026-01-01", 3600)
        return df

    assert store.build("slow", {"t": late}, "2025-01-02") == "failed" and not store.has("t", "slow")


def test_a_write_that_fails_leaves_the_old_rows(spark, tmp_path):
    store, df = tables.RunStore(spark, str(tmp_path)), spark.range(3)
    store.write("t", df, "r")
    store.rebuild("links", df)
    reader = store.read("links")
    broken = df.select(F.raise_error(F.lit("broken")).alias("id"))
    for write in (lambda: store.write("t", broken, "r"), lambda: store.rebuild("links", broken)):
        with pytest.raises(Exception, match="broken"):
            write()
    store.rebuild("links", df.limit(1))
    assert store.read("t", "r").count() == 3 and store.read("links").count() == 1 and reader.count() == 3
    with pytest.raises(ValueError, match="share"):
        tables.shared_base(type("S", (), {"conf": type("C", (), {"get": staticmethod(lambda *a: None)}), "sparkContext": type("X", (), {"master": "yarn", "getConf": staticmethod(lambda: type("C", (), {"get": staticmethod(lambda *a: None)}))})}))


def test_sweep_and_upsert(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k int, v string")
    keys = lambda *k: spark.createDataFrame([(x,) for x in k], "k int")
    blocked = runs.sweep(rows, keys(1), "k", [keys(2)])
    assert {r.k: r.action for r in blocked.collect()} == {1: "keep", 2: "blocked", 3: "delete"}
    with pytest.raises(runs.RunRefused):
        runs.swept(rows, blocked, "k")
    assert [r.k for r in runs.swept(rows, runs.sweep(rows, keys(1, 2), "k", [keys()]), "k").orderBy("k").collect()] == [1, 2]
    new = spark.createDataFrame([(2, "b"), (3, "x"), (4, "d")], "k int, v string")
    assert {(r.k, r.v, r.change) for r in runs.upsert_where_changed(rows, new, "k").collect()} == {(1, "a", "kept"), (2, "b", "unchanged"), (3, "x", "updated"), (4, "d", "inserted")}


def test_search(spark):
    roster = bindings.roster(spark)
    got = [(r.id, r.match_rank, r.matched_alias) for r in serve.search(roster, "RED", 10).collect()]
    assert got == [("c2", 2, None), ("c1", 2, "red ring")]
    assert [r.id for r in serve.search(roster, "18 § LARGE").collect()] == ["c5", "c6"]
    for q, n in (("", 5), ("x" * 101, 5), ("a", 26)):
        with pytest.raises(serve.InvalidQuery):
            serve.search(roster, q, n)
    assert serve.by_id_or_slug(roster, "hot-gear").first().id == "c3"
    assert serve.by_id_or_slug(roster, "0f0e0d0c-0000-0000-0000-000000000000").count() == 0
    assert serve.contains_filter(roster, " ", "display_name").count() == 6


def test_states(spark):
    rows = lambda *c: spark.createDataFrame([(x,) for x in c], "charge_id string")
    assert {r.charge_id: r.arm for r in serve.charge_state(rows("a", "b", "c"), rows("a", "a"), rows("a", "b")).collect()} == {"a": "success", "b": "volume_only", "c": "unavailable"}
    pairs = lambda *c: spark.createDataFrame(list(c), "charge_id string, judge_id int")
    got = serve.pair_state(pairs(("a", 1), ("a", 2), ("b", 1), ("c", 1)), rows("a"), pairs(("a", 1), ("b", 1)))
    assert {(r.charge_id, r.judge_id): r.state for r in got.collect()} == {("a", 1): "success", ("a", 2): "baseline_only", ("b", 1): "integrity_error", ("c", 1): "unavailable"}


def test_import_and_extract(spark, tmp_path):
    for name, content in (("CP-51-CR-0000001-2020.pdf", b"%PDF-one"), ("copy.pdf", b"%PDF-one"), ("other.pdf", b"text"), ("bad.pdf", b"%PDF-bad")):
        (tmp_path / name).write_bytes(content)
    rows = {r.path.rsplit("/", 1)[1]: (r.status, r.provenance.court) for r in files.import_documents(spark, str(tmp_path)).collect()}
    assert rows == {"CP-51-CR-0000001-2020.pdf": ("imported", "CP"), "copy.pdf": ("duplicate", None), "other.pdf": ("invalid", None), "bad.pdf": ("imported", None)}

    def extractor(content: bytes) -> list[str]:
        if content.endswith(b"bad"):
            raise ValueError("cannot read bad.pdf")
        return [content.decode(), ""]

    got = {r.path.rsplit("/", 1)[1]: r for r in files.extract_text(spark.read.format("binaryFile").load(str(tmp_path)), extractor, least=5).collect()}
    assert got["bad.pdf"].status == "failed" and got["bad.pdf"].error == "cannot read <redacted>"
    assert got["other.pdf"].status == "needs_ocr_or_review" and got["copy.pdf"].status == "partial"


def test_artifacts_and_ledgers(spark, tmp_path):
    for i, body in enumerate(('{"k": "a", "v": 1}', '{"k": "a", "v": 2}', "{broken")):
        (tmp_path / f"{i}.json").write_text(body)
    good, skipped = files.json_artifacts(spark, str(tmp_path), T.StructType().add("k", T.StringType()).add("v", T.IntegerType()))
    assert skipped.first().skipped == 1 and good.count() == 2
    last, twice = files.last_of_each(good, "k", "v")
    assert last.first().v == 2 and twice.first().n == 2
    lines = spark.createDataFrame([('{"date": "2024-01-01", "court": "CP", "outcome": "complete"}',), ("junk",), ('{"date": "2024-01-01", "court": "XX"}',), ("",)], "value string")
    assert [r.usable for r in files.parse_ledger(lines).collect()] == [True, False, False]


def drain(df, name, mode):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


def test_streams_equal_batches(spark, tmp_path):
    kinds = ["blocked", "blocked", "error", "hit", "blocked", "blocked", "blocked", "blocked", "blocked", "miss"]
    rows = [(r, (pd.Timestamp("2024-01-01") + pd.Timedelta(hours=i)).to_pydatetime(), i, k) for r in (1, 2) for i, k in enumerate(kinds[: 10 if r == 1 else 4])]
    spark.createDataFrame(rows, "run int, ts timestamp, seq int, outcome string").write.parquet(f"{tmp_path}/a")
    source = spark.readStream.schema("run int, ts timestamp, seq int, outcome string").parquet(f"{tmp_path}/a")
    got = {r.run: (r.attempts, r.block_streak, r.stop_reason) for r in drain(streams.streak_states(source), "streaks", "update").collect()}
    assert got == {1: (9, 5, "block_streak"), 2: (4, 0, None)}
    led = spark.createDataFrame([(date(2024, 1, 1), "both", "complete", 0), (date(2024, 1, 2), "CP", "blocked", 0), (date(2024, 1, 2), "CP", "empty", 0), (date(2024, 1, 2), "CP", "blocked", 0)], "day date, court string, outcome string, fetch_failures long")
    led.write.parquet(f"{tmp_path}/l")
    live = drain(streams.completed_windows(spark.readStream.schema(led.schema).parquet(f"{tmp_path}/l")), "windows", "complete")
    assert {(r.day, r.court) for r in live.where("done").collect()} == {tuple(r) for r in collector.completed_windows(led).collect()}


def test_daily_and_first_attempts_as_streams(spark, tmp_path):
    rows = [(k, (pd.Timestamp("2024-01-01") + pd.Timedelta(hours=7 * k)).to_pydatetime(), k % 5, "hit" if k % 3 else "miss") for k in range(20)]
    df = spark.createDataFrame(rows, "seq int, ts timestamp, run int, outcome string")
    df.write.parquet(f"{tmp_path}/d")
    source = lambda: spark.readStream.schema(df.schema).parquet(f"{tmp_path}/d")
    daily = drain(streams.daily_attempts(source()), "daily", "complete")
    assert {tuple(r) for r in daily.collect()} == {tuple(r) for r in collector.daily_attempts(df).collect()}
    assert drain(streams.first_attempts(source(), "run"), "firsts", "append").count() == 5


def test_schemas_are_valid_json(spark):
    for name in ("dockets", "charges", "aggregate_runs"):
        assert json.loads(spark.createDataFrame([], tables.schema_of(name)).schema.json())["fields"]


def test_a_run_reads_the_built_facts_and_copies_none(spark):
    import os

    from verdigris.plans import queries_runs

    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("the driver's tables are not here")
    store, _ = queries_runs._life(spark, "/root/testdata/sf0.001")
    assert not store.has("facts", "f1") and "facts" not in store.folder.names()
