"""Keyed tables that triggers change: manifests, repeats, retirement, version decisions."""

import random

from pyspark.sql import functions as F

from verdigris.operators import collector
from verdigris.streaming import collector as streams
from verdigris.streaming.buckets import Buckets

ENVELOPE = "file_hash string, docket_number string, court string, version struct<envelope int, record int>, content_hash string"


def test_merge_each(spark, tmp_path):
    root = str(tmp_path / "m")
    merge = streams.merge_each(root, "k", "v")
    batch = lambda *rows: spark.createDataFrame(list(rows), "k string, v int, x string")
    assert streams.merged(spark, root) is None
    merge(batch(("a", 1, "p"), ("a", 2, "q"), ("b", 5, "r"), (None, 1, "n")), 0)
    merge(batch(("a", 1, "old"), ("b", 6, "s"), ("c", 1, "t")), 1)
    merge(batch(("a", 9, "repeated"), ("b", 6, "s"), ("c", 1, "t")), 1)
    assert sorted(map(str, streams.merged(spark, root, 1).collect())) == sorted(map(str, batch(("a", 2, "q"), ("b", 6, "s"), ("c", 1, "t"), (None, 1, "n")).collect()))
    assert streams.merged(spark, root, 0).where("k = 'c'").isEmpty()


def test_triggers_read_and_keep_a_bounded_number_of_files(spark, tmp_path):
    root = str(tmp_path / "m")
    merge = streams.merge_each(root, "k", "v", buckets=4)
    frame = lambda ks, v: spark.createDataFrame([(k, v) for k in ks], "k int, v int")
    merge(frame(range(40), 0), 0)
    for trigger in range(1, 9):
        merge(frame([trigger % 3], trigger), trigger)
        table = Buckets(spark, root, ["k"], 4)
        assert len(table.manifest()["files"]) == 4
    plan = streams.merged(spark, root)._jdf.queryExecution().toString()
    assert plan.count("FileScan") == 1 and "Union" not in plan and "Join" not in plan
    folders = [p for p in (tmp_path / "m").iterdir() if p.name.startswith("generation")]
    assert len(folders) <= 4 + 2 and len(list((tmp_path / "m" / "_manifest").glob("0*"))) == 3
    assert {tuple(r) for r in streams.merged(spark, root).collect()} == {(k, {0: 6, 1: 7, 2: 8}.get(k, 0)) for k in range(40)}


def test_an_emptied_bucket_holds_nothing(spark, tmp_path):
    table = Buckets(spark, str(tmp_path / "b"), ["k"], 2)
    rows = spark.createDataFrame([(k,) for k in range(10)], "k int")
    table.replace(rows, [0, 1], 0)
    table.replace(rows.limit(0), [0], 1)
    left = table.read()
    assert 0 < left.count() < 10 and left.where(table.bucket() == 0).isEmpty()
    table.replace(rows.limit(0), [1], 2)
    assert table.read().count() == 0 and table.read([1]).count() == 0


def envelopes(spark, rows):
    return spark.createDataFrame([(h, d, c, (1, v), x, s, True) for h, d, c, v, x, s in rows], f"{ENVELOPE}, status string, imported boolean")


def test_versions_apply_as_a_stream(spark, tmp_path):
    empty = spark.createDataFrame([], f"{ENVELOPE}, raw_status string")
    root = str(tmp_path / "a")
    batch = lambda *rows: envelopes(spark, [(h, d, "CP", v, c, "parsed") for h, d, v, c in rows])
    apply = streams.apply_each(root, [(1, 1), (1, 2)], empty)
    apply(batch(("f1", "d1", 2, "x"), ("f2", "d2", 1, "y")), 0)
    apply(batch(("f1", "d1", 1, "z"), ("f2", "d2", 2, "y"), ("f3", "d1", 2, "w")), 1)  # refused, replaced, supersedes f1
    apply(batch(("f1", "d1", 2, "x")), 2)  # stale
    for g in (1, 2):
        rows = {r.file_hash: (r.version.record, r.raw_status) for r in streams.loaded_envelopes(spark, root, g).collect()}
        assert rows == {"f1": (2, "parse_superseded"), "f2": (2, "parsed"), "f3": (2, "parsed")}
    log = {(r.trigger, r.file_hash): r.decision for r in streams.decision_log(spark, root).collect()}
    assert log == {(0, "f1"): "load", (0, "f2"): "load", (1, "f1"): "refuse", (1, "f2"): "replace", (1, "f3"): "supersede", (2, "f1"): "stale_skip"}


def test_triggers_equal_whole_table_decisions(spark, tmp_path):
    """Random envelopes, few dockets, unknown courts: bucket by bucket as over the whole table."""
    rng, root = random.Random(6), str(tmp_path / "a")
    empty = spark.createDataFrame([], f"{ENVELOPE}, raw_status string")
    apply, whole = streams.apply_each(root, [(1, 1), (1, 2), (1, 3)], empty, buckets=8), empty
    for trigger in range(5):
        chosen = rng.sample(range(14), 6)
        batch = envelopes(spark, [(f"f{i}", f"d{(i + trigger * (i % 5 == 0)) % 6}", rng.choice(["CP", None]) if i % 4 == 0 else "CP", rng.randint(1, 4), rng.choice("xy"), rng.choice(["parsed", "parsed", "failed"])) for i in chosen])
        apply(batch, trigger)
        whole = spark.createDataFrame(collector.applied_versions(batch, whole, [(1, 1), (1, 2), (1, 3)]).collect(), empty.schema)
        got = streams.loaded_envelopes(spark, root).select(*whole.columns)
        assert sorted(map(str, got.collect())) == sorted(map(str, whole.collect()))


def test_a_trigger_that_stops_half_way_is_repeated(spark, tmp_path, monkeypatch):
    root, empty = str(tmp_path / "a"), spark.createDataFrame([], f"{ENVELOPE}, raw_status string")
    apply = streams.apply_each(root, [(1, 1)], empty, buckets=8)
    apply(envelopes(spark, [("f1", "d1", "CP", 1, "x", "parsed")]), 0)
    second, real = envelopes(spark, [("f2", "d1", "CP", 1, "x", "parsed")]), Buckets.replace
    with monkeypatch.context() as m:
        m.setattr(Buckets, "replace", lambda self, *a: 1 / 0 if self.root.endswith("rows") else real(self, *a))
        try:
            apply(second, 1)
        except ZeroDivisionError:
            pass
    apply(second, 1)
    assert {r.file_hash: r.raw_status for r in streams.loaded_envelopes(spark, root).collect()} == {"f1": "parse_superseded", "f2": "parsed"}
    assert {r.decision for r in streams.decision_log(spark, root).where("trigger = 1").collect()} == {"supersede"}


def test_a_trigger_touches_its_own_buckets(spark, tmp_path):
    root, empty = str(tmp_path / "a"), spark.createDataFrame([], f"{ENVELOPE}, raw_status string")
    apply = streams.apply_each(root, [(1, 1)], empty, buckets=16)
    apply(envelopes(spark, [(f"f{i}", f"d{i}", "CP", 1, "x", "parsed") for i in range(60)]), 0)
    before = Buckets(spark, f"{root}/rows", ["file_hash"], 16).manifest()["files"]
    apply(envelopes(spark, [("new", "d7", "CP", 1, "x", "parsed")]), 1)
    after = Buckets(spark, f"{root}/rows", ["file_hash"], 16).manifest()["files"]
    assert 1 <= sum(before.get(b) != g for b, g in after.items()) <= 2
    assert streams.loaded_envelopes(spark, root).where(F.col("raw_status") == "parse_superseded").first().file_hash == "f7"
