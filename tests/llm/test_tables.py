"""WARC, URL filter and nearest neighbours: round trips, brute force and odd rows."""

import base64
import hashlib
import io
import random

import numpy as np
import pytest
from pyarrow import fs
from pyspark.sql import functions as F

from verdigris.llm import ann, url_filter, warc
from verdigris.llm.common import shared_folder


def pages(spark):
    rows = [(k, f"http://h{k}.example.com/{k}", f"<p>{k % 7}</p>" * (k % 5)) for k in range(40)]
    rows += [(50, None, None), (51, "x\r\ny", ""), (52, "u", "é" * 10), (52, "u", "é" * 10), (None, "v", "é" * 10), (60, "long", "abc " * 400_000)]
    return rows, spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)


def test_warc_round_trip(spark):
    rows, df = pages(spark)
    folder = shared_folder(spark, "warc")
    warc.write(warc.with_revisits(df), folder, archive_bytes=100)
    found = warc.read(spark, folder).collect()
    assert len({r.archive for r in found}) > 3
    largest = {}
    for page, _, html in rows:
        largest[html or ""] = max(largest.get(html or "", -1), -1 if page is None else page)
    expected = []
    for page, _, html in rows:
        raw, revisit = (html or "").encode(), page != largest[html or ""]
        expected.append((page, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if revisit else "response", largest[html or ""] if revisit else None))
    assert sorted(map(str, expected)) == sorted(str((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)) for r in found)


def test_warc_archive_is_read_record_by_record():
    records = [{"page_id": k, "url": "u", "payload": f"page {k} ".encode() * 50, "payload_digest": "D", "record_type": "response", "refers_to": None} for k in range(30)]
    content, offsets = warc.archive_bytes_of([warc.record_bytes(r, "2020-01-31T12:00:00Z") for r in records])
    found = list(warc.parse_archive(io.BytesIO(content)))
    assert [at for at, _, _ in found] == offsets
    assert {h["WARC-Date"] for _, h, _ in found} == {"2020-01-31T12:00:00Z"}
    assert [c.partition(b"\r\n\r\n")[2] for _, _, c in found] == [r["payload"] for r in records]
    one, _ = warc.archive_bytes_of([b"WARC/1.1\r\nContent-Length: 0\r\n\r\n\r\n\r\n"])
    assert [c for _, _, c in warc.parse_archive(io.BytesIO(one))] == [b""]


def test_warc_reader_takes_records_longer_than_a_read_and_refuses_cut_ones(monkeypatch):
    monkeypatch.setattr(warc, "READ_BYTES", 100)
    monkeypatch.setattr(warc, "FIRST_BYTES", 7)
    rng = random.Random(5)
    payloads = [rng.randbytes(n) for n in (0, 1, 5000, 60, 99, 100, 101)]
    records = [{"page_id": k, "url": "u", "payload": p, "payload_digest": "D", "record_type": "response", "refers_to": None} for k, p in enumerate(payloads)]
    content, offsets = warc.archive_bytes_of([warc.record_bytes(r, "2020-01-31T12:00:00Z") for r in records])
    found = list(warc.parse_archive(io.BytesIO(content)))
    assert [at for at, _, _ in found] == offsets and [c.partition(b"\r\n\r\n")[2] for _, _, c in found] == payloads
    with pytest.raises(ValueError, match="cut off"):
        list(warc.parse_archive(io.BytesIO(content[:-3])))


def test_warc_least_and_empty_table(spark):
    df = spark.createDataFrame([(1, "u", "aa"), (2, "u", "aa"), (3, "u", "bbbb"), (4, "u", "bbbb")], "page_id long, url string, html string")
    assert {r.page_id: r.refers_to for r in warc.with_revisits(df, least=3).collect()} == {1: None, 2: None, 3: 4, 4: None}
    folder = shared_folder(spark, "warc")
    warc.write(warc.with_revisits(df.limit(0)), folder)
    assert warc.read(spark, folder).count() == 0


def test_warc_follows_the_manifest(spark):
    """An archive that a lost attempt left in the folder is not read; clashing columns are ignored."""
    df = spark.createDataFrame([(k, "u", f"text {k % 3}", "x", 1) for k in range(9)], "page_id long, url string, html string, payload string, sha1 int").repartition(2)
    folder = shared_folder(spark, "warc")
    warc.write(warc.with_revisits(df), folder)
    stray, _ = warc.archive_bytes_of([warc.record_bytes({"page_id": 99, "url": "u", "payload": b"", "payload_digest": "D", "record_type": "response", "refers_to": None}, "2020-01-31T12:00:00Z")])
    store, root = fs.FileSystem.from_uri(folder)
    with store.open_output_stream(f"{root}/part-000000-00000-stray.warc.zst") as out:
        out.write(stray)
    found = {r.page_id: r.refers_to for r in warc.read(spark, folder).collect()}
    assert found == {k: None if k > 5 else k % 3 + 6 for k in range(9)}


RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block"), ("blog.org", None, "block"), (None, "/x", "block"), ("com", "en", "block"), ("twice.com", "", "allow"), ("twice.com", "", "block")]


def judged(url, rules):
    head, sign, rest = (url or "").partition("://")
    if not sign:
        return "", "", None, "allow"
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    end = min([rest.find(c, cut) for c in "?#" if rest.find(c, cut) >= 0] or [len(rest)])
    path, best = rest[cut:end], None
    for h, p, action in rules:
        p = p or ""
        if h and (not p or p[0] == "/") and (host == h or host.endswith("." + h)) and path.startswith(p):
            key = (len(h) + len(p), len(h), h + p, action == "block")
            best = key if best is None or key > best else best
    return host, path, best and best[2], "block" if best and best[3] else "allow"


def test_url_filter_is_exact(spark):
    rng = random.Random(4)
    urls = [f"{rng.choice(['http', 'https'])}://{rng.choice(['', 'www.', 'A.b.'])}{rng.choice(['example.', 'other.', 'Example.', ''])}{rng.choice(['com', 'net', 'org', 'twice.com', 'blog.org'])}{rng.choice(['', '/', '/en/', '/en/7', '/de/', '/de/81', '/es/x', '/en'])}{rng.choice(['', '?q=/en/', '#f', str(rng.randrange(99))])}" for _ in range(600)]
    urls += ["http://com/en/" + "x" * 100_000, "http://" + "a." * 300 + "example.com/en/7", None, "", "no scheme", "http://", "://com/en/x", "a://b://com/en/", "http://com", "http://example.com/en/7", "http://host com/en/\nx", "http://..com/en/"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit("clash"))
    rules = spark.createDataFrame(RULES, "host string, path string, action string")
    for how in ({}, {"rate": 0.7}, {"most_keys": 4}):  # the last in three passes
        found = {r.page_id: tuple(r["filter"]) for r in url_filter.judge(df, rules, **how).collect()}
        assert found == {i: judged(u, RULES) for i, u in enumerate(urls)}


def test_url_filter_without_rules_or_pages(spark):
    rules = spark.createDataFrame([], "host string, path string, action string")
    df = spark.createDataFrame([(1, "http://a.com/x")], "page_id long, url string")
    assert [tuple(r["filter"]) for r in url_filter.judge(df, rules).collect()] == [("a.com", "/x", None, "allow")]
    full = spark.createDataFrame(RULES, "host string, path string, action string")
    assert url_filter.judge(df.limit(0), full).count() == 0


def test_cascade_is_exact_over_its_universe(spark):
    universe = spark.range(5000).select(F.concat(F.lit("key"), F.col("id")).alias("key"))
    listed = universe.where("hash(key) % 9 = 0").union(spark.createDataFrame([("outside",)], "key string"))
    cascade = url_filter.Cascade(listed, universe, rate=0.5)
    assert len(cascade.levels) > 3
    got = universe.withColumn("has", cascade.has(F.col("key")))
    assert got.where("has <> (hash(key) % 9 = 0)").count() == 0


def test_url_filter_runs_no_python(spark):
    rules = spark.createDataFrame(RULES, "host string, path string, action string")
    df = spark.createDataFrame([(1, "http://a.com/x")], "page_id long, url string")
    plan = url_filter.judge(df, rules)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas", "Join"))


def brute(ids, vectors, asks, k):
    out = {}
    for q in asks:
        s = (vectors * vectors[q]).sum(1) / (np.sqrt((vectors**2).sum(1)) * np.sqrt((vectors[q] ** 2).sum()))
        order = [i for i in np.lexsort((ids, -s)) if ids[i] != ids[q]][:k]
        out[int(ids[q])] = [(int(ids[i]), float(s[i])) for i in order]
    return out


@pytest.mark.parametrize("block_rows", [300, 100_000])
def test_ann_recall_and_scores(spark, block_rows):
    rng = np.random.default_rng(0)
    vectors = rng.standard_normal((1500, 16))
    vectors[700:900] = vectors[50]  # a third equal, also to a query
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    found = ann.search(df, F.col("vec_id") % 50 == 0, block_rows=block_rows, chunk_rows=7).collect()
    truth = brute(np.arange(1500), vectors, range(0, 1500, 50), 5)
    got = {}
    for r in sorted(found, key=lambda r: r["rank"]):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(got) == set(truth) and all(len(x) == 5 for x in got.values())
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in truth[q]}) for q in truth)
    assert hits >= 0.9 * 5 * len(truth)
    assert [i for i, _ in got[50]] == [700, 701, 702, 703, 704]
    for q, rows in got.items():
        for i, s in rows:
            assert abs(s - vectors[q] @ vectors[i] / np.linalg.norm(vectors[q]) / np.linalg.norm(vectors[i])) < 1e-12


def test_forest_candidates_grow_slower_than_rows():
    """Recall holds at two sizes ten apart while the candidates of a query grow by far less."""
    rng, shares = np.random.default_rng(2), []
    for n in (800, 8000):
        vectors = rng.standard_normal((n, 24))
        strings = ann.Projections(24, ann.TREES).strings(vectors)
        forest, enough = ann.Forest(strings, ann.bits_of(24)), max(ann.SHARE * n**ann.POWER, ann.TREES * 7)
        depth = np.zeros(40, np.int64)
        for at, open_, count in forest.counts(strings[:, :40], enough):
            depth[open_[count >= enough]] = np.maximum(depth[open_[count >= enough]], at)
        found = list(forest.candidates(strings[:, :40], depth))
        truth = brute(np.arange(n), vectors, range(40), 5)
        assert sum(len({i for i, _ in truth[q]} & set(found[q].tolist())) for q in range(40)) >= 0.9 * 200
        shares.append(np.mean([len(f) for f in found]))
    assert shares[1] < 6 * shares[0]


def test_copies_of_a_vector_are_few_in_a_block(spark):
    rows = [(i, [[1.0, 0.0], [0.0, 2.0]][i % 2], False) for i in range(100)]
    rows[0] = (0, [1.0, -0.0], False)
    made = sorted(ann.with_strings(spark.createDataFrame(rows, "id long, v array<float>, asks boolean"), 4).collect())
    assert len({(r.kind, tuple(r.strings)) for r in made}) == 2 and made[0].kind == made[2].kind
    assert ann.without_copies(np.array([r.kind for r in made]), 3).tolist() == [0, 1, 2, 3, 4, 5]


def test_ann_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, []), (8, [1.0, 0.0, 0.0]), (None, [1.0, 0.0]), (1, [2.0, 0.0]), (50, [0.0, 3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = sorted(tuple(r) for r in ann.search(df, F.col("vec_id") % 50 == 0).collect())
    assert found == [(0, 1, 1, 1.0), (0, 2, 50, 0.0), (50, 1, 0, 0.0), (50, 2, 1, 0.0)]
    assert ann.search(df.limit(0), F.lit(True)).count() == 0


def test_ann_repeated_rows_hide_no_neighbour(spark):
    near = [(k, [1.0, 0.01 * k]) for k in range(1, 8)]
    rows = [(0, [1.0, 0.0])] + [r for r in near for _ in range(12)] + [(9, [1.0, 0.9 + 0.001 * k]) for k in range(30)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    for block_rows in (8192, 10):
        found = ann.search(df, F.col("vec_id") == 0, k=8, block_rows=block_rows).orderBy("rank").collect()
        assert [r.vec_id for r in found] == [1, 2, 3, 4, 5, 6, 7, 9]
        assert abs(found[7].score - 1 / np.hypot(1, 0.9)) < 1e-12
