"""Byte-level BPE, whitening and collocations against the library, numpy and plain counting."""

import base64
import hashlib
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from verdigris.llm import bpe, collocations, entry_queries, slices, whitening

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


SIGNS = ["'", "s", "t", "re", "ve", "m", "ll", "d", "l", "S", " ", "  ", "\n", "\t", " ", "　", "a", "é", "中", "1", "٣", "½", "!", ",", "🙂", "́", "\x1c", "\x85", "​", "<|endoftext|>"]


def odd_texts(n: int, seed: int = 5) -> list[str]:
    rng = random.Random(seed)
    return ["".join(rng.choice(SIGNS) for _ in range(rng.randint(0, 30))) for _ in range(n)]


def test_byte_pairs_equal_the_library_and_decode_to_the_bytes(spark, library):
    texts = [None, "", " ", "\n\n", "ab " * 5000, "x" * 3000, "don't 'sound' we'll I'd've", "same", "same", *odd_texts(400)]
    docs = spark.createDataFrame([(i // 2, t, "x", [i]) for i, t in enumerate(texts)], "doc_id long, text string, IDS string, slice array<int>").repartition(3).sortWithinPartitions("slice")
    rows = bpe.decode(bpe.encode(docs, RANKS, keep=["doc_id", "slice", "IDS"], into="made"), RANKS, ids_col="made", into="bytes").collect()
    assert len(rows) == len(texts)
    for r in rows:
        text = texts[r["slice"][0]] or ""
        assert r["doc_id"] == r["slice"][0] // 2 and r["IDS"] == "x"
        assert r["made"] == library.encode_ordinary(text) and bytes(r["bytes"]) == text.encode()


def test_long_texts_are_cut_where_pre_tokens_end(monkeypatch):
    texts = pa.array(["a b\tc  d\n\n e'll " * 50, "", "x" * 100, *odd_texts(50, 9)])
    whole, counts = bpe.pre_tokens(texts)
    pieces, of = bpe.cut(texts, 8)
    assert len(pieces) > len(texts)
    again, _ = bpe.pre_tokens(pieces)
    assert again.equals(whole) and of.sum() == len(pieces) and counts.sum() == len(whole)


def test_decoding_refuses_unknown_ids_and_keeps_nulls(spark):
    rows = spark.createDataFrame([(1, None), (2, [])], "id long, ids array<int>")
    assert [(r["id"], r["decoded"]) for r in bpe.decode(rows, RANKS).orderBy("id").collect()] == [(1, None), (2, b"")]
    with pytest.raises(Exception, match="not in the token-byte table"):
        bpe.decode(spark.createDataFrame([([60000],)], "ids array<int>"), RANKS).collect()
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.decode(bpe.encode(empty, RANKS), RANKS).collect() == []


def test_slices_that_differ_between_passes_stop_the_query():
    with pytest.raises(RuntimeError, match="different rows"):
        slices.same(pa.chunked_array([pa.array([1, 1])]), pa.chunked_array([pa.array([2])]))


def test_packed_columns_come_back():
    for values in (np.zeros(0, np.int64), np.array([0, 255, 256, 2**40]), np.arange(1000)):
        assert (slices.unpack(slices.pack(values)) == values).all()
    words = pa.array([b"", b"abc", "é".encode()], pa.large_binary())
    assert slices.unpack_strings(slices.pack_strings(words)).equals(words)


@pytest.mark.parametrize("d", [1, 2, 3, 17])
def test_rotations_give_singular_values_and_vectors(d):
    a = np.random.default_rng(d).normal(size=(200, d)) * np.logspace(0, -7, d)
    v, length = whitening.jacobi(np.linalg.qr(a, mode="r"))
    assert np.allclose(length, np.linalg.svd(a, compute_uv=False), rtol=1e-12)
    assert np.abs(v.T @ v - np.eye(d)).max() < 1e-13
    assert np.allclose(np.linalg.norm(a @ v, axis=0), length, rtol=1e-9)


def vectors(spark, folder, n=700, d=12):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in np.float32(v)], "t") for i, v in enumerate(rng.normal(size=(n, d)) @ rng.normal(size=(d, d)))]
    rows += [(n, None, "t"), (n + 1, [None] + [1.0] * (d - 1), None), (n + 2, [float("nan")] * d, "t"), (n + 3, [float("inf")] * d, "t"), (n + 4, [], "t"), (n + 5, [1.0], "t"), (3, rows[3][1], "t"), (None, rows[4][1], "t")]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, n string").repartition(3).write.parquet(f"{folder}/embeddings.parquet")
    return [(i, np.array(v)) for i, v, _ in rows[:n] + rows[-2:]]


def test_whitening_query_equals_an_eigen_decomposition(spark, tmp_path):
    kept = vectors(spark, tmp_path)
    x = np.array([np.floor(v * 1024).astype(np.int64) + 100_000 for _, v in kept])
    n, sums = len(x), x.sum(axis=0)
    centred = x - sums / n
    e, w = np.linalg.eigh(centred.T @ centred / n)
    e, w = e[::-1], w[:, ::-1]
    got = entry_queries.op12_whitening(spark, str(tmp_path)).collect()
    assert len(got) == 8 * n and {r["component"] for r in got} == set(range(1, 9)) and {r["n"] for r in got} == {n}
    assert all(r["identity_error"] < 1e-9 and abs(r["explained"] / (e[r["component"] - 1] / e.sum()) - 1) < 1e-9 for r in got)
    exact = Counter((i, int(((n * row - sums) ** 2).sum())) for (i, _), row in zip(kept, x.astype(object)))
    assert Counter((r["vec_id"], r["deviation"]) for r in got if r["component"] == 1) == exact
    want = {i: row for (i, _), row in zip(kept, centred @ w / np.sqrt(e))}
    sign = {c: np.sign(next(r["whitened"] for r in got if r["vec_id"] == 0 and r["component"] == c) * want[0][c - 1]) for c in range(1, 9)}
    assert all(abs(r["whitened"] - sign[r["component"]] * want[r["vec_id"]][r["component"] - 1]) < 1e-8 for r in got)


def test_whitening_without_spread_or_rows(spark):
    one = spark.createDataFrame([(1, [1.0, 2.0], "a"), (2, [1.0, 2.0], "b")], "vec_id long, embedding array<double>, WHITENING string")
    model = whitening.fit(one)
    assert model.n == 2 and not len(model.variances) and model.explained == []
    assert [r["whitening"]["whitened"] for r in whitening.whiten(one, model).collect()] == [[], []]
    flat = spark.createDataFrame([(i, [float(i % 5), float(i % 5), 1.0]) for i in range(40)], "vec_id long, embedding array<double>")
    model = whitening.fit(flat)
    assert len(model.variances) == 1 and model.explained == [1.0] and whitening.identity_error(flat, model) < 1e-12
    empty = whitening.fit(flat.limit(0))
    assert empty.n == 0 and whitening.whiten(flat.limit(0), empty).collect() == [] and whitening.identity_error(flat.limit(0), empty) == 0
    with pytest.raises(Exception, match="outside"):
        whitening.fit(spark.createDataFrame([(1, [1e300])], "vec_id long, embedding array<double>"))
    big = whitening.Model(2**40, np.array([0]), np.zeros((1, 0)), np.zeros(0), 0.0)
    assert whitening.spreads(np.array([[2**20], [0]]), big).to_pylist() == [None, 0]


def collocations_by_hand(docs, longest=4, least=30, best=2000):
    count, n = {}, Counter()
    for lang, text in docs:
        lang = lang if lang is not None else "und"
        f = count.setdefault(lang, Counter())
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            words = [w for w in re.split("[ \t]+", piece) if w]
            n[lang] += len(words)
            f.update(tuple(words[i : i + m]) for m in range(1, longest + 1) for i in range(len(words) - m + 1))
    out = []
    for lang, f in count.items():
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        longer = Counter()
        for p, a in found.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    longer[p[i : i + m]] = max(longer[p[i : i + m]], a)
        rows = []
        for p, a in found.items():
            if 100 * longer[p] < 80 * a:
                score, k = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
                rows.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(rows)[:best], 1)]
    return sorted(out)


@pytest.mark.parametrize("size", [collocations.SLICE_TEXT, 200])
def test_collocations_equal_plain_counting(spark, tmp_path, monkeypatch, size):
    rng = random.Random(4)
    words = ["the", "The", "of", "new", "york", "city", "ÄÖ", "äö", "a b", "x" * 40, "-"]
    glue = [" ", " ", " ", "  ", "\t", ". ", ",", "\r\n", "!?"]
    docs = [(i, rng.choice(["en", "de", None, "und", ""]), "".join(rng.choice(words) + rng.choice(glue) for _ in range(rng.randint(0, 120)))) for i in range(200)]
    docs += [(300, "en", None), (301, None, None), (302, "en", ""), (303, "fr", " . "), (7, "en", "new york city " * 4000), (7, "en", "new york city " * 4000)]
    spark.createDataFrame(docs, "doc_id long, lang string, text string").withColumn("n", F.lit("a")).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(collocations, "slices", lambda b, c, _: slices.slices(b, c, size))
    got = [tuple(r) for r in entry_queries.op13_collocations(spark, str(tmp_path)).collect()]
    assert sorted(got) == collocations_by_hand([d[1:] for d in docs]) and len(got) > 30


def test_collocations_of_few_and_short_phrases(spark):
    docs = spark.createDataFrame([("en", "a b c a b c a b"), ("en", "a b")], "lang string, text string")
    for longest in (2, 3):
        got = [tuple(r) for r in collocations.mine(docs, longest=longest, least=2, best=3).collect()]
        assert sorted(got) == collocations_by_hand([tuple(r) for r in docs.collect()], longest, 2, 3)
    assert collocations.mine(docs.limit(0)).collect() == []


def test_byte_pair_query_on_a_small_folder(spark, tmp_path, library):
    docs = [(1, None), (2, ""), (3, "Hello, world's end"), (None, "a"), (3, "Hello, world's end")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = Counter()
    for i, t in docs:
        ids = library.encode_ordinary(t or "")
        want[i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()] += 1
    got = entry_queries.op11_byte_bpe(spark, str(tmp_path)).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert Counter(map(tuple, got)) == want
