"""The registered queries on a small folder with odd rows and clashing columns, against plain Python."""

import base64
import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from test_tables import brute, judged
from test_texts import corpus, decon, groups, prose, removed

from verdigris.llm import entry_queries

LANGUAGES = {"en": "the house and the river with some other words", "de": "das haus und der fluss mit anderen worten", "es": "la casa y el rio con otras palabras más"}
ITEMS = [(1, "What is the answer to life the universe and all things, said Bob?"), (2, "short item"), (3, None), (4, "!!"), (11, "one")]


def fold(i):
    return zlib.crc32(str(i).encode()) % 5


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def written(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{folder}/{name}.parquet")


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(7)
    rows = [(i, t) for i, t, _ in corpus(3)]
    n = len(rows)
    rows += [(n, "What is THE answer to life, the universe and all things"), (n + 1, "a short ITEM here"), (n + 2, "12 34 !"), (n + 3, prose(rng, 4000))]
    for lang in LANGUAGES:
        rows += [(len(rows) + k, " ".join(rng.choices(LANGUAGES[lang].split(), k=30))) for k in range(40)]
    return rows


@pytest.fixture(scope="module")
def languages(texts):
    """The language of each row; some have none."""
    start = len(texts) - 120
    return {i: None if i < start else list(LANGUAGES)[(i - start) // 40] for i, _ in texts}


@pytest.fixture(scope="module")
def folder(spark, texts, languages, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("tables"))
    # columns of the results' names and of the operators' own
    written(spark, at, "documents", [(i, t, languages[i], "s", "x", 1) for i, t in texts], "doc_id long, text string, lang string, source string, parse string, n_tokens int")
    written(spark, at, "benchmark", ITEMS, "item_id long, text string")
    return at


def test_substring_dedup_query(spark, folder, texts):
    want = {i: (n, k, sha(kept)) for i, (n, k, kept) in removed([(i, t, "s") for i, t in texts], 13).items()}
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in entry_queries.op1_substring_dedup(spark, folder).collect()} == want


def test_token_count_query(spark, folder, texts):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=entry_queries.PIECES)
    counts = {i: len(model.encode(t or "")) for i, t in texts}
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in entry_queries.op7_token_counts(spark, folder).collect()}
    assert got == {i: (len((t or "").encode()), counts[i], counts[i] > 4096) for i, t in texts}
    assert {over for _, _, over in got.values()} == {True, False}


def test_decontamination_query(spark, folder, texts):
    want = {}
    for i, t in texts:
        words, hit, ids = decon(t, ITEMS)
        want[i] = (words, len(hit), len(ids), sha(",".join(ids)), bool(hit))
    assert {tuple(r)[0]: tuple(r)[1:] for r in entry_queries.op8_decontaminate(spark, folder).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()} == want
    assert any(w[4] for w in want.values())


def test_minhash_query(spark, folder, texts):
    rows = entry_queries.op9_minhash(spark, folder).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in rows} == groups([(i, t, "s") for i, t in texts], 2)


def test_packing_query(spark, folder, texts):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(entry_queries.WORD_BPE)
    ids = {i: np.array([*model.encode(t or "", add_special_tokens=False).ids, 2], "<u4") for i, t in texts}
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in entry_queries.op10_packing(spark, folder).collect():
        assert p.doc_tokens == len(ids[p.doc_id]) and p.ids_crc32 == zlib.crc32(ids[p.doc_id][p.start : p.start + p.length].tobytes())
        by_doc[p.doc_id].append((p.start, p.length))
        by_sequence[p.sequence_id].append((p.offset, p.length))
    assert set(by_doc) == set(ids)
    for spans, total in [*((by_doc[i], len(ids[i])) for i in ids), *((s, sum(n for _, n in s)) for s in by_sequence.values())]:
        assert [at for at, _ in sorted(spans)] == [0, *np.cumsum([n for _, n in sorted(spans)])[:-1]] and sum(n for _, n in spans) == total
    assert max(sum(n for _, n in s) for s in by_sequence.values()) <= 4096


def test_language_query(spark, folder, texts, languages, tmp_path):
    found = {r.doc_id: r for r in entry_queries.op6_language_id(spark, folder).collect()}
    assert set(found) == {i for i, _ in texts}
    for i, t in texts:
        assert found[i].held_out == (fold(i) == 0) and 0 <= found[i].score <= 1
        assert (found[i].lang_pred == "und") == (not any(c.isalpha() for c in t or "")), t
    learned = [i for i in languages if languages[i]]
    assert all(found[i].lang_pred == languages[i] for i in learned) and any(found[i].held_out for i in learned)
    # labels of the held-out fold are not looked at
    written(spark, tmp_path, "documents", [(i, t, "xx" if fold(i) == 0 else languages[i]) for i, t in texts], "doc_id long, text string, lang string")
    again = {r.doc_id: r for r in entry_queries.op6_language_id(spark, str(tmp_path)).collect()}
    assert all(again[i].lang_pred == r.lang_pred and abs(again[i].score - r.score) < 1e-9 for i, r in found.items())


def test_toxicity_query(spark, tmp_path):
    rng = random.Random(1)
    rows = [(i, prose(rng, 25) + (f" zuqqa{rng.choice('xyz')} vrool" if i % 3 == 0 else "")) for i in range(240)]
    rows += [(300, None), (301, ""), (302, "zuqqax vrool " * 500)]
    labels = {i: int(i % 3 == 0) for i in range(240) if i % 7} | {301: None}
    scores = []
    for hidden in (0, 1):
        at = str(tmp_path / str(hidden))
        written(spark, at, "documents", [(i, t, "x", 0.5) for i, t in rows], "doc_id long, text string, lang string, score double")
        # the held-out labels once as they are and once turned round
        written(spark, at, "labels", [(i, x if x is None or fold(i) else x ^ hidden) for i, x in labels.items()], "doc_id long, toxic int")
        scores.append({r.doc_id: r for r in entry_queries.op3_toxicity(spark, at).collect()})
    first, second = scores
    assert set(first) == {i for i, _ in rows}
    assert all(r.held_out == (fold(i) == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for i, r in first.items())
    assert all(abs(first[i].score - second[i].score) < 1e-9 for i in first)
    held = [i for i in range(240) if fold(i) == 0]
    assert sum(first[i].predicted == (i % 3 == 0) for i in held) >= 0.95 * len(held)


def test_page_queries(spark, tmp_path):
    pages = [(k, f"http://h{k}.example.{['com', 'net', 'org'][k % 3]}/{['en', 'de', 'es'][k // 3 % 3]}/{k}?q", f"<p>{k % 7}</p>" * (k % 5)) for k in range(60)]
    pages += [(70, None, None), (71, "no scheme", ""), (72, "HTTP://EXAMPLE.COM/en/7", "é" * 10), (73, "a://x.example.net/de/81#f", "é" * 10), (74, "b://com/en/" + "x" * 50_000, "abc " * 400_000)]
    written(spark, tmp_path, "pages", [(*p, "clash", "clash") for p in pages], "page_id long, url string, html string, host string, payload string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in entry_queries.op4_url_filter(spark, str(tmp_path)).collect()}
    assert got == {i: judged(u, entry_queries.URL_RULES) for i, u, _ in pages}
    assert {v[3] for v in got.values()} == {"allow", "block"}
    response = {}
    for i, _, html in pages:
        response[html or ""] = max(i, response.get(html or "", -1))
    want = Counter()
    for i, _, html in pages:
        raw, to = (html or "").encode(), response[html or ""]
        want[i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if i == to else "revisit", None if i == to else to] += 1
    found = entry_queries.op2_warc(spark, str(tmp_path)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert Counter(map(tuple, found)) == want


def test_nearest_query(spark, tmp_path):
    rng = np.random.default_rng(4)
    vectors = np.float32(rng.standard_normal((500, 12)))
    vectors[300:420] = vectors[50]  # copies of a query
    rows = [(i, [float(x) for x in v], 1, "x") for i, v in enumerate(vectors)]
    rows += [(550, None, 1, "x"), (600, [0.0] * 12, 1, "x"), (650, [float("nan")] * 12, 1, "x"), (700, [None] + [1.0] * 11, 1, "x")]
    written(spark, tmp_path, "embeddings", rows, "vec_id long, embedding array<float>, rank int, strings string")
    want = brute(np.arange(500), vectors.astype(float), range(0, 500, 50), 5)
    got = defaultdict(list)
    for r in sorted(entry_queries.op5_ann(spark, str(tmp_path)).collect(), key=lambda r: r["rank"]):
        assert r["rank"] == len(got[r.query_id]) + 1
        got[r.query_id].append((r.vec_id, r.score))
    assert set(got) == set(want)
    exact = {q: dict(brute(np.arange(500), vectors.astype(float), [q], 499)[q]) for q in want}
    assert all(abs(exact[q][i] - s) < 1e-12 for q in got for i, s in got[q])
    assert sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want) >= 0.9 * 5 * len(want)
    assert [i for i, _ in got[50]] == [300, 301, 302, 303, 304]


def test_queries_on_empty_tables(spark, tmp_path):
    at = str(tmp_path)
    for name, schema in {"documents": "doc_id long, text string, lang string, source string", "benchmark": "item_id long, text string", "labels": "doc_id long, toxic int", "pages": "page_id long, url string, html string", "embeddings": "vec_id long, embedding array<float>"}.items():
        written(spark, at, name, [], schema)
    for name, query in entry_queries.queries().items():
        assert query(spark, at).collect() == [], name


def test_a_cluster_needs_a_shared_folder():
    from verdigris.llm import common

    class Session:
        """A session of a cluster without the setting."""

        class conf:
            get = staticmethod(lambda name, default=None: default if name == "spark.checkpoint.dir" else "/warehouse")

        class sparkContext:
            master = "spark://host:7077"
            getConf = staticmethod(lambda: Session.conf)

    with pytest.raises(ValueError, match="share"):
        common.checkpoint_dir(Session)
