"""Operators on documents against brute force, with nulls, empty and long texts, ties and repeats."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from verdigris.llm import common, decontaminate, langid, minhash, packing, substring_dedup, token_counts, toxicity

PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def prose(rng, n):
    return " ".join(rng.choice(["the", "of", "and"]) if rng.random() < 0.3 else "".join(rng.choice(["ta", "re", "Mo", "li", "é", "x,"]) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def corpus(seed=0):
    """(doc_id, text, source): prose, copies, near copies, shared passages, and odd rows."""
    rng = random.Random(seed)
    texts = [prose(rng, rng.randrange(1, 120)) for _ in range(60)]
    passage = prose(rng, 40)
    for k in range(0, 60, 7):
        texts[k] = texts[k] + "\n" + passage + " " + prose(rng, 5)
    texts += [texts[3], texts[3], texts[5].upper(), " ".join(texts[9].split()[:-2] + ["changed", "words"])]
    for k in range(12):  # a group of near copies
        words = texts[20].split()
        words[k % len(words)] = f"w{k}"
        texts.append(" ".join(words))
    texts += [None, "", " \n\t ", "one", "ONE", "two words", "x" * 30000, prose(rng, 6000), "a b " * 40, "\x1c 日本 ▁x  y "]
    order = list(range(len(texts)))
    rng.shuffle(order)
    return [(i, texts[k], "s") for i, k in enumerate(order)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), "doc_id long, text string, source string").repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string")


def removed(rows, window):
    first, out = {}, {}
    words = {i: WORD.findall(t or "") for i, t, _ in rows}
    for i in sorted(words):
        for k in range(len(words[i]) - window + 1):
            first.setdefault(tuple(words[i][k : k + window]), i)
    for i, w in words.items():
        keep = [True] * len(w)
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < i:
                keep[k : k + window] = [False] * window
        out[i] = (len(w), keep.count(False), " ".join(x for x, y in zip(w, keep) if y))
    return out


@pytest.mark.parametrize("shard_bytes", [3000, 1 << 20])
def test_substring_dedup_is_exact(docs, shard_bytes):
    rows = substring_dedup.dedup(docs, shard_bytes=shard_bytes).collect()
    assert {r.doc_id: (r.parse.n_words, r.parse.n_removed, r.parse.kept) for r in rows} == removed(corpus(), 13)


def test_factors_lie_where_they_say(docs):
    words = {i: WORD.findall(t or "") for i, t, _ in corpus()}
    factors = [(r.doc_id, f) for r in substring_dedup.dedup(docs, shard_bytes=5000).collect() for f in r.parse.factors]
    assert factors
    for doc, f in factors:
        assert f.ref_doc < doc and f.length >= 13
        assert words[doc][f.start : f.start + f.length] == words[f.ref_doc][f.ref_start : f.ref_start + f.length]


def longest_before(words, docs):
    """Of each place of each passage the longest run that a passage of a smaller document has, by brute force."""
    out = []
    for i, w in enumerate(words):
        for k in range(len(w)):
            best = 0
            for j, v in enumerate(words):
                for m in range(len(v)) if docs[j] < docs[i] else ():
                    n = 0
                    while k + n < len(w) and m + n < len(v) and w[k + n] == v[m + n]:
                        n += 1
                    best = max(best, n)
            out.append(best)
    return out


def test_index_finds_the_longest_earlier_match():
    rng = random.Random(3)
    words = [[rng.randrange(3) for _ in range(rng.randrange(1, 12))] for _ in range(40)]
    words += [words[0], words[1] * 3]
    docs = np.array([rng.randrange(15) for _ in words])
    index = substring_dedup.Index(np.array(sum(words, []), np.uint64), np.array([len(w) for w in words]), docs, np.arange(len(words)))
    assert index.longest.tolist() == longest_before(words, docs)
    flat, found = sum(words, []), np.flatnonzero(index.longest)
    for i in found.tolist():
        j, n = int(index.source[i]), int(index.longest[i])
        assert flat[i : i + n] == flat[j : j + n] and docs[index.of[j]] < docs[index.of[i]]


def test_span_found_only_across_a_border(spark):
    """Greedily 14 words come from document 1, then 6 from 2; the window of 13 words across the border is in 2."""
    words = list(range(1, 21))
    others = [words[:14] + list(range(50, 60)), list(range(70, 80)) + words[7:], words]
    index = substring_dedup.Index(np.array(sum(others, []), np.uint64), np.array([len(w) for w in others]), np.arange(1, 4), np.zeros(3, np.int64))
    start, size, source = index.spans(13)
    at = index.start[2]
    assert [(s - at, n, index.of[j]) for s, n, j in zip(start, size, source)] == [(0, 14, 0), (7, 13, 1)]
    rows = [(k + 1, " ".join(f"w{x}" for x in w)) for k, w in enumerate(others)]
    found = {r.doc_id: r.parse for r in substring_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[3].n_removed == 20 and {f.ref_doc for f in found[3].factors} == {1, 2}


def test_spans_cover_every_window_of_an_earlier_document():
    """Runs of one text, cut anywhere: words of all windows that an earlier document holds are in a span, no others."""
    rng = random.Random(11)
    for kinds in (2, 1000):
        for _ in range(150):
            text = [rng.randrange(kinds) for _ in range(40)]
            runs = [(rng.randrange(25), rng.randrange(4, 28)) for _ in range(8)]
            words = [text[a : a + n] for a, n in runs]
            docs = np.sort([rng.randrange(5) for _ in words])
            index = substring_dedup.Index(np.array(sum(words, []), np.uint64), np.array([len(w) for w in words]), docs, np.zeros(len(words), np.int64))
            covered = np.zeros(index.start[-1], bool)
            for start, size, _ in zip(*index.spans(6)):
                covered[start : start + size] = True
            expected = np.zeros(index.start[-1], bool)
            for i, w in enumerate(words):
                earlier = {tuple(v[k : k + 6]) for j, v in enumerate(words) if docs[j] < docs[i] for k in range(len(v) - 5)}
                for k in range(len(w) - 5):
                    if tuple(w[k : k + 6]) in earlier:
                        expected[index.start[i] + k : index.start[i] + k + 6] = True
            assert covered.tolist() == expected.tolist()


def test_match_that_begins_inside_a_factor_and_goes_on(spark):
    """14 words come from document 1; document 2 holds the words from the second on, six beyond the factor."""
    words = [f"w{x}" for x in range(20)]
    rows = [(1, " ".join(words[:14] + ["a", "b"])), (2, " ".join(["c", "d"] + words[1:])), (3, " ".join(words))]
    index = substring_dedup.Index(np.array([*range(14), 50, 51, 60, 61, *range(1, 20), *range(20)], np.uint64), np.array([16, 21, 20]), np.arange(1, 4), np.zeros(3, np.int64))
    start, size, _ = index.spans(13)
    assert max((start + size)[start >= 37]) == 57
    found = {r.doc_id: r.parse.n_removed for r in substring_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {1: 0, 2: 13, 3: 20}


def test_substring_dedup_layout_nulls_and_repeats(spark, empty):
    passage = " ".join(f"p{i}" for i in range(20))
    rows = [(1, passage), (2, f"Head\n\n{passage}\ntail  end"), (2, f"Head\n\n{passage}\ntail  end"), (None, passage), (3, None), (4, "")]
    found = substring_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string"), layout=True).collect()
    kept = sorted((str(r.doc_id), r.parse.kept, r.parse.n_removed) for r in found)
    assert kept == sorted([("1", passage, 0), ("2", "Head\n\ntail  end", 20), ("2", "Head\n\ntail  end", 20), ("None", passage, 0), ("3", "", 0), ("4", "", 0)])
    assert substring_dedup.dedup(empty).count() == 0
    clash = spark.createDataFrame([(1, "a b", 7, "x")], "doc_id long, text string, shard int, Parse string")
    row = substring_dedup.dedup(clash).first()
    assert row.shard == 7 and row.parse.kept == "a b"
    with pytest.raises(ValueError):
        substring_dedup.dedup(empty, into="text")


def groups(rows, k, num=80, den=100):
    sets = {}
    for i, t, _ in rows:
        w = WORD.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


@pytest.mark.parametrize("shingle", [2, 5])
def test_minhash_groups_are_exact(docs, shingle):
    rows = minhash.near_duplicates(docs, shingle=shingle).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in rows} == groups(corpus(), shingle)


def test_minhash_chain_needs_other_leaders(spark):
    """A chain of links whose ends are not alike is one group."""
    words = [f"w{i}" for i in range(100)]
    rows = [(k, " ".join([*words[3 * k :], *(f"n{i}" for i in range(3 * k))]), "s") for k in range(12)]
    found = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, source string"), shingle=1).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in found} == groups(rows, 1)
    assert {r.component_id for r in found} == {0}


def test_bitmaps_differ_in_fewer_bits_than_sets():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 2**63, n, dtype=np.uint64)) for n in (1, 50, 800)]
    sets += [np.union1d(s[3:], rng.integers(0, 2**63, 4, dtype=np.uint64)) for s in sets]
    bits = minhash.bitmaps(np.concatenate(sets), np.cumsum([0, *map(len, sets)])).to_pylist()
    for a, x in zip(sets, bits):
        for b, y in zip(sets, bits):
            differ = sum(bin((p ^ q) & (2**64 - 1)).count("1") for p, q in zip(x, y))
            assert len(x) == minhash.LONGS and differ <= len(np.setxor1d(a, b)) and (differ - len(np.setxor1d(a, b))) % 2 == 0


def test_minhash_large_group_of_unlike_edits(spark):
    """Copies of one text with edits of their own, some of them too many, against brute force."""
    rng = random.Random(9)
    base = [f"w{i}" for i in range(60)]

    def edited(k):
        words = list(base)
        for _ in range(k % 9):
            words[rng.randrange(60)] = f"e{k}x{rng.randrange(99)}"
        return " ".join(words)

    rows = [(k, edited(k), "s") for k in range(150)]
    found = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, source string"), shingle=2).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in found} == groups(rows, 2)


def test_components_of_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(20)] + [(100, 100 + k) for k in range(1, 9)] + [(200, 199), (199, 300), (50, 50)]
    found = {r.node: r.component for r in minhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**{k: 0 for k in range(21)}, **{100 + k: 100 for k in range(9)}, 199: 199, 200: 199, 300: 199}


def prefix_input(spark, sets, components=None):
    """The two tables that ``prefix_pairs`` takes, of sets of numbers."""
    arrays = [np.array(sorted(s), np.uint64) for s in sets]
    bits = minhash.bitmaps(np.concatenate(arrays), np.cumsum([0, *map(len, arrays)])).to_pylist()
    held = [(i, [int(v) for v in a.view(np.int64)], b) for i, (a, b) in enumerate(zip(arrays, bits, strict=True))]
    documents = [(i, len(s), components[i] if components else i) for i, s in enumerate(sets)]
    return spark.createDataFrame(documents, "id long, n long, component long"), spark.createDataFrame(held, "id long, shingles array<long>, bits array<long>")


@pytest.mark.parametrize("similarity", [(80, 100), (9, 10), (2, 3)])
def test_minhash_prefix_pairs_lose_no_link(spark, similarity):
    num, den = similarity
    rng, sets = random.Random(num), []
    for _ in range(40):
        base = {rng.getrandbits(64) for _ in range(rng.choice([1, 2, 5, 10, 45, 100]))}
        sets.append(base)
        for _ in range(6):  # edits, cuts and growth around the bound, ties in size included
            own = set(rng.sample(sorted(base), len(base) - rng.randrange(0, len(base) // 4 + 1))) | {rng.getrandbits(64) for _ in range(rng.randrange(0, len(base) // 4 + 2))}
            sets.append(own or base)
    components = [i // 2 for i in range(len(sets))]
    like = {(i, j) for j in range(len(sets)) for i in range(j) if components[i] != components[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j])}
    found = {(r.a, r.b) for r in minhash.prefix_pairs(*prefix_input(spark, sets, components), similarity).collect()}
    assert len(like) > 20 and like <= found and all(components[a] != components[b] for a, b in found)


def test_minhash_prefix_entries_of_a_common_passage(spark):
    """Texts that share a passage and are not alike: comparisons grow with the texts, not with their pairs."""
    met = []
    for count in (500, 2000):
        rng = random.Random(3)
        passage = {rng.getrandbits(64) for _ in range(80)}
        sets = [passage | {rng.getrandbits(64) for _ in range(20 if i % 2 else 4)} for i in range(count)]  # 80 of 104, 80 of 120
        components = [i if i % 2 else 0 for i in range(count)]  # half are linked with each other, half with none
        small, large = minhash.prefix_entries(*prefix_input(spark, sets, components), (80, 100))
        pairs = small.join(large.select("token", "small", "large", F.col("component").alias("cx")), ["token", "small", "large"]).where("component != cx").count()
        met.append(pairs)
    assert met[0] <= 10 * 500 and met[1] <= 10 * 2000


def test_minhash_nulls_repeats_and_empty(spark, empty):
    rows = [(7, "a b c d e f"), (7, "a b c d e f"), (3, "a b c d e f"), (None, "a b c d e f"), (8, None), (9, ""), (None, None)]
    found = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), str(r.component_id), r.kept) for r in found) == sorted([("7", "3", False), ("7", "3", False), ("3", "3", True), ("None", "None", True), ("8", "8", True), ("9", "9", True), ("None", "None", True)])
    assert minhash.near_duplicates(empty).count() == 0


def test_circulant_signature_estimates_jaccard():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 400, dtype=np.uint64)
    a, b = base[:300], base[100:]
    both = minhash.signatures(np.concatenate([a, b]), np.array([0, 300, 600]), 512)
    assert abs((both[0] == both[1]).mean() - 200 / 400) < 0.08
    assert (minhash.signatures(a, np.array([0, 300]), 512)[0] == both[0]).all()


def test_permutations_are_bijections():
    x = np.arange(1 << 16, dtype=np.uint32) << np.uint32(7)
    assert len(np.unique(minhash.first_permutation(x))) == len(x)
    assert len(np.unique(minhash.second_permutation(x.copy(), np.empty_like(x)))) == len(x)


def test_token_counts_equal_the_library(docs, empty):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rows = token_counts.token_counts(docs, PIECES).collect()
    assert {r.doc_id: (r.tokens.n_bytes, r.tokens.n_tokens) for r in rows} == {i: (len((t or "").encode()), len(model.encode(t or ""))) for i, t, _ in corpus()}
    assert token_counts.token_counts(empty, PIECES).count() == 0


def test_token_counts_of_random_strings():
    import pyarrow as pa
    import sentencepiece

    model, rng = sentencepiece.SentencePieceProcessor(model_file=PIECES), random.Random(5)
    signs = ["a", "b", " ", "  ", "\n", "▁", "é", "e", "\u0301", "日", "<s>", "</s>", "<0x0A>", "the", "ing", "\x00", "😀", "aaa", "==", "0"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(0, 40))) for _ in range(2000)] + ["a" * 3000, "ab" * 2000, " " * 700, "".join(rng.choice("abcdefgh") for _ in range(1500))]
    texts += ["".join(rng.choice("etaoinshrdlu") for _ in range(n)) for n in (511, 513, 2000, 20_000)] + ["theing" * 3000]
    assert token_counts.count_texts(pa.array(texts), token_counts.Merges.of(PIECES)).tolist() == [len(x) for x in model.encode(texts)]


ITEMS = [(1, "What is the answer to life the universe and all things, said Bob?"), (2, "short item"), (3, None), (4, "!!"), (None, "never used at all"), (2, "short item"), (11, "One two three four five six seven eight nine ten")]


def decon(text, items, width=10):
    fold = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]+", lambda m: m[0].lower(), t or ""))
    words, hit, ids = fold(text), set(), set()
    for item, t in items:
        w = fold(t)
        if item is None or not w:
            continue
        for i in range(max(1, len(w) - width + 1)):
            window = w[i : i + width]
            for k in range(len(words) - len(window) + 1):
                if words[k : k + len(window)] == window:
                    hit |= set(range(k, k + len(window)))
                    ids.add(str(item))
    return len(words), sorted(hit), sorted(ids)


@pytest.mark.parametrize("block_bytes", [20, 1 << 18])
def test_decontamination_is_exact(spark, block_bytes):
    rows = [*corpus(), (900, "He said: WHAT is -- the answer to life, the universe and all things said bob. Short  ITEM! shorts item", "s"), (901, "one two three four five six seven eight nine one two three four five six seven eight nine ten", "s"), (902, "", "s")]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string, source string"), spark.createDataFrame(ITEMS, "item_id long, text string")
    found = {r.doc_id: (r.scan.n_words, list(r.scan.hit), list(r.scan["items"])) for r in decontaminate.scan(docs, bench, block_bytes=block_bytes).collect()}
    assert found == {i: decon(t, ITEMS) for i, t, _ in rows}
    assert found[900][2] == ["1", "2"] and found[901][2] == ["11"]


def test_decontamination_places_and_empty_tables(spark, docs, empty):
    text = "Über «SHORT — item» end"
    assert [text[a:b] for a, b in decontaminate.char_spans(text, [1, 2, 3])] == ["«SHORT — item»"]
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.clean(docs, bench).count() == docs.count()
    one = spark.createDataFrame([(1, "short item", True), (2, "clean", False)], "doc_id long, text string, scan boolean")
    assert [tuple(r) for r in decontaminate.clean(one, spark.createDataFrame(ITEMS, "item_id long, text string")).collect()] == [(2, "clean", False)]
    assert decontaminate.scan(empty, bench).count() == 0


def test_one_automaton_holds_a_large_benchmark():
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(4000)]
    items = [(str(k), " ".join(rng.choice(words) for _ in range(60))) for k in range(700)]
    assert 256 << 10 < sum(len(t) for _, t in items) <= decontaminate.BLOCK_BYTES
    windows = decontaminate.Windows(items, 10)
    for k in (0, 350, 699):
        n, hit, found = windows.scan("new " * 5 + " ".join(items[k][1].split()[20:35]) + " unheard")
        assert (n, hit.tolist(), found) == (21, list(range(5, 20)), {str(k)})


def test_decontamination_names_repeats_and_none(spark):
    item = " ".join(f"w{i}" for i in range(12))
    rows = [(1, item, "x"), (1, item, "x"), (2, None, "y"), (3, "w1", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, Scan string")
    bench = spark.createDataFrame([("a", item), ("a", item), (None, item), ("b", None), ("c", "..")], "item_id string, text string")
    found = decontaminate.scan(docs, bench).collect()
    assert sorted((r.doc_id, len(r.scan.hit), tuple(r.scan["items"])) for r in found) == [(1, 12, ("a",)), (1, 12, ("a",)), (2, 0, ()), (3, 0, ())]
    assert decontaminate.scan(docs.limit(0), bench).count() == 0
    assert decontaminate.clean(docs, bench).count() == 2


def test_packing_holds_every_id_once(spark, docs):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(WORD_BPE)
    ids = {i: np.array([*model.encode(t or "", add_special_tokens=False).ids, 2], "<u4") for i, t, _ in corpus()}
    pieces = packing.pack(docs, WORD_BPE, window=512, open_windows=4).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        assert p.ids_crc32 == zlib.crc32(ids[p.doc_id][p.start : p.start + p.length].tobytes())
        assert p.doc_tokens == len(ids[p.doc_id]) and p.length > 0
        by_doc[p.doc_id].append((p.start, p.length))
        by_sequence[p.sequence_id].append((p.offset, p.length))
    assert set(by_doc) == set(ids)
    for spans, whole in [*((by_doc[i], len(ids[i])) for i in ids), *((s, None) for s in by_sequence.values())]:
        at = 0
        for start, length in sorted(spans):
            assert start == at
            at += length
        assert at == whole if whole is not None else at <= 512
    total = sum(map(len, ids.values()))
    used = [sum(n for _, n in s) for s in by_sequence.values()]
    padded = sum(512 - n for n in used if n & (n - 1))
    assert padded <= 0.1 * total
    assert packing.cuts(1300, 512) == [512, 512, 256, 16, 4]


def test_packing_words_equal_whole_texts():
    import pyarrow as pa
    from tokenizers import Tokenizer

    model, rng = Tokenizer.from_file(WORD_BPE), random.Random(7)
    signs = ["a", "B", " ", "\n", "É", "e", "\u0301", "日", "<|endoftext|>", "'s", "'S", "the", "\x00", "😀", "Σ", "İ", "1", "==", ".", ",", "\x1c", "ß", "ﬁ", "\u0958"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(0, 30))) for _ in range(3000)]
    flat, counts = packing.Encoder(WORD_BPE).encode(pa.array(texts))
    expected = [e.ids for e in model.encode_batch(texts, add_special_tokens=False)]
    assert counts.tolist() == [len(e) for e in expected]
    assert flat.tolist() == [i for e in expected for i in e]


def test_packing_reads_no_other_columns(spark):
    rows = [(1, "one two", "x", 9), (2, "word " * 60_000, "y", 8)]
    found = packing.pack(spark.createDataFrame(rows, "doc_id long, text string, sequence_id string, ids int"), WORD_BPE).collect()
    assert {sum(p.length for p in found if p.doc_id == 2)} == {p.doc_tokens for p in found if p.doc_id == 2}
    assert {p.doc_id for p in found} == {1, 2} and max(p.length for p in found) <= 4096


def test_packing_odd_rows(spark, empty):
    rows = [(None, None), (5, ""), (5, "")]
    found = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), WORD_BPE).collect()
    assert sum(p.length for p in found) == 3 and {p.doc_tokens for p in found} == {1}
    assert packing.pack(empty, WORD_BPE).count() == 0


LANGUAGES = {"en": "the quick brown fox and the lazy dog were walking through those woods", "de": "der schnelle braune Fuchs und die faulen Hunde gingen durch den Wald", "es": "el rápido zorro marrón y los perros perezosos caminaban por el bosque"}


def test_language_id(spark, empty):
    rng = random.Random(3)
    rows = [(k, " ".join(rng.choices(LANGUAGES[x].split(), k=12)), x) for k, x in enumerate(["en", "de", "es"] * 30)]
    labelled = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(labelled, PIECES)
    assert model.languages == ["de", "en", "es"] and np.allclose(model.probability.sum(axis=0), 1)
    tests = [(1, "THE woods and dogs"), (2, "durch die Wälder"), (3, "los bosques, 123"), (4, None), (5, ""), (6, "123 !?"), (7, "der" * 4000)]
    found = {r.doc_id: r.language for r in langid.identify(spark.createDataFrame(tests, "doc_id long, text string"), model, PIECES).collect()}
    assert [found[i].lang_pred for i in range(1, 7)] == ["en", "de", "es", "und", "und", "und"]
    assert all(0 <= f.score <= 1 for f in found.values()) and found[4].score == 0
    nothing = langid.fit(empty.withColumn("lang", F.lit(None).cast("string")), PIECES)
    assert langid.identify(labelled.select("doc_id", "text"), nothing, PIECES).where("language.lang_pred <> 'und'").count() == 0


def test_results_replace_columns_of_their_name(spark):
    df = spark.createDataFrame([(1, "der Wald", "x", 3)], "doc_id long, text string, Tokens string, n int")
    row = token_counts.token_counts(df, PIECES).first()
    assert row.tokens.n_bytes == 8 and row.n == 3
    assert common.free_name(["A", "a_"], "a") == "a__"


def test_language_id_odd_rows(spark, empty):
    """Ties, repeats, a very long run of letters, a column of the result's name, an empty table, no labelled rows."""
    train = spark.createDataFrame([("the and of thing", "en"), ("the and of thing", "aa"), ("the and", None), (None, "en")], "text string, lang string")
    model = langid.fit(train, PIECES)
    rows = [(1, "the thing", "x"), (1, "the thing", "x"), (2, "a" * 200_000, "x"), (3, "12 !", "x"), (4, None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, Language string")
    found = langid.identify(docs, model, PIECES).collect()
    assert len(found) == 5 and {r.language.lang_pred for r in found if r.doc_id < 3} == {"aa"}
    assert {(r.language.lang_pred, r.language.score) for r in found if r.doc_id > 2} == {("und", 0.0)}
    assert all(abs(r.language.score - 0.5) < 1e-9 for r in found if r.doc_id < 3)
    assert langid.identify(empty, model, PIECES).count() == 0
    nothing = langid.fit(train.limit(0), PIECES)
    assert {r.language.lang_pred for r in langid.identify(docs, nothing, PIECES).collect()} == {"und"}


def test_forward_sums_all_segmentations():
    vocab = langid.vocabulary(PIECES)
    prob = np.random.default_rng(0).random((len(vocab.pieces), 2)) / 1000
    place = {p: k for k, p in enumerate(vocab.pieces)}

    def total(word, k):
        if not word:
            return 1.0
        out = langid.UNKNOWN * total(word[1:], k)
        return out + sum(prob[place[word[:n]], k] * total(word[n:], k) for n in range(1, len(word) + 1) if word[:n] in place)

    words = ["the", "wald", "x", "日q"]
    found = langid.log_likelihoods(words, vocab, prob)
    expected = np.log([[total("▁" + w, k) for k in (0, 1)] for w in words])
    assert np.allclose(found, expected)
    assert np.isfinite(langid.log_likelihoods(["a" * 5000], vocab, prob)).all()


def test_expected_counts_cover_long_runs(monkeypatch):
    vocab = langid.vocabulary(PIECES)
    prob = np.random.default_rng(1).random(len(vocab.pieces)) / 1000
    size = np.array([len(p) for p in vocab.pieces])
    for word in ("derwald" * 12, "theandof" * 300):
        assert abs(langid.expected_counts([word], np.ones(1), vocab, prob) @ size / (len(word) + 1) - 1) < 0.01
    short = ["derwald" * 3, "the", "walking"]
    plain = langid.expected_counts(short, np.ones(3), vocab, prob)
    monkeypatch.setattr(langid, "UNSCALED", 1)
    assert np.allclose(langid.expected_counts(short, np.ones(3), vocab, prob), plain)


def test_toxicity_finds_rare_inflections(spark):
    rng = random.Random(11)
    stems = ["lowei", "vequa"]

    def text(toxic):
        words = prose(rng, 60).split()
        if toxic:
            for _ in range(2):
                words.insert(rng.randrange(len(words)), rng.choice(stems) + rng.choice(["ta", "re", "mo", "li", "x"]) + rng.choice("aeiou"))
        return " ".join(words)

    rows = [(k, text(k % 4 == 0), int(k % 4 == 0)) for k in range(400)]
    labelled = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(labelled, held_back=F.col("doc_id") % 10 >= 7)
    tests = spark.createDataFrame([(k, text(k < 40), k) for k in range(80)] + [(900, None, 0), (901, "", 0)], "doc_id long, text string, score int")
    found = {r.doc_id: r.toxicity.score for r in toxicity.assess(tests, model).collect()}
    assert all(0 <= s <= 1 for s in found.values()) and found[900] == found[901]
    right = sum((found[k] >= 0.5) == (k < 40) for k in range(80))
    assert right >= 70
    one = toxicity.fit(labelled.where("toxic = 0"), held_back=F.lit(False))
    assert toxicity.assess(tests, one).where("toxicity.score >= 0.5").count() == 0


def exact_ratios(texts, rows):
    """The ratio of each text by the definition of Kneser-Ney, from dictionaries keyed by whole sequences."""
    spell = lambda word: [("\1" * 4 + word + "\2")[k : k + 5] for k in range(len(word) + 1)]
    n, seen, types = (defaultdict(lambda: [0, 0]) for _ in range(3))
    for body, toxic in rows:
        for word in set(body.split()):
            for s in spell(word):
                n[s][toxic] += 1
                seen[s[:4]][toxic] += 1
    before, current = {}, set(n)  # how many signs stand before each shorter sequence
    for size in (4, 3, 2, 1):
        before[size] = defaultdict(int)
        for s in current:
            before[size][s[1:]] += 1
        current = set(before[size])
    for s, by_class in n.items():
        for c in (0, 1):
            types[s[:4]][c] += by_class[c] > 0

    def shared(s):
        if not s:
            return 1 / (len(before[1]) + 1)
        own = {x: k for x, k in before[len(s)].items() if x[:-1] == s[:-1]}
        total = sum(own.values())
        return (max(own.get(s, 0) - 0.75, 0) + 0.75 * len(own) * shared(s[1:])) / total if total else shared(s[1:])

    def probability(s, c, back):
        total = seen.get(s[:4], (0, 0))[c]
        return (max(n.get(s, (0, 0))[c] - 0.75, 0) + 0.75 * types[s[:4]][c] * back) / total if total else back

    out = []
    for text in texts:
        total = 0.0
        for word in text.split():
            backs = [(s, shared(s[1:])) for s in spell(word)]
            total += np.log(0.97 + 0.03 * np.exp(sum(np.log(probability(s, 1, b) / probability(s, 0, b)) for s, b in backs)))
        out.append(total / (len(text.split()) + 50))
    return out


def test_toxicity_is_kneser_ney(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randrange(1, 7)))
    rows = [(k, " ".join(word() for _ in range(6)), k % 3 % 2) for k in range(60)]
    model = toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string, toxic int"), held_back=F.col("doc_id") >= 40)
    tests = [(k, " ".join(word() for _ in range(4)) + " xyz " + word()) for k in range(30)]
    found = {r.doc_id: r.toxicity.ratio for r in toxicity.assess(spark.createDataFrame(tests, "doc_id long, text string"), model).collect()}
    assert np.allclose([found[k] for k, _ in tests], exact_ratios([t for _, t in tests], [r[1:] for r in rows]), rtol=1e-9)


def test_toxicity_odd_rows(spark, empty):
    """Repeated rows, a very long text, an empty table, a column of the result's name, a score of just 0.5."""
    rows = [(k, "abc dé" if k % 2 else "xyz uvw", k % 2) for k in range(40)] * 2
    labelled = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(labelled, held_back=F.col("doc_id") >= 20)
    tests = spark.createDataFrame([(1, "abc " * 300_000, "x"), (2, "abc dé", "y"), (2, "abc dé", "y"), (3, "123", "z")], "doc_id long, text string, Toxicity string")
    found = toxicity.assess(tests, model).collect()
    assert len(found) == 4 and {r.toxicity.ratio for r in found if r.doc_id == 3} == {0.0}
    assert len({r.toxicity.score for r in found if r.doc_id == 2}) == 1
    assert all(r.toxicity.ratio > 0 for r in found if r.doc_id < 3)
    assert toxicity.assess(empty, model).count() == 0
    none = toxicity.fit(labelled.limit(0), held_back=F.lit(True))
    assert toxicity.assess(tests, none).agg(F.max("toxicity.score")).first()[0] < 1e-6
    half = toxicity.Model(model.counts, (0.0, 0.0))
    assert toxicity.assess(tests, half).where("toxicity.score >= 0.5").count() == 4


def test_toxicity_counts_whole_sequences(spark):
    rng = random.Random(5)
    word = lambda: "".join(chr(0x4E00 + rng.randrange(600)) for _ in range(4))
    rows = [(k, " ".join(word() for _ in range(40)), k % 2) for k in range(500)]
    labelled = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(labelled, held_back=F.col("doc_id") >= 400)
    # about 80,000 sequences, among which hashes into 2**20 buckets collide thousands of times
    tests = [(k, " ".join(text.split()[:5]) + " " + word()) for k, text, _ in rows[:100]] + [(900, None), (901, "")]
    found = {r.doc_id: r.toxicity.ratio for r in toxicity.assess(spark.createDataFrame(tests, "doc_id long, text string"), model).collect()}
    learned = [r[1:] for r in rows]
    assert len(found) == len(tests) and found[900] == found[901] == 0
    assert model.counts.count() == len({s for text, _ in learned for w in text.split() for s in [("\1" * 4 + w + "\2")[k : k + 5] for k in range(5)]})
    right = sum((found[k] > 0) == (toxic == 1) for k, _, toxic in rows[:100])
    assert right >= 95
    one = toxicity.assess(spark.createDataFrame([(1, None)], "doc_id long, text string"), model, keep_text=False)
    assert one.columns == ["doc_id", "toxicity"] and one.first().toxicity.ratio == 0


def test_toxicity_learns_from_held_back_rows(spark):
    rng = random.Random(8)
    bad = lambda k: k % 4 == 0
    rows = [(k, prose(rng, 30) + (" zuqqa" if bad(k) and k < 300 else " vixxo" if bad(k) else ""), int(bad(k))) for k in range(400)]
    labelled = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    # only held-back rows hold the second expression, and the curve takes few of them
    model = toxicity.fit(labelled, held_back=F.col("doc_id") >= 260, calibration_rows=40)
    tests = spark.createDataFrame([(1, "vixxo"), (2, "zuqqa")], "doc_id long, text string")
    assert all(r.toxicity.ratio > 0.03 for r in toxicity.assess(tests, model).collect())
    spelled = lambda w: sum((ord(c) + 2) << (21 * (2 - i)) for i, c in enumerate(w))
    assert model.counts.where((F.col("lo") == spelled("xxo")) & (F.col("n1") == 25)).count() == 1


def test_samples_take_copies_once(spark):
    rng = random.Random(4)
    texts = [prose(rng, 12) for _ in range(10)]
    rows = lambda n: spark.createDataFrame([(t, "en") for t in texts for _ in range(n)], "text string, lang string")
    once, often = (langid.fit(rows(n), PIECES, per_language=10) for n in (1, 50))
    assert np.allclose(once.probability, often.probability)
    labelled = spark.createDataFrame([(t + " zuqqa" * (k % 2), k % 2) for k, t in enumerate(texts) for _ in range(20)], "text string, toxic int")
    assert toxicity.fit(labelled, held_back=F.lit(True), calibration_rows=10).curve[0] != 0


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(2)
    passage = " ".join(f"shared{i}" for i in range(60))
    rows = [(k, " ".join(rng.choices(LANGUAGES[x].split(), k=40)) + f" unique{k}", x, "s", 1) for k, x in enumerate(["en", "de", "es"] * 10)]
    rows += [(100, rows[4][1], "de", "s", 1), (101, "12345", "en", "s", 1), (102, f"{passage} here", "en", "s", 1), (103, f"{rows[0][1]} {passage} own words stay here", "en", "s", 1), (104, "bench one two three four five six seven eight nine ten", "en", "s", 1), (4, rows[4][1], "de", "s", 1)]
    folder = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, "one two three four five six seven eight nine ten")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder).cache()
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        kept.append(sorted(r.doc_id for r in docs.collect()))
    assert 101 not in kept[0] and len(kept[0]) == 35
    assert 100 not in kept[1] and kept[1].count(4) == 1
    texts = {r.doc_id: r for r in docs.collect()}
    assert "shared30" not in texts[103].text and texts[103].n_chars == len(texts[103].text)
    assert 104 not in kept[3] and kept[3] == sorted({*kept[2]} - {104})
    assert {p.doc_id for p in corpus_pipeline.run(spark, folder).collect()} == set(kept[3])


def test_pipeline_stages_take_odd_rows(spark, tmp_path):
    """Null and empty texts, rows of one id with different texts, an empty table, columns named like results."""
    import corpus_pipeline

    words = " ".join(f"w{i}" for i in range(30))
    rows = [(1, words, "en", 1, "p"), (1, words + " b", "en", 1, "q"), (2, None, "en", 0, "r"), (3, "", "en", 0, "s"), (4, words.replace("w", "v"), "en", 1, "t")]
    spark.createDataFrame([(1, "one two three")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_chars long, Parse string").repartition(3)
    for name, stage in corpus_pipeline.STAGES[1:4]:
        found = stage(spark, docs, str(tmp_path))
        assert found.columns == docs.columns, name
        kept = sorted((r.doc_id, r.text or "", r.Parse) for r in found.collect())
        once = [(1, words, "p")] if name == "near_dedup" else [(1, words, "p"), (1, words + " b", "q")]
        assert kept == [*once, (2, "", "r"), (3, "", "s"), (4, words.replace("w", "v"), "t")], name
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    assert {r.doc_id for r in corpus_pipeline.pack(spark, docs, str(tmp_path)).collect()} == {1, 2, 3, 4}


def test_pipeline_takes_long_texts_and_language_id_odd_rows(spark, tmp_path):
    """The first stage on nulls, empty texts, an empty table and a clashing column; every stage on long texts."""
    import corpus_pipeline

    rng = random.Random(8)
    rows = [(k, " ".join(rng.choices(LANGUAGES[x].split(), k=40)), x, 0, "p") for k, x in enumerate(["en", "de"] * 12)]
    rows += [(30, None, "en", 0, "p"), (31, "", "en", 0, "p"), (32, "123 !", "en", 0, "p"), (33, rows[0][1], None, 0, "p"), (33, rows[0][1], None, 0, "p")]
    long = " ".join(rng.choices(LANGUAGES["en"].split(), k=12_000)) + " e" + "n" * 20_000
    rows.append((40, long, "en", len(long), "p"))
    schema = "doc_id long, text string, lang string, n_chars long, Language string"
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "one two three")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    first = corpus_pipeline.language_id(spark, docs, str(tmp_path))
    assert first.columns == docs.columns
    assert sorted(r.doc_id for r in first.collect()) == [*range(24), 33, 33, 40]
    assert corpus_pipeline.language_id(spark, docs.limit(0), str(tmp_path)).count() == 0
    for name, stage in corpus_pipeline.STAGES[1:4]:
        kept = stage(spark, docs.where("doc_id in (30, 40)"), str(tmp_path)).collect()
        assert sorted((r.doc_id, r.text) for r in kept) == [(30, None), (40, long)], name
    pieces = corpus_pipeline.pack(spark, docs.where("doc_id = 40"), str(tmp_path)).collect()
    assert sum(p.length for p in pieces) == pieces[0].doc_tokens > 12_000


def test_empty_sha_of_items():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")
