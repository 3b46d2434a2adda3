"""Phrase collocations from vertical positional inverted lists.

A word's inverted list holds its places, a place being the number of the word in its slice of one
language's documents, with a gap wherever a piece or a document ends. So two words follow each other in a
piece exactly where their places do. A frequent phrase of k words is extended by merge-joining its places,
moved by k, with the lists of all adjacent words in order of place; the phrase that begins one place later must be
frequent, too. Each extension's list is as long as the extension is frequent in the slice; the lengths
are summed over slices, and what stays frequent is sent back to the slices that have it, which go on
with its list. No phrase below ``least`` is extended and none above is lost.

Words and phrases are counted in buckets (by hash) to which a slice sends each of them once, with its list's length. A
task holds one slice's lists or one bucket; nothing grows with a frequent word or a large language.
Lists are cut out of the documents twice (words, places), so ``docs`` must give the same rows in the same
order each time, as scans of files do; checksums stop the query otherwise.

Defined cases: null texts and empty ones have no words; a null language is ``und``; texts may have any
length; repeated rows count each time; an empty table gives no rows; ties are broken by the phrase, which is unique in
its language; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, discard, mix64, quoted, starts_of, written
from .slices import Words, buckets, pack, pack_strings, same, slices, strings, unpack, unpack_strings, utf8

UNKNOWN = "und"
#: Bytes that end a piece, and bytes that end a word.
CUTS, BLANKS = b".,;:!?\x0a\x0b\x0c\x0d", b" \t"
#: Bytes of text of a slice, and of the corpus for each bucket.
SLICE_TEXT, BUCKET_TEXT = 16 << 20, 4 << 20
#: Parts that a language's best phrases are taken from before they meet.
PARTS = 64

_kind = np.zeros(256, np.uint8)
_kind[list(BLANKS)] = 1
_kind[list(CUTS)] = 2
_lower = np.arange(256, dtype=np.uint8)
_lower[0x41:0x5B] += 0x20

LEVEL = "lang string, slice bigint, mark bigint, bucket bigint, n bigint, prev binary, word binary, amount binary, id binary"


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of all texts, lower-cased, and their places."""
    data, offsets = utf8(texts)
    kind = _kind[data]
    inside = kind == 0
    first = np.zeros(len(data), bool)
    first[offsets[:-1][np.diff(offsets) > 0]] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | first[1:]
    start = np.flatnonzero(begins)
    breaks = np.flatnonzero(first | (kind == 2))
    segment = np.searchsorted(breaks, start, side="right")
    places = np.arange(len(start)) + np.cumsum(np.diff(segment, prepend=segment[:1]) > 0)
    count = np.cumsum(inside)
    edges = np.append(count[start] - 1, count[-1] if len(count) else 0)
    return strings(_lower[data[inside]], edges), places


class Lists:
    """Inverted lists: distinct ids, the length of each list, and all places, list after list."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray, places: np.ndarray):
        self.ids, self.sizes, self.places = ids, sizes, places

    @classmethod
    def of(cls, ids: np.ndarray, places: np.ndarray) -> "Lists":
        """From the id at each place, places in order."""
        order = np.argsort(ids, kind="stable")
        distinct, sizes = np.unique(ids, return_counts=True)
        return cls(distinct, sizes, places[order])

    def in_order(self) -> tuple[np.ndarray, np.ndarray]:
        """All lists merged by place: the places, and the number of the list each is of."""
        order = np.argsort(self.places, kind="stable")
        return self.places[order], np.repeat(np.arange(len(self.ids)), self.sizes)[order]

    def only(self, keep: np.ndarray) -> "Lists":
        """The lists without some of their places, and without lists that have none left."""
        sizes = np.bincount(np.repeat(np.arange(len(self.ids)), self.sizes)[keep], minlength=len(self.ids))
        return Lists(self.ids[sizes > 0], sizes[sizes > 0], self.places[keep])

    def packed(self) -> bytes:
        step = np.diff(self.places, prepend=0)
        heads = starts_of(self.sizes)[:-1]
        step[heads] = self.places[heads]
        blobs = [pack(np.diff(self.ids, prepend=0)), pack(self.sizes), pack(step)]
        return b"".join(len(b).to_bytes(8, "little") + b for b in blobs)

    @classmethod
    def unpacked(cls, blob: bytes) -> "Lists":
        found, at = [], 0
        while at < len(blob):
            end = at + 8 + int.from_bytes(blob[at : at + 8], "little")
            found.append(unpack(blob[at + 8 : end]))
            at = end
        step, heads = found[2], starts_of(found[1])[:-1]
        run = np.cumsum(step)
        return cls(np.cumsum(found[0]), found[1], run - np.repeat(run[heads] - step[heads], found[1]))


def extended(phrases: Lists, words: Lists, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places, phrases and words (by number) where a phrase of k words is followed by a word."""
    at, phrase = phrases.in_order()
    where, word = (at, phrase) if words is phrases else words.in_order()
    if not len(at) or not len(where):
        return at[:0], phrase[:0], word[:0]
    next_ = np.minimum(np.searchsorted(where, at + k), len(where) - 1)
    hit = where[next_] == at + k
    if k > 1:  # its last k words are a frequent phrase as well
        hit &= at[np.minimum(np.searchsorted(at, at + 1), len(at) - 1)] == at + 1
    return at[hit], phrase[hit], word[next_[hit]]


def within(places: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Which of the places are among the ordered ones."""
    return ordered[np.minimum(np.searchsorted(ordered, places), len(ordered) - 1)] == places if len(ordered) else np.zeros(len(places), bool)


def still_needed(phrases: Lists, words: Lists, k: int) -> tuple[Lists, Lists]:
    """The lists without places that no longer phrase can use: phrases of k words that neither follow
    one nor are followed by one, one place on, and words that end no phrase."""
    at = np.sort(phrases.places)
    kept = phrases.only(within(phrases.places + 1, at) | within(phrases.places - 1, at))
    return (kept, kept) if words is phrases else (kept, words.only(within(words.places - k + 1, at)))


def bucket_of(prev: np.ndarray, word: np.ndarray, count: int) -> np.ndarray:
    return (mix64(mix64(prev.astype(np.uint64)) + word.astype(np.uint64)) % np.uint64(count)).astype(np.int64)


def _table(rows: list[tuple]) -> pa.Table:
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
    names = [c.split(" ")[0] for c in LEVEL.split(", ")]
    return pa.table([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=names)


def _candidates(lang: str, number: int, phrases: Lists, words: Lists, k: int, count: int, last: bool) -> Iterator[tuple]:
    """The slice's own row, with its lists, and a row for each bucket of extensions."""
    phrases, words = still_needed(phrases, words, k)
    _, phrase, word = extended(phrases, words, k)
    code, sizes = np.unique(phrase * max(1, len(words.ids)) + word, return_counts=True)
    if not len(code):
        return
    if not last:
        yield lang, number, None, None, None, phrases.packed(), b"" if words is phrases else words.packed(), None, None
    prev, word = phrases.ids[code // len(words.ids)], words.ids[code % len(words.ids)]
    bucket = bucket_of(prev, word, count)
    order = np.argsort(bucket, kind="stable")  # in a bucket still by phrase and word
    prev, word, sizes, bucket = prev[order], word[order], sizes[order], bucket[order]
    edges = np.flatnonzero(np.diff(bucket, prepend=-1, append=-1))
    for s, e in zip(edges[:-1], edges[1:]):
        yield lang, number, None, int(bucket[s]), None, pack(np.diff(prev[s:e], prepend=0)), pack(word[s:e]), pack(sizes[s:e]), None


def mine(docs: DataFrame, *, lang_col: str = "lang", text_col: str = "text", longest: int = 4, least: int = 30, best: int = 2000, covered: tuple[int, int] = (80, 100)) -> DataFrame:
    """Each language's ``best`` phrases of 2 to ``longest`` words: lang, rank, phrase, a, l, r, n, score.

    A phrase is left out where a longer candidate that holds its words occurs at least covered[0] /
    covered[1] times as often.
    """
    found, n = frequent(docs, lang_col=lang_col, text_col=text_col, longest=longest, least=least)
    return scored(found, n, best=best, covered=covered)


def frequent(docs: DataFrame, *, lang_col: str, text_col: str, longest: int, least: int) -> tuple[DataFrame, DataFrame]:
    """Phrases of 1 to ``longest`` words with their exact frequency a, from ``least`` on (lang, words,
    phrase, a), and the words of each language (lang, n)."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col(quoted(lang_col)).cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col(quoted(text_col)).alias("text"))
    count = buckets(rows, "text", BUCKET_TEXT)

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[str, int, Words, np.ndarray]]:
        """Language, number, words and places of each slice and language."""
        for number, parts in slices(batches, "text", SLICE_TEXT):
            of = [pc.dictionary_encode(p.column("lang")) for p in parts]
            for lang in sorted({v for d in of for v in d.dictionary.to_pylist()}):
                listed, places, at = [], [np.zeros(0, np.int64)], 0
                for part in parts:
                    found, place = words_of(pc.fill_null(part.column("text").filter(pc.equal(part.column("lang"), lang)), ""))
                    if len(place):
                        listed.append(found)
                        places.append(place + at)
                        at += int(place[-1]) + 2
                if at:
                    yield lang, number, Words(listed, count, lang.encode() + b"\n"), np.concatenate(places)

    def words(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, number, found, _ in cut(batches):
            amount = np.bincount(found.number, minlength=len(found.distinct))
            yield from _table([(lang, number, found.check, b, None, None, pack_strings(found.distinct.slice(s, e - s)), pack(amount[s:e]), None) for b, s, e in found.runs()]).to_batches()

    def places(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, number, found, place in cut(batches):
            often = np.argsort(-np.bincount(found.number, minlength=len(found.distinct)), kind="stable")
            rank = np.empty(len(often), np.int64)
            rank[often] = np.arange(len(often))
            yield from _table([(lang, number, found.check, None, None, pack(often), pack(rank[found.number]), pack(np.diff(place, prepend=0)), None)]).to_batches()

    def count_words(bucket: pa.Table) -> pa.Table:
        """One row of the bucket's frequent words, and one for each slice: the ids, by word."""
        lists = [unpack_strings(w) for w in bucket.column("word").to_pylist()]
        amounts = [unpack(a) for a in bucket.column("amount").to_pylist()]
        every = pa.concat_arrays(lists).dictionary_encode()
        index = every.indices.to_numpy(zero_copy_only=False)
        total = np.bincount(index, weights=None, minlength=len(every.dictionary)) * 0
        np.add.at(total, index, np.concatenate(amounts))
        often = np.flatnonzero(total >= least)
        often = often[np.argsort(np.array(every.dictionary.take(pa.array(often)).to_pylist(), object), kind="stable")] if len(often) else often
        lang, of = bucket.column("lang")[0].as_py(), bucket.column("bucket")[0].as_py()
        ids = np.zeros(len(total), np.int64)
        ids[often] = (of << 32) + np.arange(len(often)) + 1
        out, at = [(lang, None, None, of, int(total.sum()), None, pack_strings(every.dictionary.take(pa.array(often, pa.int64()))), pack(total[often]), pack(ids[often]))], 0
        for number, mark, one in zip(bucket.column("slice").to_pylist(), bucket.column("mark").to_pylist(), lists):
            out.append((lang, number, mark, of, None, None, None, None, pack(ids[index[at : at + len(one)]])))
            at += len(one)
        return _table(out)

    def first_lists(ids: pa.Table, rows: pa.Table) -> pa.Table:
        same(ids.column("mark"), rows.column("mark"))
        ids, row = ids.sort_by("bucket"), rows.to_pylist()[0]
        known = np.concatenate([np.zeros(0, np.int64), *map(unpack, ids.column("id").to_pylist())])[unpack(row["prev"])]
        at, place = known[unpack(row["word"])], np.cumsum(unpack(row["amount"]))
        lists = Lists.of(at[at > 0], place[at > 0])
        return _table(list(_candidates(row["lang"], row["slice"], lists, lists, 1, count, longest <= 2)) if longest > 1 else [])

    def count_phrases(bucket: pa.Table) -> pa.Table:
        """One row of the bucket's frequent phrases, and one for each slice that has some of them."""
        prevs = [np.cumsum(unpack(p)) for p in bucket.column("prev").to_pylist()]
        prev, word = np.concatenate(prevs), np.concatenate([unpack(w) for w in bucket.column("word").to_pylist()])
        amount = np.concatenate([unpack(a) for a in bucket.column("amount").to_pylist()])
        order = np.lexsort((word, prev))
        p, w = prev[order], word[order]
        head = np.flatnonzero(np.append(True, (p[1:] != p[:-1]) | (w[1:] != w[:-1])))
        total = np.add.reduceat(amount[order], head)
        often = np.flatnonzero(total >= least)
        lang, of = bucket.column("lang")[0].as_py(), bucket.column("bucket")[0].as_py()
        known = np.zeros(len(head), np.int64)
        known[often] = (of << 32) + np.arange(len(often)) + 1
        ids = np.empty(len(prev), np.int64)
        ids[order] = np.repeat(known, np.diff(np.append(head, len(prev))))
        out, at = [], 0
        if len(often):
            at_ = head[often]
            out.append((lang, None, None, of, None, pack(np.diff(p[at_], prepend=0)), pack(w[at_]), pack(total[often]), pack(known[often])))
        for number, one in zip(bucket.column("slice").to_pylist(), prevs):
            mine_ = np.arange(at, at + len(one))
            at += len(one)
            mine_ = mine_[ids[mine_] > 0]
            if len(mine_):
                out.append((lang, number, None, of, None, pack(np.diff(prev[mine_], prepend=0)), pack(word[mine_]), None, pack(ids[mine_])))
        return _table(out)

    def next_lists(k: int):
        def run(lists: pa.Table, kept: pa.Table) -> pa.Table:
            """Lists of the frequent phrases of k words, and their extensions."""
            if not lists.num_rows or not kept.num_rows:
                return _table([])
            row = lists.to_pylist()[0]
            shorter = Lists.unpacked(row["prev"])
            words = Lists.unpacked(row["word"]) if row["word"] else shorter
            prev = np.concatenate([np.cumsum(unpack(p)) for p in kept.column("prev").to_pylist()])
            word, ids = (np.concatenate([unpack(x) for x in kept.column(c).to_pylist()]) for c in ("word", "id"))
            code = np.searchsorted(shorter.ids, prev) * len(words.ids) + np.searchsorted(words.ids, word)
            order = np.argsort(code)
            code, ids = code[order], ids[order]
            place, phrase, next_ = extended(shorter, words, k - 1)
            asked = phrase * len(words.ids) + next_
            at = np.minimum(np.searchsorted(code, asked), len(code) - 1)
            hit = code[at] == asked
            longer = Lists.of(ids[at[hit]], place[hit])
            return _table(list(_candidates(row["lang"], row["slice"], longer, words, k, count, k + 1 >= longest)))

        return run

    key = ["lang", "slice"]
    levels = [written(rows.mapInArrow(words, LEVEL).groupBy("lang", "bucket").applyInArrow(count_words, LEVEL), "words")]
    lists = written(levels[0].where("slice is not null").groupBy(key).cogroup(rows.mapInArrow(places, LEVEL).groupBy(key)).applyInArrow(first_lists, LEVEL), "lists-2")
    for k in range(2, longest + 1):
        levels.append(written(lists.where("bucket is not null").groupBy("lang", "bucket").applyInArrow(count_phrases, LEVEL), f"phrases-{k}"))
        if k < longest:
            kept = levels[-1].where("slice is not null")
            lists, before = written(lists.where("bucket is null").groupBy(key).cogroup(kept.groupBy(key)).applyInArrow(next_lists(k), LEVEL), f"lists-{k + 1}"), lists
            discard(before)
    discard(lists)

    def open_words(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([row["lang"]] * len(a := unpack(row["amount"])), pa.string()), pa.array(unpack(row["id"])), unpack_strings(row["word"]).cast(pa.large_string()).cast(pa.string()), pa.array(a)], names=["lang", "id", "phrase", "a"])

    def open_phrases(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([row["lang"]] * len(a := unpack(row["amount"])), pa.string()), pa.array(unpack(row["id"])), pa.array(np.cumsum(unpack(row["prev"]))), pa.array(unpack(row["word"])), pa.array(a)], names=["lang", "id", "prev", "word", "a"])

    whole = levels[0].where("slice is null")
    n = whole.groupBy("lang").agg(F.sum("n").alias("n"))
    single = whole.mapInArrow(open_words, "lang string, id bigint, phrase string, a bigint")
    shorter, found = single, single.select("lang", F.lit(1).alias("words"), "phrase", "a")
    for k, level in enumerate(levels[1:], 2):
        parts = level.where("slice is null").mapInArrow(open_phrases, "lang string, id bigint, prev bigint, word bigint, a bigint")
        heads = shorter.select("lang", F.col("id").alias("prev"), F.col("phrase").alias("head"))
        tails = single.select("lang", F.col("id").alias("word"), F.col("phrase").alias("tail"))
        shorter = parts.join(heads, ["lang", "prev"]).join(tails, ["lang", "word"]).select("lang", "id", F.concat_ws(" ", "head", "tail").alias("phrase"), "a")
        found = found.unionByName(shorter.select("lang", F.lit(k).alias("words"), "phrase", "a"))
    return written(found, "phrases"), n


def scored(found: DataFrame, n: DataFrame, *, best: int, covered: tuple[int, int]) -> DataFrame:
    """The best candidates of each language by their weakest cut."""
    big = "decimal(38,0)"
    parts = F.split("phrase", " ")
    several = found.where("words > 1").withColumn("part", parts)
    cuts = several.select("lang", "phrase", "words", "a", "part", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.array_join(F.slice("part", F.lit(1), F.col("k")), " ").alias("first"), F.array_join(F.slice("part", F.col("k") + 1, F.col("words")), " ").alias("rest"))
    lefts = found.select("lang", F.col("phrase").alias("first"), F.col("a").alias("l"))
    rights = found.select("lang", F.col("phrase").alias("rest"), F.col("a").alias("r"))
    cuts = cuts.join(lefts, ["lang", "first"]).join(rights, ["lang", "rest"])
    score = F.expr(f"(cast(a as {big}) * 2000000) div (cast(l as {big}) + cast(r as {big}))")
    weakest = cuts.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    inner = several.where("words > 2").select("lang", "part", "words", "a", F.explode(F.sequence(F.lit(2), F.col("words") - 1)).alias("size"))
    inner = inner.select("lang", "part", "a", "size", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("size") + 1)).alias("at"))
    inner = inner.groupBy("lang", F.array_join(F.slice("part", F.col("at"), F.col("size")), " ").alias("phrase")).agg(F.max("a").alias("longer"))
    left = weakest.join(inner, ["lang", "phrase"], "left")
    left = left.where(F.col("longer").isNull() | (F.col("longer").cast(big) * covered[1] < F.col("a").cast(big) * covered[0]))
    left = left.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score").withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    for keys in (["lang", "part"], ["lang"]):  # a language's phrases never meet whole
        left = left.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= best)
    return left.join(n, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", F.col("n").cast("long").alias("n"), "score")
