"""Benchmark decontamination with one Aho-Corasick automaton over normalised items.

Items and documents are lower-cased (A-Z only) and cut into words of ASCII letters, digits and
non-ASCII characters. A window is ``width`` consecutive item words (an item of fewer words, but not
none, is one window). All windows form one automaton over the items' words; a word that no item has is
a sign that no window holds. Each document is normalised once, byte for byte, so that a place in the
normalised text maps back to a place in the original, and is scanned once. Nothing is shuffled.

The automaton is broadcast, so its size is checked: items are taken in blocks of at most
``block_bytes`` of text. Benchmarks up to that are one block; a larger one is scanned block after block,
each pass adding its hits to those found before and writing them to the shared folder, so that a
worker never holds two automata. A worker keeps its automaton from task to task.

Defined cases: a null or wordless text has no hits; items without id or words are ignored; rows of
one item id count as one item; an empty benchmark leaves every document clean; an empty table gives no
rows; repeated document rows are judged one by one, texts of any length whole; a column named like the
result is replaced, other columns pass whatever their names.
"""

from __future__ import annotations

import math
import re
import uuid

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import add_struct, free_name, quoted, written

#: Item text of one automaton; about 140 bytes of automaton for each byte of text.
BLOCK_BYTES = 1 << 20

_KEEP = set(range(0x30, 0x3A)) | set(range(0x61, 0x7B)) | set(range(0x80, 0x100))
#: One byte for one byte: A-Z lower-cased, separators to blanks, all else unchanged.
FOLD = bytes((b + 32 if 0x41 <= b <= 0x5A else b if b in _KEEP else 0x20) for b in range(256))
WORD = re.compile(rb"[^ ]+")

FIELDS = "n_words bigint, hit array<int>, items array<string>"


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(FOLD).split()


class Windows:
    """The automaton over all windows, as sequences of word numbers; 0 is a word that no item has."""

    def __init__(self, items: list[tuple[str, str]], width: int):
        self.number: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            words = [self.number.setdefault(w, len(self.number) + 1) for w in words_of(text)]
            for i in range(max(1, len(words) - width + 1) if words else 0):
                owners.setdefault(tuple(words[i : i + width]), set()).add(item)
        self.machine = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE) if owners else None
        for window, ids in owners.items():
            self.machine.add_word(window, (len(window), sorted(ids)))
        if owners:
            self.machine.make_automaton()

    def scan(self, text: str) -> tuple[int, np.ndarray, set[str]]:
        """Number of words, sorted positions of the words that are hit, ids of the items found."""
        words = words_of(text)
        hits = list(self.machine.iter(tuple(self.number.get(w, 0) for w in words))) if self.machine and words else []
        if not hits:
            return len(words), np.zeros(0, np.int32), set()
        covered, items = np.zeros(len(words) + 1, np.int32), set()
        for last, (n, ids) in hits:
            covered[last - n + 1] += 1
            covered[last + 1] -= 1
            items.update(ids)
        return len(words), np.flatnonzero(np.cumsum(covered[:-1])).astype(np.int32), items


_built: dict[str, Windows] = {}


def built(token: str, items: list[tuple[str, str]], width: int) -> Windows:
    """The automaton of a block, built once in a worker, which holds the latest one."""
    if token not in _built:
        _built.clear()
        _built[token] = Windows(items, width)
    return _built[token]


def char_spans(text: str, hit: list[int]) -> list[tuple[int, int]]:
    """Places (start, end) in the original text of each run of hit words, in characters."""
    if not len(hit):
        return []
    raw = text.encode()
    at = [m.span() for m in WORD.finditer(raw.translate(FOLD))]
    runs = np.split(p := np.asarray(hit), np.flatnonzero(np.diff(p) > 1) + 1)
    place = lambda b: len(raw[:b].decode(errors="ignore"))
    return [(place(at[r[0]][0]), place(at[r[-1]][1])) for r in runs]


def scan(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", width: int = 10, into: str = "scan", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with a struct ``into``: n_words, hit (word positions), items (sorted ids found)."""
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).alias("words")).where("item is not null and words is not null")
    size = items.agg(F.sum(F.octet_length("words"))).first()[0] or 0
    blocks = max(1, math.ceil(size / block_bytes))
    out = docs
    for k in range(blocks):
        own = items.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == k)
        sent = spark.sparkContext.broadcast([tuple(r) for r in own.collect()])  # about block_bytes
        out = _scan_block(out, sent, text_col, width, into, k)
        if k < blocks - 1:  # one automaton at a time: each pass is a job of its own
            out = written(out, "scan")
    return out


def _scan_block(docs: DataFrame, sent, text_col: str, width: int, into: str, k: int) -> DataFrame:
    step, token = free_name(docs.columns, f"{into}_{k}") if k else into, uuid.uuid4().hex

    def factory():
        windows = built(token, sent.value, width)

        def apply(texts: pa.Array) -> pa.Array:
            n, hit, items = [], [], []
            for text in texts.to_pylist():
                count, covered, found = windows.scan(text)
                n.append(count)
                hit.append(covered)
                items.append(sorted(found))
            return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(hit, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))], names=["n_words", "hit", "items"])

        return apply

    out = add_struct(docs, text_col, step, FIELDS, factory)
    if not k:
        return out
    both = F.struct(F.col(f"{into}.n_words").alias("n_words"), F.array_sort(F.array_union(f"{into}.hit", f"{step}.hit")).alias("hit"), F.array_sort(F.array_union(f"{into}.items", f"{step}.items")).alias("items"))
    return out.withColumn(into, both).drop(step)


def clean(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """The rows of ``docs``, unchanged, in whose text no benchmark window occurs."""
    into = free_name(docs.columns, "scan")
    found = scan(docs, benchmark, into=into, **how)
    return found.where(F.size(f"{into}.items") == 0).select(*map(quoted, docs.columns))
