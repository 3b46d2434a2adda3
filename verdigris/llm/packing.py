"""Bounded-space online packing of token sequences.

Each partition tokenises its documents (library ids, then an end id) and packs them as they come. A
document is cut into full windows and a rest. The rest goes to the open window that it fills best;
at most ``open_windows`` windows are open. When none has room the fullest is emitted: if at least
``min_cut`` places are free there, the head of the rest fills them first, and what remains opens a
new window. Windows still open at the end of a partition are leftovers. They travel with their ids
and are merged in groups of ``MERGE`` partitions: laid end to end, cut at window borders, and what
is left at the very end is cut at powers of two, which need no padding.

Memory: one slice of text, a cache of at most ``CACHE`` words and ``open_windows`` windows. A merge
group holds at most MERGE x open_windows windows. Sequence ids follow from the partition or group,
so a repeated task gives the same rows. The pieces are written once to the cluster's shared folder.

Words are looked up once per slice: white space never joins two pre-tokens of this tokenizer, so a
text's ids are those of its words in turn.

Defined cases: a null or empty text is the end id alone; a null id column value is kept; repeated
rows are packed one by one; a text of any length is one document, cut as others are; an empty table
gives no rows; other columns are not read, whatever their names.
"""

from __future__ import annotations

import os
import re
import zlib
from bisect import bisect_left, insort
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, encode_words, ragged, split_words, starts_of, text_slices, written

CACHE = 250_000
MERGE = 8
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"
ARROW = pa.schema([*((n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")), ("ids", pa.binary())])
#: Letters that lower-casing and NFC leave letters, perhaps with signs behind them: two pre-tokens
#: at most, whatever stands around them. The apostrophe is left out: contractions are cut otherwise.
LETTERS, SIGNS = "A-Za-zÀ-ÖØ-öø-įı-ɏ", "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
SIMPLE = f"^[{LETTERS}]+[{re.escape(SIGNS)}]*$"
#: Lower-case letters for which the tokenizer's normaliser and pre-tokenizer leave one word as it is.
PLAIN = re.compile("[a-zß-öø-įı-ɏ]+")


def byte_letters(first: int, last: int) -> dict[int, str]:
    """For each character its UTF-8 bytes as the letters that a byte-level vocabulary spells them with."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    letter = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}
    return {c: "".join(letter[b] for b in chr(c).encode()) for c in range(first, last + 1)}


_LETTERS = byte_letters(0xC0, 0x24F)
_encoders: dict[str, "Encoder"] = {}


class Encoder:
    """Ids of words, remembered between slices."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.clear()

    @classmethod
    def of(cls, path: str) -> "Encoder":
        if path not in _encoders:
            _encoders[path] = cls(path)
        return _encoders[path]

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.begin, self.size = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def learn(self, words: list[str]) -> None:
        ids, sizes = [self.flat], [self.size]
        # plain words are one pre-token each and go to the library's model directly
        plain = [PLAIN.fullmatch(w) is not None for w in words]
        tokenize = self.model.model.tokenize
        for i in range(0, len(words), 5000):
            part, own = words[i : i + 5000], plain[i : i + 5000]
            spelt = [[t.id for t in tokenize(w if w.isascii() else w.translate(_LETTERS))] if p else None for w, p in zip(part, own, strict=True)]
            if rest := [w for w, p in zip(part, own, strict=True) if not p]:
                got = self.model.encode(rest, is_pretokenized=True, add_special_tokens=False)
                cut = starts_of(np.bincount(np.array(got.word_ids, np.int64), minlength=len(rest))).tolist()
                listed = got.ids
                others = iter([listed[a:b] for a, b in pairwise(cut)])
                spelt = [next(others) if x is None else x for x in spelt]
            ids.append(np.fromiter(chain.from_iterable(spelt), np.uint32))
            sizes.append(np.fromiter(map(len, spelt), np.int64, len(part)))
        self.known.update(zip(words, range(len(self.known), len(self.known) + len(words)), strict=True))
        self.flat, self.size = np.concatenate(ids), np.concatenate(sizes)
        self.begin = starts_of(self.size)[:-1]

    def find(self, words: list[str]) -> np.ndarray:
        """Place of each distinct word in the cache."""
        if len(self.known) + len(words) > CACHE:
            self.clear()
        if new := [w for w in words if w not in self.known]:
            self.learn(new)
        return np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts on end, and how many each text has."""
        words, per_text = split_words(texts)
        index, distinct = encode_words(words)
        simple = pc.match_substring_regex(distinct, SIMPLE)
        # every word is a head and, where it is simple, the signs behind it: two runs of ids
        head = pc.if_else(simple, pc.utf8_lower(pc.utf8_rtrim(distinct, SIGNS)), distinct)
        tail = pc.if_else(simple, pc.replace_substring_regex(distinct, f"^[{LETTERS}]+", ""), "")
        coded = pa.concat_arrays([head, tail]).dictionary_encode()
        at = self.find(coded.dictionary.to_pylist())[coded.indices.to_numpy(zero_copy_only=False)].reshape(2, -1).T
        runs_at, runs_n = self.begin[at], self.size[at]
        lengths = runs_n.sum(1)
        words_of = np.repeat(np.arange(len(texts)), per_text)
        counts = np.bincount(words_of, weights=lengths[index], minlength=len(texts)).astype(np.int64)
        ids = self.flat[ragged(runs_at[index].ravel(), runs_n[index].ravel())]
        return ids, counts


class Packer:
    """The open windows of one partition; finished pieces gather in ``rows``."""

    def __init__(self, first_id: int, window: int, open_windows: int, min_cut: int):
        self.next_id, self.window, self.limit, self.min_cut = first_id, window, open_windows, min_cut
        self.free: list[tuple[int, int]] = []  # (free places, sequence), sorted
        self.held: dict[int, list[tuple]] = {}
        self.rows: list[tuple] = []

    def add(self, doc_id, ids: np.ndarray) -> None:
        total, at = len(ids), 0
        while total - at >= self.window:
            self.rows.append(self.piece(doc_id, at, ids[at : at + self.window], total, self.next_id, 0, False))
            self.next_id, at = self.next_id + 1, at + self.window
        if at == total:
            return
        k = bisect_left(self.free, (total - at, -1))
        if k == len(self.free) and len(self.free) >= self.limit:
            free, sequence = self.free[0]
            if free >= self.min_cut:
                self.put(0, doc_id, at, ids[at : at + free], total)
                at += free
            else:
                self.free.pop(0)
                self.emit(sequence)
            k = len(self.free)
        if k == len(self.free):
            self.free.append((self.window, self.next_id))
            self.held[self.next_id] = []
            self.next_id += 1
        self.put(k, doc_id, at, ids[at:], total)

    def put(self, k: int, doc_id, start: int, ids: np.ndarray, total: int) -> None:
        free, sequence = self.free.pop(k)
        self.held[sequence].append((doc_id, start, ids, total))
        if free > len(ids):
            insort(self.free, (free - len(ids), sequence))
        else:
            self.emit(sequence)

    def emit(self, sequence: int, left: bool = False) -> None:
        offset = 0
        for doc_id, start, ids, total in self.held.pop(sequence):
            self.rows.append(self.piece(doc_id, start, ids, total, sequence, offset, left))
            offset += len(ids)

    def leftovers(self) -> None:
        for sequence in sorted(self.held):
            self.emit(sequence, left=True)
        self.free = []

    def piece(self, doc_id, start: int, ids: np.ndarray, total: int, sequence: int, offset: int, left: bool) -> tuple:
        raw = np.ascontiguousarray(ids, "<u4").tobytes()
        return doc_id, start, len(ids), zlib.crc32(raw), total, sequence, offset, raw if left else None

    def batch(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), ARROW, strict=True)], schema=ARROW)


def cuts(total: int, window: int) -> list[int]:
    """Lengths of the sequences that ``total`` ids on end become: full windows, then powers of two."""
    out = [window] * (total // window)
    rest = total % window
    return out + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def merge(rows, window: int, first_id: int):
    """Leftover pieces on end, cut anew; ``rows`` is a frame of SCHEMA."""
    import pandas as pd

    rows = rows.sort_values(["sequence_id", "offset"], kind="stable")
    ends = np.cumsum(cuts(int(rows["length"].sum()), window))
    out, at, k = [], 0, 0
    for doc, start, total, raw in zip(rows["doc_id"], rows["start"], rows["doc_tokens"], rows["ids"], strict=True):
        ids, used = np.frombuffer(raw, "<u4"), 0
        while used < len(ids):
            take = int(min(len(ids) - used, ends[k] - at))
            part = ids[used : used + take]
            out.append((doc, start + used, take, zlib.crc32(part.tobytes()), total, first_id + k, at - (int(ends[k - 1]) if k else 0)))
            used, at = used + take, at + take
            k += at == ends[k]
    frame = pd.DataFrame(out, columns=ARROW.names[:-1])
    return frame.astype({c: "Int64" for c in frame.columns})


def pack(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, window: int = 4096, open_windows: int = 32, min_cut: int = 32) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""

    def run(batches):
        encoder = Encoder.of(tokenizer_path)
        packer = Packer(TaskContext.get().partitionId() << 32, window, open_windows, min_cut)
        for part in text_slices(batches, "text"):
            ids, counts = encoder.encode(pc.fill_null(part.column("text"), ""))
            at = starts_of(counts)
            for i, doc_id in enumerate(part.column("doc_id").to_pylist()):
                packer.add(doc_id, np.append(ids[at[i] : at[i + 1]], np.uint32(end_id)))
            if packer.rows:
                yield packer.batch()
        packer.leftovers()
        if packer.rows:
            yield packer.batch()

    bounded_batches(docs.sparkSession)
    pieces = written(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, SCHEMA), "packing")
    partition = F.shiftright("sequence_id", 32)

    def merged(key, rows):
        return merge(rows, window, (1 << 62) | (int(key[0]) << 32))

    full = pieces.where("ids is null").drop("ids")
    rest = pieces.where("ids is not null").groupBy(F.floor(partition / MERGE).alias("part")).applyInPandas(merged, full.schema)
    return full.unionByName(rest)
