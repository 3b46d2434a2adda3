"""Slices of documents and their distinct words, as packed columns: what word-wise operators send around.

A slice is a run of rows of one task, cut by bytes of text. Its number is made of the task's partition
and a count, so two passes over the same files number alike; a checksum of the slice travels with every
row, and rows of one number whose checksums differ stop the query instead of giving mixed results.

Words of a slice are dealt to buckets by hash. A bucket's rows hold all places of a word at once, so a
word reaches its bucket at most once a slice, however often it occurs.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import quoted, starts_of, text_slices

#: Bytes of text of a slice, and of the corpus for each bucket of words.
SLICE_TEXT, BUCKET_TEXT = 8 << 20, 1 << 20


def buckets(docs: DataFrame, text_col: str, bucket_bytes: int = BUCKET_TEXT) -> int:
    """So many buckets that each gets the words of ``bucket_bytes`` of text on average; one pass counts."""
    total = docs.agg(F.sum(F.octet_length(quoted(text_col)))).first()[0] or 0
    return max(1, -(-total // bucket_bytes))


def slices(batches: Iterable[pa.RecordBatch], text_col: str, limit: int = SLICE_TEXT) -> Iterator[tuple[int, list[pa.RecordBatch]]]:
    """Numbered slices, each a list of parts that one numpy step can take."""
    from pyspark import TaskContext

    number, held, size = TaskContext.get().partitionId() << 32, [], 0
    for part in text_slices(batches, text_col):
        held.append(part)
        size += pc.sum(pc.binary_length(part.column(text_col))).as_py() or 0
        if size >= limit:
            yield number, held
            number, held, size = number + 1, [], 0
    if held:
        yield number, held


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts (none null) and where each text begins in them, the end last."""
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if not len(texts) or texts.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def strings(data: np.ndarray, starts: np.ndarray) -> pa.Array:
    """Consecutive byte strings of ``data``; ``starts`` ends with the last one's end."""
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts) - 1, [None, pa.py_buffer(starts.astype(np.int64)), pa.py_buffer(data)])


def pack(values: np.ndarray) -> bytes:
    """Whole numbers from 0 as byte planes, compressed."""
    if not len(values):
        return b""
    width = max(1, (int(values.max()).bit_length() + 7) // 8)
    planes = values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T
    return bytes([width]) + zstandard.compress(planes.tobytes())


def unpack(blob: bytes) -> np.ndarray:
    if not blob:
        return np.zeros(0, np.int64)
    planes = np.frombuffer(zstandard.decompress(memoryview(blob)[1:]), np.uint8).reshape(blob[0], -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, : len(planes)] = planes.T
    return out.view("<i8").ravel()


def pack_strings(values: pa.Array) -> bytes:
    data, starts = utf8(values)
    sizes = pack(np.diff(starts))
    return len(sizes).to_bytes(4, "little") + sizes + zstandard.compress(data.tobytes())


def unpack_strings(blob: bytes) -> pa.Array:
    at = 4 + int.from_bytes(blob[:4], "little")
    data = zstandard.decompress(memoryview(blob)[at:])
    return strings(np.frombuffer(data, np.uint8), starts_of(unpack(blob[4:at])))


class Words:
    """Distinct words of a slice in the order of their buckets, and the words of its texts as numbers."""

    def __init__(self, parts: list[pa.Array], count: int, salt: bytes = b""):
        coded = [p.dictionary_encode() for p in parts if len(p)]
        every = pa.concat_arrays([c.dictionary for c in coded]).dictionary_encode() if coded else None
        distinct = every.dictionary if coded else pa.array([], pa.large_binary())
        hashes = np.fromiter((xxhash.xxh3_64_intdigest(salt + w) for w in distinct.to_pylist()), np.uint64, len(distinct))
        bucket = (hashes % np.uint64(count)).astype(np.int64)
        order = np.lexsort((hashes, bucket))
        self.distinct, self.bucket = distinct.take(pa.array(order)), bucket[order]
        rank, number, at = np.empty(len(order), np.int64), [], 0
        rank[order] = np.arange(len(order))
        codes = every.indices.to_numpy(zero_copy_only=False) if coded else np.zeros(0, np.int64)
        for c in coded:
            number.append(rank[codes[at : at + len(c.dictionary)]][c.indices.to_numpy(zero_copy_only=False)])
            at += len(c.dictionary)
        self.number = np.concatenate(number) if number else np.zeros(0, np.int64)
        self.check = int(np.bitwise_xor.reduce(hashes, initial=np.uint64(len(hashes)))) >> 1

    def runs(self) -> Iterator[tuple[int, int, int]]:
        """(bucket, first word, word after the last) of each bucket that has words."""
        edges = np.flatnonzero(np.diff(self.bucket, prepend=-1, append=-1)) if len(self.bucket) else []
        for start, end in zip(edges[:-1], edges[1:]):
            yield int(self.bucket[start]), int(start), int(end)


def same(*columns: pa.ChunkedArray) -> None:
    """All checksums of a slice agree, or the two passes saw different rows."""
    if len({v for c in columns for v in c.to_pylist()}) > 1:
        raise RuntimeError("two passes over the documents saw different rows: pass a written table")
