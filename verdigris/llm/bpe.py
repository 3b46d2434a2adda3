"""Byte-level BPE by a global shuffle of distinct words, and decoding by a join with the token bytes.

Pre-tokens are exploded with their places, but travel pre-aggregated: each slice of documents sends each
distinct pre-token once, in packed rows of a bucket of words, and its places apart from them as one
sequence of numbers. In a bucket all slices' rows of a word meet, and it is encoded once. Its ids are
joined back by slice and number, and each text is put together by position.

Decoding joins every id of a row with the token-byte table by id and concatenates by position. That table
is the vocabulary file, which bounds it, so each worker holds it as two arrays.

Texts are cut into pre-tokens by array steps over the code points' classes. The classes are asked of the
tokenizer library's own pattern engine, once a worker. A pre-token's merges are the library's.

The documents are read twice (words, places), so ``docs`` must give the same rows in the same order each
time, as scans of files do; checksums stop the query otherwise. A task holds one slice, or one bucket.

Defined cases: null and empty texts have no ids; texts and pre-tokens may have any length; repeated rows
are encoded one by one; an empty table gives no rows; the ranks have no ties. A column named like the
result is replaced, others pass whatever their names.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import bounded_batches, free_name, quoted, ragged, starts_of, without
from .slices import SLICE_TEXT, Words, buckets, pack, pack_strings, same, slices, strings, unpack, unpack_strings, utf8

LETTER, NUMBER, SPACE = 1, 2, 3
BLANK, QUOTE = 0x20, 0x27
#: Letters that an apostrophe takes with it.
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")
#: The pattern whose matches ``pre_tokens`` finds.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_kept: dict = {}


def ranks(path: str) -> dict[bytes, int]:
    """Token bytes and their ids."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def encoder(path: str):
    """The library's merges for one pre-token; built once a worker."""
    import tiktoken

    if ("encoder", path) not in _kept:
        _kept["encoder", path] = tiktoken.Encoding("own", pat_str=r"[\s\S]+", mergeable_ranks=ranks(path), special_tokens={})
    return _kept["encoder", path]


def token_bytes(path: str) -> tuple[np.ndarray, np.ndarray]:
    """The token-byte table by id: all bytes, and where each id's begin."""
    if ("bytes", path) not in _kept:
        table = ranks(path)
        known = {i: token for token, i in table.items()}
        tokens = [known.get(i, b"") for i in range(max(known) + 1)]
        _kept["bytes", path] = np.frombuffer(b"".join(tokens), np.uint8), starts_of(np.fromiter(map(len, tokens), np.int64, len(tokens)))
    return _kept["bytes", path]


def classes() -> np.ndarray:
    """Letter, number, white space or other, by code point, as the library's patterns see them."""
    if "classes" not in _kept:
        import tiktoken

        found = np.zeros(0x110000, np.uint8)
        every = "".join(chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000)
        for code, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
            one = tiktoken.Encoding("class", pat_str=pattern, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
            found[np.frombuffer(one.decode(one.encode_ordinary(every)).encode("utf-32-le"), np.uint32)] = code
        _kept["classes"] = found
    return _kept["classes"]


def pre_tokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All matches of PATTERN in all texts, in order, and the number of each text's."""
    data, offsets = utf8(texts)
    if not len(data):
        return pa.array([], pa.large_binary()), np.zeros(len(texts), np.int64)
    char = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    where = np.flatnonzero((data & 0xC0) != 0x80)
    kind = classes()[char]
    first = np.zeros(len(char), bool)
    bounds = np.searchsorted(where, offsets)
    first[bounds[:-1][np.diff(offsets) > 0]] = True
    start = first.copy()
    start[1:] |= kind[1:] != kind[:-1]
    # white space before a word: its last sign stands alone, or a blank goes with the word
    word = np.flatnonzero(start & (kind != SPACE) & ~first)
    word = word[kind[word - 1] == SPACE]
    ends = start.copy()
    start[word - 1] = True
    start[word[char[word - 1] == BLANK]] = False
    # a lone apostrophe takes its ending from the letters behind it
    quote = np.flatnonzero((char[:-1] == QUOTE) & start[:-1] & ends[1:] & ~first[1:] & (kind[1:] == LETTER))
    quote = quote[ends[quote]]
    for ending in ENDINGS:
        codes = np.frombuffer(ending.encode("utf-32-le"), np.uint32)
        at = quote[quote + len(codes) < len(char)]
        fits = np.ones(len(at), bool)
        for k, c in enumerate(codes.tolist(), 1):
            fits &= (char[at + k] == c) & ~first[at + k]
        at = at[fits]
        start[at + 1] = False
        after = at + 1 + len(codes)
        start[after[after < len(char)]] = True
    begins = np.flatnonzero(start)
    counts = np.diff(np.searchsorted(begins, bounds))
    return strings(data, np.append(where[begins], len(data))), counts


def cut(texts: pa.Array, limit: int) -> tuple[pa.Array, np.ndarray]:
    """Pieces of the texts of about ``limit`` bytes, cut only before white space that follows a word, where
    every pre-token ends; and the number of each text's pieces."""
    sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False)
    if not len(texts) or sizes.max() <= limit:
        return texts, np.ones(len(texts), np.int64)
    out, counts = [], np.ones(len(texts), np.int64)
    for i, text in enumerate(texts.to_pylist()):
        at, pieces = 0, []
        while len(text) - at > limit:
            end = at + limit
            while end < len(text) and not (text[end].isspace() and ord(text[end]) < 128 and not text[end - 1].isspace() and classes()[ord(text[end - 1])] != SPACE and ord(text[end]) in (9, 10, 13, 32)):
                end += 1
            pieces.append(text[at:end])
            at = end
        pieces.append(text[at:])
        counts[i] = len(pieces)
        out += pieces
    return pa.array(out, pa.large_string()), counts


def _split(parts: list[pa.RecordBatch], text_col: str) -> tuple[list[pa.Array], np.ndarray]:
    """Pre-tokens of a slice's parts, and how many each row has."""
    words, counts = [], []
    for part in parts:
        texts, pieces = cut(pc.fill_null(part.column(text_col), ""), SLICE_TEXT)
        of = np.repeat(np.arange(part.num_rows), pieces)
        total = np.zeros(part.num_rows, np.int64)
        for at in range(0, len(texts), 1 if len(texts) > part.num_rows else max(1, len(texts))):
            step = texts.slice(at, 1 if len(texts) > part.num_rows else len(texts))
            found, n = pre_tokens(step)
            words.append(found)
            np.add.at(total, of[at : at + len(step)], n)
        counts.append(total)
    return words, np.concatenate(counts)


def encode(docs: DataFrame, path: str, pattern: str = PATTERN, *, text_col: str = "text", into: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """The ``keep`` columns of ``docs`` (all but the text, unless given) with the text's ids in ``into``."""
    if pattern != PATTERN:
        raise ValueError("the array steps know one pattern only")
    keep = [c for c in (docs.columns if keep is None else keep) if c not in (text_col, into)]
    bounded_batches(docs.sparkSession)
    text = free_name(keep, "text")
    rows = docs.select(*map(quoted, keep), quoted(text_col)).toDF(*keep, text)
    count = buckets(rows, text)

    def words(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, parts in slices(batches, text):
            found = Words(_split(parts, text)[0], count)
            out = [(b, pack_strings(found.distinct.slice(s, e - s))) for b, s, e in found.runs()]
            yield pa.RecordBatch.from_pydict({"slice": pa.array([number] * len(out), pa.int64()), "mark": pa.array([found.check] * len(out), pa.int64()), "bucket": pa.array([b for b, _ in out], pa.int64()), "words": pa.array([w for _, w in out], pa.binary())})

    def places(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, parts in slices(batches, text):
            listed, counts = _split(parts, text)
            found = Words(listed, count)
            del listed
            often = np.argsort(-np.bincount(found.number, minlength=len(found.distinct)), kind="stable")
            rank = np.empty(len(often), np.int64)
            rank[often] = np.arange(len(often))
            sink = pa.BufferOutputStream()
            kept = pa.Table.from_batches(parts).select(keep).combine_chunks()
            with pa.ipc.new_stream(sink, kept.schema) as writer:
                writer.write_table(kept)
            yield pa.RecordBatch.from_pydict({"slice": pa.array([number], pa.int64()), "mark": pa.array([found.check], pa.int64()), "often": [pack(often)], "places": [pack(rank[found.number])], "counts": [pack(counts)], "kept": pa.array([sink.getvalue().to_pybytes()], pa.binary())})

    def encoded(bucket: pa.Table) -> pa.Table:
        lists = [unpack_strings(w) for w in bucket.column("words").to_pylist()]
        every = pa.concat_arrays(lists).dictionary_encode()
        code = encoder(path)
        ids = [code.encode_ordinary(w.decode()) for w in every.dictionary.to_pylist()]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        flat, starts = np.fromiter((i for one in ids for i in one), np.int64, int(sizes.sum())), starts_of(sizes)[:-1]
        index, at, out = every.indices.to_numpy(zero_copy_only=False), 0, []
        for one in lists:
            mine = index[at : at + len(one)]
            at += len(one)
            out.append((pack(sizes[mine]), pack(flat[ragged(starts[mine], sizes[mine])])))
        return pa.table({"slice": bucket.column("slice"), "mark": bucket.column("mark"), "bucket": bucket.column("bucket"), "sizes": pa.array([s for s, _ in out], pa.binary()), "flat": pa.array([f for _, f in out], pa.binary())})

    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField(into, T.ArrayType(T.IntegerType()))])

    def together(words: pa.Table, rows: pa.Table) -> pa.Table:
        same(words.column("mark"), rows.column("mark"))
        words = words.sort_by("bucket")
        row = rows.to_pylist()[0]
        every = np.concatenate([np.zeros(0, np.int64), *map(unpack, words.column("sizes").to_pylist())])
        flat = np.concatenate([np.zeros(0, np.int32), *(unpack(f).astype(np.int32) for f in words.column("flat").to_pylist())])
        often = unpack(row["often"])
        sizes, starts = every[often], starts_of(every)[:-1][often]
        places, counts = unpack(row["places"]), unpack(row["counts"])
        ends = starts_of(sizes[places])
        ids = flat[ragged(starts[places], sizes[places])]
        kept = pa.ipc.open_stream(row["kept"]).read_all()
        lists = pa.ListArray.from_arrays(pa.array(ends[starts_of(counts)].astype(np.int32)), pa.array(ids))
        pa.default_memory_pool().release_unused()
        return pa.table([*kept.columns, lists], names=[*keep, into])

    word_rows = rows.mapInArrow(words, "slice bigint, mark bigint, bucket bigint, words binary")
    coded = word_rows.groupBy("bucket").applyInArrow(encoded, "slice bigint, mark bigint, bucket bigint, sizes binary, flat binary")
    place_rows = rows.mapInArrow(places, "slice bigint, mark bigint, often binary, places binary, counts binary, kept binary")
    return coded.groupBy("slice").cogroup(place_rows.groupBy("slice")).applyInArrow(together, schema)


def decode(rows: DataFrame, path: str, *, ids_col: str = "ids", into: str = "decoded") -> DataFrame:
    """``rows`` with the bytes of their ids in ``into``; null ids give null, ids that the table lacks raise
    ValueError."""
    rows = without(rows, into, ids_col)
    bounded_batches(rows.sparkSession)
    schema = T.StructType([*rows.schema.fields, T.StructField(into, T.BinaryType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data, starts = token_bytes(path)
        sizes = np.diff(starts)
        for batch in batches:
            lists = batch.column(ids_col)
            ids = lists.flatten().to_numpy(zero_copy_only=False)
            if len(ids) and (ids.min() < 0 or ids.max() >= len(sizes) or not sizes[ids].all()):
                raise ValueError("an id is not in the token-byte table")
            ends = starts_of(sizes[ids])
            counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            found = strings(data[ragged(starts[:-1][ids], sizes[ids])], ends[starts_of(counts)]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, pc.if_else(lists.is_valid(), found, None)], names=[*batch.schema.names, into])

    return rows.mapInArrow(run, schema)
