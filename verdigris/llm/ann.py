"""Approximate nearest neighbours by a hash-prefix forest.

A row's hash string in a tree is a run of symbols; a symbol is the axis, with its sign, that lies
nearest to the vector after a random projection (a cross-polytope hash). Each tree keeps the strings as
a sorted array. A query descends every tree to the longest prefix it shares with any string and then
ascends all trees at the same time, one bit at a time, until the prefixes take in enough candidates.
Candidates are ranked by their exact cosine in double precision on the original vectors.

Rows lie in blocks, each with its part of the forest, and a stated query set is asked of all blocks. The
ascent is one for the whole table: a first pass gives, for each query, how many strings of all blocks lie
under each prefix length; the length is chosen by their sum; a second pass ranks what lies under it. So
the candidates of a query, ``share * rows ** power`` strings over all trees, grow more slowly than the
rows. Strings are made once for each row, before both passes, and stored beside the vectors, so that a
block sorts numbers and hashes nothing; the first pass moves strings without vectors. Queries come in
chunks of several blocks' size, so that sorting a block's arrays costs little beside asking them; no
task holds more than one block and one chunk.

Of identical vectors (by a 64-bit hash) in a block only the ``k`` + 1 smallest ids are kept, as ties go to smaller ids, so
a vector that a third of all rows share costs a query a few candidates a block. Results are cut to ``k``
a query in each block before they are merged.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components take no
part; rows with a null id neither; vectors of different lengths are not compared; a candidate with
the query's own id is not returned; ties go to the smaller id; repeated rows count once, and an id
that has several vectors once, by its best score; an empty table gives no rows; other columns are not
read, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, written

TREES = 128
#: Bits of a hash string at least; axes that a symbol chooses among.
BITS, AXES = 28, 64
BLOCK_ROWS = 8192
CHUNK_ROWS = 65_536
#: Strings under the prefixes of a query, over all trees: SHARE * rows ** POWER.
SHARE, POWER = 8, 2 / 3
FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def bits_of(length: int, bits: int = BITS) -> int:
    """Bits of a string of vectors of this length: whole symbols, ``bits`` at least."""
    width = (2 * min(length, AXES) - 1).bit_length()
    return width * -(-bits // width)


class Projections:
    """The hash functions of all trees for vectors of one length, the same in every task."""

    def __init__(self, length: int, trees: int, bits: int = BITS):
        axes = min(length, AXES)
        self.width, self.bits = (2 * axes - 1).bit_length(), bits_of(length, bits)
        self.trees, self.symbols = trees, self.bits // self.width
        self.planes = np.random.default_rng(length).standard_normal((trees * self.symbols, length, axes))

    def strings(self, vectors: np.ndarray) -> np.ndarray:
        """One integer for each tree and vector, its first symbol the highest."""
        out = np.zeros((self.trees, len(vectors)), np.int64)
        for k, plane in enumerate(self.planes):
            own = out[k // self.symbols]
            for i in range(0, len(vectors), 4096):
                value = vectors[i : i + 4096] @ plane
                axis = np.abs(value).argmax(axis=1)
                own[i : i + 4096] = own[i : i + 4096] << self.width | axis * 2 + (value[np.arange(len(axis)), axis] > 0)
        return out


class Forest:
    """Sorted hash strings of the rows of one block: an integer of ``bits`` bits for each tree and row."""

    def __init__(self, strings: np.ndarray, bits: int):
        self.trees, self.bits = len(strings), bits
        self.order = np.argsort(strings, axis=1, kind="stable")
        self.sorted = np.take_along_axis(strings, self.order, axis=1)

    def ranges(self, strings: np.ndarray, depth: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
        """For each tree and query, the part of the sorted array under the first ``depth`` bits."""
        below = np.int64(1) << (self.bits - np.broadcast_to(depth, strings.shape[1])).astype(np.int64)
        first = strings // below * below
        low, high = np.empty_like(strings), np.empty_like(strings)
        for t in range(self.trees):
            low[t] = np.searchsorted(self.sorted[t], first[t])
            high[t] = np.searchsorted(self.sorted[t], first[t] + below - 1, side="right")
        return low, high

    def counts(self, strings: np.ndarray, enough: int):
        """(depth, queries, strings under it in all trees), deepest first; a query that has enough is done."""
        open_ = np.arange(strings.shape[1])
        for depth in range(self.bits, -1, -1):
            low, high = self.ranges(strings[:, open_], depth)
            n = (high - low).sum(axis=0)
            yield depth, open_, n
            open_ = open_[n < enough]
            if not len(open_):
                return

    def candidates(self, strings: np.ndarray, depth: np.ndarray):
        """The rows under the first ``depth`` bits of each query in any tree."""
        low, high = self.ranges(strings, depth)
        for q in range(strings.shape[1]):
            there = np.zeros(self.sorted.shape[1], bool)
            for t in range(self.trees):
                there[self.order[t, low[t, q] : high[t, q]]] = True
            yield np.flatnonzero(there)


def list_matrix(column: pa.Array | pa.ChunkedArray, dtype: type) -> np.ndarray:
    """Lists of one length as the rows of a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(dtype, copy=False)


def with_strings(rows: DataFrame, trees: int) -> DataFrame:
    """``rows`` of id, v and asks with two more columns: ``strings``, a row's hash string in each tree, and
    ``kind``, a hash of its vector. Both are made here once for all blocks, chunks and passes."""
    bounded_batches(rows.sparkSession)
    schema = T.StructType([*rows.schema.fields, *T._parse_datatype_string("strings array<int>, kind long").fields])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, Projections] = {}
        for batch in batches:
            lengths = pc.list_value_length(batch.column("v")).to_numpy(zero_copy_only=False)
            for length in map(int, np.unique(lengths)):
                part = batch.filter(pa.array(lengths == length))
                vectors = list_matrix(part.column("v"), np.float64) + 0.0  # 0.0 and -0.0 alike
                if length not in made:
                    made[length] = Projections(length, trees)
                strings = np.ascontiguousarray(made[length].strings(vectors).T).astype(np.int32)
                kind = np.fromiter((xxhash.xxh3_64_intdigest(v.data) for v in vectors), np.uint64, len(vectors)).view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, strings.size + 1, trees, dtype=np.int32)), pa.array(strings.ravel()))
                yield pa.RecordBatch.from_arrays([*part.columns, lists, pa.array(kind)], names=[*part.schema.names, "strings", "kind"])

    return rows.mapInArrow(run, schema)


def without_copies(kind: np.ndarray, most: int) -> np.ndarray:
    """Places of the first ``most`` rows of each kind."""
    order = np.argsort(kind, kind="stable")
    first = np.searchsorted(kind[order], kind[order])
    return np.sort(order[np.arange(len(order)) - first < most])


def nearest(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, candidates: Iterable[np.ndarray], k: int):
    """(query_id, vec_id, cosine) of the best ``k`` candidates of each query in this block."""
    norms = np.sqrt((vectors * vectors).sum(axis=1))
    for query_id, query, found in zip(query_ids, queries, candidates, strict=True):
        found = found[ids[found] != query_id]
        if len(found):
            score = (vectors[found] * query).sum(axis=1) / (norms[found] * math.sqrt((query * query).sum()))
            best = np.lexsort((ids[found], -score))
            best = best[np.sort(np.unique(ids[found][best], return_index=True)[1])[:k]]  # the best row of each id
            yield query_id, ids[found][best], score[best]


def usable(vec: Column) -> Column:
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vec.isNotNull() & (F.size(vec) > 0) & finite & F.exists(vec, lambda x: x != 0)


def search(vectors: DataFrame, is_query: Column, *, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 5, trees: int = TREES, block_rows: int = BLOCK_ROWS, chunk_rows: int = CHUNK_ROWS, share: float = SHARE, power: float = POWER) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found for every row where ``is_query`` holds."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v"), is_query.alias("asks")).where(F.col("id").isNotNull() & usable(F.col("v").cast("array<double>")))
    rows = rows.groupBy("id", "v").agg(F.bool_or("asks").alias("asks"))
    rows = written(with_strings(rows, trees), "ann-rows").withColumn("size", F.size("v"))
    total, asked = rows.agg(F.count("*"), F.count_if("asks")).first()
    blocks, chunks = max(1, math.ceil(total / block_rows)), max(1, math.ceil(asked / chunk_rows))
    # so many strings that some tree holds the query's own row, and k more
    enough = max(math.ceil(share * total**power), trees * (k + 2))
    spread = lambda n: F.pmod(F.xxhash64("id", "kind"), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    keys = ["size", "block", "chunk"]
    queries = rows.where("asks").withColumn("query", F.xxhash64("id", "kind"))

    def held(*columns: str):
        return rows.select("size", "id", "kind", "strings", *columns, spread(blocks).alias("block")).select("*", every(chunks).alias("chunk")).groupBy(*keys)

    def asks(queries: DataFrame, *columns: str):
        return queries.select("size", "strings", *columns, spread(chunks).alias("chunk")).select("*", every(blocks).alias("block")).groupBy(*keys)

    def forest_of(left: pa.Table, size: int) -> tuple[Forest, np.ndarray]:
        """The forest of a block, and the places of its rows in ``left``."""
        ids, kind = left.column("id").to_numpy(), left.column("kind").to_numpy()
        order = np.lexsort((kind, ids))
        kept = order[without_copies(kind[order], k + 1)]
        return Forest(strings_of(left)[:, kept], bits_of(size)), kept

    def strings_of(part: pa.Table) -> np.ndarray:
        return np.ascontiguousarray(list_matrix(part.column("strings"), np.int64).T)

    def count(key, left, right):
        out = [[], [], []]
        if len(left) and len(right):
            names = right.column("query").to_numpy()
            for depth, open_, n in forest_of(left, key[0].as_py())[0].counts(strings_of(right), enough):
                for part, value in zip(out, (names[open_], np.full(len(open_), depth), n), strict=True):
                    part.append(value)
        return pa.table([np.concatenate(x) if x else np.zeros(0, np.int64) for x in out], names=["query", "depth", "n"])

    def match(key, left, right):
        out = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        if len(left) and len(right):
            forest, kept = forest_of(left, key[0].as_py())
            ids, values = left.column("id").to_numpy()[kept], list_matrix(left.column("v"), np.float64)[kept]
            candidates = forest.candidates(strings_of(right), right.column("depth").to_numpy())
            for query_id, found, score in nearest(ids, values, right.column("id").to_numpy(), list_matrix(right.column("v"), np.float64), candidates, k):
                for part, value in zip(out, (np.full(len(found), query_id), found, score), strict=True):
                    part.append(value)
        return pa.table([np.concatenate(x) for x in out], schema=FOUND)

    # a block that had enough at some depth says no more: above that the sum is enough anyway
    counted = held().cogroup(asks(queries, "id", "kind", "query")).applyInArrow(count, "query long, depth long, n long")
    depths = counted.groupBy("query", "depth").agg(F.sum("n").alias("n")).where(F.col("n") >= enough).groupBy("query").agg(F.max("depth").alias("depth"))
    # where all rows are fewer, all are candidates
    deep = written(queries.join(depths, "query", "left").select("size", "id", "kind", "v", "strings", F.coalesce("depth", F.lit(0).cast("long")).alias("depth")), "ann-depths")
    found = held("v").cogroup(asks(deep, "id", "kind", "v", "depth")).applyInArrow(match, "query_id long, vec_id long, score double").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
