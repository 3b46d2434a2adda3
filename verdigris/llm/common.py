"""Arrow helpers shared by the text operators: bounded slices, words, word hashes, shared folders."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that one numpy step works on; longer single texts form a slice of their own.
SLICE_BYTES = 4 << 20
#: Bytes of an Arrow batch between Spark and a worker, and the setting that bounds it.
BATCH_BYTES, BATCH_CONF = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


def text_slices(batches: Iterable[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches again, cut so that no slice of several rows holds more than ``limit`` bytes of text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            base = size[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(size, base + limit, side="right")))
            yield batch.slice(start, end - start)
            start = end


def without(docs: DataFrame, name: str, *kept: str) -> DataFrame:
    """``docs`` without a column of this name, case aside; ``kept`` columns may not have it."""
    if name.lower() in {k.lower() for k in kept}:
        raise ValueError(f"{name!r} is a column that is read")
    return docs.select(*[quoted(c) for c in docs.columns if c.lower() != name.lower()])


def quoted(name: str) -> str:
    """A column name as Spark's expressions take it, whatever signs it holds."""
    return "`" + name.replace("`", "``") + "`"


def free_name(columns: list[str], base: str) -> str:
    """``base``, with underscores behind it until no column has that name, case aside."""
    taken = {c.lower() for c in columns}
    while base.lower() in taken:
        base += "_"
    return base


def bounded_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batches to BATCH_BYTES, where they may be larger; the setting stays.

    Spark's default of 64 MB would be held by every task twice, in the executor's buffers and in the
    worker.
    """
    found = re.fullmatch(r"(\d+)([bkmg]?)b?", spark.conf.get(BATCH_CONF, "1g").lower())
    if not found or not 0 < int(found[1]) << {"k": 10, "m": 20, "g": 30}.get(found[2], 0) <= BATCH_BYTES:
        spark.conf.set(BATCH_CONF, f"{BATCH_BYTES}b")


def add_struct(docs: DataFrame, text_col: str, into: str, fields: str, factory: Callable[[], Callable]) -> DataFrame:
    """``docs`` with one more struct column ``into`` (of DDL ``fields``) computed from ``text_col``.

    ``factory()`` runs once a task and returns a function from a string array to a struct array.
    The new column is one struct, so the caller's other columns may have any names. A column that
    is named ``into`` already (case aside) is replaced.
    """
    docs = without(docs, into, text_col)
    bounded_batches(docs.sparkSession)
    schema = T.StructType([*docs.schema.fields, T.StructField(into, T._parse_datatype_string(f"struct<{fields}>"))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apply = factory()
        for part in text_slices(batches, text_col):
            value = apply(pc.fill_null(part.column(text_col), ""))
            yield pa.RecordBatch.from_arrays([*part.columns, value], names=[*part.schema.names, into])
        pa.default_memory_pool().release_unused()

    return docs.mapInArrow(run, schema)


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of every text, in order, and the number of words of each text."""
    lists = pc.ascii_split_whitespace(texts)
    words, parents = pc.list_flatten(lists), pc.list_parent_indices(lists)
    full = pc.not_equal(words, "")
    if not pc.all(full, min_count=0).as_py():
        words, parents = words.filter(full), parents.filter(full)
    return words, np.bincount(parents.to_numpy(zero_copy_only=False), minlength=len(texts)).astype(np.int64)


def encode_words(words: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Index of each word in the array of distinct words, and that array."""
    coded = words.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary


def hash_strings(values: pa.Array) -> np.ndarray:
    """A 64-bit hash of each string."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, values.cast(pa.binary()).to_pylist()), np.uint64, len(values))


def word_hashes(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word; each distinct word is hashed once."""
    index, distinct = encode_words(words)
    return hash_strings(distinct)[index] if len(words) else np.zeros(0, np.uint64)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit over the whole word."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def rolling(h: np.ndarray, width: int) -> np.ndarray:
    """Hash of every ``width`` consecutive word hashes: entry i covers words i to i + width - 1."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    acc = h[:n].copy()
    for i in range(1, width):
        acc *= np.uint64(0x9E3779B97F4A7C15)
        acc += h[i : i + n]
    return mix64(acc)


def starts_of(counts: np.ndarray) -> np.ndarray:
    """Offsets 0, c0, c0 + c1, ... of runs with these lengths."""
    out = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts, out=out[1:])
    return out


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices start, ..., start + length - 1 of every run, one run after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


def shared_folder(spark: SparkSession, what: str) -> str:
    """A new folder name below the cluster's shared folder (``spark.checkpoint.dir``)."""
    base = checkpoint_dir(spark)
    return f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder, set on the context where it was not.

    Only on one machine, as in tests, a folder below the warehouse stands in for a missing setting; a
    cluster without it is an error, as executors would write to their own disks.
    """
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir names no folder that all executors share")
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(base)
    return base


def written(df: DataFrame, what: str) -> DataFrame:
    """``df`` written once as Parquet into the shared folder and read again: cuts lineage durably."""
    path = shared_folder(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(frame: DataFrame) -> None:
    """Deletes the folder that ``written`` made for this frame, once nothing reads it any more."""
    files = frame.inputFiles()
    if files:
        path = frame.sparkSession._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        path.getFileSystem(frame.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def crc_fold(doc_id) -> F.Column:
    """crc32 of the id as text, modulo 5; 0 is the held-out fold."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
