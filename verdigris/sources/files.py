"""File sources: raw documents, JSON artifacts and line ledgers, with what cannot be read counted."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator
from urllib.parse import quote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import provenance, sanitized_error, text_hash, text_status


#: Bytes that a task holds of a file at once.
CHUNK_BYTES = 1 << 20


def _opened(uri: str):
    """File system and path of what Spark names; names come with any sign, not as escaped URIs."""
    from pyarrow import fs

    if uri.startswith(("file:", "/")):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    scheme, rest = uri.split("://", 1)
    return fs.FileSystem.from_uri(f"{scheme}://{quote(rest)}")


def read_in_chunks(uri: str, chunk_bytes: int) -> Iterator[bytes]:
    """The content of a file, a chunk at a time."""
    system, path = _opened(uri)
    with system.open_input_stream(path) as stream:
        while chunk := stream.read(chunk_bytes):
            yield bytes(chunk)


def digests(files: DataFrame, head_bytes: int, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """``files`` (path and more) with file_hash (SHA-256), head (first bytes) and read_bytes of each file.

    Files of any size: a task reads its files one after another, chunk by chunk, and keeps a running hash.
    The list of files is dealt to tasks by size's own order, so large files do not meet in one.
    """
    schema = T.StructType([*files.schema.fields, T.StructField("file_hash", T.StringType()), T.StructField("head", T.BinaryType()), T.StructField("read_bytes", T.LongType())])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = []
            for path in frame["path"]:
                digest, head, size = hashlib.sha256(), b"", 0
                for chunk in read_in_chunks(path, chunk_bytes):
                    digest.update(chunk)
                    head, size = head or chunk[:head_bytes], size + len(chunk)
                found.append((digest.hexdigest(), head, size))
            yield frame.assign(file_hash=[f[0] for f in found], head=[f[1] for f in found], read_bytes=[f[2] for f in found])

    return files.mapInPandas(run, schema)


def import_documents(spark: SparkSession, folder: str, known: DataFrame | None = None, *, magic: bytes = b"%PDF-", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """One row for each file: hash, size, status (imported, duplicate, invalid) and provenance.

    Spark lists the files; tasks read them in chunks, so a file may have any size, and only its hash and
    first bytes leave the task. Of sound files with one hash the first path is imported; hashes in ``known``
    (column file_hash) are duplicates. Files without a byte are not listed: they hold no document.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified_at"))
    tasks = max(1, spark.sparkContext.defaultParallelism)
    dealt = listed.repartition(tasks, F.xxhash64("path"))
    name = F.element_at(F.split("path", "/"), -1)
    rows = digests(dealt, len(magic), chunk_bytes).withColumns({"sound": F.col("head") == F.lit(magic), "stem": F.regexp_replace(name, r"\.[^.]*$", "")})
    rows = rows.withColumn("first", F.row_number().over(Window.partitionBy("file_hash").orderBy("path")) == 1)
    if known is not None:
        rows = rows.join(known.select("file_hash").distinct().withColumn("known", F.lit(True)), "file_hash", "left")
    else:
        rows = rows.withColumn("known", F.lit(None).cast("boolean"))
    status = F.when(~F.col("sound"), "invalid").when(~F.col("first") | F.col("known").isNotNull(), "duplicate").otherwise("imported")
    return rows.select("path", "file_hash", "size_bytes", status.alias("status"), provenance(F.col("stem")).alias("provenance"), "modified_at")


def write_files(rows: DataFrame, folder: str) -> None:
    """A file below ``folder`` for each row (name, content), written by the tasks, whole or not at all."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, root = _opened(folder)
        system.create_dir(root, recursive=True)
        for frame in frames:
            for name, content in zip(frame["name"], frame["content"]):
                draft = f"{root}/.{name}.{uuid.uuid4().hex}"
                with system.open_output_stream(draft) as stream:
                    stream.write(content)
                system.move(draft, f"{root}/{name}")  # a task that runs again writes the same
            yield frame[["name"]]

    rows.select("name", "content").mapInPandas(run, "name string").agg(F.count("*")).collect()


def extract_text(files: DataFrame, extractor: Callable[[bytes], list[str]], *, least: int = 100) -> DataFrame:
    """path, pages, text_hash, status, error of binary files. The extractor runs file by file in tasks;
    a file that it cannot read fails alone, and its message names no path."""

    def run(frames):
        for frame in frames:
            pages, errors = [], []
            for content in frame["content"]:
                try:
                    pages.append(extractor(content))
                    errors.append(None)
                except Exception as e:  # noqa: BLE001 - any failure is the file's
                    pages.append(None)
                    errors.append(str(e))
            yield pd.DataFrame({"path": frame["path"], "pages": pages, "error": errors})

    rows = files.select("path", "content").mapInPandas(run, "path string, pages array<string>, error string")
    status = F.when(F.col("error").isNotNull(), "failed").otherwise(text_status(F.col("pages"), least))
    return rows.select("path", "pages", text_hash(F.col("pages")).alias("text_hash"), status.alias("status"), sanitized_error(F.col("error"), F.col("path")).alias("error"))


def json_artifacts(spark: SparkSession, folder: str, schema: T.StructType, *, multiline: bool = True) -> tuple[DataFrame, DataFrame]:
    """Records of the JSON files in ``folder`` (a record or a list of records each), and a one-row
    frame with the number of malformed files (lines, if not ``multiline``)."""
    rows = spark.read.text(folder, wholetext=multiline).where(F.trim("value") != "").select(F.from_json("value", T.ArrayType(schema)).alias("r"))
    return rows.select(F.explode("r").alias("r")).select("r.*"), rows.agg(F.count_if(F.col("r").isNull()).alias("skipped"))


def write_json(rows: DataFrame, folder: str) -> None:
    """Artifacts as JSON lines, written by tasks; a later call replaces them."""
    rows.write.mode("overwrite").json(folder)


def last_of_each(rows: DataFrame, key: str, *order: str) -> tuple[DataFrame, DataFrame]:
    """The last record of each key, and keys that occur more than once with how often."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*[F.desc(o) for o in order]))
    return rows.withColumn("_k", rank).where("_k = 1").drop("_k"), rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


LEDGER = T.StructType([T.StructField("date", T.DateType()), T.StructField("court", T.StringType()), T.StructField("run_id", T.StringType()), T.StructField("searched_at", T.TimestampType()), T.StructField("outcome", T.StringType()), T.StructField("fetch_failures", T.LongType())])


def parse_ledger(lines: DataFrame, schema: T.StructType = LEDGER, *, courts: tuple[str, ...] = ("CP", "MC", "both")) -> DataFrame:
    """Ledger entries of a text frame (column value) with ``usable``: well-formed and in scope."""
    rows = lines.where(F.trim("value") != "").select(F.from_json("value", schema).alias("e"))
    usable = F.col("e").isNotNull() & F.col("e.date").isNotNull() & F.coalesce(F.col("e.court").isin(list(courts)), F.lit(False))
    return rows.select("e.*", usable.alias("usable")).withColumnRenamed("date", "day")


def read_ledger(spark: SparkSession, path: str, **how) -> DataFrame:
    return parse_ledger(spark.read.text(path), **how)
