"""WARC archives compressed with a dictionary of their own records.

An archive is a ``.warc.zst`` file: a skippable frame that holds a Zstandard dictionary built from
the archive's records, then every record as a frame of its own, compressed with that dictionary. A
reader that knows a record's offset needs the dictionary and that frame only.

Of records with equal payloads the one with the largest page id is the response and the others
revisit it; payloads below ``least`` bytes are all responses. Payloads are grouped by SHA-1 and
length: only (id, digest) pairs are aggregated, partially before the shuffle, and joined to their
response; payloads meet the result by id and digest together, so a payload that a third of all pages
share is spread like any other.

Archives are written by tasks, of at most ``archive_bytes`` of payload each (or one record), to a folder
that all executors share. Every attempt of a task writes names of its own, and the manifest, a table that
Spark commits, lists those of the attempts that counted. Readers follow the manifest, so archives that a
lost or repeated attempt left behind are not read.

Defined cases: a null payload is empty; a null url gives an empty target URI; a null id counts as
below all others; rows with the largest id of a payload are all responses, repeated rows repeated
records; a payload longer than ``archive_bytes`` is alone in its archive; an empty table gives no
archive; columns beside id, url and payload are not read, whatever their names.
"""

from __future__ import annotations

import base64
import datetime
import hashlib
import math
import struct
import uuid
from collections.abc import Iterable, Iterator
from typing import BinaryIO

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import written

ARCHIVE_BYTES = 16 << 20
DICTIONARY_BYTES = 64 << 10
#: Bytes of records that a dictionary is built from; records are taken evenly over the archive.
SAMPLE_BYTES = 4 << 20
#: Compressed bytes that a task reads.
TASK_BYTES = 64 << 20
#: Compressed bytes asked of an archive's file at a time, and those first handed to the decompressor for a record.
READ_BYTES, FIRST_BYTES = 1 << 20, 4 << 10
#: Magic number of the skippable frame that holds a dictionary.
DICTIONARY_FRAME = 0x184D2A5D
END = b"\r\n"
RECORDS = "page_id long, url string, payload binary, payload_digest string, record_type string, refers_to long"
READ = "archive string, offset long, record_id string, page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string"


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def base32_sha1(hex_digest: Column) -> Column:
    """Upper-case base 32 of a SHA-1 in hex: each 5 bytes are 8 characters."""
    digits = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    parts = []
    for i in range(0, 40, 10):
        number = F.conv(F.substring(hex_digest, i + 1, 10), 16, 10).cast("long")
        parts += [F.substr(digits, (F.shiftright(number, 35 - 5 * k).bitwiseAND(F.lit(31).cast("long")) + 1).cast("int"), F.lit(1)) for k in range(8)]
    return F.concat(*parts)


def with_revisits(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 0) -> DataFrame:
    """The records to write, in columns RECORDS."""
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload"), F.sha1(payload).alias("sha1"), F.octet_length(payload).alias("size"))
    keys = written(rows.where(F.col("size") >= least).select("page_id", "sha1", "size"), "warc-keys")
    groups = written(keys.groupBy("sha1", "size").agg(F.max("page_id").alias("response"), F.count("*").alias("n")).where("n > 1"), "warc-groups")
    revisits = keys.join(groups, ["sha1", "size"]).where(~F.col("page_id").eqNullSafe(F.col("response"))).select(F.col("page_id").alias("id"), F.col("sha1").alias("hash"), "response").distinct()
    joined = rows.join(revisits, F.col("page_id").eqNullSafe(F.col("id")) & (F.col("sha1") == F.col("hash")), "left")
    return joined.select("page_id", "url", "payload", base32_sha1(F.col("sha1")).alias("payload_digest"), F.when(F.col("hash").isNotNull(), "revisit").otherwise("response").alias("record_type"), F.col("response").alias("refers_to"))


def header(record: dict, content_length: int, date: str) -> bytes:
    lines = [
        "WARC/1.1",
        f"WARC-Type: {record['record_type']}",
        f"WARC-Record-ID: {record_id(record['page_id'])}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {(record['url'] or '').translate({10: '%0A', 13: '%0D'})}",
        f"WARC-Payload-Digest: sha1:{record['payload_digest']}",
        f"X-Payload-Length: {len(record['payload'])}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {content_length}",
    ]
    if record["page_id"] is not None:
        lines.append(f"X-Page-ID: {record['page_id']}")
    if record["record_type"] == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(record['refers_to'])}", f"X-Refers-To-Page-ID: {record['refers_to']}"]
    return "\r\n".join(lines).encode() + END + END


def record_bytes(record: dict, date: str) -> bytes:
    """One WARC record: a revisit holds no payload. ``date`` is that of the capture, as 2020-01-31T12:00:00Z."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    content = http + (record["payload"] if record["record_type"] == "response" else b"")
    return header(record, len(content), date) + content + END + END


def dictionary_of(records: list[bytes], size: int = DICTIONARY_BYTES, sample: int = SAMPLE_BYTES) -> bytes:
    """A dictionary built from the records, or the records' own first bytes where too few for training."""
    step = max(1, sum(map(len, records)) // sample)
    try:
        return zstandard.train_dictionary(size, records[::step], k=256, d=8).as_bytes()
    except zstandard.ZstdError:
        return b"".join(records[:4])[:size]


def archive_bytes_of(records: list[bytes]) -> tuple[bytes, list[int]]:
    """The archive, and the offset of each record's frame."""
    raw = dictionary_of(records)
    frame = zstandard.compress(raw)
    out, offsets = [struct.pack("<II", DICTIONARY_FRAME, len(frame)), frame], []
    at = 8 + len(frame)
    compressor = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(raw))
    for record in records:
        part = compressor.compress(record)
        offsets.append(at)
        out.append(part)
        at += len(part)
    return b"".join(out), offsets


def manifest_of(folder: str) -> str:
    return f"{folder.rstrip('/')}-manifest"


def write(records: DataFrame, folder: str, *, archive_bytes: int = ARCHIVE_BYTES, date: str | None = None) -> str:
    """Writes archives of the records below ``folder`` (a URI that all executors reach); its manifest.

    ``date`` is the records' WARC-Date; by default the time of this call.
    """
    dated = date or datetime.datetime.now(datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")

    def save(name: str, pending: list[dict]) -> dict:
        store, root = fs.FileSystem.from_uri(folder)
        content, _ = archive_bytes_of([record_bytes(r, dated) for r in pending])
        store.create_dir(root, recursive=True)
        with store.open_output_stream(f"{root}/{name}") as out:
            out.write(content)
        return {"archive": name, "records": len(pending), "bytes": len(content)}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        partition, attempt, pending, size, done = TaskContext.get().partitionId(), uuid.uuid4().hex, [], 0, []

        def flush():
            done.append(save(f"part-{partition:06d}-{len(done):05d}-{attempt}.warc.zst", pending))

        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                for record in batch.slice(i, 256).to_pylist():
                    if pending and size + len(record["payload"]) > archive_bytes:
                        flush()
                        pending, size = [], 0
                    pending.append(record)
                    size += len(record["payload"])
        if pending:
            flush()
        yield pa.RecordBatch.from_pylist(done, schema=pa.schema([("archive", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]))

    records.mapInArrow(run, "archive string, records long, bytes long").write.parquet(manifest_of(folder))
    return manifest_of(folder)


def parse_archive(file: BinaryIO) -> Iterator[tuple[int, dict, bytes]]:
    """(offset, headers, content) of each record of an archive, read forward; one record is held at a time."""
    magic, size = struct.unpack("<II", file.read(8))
    if magic != DICTIONARY_FRAME:
        raise ValueError("the archive does not begin with a dictionary frame")
    raw = zstandard.ZstdDecompressor().decompress(file.read(size))
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw))
    at, ahead = 8 + size, memoryview(b"")
    while ahead := ahead or memoryview(file.read(READ_BYTES)):
        # what is handed over beyond a frame's end is copied, so pieces begin small and double
        frame, parts, length, step = reader.decompressobj(), [], 0, FIRST_BYTES
        while not frame.eof:
            ahead = ahead or memoryview(file.read(READ_BYTES))
            if not ahead:
                raise ValueError(f"record at {at} is cut off")
            piece = ahead[:step]
            parts.append(frame.decompress(piece))
            used = len(piece) - len(frame.unused_data)
            length, ahead, step = length + used, ahead[used:], min(2 * step, READ_BYTES)
        head, _, rest = b"".join(parts).partition(END + END)
        lines = head.decode().split("\r\n")
        names = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
        yield at, names, rest[: int(names["Content-Length"])]
        at += length


def read(spark: SparkSession, folder: str, *, task_bytes: int = TASK_BYTES) -> DataFrame:
    """One row for each record of the archives that the manifest lists, in columns READ; digests are recomputed."""
    manifest = spark.read.schema("archive string, records long, bytes long").parquet(manifest_of(folder))
    archives, size = manifest.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    tasks = max(1, min(archives, max(spark.sparkContext.defaultParallelism, math.ceil(size / task_bytes))))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        schema = pa.schema([("archive", pa.string()), ("offset", pa.int64()), ("record_id", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())])
        number = lambda x: None if x is None else int(x)

        def records_of(path: str, store: fs.FileSystem):
            with store.open_input_stream(path) as file:
                yield from parse_archive(file)

        for batch in batches:
            for i in range(batch.num_rows):
                rows = []
                name = batch.column("archive")[i].as_py()
                for at, names, content in records_of(f"{root}/{name}", store):
                    digest, size = names["WARC-Payload-Digest"].removeprefix("sha1:"), int(names["X-Payload-Length"])
                    if names["WARC-Type"] == "response":
                        payload = content.partition(END + END)[2]
                        own = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                        if (own, len(payload)) != (digest, size):
                            raise ValueError(f"record at {at} is damaged")
                    rows.append(dict(zip(schema.names, (name, at, names["WARC-Record-ID"], number(names.get("X-Page-ID")), names["WARC-Target-URI"], names["WARC-Type"], number(names.get("X-Refers-To-Page-ID")), size, digest), strict=True)))
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return manifest.select("archive").repartition(tasks).mapInArrow(run, READ)
