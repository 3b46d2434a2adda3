"""Facts of a corpus, built once for each state of its files and read by all.

A build is keyed by a fingerprint: paths, sizes and times of the input files, the parameters, and the code
that derives the facts. The first reader of a state builds its tables into the shared folder and
commits them; later ones, in this session or another, read them back. If two build at once, one commit
wins and the other build is removed. A corpus that has moved has another fingerprint, so its facts are
built anew; how many charges the last build saw stays on record beside it.
"""

from __future__ import annotations

import hashlib
import inspect
import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from types import ModuleType

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .commits import Commits, Folder
from .tables import shared_base


def fingerprint(spark: SparkSession, paths: list[str], code: list[ModuleType], **parameters: str) -> str:
    """One hash of the files below the paths (listed and summed up by Spark), the code and the parameters."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths).select("path", "length", "modificationTime")
    seen = files.agg(F.count("*"), F.sum("length"), F.bit_xor(F.xxhash64("path", "length", "modificationTime")), F.max("modificationTime").cast("string")).first()
    sources = [hashlib.sha256(inspect.getsource(m).encode()).hexdigest() for m in code]
    return hashlib.sha256(json.dumps([sorted(paths), list(seen), sources, sorted(parameters.items())]).encode()).hexdigest()


@dataclass
class Build:
    """The tables of one build, and their counts of rows."""

    spark: SparkSession
    root: str
    state: dict

    def table(self, name: str) -> DataFrame:
        return self.spark.read.schema(self.state["schemas"][name]).parquet(f"{self.root}/{self.state['folder']}/{name}")

    def rows(self, name: str) -> int:
        return self.state["rows"][name]


def build(spark: SparkSession, key: str, make: Callable[[Callable[[str, DataFrame], DataFrame]], None]) -> Build:
    """The build of this fingerprint, made by ``make`` if there is none.

    ``make(keep)`` hands each table to ``keep(name, rows)``, which writes it and gives it back as stored.
    """
    root = f"{shared_base(spark)}/facts/{key}"
    commits, folder = Commits(spark, f"{root}/_commits"), Folder(spark, root)
    number, state = commits.latest()
    if state is not None and all(folder.has(state["folder"], t, "_SUCCESS") for t in state["rows"]):
        return Build(spark, root, state)
    made = {"folder": uuid.uuid4().hex, "rows": {}, "schemas": {}}

    def keep(name: str, rows: DataFrame) -> DataFrame:
        path = f"{root}/{made['folder']}/{name}"
        rows.write.option("compression", "zstd").parquet(path)
        made["schemas"][name] = rows._jdf.schema().toDDL()
        stored = spark.read.schema(made["schemas"][name]).parquet(path)
        made["rows"][name] = stored.count()
        return stored

    try:
        make(keep)
    except BaseException:
        folder.delete(made["folder"])
        raise
    if not commits.put(number + 1, made):
        folder.delete(made["folder"])
        made = commits.latest()[1]
    return Build(spark, root, made)
