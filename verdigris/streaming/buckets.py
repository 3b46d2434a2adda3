"""A keyed table that streams change: buckets of whole Parquet files, and a manifest of the valid ones.

A trigger writes the buckets it touches as a generation and commits a manifest that names, for every
bucket, the generation that holds it. Readers read just the files that the manifest names, at most one
generation a bucket, in one scan. What no manifest still kept names is deleted, so neither plans nor
folders grow with the number of triggers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.commits import KEPT, Commits, Folder

BUCKET = "_bucket"


class Buckets:
    """Rows below ``root`` in ``count`` buckets by the hash of ``key`` (nulls have a bucket like any value)."""

    def __init__(self, spark: SparkSession, root: str, key: list[str], count: int = 64):
        self.spark, self.root, self.key, self.count = spark, root.rstrip("/"), key, count
        self.commits, self.folder = Commits(spark, f"{self.root}/_manifest"), Folder(spark, self.root)

    def bucket(self, *columns: str) -> Column:
        return F.pmod(F.xxhash64(*[F.col(c) for c in columns or self.key]), F.lit(self.count)).cast("int")

    def touched(self, rows: DataFrame, *columns: str) -> list[int]:
        """The buckets of these rows; at most ``count``."""
        return sorted(r[0] for r in rows.select(self.bucket(*columns)).distinct().collect())

    def manifest(self, generation: int | None = None) -> dict:
        """generation (-1 before the first), files (bucket: generation), schema; as of a kept generation, or now."""
        states = [s for _, s in self.commits.states(KEPT + 1) if generation is None or s["generation"] <= generation]
        return states[-1] if states else {"generation": -1, "files": {}, "schema": None}

    def read(self, only: list[int] | None = None, generation: int | None = None) -> DataFrame | None:
        """All rows, or those of some buckets; None before the first trigger."""
        now = self.manifest(generation)
        if now["schema"] is None:
            return None
        paths = [f"{self.root}/generation={g}/{BUCKET}={b}" for b, g in sorted(now["files"].items(), key=lambda x: int(x[0])) if only is None or int(b) in only]
        rows = self.spark.read.schema(now["schema"])
        return rows.parquet(*paths) if paths else self.spark.createDataFrame([], now["schema"])

    def replace(self, rows: DataFrame, touched: list[int], generation: int) -> None:
        """``rows`` in place of all that the touched buckets hold. A generation that is committed already
        (a trigger that is repeated) changes nothing."""
        old = self.manifest()
        if generation <= old["generation"]:
            return
        rows.withColumn(BUCKET, self.bucket()).repartition(max(1, len(touched)), BUCKET).write.mode("overwrite").partitionBy(BUCKET).parquet(f"{self.root}/generation={generation}")
        made = {n.split("=")[1]: generation for n in self.folder.names(f"generation={generation}") if n.startswith(BUCKET)}
        files = {b: g for b, g in old["files"].items() if int(b) not in touched} | made
        self.commits.change(lambda _, state: {"generation": generation, "files": files, "schema": rows._jdf.schema().toDDL()})
        self._retire()

    def _retire(self) -> None:
        """Deletes files that none of the kept manifests names, and generations without files."""
        gone = self.commits.forget()
        named = {(b, g) for _, s in self.commits.states(KEPT + 1) for b, g in s["files"].items()}
        for b, g in {(b, g) for s in gone for b, g in s["files"].items()} - named:
            self.folder.delete(f"generation={g}", f"{BUCKET}={b}")
        for g in {g for s in gone for g in s["files"].values()} - {g for _, g in named}:
            self.folder.delete(f"generation={g}")
