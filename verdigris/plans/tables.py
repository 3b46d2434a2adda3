"""Schemas of the stored tables and the run-partitioned store that holds them."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .commits import Commits, Folder
from .runs import ACTIVE, RunRefused, active, published, validated

_DDL = {
    "source_documents": "id string, file_hash string, original_filename string, file_size_bytes bigint, imported_at timestamp, import_mode string, status string, error_code string, docket_number_provenance string, court_type string, county string",
    "dockets": "id string, source_document_id string, docket_number string, record_parser_version int, envelope_parser_version int, parsed_at timestamp, county string, court_type_recorded string, court_type_derived string, case_status string, filed_date date, otn string, dc_number string, cross_court_dockets string, defendant_hash string, assigned_judge_raw string, envelope_status string, review_needed boolean, loaded_at timestamp, originating_docket_no string",
    "charges": "id string, docket_id string, sequence int, statute string, grade string, offense string, disposition_raw string, disposition_date date, disposition_judge_raw string, event_name string, event_date date, orig_seq int, superseded_by_charge_id string",
    "sentences": "id string, charge_id string, component_order int, sentence_type string, min_days int, max_days int, min_assumed boolean, program string, sentence_date date, raw_text string",
    "warnings": "id string, docket_id string, code string, section string, charge_sequence int, page int, field string",
    "related_cases": "id string, docket_id string, docket_number string, court string, association_reason string",
    "docket_links": "source_docket_id string, target_docket_number string, link_type string, target_docket_id string, evidence_source string",
    "normalized_charges": "id string, slug string, display_name string, statute_code string, grade string, is_active boolean",
    "charge_aliases": "normalized_charge_id string, alias_text string",
    "normalized_judges": "id string, slug string, display_name string, is_active boolean",
    "judge_aliases": "normalized_judge_id string, alias_text string",
    "queue_items": "dedup_key string, item_type string, severity string, source_document_id string, entity_type string, raw_value string, candidate_context string, reason_code string, status string",
    "aggregate_runs": "id string, status string, started_at timestamp, completed_at timestamp, published_at timestamp, invalidated_at timestamp, invalidated_reason string, parser_version int, taxonomy_version string, data_range_start date, data_range_end date, build_run_id string",
}


def schema_of(table: str) -> str:
    """The table's schema as DDL."""
    return _DDL[table]


def row_id(*parts: str):
    """A stable id from a natural key."""
    return F.sha2(F.concat_ws("\x1f", *parts), 256)


def shared_base(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``). Only on one machine, as in tests, a folder
    below the warehouse stands in for it; a cluster without the setting is an error, as executors would
    write to their own disks."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir names no folder that all executors share")
        base = spark.conf.get("spark.sql.warehouse.dir") + "/_shared"
    return base.rstrip("/")


def shared_root(spark: SparkSession, what: str) -> str:
    """A new folder below the shared one."""
    return f"{shared_base(spark)}/{what}-{uuid.uuid4().hex}"


def stored(rows: DataFrame, name: str) -> DataFrame:
    """Rows written once into the shared folder and read back."""
    path = shared_root(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


class RunStore:
    """Parquet tables with versions for each run below one root, and the table of runs.

    Whatever is written is a new folder first and valid by a commit (see ``plans.commits``) after: a write
    that fails leaves the rows that were there, and readers never see a part. A run counts once its row in
    ``runs`` says completed: its tables are written before, and if one of them fails all are removed and the
    row says failed. The table of runs is a row a run; every change of it reads the last state, writes
    the next and commits it, and starts again where another writer was faster, so none is lost.
    """

    #: Stands for the run of a table that belongs to none.
    WHOLE = "_whole"

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.folder = Folder(spark, self.root)

    def _commits(self, table: str, run_id: str) -> Commits:
        return Commits(self.spark, f"{self.root}/_commits/{table}/{run_id}")

    def _version(self, table: str, run_id: str) -> str | None:
        return self._commits(table, run_id).latest()[1]

    def _save(self, table: str, rows: DataFrame, run_id: str, first: bool = False) -> None:
        version = f"{table}/run_id={run_id}/{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.root}/{version}")
        commits = self._commits(table, run_id)
        if not first:
            commits.change(lambda _, old: version)
        elif not commits.put(0, version):
            self.folder.delete(version)
            raise RunRefused(f"{table} already exists for {run_id}")
        for old in commits.forget():
            self.folder.delete(old)

    # -- tables of a run

    def write(self, table: str, rows: DataFrame, run_id: str) -> None:
        """The run's rows in place of those it had; those stay until the new ones are whole."""
        self._save(table, rows, run_id)

    def insert(self, table: str, rows: DataFrame, run_id: str) -> None:
        """The run's rows; an error if it has some already, or if another writer was faster."""
        if self.has(table, run_id):
            raise RunRefused(f"{table} already exists for {run_id}")
        self._save(table, rows, run_id, first=True)

    def rebuild(self, table: str, rows: DataFrame) -> None:
        """A table that belongs to no run, whole. Readers of the old rows may go on."""
        self._save(table, rows, self.WHOLE)

    def read(self, table: str, run_id: str | None = None) -> DataFrame:
        """Rows of a run; without one those of the table as a whole, or of all its runs."""
        if run_id or self.has(table, self.WHOLE):
            return self.spark.read.parquet(f"{self.root}/{self._version(table, run_id or self.WHOLE)}")
        versions = [self._version(table, r) for r in self.folder.names("_commits", table)]
        return self.spark.read.option("basePath", f"{self.root}/{table}").parquet(*[f"{self.root}/{v}" for v in versions])

    def has(self, table: str, run_id: str) -> bool:
        return self._version(table, run_id) is not None

    def drop(self, table: str, run_id: str) -> None:
        self.folder.delete("_commits", table, run_id)
        self.folder.delete(table, f"run_id={run_id}")

    def row_counts(self, tables: list[str], run_id: str) -> DataFrame:
        """table, rows of a run; a table that the run lacks has none."""
        one = lambda t: (self.read(t, run_id) if self.has(t, run_id) else self.spark.range(0)).agg(F.count("*").alias("rows")).select(F.lit(t).alias("table"), "rows")
        return reduce(DataFrame.unionByName, map(one, tables))

    # -- runs

    def _rows(self, version: str | None) -> DataFrame:
        ddl = schema_of("aggregate_runs")
        return self.spark.read.schema(ddl).parquet(f"{self.root}/{version}") if version else self.spark.createDataFrame([], ddl)

    def runs(self) -> DataFrame:
        return self._rows(self._version("runs", self.WHOLE))

    def change_runs(self, update: Callable[[DataFrame], DataFrame]) -> None:
        """Commits ``update`` of the table of runs; it may be called again on what another writer made of it."""
        commits, columns = self._commits("runs", self.WHOLE), self._rows(None).columns

        def write(_: int, version: str | None) -> str:
            new = f"runs/{uuid.uuid4().hex}"
            update(self._rows(version)).select(*columns).coalesce(1).write.parquet(f"{self.root}/{new}")
            return new

        commits.change(write, self.folder.delete)
        for old in commits.forget():
            self.folder.delete(old)

    def begin(self, run_id: str, at: str, **fields: str) -> None:
        """The run's row, whatever follows."""
        types = self._rows(None).schema
        row = self.spark.range(1).select(F.lit(run_id).alias("id"), F.lit("in_progress").alias("status"), F.lit(at).cast("timestamp").alias("started_at"), *[F.lit(v).cast(types[k].dataType).alias(k) for k, v in fields.items()])
        self.change_runs(lambda rows: rows.unionByName(row, allowMissingColumns=True))

    def build(self, run_id: str, tables: dict[str, Callable[[], DataFrame]], at: str, *, checks: Callable[[], DataFrame] | None = None, **fields: str) -> str:
        """All tables of a run or none of them; its status. Rows of ``checks`` with violations fail the run."""
        self.begin(run_id, at, **fields)
        sound = False
        try:
            for table, rows in tables.items():
                self.write(table, rows(), run_id)
            sound = checks is None or checks().where("violations > 0").isEmpty()
        finally:
            self.change_runs(lambda rows: validated(rows, run_id, sound, at))
            # a run whose lease ended meanwhile has failed, whatever it thinks itself
            sound = sound and self.runs().where((F.col("id") == run_id) & (F.col("status") == "completed")).head() is not None
            if not sound:
                for table in tables:
                    self.drop(table, run_id)
        return "completed" if sound else "failed"

    def fail_expired(self, at: str, lease_seconds: int) -> list[str]:
        """Runs still in progress that began longer than the lease before ``at``: their builder is gone. They
        fail, and what they wrote is removed. Their ids."""
        over = (F.col("status") == "in_progress") & (F.unix_seconds(F.lit(at).cast("timestamp")) - F.unix_seconds("started_at") > lease_seconds)
        dead = [r["id"] for r in self.runs().where(over).select("id").collect()]  # as many as there are dead runs
        if dead:
            self.change_runs(lambda rows: reduce(lambda frame, run: validated(frame, run, False, at), dead, rows))
            gone = {r["id"] for r in self.runs().where(F.col("id").isin(dead) & (F.col("status") == "failed")).select("id").collect()}
            for table in self.folder.names("_commits"):
                for run in gone:
                    self.drop(table, run)
            for table in self.folder.names():  # rows that were never committed
                for run in gone:
                    self.folder.delete(table, f"run_id={run}")
            return sorted(gone)
        return []

    def publish(self, at: str, run_id: str | None = None) -> None:
        self.change_runs(lambda rows: published(rows, at, run_id))

    def active_id(self) -> str | None:
        row = active(self.runs()).select("id").head()
        return row and row["id"]

    def prune(self, tables: list[str], run_ids: list[str], *, dry_run: bool = True) -> DataFrame:
        """run_id, table, rows that would go of completed runs that are not active; without ``dry_run`` they go.

        Runs of another status, or active, are refused.
        """
        allowed = {r["id"] for r in self.runs().where((F.col("status") == "completed") & F.col("id").isin(run_ids) & ~F.coalesce(F.expr(ACTIVE), F.lit(False))).select("id").collect()}  # as many as asked for
        if refused := sorted(set(run_ids) - allowed):
            raise RunRefused(f"not completed, or active: {', '.join(refused)}")
        counts = reduce(DataFrame.unionByName, [self.row_counts(tables, r).select(F.lit(r).alias("run_id"), "table", "rows") for r in run_ids])
        if not dry_run:
            counts = self.spark.createDataFrame(counts.collect(), counts.schema)  # a row a table: counted before they go
            for r in run_ids:
                for t in tables:
                    self.drop(t, r)
        return counts
