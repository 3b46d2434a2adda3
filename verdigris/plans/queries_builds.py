"""Registered queries on whole builds: all aggregates in one pass, index against facts, the review queue, imports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import vocab as V
from ..operators import aggregates as A
from ..operators import checks, facts, grains, linkage, panel, privacy, review
from ..sources import files
from . import bindings as B
from . import tables
from .oracle_base import CHARGES, FLOOR, SENTENCES, WINDOW
from .oracles import ORACLES, _add
from .queries import query

# -- all aggregates of a run --------------------------------------------------------------------


@query
def grain_tables(spark, sf_dir):
    """The nine tables of a run from one pass over the facts, in one frame."""
    cells = tables.stored(grains.pre_aggregate(*B.facts(spark, sf_dir)), "cells")
    none = lambda kind: F.lit(None).cast(kind)
    shape = lambda rows, name, code, n, size, first, second: rows.select(F.concat_ws("_", F.col("grain") if "grain" in rows.columns else F.lit("charge"), F.lit(name)).alias("table"), "charge_id", (F.col("judge_id") if "judge_id" in rows.columns else none("long")).alias("judge_id"), code.alias("code"), F.col(n).alias("n"), size.cast("long").alias("size"), F.col(first).alias("first"), second.alias("second"))
    code = F.col("category_code")
    frames = [
        shape(grains.distributions(cells, "outcome"), "outcomes", code, "count", F.col("sample_size"), "percentage", none("double")),
        shape(grains.distributions(cells, "component"), "components", code, "count", F.col("sample_size"), "percentage", none("double")),
        shape(grains.summaries(cells), "summary", none("string"), "convictions", F.col("sentenced_convictions"), "wedge_percentage", none("double")),
        shape(grains.categories(cells), "index", code, "conviction_count", none("long"), "median_min_days", F.col("median_max_days")),
        shape(grains.grades(cells), "grades", F.col("grade"), "count", none("long"), "percentage", none("double")),
    ]
    return checks.union(frames)


def _part(table: str, oracle: str, judge: str, code: str, n: str, size: str, first: str, second: str = "NULL") -> str:
    return f"SELECT '{table}' AS \"table\", charge_id, CAST({judge} AS BIGINT) AS judge_id, CAST({code} AS VARCHAR) AS code, {n} AS n, CAST({size} AS BIGINT) AS size, {first} AS first, CAST({second} AS DOUBLE) AS second FROM ({ORACLES[oracle]})"


ORACLES["grain_tables"] = " UNION ALL ".join(
    [
        _part("charge_outcomes", "charge_outcome_distribution", "NULL", "category_code", "count", "sample_size", "percentage"),
        _part("pair_outcomes", "pair_outcome_distribution", "judge_id", "category_code", "count", "sample_size", "percentage"),
        _part("charge_components", "charge_component_distribution", "NULL", "category_code", "count", "sentencing_sample_size", "percentage"),
        _part("pair_components", "pair_component_distribution", "judge_id", "category_code", "count", "sentencing_sample_size", "percentage"),
        _part("charge_summary", "index_summary_charge", "NULL", "NULL", "convictions", "sentenced_convictions", "wedge_percentage"),
        _part("pair_summary", "index_summary_pair", "judge_id", "NULL", "convictions", "sentenced_convictions", "wedge_percentage"),
        _part("charge_index", "index_category_charge", "NULL", "category_code", "conviction_count", "NULL", "median_min_days", "median_max_days"),
        _part("pair_index", "index_category_pair", "judge_id", "category_code", "conviction_count", "NULL", "median_min_days", "median_max_days"),
        _part("charge_grades", "index_grade_mix", "NULL", "grade", "count", "NULL", "percentage"),
    ]
)


@query
def index_fact_checks(spark, sf_dir):
    """Index rows against their facts at both grains, as they are, and with bounds of confinement turned round in the
    facts and medians of probation missing from some rows."""
    own, parts = B.facts(spark, sf_dir)
    # outcomes and components meet once, for both grains and all four checks; neither reads a date
    shown = parts.where("public_eligible").withColumn("sentence_date", F.lit(None).cast("date"))
    cells = tables.stored(grains.pre_aggregate(own, shown).where("kind = 'component'"), "cells")
    every = tables.stored(grains.categories(cells), "index")
    turned = cells.withColumn("max_days", F.when(F.col("category_code") == "incarceration", F.col("min_days") - 1).otherwise(F.col("max_days")))
    found = []
    for grain, table in (("charge", "charge_index"), ("pair", "pair_index")):
        keys, _, short = grains.GRAINS[grain]
        index = every.where(F.col("grain") == grain)
        cut = index.withColumn("median_min_days", F.when((F.col("category_code") == "probation") & (F.col("charge_id") < "Brand#3"), None).otherwise(F.col("median_min_days")))
        for rows, stored, counted in (("sound", index, cells), ("hurt", cut, turned)):
            fed = counted.select(*keys, "category_code", "min_days", "max_days", F.col(f"{short}_fed").alias("n"))
            found.append(checks.index_against_counts(stored, fed, keys, table).withColumn("rows", F.lit(rows)))
    return checks.union(found)


_fed = lambda table, keys, flag: f"""
SELECT '{table}' AS "table", unnest(['component_duration_invalid', 'median_presence_mismatch']) AS code, unnest([0, 0]) AS violations, 'sound' AS rows
UNION ALL SELECT '{table}', unnest(['component_duration_invalid', 'median_presence_mismatch']), unnest([count(*) FILTER (scategory = 'incarceration' AND min_days IS NOT NULL), (SELECT count(*) FROM (SELECT {keys}, scategory FROM components WHERE public_eligible AND {flag} GROUP BY ALL HAVING count(min_days) > 0 AND (scategory = 'incarceration' OR (scategory = 'probation' AND charge_id < 'Brand#3'))))]), 'hurt' FROM components WHERE public_eligible AND {flag}"""  # noqa: E731
_add("index_fact_checks", f"SELECT \"table\", code, CAST(violations AS BIGINT) AS violations, rows FROM ({_fed('charge_index', 'charge_id', 'parent_public')} UNION ALL {_fed('pair_index', 'charge_id, judge_id', 'parent_specific')})", SENTENCES)

# -- gates and queue ----------------------------------------------------------------------------


def _warnings(spark, sf_dir) -> DataFrame:
    """Warnings of charges by docket and sequence; those of third charges are the docket's."""
    return B.charges(spark, sf_dir).select("docket_id", F.when(F.col("sequence") != 3, F.col("sequence")).alias("charge_sequence"), F.explode("warning_codes").alias("code"))


@query
def gate_by_warnings(spark, sf_dir):
    """Flags of charges whose warning codes come from the warnings that name their docket and sequence."""
    rows = facts.with_warning_codes(B.charges(spark, sf_dir), _warnings(spark, sf_dir))
    own = facts.outcome_facts(rows, window=B.WINDOW, floor=B.FLOOR)
    return own.groupBy("review_needed", "public_eligible", "judge_specific_eligible").agg(F.count("*").alias("n"))


_add(
    "gate_by_warnings",
    f"""
, w AS (SELECT docket_id, sequence, bool_or(discount = 0) AS review_needed FROM charges WHERE sequence <> 3 AND discount IN (0, 1) GROUP BY ALL)
, g AS (SELECT coalesce(w.review_needed, false) AS review_needed, coalesce(disposition_date >= {WINDOW}, false) AND coalesce(filed_date >= {FLOOR}, false) AND charge_id IS NOT NULL AND category <> 'unknown' AND NOT coalesce(w.review_needed, false) AS public_eligible, attributed FROM charges LEFT JOIN w USING (docket_id, sequence) WHERE category IS NOT NULL)
SELECT review_needed, public_eligible, public_eligible AND attributed AS judge_specific_eligible, count(*) AS n FROM g GROUP BY ALL""",
    CHARGES,
)


def _build_items(spark, sf_dir) -> DataFrame:
    own, parts = B.facts(spark, sf_dir)
    warned = B.charges(spark, sf_dir).where("discount in (0, 1)")
    code = F.when(F.col("discount") == 0, "SENTINEL_COLLISION").otherwise("MISSING_DISPOSITION_DATE")
    warnings = warned.select("docket_id", F.when(F.col("sequence") != 3, F.col("sequence")).alias("charge_sequence"), code.alias("code"))
    captured = F.when(F.col("grade") == "1-URGENT", "see file").when(F.col("grade") == "2-HIGH", F.col("docket_number"))
    links = linkage.resolve_links(B.dockets(spark, sf_dir).withColumn("cross_court_dockets", captured))
    located = parts.withColumn("docket_id", F.split("outcome_id", "-")[0])
    return review.first_of_each(review.build_items(own, located, warnings, links))


@query
def build_review_items(spark, sf_dir):
    """Items that a build gives: of charges and outcomes, of components, of warnings, and of links."""
    return _build_items(spark, sf_dir).groupBy("producer", "item_type", "severity", "reason_code").agg(F.count("*").alias("n"))


ITEMS = f"""{SENTENCES},
made AS (
  SELECT 1 AS producer, 'unmapped_charge' AS item_type, 'medium' AS severity, 'charge_not_normalized' AS reason_code, count(DISTINCT charge_row) AS n FROM facts WHERE charge_method = 'unmatched'
  UNION ALL SELECT 1, 'ambiguous_charge', 'high', 'blocking_warning', count(DISTINCT charge_row) FROM facts WHERE charge_method = 'ambiguous'
  UNION ALL SELECT 1, 'unmapped_disposition', 'medium', 'disposition_not_mapped', count(DISTINCT charge_row) FROM facts WHERE category = 'unknown'
  UNION ALL SELECT 2, 'money_unparseable', 'low', 'money_amount_unparseable', count(DISTINCT charge_row || sentence_type) FROM components WHERE no_money
  UNION ALL SELECT 2, 'duration_unparseable', 'low', 'sentence_duration_unparseable', count(DISTINCT charge_row || sentence_type) FROM components WHERE no_duration
  UNION ALL SELECT 3, 'sentinel_collision', 'medium', 'judge_not_normalized', count(DISTINCT docket_id || '/' || CASE WHEN sequence <> 3 THEN sequence ELSE 0 END) FROM charges WHERE discount = 0
  UNION ALL SELECT 3, 'missing_disposition_date', 'medium', 'disposition_date_missing', count(DISTINCT docket_id || '/' || CASE WHEN sequence <> 3 THEN sequence ELSE 0 END) FROM charges WHERE discount = 1
  UNION ALL SELECT 4, 'unresolvable_cross_court_reference', 'medium', 'review_needed', count(*) FROM dockets WHERE court = 'MC' AND grade = '1-URGENT')"""
_add("build_review_items", "SELECT producer::INT AS producer, item_type, severity, reason_code, n FROM made WHERE n > 0", ITEMS)


@query
def ops_queue_summary(spark, sf_dir):
    """The queue by status, open items by type and severity; items of warnings are resolved."""
    status = F.when(F.col("producer") == 3, "resolved").otherwise("open")
    return panel.queue_summary(_build_items(spark, sf_dir).withColumn("status", status))


_add(
    "ops_queue_summary",
    "SELECT 'status' AS \"by\", CASE WHEN producer = 3 THEN 'resolved' ELSE 'open' END AS value, CAST(sum(n) AS BIGINT) AS n FROM made GROUP BY 2 HAVING sum(n) > 0 UNION ALL SELECT 'item_type', item_type, CAST(sum(n) AS BIGINT) FROM made WHERE producer <> 3 GROUP BY 2 HAVING sum(n) > 0 UNION ALL SELECT 'severity', severity, CAST(sum(n) AS BIGINT) FROM made WHERE producer <> 3 GROUP BY 2 HAVING sum(n) > 0",
    ITEMS,
)


@query
def ops_warning_counts(spark, sf_dir):
    """Parser warnings by code, codes without any included."""
    return panel.warning_counts(_warnings(spark, sf_dir).withColumnRenamed("docket_id", "doc"))


_add(
    "ops_warning_counts",
    f"SELECT code, severity, coalesce(n, 0) AS n, coalesce(d, 0) AS dockets FROM (VALUES {', '.join(f'({k!r}, {v!r})' for k, v in V.WARNING_SEVERITY.items())}) v(code, severity) LEFT JOIN (SELECT CASE discount WHEN 0 THEN 'SUSPECT_JUDGE_LINE' ELSE 'MISSING_SENTENCE_DATE' END AS code, count(*) AS n, count(DISTINCT docket_id) AS d FROM charges WHERE discount IN (0, 1) GROUP BY 1) USING (code)",
    CHARGES,
)


@query
def forbidden_json_keys(spark, sf_dir):
    """Keys of the events' properties, and of a note around them, that hold a forbidden stem."""
    rows = B.table(spark, sf_dir, "events").select(F.to_json(F.struct("props", F.struct(F.when(F.col("event_type") == "click", F.col("user_id")).alias("Docket_No"), F.array(F.struct("value")).alias("list")).alias("note"))).alias("body"))
    return privacy.json_key_violations(rows, "body", ["docketno", "value"])


_add("forbidden_json_keys", "SELECT 'Docket_No' AS key, count(*) AS violations FROM events WHERE event_type = 'click' UNION ALL SELECT 'value', count(value) FROM events")

# -- imports ------------------------------------------------------------------------------------


@query
def imported_files(spark, sf_dir):
    """Pages written out as files, some of them twice and one large, and imported in chunks."""
    from .commits import Folder

    root = tables.shared_root(spark, "import")
    pages = B.table(spark, sf_dir, "pages").select("page_id", F.concat(F.when(F.col("page_id") % 10 != 9, "%PDF-").otherwise(""), F.col("html")).alias("body"))
    files.write_files(pages.select(F.concat(F.col("page_id").cast("string"), F.lit(".pdf")).alias("name"), F.col("body").cast("binary").alias("content")), root)
    found = files.import_documents(spark, root, chunk_bytes=1024)
    name = F.regexp_extract("path", r"([^/]+)\.pdf$", 1).cast("long")
    out = tables.stored(found.select(name.alias("page_id"), "file_hash", "size_bytes", "status"), "imported")
    Folder(spark, root).delete()
    return out


_add(
    "imported_files",
    "SELECT page_id, file_hash, size_bytes, CASE WHEN page_id % 10 = 9 THEN 'invalid' WHEN place = 1 THEN 'imported' ELSE 'duplicate' END AS status FROM (SELECT *, row_number() OVER (PARTITION BY file_hash ORDER BY CAST(page_id AS VARCHAR) || '.pdf') AS place FROM f)",
    "b AS (SELECT page_id, CASE WHEN page_id % 10 <> 9 THEN '%PDF-' ELSE '' END || html AS body FROM pages), f AS (SELECT page_id, sha256(body) AS file_hash, CAST(octet_length(encode(body)) AS BIGINT) AS size_bytes FROM b)",
)
