"""Registered queries on sources, rosters, sheets, texts and comparisons, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import vocab as V
from ..functions import text
from ..operators import collector, compare, eligibility, matching, privacy, reports, sheets
from ..sources import files
from . import bindings as B
from . import tables
from .oracle_base import CHARGES, DOCKETS
from .oracles import ATTEMPTS, _add
from .queries import _versions, printed_sheets, query, sheet_parts

# -- files and artifacts ------------------------------------------------------------------------


@query
def artifact_scan(spark, sf_dir):
    """Nations written as JSON lines, some broken, and read back: the records and how many were skipped."""
    n = B.table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    line = F.to_json(F.struct(*n.columns))
    folder = tables.shared_root(spark, "artifacts")
    n.select(F.when(F.col("n_regionkey") == 2, F.substring(line, 1, 20)).otherwise(line).alias("value")).write.text(folder)
    good, skipped = files.json_artifacts(spark, folder, n.schema, multiline=False)
    return good.select("n_nationkey", "n_name").unionByName(skipped.select(F.col("skipped").alias("n_nationkey"), F.lit("skipped").alias("n_name")))


_add("artifact_scan", "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name FROM nation WHERE n_regionkey <> 2 UNION ALL SELECT count(*), 'skipped' FROM nation WHERE n_regionkey = 2")


@query
def artifact_writers(spark, sf_dir):
    """A report written as one JSON document a court and read back."""
    report = reports.outcome_pivot(B.attempts(spark, sf_dir).withColumn("court", F.when(F.col("run") < 75, "CP").otherwise("MC")), ["hit", "miss", "blocked", "error", "already_present"])
    folder = tables.shared_root(spark, "report")
    files.write_json(report, folder)
    return files.json_artifacts(spark, folder, report.schema, multiline=False)[0]


_add("artifact_writers", "SELECT CASE WHEN run < 75 THEN 'CP' ELSE 'MC' END AS court, count(*) AS attempts, count(*) FILTER (outcome = 'hit') AS hit, count(*) FILTER (outcome = 'miss') AS miss, count(*) FILTER (outcome = 'blocked') AS blocked, count(*) FILTER (outcome = 'error') AS error, count(*) FILTER (outcome = 'already_present') AS already_present, true AS reconciles FROM attempts GROUP BY 1", ATTEMPTS)


@query
def last_records(spark, sf_dir):
    """The latest order of each customer, and how many have several."""
    o = B.table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    last, twice = files.last_of_each(o, "o_custkey", "o_orderkey")
    return last.join(twice, "o_custkey", "left").select("o_custkey", "o_orderkey", F.coalesce("n", F.lit(1)).alias("n"))


_add("last_records", "SELECT o_custkey, max(o_orderkey) AS o_orderkey, count(*) AS n FROM orders GROUP BY o_custkey")


@query
def ledger_lines(spark, sf_dir):
    """Ledger lines as JSON, some cut short, some of a court out of scope."""
    rows = B.ledger(spark, sf_dir).withColumn("court", F.when(F.col("fetch_failures") == 1, F.concat("court", F.lit("?"))).otherwise(F.col("court")))
    line = F.to_json(F.struct(F.col("day").alias("date"), "court", "outcome", "fetch_failures"))
    lines = rows.select(F.when(F.col("outcome") == "truncated", F.substring(line, 1, 12)).otherwise(line).alias("value"))
    return files.parse_ledger(lines).groupBy("usable", F.coalesce("court", F.lit("-")).alias("court")).agg(F.count("*").alias("n"), F.count_distinct("day").alias("days"))


_add("ledger_lines", "SELECT NOT cut AND NOT bad AS usable, CASE WHEN cut THEN '-' WHEN bad THEN court || '?' ELSE court END AS court, count(*) AS n, count(DISTINCT CASE WHEN NOT cut THEN day END) AS days FROM (SELECT CAST(ts AS DATE) AS day, CASE WHEN user_id < 50 THEN 'CP' WHEN user_id < 100 THEN 'MC' ELSE 'both' END AS court, event_type = 'click' AS cut, value > 20 AS bad FROM events) GROUP BY 1, 2")


def _pages_of(content: bytes) -> list[str]:
    """Stands for an extractor: pages by line, and a failure that names the file."""
    if content[:1] == b"T":
        raise ValueError("cannot open /in/file.txt: file is broken")
    return content.decode().split("\n")


@query
def extraction_artifacts(spark, sf_dir):
    """Pages of every document by an extractor that fails on some; messages name no path."""
    docs = B.table(spark, sf_dir, "documents").where("text is not null")
    rows = files.extract_text(docs.select(F.concat(F.lit("/in/"), "doc_id", F.lit("/file.txt")).alias("path"), F.encode("text", "utf-8").alias("content")), _pages_of)
    return rows.select(F.split("path", "/")[2].cast("bigint").alias("doc_id"), "status", F.when(F.col("error").isNull(), F.col("text_hash")).alias("text_hash"), "error")


_add(
    "extraction_artifacts",
    r"SELECT doc_id, CASE WHEN bad THEN 'failed' WHEN poor = 0 THEN 'success' WHEN poor = len(pages) THEN 'needs_ocr_or_review' ELSE 'partial' END AS status, CASE WHEN NOT bad THEN sha256(array_to_string(pages, chr(12))) END AS text_hash, CASE WHEN bad THEN 'cannot open /in/<redacted>: <redacted> is broken' END AS error FROM (SELECT *, len(list_filter(pages, lambda p: length(regexp_replace(p, '^\s+|\s+$', '', 'g')) < 100)) AS poor FROM (SELECT doc_id, starts_with(text, 'T') AS bad, string_split(text, chr(10)) AS pages FROM documents WHERE text IS NOT NULL))",
)


@query
def extractor_evaluation(spark, sf_dir):
    d = B.table(spark, sf_dir, "documents").where("text is not null")
    pages = d.select(F.col("source").alias("extractor"), F.col("doc_id").alias("document"), F.explode(F.split("text", "\n", -1)).alias("text"))
    return reports.extraction_evaluation(pages, ["license", "THE"]).withColumn("mean_signs", F.floor(F.col("mean_signs") * 1000).cast("bigint"))


_add("extractor_evaluation", "SELECT source AS extractor, count(DISTINCT doc_id) AS documents, count(*) AS pages, count(*) FILTER (length(trim(t)) = 0) AS empty_pages, CAST(floor(CAST(sum(length(trim(t))) AS DOUBLE) / count(*) * 1000) AS BIGINT) AS mean_signs, count(*) FILTER (contains(t, 'license')) AS license, count(*) FILTER (contains(t, 'THE')) AS the FROM (SELECT source, doc_id, unnest(string_split(text, chr(10))) AS t FROM documents WHERE text IS NOT NULL) GROUP BY source")

# -- rosters and keys ---------------------------------------------------------------------------


@query
def roster_snapshots(spark, sf_dir):
    """Active nations with an array of aliases, without two slugs."""
    entries = B.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.lower("n_name").alias("slug"), (F.col("n_regionkey") != 3).alias("active"))
    aliases = B.table(spark, sf_dir, "customer").where("c_acctbal > 9000").select(F.col("c_nationkey").alias("entry_id"), F.when(F.col("c_mktsegment") != "MACHINERY", F.col("c_mktsegment")).alias("alias")).distinct()
    rows = matching.roster_snapshot(entries, aliases, without=["nation_1", "nation_2"])
    return rows.select("id", "slug", F.concat_ws(",", "aliases").alias("aliases"))


_add("roster_snapshots", "SELECT n_nationkey AS id, lower(n_name) AS slug, coalesce((SELECT string_agg(DISTINCT c_mktsegment, ',' ORDER BY c_mktsegment) FROM customer WHERE c_nationkey = n_nationkey AND c_acctbal > 9000 AND c_mktsegment <> 'MACHINERY'), '') AS aliases FROM nation WHERE n_regionkey <> 3 AND lower(n_name) NOT IN ('nation_1', 'nation_2')")


@query
def forbidden_paths(spark, sf_dir):
    """Paths of identifying fields in nested rows of several tables; the stems are as many as there are rules."""
    o = B.dockets(spark, sf_dir).select(F.struct("docket_number", F.array(F.struct("otn")).alias("keys")).alias("Case_Info"), "court")
    found = privacy.forbidden_keys(o.schema, ["docketnumber", "otn", "caseinfo"])
    return spark.createDataFrame([(p,) for p in found], "path string")


_add("forbidden_paths", "SELECT * FROM (VALUES ('$.Case_Info'), ('$.Case_Info.docket_number'), ('$.Case_Info.keys[].otn')) v(path)")


@query
def related_keys(spark, sf_dir):
    """Related cases as JSON; entries with other keys than the three allowed are told apart."""
    d = B.dockets(spark, sf_dir)
    plain = F.struct("docket_number", "court", F.lit("Related").alias("association_reason"))
    entry = F.when(F.col("grade") == "1-URGENT", F.to_json(F.struct("docket_number", "court", "otn"))).otherwise(F.to_json(plain))
    return d.select(sheets.allowed_related(entry).alias("allowed")).groupBy("allowed").agg(F.count("*").alias("n"))


_add("related_keys", "SELECT coalesce(grade, '') <> '1-URGENT' AS allowed, count(*) AS n FROM dockets GROUP BY 1", DOCKETS)


@query
def same_hash_imports(spark, sf_dir):
    """Raw pages joined to the parsed page of the same hash."""
    p = B.table(spark, sf_dir, "pages").select("page_id", F.sha2("html", 256).alias("file_hash"))
    parsed = p.groupBy("file_hash").agg(F.min("page_id").alias("parsed_id"))
    return compare.same_hash(p, parsed.where("parsed_id % 2 = 0")).select("page_id", "parsed_id")


_add("same_hash_imports", "WITH p AS (SELECT page_id, sha256(html) AS h FROM pages), f AS (SELECT h, min(page_id) AS parsed_id FROM p GROUP BY h) SELECT page_id, parsed_id FROM p JOIN f USING (h) WHERE parsed_id % 2 = 0")

# -- sheets -------------------------------------------------------------------------------------

SHEET_CHARGES = f"""{CHARGES},
one AS (SELECT docket_number, docket_id, filed_date, sequence, min((charge_row, offense, statute, coalesce(disposition_raw, ''), coalesce(CAST(disposition_date AS VARCHAR), ''))) AS c FROM charges GROUP BY ALL),
flat AS (SELECT docket_number, docket_id, filed_date, sequence, nullif(struct_extract_at(c, 4), '') AS raw, CAST(nullif(struct_extract_at(c, 5), '') AS DATE) AS day FROM one),
heads AS (SELECT DISTINCT docket_number, docket_id, filed_date FROM flat)"""


def _sheets(spark, sf_dir):
    """The printed sheets with more sections: status, related cases under a heading, sentences, captions, blank birth dates."""
    p = printed_sheets(spark, sf_dir).withColumn("k", F.split_part("docket_number", F.lit("-"), F.lit(4)).cast("bigint"))
    k = F.col("k")
    status = F.when(k % 3 == 0, F.lit("\nSTATUS INFORMATION\nCase Status: Closed")).otherwise("")
    related = F.when(k % 4 == 0, F.concat(F.lit("\nRELATED CASES\nJoined\nCP-51-CR-0000001-2001\nMC-51-CR-0000002-2002 Refiled"))).otherwise("")
    first = F.concat(F.regexp_replace(F.get("pages", F.lit(0)), "\nPage 1 of 2$", ""), status, related, F.lit("\nPage 1 of 2"))
    first = F.when(k % 5 == 0, F.regexp_replace(first, "Date Of Birth: 01/02/1980\nDefendant Smith, Sam", "no name here")).otherwise(first)
    judged = r"(Doe, Jane \d\d/\d\d/\d{4})"
    second = F.regexp_replace(F.get("pages", F.lit(1)), judged, "$1\nProbation\nMin of 3.00 Months\nMax of 6.00 Months")
    second = F.when(k % 7 == 1, F.regexp_replace(second, "Min of 3.00 Months\nMax of 6.00 Months", "of some time")).otherwise(second)
    return p.select("docket_number", F.array(first, second).alias("pages"))


@query
def sheet_cases(spark, sf_dir):
    rows = sheets.parse_sheets(_sheets(spark, sf_dir), "salt", wanted=["cases"], dealt=True, stored=tables.stored)["cases"]
    return rows.select("doc", "court_type", "case_status", "filed_date", "assigned_judge", "parsed", (F.col("defendant_hash") == F.sha2(F.lit("salt|smith sam|1980"), 256)).alias("hashed"))


_add("sheet_cases", "SELECT docket_number AS doc, CASE WHEN starts_with(docket_number, 'MC') THEN 'Municipal Court' ELSE 'Common Pleas' END AS court_type, CASE WHEN docket_id % 3 = 0 THEN 'Closed' END AS case_status, filed_date, 'Roe, Rick' AS assigned_judge, docket_id % 5 <> 0 AS parsed, CASE WHEN docket_id % 5 <> 0 THEN true END AS hashed FROM heads", SHEET_CHARGES)


@query
def sheet_related(spark, sf_dir):
    rows = sheets.parse_sheets(_sheets(spark, sf_dir), "salt", wanted=["related"], dealt=True, stored=tables.stored)["related"]
    return rows.groupBy("docket_number", "court", "association_reason").agg(F.count("*").alias("n"), F.count_distinct("doc").alias("docs"))


_add("sheet_related", "SELECT n AS docket_number, c AS court, r AS association_reason, count(*) AS n, count(*) AS docs FROM heads, (VALUES ('CP-51-CR-0000001-2001', 'Common Pleas', 'Joined'), ('MC-51-CR-0000002-2002', 'Municipal Court', 'Refiled')) v(n, c, r) WHERE docket_id % 4 = 0 GROUP BY ALL", SHEET_CHARGES)


@query
def sheet_sentences(spark, sf_dir):
    rows = sheets.parse_sheets(_sheets(spark, sf_dir), "salt", wanted=["sentences"], dealt=True)["sentences"]
    return rows.groupBy("sentence_type", "min_days", "max_days", "min_assumed", "component_order").agg(F.count("*").alias("n"), F.count_distinct("doc").alias("docs"))


_add("sheet_sentences", "SELECT 'Probation' AS sentence_type, CASE WHEN docket_id % 7 <> 1 THEN 90 END::INT AS min_days, CASE WHEN docket_id % 7 <> 1 THEN 180 END::INT AS max_days, false AS min_assumed, 1::INT AS component_order, count(*) AS n, count(DISTINCT docket_number) AS docs FROM flat WHERE raw IS NOT NULL AND day IS NOT NULL AND docket_id % 5 <> 0 GROUP BY 2, 3", SHEET_CHARGES)


@query
def sheet_warnings(spark, sf_dir):
    """Warnings by place, on sheets some of whose judge lines are no names or name the defendant."""
    k = F.split_part("docket_number", F.lit("-"), F.lit(4)).cast("bigint") % 11
    first, second = F.get("pages", F.lit(0)), F.get("pages", F.lit(1))
    second = F.when(k == 3, F.replace(second, F.lit("Doe, Jane"), F.lit("Max of Roe"))).when(k == 4, F.replace(second, F.lit("Doe, Jane"), F.lit("Smith, Sam"))).otherwise(second)
    first = F.when(k == 5, F.replace(first, F.lit("Judge Assigned: Roe, Rick"), F.lit("Judge Assigned: Smith, Sam"))).when(k == 6, F.replace(first, F.lit("Judge Assigned: Roe, Rick"), F.lit("Judge Assigned: Max of Roe"))).otherwise(first)
    rows = sheets.parse_sheets(_sheets(spark, sf_dir).select("docket_number", F.array(first, second).alias("pages")), "salt", wanted=["warnings"], dealt=True)["warnings"]
    return rows.groupBy("code", "section", "page", "field").agg(F.count("*").alias("n"), F.count("charge_sequence").alias("placed"))


_add(
    "sheet_warnings",
    """
, good AS (SELECT *, raw IS NOT NULL AND day IS NOT NULL AS named FROM flat WHERE docket_id % 5 <> 0)
, found AS (SELECT 'UNPARSEABLE_DURATION' AS code, 'DISPOSITION SENTENCING/PENALTIES' AS section, 2 AS page, 'duration' AS field, count(*) AS n, count(*) AS placed FROM good WHERE named AND docket_id % 7 = 1
UNION ALL SELECT 'NON_TERMINAL_CASE', NULL, NULL, NULL, count(*), 0 FROM (SELECT docket_number FROM good GROUP BY 1 HAVING NOT bool_or(named))
UNION ALL SELECT 'MISSING_DISPOSITION_DATE', 'DISPOSITION SENTENCING/PENALTIES', 2, 'disposition_date', count(*), count(*) FROM good WHERE named AND raw = 'Held for Court'
UNION ALL SELECT 'SUSPECT_JUDGE_LINE', 'DISPOSITION SENTENCING/PENALTIES', 2, 'disposition_judge', count(*), count(*) FROM good WHERE named AND docket_id % 11 = 3
UNION ALL SELECT 'SENTINEL_COLLISION', 'DISPOSITION SENTENCING/PENALTIES', 2, 'disposition_judge', count(*), count(*) FROM good WHERE named AND docket_id % 11 = 4
UNION ALL SELECT 'SENTINEL_COLLISION', 'CASE INFORMATION', 1, 'assigned_judge', count(*), 0 FROM heads WHERE docket_id % 5 <> 0 AND docket_id % 11 = 5
UNION ALL SELECT 'SUSPECT_JUDGE_LINE', 'CASE INFORMATION', 1, 'assigned_judge', count(*), 0 FROM heads WHERE docket_id % 5 <> 0 AND docket_id % 11 = 6)
SELECT code, section, page::INT AS page, field, n, placed FROM found WHERE n > 0""",
    SHEET_CHARGES,
)


@query
def sheet_envelopes(spark, sf_dir):
    """Envelopes of all sheets, those that cannot be parsed with their error code, among texts that are no sheets."""
    d = B.table(spark, sf_dir, "documents").select(F.concat(F.lit("doc "), "doc_id").alias("docket_number"), F.array(F.coalesce("text", F.lit(""))).alias("pages"))
    printed = _sheets(spark, sf_dir)
    rows = sheets.envelopes(printed.unionByName(d.repartition(sheet_parts(spark, sf_dir), "docket_number")), "salt", dealt=True)
    return rows.groupBy("status", F.coalesce("error_code", F.lit("-")).alias("error_code")).agg(F.count("*").alias("n"), F.sum(F.size("charges")).alias("charges"), F.sum(F.size("sentences")).alias("sentences"))


_add(
    "sheet_envelopes",
    r"""
, good AS (SELECT * FROM flat WHERE docket_id % 5 <> 0)
SELECT 'parsed' AS status, '-' AS error_code, (SELECT count(DISTINCT docket_number) FROM good) AS n, (SELECT count(*) FROM good) AS charges, (SELECT count(*) FROM good WHERE raw IS NOT NULL AND day IS NOT NULL) AS sentences
UNION ALL SELECT 'failed', 'IDENTITY_NOT_FOUND', count(*), 0, 0 FROM heads WHERE docket_id % 5 = 0 HAVING count(*) > 0
UNION ALL SELECT 'failed', CASE WHEN length(regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g')) < 100 THEN 'LOW_TEXT_EXTRACTION' ELSE 'UNSUPPORTED_FORMAT' END, count(*), 0, 0 FROM documents GROUP BY 2""",
    SHEET_CHARGES,
)


@query
def repaired_dispositions(spark, sf_dir):
    p = B.table(spark, sf_dir, "part")
    raw = F.when(F.col("p_size") < 10, "Transferred to Another").when(F.col("p_size") < 20, "Dismissed - Rule 600 (Speedy").otherwise(F.col("p_type"))
    return p.groupBy(text.repaired_disposition(raw).alias("raw")).agg(F.count("*").alias("n"))


_add("repaired_dispositions", "SELECT CASE WHEN p_size < 10 THEN 'Transferred to Another Jurisdiction' WHEN p_size < 20 THEN 'Dismissed - Rule 600 (Speedy Trial)' ELSE p_type END AS raw, count(*) AS n FROM part GROUP BY 1")


@query
def sanitized_errors(spark, sf_dir):
    p = B.table(spark, sf_dir, "pages")
    path = F.concat(F.lit("/data/in/page-"), "page_id", F.lit(".html"))
    message = F.concat(F.lit("no "), path, F.lit(" in page-"), "page_id", F.when(F.col("page_id") % 2 == 0, F.repeat(F.lit("x"), 300)).otherwise(""))
    return p.select("page_id", text.sanitized_error(message, path).alias("error"))


_add("sanitized_errors", "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'no <redacted> in <redacted>' || repeat('x', 173) || '…' ELSE 'no <redacted> in <redacted>' END AS error FROM pages")


@query
def ended_charges(spark, sf_dir):
    rows = B.charges(spark, sf_dir)
    told = F.when(F.col("discount") >= 9, F.array(F.lit("Probation")))
    return rows.groupBy(eligibility.disposed(F.col("disposition_raw"), F.col("disposition_date"), told).alias("ended")).agg(F.count("*").alias("n"))


_add("ended_charges", "SELECT disposition_raw IS NOT NULL OR disposition_date IS NOT NULL OR discount >= 9 AS ended, count(*) AS n FROM charges GROUP BY 1", CHARGES)

# -- comparison ---------------------------------------------------------------------------------


def _two_parses(spark, sf_dir):
    """Charges of an old and a new parse: the new one lost dispositions at sequence 2 and rows at 5."""
    old = B.charges(spark, sf_dir).groupBy("docket_id", "sequence").agg(F.min("disposition_raw").alias("disposition_raw"))
    return old, old.where("sequence <> 5").withColumn("disposition_raw", F.when(F.col("sequence") != 2, F.col("disposition_raw")))


@query
def parse_regressions(spark, sf_dir):
    old, new = _two_parses(spark, sf_dir)
    n = lambda df, kind: df.agg(F.count("*").alias("n")).withColumn("kind", F.lit(kind))
    return n(compare.regressions(old, new), "lost").unionByName(n(compare.undisposed(old, new), "undisposed")).unionByName(n(compare.shrunk(old, new), "shrunk"))


_add(
    "parse_regressions",
    """
, old AS (SELECT docket_id, sequence, min(disposition_raw) AS raw FROM charges GROUP BY ALL)
SELECT 'lost' AS kind, count(*) AS n FROM old WHERE raw IS NOT NULL AND sequence IN (2, 5) UNION ALL SELECT 'undisposed', count(*) FROM old WHERE raw IS NOT NULL AND sequence = 2
UNION ALL SELECT 'shrunk', count(*) FROM (SELECT docket_id FROM old GROUP BY 1 HAVING bool_or(sequence = 5) AND bool_or(sequence <> 5))""",
    CHARGES,
)


@query
def lost_sequences(spark, sf_dir):
    """Disposed sequences of each docket that the new parse lacks."""
    return compare.lost_sequences(*_two_parses(spark, sf_dir)).select("docket_id", F.concat_ws(",", "lost").alias("lost"))


_add("lost_sequences", "SELECT docket_id, string_agg(sequence, ',' ORDER BY sequence) AS lost FROM (SELECT docket_id, sequence, min(disposition_raw) AS raw FROM charges GROUP BY ALL) WHERE raw IS NOT NULL AND sequence IN (2, 5) GROUP BY docket_id", CHARGES)


@query
def canonical_lists(spark, sf_dir):
    """Charges of dockets compared as lists without order, volatile keys left out."""
    rows = B.charges(spark, sf_dir)
    listed = lambda order: rows.groupBy("docket_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), F.struct("sequence", "statute", "quantity").alias("c")))), lambda x: x["c"]).alias("c"))
    a, b = listed(F.col("sequence")), listed(-F.col("sequence")).withColumnRenamed("c", "d")
    both = a.join(b, "docket_id")
    golden = lambda c: F.transform(c, lambda x: x.dropFields("quantity"))
    return both.agg(F.count("*").alias("dockets"), F.count_if(F.col("c") == F.col("d")).alias("same_order"), F.count_if(compare.canonical(F.col("c")) == compare.canonical(F.col("d"))).alias("same"), F.count_distinct(compare.canonical(golden(F.col("c")))).alias("kinds"))


_add("canonical_lists", "SELECT (SELECT count(DISTINCT docket_id) FROM charges) AS dockets, (SELECT count(*) FROM (SELECT docket_id FROM charges GROUP BY 1 HAVING min(sequence) = max(sequence))) AS same_order, (SELECT count(DISTINCT docket_id) FROM charges) AS same, (SELECT count(*) FROM (SELECT DISTINCT k FROM (SELECT docket_id, string_agg(sequence || '|' || statute, ';' ORDER BY sequence || '|' || statute) AS k FROM charges GROUP BY docket_id))) AS kinds", CHARGES)


@query
def golden_diff(spark, sf_dir):
    """Differences of orders against a copy whose volatile key is left out of the comparison."""
    o = B.table(spark, sf_dir, "orders").select("o_orderkey", F.struct("o_orderstatus", F.col("o_orderdate").alias("parsed_at")).alias("case"), "o_custkey")
    changed = o.withColumns({"case": F.col("case").withField("parsed_at", F.lit("2030-01-01").cast(o.select("case.parsed_at").schema[0].dataType)), "o_custkey": F.when(F.col("o_orderkey") % 10 == 0, F.lit(0).cast("bigint")).otherwise(F.col("o_custkey"))})
    return compare.deep_diff(o, changed, "o_orderkey", without={"parsed_at"}).groupBy("path", "kind").agg(F.count("*").alias("n"))


_add("golden_diff", "SELECT '$.o_custkey' AS path, 'value' AS kind, count(*) AS n FROM orders WHERE o_orderkey % 10 = 0 AND o_custkey <> 0 HAVING count(*) > 0")

# -- collection ---------------------------------------------------------------------------------


@query
def run_progress(spark, sf_dir):
    """Seconds still to go of every run, after each five windows."""
    rows = B.table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("run"), F.col("ts").cast("date").alias("day")).agg(F.count("*").alias("seconds"))
    return collector.progress(rows, 40).select("run", "day", "done", F.floor(F.col("seconds_left") * 100).cast("bigint").alias("centiseconds_left"))


_add("run_progress", "SELECT run, day, CAST(done AS INT) AS done, CAST(floor(m * (40 - done) * 100) AS BIGINT) AS centiseconds_left FROM (SELECT run, day, row_number() OVER w AS done, avg(s) OVER w AS m FROM (SELECT user_id AS run, CAST(ts AS DATE) AS day, count(*) AS s FROM events GROUP BY 1, 2) WINDOW w AS (PARTITION BY run ORDER BY day ROWS UNBOUNDED PRECEDING)) WHERE done % 5 = 0")


@query
def daily_outcomes(spark, sf_dir):
    """Attempts by day and outcome: the batch form of the daily stream."""
    return collector.daily_attempts(B.attempts(spark, sf_dir))


_add("daily_outcomes", "SELECT CAST(ts AS DATE) AS day, outcome, count(*) AS n FROM attempts GROUP BY ALL", ATTEMPTS)


@query
def fresh_targets(spark, sf_dir):
    """Targets once each that neither the ledger of hits nor that of misses knows."""
    a = B.attempts(spark, sf_dir)
    return collector.new_targets(a.select(F.col("run").alias("target")), a.where("outcome in ('hit', 'miss') and hour(ts) < 2").select(F.col("run").alias("target")), "target")


_add("fresh_targets", "SELECT DISTINCT run AS target FROM attempts WHERE run NOT IN (SELECT run FROM attempts WHERE outcome IN ('hit', 'miss') AND hour(ts) < 2)", ATTEMPTS)


@query
def applied_versions(spark, sf_dir):
    incoming, loaded = _versions(spark, sf_dir)
    rows = collector.applied_versions(incoming, loaded, [(1, 1), (1, 2)])
    return rows.groupBy("raw_status").agg(F.count("*").alias("n"), F.sum("version.record").alias("records"))


_add(
    "applied_versions",
    """
, incoming AS (SELECT CASE WHEN filed_date >= DATE '2000-01-01' THEN 'new' || docket_id ELSE CAST(docket_id AS VARCHAR) END AS h, docket_number, CASE WHEN grade IS NOT NULL THEN court END AS court, CASE grade WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 9 ELSE 2 END AS v, filed_date IS NULL AS failed, court = 'CP' AS same, coalesce(grade, '') <> '5-LOW' AS imported FROM dockets)
, loaded AS (SELECT CAST(docket_id AS VARCHAR) AS h, docket_number, CASE WHEN grade IS NOT NULL THEN court END AS court, CASE WHEN court = 'CP' THEN 2 ELSE 1 END AS v, CASE WHEN filed_date < DATE '1995-06-01' THEN 'parse_superseded' ELSE 'parsed' END AS status FROM dockets WHERE filed_date < DATE '2001-01-01')
, twins AS (SELECT docket_number, court FROM loaded WHERE status = 'parsed' GROUP BY ALL)
, decided AS (SELECT i.*, l.h IS NOT NULL AS was, CASE WHEN i.v NOT IN (1, 2) THEN 'reject' WHEN NOT imported THEN 'missing' WHEN failed THEN 'raw_only' WHEN l.status = 'parse_superseded' THEN 'stale' WHEN l.h IS NULL AND t.docket_number IS NOT NULL THEN 'supersede' WHEN l.h IS NULL THEN 'load' WHEN i.v > l.v THEN 'replace' ELSE 'other' END AS d
  FROM incoming i LEFT JOIN loaded l ON i.h = l.h LEFT JOIN twins t ON i.docket_number = t.docket_number AND i.court IS NOT DISTINCT FROM t.court)
, taken AS (SELECT h, v, CASE WHEN d = 'raw_only' THEN 'failed' ELSE 'parsed' END AS status FROM decided WHERE d IN ('load', 'supersede', 'replace') OR (d = 'raw_only' AND NOT was))
, kept AS (SELECT v, CASE WHEN status = 'parsed' AND EXISTS (SELECT 1 FROM decided x WHERE x.d = 'supersede' AND x.docket_number = l.docket_number AND x.court IS NOT DISTINCT FROM l.court) THEN 'parse_superseded' ELSE status END AS status FROM loaded l WHERE h NOT IN (SELECT h FROM taken))
SELECT status AS raw_status, count(*) AS n, CAST(sum(v) AS BIGINT) AS records FROM (SELECT v, status FROM taken UNION ALL SELECT v, status FROM kept) GROUP BY status""",
    DOCKETS,
)


@query
def corpus_order(spark, sf_dir):
    """Place of every charge in the whole corpus: by docket, sequence and id."""
    rows = B.charges(spark, sf_dir).select("charge_id", "docket_id", "sequence", "filed_date")
    return collector.in_corpus_order(rows, []).select("charge_id", "place", F.date_format("filed_date", "yyyy-MM-dd").alias("filed"))


_add("corpus_order", "SELECT charge_row AS charge_id, row_number() OVER (ORDER BY docket_id, sequence, charge_row) AS place, strftime(filed_date, '%Y-%m-%d') AS filed FROM charges", CHARGES)
