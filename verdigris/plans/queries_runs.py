"""Registered queries on the life of runs, the operations panel, served results and validation, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import vocab as V
from ..functions import numbers, text
from ..operators import aggregates as A
from ..operators import checks, facts, linkage, matching, panel, reports, review
from . import bindings as B
from . import runs, serve, tables
from .oracle_base import CHARGES, DOCKETS, FACTS, FLOOR, SENTENCES, pct
from .oracles import ATTEMPTS, CONVICTION, CORPUS, MONTHS, QUEUE, _add
from .queries import _component_distribution, _corpus, _identities, _outcome_distribution, _queue_items, _versions, query

# -- life of a run ------------------------------------------------------------------------------

RUN_TABLES = ["charge_outcomes", "pair_outcomes"]


def _life(spark, sf_dir) -> tuple[tables.RunStore, DataFrame]:
    """Runs that complete, fail while they write, fail their checks, publish nothing, and are pruned."""
    store = tables.RunStore(spark, tables.shared_root(spark, "runs"))
    own = B.outcomes(spark, sf_dir)  # built once and stored; every aggregate reads them back
    charge, pair = (lambda: _outcome_distribution(own, B.CHARGE)), (lambda: _outcome_distribution(own, B.PAIR))
    broken = lambda: charge().withColumn("charge_id", F.raise_error(F.lit("a table that fails")).cast("string"))
    unsound = lambda: checks.distribution_integrity(charge().withColumn("count", F.col("count") + 1), "charge_outcomes", B.CHARGE, floor=B.FLOOR)
    store.build("r1", dict(zip(RUN_TABLES, (charge, pair), strict=True)), "2025-01-01", checks=lambda: checks.distribution_integrity(store.read("charge_outcomes", "r1"), "charge_outcomes", B.CHARGE, floor=B.FLOOR), taxonomy_version=V.TAXONOMY_VERSION)
    store.publish("2025-01-02")
    try:
        store.build("r2", dict(zip(RUN_TABLES, (charge, broken), strict=True)), "2025-01-03")
    except Exception:  # noqa: BLE001 - the failure is the point: the run must leave no rows
        pass
    store.build("r3", {"charge_outcomes": charge}, "2025-01-04", checks=unsound)
    store.build("r4", {"charge_outcomes": charge, "pair_outcomes": pair}, "2025-01-05")
    store.write("pair_outcomes", store.read("pair_outcomes", "r4").limit(0), "r4")  # no rows replace the old ones
    store.publish("2025-01-06")
    preview = store.prune(RUN_TABLES, ["r1"], dry_run=False)
    return store, preview


@query
def run_life(spark, sf_dir):
    store, preview = _life(spark, sf_dir)
    rows = store.runs().where("status = 'failed' or id in ('r1', 'r4')").select("id", "status", F.expr(runs.ACTIVE).alias("active"), F.col("invalidated_reason"))
    counts = [store.row_counts(RUN_TABLES, r).withColumn("id", F.lit(r)) for r in ("r1", "r2", "r3", "r4")]
    every = counts[0].union(counts[1]).union(counts[2]).union(counts[3])
    gone = preview.select("table", "rows", F.concat("run_id", F.lit(" pruned")).alias("id"))
    return every.unionByName(gone).join(rows, "id", "left")


@query
def recent_runs(spark, sf_dir):
    store, _ = _life(spark, sf_dir)
    return runs.recent(store.runs(), 3).select("id", "status").unionByName(runs.latest(store.runs()).select("id", F.lit("latest completed").alias("status"))).unionByName(runs.active(store.runs()).select("id", F.lit("active").alias("status")))


COUNTS = f"""{FACTS},
c AS (SELECT count(*) AS n FROM (SELECT DISTINCT charge_id, category FROM facts WHERE public_eligible)),
p AS (SELECT count(*) AS n FROM (SELECT DISTINCT charge_id, judge_id, category FROM facts WHERE judge_specific_eligible))"""
_add(
    "run_life",
    """
SELECT id, "table", CASE size WHEN 'c' THEN c.n WHEN 'p' THEN p.n ELSE 0 END AS rows, status, active, reason AS invalidated_reason
FROM (VALUES ('r1', 'charge_outcomes', '', 'completed', false, 'superseded'), ('r1', 'pair_outcomes', '', 'completed', false, 'superseded'), ('r2', 'charge_outcomes', '', 'failed', false, NULL), ('r2', 'pair_outcomes', '', 'failed', false, NULL), ('r3', 'charge_outcomes', '', 'failed', false, NULL), ('r3', 'pair_outcomes', '', 'failed', false, NULL),
  ('r4', 'charge_outcomes', 'c', 'completed', true, NULL), ('r4', 'pair_outcomes', '', 'completed', true, NULL), ('r1 pruned', 'charge_outcomes', 'c', NULL, NULL, NULL), ('r1 pruned', 'pair_outcomes', 'p', NULL, NULL, NULL)) v(id, "table", size, status, active, reason), c, p""",
    COUNTS,
)
_add("recent_runs", "SELECT * FROM (VALUES ('r4', 'completed'), ('r3', 'failed'), ('r2', 'failed'), ('r4', 'latest completed'), ('r4', 'active')) v(id, status)")


@query
def upserted_rows(spark, sf_dir):
    """Suppliers of even nations arrive anew, some with another balance; keys beyond the table are inserted."""
    s = B.table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", F.floor("s_acctbal").alias("balance"))
    new = s.where("s_nationkey % 2 = 0").withColumn("balance", F.when(F.col("balance") > 5000, F.col("balance") + 1).otherwise(F.col("balance"))).unionByName(s.where("s_nationkey = 0").withColumn("s_suppkey", F.col("s_suppkey") + 1_000_000_000))
    return runs.upsert_where_changed(s, new, "s_suppkey").groupBy("change").agg(F.count("*").alias("n"), F.sum("balance").alias("balance"))


_add("upserted_rows", "SELECT change, count(*) AS n, CAST(sum(b) AS BIGINT) AS balance FROM (SELECT CASE WHEN s_nationkey % 2 <> 0 THEN 'kept' WHEN floor(s_acctbal) > 5000 THEN 'updated' ELSE 'unchanged' END AS change, floor(s_acctbal) + CASE WHEN s_nationkey % 2 = 0 AND floor(s_acctbal) > 5000 THEN 1 ELSE 0 END AS b FROM supplier UNION ALL SELECT 'inserted', floor(s_acctbal) FROM supplier WHERE s_nationkey = 0) GROUP BY change")


@query
def merged_documents(spark, sf_dir):
    """Source documents by file hash: later imports take the place of earlier ones."""
    p = B.table(spark, sf_dir, "pages").select(F.sha2("html", 256).alias("file_hash"), "page_id")
    old = p.groupBy("file_hash").agg(F.min("page_id").alias("page_id"))
    new = p.where("page_id % 3 = 0").groupBy("file_hash").agg(F.max("page_id").alias("page_id"))
    return runs.upsert(old, new, "file_hash")


_add("merged_documents", "WITH p AS (SELECT sha256(html) AS file_hash, page_id FROM pages), a AS (SELECT file_hash, min(page_id) AS page_id FROM p GROUP BY 1), b AS (SELECT file_hash, max(page_id) AS page_id FROM p WHERE page_id % 3 = 0 GROUP BY 1) SELECT file_hash, coalesce(b.page_id, a.page_id) AS page_id FROM a LEFT JOIN b USING (file_hash)")


@query
def seed_sweep(spark, sf_dir):
    """Nations as seeded rows; region 1 has left the registry, and customers still point at some."""
    n, c = B.table(spark, sf_dir, "nation"), B.table(spark, sf_dir, "customer")
    used = c.where("c_acctbal > 9500").select(F.col("c_nationkey").alias("n_nationkey"))
    return runs.sweep(n, n.where("n_regionkey not in (1, 2)"), "n_nationkey", [used])


_add("seed_sweep", "SELECT n_nationkey, CASE WHEN n_regionkey NOT IN (1, 2) THEN 'keep' WHEN n_nationkey IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9500) THEN 'blocked' ELSE 'delete' END AS action FROM nation")

# -- operations panel ---------------------------------------------------------------------------


@query
def ops_versions(spark, sf_dir):
    return panel.version_pairs(_versions(spark, sf_dir)[0])


_add("ops_versions", "SELECT 1::INT AS envelope, CASE grade WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 9 ELSE 2 END::INT AS record, count(*) AS n FROM dockets GROUP BY 2", DOCKETS)


@query
def ops_source_status(spark, sf_dir):
    size = F.length("html")
    status = F.when(size < 1500, "invalid").when(F.contains("url", F.lit("/en/")), "imported").otherwise("duplicate")
    return panel.source_status(B.table(spark, sf_dir, "pages"), status, size)


_add("ops_source_status", "SELECT CASE WHEN length(html) < 1500 THEN 'invalid' WHEN contains(url, '/en/') THEN 'imported' ELSE 'duplicate' END AS status, count(*) AS n, CAST(coalesce(sum(length(html)), 0) AS BIGINT) AS bytes FROM pages GROUP BY 1")


@query
def ops_charge_totals(spark, sf_dir):
    return panel.charge_totals(_outcome_distribution(B.outcomes(spark, sf_dir), B.CHARGE), A.volume_funnel(_corpus(spark, sf_dir)))


FUNNEL = f"""{CORPUS},
funnel AS (SELECT charge_id, count(*) FILTER (stage <> 'folded') AS charges_seen, count(*) FILTER (stage = 'outcome') AS outcomes_recorded, count(*) FILTER (stage = 'held') AS held_for_court, count(*) FILTER (stage = 'pending') AS still_pending, count(*) FILTER (stage = 'excluded') AS disposed_excluded, count(*) FILTER (stage = 'folded') AS held_superseded FROM corpus WHERE charge_id IS NOT NULL AND stage <> 'before_floor' GROUP BY charge_id HAVING count(*) FILTER (stage <> 'folded') > 0),
cells AS (SELECT charge_id, count(*) AS n FROM corpus WHERE stage = 'outcome' GROUP BY charge_id)"""
SUMS = ", ".join(f"CAST(coalesce(sum({c}), 0) AS BIGINT) AS {c}" for c in ("charges_seen", "outcomes_recorded", "held_for_court", "still_pending", "disposed_excluded", "held_superseded"))
# a public fact need not be in the funnel's order of stages, so sizes come from the facts
_add("ops_charge_totals", f"SELECT (SELECT count(DISTINCT charge_id) FROM gate) AS charges, (SELECT count(*) FROM (SELECT charge_id FROM gate GROUP BY 1 HAVING count(*) < 10)) AS thin_charges, {SUMS} FROM funnel", FUNNEL + f", gate AS (SELECT charge_id FROM charges WHERE category IS NOT NULL AND category <> 'unknown' AND charge_id IS NOT NULL AND NOT review AND disposition_date >= DATE '1998-01-01' AND filed_date >= {FLOOR})")


@query
def ops_top_charges(spark, sf_dir):
    return panel.top_charges(_outcome_distribution(B.outcomes(spark, sf_dir), B.CHARGE))


_add("ops_top_charges", "SELECT charge_id, count(*) AS n, count(*) < 10 AS thin FROM facts WHERE public_eligible GROUP BY charge_id ORDER BY n DESC, charge_id LIMIT 12", FACTS)


@query
def ops_judge_totals(spark, sf_dir):
    return panel.judge_totals(_outcome_distribution(B.outcomes(spark, sf_dir), B.PAIR))


_add("ops_judge_totals", "SELECT count(DISTINCT judge_id) AS judges, count(*) AS pairs, count(*) FILTER (n < 10) AS thin_pairs FROM (SELECT charge_id, judge_id, count(*) AS n FROM facts WHERE judge_specific_eligible GROUP BY 1, 2)", FACTS)


@query
def ops_queue(spark, sf_dir):
    return panel.queue_counts(_review_items(spark, sf_dir).withColumn("status", F.lit("open")))


@query
def ops_row_counts(spark, sf_dir):
    """Rows of every table of the active run."""
    own, parts = B.facts(spark, sf_dir)
    store = tables.RunStore(spark, tables.shared_root(spark, "runs"))
    made = {"charge_outcomes": lambda: _outcome_distribution(own, B.CHARGE), "charge_components": lambda: _component_distribution(parts, B.CHARGE), "grade_mix": lambda: A.grade_mix(own)}
    store.build("a", made, "2025-01-01")
    store.publish("2025-01-02")
    return store.row_counts([*made, "volume"], store.active_id())


_add("ops_row_counts", f"SELECT 'charge_outcomes' AS \"table\", (SELECT count(*) FROM (SELECT DISTINCT charge_id, category FROM facts WHERE public_eligible)) AS rows UNION ALL SELECT 'charge_components', (SELECT count(*) FROM (SELECT DISTINCT charge_id, scategory FROM components WHERE public_eligible)) UNION ALL SELECT 'grade_mix', (SELECT count(*) FROM (SELECT DISTINCT charge_id, coalesce(grade, 'ungraded') FROM facts WHERE public_eligible AND {CONVICTION})) UNION ALL SELECT 'volume', 0", SENTENCES)


@query
def ops_live_checks(spark, sf_dir):
    """Checks over the active run's tables as they are, and over tables in which each of the seven is hurt."""
    made = B.built(spark, sf_dir)
    own, parts, seen = made["outcomes"].table("outcomes"), made["components"].table("components"), made["charges"].rows("charges")
    store = tables.RunStore(spark, tables.shared_root(spark, "runs"))
    store.build("a", {"charge_outcomes": lambda: _outcome_distribution(own, B.CHARGE), "charge_index": lambda: A.index_summary(own, parts, B.CHARGE, eligible="public_eligible"), "charge_volume": lambda: A.volume_funnel(_corpus(spark, sf_dir))}, "2025-01-01")
    store.publish("2025-01-02")
    run, volume, charge, summary = store.runs(), store.read("charge_volume", "a"), store.read("charge_outcomes", "a"), store.read("charge_index", "a")
    live, pointers = B.charges(spark, sf_dir, origins=True), linkage.supersessions(B.charges(spark, sf_dir, origins=True))
    sound = panel.live_checks(run, volume, charge, summary, live, seen, pointers)
    up = lambda c, cond: F.col(c) + cond.cast("int")
    key = F.col("charge_id")
    hurt = panel.live_checks(
        run.unionByName(run.withColumn("id", F.lit("b"))),
        volume.withColumns({"charges_seen": up("charges_seen", key < "Brand#2"), "outcomes_recorded": up("outcomes_recorded", key >= "Brand#4")}),
        charge.withColumn("count", up("count", F.col("category_code") == "withdrawn")),
        summary.withColumn("wedge_count", up("wedge_count", F.endswith(key, F.lit("3")))),
        live,
        seen - 1,
        pointers.withColumn("superseded_by", F.when(F.startswith("mc_charge_id", F.lit("1")), F.col("mc_charge_id")).otherwise(F.col("superseded_by"))),
    )
    return sound.withColumn("rows", F.lit("sound")).unionByName(hurt.withColumn("rows", F.lit("hurt")))


LIVE = SENTENCES + ",\nclaims AS" + FUNNEL.split("claims AS", 1)[1]
_add(
    "ops_live_checks",
    f"""
, samples AS (SELECT charge_id, count(*) AS s FROM facts WHERE public_eligible GROUP BY charge_id)
, conv AS (SELECT charge_id, count(*) AS c, count(*) FILTER (charge_row IN (SELECT charge_row FROM components WHERE public_eligible)) AS s, count(*) FILTER (charge_row NOT IN (SELECT charge_row FROM components WHERE public_eligible)) AS w FROM facts WHERE public_eligible AND {CONVICTION} GROUP BY charge_id)
, v AS (SELECT funnel.*, coalesce(s, 0) AS s, outcomes_recorded + held_for_court + still_pending + disposed_excluded AS stages FROM funnel LEFT JOIN samples USING (charge_id))
, h AS (SELECT charge_id, charges_seen + (charge_id < 'Brand#2')::INT AS seen, stages + (charge_id >= 'Brand#4')::INT AS stages, outcomes_recorded + (charge_id >= 'Brand#4')::INT AS recorded, s FROM v)
SELECT name, l AS left_n, r AS right_n, l = r AS passed, rows FROM (
  SELECT 'sound' AS rows, unnest(['one_active_published_run', 'volume_closure', 'volume_matches_percentages', 'outcome_counts_sum_to_sample', 'wedge_identity', 'corpus_unchanged_since_build', 'no_self_supersession']) AS name,
    unnest([1, (SELECT count(*) FROM v WHERE stages <> charges_seen), (SELECT count(*) FROM v WHERE outcomes_recorded <> s), (SELECT count(*) FROM (SELECT charge_id, sum(n) AS t FROM (SELECT charge_id, category, count(*) AS n FROM facts WHERE public_eligible GROUP BY ALL) GROUP BY 1) JOIN samples USING (charge_id) WHERE t <> s), (SELECT count(*) FROM conv WHERE s + w <> c), (SELECT count(*) FROM charges), (SELECT count(*) FROM stages WHERE stage = 'superseded' AND mc_id = cp)]) AS l,
    unnest([1, 0, 0, 0, 0, (SELECT count(*) FROM lineitem), 0]) AS r
  UNION ALL SELECT 'hurt', unnest(['one_active_published_run', 'volume_closure', 'volume_matches_percentages', 'outcome_counts_sum_to_sample', 'wedge_identity', 'corpus_unchanged_since_build', 'no_self_supersession']),
    unnest([2, (SELECT count(*) FROM h WHERE stages <> seen), (SELECT count(*) FROM h WHERE recorded <> s), (SELECT count(DISTINCT charge_id) FROM facts WHERE public_eligible AND category = 'withdrawn'), (SELECT count(*) FROM conv WHERE charge_id LIKE '%3'), (SELECT count(*) FROM charges), (SELECT count(*) FROM stages WHERE stage = 'superseded' AND starts_with(mc_id, '1'))]),
    unnest([1, 0, 0, 0, 0, (SELECT count(*) - 1 FROM lineitem), 0]))""",
    LIVE,
)


@query
def ops_unmatched_values(spark, sf_dir):
    """The most frequent offenses and statutes that no roster entry fits."""
    parts = B.table(spark, sf_dir, "part").select(F.col("p_name").alias("offense"), F.concat(F.lit("18 § "), F.col("p_type")).alias("statute"))
    rows = matching.match_charges(parts, B.roster(spark)).where(F.col("charge.method") == V.UNMATCHED)
    return panel.top_values(reports.value_counts(rows, ["offense", "statute"]), 5)


_add(
    "ops_unmatched_values",
    r"""
SELECT * FROM (SELECT col AS "column", value, n, CAST(row_number() OVER (PARTITION BY col ORDER BY n DESC, value) AS INT) AS place FROM (
  SELECT 'offense' AS col, offense AS value, count(*) AS n FROM gone GROUP BY 2 UNION ALL SELECT 'statute', statute, count(*) FROM gone GROUP BY 2)) WHERE place <= 5""",
    r"""words AS (SELECT p_name AS offense, '18 § ' || p_type AS statute, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) AS k, p_type FROM part),
gone AS (SELECT offense, statute FROM words WHERE k NOT IN ('small ring', 'tiny ring', 'red ring', 'red bolt', 'old bolt', 'blue bolt', 'hot gear', 'cold gear', 'promotion', 'large a', 'large b', 'anvil') AND p_type NOT IN ('ECONOMY', 'SMALL', 'MEDIUM', 'PROMO', 'LARGE'))""",
)


@query
def folded_preview(spark, sf_dir):
    return A.folded_preview(A.volume_funnel(_corpus(spark, sf_dir)))


_add("folded_preview", "SELECT charge_id, held_superseded, charges_seen FROM funnel ORDER BY held_superseded DESC, charge_id LIMIT 10", FUNNEL)

# -- served results -----------------------------------------------------------------------------

_shown = lambda rows, item: F.array_join(F.transform(rows, item), ", ")
_outcome_text = lambda c: _shown(c, lambda x: F.concat_ws(":", x["category_code"], x["count"].cast("string")))


@query
def result_charge(spark, sf_dir):
    own, parts = B.facts(spark, sf_dir)
    grades = A.grade_mix(own)
    known = _identities(spark, sf_dir).unionByName(spark.createDataFrame([("none", "none", "None", [], "")], "id string, slug string, display_name string, aliases array<string>, statute string"))
    rows = serve.charge_result(known, _outcome_distribution(own, B.CHARGE), A.index_summary(own, parts, B.CHARGE, eligible="public_eligible"), A.index_categories(own, parts, B.CHARGE, eligible="public_eligible"), grades, A.volume_funnel(_corpus(spark, sf_dir)))
    index = _shown(F.col("index"), lambda x: F.concat_ws(":", x["category_code"], x["conviction_count"].cast("string"), (x["median_min_months"] * 10).cast("int").cast("string")))
    listed = _shown(F.col("grades"), lambda x: F.concat_ws(":", x["grade"], x["count"].cast("string")))
    return rows.select("charge_id", "arm", "sample_size", "is_thin_data", "uniform", _outcome_text(F.col("outcomes")).alias("outcomes"), F.col("summary.convictions").alias("convictions"), F.col("summary.wedge_count").alias("wedge"), index.alias("index"), listed.alias("grades"), F.col("volume.charges_seen").alias("charges_seen"))


ORDER = "list_position(['dismissed', 'withdrawn', 'guilty_plea', 'guilty_verdict', 'acquittal', 'ard', 'diversion', 'other'], category)"
BLOCKS = f"""
, cats AS (SELECT charge_id, category, count(*) AS n FROM facts WHERE public_eligible GROUP BY ALL)
, outs AS (SELECT charge_id, CAST(sum(n) AS BIGINT) AS size, string_agg(category || ':' || n, ', ' ORDER BY {ORDER}) AS txt FROM cats GROUP BY charge_id)"""
_add(
    "result_charge",
    f"""{BLOCKS}
, conv AS (SELECT charge_id, count(*) AS c, count(*) FILTER (charge_row NOT IN (SELECT charge_row FROM components WHERE public_eligible)) AS w FROM facts WHERE public_eligible AND {CONVICTION} GROUP BY charge_id)
, idx AS (SELECT charge_id, scategory, count(DISTINCT charge_row) AS n, {MONTHS.format("median(min_days) FILTER (min_days IS NOT NULL)")} AS m FROM components WHERE public_eligible AND parent_public GROUP BY ALL)
, idxs AS (SELECT charge_id, string_agg(concat_ws(':', scategory, n, CAST(m * 10 AS INT)), ', ' ORDER BY scategory) AS txt FROM idx GROUP BY charge_id)
, gr AS (SELECT charge_id, coalesce(grade, 'ungraded') AS g, count(*) AS n FROM facts WHERE public_eligible AND {CONVICTION} GROUP BY ALL)
, grs AS (SELECT charge_id, string_agg(g || ':' || n, ', ' ORDER BY n DESC, g) AS txt FROM gr GROUP BY charge_id)
, ids AS (SELECT DISTINCT p_brand AS charge_id FROM part UNION ALL SELECT 'none')
SELECT ids.charge_id, CASE WHEN size IS NOT NULL THEN 'success' WHEN charges_seen IS NOT NULL THEN 'volume_only' ELSE 'unavailable' END AS arm, size AS sample_size, size < 10 AS is_thin_data, CASE WHEN size IS NOT NULL THEN true END AS uniform, outs.txt AS outcomes, c AS convictions, w AS wedge, idxs.txt AS "index", grs.txt AS grades, charges_seen
FROM ids LEFT JOIN outs USING (charge_id) LEFT JOIN conv USING (charge_id) LEFT JOIN idxs USING (charge_id) LEFT JOIN grs USING (charge_id) LEFT JOIN funnel USING (charge_id)""",
    SENTENCES + ",\nclaims AS" + FUNNEL.split("claims AS", 1)[1],
)


@query
def result_judge(spark, sf_dir):
    own = B.outcomes(spark, sf_dir)
    pairs = B.charges(spark, sf_dir).where("judge_id is not null").select(F.coalesce("normalized_charge_id", "statute").alias("charge_id"), "judge_id").distinct()
    rows = serve.judge_result(pairs, _outcome_distribution(own, B.CHARGE), _outcome_distribution(own, B.PAIR))
    return rows.select("charge_id", "judge_id", "state", "sample_size", "is_thin_data", "baseline_size", _outcome_text(F.col("outcomes")).alias("outcomes"), _outcome_text(F.col("baseline")).alias("baseline"))


_add(
    "result_judge",
    f"""{BLOCKS}
, pc AS (SELECT charge_id, judge_id, category, count(*) AS n FROM facts WHERE judge_specific_eligible GROUP BY ALL)
, pouts AS (SELECT charge_id, judge_id, CAST(sum(n) AS BIGINT) AS psize, string_agg(category || ':' || n, ', ' ORDER BY {ORDER}) AS ptxt FROM pc GROUP BY ALL)
, pairs AS (SELECT DISTINCT coalesce(charge_id, statute) AS charge_id, judge_id FROM charges WHERE judge_id IS NOT NULL)
SELECT charge_id, judge_id, CASE WHEN size IS NULL THEN 'unavailable' WHEN psize IS NULL THEN 'baseline_only' ELSE 'success' END AS state, psize AS sample_size, psize < 10 AS is_thin_data, size AS baseline_size, ptxt AS outcomes, txt AS baseline
FROM pairs LEFT JOIN outs USING (charge_id) LEFT JOIN pouts USING (charge_id, judge_id)""",
    FACTS,
)


@query
def result_integrity(spark, sf_dir):
    """Served rows as they are, and once hurt: unknown outcomes shown, sizes shifted, a charge's baseline cut."""
    own, parts = B.facts(spark, sf_dir)
    charge, pair = _outcome_distribution(own, B.CHARGE), _outcome_distribution(own, B.PAIR)
    index = A.index_categories(own, parts, B.CHARGE, eligible="public_eligible")
    hurt = charge.where("category_code <> 'withdrawn'").withColumns({"sample_size": F.col("sample_size") + (F.col("category_code") == "guilty_plea").cast("int"), "category_code": F.when(F.col("category_code") == "dismissed", "unknown").otherwise(F.col("category_code"))})
    return serve.integrity(charge, B.CHARGE, pair, index).withColumn("rows", F.lit("sound")).unionByName(serve.integrity(hurt, B.CHARGE, pair, index.withColumn("median_max_days", F.lit(None).cast("double"))).withColumn("rows", F.lit("hurt")))


_add(
    "result_integrity",
    """
, cats AS (SELECT charge_id, category, count(*) AS n FROM facts WHERE public_eligible GROUP BY ALL)
, left_ AS (SELECT * FROM cats WHERE category <> 'withdrawn')
SELECT code, 'sound' AS rows, 0::BIGINT AS violations FROM (VALUES ('sample_size_not_uniform'), ('code_not_public'), ('duration_trio_broken'), ('baseline_not_superset')) v(code)
UNION ALL SELECT 'sample_size_not_uniform', 'hurt', (SELECT count(*) FROM (SELECT charge_id FROM left_ GROUP BY 1 HAVING count(*) > 1 AND bool_or(category = 'guilty_plea')))
UNION ALL SELECT 'code_not_public', 'hurt', (SELECT count(*) FROM left_ WHERE category = 'dismissed')
UNION ALL SELECT 'duration_trio_broken', 'hurt', (SELECT count(*) FROM (SELECT charge_id, scategory FROM components WHERE public_eligible AND parent_public GROUP BY ALL HAVING count(min_days) > 0))
UNION ALL SELECT 'baseline_not_superset', 'hurt', (SELECT count(*) FROM (SELECT DISTINCT charge_id, judge_id, category FROM facts WHERE judge_specific_eligible AND category IN ('withdrawn', 'dismissed')))""",
    SENTENCES,
)


@query
def grade_order(spark, sf_dir):
    return A.grades_in_order(A.grade_mix(B.outcomes(spark, sf_dir))).select("charge_id", "place", "grade", "count")


_add("grade_order", f"SELECT charge_id, CAST(row_number() OVER (PARTITION BY charge_id ORDER BY count(*) DESC, coalesce(grade, 'ungraded')) AS INT) AS place, coalesce(grade, 'ungraded') AS grade, count(*) AS count FROM facts WHERE public_eligible AND {CONVICTION} GROUP BY charge_id, coalesce(grade, 'ungraded')", FACTS)


@query
def judge_search(spark, sf_dir):
    return serve.search(B.judge_roster(spark, sf_dir).withColumn("slug", F.lower("id")), "Building M", 25, by_statute=False)


_add("judge_search", "SELECT * FROM (SELECT n_nationkey || '-Building-M' AS id, lower(n_nationkey || '-Building-M') AS slug, 'Building M. ' || replace(n_name, '_', '-') AS display_name, 2::INT AS match_rank, NULL::VARCHAR AS matched_alias FROM nation) ORDER BY display_name, slug LIMIT 25")


@query
def entry_lookups(spark, sf_dir):
    """Lookups by slug, by id form and by a needle in two columns."""
    known = _identities(spark, sf_dir)
    n = lambda df, name: df.agg(F.count("*").alias("n")).withColumn("lookup", F.lit(name))
    return n(serve.by_id_or_slug(known, "brand#11"), "slug").unionByName(n(serve.by_id_or_slug(known, "0f0e0d0c-0000-0000-0000-000000000000"), "id")).unionByName(n(serve.contains_filter(known, " #1 ", "display_name", "statute"), "needle")).unionByName(n(serve.contains_filter(known, "  ", "statute"), "blank"))


_add("entry_lookups", "SELECT count(*) FILTER (slug = 'brand#11') AS n, 'slug' AS lookup FROM identities UNION ALL SELECT 0, 'id' UNION ALL SELECT count(*) FILTER (contains(lower(id), '#1') OR contains(lower(statute), '#1')), 'needle' FROM identities UNION ALL SELECT count(*), 'blank' FROM identities", "identities AS (SELECT p_brand AS id, lower(p_brand) AS slug, min(p_type) AS statute FROM part GROUP BY p_brand)")


@query
def public_definitions(spark, sf_dir):
    """Public categories with the facts that each has, and what the pages say of the method."""
    own = B.outcomes(spark, sf_dir)
    n = own.where("public_eligible").groupBy(F.col("outcome_category_code").alias("value")).agg(F.count("*").alias("n"))
    named = serve.definitions(spark).select(F.col("sort_order").cast("string").alias("key"), F.col("code").alias("value")).join(n, "value", "left").select("key", "value", F.coalesce("n", F.lit(0)).alias("n"))
    last = own.where("public_eligible").agg(F.max("disposition_date").cast("string").alias("value")).select(F.lit("data_end").alias("key"), "value", F.lit(None).cast("long").alias("n"))
    return named.unionByName(serve.methodology(spark, {"data_start": B.FLOOR}).withColumn("n", F.lit(None).cast("long"))).unionByName(last)


_add("public_definitions", "SELECT key, value, CASE WHEN length(key) = 1 THEN (SELECT count(*) FROM facts WHERE public_eligible AND category = value) END AS n FROM (VALUES ('1', 'dismissed'), ('2', 'withdrawn'), ('3', 'guilty_plea'), ('4', 'guilty_verdict'), ('5', 'acquittal'), ('6', 'ard'), ('7', 'diversion'), ('8', 'other'), ('taxonomy_version', '1.0.0'), ('thin_sample', '10'), ('data_start', '1996-01-01')) v(key, value) UNION ALL SELECT 'data_end', CAST(max(disposition_date) AS VARCHAR), NULL FROM facts WHERE public_eligible", FACTS)

# -- validation ---------------------------------------------------------------------------------


@query
def floor_stops(spark, sf_dir):
    own = B.outcomes(spark, sf_dir)
    return A.floor_violations(own, date="disposition_date", eligible="public_eligible", floor="1998-07-01").withColumn("gate", F.lit("public")).unionByName(A.floor_violations(own, date="disposition_date", eligible="mvp_eligible", floor=B.WINDOW).withColumn("gate", F.lit("mvp")))


_add("floor_stops", "SELECT count(*) FILTER (public_eligible AND disposition_date < DATE '1998-07-01') AS violations, 'public' AS gate FROM facts UNION ALL SELECT count(*) FILTER (mvp_eligible AND charge_id IS NULL), 'mvp' FROM facts", FACTS)


@query
def build_stops(spark, sf_dir):
    """A corpus of two parser versions, wrong taxonomies, sentences of held charges, and durations that drifted."""
    rows = B.charges(spark, sf_dir)
    own = facts.outcome_facts(rows, window=B.WINDOW, floor=B.FLOOR)
    sentences = B.sentences(rows)
    parts = facts.component_facts(sentences, own, window=B.WINDOW, floor=B.FLOOR).withColumn("max_days", F.when(F.col("sentencing_category_code") == "incarceration", F.lit(1)).otherwise(F.col("max_days")))
    held = rows.where("disposition_raw = 'Held for Court' and sequence = 1").select(F.col("charge_id").alias("outcome_id"))
    corpus = rows.withColumns({"parser_version": F.when(F.col("court") == "CP", 1).otherwise(2), "taxonomy_version": F.when(F.col("sequence") == 2, None).otherwise(F.lit(V.TAXONOMY_VERSION))})
    return checks.build_stops(corpus, own, sentences.unionByName(held, allowMissingColumns=True), parts, V.TAXONOMY_VERSION)


_add(
    "build_stops",
    "SELECT 'empty_corpus' AS code, 0::BIGINT AS violations UNION ALL SELECT 'mixed_corpus', (SELECT count(DISTINCT court) - 1 FROM charges) UNION ALL SELECT 'taxonomy_mismatch', (SELECT count(*) FROM charges WHERE sequence = 2) UNION ALL SELECT 'held_sentences', (SELECT count(*) FROM charges WHERE disposition_raw = 'Held for Court' AND sequence = 1) UNION ALL SELECT 'duration_drift', (SELECT count(*) FROM components WHERE scategory = 'incarceration')",
    SENTENCES,
)


@query
def index_row_checks(spark, sf_dir):
    """Index rows hurt in run id, taxonomy version, wedge share and dates."""
    own, parts = B.facts(spark, sf_dir)
    summary, categories = A.index_summary(own, parts, B.CHARGE, eligible="public_eligible"), A.index_categories(own, parts, B.CHARGE, eligible="public_eligible")
    low = F.col("charge_id") < "Brand#2"
    hurt = summary.withColumns({"wedge_percentage": F.when(low, F.col("wedge_percentage") + 0.1).otherwise(F.col("wedge_percentage")), "date_range_start": F.when(low, F.lit("2020-01-01").cast("date")).otherwise(F.col("date_range_start")), "run_id": F.when(low, "r0").otherwise("r1"), "taxonomy_version": F.when(~low, F.lit(V.TAXONOMY_VERSION))})
    return checks.index_identities(hurt, categories, B.CHARGE, "index_charge").unionByName(checks.run_rows(hurt, "index_charge", "r1")).where("code in ('wedge_percentage_misaligned', 'wedge_identity_mismatch', 'date_range_inverted', 'run_id_mismatch', 'taxonomy_version_missing')")


_add(
    "index_row_checks",
    f"""
, conv AS (SELECT charge_id, count(*) AS c, count(*) FILTER (charge_row NOT IN (SELECT charge_row FROM components WHERE public_eligible)) AS w FROM facts WHERE public_eligible AND {CONVICTION} GROUP BY charge_id)
, low AS (SELECT *, CAST((CAST(w AS BIGINT) * 2000 + c) // (2 * c) AS DECIMAL(18, 1)) * CAST(0.1 AS DECIMAL(2, 1)) + CASE WHEN charge_id < 'Brand#2' THEN 0.1 ELSE 0.0 END AS p FROM conv)
SELECT 'index_charge' AS "table", code, CASE code WHEN 'wedge_identity_mismatch' THEN 0 WHEN 'wedge_percentage_misaligned' THEN (SELECT count(*) FROM low WHERE abs(p * c - w * 100) > 0.05 * c) ELSE (SELECT count(*) FROM conv WHERE charge_id < 'Brand#2') END AS violations
FROM (VALUES ('wedge_identity_mismatch'), ('wedge_percentage_misaligned'), ('date_range_inverted'), ('run_id_mismatch'), ('taxonomy_version_missing')) v(code)""",
    SENTENCES,
)


@query
def taxonomy_checks(spark, sf_dir):
    """The kinds of parts as a taxonomy ordered by the length of their names, one of them banned, some beyond and
    one short of what is expected."""
    rows = B.table(spark, sf_dir, "part").select(F.lower("p_type").alias("code"), F.length("p_type").alias("sort_order")).distinct()
    return checks.taxonomy_faults(rows, "1.0", ["economy", "standard", "small", "guilty_plea"], ["promo", "odds"])


_add(
    "taxonomy_checks",
    """
SELECT 'order_repeated' AS fault, CAST(o AS VARCHAR) AS value FROM t GROUP BY o HAVING count(*) > 1 UNION ALL SELECT 'code_banned', code FROM t WHERE contains(code, 'promo') OR contains(code, 'odds')
UNION ALL SELECT 'code_unexpected', code FROM t WHERE code NOT IN (SELECT c FROM e) UNION ALL SELECT 'code_absent', c FROM e WHERE c NOT IN (SELECT code FROM t) UNION ALL SELECT 'version_malformed', '1.0'""",
    "t AS (SELECT DISTINCT lower(p_type) AS code, length(p_type) AS o FROM part), e(c) AS (VALUES ('economy'), ('standard'), ('small'), ('guilty_plea'))",
)


@query
def reasons_in_vocabulary(spark, sf_dir):
    rows = B.outcomes(spark, sf_dir).select(F.explode("reasons").alias("reason"))
    return checks.codes_outside(rows, "reason", [c for c in V.REASON_CODES if not c.startswith("filed")])


_add("reasons_in_vocabulary", "SELECT reason AS code, count(*) AS n FROM (SELECT unnest(reasons) AS reason FROM facts) WHERE starts_with(reason, 'filed') GROUP BY reason", FACTS)


@query
def seed_checks(spark, sf_dir):
    """Seeded distributions, the nations of a region as its categories, some of their shares wrong, before they are
    stored."""
    n = B.table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("charge_id"), F.col("n_name").alias("category_code"), (F.col("n_nationkey") + 1).cast("long").alias("count"), "n_nationkey")
    n = n.withColumn("sample_size", F.sum("count").over(Window.partitionBy("charge_id")))
    seed = n.withColumn("percentage", numbers.percent(F.col("count"), F.col("sample_size")) + F.when(F.col("n_nationkey") % 7 == 3, 0.02).otherwise(0.0))
    seed = seed.withColumns({"date_range_start": F.lit(V.DATA_START).cast("date"), "date_range_end": F.lit(V.DATA_START).cast("date"), "sample_size": F.col("sample_size") + ((F.col("charge_id") == 2) & (F.col("n_nationkey") > 12)).cast("int")})
    return checks.distribution_integrity(seed, "seed", B.CHARGE).where("code not in ('count_sum_mismatch')")


_add(
    "seed_checks",
    """
SELECT 'seed' AS "table", code, CAST(n AS BIGINT) AS violations FROM (SELECT unnest(['percentage_misaligned', 'sample_size_missing', 'date_range_missing', 'date_range_start_before_window', 'date_range_inverted', 'sample_size_inconsistent']) AS code,
  unnest([(SELECT count(*) FROM s WHERE abs(p * z - c * 100) > 0.005 * z), 0, 0, 0, 0, (SELECT count(*) FROM (SELECT r FROM s GROUP BY r HAVING min(z) <> max(z)))]) AS n)""",
    """b AS (SELECT n_nationkey AS k, n_regionkey AS r, CAST(n_nationkey + 1 AS BIGINT) AS c, CAST(sum(n_nationkey + 1) OVER (PARTITION BY n_regionkey) AS BIGINT) AS t FROM nation),
s AS (SELECT r, c, t + CASE WHEN r = 2 AND k > 12 THEN 1 ELSE 0 END AS z, CAST((c * 20000 + t) // (2 * t) AS DECIMAL(18, 2)) * CAST(0.01 AS DECIMAL(3, 2)) + CASE WHEN k % 7 = 3 THEN 0.02 ELSE 0 END AS p FROM b)""",
)

# -- review queue and reports -------------------------------------------------------------------


def _review_items(spark, sf_dir) -> DataFrame:
    """Items of four producers: unmatched charges, unmapped outcomes, warnings, unreadable money."""
    rows = B.charges(spark, sf_dir)
    own, parts = B.facts(spark, sf_dir)
    item = lambda df, kind, key: df.select(text.dedup_key(F.lit(kind), key.cast("string")).alias("dedup_key"))
    warned = rows.where(F.size("warning_codes") > 0).select("docket_id")
    return review.produced({
        "charge": item(own.where("charge_id is null"), "charge", F.col("docket_id")),
        "outcome": item(own.where("outcome_category_code = 'unknown'"), "outcome", F.col("docket_id")),
        "warning": item(warned, "warning", F.col("docket_id")),
        "money": item(parts.where(F.array_contains("reasons", "money_amount_unparseable")), "money", F.col("outcome_id")),
    })


@query
def review_producers(spark, sf_dir):
    rows = review.first_of_each(_review_items(spark, sf_dir))
    return rows.groupBy("producer", "reason").agg(F.count("*").alias("n"))


PRODUCED = f"""{SENTENCES},
produced AS (
  SELECT 1 AS producer, 'charge' AS reason, CAST(docket_id AS VARCHAR) AS k FROM facts WHERE charge_id IS NULL UNION ALL SELECT 2, 'outcome', CAST(docket_id AS VARCHAR) FROM facts WHERE category = 'unknown'
  UNION ALL SELECT 3, 'warning', CAST(docket_id AS VARCHAR) FROM charges WHERE discount IN (0, 1) UNION ALL SELECT 4, 'money', charge_row FROM components WHERE no_money)"""
_add("review_producers", "SELECT producer::INT AS producer, reason, count(DISTINCT k) AS n FROM produced GROUP BY ALL", PRODUCED)
_add("ops_queue", "SELECT 'open' AS status, reason, count(*) AS n FROM produced GROUP BY reason", PRODUCED)


@query
def candidate_contexts(spark, sf_dir):
    """JSON context of ambiguous charges, by distinct pair."""
    rows = B.roster(spark)
    parts = B.table(spark, sf_dir, "part").select(F.col("p_name").alias("offense"), F.concat(F.lit("18 § "), F.col("p_type")).alias("statute")).distinct()
    found = matching.match_charges(parts, rows).where(F.col("charge.method") == V.AMBIGUOUS).select("offense", "statute", F.explode("charge.candidates").alias("id"))
    named = found.join(rows.select("id", "display_name"), "id")
    listed = named.groupBy("offense", "statute").agg(F.collect_list(F.struct(F.col("id").alias("normalized_id"), "display_name")).alias("c"))
    return listed.select("offense", "statute", review.candidate_context(F.col("c")).alias("context"))


_add(
    "candidate_contexts",
    """
SELECT DISTINCT p_name AS offense, '18 § LARGE' AS statute, '{"candidates":[' || '{"normalized_id":"c5","display_name":"Large A"},{"normalized_id":"c6","display_name":"Large B"}' || ']}' AS context FROM part WHERE p_type = 'LARGE' AND lower(p_name) NOT IN ('small ring', 'tiny ring', 'red ring', 'red bolt', 'old bolt', 'blue bolt', 'hot gear', 'cold gear')
UNION ALL SELECT offense, statute, '{"candidates":[' || string_agg('{"normalized_id":"' || id || '","display_name":"' || display || '"}', ',' ORDER BY id) || ']}' FROM more GROUP BY ALL""",
    """named(id, display) AS (VALUES ('c1', 'Small Ring'), ('c2', 'Red  Bolt!'), ('c3', 'Hot Gear'), ('c4', 'Promotion'), ('c5', 'Large A'), ('c6', 'Large B')),
texts(k, ids) AS (VALUES ('small ring', ['c1']), ('tiny ring', ['c1']), ('red ring', ['c1']), ('red bolt', ['c2']), ('old bolt', ['c2', 'c3']), ('blue bolt', ['c2']), ('hot gear', ['c3']), ('cold gear', ['c3'])),
codes(t, ids) AS (VALUES ('ECONOMY', ['c1']), ('SMALL', ['c2']), ('MEDIUM', ['c3']), ('PROMO', ['c4']), ('LARGE', ['c5', 'c6'])),
pairs AS (SELECT DISTINCT p_name AS offense, '18 § ' || p_type AS statute, texts.ids AS a, coalesce(codes.ids, []) AS b FROM part JOIN texts ON lower(p_name) = k LEFT JOIN codes ON p_type = t),
more AS (SELECT offense, statute, id, display FROM (SELECT offense, statute, unnest(list_distinct(list_concat(a, b))) AS id FROM pairs WHERE len(a) > 1 OR (len(b) > 0 AND NOT list_contains(b, a[1]))) JOIN named USING (id))""",
)


@query
def warning_charges(spark, sf_dir):
    """Two kinds of warnings on their dockets and, by docket and sequence, their charges."""
    rows = B.charges(spark, sf_dir)
    warnings = rows.select("docket_id", F.when(F.col("sequence") == 3, F.lit(99)).otherwise(F.col("sequence")).alias("charge_sequence"), F.explode("warning_codes").alias("code"))
    found = facts.warned_charges(warnings, B.dockets(spark, sf_dir), rows.select("docket_id", "sequence", "charge_id"), ["SUSPECT_JUDGE_LINE", "MISSING_SENTENCE_DATE"])
    return found.groupBy("code").agg(F.count("*").alias("n"), F.count_distinct("charge_id").alias("charges"))


_add(
    "warning_charges",
    """
, w AS (SELECT docket_id, CASE WHEN sequence = 3 THEN 99 ELSE sequence END AS s, CASE discount WHEN 0 THEN 'SUSPECT_JUDGE_LINE' ELSE 'MISSING_SENTENCE_DATE' END AS code FROM charges WHERE discount IN (0, 1))
SELECT code, count(*) AS n, count(DISTINCT charge_row) AS charges FROM w LEFT JOIN charges c ON w.docket_id = c.docket_id AND w.s = c.sequence GROUP BY code""",
    CHARGES,
)


@query
def judge_coverage(spark, sf_dir):
    rows = matching.match_judges(B.judge_values(spark, sf_dir).withColumn("name", F.when(F.col("c_custkey") % 7 != 0, F.col("name"))), B.judge_roster(spark, sf_dir))
    return reports.name_coverage(rows.select("name", F.col("judge.method").alias("method")), {"name": "method"})


_add(
    "judge_coverage",
    """
SELECT 'name' AS field, CASE WHEN c_custkey % 7 = 0 THEN 'absent' WHEN coalesce(len(ids), 0) = 0 THEN 'unmatched' WHEN len(ids) = 1 THEN 'exact' ELSE 'ambiguous' END AS kind, CASE WHEN bool_or(c_custkey % 7 = 0) THEN 1 ELSE count(DISTINCT full_name) END AS distinct_values, count(*) AS rows
FROM near JOIN full_names USING (c_custkey) GROUP BY 2""",
    """
raw AS (SELECT c_custkey, lower(replace(n_name, '_', '')) AS surname, lower(c_mktsegment) AS first, CASE WHEN c_acctbal < 0 THEN 'b' WHEN c_acctbal > 5000 THEN '' ELSE 'm' END AS middle FROM customer JOIN nation ON c_nationkey = n_nationkey),
full_names AS (SELECT c_custkey, CASE WHEN c_acctbal > 9000 THEN 'T' ELSE '' END || n_name || ',' || c_mktsegment || CASE WHEN c_acctbal < 0 THEN ' B.' WHEN c_acctbal > 5000 THEN '' ELSE ' M' END || CASE WHEN c_acctbal > 8000 THEN ', Jr.' ELSE '' END AS full_name FROM customer JOIN nation ON c_nationkey = n_nationkey),
roster AS (SELECT n_nationkey || '-' || g || '-' || m AS id, lower(replace(n_name, '_', '')) AS rsurname, lower(g) AS rfirst, lower(m) AS rmiddle FROM nation, (VALUES ('Building'), ('Machinery'), ('Furniture')) a(g), (VALUES ('M'), ('B')) b(m) WHERE m = 'M' OR n_regionkey = 0),
near AS (SELECT c_custkey, list_sort(list(id) FILTER (id IS NOT NULL AND (middle = '' OR middle = rmiddle))) AS ids FROM raw LEFT JOIN roster ON surname = rsurname AND first = rfirst GROUP BY c_custkey)""",
)


@query
def sentencing_coverage(spark, sf_dir):
    """Components by kind; second charges also pay restitution, third ones serve, fifth ones have an unknown type."""
    place = F.split("outcome_id", "-")[1]
    rows = B.sentences(B.charges(spark, sf_dir)).withColumns({"raw_text": F.concat("raw_text", F.when(place == "2", ", Restitution").when(place == "3", ", 40 hours Community Service").otherwise("")), "sentence_type": F.when(place == "5", "Other").otherwise(F.col("sentence_type"))})
    rows = rows.select(matching.component(F.col("sentence_type"), F.col("raw_text")).alias("c"))
    return reports.sentencing_coverage(rows.select("c.categories", "c.amount_cents"))


_add(
    "sentencing_coverage",
    """
, s AS (SELECT split_part(charge_row, '-', 2) AS p, scategory = 'costs_fees' AS fee, amount_cents FROM sentences)
, k AS (SELECT p IN ('2', '3') AS more, p = '5' AS lost, (fee AND p <> '5') OR p = '2' AS money, CASE WHEN fee THEN amount_cents END AS amount FROM s)
SELECT unnest(['base', 'additive', 'ambiguous', 'money_with_amount', 'money_without_amount']) AS kind, unnest([count(*) FILTER (NOT more AND NOT lost), count(*) FILTER (more), count(*) FILTER (lost), count(*) FILTER (money AND amount IS NOT NULL), count(*) FILTER (money AND amount IS NULL)]) AS n FROM k""",
    SENTENCES,
)


@query
def search_run_report(spark, sf_dir):
    windows = B.ledger(spark, sf_dir).select("court", "outcome", (F.col("outcome") == "complete").cast("long").alias("found"))
    attempts = B.attempts(spark, sf_dir).withColumn("court", F.when(F.col("run") < 50, "CP").when(F.col("run") < 100, "MC").otherwise("both"))
    return reports.search_report(windows, attempts)


_add("search_run_report", "SELECT CASE WHEN run < 50 THEN 'CP' WHEN run < 100 THEN 'MC' ELSE 'both' END AS court, count(*) AS windows, count(*) FILTER (outcome = 'hit') AS complete, count(*) FILTER (outcome = 'miss') AS empty, count(*) FILTER (outcome = 'blocked') AS truncated, count(*) FILTER (outcome IN ('error', 'already_present')) AS blocked, count(*) FILTER (outcome = 'hit') AS found, count(*) AS attempts, count(*) FILTER (outcome = 'hit') AS hits, true AS reconciles FROM attempts GROUP BY 1", ATTEMPTS)


@query
def refresh_run_report(spark, sf_dir):
    p = B.table(spark, sf_dir, "pages")
    known = p.where("length(html) > 2500").select("page_id", F.sha2(F.col("html"), 256).alias("hash"))
    now = p.select("page_id", F.sha2(F.when(F.contains("url", F.lit("/en/")), F.concat("html", F.lit("!"))).otherwise(F.col("html")), 256).alias("hash"))
    from ..operators import collector

    return reports.refresh_report(collector.changes(known, now, "page_id"))


_add("refresh_run_report", "SELECT count(*) AS targets, count(*) FILTER (length(html) <= 2500) AS new, count(*) FILTER (length(html) > 2500 AND contains(url, '/en/')) AS changed, count(*) FILTER (length(html) > 2500 AND NOT contains(url, '/en/')) AS unchanged, true AS reconciles FROM pages")


@query
def spec_values(spark, sf_dir):
    p = B.table(spark, sf_dir, "part").select(F.col("p_brand").alias("brand"), F.to_json(F.struct("p_type", "p_size")).alias("about"))
    return reports.spec_values({"parts": p}, ["parts.brand", "parts.about.p_type"])


_add("spec_values", "SELECT 'parts.brand' AS \"column\", p_brand AS value, count(*) AS n FROM part GROUP BY 2 UNION ALL SELECT 'parts.about.p_type', p_type, count(*) FROM part GROUP BY 2")


@query
def value_frequencies(spark, sf_dir):
    """All values of three columns, most frequent first, with their place."""
    return panel.top_values(reports.value_counts(B.charges(spark, sf_dir), ["statute", "disposition_raw", "grade"]), None)


_add("value_frequencies", "SELECT col AS \"column\", v AS value, n, CAST(row_number() OVER (PARTITION BY col ORDER BY n DESC, v NULLS LAST) AS INT) AS place FROM (SELECT col, v, count(*) AS n FROM (SELECT 'statute' AS col, statute AS v FROM charges UNION ALL SELECT 'disposition_raw', disposition_raw FROM charges UNION ALL SELECT 'grade', grade FROM charges) GROUP BY ALL)", CHARGES)
