"""SQL that DuckDB runs on the same tables, for every registered query that SQL can express."""

from .oracle_base import CHARGES, DOCKETS, FACTS, FLOOR, SENTENCES, WINDOW, pct, with_base

ORACLES: dict[str, str] = {}


def _add(name: str, sql: str, base: str = "") -> None:
    ORACLES[name] = with_base(base, sql) if base else sql.strip()


# -- aggregates ---------------------------------------------------------------------------------


def _distribution(source: str, keys: str, category: str, date: str, flag: str, sample: str) -> str:
    return f"""
, counted AS (SELECT {keys}, {category} AS category_code, count(*) AS count, min({date}) AS a, max({date}) AS b FROM {source} WHERE {flag} GROUP BY ALL)
, cells AS (SELECT {keys}, CAST(sum(count) AS BIGINT) AS {sample}, min(a) AS date_range_start, max(b) AS date_range_end FROM counted GROUP BY ALL)
SELECT {keys}, category_code, count, {pct("count", sample)} AS percentage, {sample}, date_range_start, date_range_end, {sample} < 10 AS is_thin_data FROM counted JOIN cells USING ({keys})"""


OUT_CHARGE = _distribution("facts", "charge_id", "category", "disposition_date", "public_eligible", "sample_size")
OUT_PAIR = _distribution("facts", "charge_id, judge_id", "category", "disposition_date", "judge_specific_eligible", "sample_size")
COMP_CHARGE = _distribution("components", "charge_id", "scategory", "sentence_date", "public_eligible", "sentencing_sample_size")
COMP_PAIR = _distribution("components", "charge_id, judge_id", "scategory", "sentence_date", "public_eligible AND attributed", "sentencing_sample_size")
_add("charge_outcome_distribution", OUT_CHARGE, FACTS)
_add("pair_outcome_distribution", OUT_PAIR, FACTS)
_add("charge_component_distribution", COMP_CHARGE, SENTENCES)
_add("pair_component_distribution", COMP_PAIR, SENTENCES)

CONVICTION = "category IN ('guilty_plea', 'guilty_verdict')"
for grain, keys, flag in (("charge", "charge_id", "public_eligible"), ("pair", "charge_id, judge_id", "judge_specific_eligible")):
    fed = "parent_public" if grain == "charge" else "parent_specific"
    _add(
        f"index_summary_{grain}",
        f"""
SELECT {keys}, count(*) AS convictions, count(*) FILTER (has) AS sentenced_convictions, count(*) FILTER (NOT has) AS wedge_count, {pct("count(*) FILTER (NOT has)", "count(*)", 1)} AS wedge_percentage,
  min(disposition_date) AS date_range_start, max(disposition_date) AS date_range_end, count(*) FILTER (has) < 10 AS is_thin_data
FROM (SELECT *, EXISTS (SELECT 1 FROM components c WHERE c.charge_row = f.charge_row AND c.public_eligible) AS has FROM facts f WHERE {flag} AND {CONVICTION})
GROUP BY {keys}""",
        SENTENCES,
    )
    _add(
        f"index_category_{grain}",
        f"""
, fed AS (SELECT * FROM components WHERE public_eligible AND {fed})
, sentenced AS (SELECT {keys}, count(DISTINCT charge_row) AS s FROM fed GROUP BY ALL)
SELECT {keys}, scategory AS category_code, count(DISTINCT charge_row) AS conviction_count, {pct("count(DISTINCT charge_row)", "max(s)", 1)} AS percentage,
  CAST(median(min_days) FILTER (min_days IS NOT NULL) AS DOUBLE) AS median_min_days, CAST(median(max_days) FILTER (min_days IS NOT NULL) AS DOUBLE) AS median_max_days,
  CASE WHEN count(min_days) > 0 THEN {pct("count(*) FILTER (min_assumed)", "count(*)", 1)} END AS min_assumed_percentage
FROM fed JOIN sentenced USING ({keys}) GROUP BY {keys}, scategory""",
        SENTENCES,
    )
_add("index_grade_mix", f"SELECT charge_id, coalesce(grade, 'ungraded') AS grade, count(*) AS count, {pct('count(*)', 'sum(count(*)) OVER (PARTITION BY charge_id)', 1)} AS percentage FROM facts WHERE public_eligible AND {CONVICTION} GROUP BY charge_id, coalesce(grade, 'ungraded')", FACTS)

SUPERSEDE = f"""{CHARGES},
claims AS (SELECT charge_row AS cp, docket_number AS cp_docket, filed_date AS cp_filed, sequence AS seq, statute AS st, originating_docket_no AS o, otn FROM charges WHERE court = 'CP' AND originating_docket_no IS NOT NULL),
mc AS (SELECT charge_row AS mc_id, docket_number, otn, sequence, statute, disposition_raw = 'Held for Court' AS held FROM charges WHERE court = 'MC'),
case_hit AS (SELECT DISTINCT cp FROM claims JOIN mc ON o = docket_number AND claims.otn = mc.otn),
seq_hit AS (SELECT DISTINCT cp FROM claims JOIN mc ON o = docket_number AND claims.otn = mc.otn AND seq = sequence),
full_hit AS (SELECT cp, min(mc_id) AS mc_id, arg_min(coalesce(held, false), mc_id) AS held FROM claims JOIN mc ON o = docket_number AND claims.otn = mc.otn AND seq = sequence AND st = statute GROUP BY cp),
staged AS (
  SELECT claims.*, full_hit.mc_id, CASE WHEN case_hit.cp IS NULL THEN 'no_case_match' WHEN seq_hit.cp IS NULL THEN 'no_seq_match' WHEN full_hit.cp IS NULL THEN 'statute_mismatch' WHEN NOT held THEN 'mc_not_currently_held' END AS failed
  FROM claims LEFT JOIN case_hit USING (cp) LEFT JOIN seq_hit USING (cp) LEFT JOIN full_hit USING (cp)),
ranked AS (SELECT *, CASE WHEN failed IS NULL THEN row_number() OVER (PARTITION BY failed IS NULL, mc_id ORDER BY cp_filed DESC NULLS LAST, cp_docket DESC, cp) END AS k FROM staged),
stages AS (SELECT cp, mc_id, coalesce(failed, CASE WHEN k = 1 THEN 'superseded' ELSE 'later_claim_won' END) AS stage FROM ranked)"""
_add("supersession_stage_counts", "SELECT stage, count(*) AS n FROM stages GROUP BY stage", SUPERSEDE)
_add("supersession_latest_wins", "SELECT mc_id AS mc_charge_id, cp AS superseded_by FROM stages WHERE stage = 'superseded'", SUPERSEDE)

CORPUS = SUPERSEDE + f""",
corpus AS (
  SELECT c.charge_id, charge_method, s.cp IS NOT NULL AS superseded,
    CASE WHEN filed_date IS NULL OR filed_date < {FLOOR} THEN 'before_floor' WHEN s.cp IS NOT NULL AND disposition_raw = 'Held for Court' THEN 'folded' WHEN disposition_raw IS NULL THEN 'pending' WHEN disposition_raw = 'Held for Court' THEN 'held'
      WHEN disposition_date >= {WINDOW} AND charge_id IS NOT NULL AND category <> 'unknown' AND NOT review THEN 'outcome' ELSE 'excluded' END AS stage
  FROM charges c LEFT JOIN (SELECT * FROM stages WHERE stage = 'superseded') s ON s.mc_id = c.charge_row)"""
_add(
    "volume_funnel",
    """
SELECT charge_id, count(*) FILTER (stage <> 'folded') AS charges_seen, count(*) FILTER (stage = 'outcome') AS outcomes_recorded, count(*) FILTER (stage = 'held') AS held_for_court, count(*) FILTER (stage = 'pending') AS still_pending, count(*) FILTER (stage = 'excluded') AS disposed_excluded, count(*) FILTER (stage = 'folded') AS held_superseded
FROM corpus WHERE charge_id IS NOT NULL AND stage <> 'before_floor' GROUP BY charge_id HAVING count(*) FILTER (stage <> 'folded') > 0""",
    CORPUS,
)
_add(
    "volume_totals",
    """
SELECT count(*) AS rows_total, count(*) FILTER (stage = 'before_floor') AS rows_pre_floor, count(*) FILTER (stage <> 'before_floor') AS rows_in_universe, count(*) FILTER (stage = 'folded') AS superseded_folded,
  count(*) FILTER (superseded AND stage NOT IN ('folded', 'before_floor')) AS superseded_not_held_anomaly, count(*) FILTER (charge_method = 'unmatched' AND stage NOT IN ('folded', 'before_floor')) AS unmatched_rows, count(*) FILTER (charge_method = 'ambiguous' AND stage NOT IN ('folded', 'before_floor')) AS ambiguous_rows,
  count(*) FILTER (stage = 'outcome') AS outcomes_total, count(*) FILTER (stage = 'held') AS held_total, count(*) FILTER (stage = 'pending') AS pending_total, count(*) FILTER (stage = 'excluded') AS excluded_total,
  count(DISTINCT charge_id) FILTER (stage NOT IN ('folded', 'before_floor')) AS identities_with_journeys,
  count(DISTINCT charge_id) FILTER (stage <> 'before_floor') - count(DISTINCT charge_id) FILTER (stage NOT IN ('folded', 'before_floor')) AS identities_fully_superseded
FROM corpus""",
    CORPUS,
)
_add("exclusion_reasons", "SELECT reason, count(*) AS n FROM (SELECT unnest(reasons) AS reason FROM facts WHERE NOT public_eligible) GROUP BY reason", FACTS)
_add("data_range", f"SELECT {FLOOR} AS data_range_start, coalesce(greatest((SELECT max(disposition_date) FROM facts WHERE public_eligible), (SELECT max(sentence_date) FROM components WHERE public_eligible)), {FLOOR}) AS data_range_end", SENTENCES)
_add("charges_without_sentencing", "SELECT count(*) AS n FROM (SELECT charge_id FROM facts WHERE judge_specific_eligible EXCEPT SELECT charge_id FROM components WHERE public_eligible AND attributed)", SENTENCES)

# -- facts and gates ----------------------------------------------------------------------------

_add("eligibility_gate", "SELECT charge_row AS outcome_id, category AS outcome_category_code, mvp_eligible, public_eligible, judge_specific_eligible, array_to_string(reasons, ',') AS reasons FROM facts", FACTS)
_add("component_gate", "SELECT charge_row || '/' || sentence_type AS sentence_id, scategory AS sentencing_category_code, 'exact' AS component_method, min_days, max_days, min_assumed, amount_cents, mvp_eligible, public_eligible, public_eligible AND attributed AS judge_specific_eligible FROM components", SENTENCES)
_add("gate_invariants", "SELECT 0::BIGINT AS broken, 'outcomes' AS facts UNION ALL SELECT 0, 'components'")
_add("fact_counts", "SELECT count(*) AS processed, count(category) AS facts, count(*) FILTER (disposition_raw = 'Held for Court') AS held, count(*) FILTER (disposition_raw IS NULL) AS undisposed FROM charges", CHARGES)
REASONS = "disposition_date_missing disposition_date_before_mvp_window sentence_date_missing sentence_date_before_mvp_window charge_not_normalized judge_not_normalized disposition_not_mapped outcome_category_not_public sentencing_category_not_public sentencing_component_not_normalized review_needed blocking_warning judge_not_attributed parent_outcome_ineligible money_amount_unparseable sentence_duration_unparseable filed_date_before_floor filed_date_missing".split()
_add("reason_tally_with_zeros", f"SELECT reason, count(r) AS n FROM (VALUES {', '.join(f'({chr(39)}{r}{chr(39)})' for r in REASONS)}) v(reason) LEFT JOIN (SELECT unnest(reasons) AS r FROM facts) ON r = reason GROUP BY reason", FACTS)
_add("component_tallies", "SELECT count(*) AS components, count(amount_cents) AS with_amount, count(*) FILTER (no_money) AS money_unparseable, 0::BIGINT AS multi_category, 0::BIGINT AS multi_category_charges, count(*) FILTER (no_duration) AS duration_unparseable FROM components", SENTENCES)
_add("lag_report", f"SELECT count(l) AS dated_pairs, count(*) FILTER (l <> 0) AS diverging, count(*) FILTER (l < 0) AS negative, count(*) FILTER ((disposition_date < {WINDOW}) <> (sentence_date < {WINDOW})) AS straddling, min(l) AS least_lag, max(l) AS greatest_lag FROM (SELECT *, CAST(sentence_date - disposition_date AS INT) AS l FROM components)", SENTENCES)
_add("orphaned_sentences", "SELECT count(*) AS n FROM sentences LEFT JOIN facts USING (charge_row) WHERE facts.charge_row IS NULL", SENTENCES)

# -- matching -----------------------------------------------------------------------------------

MATCH = r"""
roster(id, display, statute, aliases) AS (VALUES ('c1', 'Small Ring', '18 § ECONOMY', ['tiny ring', 'red ring']), ('c2', 'Red  Bolt!', '18 § SMALL', ['old bolt', 'blue bolt']), ('c3', 'Hot Gear', '18 § MEDIUM', ['old bolt', 'cold-gear']), ('c4', 'Promotion', '18 § PROMO', []), ('c5', 'Large A', '18 § LARGE', ['anvil']), ('c6', 'Large B', '18 § LARGE', [])),
parts AS (SELECT p_name AS offense, '18 § ' || p_type AS statute FROM part),
pairs AS (SELECT offense, statute, count(*) AS n, trim(regexp_replace(lower(offense), '[^a-z0-9]+', ' ', 'g')) AS k FROM parts GROUP BY ALL),
found AS (
  SELECT p.*, (SELECT coalesce(list_sort(list(DISTINCT id)), []) FROM roster r WHERE trim(regexp_replace(lower(display), '[^a-z0-9]+', ' ', 'g')) = p.k) AS d,
    (SELECT coalesce(list_sort(list(DISTINCT id)), []) FROM (SELECT id, unnest(aliases) AS a FROM roster) WHERE trim(regexp_replace(lower(a), '[^a-z0-9]+', ' ', 'g')) = p.k) AS a,
    (SELECT coalesce(list_sort(list(DISTINCT id)), []) FROM roster r WHERE regexp_replace(upper(r.statute), '[^A-Z0-9.-]+', '', 'g') = regexp_replace(upper(p.statute), '[^A-Z0-9.-]+', '', 'g')) AS s
  FROM pairs p),
sets AS (SELECT *, CASE WHEN len(d) > 0 THEN d ELSE a END AS t FROM found),
arms AS (
  SELECT *, len(t) = 1 AND len(s) > 0 AND NOT list_contains(s, t[1]) AS conflict,
    CASE WHEN len(t) >= 2 THEN 'ambiguous' WHEN len(t) = 1 AND len(s) > 0 AND NOT list_contains(s, t[1]) THEN 'ambiguous' WHEN len(t) = 1 AND len(d) > 0 THEN 'exact' WHEN len(t) = 1 THEN 'alias' WHEN len(s) = 1 THEN 'statute' WHEN len(s) = 0 THEN 'unmatched' ELSE 'ambiguous' END AS method
  FROM sets)"""
_add("roster_match_arms", "SELECT method, CASE WHEN conflict THEN 'NORM_STATUTE_TEXT_CONFLICT' WHEN method = 'ambiguous' THEN 'NORM_AMBIGUOUS' WHEN method = 'unmatched' THEN 'NORM_UNMATCHED' ELSE '' END AS warning, CASE WHEN method IN ('exact', 'alias') THEN t[1] WHEN method = 'statute' THEN s[1] ELSE '' END AS id, CAST(sum(n) AS BIGINT) AS n FROM arms GROUP BY 1, 2, 3", MATCH)
_add("roster_candidates", "SELECT offense, statute, array_to_string(list_sort(list_distinct(list_concat(t, s))), ',') AS candidates, n FROM arms WHERE method = 'ambiguous'", MATCH)
_add("coverage_report_match", "SELECT m AS method, count(method) AS distinct_pairs, CAST(coalesce(sum(n), 0) AS BIGINT) AS rows FROM (VALUES ('exact'), ('alias'), ('statute'), ('pattern'), ('unmatched'), ('ambiguous')) v(m) LEFT JOIN arms ON m = method GROUP BY m", MATCH)
JUDGES = """
raw AS (SELECT c_custkey, lower(replace(n_name, '_', '')) AS surname, lower(c_mktsegment) AS first, CASE WHEN c_acctbal < 0 THEN 'b' WHEN c_acctbal > 5000 THEN '' ELSE 'm' END AS middle, CASE WHEN c_acctbal > 8000 THEN 'jr' ELSE '' END AS suffix FROM customer JOIN nation ON c_nationkey = n_nationkey),
roster AS (SELECT n_nationkey || '-' || g || '-' || m AS id, lower(replace(n_name, '_', '')) AS rsurname, lower(g) AS rfirst, lower(m) AS rmiddle FROM nation, (VALUES ('Building'), ('Machinery'), ('Furniture')) a(g), (VALUES ('M'), ('B')) b(m) WHERE m = 'M' OR n_regionkey = 0),
near AS (SELECT c_custkey, list_sort(list(id) FILTER (id IS NOT NULL AND (middle = '' OR middle = rmiddle))) AS ids FROM raw LEFT JOIN roster ON surname = rsurname AND first = rfirst GROUP BY c_custkey)"""
_add("name_canonical", "SELECT c_custkey, surname, trim(first || ' ' || middle) AS given, suffix FROM raw", JUDGES)
_add("name_tolerant_match", "SELECT CASE WHEN coalesce(len(ids), 0) = 0 THEN 'unmatched' WHEN len(ids) = 1 THEN 'exact' ELSE 'ambiguous' END AS method, CASE WHEN len(ids) = 1 THEN ids[1] ELSE '' END AS id, count(*) AS n FROM near GROUP BY 1, 2", JUDGES)
_add("statute_canonical", "SELECT p_partkey, regexp_replace(upper(p_brand || ' § ' || p_type), '[^A-Z0-9.-]+', '', 'g') AS statute, trim(regexp_replace(lower(upper(p_name) || ' -- ' || p_brand), '[^a-z0-9]+', ' ', 'g')) AS name FROM part")
_add("disposition_map", "SELECT coalesce(disposition_raw, '') AS raw, coalesce(disposition_raw = 'Held for Court', false) AS held, coalesce(category, '') AS category, category IS NOT NULL AND category <> 'unknown' AS mapped, category IS NOT NULL AND category <> 'unknown' AS public, count(*) AS n FROM charges GROUP BY 1, 2, 3, 4, 5", CHARGES)
_add("money_triage", "SELECT p_partkey, CASE WHEN p_size < 10 THEN NULL WHEN p_size < 20 THEN CAST(floor(p_retailprice) AS BIGINT) * 100 + 50 WHEN p_size < 30 THEN CAST(floor(p_retailprice) AS BIGINT) * 100 END AS amount_cents, p_size >= 30 AS unparseable FROM part")

# -- scalars ------------------------------------------------------------------------------------

_add("duration_days", "SELECT l_linenumber, CASE l_linenumber WHEN 1 THEN q * 30 + 15 WHEN 2 THEN q * 360 + 3 WHEN 3 THEN CASE WHEN q % 2 = 0 THEN q ELSE q + 1 END WHEN 4 THEN NULL ELSE CASE WHEN q % 2 = 0 THEN q ELSE q + 1 END END AS days, count(*) AS n FROM (SELECT *, CAST(l_quantity AS INT) AS q FROM lineitem) GROUP BY 1, 2")
_add("median_days_to_months", "SELECT l_suppkey, median_days, CAST((CAST(round(median_days * 10) AS BIGINT) + 15) // 30 AS DOUBLE) / 10.0 AS months FROM (SELECT l_suppkey, CAST(median(CAST(l_quantity AS INT)) AS DOUBLE) AS median_days FROM lineitem GROUP BY 1)")
_add("percentages", f"SELECT l_partkey, {pct('k', 'n')} AS pct2, {pct('k', 'n', 1)} AS pct1, floor(CAST(k AS DOUBLE) / CAST(n AS DOUBLE) * 1000 + 0.5) / 10.0::DOUBLE AS share FROM (SELECT l_partkey, count(*) AS n, count(*) FILTER (l_returnflag = 'A') AS k FROM lineitem GROUP BY 1)")
_add("date_forms", "SELECT o_orderkey, CASE WHEN o_orderstatus IN ('F', 'O') THEN CAST(o_orderdate AS DATE) END AS day FROM orders")
_add("identity_hash", "SELECT c_custkey, sha256('salt|' || trim(regexp_replace(regexp_replace(lower(c_name || ' ' || c_mktsegment), '[^a-z ]', ' ', 'g'), ' +', ' ', 'g')) || '|' || (c_nationkey + 1950)) AS with_year, sha256('salt|' || lower(c_mktsegment)) AS name_only FROM customer")
_add("statute_tokens", r"SELECT is_statute, count(*) AS n, count(DISTINCT w) AS words FROM (SELECT w, trim(w) = '' OR contains(w, '§') OR regexp_matches(w, '[0-9]') OR length(trim(w)) = 1 OR lower(trim(w)) IN ('i', 'ii', 'iii', 'iv', 'v', 'vi', 'vii', 'viii', 'ix', 'x') OR (starts_with(trim(w), '(') AND ends_with(trim(w), ')')) AS is_statute FROM (SELECT unnest(string_split(text, ' ')) AS w FROM documents)) GROUP BY 1")
_add("judge_slot_guards", r"SELECT regexp_matches(text, '(?i)\b(?:Confinement|Probation|IPP)\b') OR regexp_matches(text, '(?i)\b(?:Min|Max)\s+of\b') OR regexp_matches(text, '(?i)\b\d+(?:\.\d+)?\s*(?:½|1/2)?\s*(?:years?|months?|days?)\b') OR regexp_matches(text, '\$|\b\d[\d,]*\.\d{2}\b') AS junk, regexp_matches(text, '(?i)\bamended\b|\bdowngraded\b|\breplaced\s+by\b|\bcharge\s+changed\b') AS amended, count(*) AS n FROM documents GROUP BY 1, 2")

# -- links --------------------------------------------------------------------------------------

_add(
    "link_resolution",
    r"""
, around AS (SELECT *, concat_ws(' and ', lag(docket_number) OVER w, lead(docket_number) OVER w) AS near FROM dockets WINDOW w AS (PARTITION BY o_custkey ORDER BY docket_id))
, captured AS (SELECT *, CASE WHEN grade = '1-URGENT' THEN 'see file' WHEN grade = '2-HIGH' THEN 'to ' || replace(docket_number, 'MC-51', 'CP-51') WHEN grade IS NOT NULL THEN near END AS c FROM around WHERE court = 'MC')
, numbers AS (SELECT docket_id, list_distinct(regexp_extract_all(c, '(?:CP|MC)-51-CR-\d{7}-\d{4}')) AS ns FROM captured WHERE c IS NOT NULL)
, targets AS (SELECT docket_id, unnest(ns) AS target FROM numbers WHERE len(ns) > 0 UNION ALL SELECT docket_id, NULL FROM numbers WHERE len(ns) = 0)
, known AS (SELECT docket_number, count(*) AS n, min(docket_id) AS sole FROM dockets GROUP BY 1)
SELECT CASE WHEN target IS NULL THEN 'malformed' WHEN n >= 2 THEN 'ambiguous_target' WHEN n = 1 THEN 'resolved' ELSE 'unresolved' END AS outcome, count(*) AS n, count(DISTINCT target) AS targets, CAST(sum(sole) FILTER (known.n = 1) AS BIGINT) AS id_sum
FROM targets LEFT JOIN known ON target = docket_number GROUP BY 1""",
    DOCKETS,
)
_add(
    "attribution_rule",
    """
, own AS (SELECT *, tax = 1 OR (tax = 2 AND sequence = 1) AS present, CASE WHEN tax = 2 AND sequence = 1 THEN CAST(quantity AS BIGINT) END AS own_id, discount = 0 AS nulled, CASE WHEN grade IS NOT NULL THEN docket_id % 97 END AS assigned FROM charges)
, fallback AS (SELECT *, count(own_id) OVER (PARTITION BY docket_id) = 0 AND assigned IS NOT NULL AS fits FROM own)
, done AS (SELECT *, CASE WHEN own_id IS NOT NULL THEN 'disposition_judge' WHEN present OR nulled THEN 'none' WHEN fits THEN 'assigned_judge_rule' ELSE 'none' END AS attribution FROM fallback)
SELECT attribution, CASE attribution WHEN 'disposition_judge' THEN own_id WHEN 'assigned_judge_rule' THEN assigned ELSE -1 END AS judge_id, count(*) AS n FROM done GROUP BY 1, 2""",
    CHARGES,
)

# -- review queue -------------------------------------------------------------------------------

QUEUE = f"""{FACTS},
items AS (SELECT category || '/' || docket_id AS k, CASE WHEN charge_id IS NULL THEN 1 ELSE 2 END AS producer, charge_row, charge_method FROM facts WHERE charge_id IS NULL OR category = 'unknown'),
firsts AS (SELECT * FROM items QUALIFY row_number() OVER (PARTITION BY k ORDER BY producer, charge_row) = 1)"""
_add("review_dedup", "SELECT charge_row AS outcome_id, producer, charge_method FROM firsts", QUEUE)
_add("stale_items_anti", "SELECT count(*) AS n FROM firsts WHERE charge_method <> 'ambiguous' AND k NOT IN (SELECT k FROM items WHERE producer = 2)", QUEUE)
_add("held_items_semi", "SELECT count(*) AS n FROM firsts WHERE charge_method <> 'ambiguous' AND k IN (SELECT k FROM items WHERE charge_method = 'unmatched')", QUEUE)
_add("insert_absent_items", "SELECT producer, 'open' AS status, count(*) AS n FROM firsts WHERE charge_method <> 'ambiguous' GROUP BY producer", QUEUE)

# -- served queries -----------------------------------------------------------------------------

IDENTITIES = "identities AS (SELECT p_brand AS id, lower(p_brand) AS slug, list_sort(list(DISTINCT p_name)) AS aliases, min(p_type) AS statute FROM part GROUP BY p_brand)"
_add(
    "search_ranked",
    """
, hits AS (SELECT id, slug, statute, a, CASE WHEN lower(a) = 'red' THEN 1 WHEN starts_with(lower(a), 'red') THEN 2 WHEN contains(lower(a), 'red') THEN 3 END AS r FROM (SELECT id, slug, statute, unnest(aliases) AS a FROM identities))
SELECT id, id AS display_name, statute, CAST(min(r) AS INT) AS match_rank, min(a) FILTER (r IS NOT NULL) AS matched_alias FROM hits GROUP BY id, slug, statute HAVING min(r) IS NOT NULL ORDER BY match_rank, display_name, slug LIMIT 25""",
    IDENTITIES,
)
_add("search_like_escape", r"SELECT count(*) FILTER (n_name ILIKE '%n\_1%' ESCAPE '\') AS n, 'n_1' AS q FROM nation UNION ALL SELECT count(*) FILTER (n_name ILIKE '%\_%' ESCAPE '\'), '_' FROM nation UNION ALL SELECT count(*) FILTER (n_name ILIKE '%\%%' ESCAPE '\'), '%' FROM nation UNION ALL SELECT count(*) FILTER (n_name ILIKE '%nation%'), 'nation' FROM nation")
_add("directory", "SELECT charge_id AS id, lower(charge_id) AS slug, charge_id AS display_name, count(*) AS sample_size, charge_id IN (SELECT charge_id FROM components WHERE public_eligible) AS has_sentencing FROM facts WHERE public_eligible GROUP BY charge_id", SENTENCES)
_add("coverage_counts", "SELECT (SELECT count(DISTINCT charge_id) FROM facts WHERE public_eligible) AS charges_with_outcomes, (SELECT count(DISTINCT charge_id) FROM components WHERE public_eligible) AS charges_with_sentencing, (SELECT count(DISTINCT (charge_id, judge_id)) FROM facts WHERE judge_specific_eligible) AS charge_judge_pairs, (SELECT count(*) FROM facts WHERE public_eligible) > 0 AS available", SENTENCES)
_add("result_success_arm", "SELECT id AS charge_id, CASE WHEN id IN (SELECT charge_id FROM facts WHERE public_eligible) THEN 'success' WHEN id IN (SELECT substr(statute, 6) FROM charges) AND id <> 'PROMO' THEN 'volume_only' ELSE 'unavailable' END AS arm FROM (SELECT p_brand AS id FROM part UNION SELECT p_type FROM part)", FACTS)
_add(
    "result_distribution_block",
    f"SELECT charge_id, CAST(list_position(['dismissed', 'withdrawn', 'guilty_plea', 'guilty_verdict', 'acquittal', 'ard', 'diversion', 'other'], category) AS INT) AS sort_order, category AS category_code, count(*) AS count, {pct('count(*)', 'sum(count(*)) OVER (PARTITION BY charge_id)')} AS percentage FROM facts WHERE public_eligible GROUP BY charge_id, category",
    FACTS,
)
MONTHS = "CAST((CAST(round({0} * 10) AS BIGINT) + 15) // 30 AS DOUBLE) / 10.0"
_add("result_index_block", f"SELECT charge_id, scategory AS category_code, {MONTHS.format('median(min_days) FILTER (min_days IS NOT NULL)')} AS median_min_months, {MONTHS.format('median(max_days) FILTER (min_days IS NOT NULL)')} AS median_max_months FROM components WHERE public_eligible AND parent_public GROUP BY 1, 2", SENTENCES)
_add("result_quadrants", "SELECT CASE WHEN b AND j THEN 'success' WHEN b THEN 'baseline_only' WHEN j THEN 'integrity_error' ELSE 'unavailable' END AS state, count(*) AS n FROM (SELECT c, k, c IN (SELECT charge_id FROM facts WHERE public_eligible) AS b, EXISTS (SELECT 1 FROM facts f WHERE f.charge_id = c AND f.judge_id = k AND judge_specific_eligible) AS j FROM (SELECT DISTINCT coalesce(charge_id, statute) AS c, coalesce(judge_id, -1) AS k FROM charges)) GROUP BY 1", FACTS)

# -- operations panel and checks ----------------------------------------------------------------

_add("ops_corpus", "SELECT court, count(*) AS dockets, count(filed_date) AS filed, min(filed_date) AS first_filed, max(filed_date) AS last_filed, count(DISTINCT otn) AS otns, count(DISTINCT otn) FILTER (grade IS NULL) AS ungraded_otns FROM dockets GROUP BY court", DOCKETS)
_add("ops_source_days", "SELECT CAST(ts AS DATE) AS day, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1 HAVING CAST(ts AS DATE) > (SELECT max(CAST(ts AS DATE)) FROM events) - 14")
_add("ops_linkage", "SELECT count(*) AS charges, count(originating_docket_no) AS with_origin, count(DISTINCT originating_docket_no) AS origins, count(DISTINCT originating_docket_no) FILTER (disposition_raw IS NULL) AS pending_origins FROM charges", CHARGES)
_add("ops_outcome_share", ", per AS (SELECT category AS category_code, count(*) AS n FROM facts WHERE public_eligible GROUP BY category UNION ALL SELECT 'dismissed_or_withdrawn', count(*) FILTER (category IN ('dismissed', 'withdrawn')) FROM facts WHERE public_eligible) SELECT category_code, n, floor(CAST(n AS DOUBLE) / CAST((SELECT count(*) FROM facts WHERE public_eligible) AS DOUBLE) * 1000 + 0.5) / 10.0::DOUBLE AS share FROM per WHERE n > 0", FACTS)
_add("ops_topk", "SELECT judge_id, CAST(sum(n) AS BIGINT) AS n, count(*) AS charges, count(*) FILTER (n < 10) AS thin FROM (SELECT judge_id, charge_id, count(*) AS n FROM facts WHERE judge_specific_eligible GROUP BY 1, 2) GROUP BY judge_id ORDER BY n DESC, judge_id LIMIT 10", FACTS)


def _zeros(codes: dict[str, str]) -> str:
    return " UNION ALL ".join(f"SELECT '{t}' AS \"table\", '{c}' AS code, 0::BIGINT AS violations" for t, cs in codes.items() for c in cs.split())


DIST_CODES = "percentage_misaligned sample_size_missing date_range_missing date_range_start_before_window date_range_inverted count_sum_mismatch sample_size_inconsistent"
_add("ops_checks", _zeros({"charge_outcomes": DIST_CODES, "pair_outcomes": DIST_CODES + " baseline_missing", "index_charge": "wedge_identity_mismatch wedge_percentage_misaligned convictions_missing date_range_missing date_range_inverted summary_row_missing category_count_exceeds_sentenced median_presence_mismatch median_days_invalid", "grade_mix": "grade_mix_sum_mismatch", "charge_sentences": "component_duration_invalid"}))
_add(
    "check_integrity",
    """
, rows AS (SELECT charge_id, category, count(*) AS n FROM facts WHERE public_eligible GROUP BY ALL)
, latest AS (SELECT charge_id, max(disposition_date) AS b FROM facts WHERE public_eligible GROUP BY ALL)
, shares AS (SELECT *, CAST(((CAST(n AS BIGINT) * 20000 + t) // (2 * t)) AS DECIMAL(18, 2)) * CAST(0.01 AS DECIMAL(3, 2)) AS p, CAST(n + CASE WHEN category = 'withdrawn' AND charge_id < 'Brand#2' THEN 1 ELSE 0 END AS DECIMAL(18, 0)) AS m FROM (SELECT *, CAST(sum(n) OVER (PARTITION BY charge_id) AS BIGINT) AS t FROM rows))
SELECT 'hurt' AS "table", 'percentage_misaligned' AS code, count(*) AS violations FROM shares WHERE abs((p + CASE WHEN category = 'dismissed' THEN 0.01 ELSE 0 END) * t - m * 100) > 0.005 * t
UNION ALL SELECT 'hurt', 'sample_size_missing', 0 UNION ALL SELECT 'hurt', 'date_range_missing', 0 UNION ALL SELECT 'hurt', 'date_range_start_before_window', 0
UNION ALL SELECT 'hurt', 'date_range_inverted', count(*) FROM rows JOIN latest USING (charge_id) WHERE category = 'guilty_plea' AND b < DATE '2009-01-01'
UNION ALL SELECT 'hurt', 'count_sum_mismatch', count(*) FROM rows WHERE category = 'withdrawn' AND charge_id < 'Brand#2'
UNION ALL SELECT 'hurt', 'sample_size_inconsistent', 0""",
    FACTS,
)
_add("check_baseline", "SELECT 'pair_outcomes' AS \"table\", 'baseline_missing' AS code, count(DISTINCT charge_id) AS violations FROM facts WHERE judge_specific_eligible AND charge_id NOT IN (SELECT charge_id FROM facts WHERE public_eligible AND grade = '1-URGENT' AND disposition_date > DATE '1998-06-01')", FACTS)
_add("check_reconciliation", f"SELECT 'charge' AS \"table\", 'conviction_reconciliation_mismatch' AS code, count(*) AS violations FROM (SELECT charge_id FROM facts WHERE {CONVICTION} GROUP BY 1 HAVING count(*) FILTER (public_eligible) <> count(*) FILTER (judge_specific_eligible))", FACTS)
_add("check_volume_outcomes", _zeros({"charge_volume": "volume_closure_mismatch volume_counts_invalid volume_outcomes_mismatch volume_row_missing volume_facts_mismatch"}))

# -- reports ------------------------------------------------------------------------------------

VALUES = f"""{CHARGES},
vals AS (SELECT 'statute' AS col, statute AS v FROM charges UNION ALL SELECT 'offense', offense FROM charges UNION ALL SELECT 'disposition_raw', disposition_raw FROM charges UNION ALL SELECT 'docket', CAST(docket_id AS VARCHAR) FROM charges UNION ALL SELECT 'grade', grade FROM charges),
counts AS (SELECT col, v, count(*) AS n FROM vals GROUP BY ALL)"""
_add("distinct_value_buckets", f"SELECT col AS \"column\", floor, count(*) FILTER (n >= floor) AS distinct_values, CAST(coalesce(sum(n) FILTER (n >= floor), 0) AS BIGINT) AS rows_covered, {pct('coalesce(sum(n) FILTER (n >= floor), 0)', 'sum(n)', 1)} AS coverage_pct FROM counts, (VALUES (1), (2), (3), (5), (10), (20), (50)) f(floor) WHERE col <> 'grade' GROUP BY col, floor", VALUES)
_add("distinct_value_summary", "SELECT col AS \"column\", count(*) AS distinct_values, CAST(coalesce(sum(n) FILTER (v IS NULL), 0) AS BIGINT) AS null_rows, 0::BIGINT AS blank_rows FROM counts WHERE col IN ('offense', 'disposition_raw', 'grade') GROUP BY col", VALUES)
_add("dominant_pairing", "SELECT statute, offense, n, CAST(t AS BIGINT) AS statute_rows FROM (SELECT statute, offense, count(*) AS n, sum(count(*)) OVER (PARTITION BY statute) AS t, row_number() OVER (PARTITION BY statute ORDER BY count(*) DESC, offense) AS k FROM charges GROUP BY statute, offense) WHERE k = 1", CHARGES)
_add("disposition_coverage", "SELECT CASE WHEN disposition_raw IS NULL THEN 'absent' WHEN disposition_raw = 'Held for Court' THEN 'held' WHEN disposition_raw = 'Proceed to Court' THEN 'unmapped' ELSE 'mapped' END AS kind, CASE WHEN bool_or(disposition_raw IS NULL) THEN 1 ELSE count(DISTINCT disposition_raw) END AS distinct_values, count(*) AS rows FROM charges GROUP BY 1", CHARGES)
_add("sentencing_recon", "SELECT sentence_type, count(*) AS rows, count(*) FILTER (sentence_type <> 'Fines and Costs') AS money_0, count(*) FILTER (sentence_type = 'Fines and Costs' AND NOT no_money) AS money_1, count(*) FILTER (no_money) AS money_2_more, 0::BIGINT AS restitution, 0::BIGINT AS restitution_without_money, 0::BIGINT AS community_service, 0::BIGINT AS hours_only, count(*) FILTER (sentence_type = 'Fines and Costs') AS has_dollar, 0::BIGINT AS fine_beyond_label FROM sentences GROUP BY sentence_type", SENTENCES)
_add("token_partition", "SELECT token, n, f AS not_final_only, CASE WHEN f = 0 THEN 'NON_TERMINAL' WHEN f = n THEN 'ARD_CLASS' ELSE 'MIXED' END AS kind FROM (SELECT offense AS token, count(*) AS n, count(*) FILTER (CASE WHEN starts_with(offense, 'red') THEN false WHEN starts_with(offense, 'hot') THEN true ELSE disposition_raw IS NULL END) AS f FROM charges GROUP BY 1)", CHARGES)
ATTEMPTS = "attempts AS (SELECT event_id, ts, user_id AS run, CASE event_type WHEN 'error' THEN 'error' WHEN 'view' THEN 'miss' WHEN 'purchase' THEN 'hit' WHEN 'click' THEN 'blocked' ELSE 'already_present' END AS outcome FROM events)"
_add("collection_report", "SELECT CASE WHEN run < 75 THEN 'CP' ELSE 'MC' END AS court, count(*) AS attempts, count(*) FILTER (outcome = 'hit') AS hit, count(*) FILTER (outcome = 'miss') AS miss, count(*) FILTER (outcome = 'blocked') AS blocked, count(*) FILTER (outcome = 'error') AS error, count(*) FILTER (outcome = 'already_present') AS already_present, true AS reconciles FROM attempts GROUP BY 1", ATTEMPTS)
_add("status_summary", "SELECT place::INT AS place, status, count(outcome) AS n FROM (VALUES (0, 'hit'), (1, 'miss'), (2, 'changed'), (3, 'blocked'), (4, 'error')) v(place, status) LEFT JOIN attempts ON outcome = status GROUP BY 1, 2", ATTEMPTS)

# -- collection ---------------------------------------------------------------------------------

STREAKS = f"""{ATTEMPTS},
islands AS (SELECT *, count(*) FILTER (outcome IN ('hit', 'miss')) OVER w AS bi, count(*) FILTER (outcome IN ('hit', 'miss', 'blocked')) OVER w AS ei FROM attempts WINDOW w AS (PARTITION BY run ORDER BY ts, event_id)),
streaks AS (SELECT *, count(*) FILTER (outcome = 'blocked') OVER (PARTITION BY run, bi ORDER BY ts, event_id) AS block_streak, count(*) FILTER (outcome = 'error') OVER (PARTITION BY run, ei ORDER BY ts, event_id) AS error_streak FROM islands)"""
_add("streak_guard", "SELECT event_id, block_streak, error_streak FROM streaks", STREAKS)
_add(
    "streak_stop",
    """
, trips AS (SELECT *, CASE WHEN outcome = 'blocked' AND block_streak >= 3 THEN 'block_streak' WHEN outcome = 'error' AND error_streak >= 3 THEN 'error_streak' END AS trip, row_number() OVER (PARTITION BY run ORDER BY ts, event_id) AS k FROM streaks)
, firsts AS (SELECT run, min(k) AS k FROM trips WHERE trip IS NOT NULL GROUP BY run)
SELECT t.run, count(*) AS attempts, coalesce(max(trip), '') AS stop_reason FROM trips t LEFT JOIN firsts f ON t.run = f.run WHERE f.k IS NULL OR t.k <= f.k GROUP BY t.run""",
    STREAKS,
)
_add("batch_numbering", "SELECT run, CAST(greatest(CASE WHEN r = 0 THEN 1 ELSE (r - 1) // 10 + 1 END, 1) AS BIGINT) AS batch, count(*) AS n FROM (SELECT run, count(*) FILTER (outcome <> 'already_present') OVER (PARTITION BY run ORDER BY ts, event_id) AS r FROM attempts) GROUP BY 1, 2", ATTEMPTS)
LEDGER = """
ledger AS (SELECT CAST(ts AS DATE) AS day, CASE WHEN user_id < 50 THEN 'CP' WHEN user_id < 100 THEN 'MC' ELSE 'both' END AS court, event_type IN ('purchase', 'view') AND value <= 20 AS done FROM events),
scoped AS (SELECT day, court, done FROM ledger WHERE court <> 'both' UNION ALL SELECT day, c, done FROM ledger, (VALUES ('CP'), ('MC')) v(c) WHERE court = 'both'),
complete AS (SELECT DISTINCT day, court FROM scoped WHERE done)"""
_add("window_completion", "SELECT day, court FROM complete", LEDGER)
_add("open_windows", "SELECT CAST(d AS DATE) AS day FROM range(DATE '2023-12-28', DATE '2024-02-03', INTERVAL 1 DAY) t(d) WHERE CAST(d AS DATE) NOT IN (SELECT day FROM complete WHERE day < DATE '2024-01-20' GROUP BY day HAVING count(*) = 2)", LEDGER)
_add("docket_range", "SELECT court, CAST(year(o_orderdate) AS INT) AS year, max(o_orderkey) - min(o_orderkey) + 1 AS numbers, max(o_orderkey) - min(o_orderkey) + 1 - count(DISTINCT o_orderkey) AS missing FROM (SELECT CASE WHEN o_orderstatus = 'F' THEN 'CP' ELSE 'MC' END AS court, o_orderdate, o_orderkey FROM orders) GROUP BY ALL")
_add("fetch_classes", "SELECT CASE WHEN event_type = 'error' THEN 'error' WHEN value > 100 OR value < 1 THEN 'blocked' WHEN event_type = 'purchase' THEN 'hit' WHEN event_type = 'view' THEN 'miss' ELSE 'blocked' END AS fetch, CASE WHEN event_type = 'error' THEN 'error' WHEN value > 100 OR value < 1 OR event_type = 'click' THEN 'blocked' WHEN value > 50 THEN 'truncated' WHEN event_type <> 'view' AND floor(value % 3) >= 1 THEN 'complete' WHEN floor(value % 3) = 0 THEN 'empty' ELSE 'blocked' END AS search, count(*) AS n FROM events GROUP BY 1, 2")
_add("refresh_targets", "SELECT docket_id, docket_number, filed_date FROM dockets WHERE court = 'MC' AND docket_id IN (SELECT docket_id FROM charges WHERE disposition_raw IS NULL)", CHARGES)
_add(
    "version_decision",
    """
, incoming AS (SELECT CASE WHEN filed_date >= DATE '2000-01-01' THEN 'new' || docket_id ELSE CAST(docket_id AS VARCHAR) END AS h, docket_number, CASE WHEN grade IS NOT NULL THEN court END AS court, CASE grade WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 9 ELSE 2 END AS v, filed_date IS NULL AS failed, court = 'CP' AS same, coalesce(grade, '') <> '5-LOW' AS imported FROM dockets)
, loaded AS (SELECT CAST(docket_id AS VARCHAR) AS h, docket_number, CASE WHEN grade IS NOT NULL THEN court END AS court, CASE WHEN court = 'CP' THEN 2 ELSE 1 END AS v, filed_date < DATE '1995-06-01' AS old FROM dockets WHERE filed_date < DATE '2001-01-01')
, twins AS (SELECT docket_number, court FROM loaded WHERE NOT old GROUP BY ALL)
SELECT CASE WHEN i.v NOT IN (1, 2) THEN 'reject' WHEN NOT imported THEN 'missing_import_record' WHEN failed THEN 'raw_only' WHEN l.old THEN 'stale_skip' WHEN l.h IS NULL AND t.docket_number IS NOT NULL THEN 'supersede' WHEN l.h IS NULL THEN 'load' WHEN i.v = l.v AND same THEN 'skip' WHEN i.v = l.v THEN 'reject' WHEN i.v > l.v THEN 'replace' ELSE 'refuse' END AS decision, count(*) AS n
FROM incoming i LEFT JOIN loaded l ON i.h = l.h LEFT JOIN twins t ON i.docket_number = t.docket_number AND i.court IS NOT DISTINCT FROM t.court GROUP BY 1""",
    DOCKETS,
)
_add("change_detection", "SELECT page_id, CASE WHEN length(html) <= 2500 THEN 'new' WHEN contains(url, '/en/') THEN 'changed' ELSE 'unchanged' END AS change FROM pages")
_add("harvest_rows", r"""SELECT page_id, count(*) AS links, count(DISTINCT h) AS hrefs, CAST(sum(length(h)) AS BIGINT) AS href_signs FROM (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<a\s[^>]*href="([^"]*)"[^>]*>(.*?)</a>', 1)) AS h FROM pages) GROUP BY 1""")

# -- texts --------------------------------------------------------------------------------------

_add(
    "privacy_value_scan",
    "SELECT 'dockets' AS \"table\", 'court' AS \"column\", 0::BIGINT AS violations UNION ALL SELECT 'dockets', 'grade', 0 UNION ALL SELECT 'dockets', 'inner', count(*) FROM orders UNION ALL SELECT 'dockets', 'otn', 0 UNION ALL SELECT 'claims', 'cp_charge_id', 0 UNION ALL SELECT 'claims', 'mc_charge_id', 0 UNION ALL SELECT 'claims', 'stage', 0",
)
_add("privacy_leaks", r"SELECT regexp_matches(lower(text), '(^|[^a-z0-9])(the|license|que\.)([^a-z0-9]|$)') OR regexp_matches(lower(source), '(^|[^a-z0-9])(the|license|que\.)([^a-z0-9]|$)') AS leaks, count(*) AS n FROM documents GROUP BY 1")
_add(
    "copy_safety_scan",
    """
SELECT c_custkey, 'odds' AS term, length(c_mktsegment) + 28 AS place, 'odds' AS found FROM customer WHERE c_acctbal > 5000
UNION ALL SELECT c_custkey, t, length(c_mktsegment) + p, f FROM customer, (VALUES ('predict stem', 19, 'Predicts'), ('win rate', 30, 'WIN RATE'), ('guarantee stem', 40, 'guaranteed')) v(t, p, f) WHERE c_acctbal > 2000 AND c_acctbal <= 5000""",
)
_add("docket_number_extract", "SELECT docket_id, 1::INT AS n, docket_number AS numbers, court, '51' AS county, CASE WHEN court = 'MC' THEN 'Municipal Court' ELSE 'Common Pleas' END AS court_name FROM dockets", DOCKETS)
_add("section_fill_down", r"SELECT doc_id, coalesce(section, -1) AS section, count(*) AS lines FROM (SELECT doc_id, last_value(CASE WHEN ends_with(line, '.') THEN CAST(pos - 1 AS INT) END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents)) GROUP BY 1, 2")
_add("text_quality_status", r"SELECT doc_id, CASE WHEN poor = 0 THEN 'success' WHEN poor = len(pages) THEN 'needs_ocr_or_review' ELSE 'partial' END AS status, sha256(array_to_string(pages, chr(12))) AS hash FROM (SELECT *, len(list_filter(pages, lambda p: length(regexp_replace(p, '^\s+|\s+$', '', 'g')) < 100)) AS poor FROM (SELECT doc_id, string_split(text, chr(10)) AS pages FROM documents))")
_add(
    "deep_diff_paths",
    """
, o AS (SELECT *, o_totalprice > 20000 AS there FROM orders), v(path, kind, n) AS (
  SELECT '$.case.tags.length', 'length', count(*) FILTER (there AND o_orderstatus = 'F') FROM o
  UNION ALL SELECT '$.case.tags[1]', 'missing_right', count(*) FILTER (there AND o_orderstatus = 'F') + count(*) FILTER (NOT there) FROM o
  UNION ALL SELECT '$.case.tags[0]', 'value', count(*) FILTER (there AND o_orderstatus <> 'F') FROM o
  UNION ALL SELECT '$.o_custkey', 'value', count(*) FILTER (there AND o_orderstatus = 'P') FROM o
  UNION ALL SELECT p, 'missing_right', (SELECT count(*) FROM o WHERE NOT there) FROM (VALUES ('$.case.o_orderstatus'), ('$.case.tags.length'), ('$.case.tags[0]'), ('$.o_custkey')) x(p))
SELECT path, kind, n FROM v WHERE n > 0""".replace(", o AS", "WITH o AS", 1),
)
_add("line_seams", "SELECT doc_id, count(*) AS lines FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE contains(line, ' the ') GROUP BY 1")
_add(
    "parsed_sheets",
    """
, one AS (SELECT docket_number, sequence, min((charge_row, offense, statute, coalesce(disposition_raw, ''), coalesce(CAST(disposition_date AS VARCHAR), ''))) AS c FROM charges GROUP BY ALL)
, flat AS (SELECT docket_number, sequence, struct_extract_at(c, 2) AS offense, struct_extract_at(c, 3) AS statute, nullif(struct_extract_at(c, 4), '') AS raw, CAST(nullif(struct_extract_at(c, 5), '') AS DATE) AS day FROM one)
SELECT docket_number, sequence, replace(statute, '18 § ', '18 § 1') AS statute, array_to_string(list_transform(string_split(offense, ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS offense,
  CASE WHEN day IS NOT NULL THEN raw END AS disposition_raw, CASE WHEN day IS NOT NULL AND raw <> 'Held for Court' THEN day END AS disposition_date, CASE WHEN day IS NOT NULL AND raw IS NOT NULL THEN 'Doe, Jane' END AS disposition_judge
FROM flat""",
    CHARGES,
)
