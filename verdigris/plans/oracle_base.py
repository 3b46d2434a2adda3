"""The bindings once more in SQL, written independently of the operators, as common table expressions."""

WINDOW, FLOOR = "DATE '1998-01-01'", "DATE '1996-01-01'"

DOCKETS = """
dockets AS (
  SELECT o_orderkey AS docket_id, o_custkey, CASE WHEN o_orderstatus = 'F' THEN 'CP' ELSE 'MC' END AS court,
    (CASE WHEN o_orderstatus = 'F' THEN 'CP' ELSE 'MC' END) || '-51-CR-' || printf('%07d', o_orderkey) || '-' || CAST(year(o_orderdate) AS VARCHAR) AS docket_number,
    CASE WHEN o_orderpriority <> '5-LOW' OR o_totalprice > 50000 THEN CAST(o_orderdate AS DATE) END AS filed_date,
    'otn  ' || CAST(o_custkey AS VARCHAR) AS otn, nullif(o_orderpriority, '4-NOT SPECIFIED') AS grade
  FROM orders),
linked AS (
  SELECT *, CASE WHEN court = 'CP' THEN last_value(CASE WHEN court = 'MC' THEN docket_number END IGNORE NULLS) OVER (PARTITION BY o_custkey ORDER BY docket_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) END AS originating_docket_no
  FROM dockets)"""

CHARGES = f"""{DOCKETS},
lines AS (
  SELECT *, CAST(round(l_tax * 100) AS INT) AS tax, CAST(round(l_discount * 100) AS INT) AS discount, l_returnflag || l_linestatus AS flag FROM lineitem),
charges AS (
  SELECT CAST(l_orderkey AS VARCHAR) || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS charge_row, docket_id, court, docket_number, otn, filed_date, grade, originating_docket_no,
    l_linenumber AS sequence, p_name AS offense, '18 § ' || p_type AS statute,
    CASE flag WHEN 'AF' THEN 'Guilty Plea - Negotiated' WHEN 'AO' THEN 'Guilty' WHEN 'RF' THEN 'Nolle Prossed' WHEN 'RO' THEN (CASE WHEN l_linenumber = 4 THEN 'Proceed to Court' ELSE 'Withdrawn' END) WHEN 'NF' THEN 'Held for Court' END AS disposition_raw,
    CASE flag WHEN 'AF' THEN 'guilty_plea' WHEN 'AO' THEN 'guilty_verdict' WHEN 'RF' THEN 'dismissed' WHEN 'RO' THEN (CASE WHEN l_linenumber = 4 THEN 'unknown' ELSE 'withdrawn' END) END AS category,
    CASE WHEN flag <> 'NO' AND l_quantity <> 1 THEN CAST(l_shipdate AS DATE) END AS disposition_date,
    CASE p_type WHEN 'PROMO' THEN 'unmatched' WHEN 'LARGE' THEN 'ambiguous' WHEN 'SMALL' THEN 'alias' WHEN 'MEDIUM' THEN 'statute' ELSE 'exact' END AS charge_method,
    CASE WHEN p_type NOT IN ('PROMO', 'LARGE') THEN p_brand END AS charge_id, p_type = 'LARGE' AS conflict,
    discount = 0 AS review, CASE WHEN tax > 0 THEN l_suppkey END AS judge_id, tax > 0 AS attributed,
    CAST(l_shipdate AS DATE) AS ship_date, CAST(l_quantity AS INT) AS quantity, tax, discount, CAST(floor(l_extendedprice) AS BIGINT) AS price
  FROM lines JOIN linked ON l_orderkey = docket_id JOIN part ON l_partkey = p_partkey)"""

FACTS = f"""{CHARGES},
flags AS (
  SELECT *, coalesce(disposition_date >= {WINDOW}, false) AS mvp_eligible, coalesce(filed_date >= {FLOOR}, false) AS filed_ok, charge_id IS NOT NULL AS clean FROM charges),
gated AS (
  SELECT *, mvp_eligible AND filed_ok AND clean AND category <> 'unknown' AND NOT review AS public_eligible FROM flags WHERE category IS NOT NULL),
facts AS (
  SELECT *, public_eligible AND attributed AS judge_specific_eligible,
    list_filter([
      CASE WHEN disposition_date IS NULL THEN 'disposition_date_missing' WHEN NOT mvp_eligible THEN 'disposition_date_before_mvp_window' END,
      CASE WHEN filed_date IS NULL THEN 'filed_date_missing' WHEN NOT filed_ok THEN 'filed_date_before_floor' END,
      CASE WHEN NOT clean THEN 'charge_not_normalized' END, CASE WHEN conflict THEN 'blocking_warning' END,
      CASE WHEN category = 'unknown' THEN 'disposition_not_mapped' END, CASE WHEN review THEN 'review_needed' END,
      CASE WHEN public_eligible AND NOT attributed THEN 'judge_not_attributed' END], lambda x: x IS NOT NULL) AS reasons
  FROM gated)"""

SENTENCES = f"""{FACTS},
sentences AS (
  SELECT charge_row, 'Probation' AS sentence_type, 'probation' AS scategory, CASE WHEN tax = 0 THEN quantity * 30 ELSE quantity END AS min_days, CASE WHEN tax = 0 THEN quantity * 30 ELSE quantity * 2 END AS max_days, tax = 0 AS min_assumed, false AS no_duration, false AS no_money, NULL::BIGINT AS amount_cents
  FROM charges WHERE category IN ('guilty_plea', 'guilty_verdict') AND discount >= 5
  UNION ALL SELECT charge_row, 'Confinement', 'incarceration', CASE WHEN discount = 4 THEN 540 END, CASE WHEN discount = 4 THEN 540 END, discount = 4, discount = 3, false, NULL
  FROM charges WHERE category IN ('guilty_plea', 'guilty_verdict') AND discount IN (3, 4)
  UNION ALL SELECT charge_row, 'Fines and Costs', 'costs_fees', NULL, NULL, false, false, sequence = 1 AND price <> 5, CASE WHEN sequence <> 1 OR price = 5 THEN price * 100 END
  FROM charges WHERE category IN ('guilty_plea', 'guilty_verdict') AND tax >= 4),
dated AS (
  SELECT s.*, f.charge_id, f.judge_id, f.attributed, f.category, f.public_eligible AS parent_public, f.judge_specific_eligible AS parent_specific, f.filed_date, f.filed_ok, f.disposition_date,
    CASE WHEN f.quantity <> 2 THEN CAST(f.ship_date + (f.sequence - 2) AS DATE) END AS sentence_date
  FROM sentences s JOIN facts f USING (charge_row)),
components AS (
  SELECT *, coalesce(sentence_date >= {WINDOW}, false) AS mvp_eligible, parent_public AND coalesce(sentence_date >= {WINDOW}, false) AND filed_ok AND NOT no_money AND NOT no_duration AS public_eligible FROM dated)"""


def with_base(base: str, query: str) -> str:
    return f"WITH {base.strip()}\n{query.strip()}"


def pct(k: str, n: str, digits: int = 2) -> str:
    """Exact half-up percentage in integers."""
    unit = 10**digits
    return f"CAST((CAST({k} AS BIGINT) * {200 * unit} + CAST({n} AS BIGINT)) // nullif(2 * CAST({n} AS BIGINT), 0) AS DOUBLE) / {float(unit)}"
