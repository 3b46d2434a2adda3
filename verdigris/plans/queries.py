"""Registered queries: every operator applied to whole driver tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import vocab as V
from ..functions import names, numbers, text
from ..operators import aggregates as A
from ..operators import checks, collector, compare, eligibility, facts, linkage, matching, panel, privacy, reports, review, sheets
from . import bindings as B
from . import serve

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(f: Query) -> Query:
    REGISTRY[f.__name__] = f
    return f


def _outcome_distribution(own: DataFrame, keys: list[str]) -> DataFrame:
    return A.distribution(own, keys, category="outcome_category_code", date="disposition_date", eligible="public_eligible" if keys == B.CHARGE else "judge_specific_eligible")


def _component_distribution(parts: DataFrame, keys: list[str]) -> DataFrame:
    return A.distribution(parts, keys, category="sentencing_category_code", date="sentence_date", eligible="public_eligible" if keys == B.CHARGE else "judge_specific_eligible", sample="sentencing_sample_size")


# -- aggregates ---------------------------------------------------------------------------------


@query
def charge_outcome_distribution(spark, sf_dir):
    return _outcome_distribution(B.outcomes(spark, sf_dir), B.CHARGE)


@query
def pair_outcome_distribution(spark, sf_dir):
    return _outcome_distribution(B.outcomes(spark, sf_dir), B.PAIR)


@query
def charge_component_distribution(spark, sf_dir):
    return _component_distribution(B.facts(spark, sf_dir)[1], B.CHARGE)


@query
def pair_component_distribution(spark, sf_dir):
    return _component_distribution(B.facts(spark, sf_dir)[1], B.PAIR)


@query
def index_summary_charge(spark, sf_dir):
    return A.index_summary(*B.facts(spark, sf_dir), B.CHARGE, eligible="public_eligible")


@query
def index_summary_pair(spark, sf_dir):
    return A.index_summary(*B.facts(spark, sf_dir), B.PAIR, eligible="judge_specific_eligible")


@query
def index_category_charge(spark, sf_dir):
    return A.index_categories(*B.facts(spark, sf_dir), B.CHARGE, eligible="public_eligible")


@query
def index_category_pair(spark, sf_dir):
    return A.index_categories(*B.facts(spark, sf_dir), B.PAIR, eligible="judge_specific_eligible")


@query
def index_grade_mix(spark, sf_dir):
    return A.grade_mix(B.outcomes(spark, sf_dir))


def _corpus(spark, sf_dir) -> DataFrame:
    """All charges with their stage in the funnel."""
    rows = B.charges(spark, sf_dir, origins=True)
    pointers = linkage.supersessions(rows)
    d = matching.disposition(F.col("disposition_raw"))
    rows = eligibility.gate_outcomes(rows.withColumns({"mapped": d["mapped"], "category_public": d["public"], "held": d["held"]}), window=B.WINDOW, floor=B.FLOOR)
    rows = rows.join(pointers, rows.charge_id == pointers.mc_charge_id, "left").withColumn("superseded", F.col("superseded_by").isNotNull())
    stage = A.journey(F.col("disposition_raw"), F.col("held"), F.col("public_eligible"), F.col("superseded"), F.col("filed_date"), B.FLOOR)
    return rows.select(F.col("normalized_charge_id").alias("charge_id"), "charge_method", "superseded", "public_eligible", "held", stage.alias("stage"))


@query
def volume_funnel(spark, sf_dir):
    return A.volume_funnel(_corpus(spark, sf_dir))


@query
def volume_totals(spark, sf_dir):
    return A.volume_totals(_corpus(spark, sf_dir))


@query
def exclusion_reasons(spark, sf_dir):
    return A.reason_tally(B.outcomes(spark, sf_dir))


@query
def data_range(spark, sf_dir):
    own, parts = B.facts(spark, sf_dir)
    return A.data_range([_outcome_distribution(own, B.CHARGE), _component_distribution(parts, B.CHARGE)], B.FLOOR)


@query
def charges_without_sentencing(spark, sf_dir):
    own, parts = B.facts(spark, sf_dir)
    return A.without_components(_outcome_distribution(own, B.PAIR), _component_distribution(parts, B.PAIR)).agg(F.count("*").alias("n"))


# -- facts and gates ----------------------------------------------------------------------------


@query
def eligibility_gate(spark, sf_dir):
    return B.outcomes(spark, sf_dir).select("outcome_id", "outcome_category_code", "mvp_eligible", "public_eligible", "judge_specific_eligible", F.concat_ws(",", "reasons").alias("reasons"))


@query
def component_gate(spark, sf_dir):
    parts = B.facts(spark, sf_dir)[1]
    return parts.select("sentence_id", "sentencing_category_code", "component_method", "min_days", "max_days", "min_assumed", "amount_cents", "mvp_eligible", "public_eligible", "judge_specific_eligible")


@query
def gate_invariants(spark, sf_dir):
    own, parts = B.facts(spark, sf_dir)
    broken = lambda df, name: eligibility.broken_invariants(df).agg(F.count("*").alias("broken")).withColumn("facts", F.lit(name))
    return broken(own, "outcomes").unionByName(broken(parts, "components"))


@query
def fact_counts(spark, sf_dir):
    return facts.build_counts(B.charges(spark, sf_dir))


@query
def reason_tally_with_zeros(spark, sf_dir):
    return facts.full_tally(B.outcomes(spark, sf_dir))


@query
def component_tallies(spark, sf_dir):
    return facts.component_tallies(B.facts(spark, sf_dir)[1])


@query
def lag_report(spark, sf_dir):
    own, parts = B.facts(spark, sf_dir)
    return facts.lag_report(parts.select("outcome_id", "sentence_date").join(own.select("outcome_id", "disposition_date"), "outcome_id"), B.WINDOW)


@query
def orphaned_sentences(spark, sf_dir):
    rows = B.charges(spark, sf_dir)
    own = facts.outcome_facts(rows, window=B.WINDOW, floor=B.FLOOR)
    return facts.orphans(B.sentences(rows), own).agg(F.count("*").alias("n"))


# -- matching -----------------------------------------------------------------------------------


def _matched_parts(spark, sf_dir) -> DataFrame:
    parts = B.table(spark, sf_dir, "part").select(F.col("p_name").alias("offense"), F.concat(F.lit("18 § "), F.col("p_type")).alias("statute"))
    return matching.match_charges(parts, B.roster(spark))


@query
def roster_match_arms(spark, sf_dir):
    rows = _matched_parts(spark, sf_dir)
    return rows.groupBy("charge.method", "charge.warning", F.coalesce("charge.id", F.lit("")).alias("id")).agg(F.count("*").alias("n")).withColumn("warning", F.coalesce("warning", F.lit("")))


@query
def roster_candidates(spark, sf_dir):
    rows = _matched_parts(spark, sf_dir).where(F.col("charge.method") == V.AMBIGUOUS)
    return rows.groupBy("offense", "statute", F.concat_ws(",", "charge.candidates").alias("candidates")).agg(F.count("*").alias("n"))


@query
def name_canonical(spark, sf_dir):
    n = names.canonical_name(F.col("name"))
    return B.judge_values(spark, sf_dir).select("c_custkey", F.concat_ws(" ", n["surname"]).alias("surname"), F.concat_ws(" ", n["given"]).alias("given"), F.concat_ws(" ", n["suffix"]).alias("suffix"))


@query
def name_tolerant_match(spark, sf_dir):
    rows = matching.match_judges(B.judge_values(spark, sf_dir), B.judge_roster(spark, sf_dir))
    return rows.groupBy("judge.method", F.coalesce("judge.id", F.lit("")).alias("id")).agg(F.count("*").alias("n"))


@query
def statute_canonical(spark, sf_dir):
    p = B.table(spark, sf_dir, "part")
    return p.select("p_partkey", text.canonical_statute(F.concat_ws(" § ", "p_brand", "p_type")).alias("statute"), text.canonical_text(F.concat_ws(" -- ", F.upper("p_name"), "p_brand")).alias("name"))


@query
def disposition_map(spark, sf_dir):
    d = matching.disposition(F.col("disposition_raw"))
    rows = B.charges(spark, sf_dir).select("disposition_raw", d.alias("d"))
    return rows.groupBy(F.coalesce("disposition_raw", F.lit("")).alias("raw"), "d.held", F.coalesce("d.category", F.lit("")).alias("category"), "d.mapped", "d.public").agg(F.count("*").alias("n"))


@query
def money_triage(spark, sf_dir):
    p = B.table(spark, sf_dir, "part")
    amount = F.floor("p_retailprice").cast("string")
    note = F.when(F.col("p_size") < 10, "no amount").when(F.col("p_size") < 20, F.concat(F.lit("pay $"), amount, F.lit(".50"))).when(F.col("p_size") < 30, F.concat(F.lit("$"), amount, F.lit(" and again $"), amount, F.lit(".00"))).when(F.col("p_size") < 40, F.concat(F.lit("$1,"), F.lpad(amount, 3, "0"), F.lit(" or $7"))).otherwise("$ unknown")
    m = text.money(note)
    return p.select("p_partkey", m["amount_cents"].alias("amount_cents"), m["unparseable"].alias("unparseable"))


# -- scalars ------------------------------------------------------------------------------------


@query
def duration_days(spark, sf_dir):
    q = F.col("l_quantity").cast("int").cast("string")
    c = F.when(F.col("l_linenumber") == 1, F.concat(q, F.lit(" 1/2 Months"))).when(F.col("l_linenumber") == 2, F.concat(q, F.lit(" Years 3 days"))).when(F.col("l_linenumber") == 3, F.concat(q, F.lit("½ Days"))).when(F.col("l_linenumber") == 4, F.lit("Life")).otherwise(F.concat(q, F.lit(".5 days")))
    rows = B.table(spark, sf_dir, "lineitem").select("l_linenumber", numbers.to_days(c).alias("days"))
    return rows.groupBy("l_linenumber", "days").agg(F.count("*").alias("n"))


@query
def median_days_to_months(spark, sf_dir):
    rows = B.table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(numbers.median_days(F.col("l_quantity").cast("int")).alias("median_days"))
    return rows.withColumn("months", numbers.months_of(F.col("median_days")))


@query
def percentages(spark, sf_dir):
    rows = B.table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "A").alias("k"))
    return rows.select("l_partkey", numbers.percent(F.col("k"), F.col("n")).alias("pct2"), numbers.percent(F.col("k"), F.col("n"), 1).alias("pct1"), numbers.share_1dp(F.col("k"), F.col("n")).alias("share"))


@query
def date_forms(spark, sf_dir):
    day = F.col("o_orderdate").cast("date")
    form = F.when(F.col("o_orderstatus") == "F", F.date_format(day, "M/d/yyyy")).when(F.col("o_orderstatus") == "O", F.date_format(day, "MM/dd/yy")).otherwise(F.date_format(day, "yyyy-MM-dd"))
    return B.table(spark, sf_dir, "orders").select("o_orderkey", numbers.parse_date(form).alias("day"))


@query
def identity_hash(spark, sf_dir):
    c = B.table(spark, sf_dir, "customer")
    return c.select("c_custkey", text.identity_hash(F.concat_ws(" ", "c_name", "c_mktsegment"), "salt", (F.col("c_nationkey") + 1950)).alias("with_year"), text.identity_hash(F.col("c_mktsegment"), "salt").alias("name_only"))


@query
def statute_tokens(spark, sf_dir):
    words = B.table(spark, sf_dir, "documents").select(F.explode(F.split("text", " ")).alias("w"))
    return words.groupBy(text.is_statute_token(F.col("w")).alias("is_statute")).agg(F.count("*").alias("n"), F.count_distinct("w").alias("words"))


@query
def judge_slot_guards(spark, sf_dir):
    d = B.table(spark, sf_dir, "documents")
    return d.groupBy(text.is_junk_judge(F.col("text")).alias("junk"), text.is_amended_charge(F.col("text")).alias("amended")).agg(F.count("*").alias("n"))


# -- links --------------------------------------------------------------------------------------


@query
def supersession_stage_counts(spark, sf_dir):
    rows = linkage.classify_claims(B.charges(spark, sf_dir, origins=True))
    return rows.groupBy("stage").agg(F.count("*").alias("n"))


@query
def supersession_latest_wins(spark, sf_dir):
    return linkage.supersessions(B.charges(spark, sf_dir, origins=True))


@query
def link_resolution(spark, sf_dir):
    d = B.dockets(spark, sf_dir)
    nearest = Window.partitionBy("o_custkey").orderBy("docket_id")
    around = F.concat_ws(" and ", F.lag("docket_number").over(nearest), F.lead("docket_number").over(nearest))
    captured = F.when(F.col("grade") == "1-URGENT", "see file").when(F.col("grade") == "2-HIGH", F.concat(F.lit("to "), F.replace("docket_number", F.lit("MC-51"), F.lit("CP-51")))).when(F.col("grade").isNotNull(), around)
    rows = linkage.resolve_links(d.withColumn("cross_court_dockets", captured))
    return rows.groupBy("outcome").agg(F.count("*").alias("n"), F.count_distinct("target").alias("targets"), F.sum("target_id").alias("id_sum"))


@query
def attribution_rule(spark, sf_dir):
    rows = B.charges(spark, sf_dir)
    own = F.when(F.col("tax") == 0, None).when(F.col("tax") == 1, F.struct(F.lit(None).cast("bigint").alias("id"), F.lit(V.AMBIGUOUS).alias("method"))).when((F.col("tax") == 2) & (F.col("sequence") == 1), F.struct(F.col("quantity").cast("bigint").alias("id"), F.lit(V.EXACT).alias("method")))
    assigned = F.when(F.col("grade").isNotNull(), F.struct((F.col("docket_id") % 97).alias("id"), F.lit(V.EXACT).alias("method")))
    rows = linkage.attribute_judges(rows.withColumns({"disposition_judge": own, "assigned_judge": assigned, "nulled": F.col("discount") == 0}).drop("attribution", "judge_id"))
    return rows.groupBy("attribution", F.coalesce("judge_id", F.lit(-1)).alias("judge_id")).agg(F.count("*").alias("n"))


# -- review queue -------------------------------------------------------------------------------


def _queue_items(spark, sf_dir) -> DataFrame:
    own = B.outcomes(spark, sf_dir)
    return own.where("charge_id is null or outcome_category_code = 'unknown'").select(text.dedup_key(F.col("outcome_category_code"), F.col("docket_id").cast("string")).alias("dedup_key"), F.when(F.col("charge_id").isNull(), 1).otherwise(2).alias("producer"), "outcome_id", "charge_method")


@query
def review_dedup(spark, sf_dir):
    rows = review.first_of_each(_queue_items(spark, sf_dir), F.col("outcome_id"))
    return rows.select("outcome_id", "producer", "charge_method")


def _queue(spark, sf_dir) -> DataFrame:
    """A queue from an earlier build: items of dockets of the first priorities, some closed."""
    rows = review.first_of_each(_queue_items(spark, sf_dir), F.col("outcome_id"))
    return rows.select("dedup_key", F.when(F.col("charge_method") == V.AMBIGUOUS, "resolved").otherwise("open").alias("status"))


@query
def stale_items_anti(spark, sf_dir):
    now = _queue_items(spark, sf_dir).where("producer = 2")
    return review.stale(_queue(spark, sf_dir), now).agg(F.count("*").alias("n"))


@query
def held_items_semi(spark, sf_dir):
    held = _queue_items(spark, sf_dir).where(F.col("charge_method") == V.UNMATCHED)
    return review.held(_queue(spark, sf_dir), held).agg(F.count("*").alias("n"))


@query
def insert_absent_items(spark, sf_dir):
    rows = review.first_of_each(_queue_items(spark, sf_dir), F.col("outcome_id"))
    old = rows.where(F.col("charge_method") == V.AMBIGUOUS)
    return review.insert_absent(old, rows).groupBy("producer", "status").agg(F.count("*").alias("n"))


# -- served queries -----------------------------------------------------------------------------


def _identities(spark, sf_dir) -> DataFrame:
    """Charge identities of the driver's parts as a roster: brands with their part names as aliases."""
    p = B.table(spark, sf_dir, "part")
    return p.groupBy(F.col("p_brand").alias("id")).agg(F.sort_array(F.collect_set("p_name")).alias("aliases"), F.min("p_type").alias("statute")).select("id", F.lower("id").alias("slug"), F.col("id").alias("display_name"), "aliases", "statute")


@query
def search_ranked(spark, sf_dir):
    return serve.search(_identities(spark, sf_dir), " Red ", 25).drop("slug")


@query
def search_like_escape(spark, sf_dir):
    n = B.table(spark, sf_dir, "nation")
    hits = [n.where(F.col("n_name").ilike(f"%{text.like_literal(q)}%")).agg(F.count("*").alias("n")).withColumn("q", F.lit(q)) for q in ("n_1", "_", "%", "nation")]
    return hits[0].union(hits[1]).union(hits[2]).union(hits[3])


@query
def directory(spark, sf_dir):
    own, parts = B.facts(spark, sf_dir)
    return serve.directory(_identities(spark, sf_dir), _outcome_distribution(own, B.CHARGE), _component_distribution(parts, B.CHARGE))


@query
def coverage_counts(spark, sf_dir):
    own, parts = B.facts(spark, sf_dir)
    return serve.coverage(_outcome_distribution(own, B.CHARGE), _component_distribution(parts, B.CHARGE), _outcome_distribution(own, B.PAIR))


@query
def result_success_arm(spark, sf_dir):
    own = B.outcomes(spark, sf_dir)
    p = B.table(spark, sf_dir, "part").select(F.explode(F.array("p_brand", "p_type")).alias("charge_id")).distinct()
    volume = B.charges(spark, sf_dir).select(F.col("statute").substr(6, 99).alias("charge_id")).where("charge_id <> 'PROMO'")
    return serve.charge_state(p, _outcome_distribution(own, B.CHARGE), volume)


@query
def result_distribution_block(spark, sf_dir):
    rows = _outcome_distribution(B.outcomes(spark, sf_dir), B.CHARGE)
    return serve.in_order(rows, V.OUTCOME_CATEGORIES).select("charge_id", "sort_order", "category_code", "count", "percentage")


@query
def result_index_block(spark, sf_dir):
    rows = A.index_categories(*B.facts(spark, sf_dir), B.CHARGE, eligible="public_eligible")
    return serve.index_block(rows).select("charge_id", "category_code", "median_min_months", "median_max_months")


@query
def result_quadrants(spark, sf_dir):
    own = B.outcomes(spark, sf_dir)
    pairs = B.charges(spark, sf_dir).select(F.coalesce("normalized_charge_id", "statute").alias("charge_id"), F.coalesce("judge_id", F.lit(-1)).alias("judge_id")).distinct()
    rows = serve.pair_state(pairs, _outcome_distribution(own, B.CHARGE), _outcome_distribution(own, B.PAIR))
    return rows.groupBy("state").agg(F.count("*").alias("n"))


# -- operations panel and checks ----------------------------------------------------------------


@query
def ops_corpus(spark, sf_dir):
    return panel.corpus(B.dockets(spark, sf_dir))


@query
def ops_source_days(spark, sf_dir):
    return panel.source_days(B.table(spark, sf_dir, "events"), "ts", "user_id")


@query
def ops_linkage(spark, sf_dir):
    return panel.linkage(B.charges(spark, sf_dir, origins=True))


@query
def ops_outcome_share(spark, sf_dir):
    return panel.outcome_shares(_outcome_distribution(B.outcomes(spark, sf_dir), B.CHARGE))


@query
def ops_topk(spark, sf_dir):
    return panel.top_judges(_outcome_distribution(B.outcomes(spark, sf_dir), B.PAIR))


def _all_checks(spark, sf_dir) -> DataFrame:
    own, parts = B.facts(spark, sf_dir)
    charge, pair = _outcome_distribution(own, B.CHARGE), _outcome_distribution(own, B.PAIR)
    summary = A.index_summary(own, parts, B.CHARGE, eligible="public_eligible")
    categories = A.index_categories(own, parts, B.CHARGE, eligible="public_eligible")
    return checks.union(
        [
            checks.distribution_integrity(charge, "charge_outcomes", B.CHARGE, floor=B.FLOOR),
            checks.distribution_integrity(pair, "pair_outcomes", B.PAIR, floor=B.FLOOR),
            checks.baseline(pair, charge, "pair_outcomes"),
            checks.index_identities(summary, categories, B.CHARGE, "index_charge"),
            checks.grade_identity(A.grade_mix(own), summary),
            checks.component_durations(own, parts),
        ]
    )


@query
def ops_checks(spark, sf_dir):
    return _all_checks(spark, sf_dir)


@query
def check_integrity(spark, sf_dir):
    """Faults put into a distribution are all found."""
    rows = _outcome_distribution(B.outcomes(spark, sf_dir), B.CHARGE)
    hurt = rows.withColumns({"percentage": F.when(F.col("category_code") == "dismissed", F.col("percentage") + 0.01).otherwise(F.col("percentage")), "count": F.when((F.col("category_code") == "withdrawn") & (F.col("charge_id") < "Brand#2"), F.col("count") + 1).otherwise(F.col("count")), "date_range_start": F.when(F.col("category_code") == "guilty_plea", F.lit("2009-01-01").cast("date")).otherwise(F.col("date_range_start"))})
    return checks.distribution_integrity(hurt, "hurt", B.CHARGE, floor=B.FLOOR)


@query
def check_baseline(spark, sf_dir):
    """A baseline at a stricter gate lacks charges that rows at the judge's grain have."""
    own = B.outcomes(spark, sf_dir)
    charge = _outcome_distribution(own.where("grade = '1-URGENT' and disposition_date > '1998-06-01'"), B.CHARGE)
    return checks.baseline(_outcome_distribution(own, B.PAIR), charge, "pair_outcomes")


@query
def check_reconciliation(spark, sf_dir):
    own, parts = B.facts(spark, sf_dir)
    summary = A.index_summary(own, parts, B.CHARGE, eligible="judge_specific_eligible")
    return checks.conviction_reconciliation(_outcome_distribution(own, B.CHARGE), summary, B.CHARGE, "charge")


@query
def check_volume_outcomes(spark, sf_dir):
    own = B.outcomes(spark, sf_dir)
    return checks.volume(A.volume_funnel(_corpus(spark, sf_dir)), _outcome_distribution(own, B.CHARGE), own)


# -- reports ------------------------------------------------------------------------------------


@query
def distinct_value_buckets(spark, sf_dir):
    rows = B.charges(spark, sf_dir).select("statute", "offense", "disposition_raw", F.col("docket_id").alias("docket"))
    return reports.coverage_buckets(reports.value_counts(rows, ["statute", "offense", "disposition_raw", "docket"]))


@query
def distinct_value_summary(spark, sf_dir):
    return reports.value_summary(reports.value_counts(B.charges(spark, sf_dir), ["offense", "disposition_raw", "grade"]))


@query
def coverage_report_match(spark, sf_dir):
    rows = _matched_parts(spark, sf_dir).groupBy("statute", "offense", F.col("charge.method").alias("method")).agg(F.count("*").alias("n"))
    return reports.method_coverage(rows)


@query
def dominant_pairing(spark, sf_dir):
    return reports.dominant_pairing(B.charges(spark, sf_dir).groupBy("statute", "offense").agg(F.count("*").alias("n")))


@query
def disposition_coverage(spark, sf_dir):
    return reports.disposition_coverage(B.charges(spark, sf_dir).groupBy(F.col("disposition_raw").alias("raw")).agg(F.count("*").alias("n")))


@query
def sentencing_recon(spark, sf_dir):
    return reports.sentencing_recon(B.sentences(B.charges(spark, sf_dir)))


@query
def token_partition(spark, sf_dir):
    rows = B.charges(spark, sf_dir).select(F.col("offense").alias("token"), F.when(F.startswith("offense", F.lit("red")), False).when(F.startswith("offense", F.lit("hot")), True).otherwise(F.col("disposition_raw").isNull()).alias("not_final_only"))
    return reports.token_partition(rows)


@query
def collection_report(spark, sf_dir):
    rows = B.attempts(spark, sf_dir).withColumn("court", F.when(F.col("run") < 75, "CP").otherwise("MC"))
    return reports.outcome_pivot(rows, ["hit", "miss", "blocked", "error", "already_present"])


@query
def status_summary(spark, sf_dir):
    counts = B.attempts(spark, sf_dir).groupBy(F.col("outcome").alias("status")).agg(F.count("*").alias("n"))
    return reports.with_zeros(counts, "status", ["hit", "miss", "changed", "blocked", "error"])


# -- collection ---------------------------------------------------------------------------------


@query
def streak_guard(spark, sf_dir):
    rows = collector.streaks(B.attempts(spark, sf_dir), ["run"], "ts", "event_id")
    return rows.select("event_id", "block_streak", "error_streak")


@query
def streak_stop(spark, sf_dir):
    rows = collector.streaks(B.attempts(spark, sf_dir), ["run"], "ts", "event_id", keep_slice=True)
    kept = collector.until_first_trip(rows, ["run"], "ts", "event_id", stop=3)
    return kept.groupBy("run").agg(F.count("*").alias("attempts"), F.coalesce(F.max("stop_reason"), F.lit("")).alias("stop_reason"))


@query
def batch_numbering(spark, sf_dir):
    rows = collector.batches(B.attempts(spark, sf_dir), ["run"], "ts", "event_id", size=10)
    return rows.groupBy("run", "batch").agg(F.count("*").alias("n"))


@query
def window_completion(spark, sf_dir):
    return collector.completed_windows(B.ledger(spark, sf_dir))


@query
def open_windows(spark, sf_dir):
    days = collector.daily_windows(spark, "2023-12-28", "2024-02-02")
    done = B.ledger(spark, sf_dir).where("day < date'2024-01-20'")
    return collector.open_windows(days, done, ["CP", "MC"])


@query
def docket_range(spark, sf_dir):
    """Numbers between the first and the last docket of each court and year, and how many no docket has."""
    d = B.dockets(spark, sf_dir).select("court", F.substring_index("docket_number", "-", -1).cast("int").alias("year"), "docket_id", "docket_number")
    ranges = d.groupBy("court", "year").agg(F.min("docket_id").cast("int").alias("first"), F.max("docket_id").cast("int").alias("last"))
    numbers_ = collector.docket_ranges(ranges).join(d.select("docket_number", F.lit(True).alias("known")).distinct(), "docket_number", "left")
    return numbers_.groupBy("court", "year").agg(F.count("*").alias("numbers"), F.count_if(F.col("known").isNull()).alias("missing"))


@query
def fetch_classes(spark, sf_dir):
    e = B.table(spark, sf_dir, "events")
    kind, v = F.col("event_type"), F.col("value")
    fetch = collector.fetch_outcome(error=kind == "error", bot_check=v > 100, rate_limited=v < 1, unauthorized=F.lit(False), pdf_ok=kind == "purchase", no_results=kind == "view")
    search = collector.search_outcome(error=kind == "error", bot_check=v > 100, rate_limited=F.lit(False), unauthorized=v < 1, ui_present=kind != "click", banner=v > 50, table=kind != "view", row_count=F.floor(v % 3))
    return e.groupBy(fetch.alias("fetch"), search.alias("search")).agg(F.count("*").alias("n"))


@query
def refresh_targets(spark, sf_dir):
    rows = collector.refresh_targets(B.dockets(spark, sf_dir), B.charges(spark, sf_dir), "MC-")
    return rows


def _versions(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Incoming and loaded envelopes, from orders and their priorities."""
    o = B.dockets(spark, sf_dir)
    v = lambda record: F.struct(F.lit(1).alias("envelope"), record.alias("record"))
    court = F.when(F.col("grade").isNotNull(), F.col("court"))
    record = F.when(F.col("grade") == "1-URGENT", 1).when(F.col("grade") == "2-HIGH", 9).otherwise(2)
    incoming = o.select(F.when(F.col("filed_date") >= F.lit("2000-01-01").cast("date"), F.concat(F.lit("new"), F.col("docket_id").cast("string"))).otherwise(F.col("docket_id").cast("string")).alias("file_hash"), "docket_number", court.alias("court"), v(record).alias("version"), F.when(F.col("filed_date").isNull(), "failed").otherwise("parsed").alias("status"), F.when(F.col("court") == "CP", "same").otherwise("new").alias("content_hash"), (F.coalesce("grade", F.lit("")) != "5-LOW").alias("imported"))
    loaded = o.where("filed_date < date'2001-01-01'").select(F.col("docket_id").cast("string").alias("file_hash"), "docket_number", court.alias("court"), v(F.when(F.col("court") == "CP", 2).otherwise(1)).alias("version"), F.lit("same").alias("content_hash"), F.when(F.col("filed_date") < F.lit("1995-06-01").cast("date"), "parse_superseded").otherwise("parsed").alias("raw_status"))
    return incoming, loaded


@query
def version_decision(spark, sf_dir):
    incoming, loaded = _versions(spark, sf_dir)
    rows = collector.version_decision(incoming, loaded, [(1, 1), (1, 2)])
    return rows.groupBy("decision").agg(F.count("*").alias("n"))


@query
def change_detection(spark, sf_dir):
    p = B.table(spark, sf_dir, "pages")
    known = p.where("length(html) > 2500").select("page_id", F.sha2(F.col("html"), 256).alias("hash"))
    now = p.select("page_id", F.sha2(F.when(F.contains("url", F.lit("/en/")), F.concat("html", F.lit("!"))).otherwise(F.col("html")), 256).alias("hash"))
    return collector.changes(known, now, "page_id")


@query
def harvest_rows(spark, sf_dir):
    rows = collector.harvest(B.table(spark, sf_dir, "pages"))
    return rows.groupBy("page_id").agg(F.count("*").alias("links"), F.count_distinct("href").alias("hrefs"), F.sum(F.length("href")).alias("href_signs"))


# -- texts --------------------------------------------------------------------------------------


@query
def privacy_value_scan(spark, sf_dir):
    rows = linkage.classify_claims(B.charges(spark, sf_dir, origins=True))
    public = B.dockets(spark, sf_dir).select("court", "grade", F.struct("docket_number", "otn").alias("inner"), "otn")
    return privacy.all_value_violations({"dockets": public, "claims": rows})


@query
def privacy_leaks(spark, sf_dir):
    sentinels = F.array(F.lit("The"), F.lit("license"), F.lit("of"), F.lit("que."))
    d = B.table(spark, sf_dir, "documents")
    return d.groupBy(privacy.leaks(F.array("text", "source"), sentinels).alias("leaks")).agg(F.count("*").alias("n"))


@query
def copy_safety_scan(spark, sf_dir):
    c = B.table(spark, sf_dir, "customer")
    copy = F.concat_ws(" ", "c_mktsegment", F.when(F.col("c_acctbal") > 5000, "is not a prediction of the odds").when(F.col("c_acctbal") > 2000, "does not predict; Predicts a WIN RATE, guaranteed").otherwise("oddsmaker, more  lenient"))
    rows = privacy.copy_violations(c.select("c_custkey", copy.alias("text")))
    return rows.select("c_custkey", "term", "place", "found")


@query
def docket_number_extract(spark, sf_dir):
    d = B.dockets(spark, sf_dir)
    note = F.concat_ws(" ", F.lit("see"), "docket_number", "docket_number", F.replace("docket_number", F.lit("51"), F.lit("52")), F.lower("docket_number"))
    found = text.docket_numbers(note)
    origin = text.provenance(F.col("docket_number"))
    return d.select("docket_id", F.size(found).alias("n"), F.concat_ws(",", found).alias("numbers"), origin["court"].alias("court"), origin["county"].alias("county"), text.court_name(F.col("docket_number")).alias("court_name"))


@query
def section_fill_down(spark, sf_dir):
    """Lines of every document under the line that opened their section (one that ends in a full stop)."""
    lines = B.table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("at", "line"))
    filled = lines.withColumn("section", sheets.filled_down(F.when(F.endswith("line", F.lit(".")), F.col("at")), ["doc_id"], "at"))
    return filled.groupBy("doc_id", F.coalesce("section", F.lit(-1)).alias("section")).agg(F.count("*").alias("lines"))


@query
def text_quality_status(spark, sf_dir):
    pages = F.split("text", "\n", -1)
    return B.table(spark, sf_dir, "documents").select("doc_id", text.text_status(pages, 100).alias("status"), text.text_hash(pages).alias("hash"))


@query
def deep_diff_paths(spark, sf_dir):
    o = B.table(spark, sf_dir, "orders")
    left = o.select("o_orderkey", F.struct("o_orderstatus", F.array("o_orderpriority", "o_orderstatus").alias("tags")).alias("case"), "o_custkey")
    changed = F.when(F.col("o_orderstatus") == "F", F.array("o_orderpriority")).otherwise(F.array(F.lit("x"), F.col("o_orderstatus")))
    right = o.where("o_totalprice > 20000").select("o_orderkey", F.struct("o_orderstatus", changed.alias("tags")).alias("case"), (F.col("o_custkey") + (F.col("o_orderstatus") == "P").cast("bigint")).alias("o_custkey"))
    return compare.deep_diff(left, right, "o_orderkey").groupBy("path", "kind").agg(F.count("*").alias("n"))


@query
def line_seams(spark, sf_dir):
    d = B.table(spark, sf_dir, "documents")
    left = d.select("doc_id", F.array("text").alias("pages"))
    right = d.select("doc_id", F.array(F.replace("text", F.lit(" the "), F.lit(" THE "))).alias("pages"))
    return compare.line_seams(left, right, "doc_id").groupBy("doc_id").agg(F.count("*").alias("lines"))


@query
def parsed_sheets(spark, sf_dir):
    """Sheets printed from orders and parsed again."""
    parsed = sheets.parse_sheets(printed_sheets(spark, sf_dir), "salt", wanted=["charges"], dealt=True)["charges"]
    return parsed.select(F.col("doc").alias("docket_number"), "sequence", "statute", "offense", "disposition_raw", "disposition_date", "disposition_judge")


#: Charges that a task prints and parses, so that a task sorts as much whatever the size of the corpus.
SHEET_CHARGES = 1 << 17


def sheet_parts(spark, sf_dir) -> int:
    """Parts that sheets are dealt to: by charges, and no fewer than any shuffle has."""
    rows = B.built(spark, sf_dir, "charges")["charges"].rows("charges")
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // SHEET_CHARGES))


def printed_sheets(spark, sf_dir) -> DataFrame:
    """A docket sheet for every order, its charges being the priced lines of distinct sequence, the least of each.

    Charges are dealt by docket number once, before they grow into texts; sheets lie as they do.
    """
    parts = sheet_parts(spark, sf_dir)
    rows = B.charges(spark, sf_dir).select("docket_number", "docket_id", "filed_date", "sequence", "charge_id", "offense", "statute", "disposition_raw", "disposition_date").repartition(parts, "docket_number")
    charge = F.concat_ws(" ", F.col("sequence").cast("string"), F.col("sequence").cast("string"), F.lit("F1"), F.replace("statute", F.lit("18 § "), F.lit("18 § 1")), F.initcap("offense"), F.lit("01/02/2020 T123"))
    raw = F.nullif("disposition_raw", F.lit(""))
    named = raw.isNotNull() & F.col("disposition_date").isNotNull()
    final = F.concat_ws("\n", F.concat_ws(" ", F.lit("Trial"), F.date_format("disposition_date", "MM/dd/yyyy"), F.lit("Final Disposition")), F.concat(F.col("sequence").cast("string"), F.lit(" / "), F.initcap("offense"), F.lit(" "), raw, F.lit(" F1 "), F.replace("statute", F.lit("18 § "), F.lit("18 § 1"))), F.concat_ws(" ", F.lit("Doe, Jane"), F.date_format(F.date_add("disposition_date", 3), "MM/dd/yyyy")))
    line = F.struct("sequence", "charge_id", "offense", "statute", F.coalesce("disposition_raw", F.lit("")).alias("raw"), F.coalesce(F.col("disposition_date").cast("string"), F.lit("")).alias("day"), charge.alias("charge"), F.when(named, final).otherwise("").alias("event"))
    # made before they are sorted: what a collecting aggregate is given as an expression, it interprets for every row
    rows = rows.select("docket_number", "docket_id", "filed_date", line.alias("line")).sortWithinPartitions("docket_id", "docket_number", "filed_date")
    docs = rows.groupBy("docket_id", "docket_number", "filed_date").agg(F.sort_array(F.collect_list("line")).alias("lines"))
    first = lambda x, i: (i == 0) | ~F.get("lines", i - 1)["sequence"].eqNullSafe(x["sequence"])
    docs = docs.withColumn("lines", F.filter("lines", first))
    head = F.concat(F.lit("COURT OF COMMON PLEAS OF PHILADELPHIA COUNTY\nCASE INFORMATION\nJudge Assigned: Roe, Rick Date Filed: "), F.coalesce(F.date_format("filed_date", "MM/dd/yyyy"), F.lit("")), F.lit("\nDEFENDANT INFORMATION\nDate Of Birth: 01/02/1980\nDefendant Smith, Sam\nCHARGES\nSeq. Orig Seq. Grade Statute\n"))
    page = F.concat(head, F.array_join("lines.charge", "\n"), F.lit("\nPage 1 of 2"))
    return docs.select("docket_number", F.array(page, F.concat(F.lit("DISPOSITION SENTENCING/PENALTIES\n"), F.array_join("lines.event", "\n"))).alias("pages"))
