"""Operators on small tables: every arm, nulls and ties."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from verdigris import vocab as V
from verdigris.operators import aggregates, checks, collector, compare, eligibility, facts, linkage, matching, privacy, reports, review
from verdigris.plans import bindings

D = date


def test_charge_match_arms(spark):
    roster = bindings.roster(spark)
    cases = [
        ("Small Ring", "18 § ECONOMY", "c1", "exact", None),
        ("small  RING", None, "c1", "exact", None),
        ("tiny ring", "9 § 9", "c1", "alias", None),
        ("small ring", "18 § SMALL", None, "ambiguous", "NORM_STATUTE_TEXT_CONFLICT"),
        ("old bolt", "18 § SMALL", None, "ambiguous", "NORM_AMBIGUOUS"),
        ("nothing", "18 § PROMO", "c4", "statute", None),
        ("nothing", "18 § LARGE", None, "ambiguous", "NORM_AMBIGUOUS"),
        ("nothing", "none", None, "unmatched", "NORM_UNMATCHED"),
        ("anvil", "18 § LARGE", "c5", "alias", None),
        (" ", None, None, "unmatched", "NORM_EMPTY_INPUT"),
        (None, None, None, "unmatched", "NORM_EMPTY_INPUT"),
    ]
    df = spark.createDataFrame([(i, a, b) for i, (a, b, *_) in enumerate(cases)], "i int, offense string, statute string")
    got = {r.i: (r.charge.id, r.charge.method, r.charge.warning) for r in matching.match_charges(df, roster).collect()}
    assert [got[i] for i in range(len(cases))] == [c[2:] for c in cases]


def test_judge_match(spark):
    roster = spark.createDataFrame([("1", "Mary Ann Smith", ["Smith, Polly"]), ("2", "John Q. Doe Jr.", []), ("3", "John R. Doe", []), ("4", "Ann O'Keefe", [])], "id string, display_name string, aliases array<string>")
    cases = [("Smith, Mary Ann", "1", "exact"), ("Smith, Mary", "1", "exact"), ("Smith, Mary A.", "1", "exact"), ("Smith, Mary B.", None, "unmatched"), ("Smith, Polly", "1", "alias"), ("Doe, John", None, "ambiguous"), ("Doe, John Q.", "2", "exact"), ("Doe, John Q., Sr.", None, "unmatched"), ("The Honorable OKeefe, Ann", "4", "exact"), ("Smith", None, "unmatched")]
    df = spark.createDataFrame([(c[0],) for c in cases] + [(None,), (" ",)], "name string")
    got = {r.name: r.judge and (r.judge.id, r.judge.method) for r in matching.match_judges(df, roster).collect()}
    assert got == {c[0]: c[1:] for c in cases} | {None: None, " ": None}


def test_dispositions_and_components(spark):
    df = spark.createDataFrame([("Guilty",), ("Held for Court",), (None,), ("guilty",), ("Mistrial",)], "c string").select("c", matching.disposition(F.col("c")).alias("d"))
    assert {r.c: tuple(r.d) for r in df.collect()} == {"Guilty": (False, "guilty_verdict", True, True), "Held for Court": (True, None, False, False), None: (False, None, False, False), "guilty": (False, "unknown", False, False), "Mistrial": (False, "other", True, True)}
    rows = [("Probation", "Probation, 3 Months"), ("Fines and Costs", "pay $5 or $6"), ("Fines and Costs", "$7"), ("Probation", "with Restitution $9"), ("Probation", "40 hours"), ("Probation", "40 hours Community Service"), ("Parole", None)]
    df = spark.createDataFrame(rows, "t string, r string").select(matching.component(F.col("t"), F.col("r")).alias("c"))
    got = [(list(r.c.categories), r.c.amount_cents, r.c.money_unparseable, r.c.method) for r in df.collect()]
    assert got == [(["probation"], None, False, "exact"), (["costs_fees"], None, True, "exact"), (["costs_fees"], 700, False, "exact"), (["probation", "restitution"], 900, False, "exact"), (["probation"], None, False, "ambiguous"), (["probation", "community_service"], None, False, "exact"), (["unknown"], None, False, "unmatched")]


def gated(spark, **over):
    base = {"disposition_date": D(2025, 2, 1), "filed_date": D(2025, 1, 1), "charge_method": "exact", "charge_warning": None, "mapped": True, "category_public": True, "warning_codes": [], "attribution": "disposition_judge"} | over
    df = spark.createDataFrame([tuple(base.values())], "disposition_date date, filed_date date, charge_method string, charge_warning string, mapped boolean, category_public boolean, warning_codes array<string>, attribution string")
    r = eligibility.gate_outcomes(df).first()
    return (r.mvp_eligible, r.public_eligible, r.judge_specific_eligible), list(r.reasons)


def test_outcome_gate(spark):
    assert gated(spark) == ((True, True, True), [])
    assert gated(spark, attribution="none") == ((True, True, False), ["judge_not_attributed"])
    assert gated(spark, disposition_date=None) == ((False, False, False), ["disposition_date_missing"])
    assert gated(spark, filed_date=D(2024, 12, 31)) == ((True, False, False), ["filed_date_before_floor"])
    assert gated(spark, charge_method="ambiguous", charge_warning=V.NORM_STATUTE_TEXT_CONFLICT)[1] == ["charge_not_normalized", "blocking_warning"]
    assert gated(spark, mapped=False, category_public=False, warning_codes=["LOW_TEXT_EXTRACTION"])[1] == ["disposition_not_mapped", "review_needed"]
    assert gated(spark, category_public=False)[1] == ["outcome_category_not_public"]
    assert gated(spark, warning_codes=["UNPARSEABLE_DURATION"])[1] == []


def outcome_rows(spark, counts, judge=None):
    rows, k = [], 0
    for category, n in counts.items():
        for _ in range(n):
            rows.append((str(k), "c", judge, category, D(2025, 1, 1 + k % 28), True, judge is not None, None if k % 2 else "F1"))
            k += 1
    return spark.createDataFrame(rows, "outcome_id string, charge_id string, judge_id string, outcome_category_code string, disposition_date date, public_eligible boolean, judge_specific_eligible boolean, grade string")


@pytest.mark.parametrize(("n", "thin"), [(9, True), (10, False)])
def test_thin_flag(spark, n, thin):
    r = aggregates.distribution(outcome_rows(spark, {"dismissed": n}), ["charge_id"], category="outcome_category_code", date="disposition_date", eligible="public_eligible").first()
    assert (r["count"], r.percentage, r.sample_size, r.is_thin_data) == (n, 100.0, n, thin)


def test_distribution_shares(spark):
    rows = aggregates.distribution(outcome_rows(spark, {"dismissed": 6, "withdrawn": 3, "guilty_plea": 3}), ["charge_id"], category="outcome_category_code", date="disposition_date", eligible="public_eligible").collect()
    assert {r.category_code: (r.percentage, r.sample_size) for r in rows} == {"dismissed": (50.0, 12), "withdrawn": (25.0, 12), "guilty_plea": (25.0, 12)}
    assert {r.date_range_start for r in rows} == {D(2025, 1, 1)} and {r.date_range_end for r in rows} == {D(2025, 1, 12)}


def test_index(spark):
    own = outcome_rows(spark, {"guilty_plea": 3, "guilty_verdict": 1, "dismissed": 2})
    parts = spark.createDataFrame([("0", "probation", 30, 60, False, True), ("0", "probation", 90, 90, True, True), ("1", "probation", 31, 61, False, True), ("1", "costs_fees", None, None, False, True), ("2", "probation", 999, 999, False, False), ("4", "probation", 5, 5, False, True)], "outcome_id string, sentencing_category_code string, min_days int, max_days int, min_assumed boolean, public_eligible boolean")
    s = aggregates.index_summary(own, parts, ["charge_id"], eligible="public_eligible").first()
    assert (s.convictions, s.sentenced_convictions, s.wedge_count, s.wedge_percentage, s.is_thin_data) == (4, 2, 2, 50.0, True)
    c = {r.category_code: r for r in aggregates.index_categories(own, parts, ["charge_id"], eligible="public_eligible").collect()}
    p = c["probation"]
    assert (p.conviction_count, p.percentage, p.median_min_days, p.median_max_days, p.min_assumed_percentage) == (2, 100.0, 31.0, 61.0, 33.3)
    f = c["costs_fees"]
    assert (f.conviction_count, f.percentage, f.median_min_days, f.median_max_days, f.min_assumed_percentage) == (1, 50.0, None, None, None)
    assert {(r.grade, r["count"]) for r in aggregates.grade_mix(own).collect()} == {("F1", 2), ("ungraded", 2)}


def test_checks_find_faults(spark):
    rows = aggregates.distribution(outcome_rows(spark, {"dismissed": 6, "guilty_plea": 4}), ["charge_id"], category="outcome_category_code", date="disposition_date", eligible="public_eligible")
    assert checks.verdict(checks.distribution_integrity(rows, "t", ["charge_id"]))
    hurt = {"percentage_misaligned": {"percentage": F.col("percentage") + 0.02}, "count_sum_mismatch": {"count": F.col("count") + 1}, "sample_size_missing": {"sample_size": F.lit(0)}, "date_range_missing": {"date_range_end": F.lit(None).cast("date")}, "date_range_start_before_window": {"date_range_start": F.lit("2024-01-01").cast("date")}, "date_range_inverted": {"date_range_end": F.lit("2025-01-01").cast("date"), "date_range_start": F.lit("2025-01-02").cast("date")}}
    for code, change in hurt.items():
        found = {r.code for r in checks.distribution_integrity(rows.withColumns(change), "t", ["charge_id"]).where("violations > 0").collect()}
        assert code in found
    own = outcome_rows(spark, {"guilty_plea": 3})
    parts = spark.createDataFrame([("0", "probation", 30, 20, False, True), ("1", "probation", 3, None, False, True), ("2", "probation", 3, 3, False, True)], "outcome_id string, sentencing_category_code string, min_days int, max_days int, min_assumed boolean, public_eligible boolean")
    assert checks.component_durations(own, parts).first().violations == 2
    assert checks.taxonomy([("a", 1, True), ("a", 1, True), ("bad", 2, True)], ["bad"]) == ["code a is repeated", "order 1 is repeated", "code bad is banned"]


def test_supersession_stages(spark):
    ddl = "charge_id string, court string, docket_number string, otn string, filed_date date, sequence int, orig_seq int, statute string, disposition_raw string, originating_docket_no string"
    mc = [("m1", "MC", "MC-1", "t 1", None, 1, 1, "18 § 1", "Held for Court", None), ("m2", "MC", "MC-1", "t 1", None, 2, 2, "18 § 2", "Guilty", None)]
    cp = [
        ("a", "CP", "CP-1", "T  1", D(2025, 1, 1), 1, 1, "18 §1", None, "mc-1"),
        ("b", "CP", "CP-2", "t 1", D(2025, 2, 1), 1, 1, "18 § 1", None, "MC-1"),
        ("c", "CP", "CP-3", "t 1", None, 1, 1, "18 § 1", None, "MC-1"),
        ("d", "CP", "CP-3", "t 1", None, 2, 2, "18 § 2", None, "MC-1"),
        ("e", "CP", "CP-3", "t 1", None, 3, 9, "18 § 2", None, "MC-1"),
        ("f", "CP", "CP-3", "t 1", None, 4, 1, "18 § 7", None, "MC-1"),
        ("g", "CP", "CP-4", "t 2", None, 1, 1, "18 § 1", None, "MC-1"),
        ("h", "CP", "CP-5", "t 1", None, 1, None, "18 § 1", None, "MC-1"),
    ]
    rows = spark.createDataFrame(mc + cp, ddl)
    assert {r.cp_charge_id: r.stage for r in linkage.classify_claims(rows).collect()} == {"a": "later_claim_won", "b": "superseded", "c": "later_claim_won", "d": "mc_not_currently_held", "e": "no_seq_match", "f": "statute_mismatch", "g": "no_case_match"}
    assert [tuple(r) for r in linkage.supersessions(rows).collect()] == [("m1", "b")]


def test_attribution(spark):
    s = "struct<id:string,method:string>"
    rows = [("1", ("j", "exact"), ("x", "exact"), False, "disposition_judge", "j"), ("1", None, ("x", "exact"), False, "none", None), ("2", None, ("x", "exact"), False, "assigned_judge_rule", "x"), ("2", (None, "ambiguous"), ("x", "exact"), False, "none", None), ("2", None, ("x", "exact"), True, "none", None), ("3", None, (None, "unmatched"), False, "none", None), ("4", None, None, False, "none", None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, docket_id string, disposition_judge {s}, assigned_judge {s}, nulled boolean, want string, who string")
    assert all((r.attribution, r.judge_id) == (r.want, r.who) for r in linkage.attribute_judges(df).collect())


def test_streaks_and_batches(spark):
    kinds = ["blocked", "error", "blocked", "already_present", "error", "error", "hit", "error", "blocked", "blocked"]
    df = spark.createDataFrame([("r", i, k) for i, k in enumerate(kinds)], "run string, at int, outcome string")
    got = collector.streaks(df, ["run"], "at").orderBy("at").collect()
    assert [(r.block_streak, r.error_streak) for r in got] == [(1, 0), (1, 1), (2, 0), (2, 0), (2, 1), (2, 2), (0, 0), (0, 1), (1, 0), (2, 0)]
    kept = collector.until_first_trip(collector.streaks(df, ["run"], "at"), ["run"], "at", stop=2).orderBy("at").collect()
    assert [r.at for r in kept] == [0, 1, 2] and kept[-1].stop_reason == "block_streak"
    assert [r.batch for r in collector.batches(df, ["run"], "at", size=3).orderBy("at").collect()] == [1, 1, 1, 1, 2, 2, 2, 3, 3, 3]


def test_windows(spark):
    led = spark.createDataFrame([(D(2024, 1, 1), "both", "complete", 0), (D(2024, 1, 2), "CP", "empty", None), (D(2024, 1, 2), "MC", "truncated", 0), (D(2024, 1, 3), "MC", "complete", 2), (D(2024, 1, 1), "CP", "blocked", 0)], "day date, court string, outcome string, fetch_failures long")
    assert {(r.day.day, r.court) for r in collector.completed_windows(led).collect()} == {(1, "CP"), (1, "MC"), (2, "CP")}
    days = collector.daily_windows(spark, "2024-01-01", "2024-01-03")
    assert sorted(r.day.day for r in collector.open_windows(days, led, ["CP", "MC"]).collect()) == [2, 3]
    with pytest.raises(ValueError):
        collector.daily_windows(spark, "2024-01-02", "2024-01-01")


def test_deep_diff(spark):
    ddl = "k int, a struct<x:int,y:array<string>>, b string, parsed_at string"
    left = spark.createDataFrame([(1, (1, ["p", "q"]), "same", "t"), (2, (2, []), None, "t")], ddl)
    right = spark.createDataFrame([(1, (3, ["p"]), "same", "u"), (3, (2, []), "z", "t")], ddl)
    got = {(r.k, r.path, r.kind) for r in compare.deep_diff(left, right, "k", without={"parsed_at"}).collect()}
    assert {g for g in got if g[0] == 1} == {(1, "$.a.x", "value"), (1, "$.a.y.length", "length"), (1, "$.a.y[1]", "missing_right")}
    assert (2, "$.b", "missing_right") in got and (3, "$.b", "missing_left") in got


def test_regressions(spark):
    old = spark.createDataFrame([(1, 1, "Guilty"), (1, 2, "Guilty"), (1, 3, None)], "docket_id int, sequence int, disposition_raw string")
    new = spark.createDataFrame([(1, 1, None)], "docket_id int, sequence int, disposition_raw string")
    assert sorted(r.sequence for r in compare.regressions(old, new).collect()) == [1, 2]
    assert [r.sequence for r in compare.undisposed(old, new).collect()] == [1]
    assert compare.shrunk(old, new).first().before == 3


def test_privacy(spark):
    df = spark.createDataFrame([("x CP-51-CR-0000001-2020", ("a", ["MC-51-CR-0000001-2020"])), ("y", None)], "t string, s struct<defendant_name:string,l:array<string>>")
    assert {(r.column, r.violations) for r in privacy.value_violations(df).collect()} == {("t", 1), ("s", 1)}
    assert privacy.forbidden_keys(df.schema, ["defendantname"]) == ["$.s.defendant_name"]
    with pytest.raises(ValueError):
        privacy.forbidden_keys(df.schema, [])


def test_review_queue(spark):
    items = spark.createDataFrame([("k", 2, "b"), ("k", 1, "z"), ("k", 1, "a"), ("m", 1, "c")], "dedup_key string, producer int, raw string")
    firsts = review.first_of_each(items, F.col("raw"))
    assert {(r.dedup_key, r.raw) for r in firsts.collect()} == {("k", "a"), ("m", "c")}
    queue = spark.createDataFrame([("k", "resolved"), ("old", "open"), ("older", "in_review")], "dedup_key string, status string")
    assert [r.dedup_key for r in review.insert_absent(queue, firsts).collect()] == ["m"]
    gone = review.stale(queue, firsts)
    assert [r.dedup_key for r in gone.collect()] == ["old"]
    assert {tuple(r) for r in review.close(queue, queue).collect()} == {("k", "resolved"), ("old", "dismissed"), ("older", "dismissed")}


def test_reports(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",), (" ",), (None,)], "v string")
    counts = reports.value_counts(df, ["v"])
    assert tuple(reports.value_summary(counts).first()) == ("v", 4, 1, 1)
    assert {(r.floor, r.distinct_values, r.rows_covered, r.coverage_pct) for r in reports.coverage_buckets(counts, [1, 2]).collect()} == {(1, 4, 5, 100.0), (2, 1, 2, 40.0)}
    with pytest.raises(ValueError):
        reports.safe_column("v; drop")


def test_empty_tables(spark):
    own = outcome_rows(spark, {"dismissed": 1}).limit(0)
    assert aggregates.distribution(own, ["charge_id"], category="outcome_category_code", date="disposition_date", eligible="public_eligible").count() == 0
    assert aggregates.data_range([own.withColumn("date_range_end", F.col("disposition_date"))]).first().data_range_end == D(2025, 1, 1)
    assert facts.full_tally(own.withColumn("reasons", F.array().cast("array<string>"))).agg(F.sum("n")).first()[0] == 0


def test_corpus_order_goes_on_over_dockets(spark):
    """One order over all dockets, whatever slices they lie in; a part of the corpus, null included, has its own."""
    rows = [(court, d, s, f"{d}-{s}-{i}") for court, d in (("MC", 3), ("CP", 1), (None, 700), ("CP", 20), (None, 2), ("MC", -5)) for s, i in ((2, "a"), (1, "b"), (1, "a"), (None, "c"))]
    df = spark.createDataFrame(rows, "court string, docket_id bigint, sequence int, charge_id string").repartition(3)
    order = lambda r: (r[1], r[2] is not None, r[2] or 0, r[3])
    for scope in ([], ["court"]):
        want = {}
        for part in [None] if not scope else ["MC", "CP", None]:
            want |= {r[3]: n for n, r in enumerate(sorted((r for r in rows if not scope or r[0] == part), key=order), 1)}
        for width in (1, 10, 4096):
            got = {r.charge_id: r.place for r in collector.in_corpus_order(df, scope, width=width).collect()}
            assert got == want
