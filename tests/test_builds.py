"""Builds of facts, both grains at once, medians, gates, review items and imports in chunks."""

import hashlib
import random
import shutil
import statistics
from collections import Counter

import pytest
from pyspark.sql import functions as F

from verdigris.operators import aggregates, checks, collector, eligibility, facts, grains, panel, privacy, review
from verdigris.plans import bindings, commits, corpus
from verdigris.sources import files


def test_a_build_is_made_once_for_a_state_of_its_files(spark, tmp_path):
    folder = str(tmp_path / "t.parquet")
    spark.range(5).write.parquet(folder)
    made = []

    def make(keep):
        made.append(1)
        keep("rows", keep("base", spark.read.parquet(folder)).withColumn("twice", F.col("id") * 2))

    key = lambda **more: corpus.fingerprint(spark, [folder], [aggregates], floor="x", **more)
    first = key()
    a = corpus.build(spark, first, make)
    b = corpus.build(spark, key(), make)
    assert len(made) == 1 and b.rows("rows") == 5 and a.table("rows").agg(F.sum("twice")).first()[0] == b.table("rows").agg(F.sum("twice")).first()[0] == 20
    assert key(window="y") != first and corpus.fingerprint(spark, [folder], [facts], floor="x") != first
    spark.range(5, 7).write.mode("append").parquet(folder)
    assert key() != first
    moved = corpus.build(spark, key(), make)
    assert len(made) == 2 and moved.rows("rows") == 7 and b.rows("rows") == 5
    with pytest.raises(ZeroDivisionError):
        corpus.build(spark, "broken", lambda keep: 1 / 0)
    assert corpus.build(spark, "broken", make).rows("base") == 7


def test_of_two_builders_one_commits(spark, tmp_path):
    folder = str(tmp_path / "t.parquet")
    spark.range(3).write.parquet(folder)
    key = hashlib.sha256(str(tmp_path).encode()).hexdigest()

    def slow(keep):
        keep("rows", spark.read.parquet(folder))
        corpus.build(spark, key, lambda keep: keep("rows", spark.read.parquet(folder).limit(1)))

    assert corpus.build(spark, key, slow).rows("rows") == 1
    log = commits.Commits(spark, str(tmp_path / "c"))
    assert log.put(0, "a") and not log.put(0, "b") and log.latest() == (0, "a")
    with pytest.raises(commits.LostRace):
        log.change(lambda n, _: log.put(n, "faster") and "slower", tries=3)


@pytest.fixture(scope="module")
def small_facts(spark):
    rng, own, parts = random.Random(3), [], []
    for i in range(400):
        public = rng.random() < 0.8
        judge = rng.choice([1, 2, None])
        own.append((f"o{i}", rng.choice("ab") if public else None, rng.choice(["guilty_plea", "guilty_verdict", "dismissed"]), f"2020-01-{i % 28 + 1:02d}", judge, rng.choice(["F1", None]), public, public and judge is not None))
        for k in range(rng.randint(0, 4)):
            days = rng.choice([None, rng.randint(0, 40)])
            shown = public and rng.random() < 0.7
            parts.append((f"s{i}-{k}", f"o{i}", own[-1][1], judge, rng.choice(["probation", "incarceration"]), f"2020-02-{k + 1:02d}", days, days and days * 2, rng.random() < 0.5, shown, shown and judge is not None))
    outcomes = spark.createDataFrame(own, "outcome_id string, charge_id string, outcome_category_code string, d string, judge_id long, grade string, public_eligible boolean, judge_specific_eligible boolean").withColumn("disposition_date", F.col("d").cast("date"))
    components = spark.createDataFrame(parts, "sentence_id string, outcome_id string, charge_id string, judge_id long, sentencing_category_code string, d string, min_days int, max_days int, min_assumed boolean, public_eligible boolean, judge_specific_eligible boolean").withColumn("sentence_date", F.col("d").cast("date"))
    return outcomes.cache(), components.cache()


def test_both_grains_at_once_equal_each_alone(small_facts):
    own, parts = small_facts
    cells = grains.pre_aggregate(own, parts).cache()
    rows = lambda df: sorted(map(str, (r.asDict() for r in df.select(*sorted(df.columns)).collect())))
    for grain, (keys, eligible, _) in grains.GRAINS.items():
        at = lambda df: df.where(F.col("grain") == grain).drop("grain", *([] if "judge_id" in keys else ["judge_id"]))
        assert rows(at(grains.distributions(cells, "outcome"))) == rows(aggregates.distribution(own, keys, category="outcome_category_code", date="disposition_date", eligible=eligible))
        assert rows(at(grains.distributions(cells, "component"))) == rows(aggregates.distribution(parts, keys, category="sentencing_category_code", date="sentence_date", eligible=eligible))
        assert rows(at(grains.summaries(cells))) == rows(aggregates.index_summary(own, parts, keys, eligible=eligible))
        assert rows(at(grains.categories(cells))) == rows(aggregates.index_categories(own, parts, keys, eligible=eligible))
    assert rows(grains.grades(cells)) == rows(aggregates.grade_mix(own))


def test_medians_are_exact_and_need_no_buffers(spark, small_facts):
    rng = random.Random(8)
    data = [(c, v, rng.randint(1, 3)) for c in "abc" for v in rng.sample(range(50), rng.randint(1, 9))] + [("a", None, 5)]
    got = aggregates.histogram_median(spark.createDataFrame(data, "c string, v int, n long"), ["c"], "v", "n")
    assert {r.c: r.v for r in got.collect()} == {c: statistics.median([v for k, v, n in data if k == c and v is not None for _ in range(n)]) for c in "abc"}
    plan = aggregates.index_categories(*small_facts, ["charge_id"], eligible="public_eligible")._jdf.queryExecution().executedPlan().toString()
    assert "ObjectHashAggregate" not in plan and "Expand" not in plan


def test_index_rows_are_held_against_their_facts(small_facts):
    own, parts = small_facts
    index = aggregates.index_categories(own, parts, ["charge_id"], eligible="public_eligible")
    count = lambda i, p: {r.code: r.violations for r in checks.index_against_facts(i, own, p, ["charge_id"], "t", eligible="public_eligible").collect()}
    assert set(count(index, parts).values()) == {0}
    assert count(index.withColumn("median_min_days", F.lit(None).cast("double")), parts)["median_presence_mismatch"] == index.where("median_min_days is not null").count()
    half = parts.withColumn("max_days", F.lit(None).cast("int"))
    fed = own.where("public_eligible and outcome_category_code <> 'dismissed'").join(half.drop("charge_id", "judge_id", "d").where("public_eligible and min_days is not null").select("outcome_id"), "outcome_id")
    assert count(index, half)["component_duration_invalid"] == fed.count()


def test_all_index_checks_read_the_facts_once(spark, small_facts, tmp_path, monkeypatch):
    """Only the counts of the facts are left to read when the checks of both grains run."""
    from verdigris.plans import queries_builds as Q

    own, parts = small_facts
    keep = lambda rows, name: (rows.write.parquet(f"{tmp_path}/{name}"), spark.read.parquet(f"{tmp_path}/{name}"))[1]
    facts_read = keep(own, "outcomes"), keep(parts, "components")
    monkeypatch.setattr(Q.B, "facts", lambda *_: facts_read)
    rows = Q.index_fact_checks(spark, "")
    assert not any("/outcomes/" in f or "/components/" in f for f in rows.inputFiles())
    assert {r.violations for r in rows.where("rows = 'sound'").collect()} == {0}
    half = checks.index_against_facts(aggregates.index_categories(own, parts, ["charge_id"], eligible="public_eligible"), own, parts.withColumn("max_days", F.when(F.col("sentencing_category_code") == "incarceration", F.col("min_days") - 1).otherwise(F.col("max_days"))), ["charge_id"], "t", eligible="public_eligible")
    invalid = {r.table: r.violations for r in rows.where("rows = 'hurt' and code = 'component_duration_invalid'").collect()}
    assert invalid["charge_index"] == half.where("code = 'component_duration_invalid'").first().violations > 0


def test_each_live_check_fails_alone(spark):
    runs = spark.createDataFrame([("a", "2025-01-01", None)], "id string, published_at string, invalidated_at string")
    volume = spark.createDataFrame([("x", 5, 3, 1, 1, 0), ("y", 2, 2, 0, 0, 0)], "charge_id string, charges_seen long, outcomes_recorded long, held_for_court long, still_pending long, disposed_excluded long")
    outcomes = spark.createDataFrame([("x", 1, 3), ("x", 2, 3), ("y", 2, 2)], "charge_id string, count long, sample_size long")
    summary = spark.createDataFrame([("x", 3, 2, 1)], "charge_id string, convictions long, sentenced_convictions long, wedge_count long")
    live, pointers = spark.range(4), spark.createDataFrame([("m", "c")], "mc_charge_id string, superseded_by string")
    failing = lambda *a: [r.name for r in panel.live_checks(*a).where("not passed").collect()]
    assert failing(runs, volume, outcomes, summary, live, 4, pointers) == []
    assert failing(runs.union(runs), volume, outcomes, summary, live, 4, pointers) == ["one_active_published_run"]
    two_faults = volume.withColumn("held_for_court", F.col("held_for_court") + F.when(F.col("charge_id") == "x", 1).otherwise(-1))
    assert failing(runs, two_faults, outcomes, summary, live, 4, pointers) == ["volume_closure"]
    assert failing(runs, volume, outcomes.where("charge_id = 'x'"), summary, live, 4, pointers) == ["volume_matches_percentages"]
    assert failing(runs, volume, outcomes.withColumn("count", F.col("count") + 1), summary, live, 4, pointers) == ["outcome_counts_sum_to_sample"]
    assert failing(runs, volume, outcomes, summary.withColumn("wedge_count", F.lit(0)), live, 4, pointers) == ["wedge_identity"]
    assert failing(runs, volume, outcomes, summary, live, 5, pointers) == ["corpus_unchanged_since_build"]
    assert failing(runs, volume, outcomes, summary, live, None, pointers.withColumn("superseded_by", F.col("mc_charge_id"))) == ["no_self_supersession"]
    names = [r.name for r in panel.live_checks(runs.limit(0), volume, outcomes, summary, live, 4, pointers).collect()]
    assert names == ["one_active_published_run", "corpus_unchanged_since_build", "no_self_supersession"]


def test_unknown_warning_codes_stop_the_gate(spark):
    rows = lambda *codes: spark.createDataFrame([(c,) for c in codes], "codes array<string>").select(eligibility.review_severity(F.col("codes")).alias("r"))
    assert [r.r for r in rows([], None, ["SUSPECT_JUDGE_LINE"], ["MISSING_SENTENCE_DATE"]).collect()] == [False, False, True, False]
    with pytest.raises(Exception, match="unknown warning code"):
        rows(["NEW_CODE"]).collect()


def test_warnings_reach_their_charges(spark):
    charges = spark.createDataFrame([("d", 1, ["OLD"]), ("d", 2, []), ("e", 1, [])], "docket_id string, sequence int, warning_codes array<string>")
    warnings = spark.createDataFrame([("d", 1, "B"), ("d", 1, "A"), ("d", 1, "A"), ("d", None, "C"), ("f", 1, "D")], "docket_id string, charge_sequence int, code string")
    got = {(r.docket_id, r.sequence): r.warning_codes for r in facts.with_warning_codes(charges, warnings).collect()}
    assert got == {("d", 1): ["A", "B"], ("d", 2): [], ("e", 1): []}


def test_review_items_of_a_build(spark):
    own = spark.createDataFrame([("o1", "d1", "unmatched", "exact", []), ("o2", "d1", "ambiguous", "unmatched", ["blocking_warning"]), ("o3", "d1", "ambiguous", "exact", []), ("o4", "d1", "exact", "exact", [])], "outcome_id string, docket_id string, charge_method string, outcome_method string, reasons array<string>")
    parts = spark.createDataFrame([("s1", "d1", "exact", 2, []), ("s2", "d1", "exact", 2, ["money_amount_unparseable"]), ("s3", "d1", "unmatched", 1, ["sentence_duration_unparseable"])], "sentence_id string, docket_id string, component_method string, n_categories int, reasons array<string>")
    warnings = spark.createDataFrame([("d1", 1, "SENTINEL_COLLISION"), ("d1", None, "SENTINEL_COLLISION"), ("d2", 4, "MISSING_DISPOSITION_DATE"), ("d2", 4, "BLANK_DOB_CAPTION")], "docket_id string, charge_sequence int, code string")
    links = spark.createDataFrame([("d1", "malformed"), ("d2", "ambiguous_target"), ("d2", "ambiguous_target"), ("d3", "resolved")], "docket_id string, outcome string")
    rows = review.build_items(own, parts, warnings, links)
    assert Counter((r.item_type, r.severity, r.reason_code) for r in rows.collect()) == {
        ("unmapped_charge", "medium", "charge_not_normalized"): 1, ("ambiguous_charge", "high", "blocking_warning"): 1, ("ambiguous_charge", "medium", "charge_not_normalized"): 1, ("unmapped_disposition", "medium", "disposition_not_mapped"): 1,
        ("additive_sentencing_category", "low", "review_needed"): 1, ("money_unparseable", "low", "money_amount_unparseable"): 1, ("unmapped_sentencing_component", "medium", "sentencing_component_not_normalized"): 1, ("duration_unparseable", "low", "sentence_duration_unparseable"): 1,
        ("sentinel_collision", "medium", "judge_not_normalized"): 2, ("missing_disposition_date", "medium", "disposition_date_missing"): 1, ("unresolvable_cross_court_reference", "medium", "review_needed"): 3,
    }
    keys = {r.dedup_key for r in review.first_of_each(rows).collect()}
    assert {"d1\x1fsentinel_collision", "d1\x1fsentinel_collision\x1f1", "d2\x1funresolvable_cross_court_reference", "d1\x1fambiguous_charge\x1fo2"} <= keys and len(keys) == 13
    queue = review.first_of_each(rows).withColumn("status", F.when(F.col("producer") == 4, "dismissed").otherwise("open"))
    got = {(r.by, r.value): r.n for r in panel.queue_summary(queue).collect()}
    assert got[("status", "dismissed")] == 2 and got[("status", "open")] == 11 and ("item_type", "unresolvable_cross_court_reference") not in got and got[("severity", "high")] == 1


def test_patterns_and_keys_of_privacy_scans(spark):
    assert privacy.portable_pattern("a.b", "si") == "(?is)a.b" and privacy.portable_pattern("x") == "x"
    with pytest.raises(ValueError, match="not portable"):
        privacy.portable_pattern("x", "gu")
    bodies = ['{"a": {"Docket_No": 1, "list": [{"docket-no": "x"}]}}', '{"note": "docketno", "b": "\\"docketno\\": 1"}', None, '{"DOCKETNO" : null}']
    rows = spark.createDataFrame([(b,) for b in bodies], "body string")
    assert {(r.key, r.violations) for r in privacy.json_key_violations(rows, "body", ["docketno"]).collect()} == {("Docket_No", 1), ("docket-no", 1), ("DOCKETNO", 1)}
    with pytest.raises(ValueError):
        privacy.json_key_violations(rows, "body", [])


def test_files_are_hashed_chunk_by_chunk(spark, tmp_path):
    contents = {"a b.pdf": b"%PDF-" + b"x" * 100_000, "copy.pdf": b"%PDF-" + b"x" * 100_000, "short": b"%P", "ünï.pdf": b"%PDF-2"}
    rows = spark.createDataFrame(list(contents.items()), "name string, content binary").repartition(3)
    files.write_files(rows, f"file://{tmp_path}/in")
    assert [len(c) for c in files.read_in_chunks(f"file://{tmp_path}/in/short", 1)] == [1, 1]
    found = {r.path.rsplit("/", 1)[1]: r for r in files.import_documents(spark, f"file://{tmp_path}/in", chunk_bytes=7).collect()}
    assert set(found) == set(contents)
    for name, r in found.items():
        assert r.file_hash == hashlib.sha256(contents[name]).hexdigest() and r.size_bytes == len(contents[name])
    assert Counter(r.status for r in found.values()) == {"imported": 2, "duplicate": 1, "invalid": 1}


def test_readers_of_charges_wait_for_no_facts(spark, tmp_path):
    """Each table is a build of its own: charges make no facts, facts take the charges that there are."""
    for name in ("orders", "lineitem", "part"):
        shutil.copy(f"/root/testdata/sf0.001/{name}.parquet", tmp_path)
    built = lambda last: {k: b.root for k, b in bindings.built(spark, str(tmp_path), last).items()}
    first = built("charges")
    root, key = first["charges"].rsplit("/", 1)
    folders = lambda: {n.rsplit("-", 1)[1] for n in commits.Folder(spark, root).names() if n.startswith(key.rsplit("-", 1)[0])}
    assert folders() == {"charges"}
    every = built("components")
    assert every["charges"] == first["charges"] and folders() == {"charges", "outcomes", "components"}


def test_a_long_range_of_numbers_is_dealt_to_all_tasks(spark):
    ranges = spark.createDataFrame([("CP", 2020, 1, 800_000), ("MC", 2020, 5, 4), ("MC", 2021, 9_999_999, 10_000_004)], "court string, year int, first int, last int")
    rows = collector.docket_ranges(ranges)
    sizes = [r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 800_001 and len(sizes) > 1 and max(sizes) < 600_000
    assert rows.agg(F.count_distinct("docket_number"), F.min("docket_number"), F.max("docket_number")).first()[:] == (800_001, "CP-51-CR-0000001-2020", "MC-51-CR-9999999-2021")


def test_lines_are_recast_before_they_are_dealt_by_docket(spark, tmp_path):
    import os

    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("the driver's tables are not here")
    folder = "/root/testdata/sf0.001"
    rows = bindings.derived_charges(spark, folder, bindings.linked_dockets(spark, folder))
    last = str(rows._jdf.queryExecution().optimizedPlan()).splitlines()[0]
    assert last.startswith("Project") and not any(c in last for c in ("l_extendedprice", "l_tax", "l_quantity", "l_shipdate"))
