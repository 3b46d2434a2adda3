"""Column functions, case by case."""

import hashlib
from datetime import date

import pytest
from pyspark.sql import functions as F

from verdigris.functions import names, numbers, text
from verdigris.operators import matching


def values(spark, f, cases):
    rows = spark.createDataFrame(list(enumerate(cases)), "i int, c string").select("i", f(F.col("c")).alias("v")).collect()
    return [r["v"] for r in sorted(rows, key=lambda r: r["i"])]


def test_canonical_forms(spark):
    assert values(spark, text.canonical_text, ["  Theft, By—Taking! ", "", None]) == ["theft by taking", "", None]
    assert values(spark, text.canonical_statute, ["18 § 3921(a)", "75-3802.b", None]) == ["183921A", "75-3802.B", None]
    assert values(spark, text.folded_otn, [" u  123 ", " ", None]) == ["U 123", None, None]
    assert values(spark, text.normal_name, ["O'Neil,  JOHN 3rd"]) == ["o neil john rd"]


def test_identity_hash(spark):
    assert values(spark, lambda c: text.identity_hash(c, "s", F.lit(1980)), ["Doe,  Jane"]) == [hashlib.sha256(b"s|doe jane|1980").hexdigest()]
    assert values(spark, lambda c: text.identity_hash(c, "s"), ["Doe"]) == [hashlib.sha256(b"s|doe").hexdigest()]
    with pytest.raises(ValueError):
        text.identity_hash(F.lit("x"), "  ")


def test_money(spark):
    got = values(spark, text.money, ["none", "$1,234.56", "$500 and $500.00", "$5 or $6", "$ unreadable", None, "$12"])
    assert [tuple(x) for x in got] == [(None, False), (123456, False), (50000, False), (None, True), (None, True), (None, False), (1200, False)]


def test_match_rank_and_like(spark):
    assert values(spark, lambda c: text.match_rank(c, "RED"), ["red", "Red ring", "a red", "blue", None]) == [1, 2, 3, None, None]
    assert text.like_literal("50%_\\") == "50\\%\\_\\\\"


def test_docket_numbers(spark):
    got = values(spark, text.docket_numbers, ["CP-51-CR-0000001-2020, MC-51-CR-0000002-2021 CP-51-CR-0000001-2020 CP-52-CR-0000001-2020", None, "nothing"])
    assert got == [["CP-51-CR-0000001-2020", "MC-51-CR-0000002-2021"], [], []]
    got = values(spark, text.provenance, ["MC-51-CR-0000002-2021", "MC-51-CR-2-2021"])
    assert [tuple(x) for x in got] == [("MC-51-CR-0000002-2021", "MC", "51"), (None, None, None)]
    assert values(spark, text.court_code, ["CP-1", "MC-1", "XX"]) == ["CP", "MC", None]


def test_guards(spark):
    assert values(spark, text.is_junk_judge, ["Doe, Jane", "Probation", "Min of 3", "11 1/2 Months", "$5", "Ard, Sue"]) == [False, True, True, True, True, False]
    assert values(spark, text.is_amended_charge, ["Guilty", "Charge Changed (Lower Court)", "Amended"]) == [False, True, True]
    assert values(spark, text.repaired_disposition, ["Transferred to Another", "Guilty", None]) == ["Transferred to Another Jurisdiction", "Guilty", None]
    assert values(spark, text.is_statute_token, ["§", "12", "a", "iv", "(a)", "", "Theft", "xi"]) == [True, True, True, True, True, True, False, False]


def test_charge_line_token(spark):
    rows = [("Theft By Taking Guilty F1 18 § 3921", "Theft By Taking Etc", "18 § 3921", "F1", "Guilty"), ("Other Guilty", "Theft", None, None, "Other Guilty"), ("Guilty", None, None, None, "Guilty"), ("Theft", "Theft", None, None, "")]
    df = spark.createDataFrame(rows, "t string, o string, s string, g string, want string")
    assert all(r.got == r.want for r in df.select("want", text.charge_line_token(F.col("t"), F.col("o"), F.col("s"), F.col("g")).alias("got")).collect())


def test_tokens_and_copy(spark):
    assert values(spark, lambda c: text.holds_token(c, F.lit("Smith")), ["mr SMITH.", "smithy", "a-smith-b", None]) == [True, False, True, None]
    assert values(spark, lambda c: text.holds_token(c, F.lit("ab")), ["ab"]) == [False]
    got = values(spark, text.forbidden_terms, ["This is not a prediction of odds; odds!", "does not predict, predicted", "oddsmaker", ""])
    assert [[(x.term, x.place, x.found) for x in g] for g in got] == [[("odds", 28, "odds"), ("odds", 34, "odds")], [("predict stem", 18, "predicted")], [], []]


def test_error_and_keys(spark):
    df = spark.createDataFrame([("cannot open /a/b/x.pdf: x broke", "/a/b/x.pdf")], "m string, p string")
    assert df.select(text.sanitized_error(F.col("m"), F.col("p"))).first()[0] == "cannot open <redacted>: <redacted> broke"
    assert df.select(text.sanitized_error(F.repeat(F.lit("y"), 300), F.col("p"))).first()[0] == "y" * 200 + "…"
    key = text.dedup_key(F.col("x"), F.col("y"))
    frame = lambda x: spark.createDataFrame([(x, "b")], "x string, y string").select(key.alias("k"))
    assert frame("a").first().k == "a\x1fb"
    for bad in ("", "a\x1f", None):
        with pytest.raises(Exception, match="separator"):
            frame(bad).collect()



def test_text_status(spark):
    df = spark.createDataFrame([(0, ["x" * 100]), (1, ["x" * 100, " y "]), (2, ["", "z"]), (3, [])], "i int, p array<string>")
    assert [r[0] for r in df.orderBy("i").select(text.text_status(F.col("p"))).collect()] == ["success", "partial", "needs_ocr_or_review", "needs_ocr_or_review"]


def test_names(spark):
    cases = ["Smith-Jones, Mary A.", "The Honorable Judge Mary A. O'Keefe Jr.", "Jr.", "  ", None, "Smith,", "Doe, John, Sr.", "Cher"]
    got = [x and (list(x.surname), list(x.given), list(x.suffix)) for x in values(spark, names.canonical_name, cases)]
    assert got == [(["smithjones"], ["mary", "a"], []), (["okeefe"], ["mary", "a"], ["jr"]), None, None, None, (["smith"], [], []), (["doe"], ["john"], ["sr"]), (["cher"], [], [])]


def test_percent_and_medians(spark):
    df = spark.createDataFrame([(1, 3), (2, 3), (1, 8), (0, 5), (5, 0), (1, 200)], "k int, n int")
    assert [r[0] for r in df.select(numbers.percent(F.col("k"), F.col("n"))).collect()] == [33.33, 66.67, 12.5, 0.0, None, 0.5]
    assert [r[0] for r in df.select(numbers.percent(F.col("k"), F.col("n"), 1)).collect()] == [33.3, 66.7, 12.5, 0.0, None, 0.5]
    assert spark.createDataFrame([(1,), (2,), (5,), (10,)], "x int").select(numbers.median_days(F.col("x"))).first()[0] == 3.5
    assert spark.createDataFrame([(45.0,), (44.5,), (0.0,)], "d double").select(numbers.months_of(F.col("d"))).toPandas().iloc[:, 0].tolist() == [1.5, 1.5, 0.0]


def test_days(spark):
    cases = ["11 1/2 Months", "1 Year 6 Months", "90 Days", "Life", None, "2.5 days", "3.5 days", "½ year", "6½ Months", ""]
    assert values(spark, numbers.to_days, cases) == [345, 540, 90, None, None, 2, 4, 720, 195, None]


def test_bounds(spark):
    cases = ["Confinement, Min of 11.00 Months Max of 23.00 Months", "Probation, 24.00 Months", "Probation, Max of 2 Years", "Confinement, Min of 6 Months", "Confinement, Life"]
    assert [tuple(x) for x in values(spark, numbers.sentence_bounds, cases)] == [(330, 690, False), (720, 720, True), (720, 720, True), (180, 180, False), (None, None, False)]


def test_dates(spark):
    cases = ["01/02/2020", "1/2/69", "1/2/68", "13/40/2020", "2020-01-02", None, " 3/4/05 "]
    assert values(spark, numbers.parse_date, cases) == [date(2020, 1, 2), date(1969, 1, 2), date(2068, 1, 2), None, None, None, date(2005, 3, 4)]


def test_patterns_of_a_sentence_are_tried_once(spark):
    """Columns that name a result again do not read the text again."""
    rows = spark.createDataFrame([("Probation", "Probation, Min of 3 Days")], "t string, x string")
    bounds = numbers.sentence_bounds(F.col("x"))
    plan = lambda df, what: str(df._jdf.queryExecution().optimizedPlan()).count(what)
    assert plan(rows.withColumn("b", bounds).select("b.min_days", "b.max_days", "b.min_assumed"), "regexp_extract_all(") <= 9
    part = rows.withColumn("c", matching.component(F.col("t"), F.col("x"))).select("c.category", "c.method", "c.amount_cents", "c.money_unparseable", F.size("c.categories").alias("n"))
    assert plan(part, "RLIKE") <= 4 and plan(part, "regexp_extract_all(") <= 1
