"""The driver's tables in the shape of the data model, for the registered queries.

Orders stand for dockets, line items for charges, parts for charge identities, suppliers for judges,
events for collection attempts. Whole tables are bound: values are recast, no row is left out.
"""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import patterns
from .. import vocab as V
from ..functions import numbers, text
from ..functions.numbers import sentence_bounds
from ..operators import eligibility, linkage, matching
from ..operators import facts as fact_operators
from ..operators.facts import component_facts, outcome_facts
from .corpus import Build, build, fingerprint

#: Start of the date window and floor of the filing date, inside the range of the tables.
WINDOW, FLOOR = "1998-01-01", "1996-01-01"
CHARGE, PAIR = ["charge_id"], ["charge_id", "judge_id"]

#: A small roster: id, slug, display name, statute, aliases.
ROSTER = [
    ("c1", "small-ring", "Small Ring", "18 § ECONOMY", ["tiny ring", "red ring"]),
    ("c2", "red-bolt", "Red  Bolt!", "18 § SMALL", ["old bolt", "blue bolt"]),
    ("c3", "hot-gear", "Hot Gear", "18 § MEDIUM", ["old bolt", "cold-gear"]),
    ("c4", "promotion", "Promotion", "18 § PROMO", []),
    ("c5", "large-a", "Large A", "18 § LARGE", ["anvil"]),
    ("c6", "large-b", "Large B", "18 § LARGE", []),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def roster(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ROSTER, "id string, slug string, display_name string, statute string, aliases array<string>")


def dockets(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    court = F.when(F.col("o_orderstatus") == "F", "CP").otherwise("MC")
    day = F.col("o_orderdate").cast("date")
    number = F.concat(court, F.lit("-51-CR-"), F.format_string("%07d", "o_orderkey"), F.lit("-"), F.year(day).cast("string"))
    return o.select(F.col("o_orderkey").alias("docket_id"), "o_custkey", court.alias("court"), number.alias("docket_number"), F.when((F.col("o_orderpriority") != "5-LOW") | (F.col("o_totalprice") > 50000), day).alias("filed_date"), F.concat(F.lit("otn  "), F.col("o_custkey").cast("string")).alias("otn"), F.nullif("o_orderpriority", F.lit("4-NOT SPECIFIED")).alias("grade"))


def linked_dockets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dockets with the MC docket that a CP docket of the same customer continues: the latest before it."""
    before = Window.partitionBy("o_custkey").orderBy("docket_id").rowsBetween(Window.unboundedPreceding, 0)
    origin = F.last(F.when(F.col("court") == "MC", F.col("docket_number")), ignorenulls=True).over(before)
    return dockets(spark, sf_dir).withColumn("originating_docket_no", F.when(F.col("court") == "CP", origin))


def derived_charges(spark: SparkSession, sf_dir: str, cases: DataFrame) -> DataFrame:
    """Charges with their docket, match and attribution."""
    # numbers are recast before lines are dealt by docket, so narrow values travel
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.concat("l_returnflag", "l_linestatus").alias("flag"), F.round(F.col("l_tax") * 100).cast("int").alias("tax"), F.round(F.col("l_discount") * 100).cast("int").alias("discount"),
        F.col("l_quantity").cast("int").alias("quantity"), F.floor("l_extendedprice").cast("long").alias("price"), F.col("l_shipdate").cast("date").alias("ship_date"), F.when(F.col("l_quantity") != 1, F.col("l_shipdate").cast("date")).alias("dated"),
    )
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", "p_brand")
    rows = lines.join(cases, F.col("l_orderkey") == F.col("docket_id")).join(parts, F.col("l_partkey") == F.col("p_partkey"))
    kind, tax, discount, line, flag = F.col("p_type"), F.col("tax"), F.col("discount"), F.col("l_linenumber"), F.col("flag")
    raw = F.when(flag == "AF", "Guilty Plea - Negotiated").when(flag == "AO", "Guilty").when(flag == "RF", "Nolle Prossed").when((flag == "RO") & (line == 4), "Proceed to Court").when(flag == "RO", "Withdrawn").when(flag == "NF", "Held for Court")
    method = F.when(kind == "PROMO", V.UNMATCHED).when(kind == "LARGE", V.AMBIGUOUS).when(kind == "SMALL", V.ALIAS).when(kind == "MEDIUM", V.STATUTE).otherwise(V.EXACT)
    warning = F.when(kind == "PROMO", V.NORM_UNMATCHED).when(kind == "LARGE", V.NORM_STATUTE_TEXT_CONFLICT)
    codes = F.when(discount == 0, F.array(F.lit("SUSPECT_JUDGE_LINE"))).when(discount == 1, F.array(F.lit("MISSING_SENTENCE_DATE"))).otherwise(F.array().cast("array<string>"))
    attribution = F.when(tax == 0, "none").when(tax == 1, "assigned_judge_rule").otherwise("disposition_judge")
    return rows.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("charge_id"), "docket_id", "court", "docket_number", "otn", "filed_date", "grade", "originating_docket_no", line.alias("sequence"), line.alias("orig_seq"), F.col("p_name").alias("offense"), F.concat(F.lit("18 § "), kind).alias("statute"), raw.alias("disposition_raw"),
        F.when(raw.isNotNull(), F.col("dated")).alias("disposition_date"), method.alias("charge_method"), warning.alias("charge_warning"), F.when(method.isin(V.PUBLIC_METHODS), F.col("p_brand")).alias("normalized_charge_id"), codes.alias("warning_codes"), F.when(attribution != "none", F.col("l_suppkey")).alias("judge_id"), attribution.alias("attribution"),
        "ship_date", "quantity", "tax", "discount", "price",
    )


def sentences(all_charges: DataFrame) -> DataFrame:
    """Components of convictions: up to three rows a charge."""
    q, tax, discount = F.col("quantity"), F.col("tax"), F.col("discount")
    days = F.when(tax == 0, F.concat(F.lit("Max of "), q.cast("string"), F.lit(".00 Months"))).otherwise(F.concat(F.lit("Min of "), q.cast("string"), F.lit(".00 Days Max of "), (q * 2).cast("string"), F.lit(".00 Days")))
    term = F.when(discount == 3, "Confinement, Life").when(discount == 4, "Confinement, 1 Year 6 Months")
    fee = F.concat(F.lit("Fines and Costs, $"), F.col("price").cast("string"), F.lit(".00"), F.when(F.col("sequence") == 1, ", $5").otherwise(""))
    part = lambda cond, kind, text: F.when(cond, F.struct(F.lit(kind).alias("sentence_type"), text.alias("raw_text")))
    parts = F.array_compact(F.array(part(discount >= 5, "Probation", F.concat(F.lit("Probation, "), days)), part(discount.isin(3, 4), "Confinement", term), part(tax >= 4, "Fines and Costs", fee)))
    rows = all_charges.where(F.col("disposition_raw").isin("Guilty Plea - Negotiated", "Guilty")).select(F.col("charge_id").alias("outcome_id"), "sequence", "ship_date", "quantity", F.explode(parts).alias("p"))
    bounds = F.when(F.col("p.sentence_type") != "Fines and Costs", sentence_bounds(F.col("p.raw_text")))
    rows = rows.withColumn("b", bounds)  # a step of its own, so that the three columns read one result
    return rows.select(F.concat_ws("/", "outcome_id", "p.sentence_type").alias("sentence_id"), "outcome_id", "p.sentence_type", "p.raw_text", F.when(F.col("quantity") != 2, F.date_add("ship_date", F.col("sequence") - 2)).alias("sentence_date"), F.col("b.min_days").alias("min_days"), F.col("b.max_days").alias("max_days"), F.coalesce("b.min_assumed", F.lit(False)).alias("min_assumed"))


def built(spark: SparkSession, sf_dir: str, last: str = "components") -> dict[str, Build]:
    """The builds of charges, outcome facts and component facts for the files as they are, up to ``last``: each is
    a build of its own, so a reader of charges waits for no facts."""
    inputs = [f"{sf_dir}/{t}.parquet" for t in ("lineitem", "orders", "part")]
    code = [eligibility, fact_operators, matching, linkage, numbers, patterns, text, V, sys.modules[__name__]]
    key = fingerprint(spark, inputs, code, window=WINDOW, floor=FLOOR, taxonomy=V.TAXONOMY_VERSION)
    made: dict[str, Build] = {}
    rows = {
        "charges": lambda: derived_charges(spark, sf_dir, linked_dockets(spark, sf_dir)),
        "outcomes": lambda: outcome_facts(made["charges"].table("charges"), window=WINDOW, floor=FLOOR),
        "components": lambda: component_facts(sentences(made["charges"].table("charges")), made["outcomes"].table("outcomes"), window=WINDOW, floor=FLOOR),
    }
    for name, derive in rows.items():
        made[name] = build(spark, f"{key}-{name}", lambda keep, name=name, derive=derive: keep(name, derive()))
        if name == last:
            break
    return made


def charges(spark: SparkSession, sf_dir: str, *, origins: bool = False) -> DataFrame:
    """The built charges; with ``origins`` also the docket that each continues."""
    rows = built(spark, sf_dir, "charges")["charges"].table("charges")
    return rows if origins else rows.drop("originating_docket_no")


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return built(spark, sf_dir, "outcomes")["outcomes"].table("outcomes")


def facts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Outcome facts and component facts."""
    made = built(spark, sf_dir)
    return made["outcomes"].table("outcomes"), made["components"].table("components")


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collection attempts: a run for each user, in the order of ts and event_id."""
    kind = F.col("event_type")
    outcome = F.when(kind == "error", "error").when(kind == "view", "miss").when(kind == "purchase", "hit").when(kind == "click", "blocked").otherwise("already_present")
    return table(spark, sf_dir, "events").select("event_id", "ts", F.col("user_id").alias("run"), outcome.alias("outcome"))


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A window ledger: a day and a court for each event."""
    kind = F.col("event_type")
    outcome = F.when(kind == "purchase", "complete").when(kind == "view", "empty").when(kind == "click", "truncated").otherwise("blocked")
    court = F.when(F.col("user_id") < 50, "CP").when(F.col("user_id") < 100, "MC").otherwise("both")
    return table(spark, sf_dir, "events").select(F.col("ts").cast("date").alias("day"), court.alias("court"), outcome.alias("outcome"), F.when(F.col("value") > 20, 1).otherwise(0).cast("long").alias("fetch_failures"))


def judge_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw names in comma form for every customer, with titles, suffixes and initials now and then."""
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey"))
    surname = F.replace("n_name", F.lit("_"), F.lit("-"))
    title = F.when(F.col("c_acctbal") > 9000, "The Honorable ").otherwise("")
    middle = F.when(F.col("c_acctbal") < 0, " B.").when(F.col("c_acctbal") > 5000, "").otherwise(" M")
    return c.select("c_custkey", F.concat(title, surname, F.lit(", "), F.col("c_mktsegment"), middle, F.when(F.col("c_acctbal") > 8000, ", Jr.").otherwise("")).alias("name"))


def judge_roster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judges in natural order; nations of two regions have two judges of one name but for the initial."""
    n = table(spark, sf_dir, "nation")
    segment = F.explode(F.array(*[F.lit(s) for s in ("Building", "Machinery", "Furniture")]))
    rows = n.select("n_nationkey", "n_regionkey", F.replace("n_name", F.lit("_"), F.lit("-")).alias("surname"), segment.alias("given"))
    rows = rows.select("*", F.explode(F.when(F.col("n_regionkey") == 0, F.array(F.lit("M."), F.lit("B."))).otherwise(F.array(F.lit("M.")))).alias("middle"))
    return rows.select(F.concat_ws("-", "n_nationkey", "given", F.substring("middle", 1, 1)).alias("id"), F.concat_ws(" ", "given", "middle", "surname").alias("display_name"), F.array(F.concat(F.col("surname"), F.lit(", "), F.col("given"), F.lit(" Alias"))).alias("aliases"))
