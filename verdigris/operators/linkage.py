"""Links between courts: judge attribution, superseded charges, cross-court targets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import vocab as V
from ..functions.text import canonical_statute, docket_numbers, folded_docket_number, folded_otn


def attribute_judges(charges: DataFrame) -> DataFrame:
    """Adds judge_id and attribution: disposition_judge, assigned_judge_rule or none.

    Reads docket_id, disposition_judge and assigned_judge (structs id, method; null if absent) and
    nulled (the sheet had a judge that was taken out). The assigned judge serves a docket of whose
    charges none has a matched judge of its own. One shuffle by docket.
    """
    own = F.col("disposition_judge.id")
    docket = Window.partitionBy("docket_id")
    fallback = (F.count(own).over(docket) == 0) & F.col("assigned_judge.id").isNotNull()
    method = F.when(own.isNotNull(), "disposition_judge").when(F.col("disposition_judge").isNotNull() | F.col("nulled"), "none").when(fallback, "assigned_judge_rule").otherwise("none")
    rows = charges.withColumn("attribution", method)
    judge = F.when(F.col("attribution") == "disposition_judge", own).when(F.col("attribution") == "assigned_judge_rule", F.col("assigned_judge.id"))
    return rows.withColumn("judge_id", judge)


def classify_claims(charges: DataFrame) -> DataFrame:
    """One row for each claim of a CP charge on an MC charge: cp_charge_id, mc_charge_id, stage.

    A claim names docket, OTN, sequence and statute. It fails at the first of these that no MC
    charge meets, or if that charge is not held now; of several claims the latest-filed case wins.
    Stages come from one left join on docket and OTN whose right side is aggregated by claim.
    """
    claim = charges.where("court = 'CP' and originating_docket_no is not null and otn is not null and orig_seq is not null and statute is not null").select(
        F.col("charge_id").alias("cp_charge_id"), F.col("docket_number").alias("cp_docket"), F.col("filed_date").alias("cp_filed"), "orig_seq", canonical_statute(F.col("statute")).alias("cp_code"), folded_docket_number(F.col("originating_docket_no")).alias("to_docket"), folded_otn(F.col("otn")).alias("to_otn")
    )
    held = F.coalesce(F.col("disposition_raw").isin(V.HELD_FORMS), F.lit(False))
    target = charges.where("court = 'MC'").select(folded_docket_number(F.col("docket_number")).alias("to_docket"), folded_otn(F.col("otn")).alias("to_otn"), "sequence", canonical_statute(F.col("statute")).alias("mc_code"), held.alias("mc_held"), F.col("charge_id").alias("mc_id"))
    target = target.where("to_docket is not null and to_otn is not null")
    joined = claim.join(target, ["to_docket", "to_otn"], "left")
    same_seq = F.col("sequence") == F.col("orig_seq")
    same_code = same_seq & (F.col("cp_code") != "") & (F.col("mc_code") == F.col("cp_code"))
    yes = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    found = joined.groupBy("cp_charge_id", "cp_docket", "cp_filed").agg(yes(F.col("mc_id").isNotNull()).alias("case"), yes(same_seq).alias("seq"), F.min(F.when(same_code, F.struct("mc_id", "mc_held"))).alias("mc"))
    failed = F.when(~F.col("case"), "no_case_match").when(~F.col("seq"), "no_seq_match").when(F.col("mc").isNull(), "statute_mismatch").when(~F.col("mc.mc_held"), "mc_not_currently_held")
    rows = found.select("cp_charge_id", "cp_docket", "cp_filed", F.col("mc.mc_id").alias("mc_charge_id"), failed.alias("failed"))
    # failed claims compete among themselves only, spread by their own id
    order = Window.partitionBy(F.coalesce("failed", F.lit("")), F.when(F.col("failed").isNull(), F.col("mc_charge_id")).otherwise(F.col("cp_charge_id"))).orderBy(F.desc_nulls_last("cp_filed"), F.desc("cp_docket"), F.asc("cp_charge_id"))
    stage = F.coalesce("failed", F.when(F.row_number().over(order) == 1, "superseded").otherwise("later_claim_won"))
    return rows.select("cp_charge_id", "mc_charge_id", stage.alias("stage"))


def supersessions(charges: DataFrame) -> DataFrame:
    """mc_charge_id and the CP charge that continues it."""
    return classify_claims(charges).where("stage = 'superseded'").select("mc_charge_id", F.col("cp_charge_id").alias("superseded_by"))


def resolve_links(dockets: DataFrame) -> DataFrame:
    """One row for each cross-court number of an MC docket: docket_id, target, target_id, outcome.

    Outcomes: malformed (no number in the text), ambiguous_target, resolved, unresolved.
    """
    numbers = docket_numbers(F.col("cross_court_dockets"))
    sources = dockets.where("court = 'MC' and cross_court_dockets is not null").select("docket_id", F.explode_outer(numbers).alias("target"))
    known = dockets.groupBy(F.col("docket_number").alias("target")).agg(F.count("*").alias("n"), F.min("docket_id").alias("only"))
    outcome = F.when(F.col("target").isNull(), "malformed").when(F.col("n") >= 2, "ambiguous_target").when(F.col("n") == 1, "resolved").otherwise("unresolved")
    return sources.join(known, "target", "left").select("docket_id", "target", F.when(F.col("n") == 1, F.col("only")).alias("target_id"), outcome.alias("outcome"))
