"""Matching of raw texts to curated rosters and vocabularies.

Rosters are reference data: columns id, display_name, aliases (array) and, for charges, statute.
They are joined by canonical keys that are aggregated first, so no row fans out; whether a side is
broadcast is left to Catalyst, which knows its size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import vocab as V
from ..functions.names import canonical_name, compatible
from ..functions.numbers import once
from ..functions.text import canonical_statute, canonical_text, mentions_community_service, mentions_hours, mentions_restitution, money


def roster_snapshot(entries: DataFrame, aliases: DataFrame, *, without: list[str] | None = None) -> DataFrame:
    """One row for each active entry, with the array of its aliases; slugs in ``without`` are left out."""
    own = aliases.groupBy("entry_id").agg(F.sort_array(F.collect_list("alias")).alias("aliases"))
    rows = entries.where("active").join(own, entries.id == own.entry_id, "left").drop("entry_id")
    rows = rows.withColumn("aliases", F.coalesce("aliases", F.array().cast("array<string>")))
    return rows.where(~F.col("slug").isin(without)) if without else rows


def _ids_by_key(roster: DataFrame, key: Column, name: str) -> DataFrame:
    rows = roster.select("id", key.alias("key")).where("key <> ''")
    return rows.groupBy("key").agg(F.sort_array(F.collect_set("id")).alias(name)).withColumnRenamed("key", f"{name}_key")


def match_charges(charges: DataFrame, roster: DataFrame, *, offense: str = "offense", statute: str = "statute", into: str = "charge") -> DataFrame:
    """``charges`` with a struct ``into``: id, method, warning, candidates.

    Text (display name, else alias) and statute each name a set of entries. Text decides; a statute
    that does not agree with the one text entry makes a conflict; a statute alone serves where no
    text fits. Both inputs blank are unmatched.
    """
    display = _ids_by_key(roster, canonical_text(F.col("display_name")), "by_display")
    alias = _ids_by_key(roster.select("id", F.explode("aliases").alias("alias")), canonical_text(F.col("alias")), "by_alias")
    code = _ids_by_key(roster, canonical_statute(F.col("statute")), "by_statute")
    text_key, code_key = canonical_text(F.col(offense)), canonical_statute(F.col(statute))
    rows = charges.join(display, text_key == F.col("by_display_key"), "left").join(alias, text_key == F.col("by_alias_key"), "left").join(code, code_key == F.col("by_statute_key"), "left")
    none = F.array().cast(roster.select(F.array("id")).schema[0].dataType)
    ids = lambda name: F.coalesce(F.col(name), none)
    on_display = F.size(ids("by_display")) > 0
    text, codes = F.when(on_display, ids("by_display")).otherwise(ids("by_alias")), ids("by_statute")
    n, m = F.size(text), F.size(codes)
    blank = (F.coalesce(text_key, F.lit("")) == "") & (F.coalesce(code_key, F.lit("")) == "")
    agrees = (m == 0) | F.array_contains(codes, F.get(text, F.lit(0)))
    method = F.when(n >= 2, V.AMBIGUOUS).when((n == 1) & ~agrees, V.AMBIGUOUS).when((n == 1) & on_display, V.EXACT).when(n == 1, V.ALIAS).when(m == 1, V.STATUTE).when(m == 0, V.UNMATCHED).otherwise(V.AMBIGUOUS)
    warning = F.when(blank, V.NORM_EMPTY_INPUT).when((n == 1) & ~agrees, V.NORM_STATUTE_TEXT_CONFLICT).when(method == V.AMBIGUOUS, V.NORM_AMBIGUOUS).when(method == V.UNMATCHED, V.NORM_UNMATCHED)
    matched = method.isin(V.PUBLIC_METHODS)
    found = F.struct(F.when(matched, F.get(F.when(n == 1, text).otherwise(codes), F.lit(0))).alias("id"), method.alias("method"), warning.alias("warning"), F.sort_array(F.array_union(text, codes)).alias("candidates"))
    return rows.withColumn(into, found).drop("by_display", "by_display_key", "by_alias", "by_alias_key", "by_statute", "by_statute_key")


def match_judges(values: DataFrame, roster: DataFrame, *, name: str = "name", into: str = "judge") -> DataFrame:
    """``values`` with a struct ``into``: id, method; null where no name is given.

    An exact identity on a display name, then on an alias, then with tolerance for middle names and
    suffixes. Several entries are ambiguous. Every distinct raw name is matched once.
    """
    forms = roster.select("id", F.col("display_name").alias("form"), F.lit(True).alias("shown")).union(roster.select("id", F.explode("aliases"), F.lit(False)))
    known = forms.select("id", "shown", canonical_name(F.col("form")).alias("known")).where("known is not null")
    raw = values.select(F.col(name).alias("raw")).where("raw is not null").distinct().select("raw", canonical_name(F.col("raw")).alias("asked")).where("asked is not null")
    same_start = (F.col("asked.surname") == F.col("known.surname")) & (F.get("asked.given", F.lit(0)) == F.get("known.given", F.lit(0)))
    # two blocks, each with all of its key in the join: the whole name, and surname with first name, which a
    # name without a first name is not in; no block grows with a surname alone
    pairs = lambda on, kind: raw.join(known, on).select("raw", "id", "shown", F.lit(kind).alias("kind"), "asked", "known")
    exact = pairs(F.col("asked") == F.col("known"), "equal")
    close = pairs(same_start, "near").where(compatible(F.col("asked"), F.col("known")))
    near = exact.unionByName(close).drop("asked", "known").unionByName(raw.select("raw"), allowMissingColumns=True)
    equal, tolerant = F.col("kind") == "equal", F.col("kind") == "near"
    some = lambda cond: F.collect_set(F.when(cond, F.col("id")))
    sets = near.groupBy("raw").agg(some(equal & F.col("shown")).alias("display"), some(equal & ~F.col("shown")).alias("alias"), some(tolerant).alias("near"), F.coalesce(F.bool_or(tolerant & F.col("shown")), F.lit(False)).alias("near_shown"))
    best = F.when(F.size("display") > 0, F.col("display")).when(F.size("alias") > 0, F.col("alias")).otherwise(F.col("near"))
    one = F.when(F.size("display") > 0, V.EXACT).when(F.size("alias") > 0, V.ALIAS).when(F.col("near_shown"), V.EXACT).otherwise(V.ALIAS)
    method = F.when(F.size(best) == 0, V.UNMATCHED).when(F.size(best) > 1, V.AMBIGUOUS).otherwise(one)
    answers = sets.select("raw", F.struct(F.when(F.size(best) == 1, F.get(best, F.lit(0))).alias("id"), method.alias("method")).alias(into))
    return values.join(answers, F.col(name) == F.col("raw"), "left").drop("raw")


def disposition(c: Column) -> Column:
    """struct(held, category, mapped, public) of a raw disposition, exact to the byte.

    No disposition and held forms have a null category; an unknown text has ``unknown``.
    """
    held = F.coalesce(c.isin(V.HELD_FORMS), F.lit(False))
    code = F.lit(None).cast("string")
    for category, forms in V.DISPOSITIONS.items():
        code = F.when(c.isin(forms), category).otherwise(code)
    mapped = code.isNotNull()
    public = code.isin([k for k, shown in V.OUTCOME_CATEGORIES if shown])
    category = F.when(~held & c.isNotNull(), F.coalesce(code, F.lit(V.UNKNOWN)))
    return F.struct(held.alias("held"), category.alias("category"), mapped.alias("mapped"), F.coalesce(public, F.lit(False)).alias("public"))


def component(sentence_type: Column, raw_text: Column) -> Column:
    """struct(categories, category, mapped, public, ambiguous, amount_cents, money_unparseable, method); each pattern is tried once."""
    text = F.coalesce(raw_text, F.lit(""))
    base = F.lit(None).cast("string")
    for kind, category in V.SENTENCE_TYPES.items():
        base = F.when(sentence_type == kind, category).otherwise(base)
    restitution = mentions_restitution(text) | F.coalesce(mentions_restitution(sentence_type), F.lit(False))
    read = F.struct(base.alias("base"), restitution.alias("restitution"), mentions_community_service(text).alias("service"), mentions_hours(text).alias("hours"), money(text).alias("money"))

    def judged(r: Column) -> Column:
        categories = F.array_compact(F.array(F.coalesce(r["base"], F.lit(V.UNKNOWN)), F.when(r["restitution"], "restitution"), F.when(r["service"], "community_service")))
        ambiguous = ~r["service"] & r["hours"]
        monetary = F.arrays_overlap(categories, F.array(*[F.lit(m) for m in V.MONETARY]))
        public = r["base"].isin([k for k, shown in V.SENTENCING_CATEGORIES if shown])
        method = F.when(r["base"].isNull(), V.UNMATCHED).when(ambiguous, V.AMBIGUOUS).otherwise(V.EXACT)
        return F.struct(
            categories.alias("categories"),
            F.coalesce(r["base"], F.lit(V.UNKNOWN)).alias("category"),
            r["base"].isNotNull().alias("mapped"),
            F.coalesce(public, F.lit(False)).alias("public"),
            ambiguous.alias("ambiguous"),
            F.when(monetary, r["money"]["amount_cents"]).alias("amount_cents"),
            (monetary & r["money"]["unparseable"]).alias("money_unparseable"),
            method.alias("method"),
        )

    return once(read, judged)
