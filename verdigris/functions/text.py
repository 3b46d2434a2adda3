"""Text scalars as column expressions; nothing here needs a Python worker."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import patterns as P
from ..vocab import FORBIDDEN_TERMS, GUARDED_PHRASES, TRUNCATED_DISPOSITIONS
from .numbers import once


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def canonical_text(c: Column) -> Column:
    """Lower case, every run of other signs than a-z and 0-9 one blank, trimmed."""
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def canonical_statute(c: Column) -> Column:
    """Upper case, only A-Z, 0-9, dot and hyphen."""
    return F.regexp_replace(F.upper(c), "[^A-Z0-9.-]+", "")


def folded_otn(c: Column) -> Column:
    return F.nullif(F.upper(F.trim(F.regexp_replace(c, r"\s+", " "))), F.lit(""))


def folded_docket_number(c: Column) -> Column:
    return F.nullif(F.upper(F.trim(c)), F.lit(""))


def normal_name(c: Column) -> Column:
    """Lower-case letters and single blanks."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"[^a-z\s]", " "), r"\s+", " "))


def identity_hash(name: Column, salt: str, birth_year: Column | None = None) -> Column:
    """Salted SHA-256 of the normal name and, where given, the birth year."""
    if not salt.strip():
        raise ValueError("the salt is empty")
    parts = [F.lit(salt), normal_name(name)] + ([] if birth_year is None else [birth_year.cast("string")])
    return F.sha2(F.concat_ws("|", *parts), 256)


def like_literal(needle: str) -> str:
    """``needle`` as a LIKE pattern that matches itself only, with ``\\`` as the escape sign."""
    return needle.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


def match_rank(c: Column, needle: str) -> Column:
    """1 the same, 2 begins with it, 3 holds it; null otherwise. Case does not count."""
    low, key = F.lower(c), F.lit(needle.lower())
    return F.when(low == key, 1).when(F.startswith(low, key), 2).when(F.contains(low, key), 3)


def distinct_cents(c: Column) -> Column:
    """Distinct amounts of money in the text, in cents."""
    digits = lambda t: F.regexp_replace(t, "[$,]", "")
    cents = lambda t: F.when(F.contains(t, F.lit(".")), F.regexp_replace(digits(t), r"\.", "").cast("long")).otherwise(digits(t).cast("long") * 100)
    return F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(P.MONEY), F.lit(0)), cents))


def money(c: Column) -> Column:
    """struct(amount_cents, unparseable): an amount only where exactly one distinct amount stands."""
    text = F.coalesce(c, F.lit(""))
    only = lambda found: F.when(F.size(found) == 1, F.get(found, F.lit(0)))
    return once(distinct_cents(text), lambda found: F.struct(only(found).alias("amount_cents"), ((F.size(found) != 1) & F.contains(text, F.lit("$"))).alias("unparseable")))


def mentions_restitution(c: Column) -> Column:
    return c.rlike(P.RESTITUTION)


def mentions_community_service(c: Column) -> Column:
    return c.rlike(P.COMMUNITY_SERVICE)


def mentions_hours(c: Column) -> Column:
    return c.rlike(P.HOURS)


def fine_beyond_label(c: Column) -> Column:
    """A fine is named after one leading "Fines and Costs" label is taken off."""
    return F.regexp_replace(c, r"(?i)^\s*Fines and Costs", "").rlike(r"(?i)\bfines?\b")


def docket_numbers(c: Column, pattern: str = P.DOCKET_NUMBER) -> Column:
    """Distinct docket numbers in the text, in order."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(f"({pattern})"), F.lit(1)))


def court_name(docket_number: Column) -> Column:
    return F.when(F.startswith(docket_number, F.lit("MC-")), "Municipal Court").otherwise("Common Pleas")


def court_code(docket_number: Column) -> Column:
    return F.when(F.startswith(docket_number, F.lit("CP-")), "CP").when(F.startswith(docket_number, F.lit("MC-")), "MC")


def provenance(stem: Column) -> Column:
    """struct(docket_number, court, county) of a file stem; nulls where it is no docket number."""
    fits = stem.rlike(P.DOCKET_STEM)
    return F.struct(F.when(fits, stem).alias("docket_number"), F.when(fits, F.regexp_extract(stem, P.DOCKET_STEM, 1)).alias("court"), F.when(fits, F.regexp_extract(stem, P.DOCKET_STEM, 2)).alias("county"))


def any_of(c: Column, patterns: list[str]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | c.rlike(p)
    return out


def is_junk_judge(c: Column) -> Column:
    return any_of(c, P.JUNK_JUDGE)


def is_amended_charge(c: Column) -> Column:
    return any_of(c, P.AMENDED)


def repaired_disposition(c: Column) -> Column:
    """A known truncated disposition in full."""
    out = c
    for cut, whole in TRUNCATED_DISPOSITIONS.items():
        out = F.when(c == cut, whole).otherwise(out)
    return out


def is_statute_token(c: Column) -> Column:
    t = F.trim(c)
    return (t == "") | F.contains(t, F.lit("§")) | t.rlike(r"\d") | (F.length(t) == 1) | t.rlike(P.ROMAN) | (F.startswith(t, F.lit("(")) & F.endswith(t, F.lit(")")))


def charge_line_token(text: Column, offense: Column, statute: Column, grade: Column) -> Column:
    """What a disposition line says beyond the charge's own offense, statute and grade.

    The longest trimmed prefix of the offense goes from the front, then statute and grade from the end.
    """
    own = F.coalesce(offense, F.lit(""))
    sizes = F.sequence(F.length(own), F.lit(0), F.lit(-1))
    prefixes = F.transform(sizes, lambda n: F.trim(F.substring(own, F.lit(1), n)))
    longest = F.when(F.startswith(text, F.trim(own)), F.trim(own)).otherwise(F.get(F.filter(prefixes, lambda p: F.startswith(text, p)), F.lit(0)))
    rest = F.trim(F.substring(text, F.length(longest) + 1, F.length(text)))
    for tail in (statute, grade):
        tail = F.coalesce(tail, F.lit(""))
        rest = F.when((tail != "") & F.endswith(rest, tail), F.trim(F.substring(rest, F.lit(1), F.length(rest) - F.length(tail)))).otherwise(rest)
    return rest


def text_hash(pages: Column) -> Column:
    """SHA-256 of pages joined by form feeds."""
    return F.sha2(F.array_join(pages, "\f"), 256)


def text_status(pages: Column, least: int = 100) -> Column:
    """success, partial or needs_ocr_or_review, by pages of fewer than ``least`` signs."""
    poor = F.size(F.filter(pages, lambda p: F.length(F.regexp_replace(p, r"^\s+|\s+$", "")) < least))
    return F.when((poor == 0) & (F.size(pages) > 0), "success").when(poor == F.size(pages), "needs_ocr_or_review").otherwise("partial")


def dedup_key(*parts: Column) -> Column:
    """Parts joined by U+001F; a part that is null, empty or holds that sign is an error."""
    bad = F.lit(False)
    for p in parts:
        bad = bad | p.isNull() | (p == "") | F.contains(p, F.lit("\x1f"))
    return F.when(bad, F.raise_error(F.lit("a part of a key is missing, empty or holds the separator"))).otherwise(F.concat_ws("\x1f", *parts))


def sanitized_error(message: Column, path: Column, limit: int = 200) -> Column:
    """The message without the path, its name and its stem, cut at ``limit`` signs."""
    name = F.element_at(F.split(path, "/"), -1)
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    out = message
    for leak in (path, name, stem):
        out = F.when(leak != "", F.replace(out, leak, F.lit("<redacted>"))).otherwise(out)
    return F.when(F.length(out) > limit, F.concat(F.substring(out, 1, limit), F.lit("…"))).otherwise(out)


def holds_token(text: Column, token: Column) -> Column:
    """``token`` (three signs at least) stands in the text between other signs than letters and digits."""
    low, key = F.lower(text), F.lower(F.trim(token))
    quoted = F.concat(F.lit(r"(?<![a-z0-9])\Q"), key, F.lit(r"\E(?![a-z0-9])"))
    return (F.length(key) >= 3) & F.regexp_like(low, quoted)


def masked_copy(c: Column) -> Column:
    """The text with guarded phrases blanked out, every sign in its place."""
    out = c
    for phrase in GUARDED_PHRASES:
        out = F.regexp_replace(out, f"(?i){phrase}", " " * len(phrase))
    return out


def _places(text: Column, term: str, pattern: str) -> Column:
    """array(struct(term, place, found)): each match begins where the pieces and matches before it end."""
    found = F.regexp_extract_all(text, F.lit(f"(?i)({pattern})"), F.lit(1))
    pieces = F.split(text, f"(?i){pattern}", -1)
    size = lambda parts: F.aggregate(parts, F.lit(0), lambda a, p: a + F.length(p))
    return F.transform(found, lambda m, i: F.struct(F.lit(term).alias("term"), (size(F.slice(pieces, F.lit(1), i + 1)) + size(F.slice(found, F.lit(1), i))).alias("place"), m.alias("found")))


def forbidden_terms(c: Column) -> Column:
    """array(struct(term, place, found)) of forbidden words outside guarded phrases; places from 0."""
    text = masked_copy(c)
    return F.flatten(F.array(*[_places(text, term, pattern) for term, pattern in FORBIDDEN_TERMS.items()]))


def related_docket(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, f"({P.ANY_DOCKET_NUMBER})", 1), F.lit(""))
