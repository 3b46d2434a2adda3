"""Personal names as structured, folded identities, in column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..patterns import HONORIFICS
from ..vocab import NAME_SUFFIXES

def folded(c: Column) -> Column:
    """Lower case; apostrophes and hyphens joined; every other run of signs one blank."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), "['’\\-]", ""), "[^a-z0-9]+", " "))


def without_honorifics(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.trim(c), HONORIFICS, ""))


def _tokens(c: Column) -> Column:
    return F.filter(F.split(folded(c), " "), lambda t: t != "")


def _last_proper(tokens: Column) -> Column:
    """Place (from 1) of the last token that is no suffix such as "jr"; 0 if there is none."""
    return F.coalesce(F.array_max(F.transform(tokens, lambda t, i: F.when(~t.isin(NAME_SUFFIXES), i + 1))), F.lit(0))


def _first(tokens: Column, n: Column) -> Column:
    return F.slice(tokens, F.lit(1), n)


def _after(tokens: Column, n: Column) -> Column:
    return F.slice(tokens, n + 1, F.greatest(F.size(tokens) - n, F.lit(0)))


def canonical_name(c: Column) -> Column:
    """struct(surname, given, suffix) of token arrays; null where the name is absent.

    Before the first comma stands the surname; without a comma the last token that is no suffix is it.
    """
    text = without_honorifics(c)
    comma = F.contains(text, F.lit(","))
    before, behind = _tokens(F.regexp_extract(text, "(?s)^([^,]*),", 1)), _tokens(F.regexp_extract(text, "(?s)^[^,]*,(.*)$", 1))
    whole = _tokens(text)
    rest = F.when(comma, behind).otherwise(whole)
    k = _last_proper(rest)
    surname = F.when(comma, before).otherwise(_after(_first(whole, k), F.greatest(k - 1, F.lit(0))))
    given = F.when(comma, _first(rest, k)).otherwise(_first(rest, F.greatest(k - 1, F.lit(0))))
    suffix = _after(rest, k)
    present = (F.trim(c) != "") & F.when(comma, (F.size(before) > 0) | (F.size(behind) > 0)).otherwise(k > 0)
    return F.when(present, F.struct(surname.alias("surname"), given.alias("given"), suffix.alias("suffix")))


def middles(name: Column) -> Column:
    return F.slice(name["given"], F.lit(2), F.greatest(F.size(name["given"]) - 1, F.lit(0)))


def compatible(a: Column, b: Column) -> Column:
    """Suffixes equal or one absent; middle names absent on one side, or equal or initials of each other.

    Surname and first name are the join keys and are not compared here.
    """
    initial = lambda x, y: (F.length(x) == 1) & (x == F.substring(y, 1, 1))
    suffix = (F.size(a["suffix"]) == 0) | (F.size(b["suffix"]) == 0) | (a["suffix"] == b["suffix"])
    ma, mb = middles(a), middles(b)
    pairs = F.zip_with(ma, mb, lambda x, y: (x == y) | initial(x, y) | initial(y, x))
    alike = (F.size(ma) == 0) | (F.size(mb) == 0) | ((F.size(ma) == F.size(mb)) & F.forall(pairs, lambda p: p))
    return suffix & alike
