"""Scans of public output: identifying values, forbidden keys and forbidden words."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import forbidden_terms, holds_token
from ..patterns import ANY_DOCKET_NUMBER


def forbidden_keys(schema: T.StructType, stems: list[str], path: str = "$") -> list[str]:
    """Paths of fields whose name holds a stem, case, ``_`` and ``-`` aside."""
    if not stems:
        raise ValueError("no forbidden stems are given")
    out = []
    for f in schema.fields:
        here, plain = f"{path}.{f.name}", f.name.lower().replace("_", "").replace("-", "")
        out += [here] if any(s in plain for s in stems) else []
        kind = f.dataType
        while isinstance(kind, T.ArrayType):
            kind, here = kind.elementType, here + "[]"
        out += forbidden_keys(kind, stems, here) if isinstance(kind, T.StructType) else []
    return out


def value_violations(rows: DataFrame, pattern: str = ANY_DOCKET_NUMBER) -> DataFrame:
    """column, violations: rows whose value as text holds the pattern, in one pass over all columns."""
    text = {c: F.to_json(F.struct(c)) if isinstance(kind.dataType, (T.StructType, T.ArrayType, T.MapType)) else F.col(c).cast("string") for c, kind in zip(rows.columns, rows.schema.fields, strict=True)}
    counts = rows.agg(*[F.count_if(F.coalesce(t.rlike(pattern), F.lit(False))).alias(c) for c, t in text.items()])
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("violations")) for c in text])
    return counts.select(F.explode(pairs).alias("p")).select("p.column", "p.violations")


#: Flags that every dialect of patterns here knows.
PORTABLE_FLAGS = "ims"


def portable_pattern(source: str, flags: str = "") -> str:
    """A shared value pattern with its flags; a flag that is not portable is refused, as a scan without it
    would pass what it should find."""
    if unknown := sorted(set(flags) - set(PORTABLE_FLAGS)):
        raise ValueError(f"pattern flags {unknown} are not portable")
    return f"(?{''.join(sorted(set(flags)))}){source}" if flags else source


def json_key_violations(rows: DataFrame, column: str, stems: list[str]) -> DataFrame:
    """key, violations: rows whose JSON text has, at any depth, a key that holds a stem (case, ``_`` and ``-``
    aside)."""
    if not stems:
        raise ValueError("no forbidden stems are given")
    keys = F.regexp_extract_all(column, F.lit(r'"((?:[^"\\]|\\.)*)"\s*:'), F.lit(1))
    plain = lambda k: F.regexp_replace(F.lower(k), "[_-]", "")
    bad = F.filter(F.array_distinct(keys), lambda k: reduce(lambda a, s: a | F.contains(plain(k), F.lit(s)), stems, F.lit(False)))
    return rows.select(F.explode(bad).alias("key")).groupBy("key").agg(F.count("*").alias("violations"))


def leaks(record: Column, sentinels: Column) -> Column:
    """Whether a sentinel of three signs or more stands as a token in any leaf text of the record."""
    return F.exists(sentinels, lambda s: F.exists(record, lambda v: F.coalesce(holds_token(v, s), F.lit(False))))


def copy_violations(texts: DataFrame, column: str = "text") -> DataFrame:
    """All columns but the text, and each forbidden word with its place and 30 signs around it."""
    rest = [c for c in texts.columns if c != column]
    rows = texts.select(*rest, column, F.explode(forbidden_terms(F.col(column))).alias("v"))
    start = F.greatest(F.col("v.place") - 30, F.lit(0))
    return rows.select(*rest, "v.term", "v.place", "v.found", F.substring(column, start + 1, F.col("v.place") + F.length("v.found") + 30 - start).alias("context"))


def all_value_violations(tables: dict[str, DataFrame]) -> DataFrame:
    """The same over several tables, with a column table."""
    return reduce(DataFrame.unionByName, [value_violations(df).withColumn("table", F.lit(name)) for name, df in tables.items()])
