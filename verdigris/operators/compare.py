"""Differences between records, and between page texts, as joins on paths and positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _paths(c: Column, kind: T.DataType, path: Column, without: set[str]) -> Column:
    """array(struct(path, value)) of all leaves; arrays add their length under ``path.length``."""
    leaf = lambda p, v: F.struct(p.alias("path"), v.alias("value"))
    none = F.array().cast("array<struct<path:string,value:string>>")
    if isinstance(kind, T.StructType):
        parts = [_paths(c[f.name], f.dataType, F.concat(path, F.lit("." + f.name)), without) for f in kind.fields if f.name not in without]
        return F.concat(none, *parts)
    if isinstance(kind, T.ArrayType):
        each = F.transform(F.coalesce(c, F.array().cast(kind)), lambda x, i: _paths(x, kind.elementType, F.concat(path, F.lit("["), i.cast("string"), F.lit("]")), without))
        return F.concat(F.array(leaf(F.concat(path, F.lit(".length")), F.size(c).cast("string"))), F.flatten(each))
    return F.array(leaf(path, c.cast("string")))


def leaves(rows: DataFrame, key: str, *, without: set[str] = frozenset()) -> DataFrame:
    """key, path, value of every leaf of every row."""
    parts = [_paths(F.col(f.name), f.dataType, F.lit("$." + f.name), set(without)) for f in rows.schema.fields if f.name != key and f.name not in without]
    return rows.select(key, F.explode(F.concat(*parts)).alias("leaf")).select(key, "leaf.path", "leaf.value")


def deep_diff(left: DataFrame, right: DataFrame, key: str, *, without: set[str] = frozenset()) -> DataFrame:
    """key, path, kind (missing_left, missing_right, length, value), left_value, right_value of every difference."""
    a = leaves(left, key, without=without).withColumnRenamed("value", "left_value").withColumn("in_left", F.lit(True))
    b = leaves(right, key, without=without).withColumnRenamed("value", "right_value").withColumn("in_right", F.lit(True))
    rows = a.join(b, [key, "path"], "full_outer")
    kind = F.when(F.col("in_left").isNull(), "missing_left").when(F.col("in_right").isNull(), "missing_right").when(~F.col("left_value").eqNullSafe(F.col("right_value")), F.when(F.endswith("path", F.lit(".length")), "length").otherwise("value"))
    return rows.select(key, "path", kind.alias("kind"), "left_value", "right_value").where("kind is not null")


def canonical(c: Column) -> Column:
    """A list of records in the order of their JSON, for comparison without order."""
    return F.array_sort(F.transform(c, lambda x: F.to_json(x)))


def line_seams(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """key, page, line of every line that differs between two page texts (column pages)."""
    lines = lambda df, name: df.select(key, F.posexplode("pages").alias("page", "text")).select(key, "page", F.posexplode(F.split("text", "\n", -1)).alias("line", name))
    rows = lines(left, "left_line").join(lines(right, "right_line"), [key, "page", "line"], "full_outer")
    return rows.where(~F.col("left_line").eqNullSafe(F.col("right_line")))


def regressions(old: DataFrame, new: DataFrame) -> DataFrame:
    """docket_id, sequence of charges that had a disposition and have none any more, or are gone."""
    had = old.where("disposition_raw is not null").select("docket_id", "sequence")
    has = new.where("disposition_raw is not null").select("docket_id", "sequence")
    return had.join(has, ["docket_id", "sequence"], "left_anti")


def undisposed(old: DataFrame, new: DataFrame) -> DataFrame:
    """Charges on both sides that the new parse leaves without the disposition they had."""
    a, b = old.where("disposition_raw is not null").select("docket_id", "sequence", F.col("disposition_raw").alias("was")), new.where("disposition_raw is null").select("docket_id", "sequence")
    return a.join(b, ["docket_id", "sequence"])


def lost_sequences(old: DataFrame, new: DataFrame) -> DataFrame:
    """docket_id, lost: the disposed sequences of each docket that are no longer disposed, in order."""
    listed = lambda df, name: df.where("disposition_raw is not null").groupBy("docket_id").agg(F.collect_set("sequence").alias(name))
    rows = listed(old, "had").join(listed(new, "has"), "docket_id", "left")
    lost = F.when(F.col("has").isNull(), F.col("had")).otherwise(F.array_except("had", "has"))
    return rows.select("docket_id", F.sort_array(lost).alias("lost")).where(F.size("lost") > 0)


def same_hash(raw: DataFrame, parsed: DataFrame) -> DataFrame:
    """Raw documents with the parsed one of the same file hash."""
    return raw.join(parsed, "file_hash")


def shrunk(old: DataFrame, new: DataFrame) -> DataFrame:
    """Dockets with fewer charges than before."""
    count = lambda df, name: df.groupBy("docket_id").agg(F.count("*").alias(name))
    return count(old, "before").join(count(new, "after"), "docket_id").where("after < before")
