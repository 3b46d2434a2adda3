"""A training-corpus pipeline over ``documents``: five stages, each calling one operator.

Each stage takes what its predecessor kept, reread from Parquet, and its decisions take effect: rows
are dropped, texts are cut. All stages but the last return the columns of ``documents``.

Defined cases, in every stage: null and empty texts have no letter, so the first stage drops them, and
the later ones keep them where they get them; documents of any length are handled whole; ties go to the
smaller id, in language ID to the language that sorts first; of rows with one id near-duplicate removal
keeps the one whose text and columns sort first, where the others stay as they are; an empty table gives
an empty one; columns of the table named like an operator's result pass through unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.llm import decontaminate, langid, minhash, packing, substring_dedup
from verdigris.llm.common import crc_fold, free_name, table, written
from verdigris.llm.entry_queries import PIECES, WORD_BPE

#: Documents whose likeliest language has a lower posterior are rejected.
LEAST_SCORE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter or without a likely language go."""
    model = langid.fit(docs.where(crc_fold(F.col("doc_id")) != 0), PIECES)
    into = free_name(docs.columns, "language")
    found = langid.identify(docs, model, PIECES, into=into)
    return found.where((F.col(f"{into}.lang_pred") != "und") & (F.col(f"{into}.score") >= LEAST_SCORE)).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays, once."""
    judged = written(minhash.near_duplicates(docs), "near-dedup")
    left = docs.join(judged.where("not kept").select("doc_id"), "doc_id", "left_anti").select(*docs.columns)
    repeated = judged.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    if repeated.isEmpty():
        return left
    least = F.min(F.struct("text", *[c for c in docs.columns if c not in ("doc_id", "text")])).alias("least")  # the same row in every run
    again = left.join(repeated, "doc_id", "left_semi").groupBy("doc_id").agg(least).select("doc_id", "least.*").select(*docs.columns)
    return left.join(repeated, "doc_id", "left_anti").select(*docs.columns).unionByName(again)


def substring_cut(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document has are cut out; documents of which nothing is left go."""
    into = free_name(docs.columns, "parse")
    parsed = substring_dedup.dedup(docs, layout=True, into=into)
    removed, words = F.col(f"{into}.n_removed"), F.col(f"{into}.n_words")
    left = parsed.where((removed == 0) | (removed < words))
    cut = left.withColumn("text", F.when(removed > 0, F.col(f"{into}.kept")).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.when(removed > 0, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return cut.select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of sequences that the remaining documents fill."""
    return packing.pack(docs, WORD_BPE)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_cut),
    ("decontamination", decontamination),
    ("packing", pack),
]

#: Tokenizers and models are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every result is written to the shared folder and reread."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
