"""The registered queries of this subpackage: one thin query for each operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, collocations, decontaminate, langid, minhash, oracles, packing, substring_dedup, token_counts, toxicity, url_filter, warc, whitening
from .common import crc_fold, shared_folder, table

PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
MULTI_BPE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")

#: Labels that may be broadcast, in bytes: an id and a label are 12. Beyond, Spark joins them by shuffle.
BROADCAST_BYTES, LABEL_BYTES = 60 << 20, 12

#: The rules of the URL filter query: host, path, action.
URL_RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring_dedup.dedup(docs).select("doc_id", "parse.n_words", "parse.n_removed", F.sha2("parse.kept", 256).alias("kept_sha256"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "warc")
    warc.write(warc.with_revisits(table(spark, sf_dir, "pages").select("page_id", "url", "html")), folder)
    return warc.read(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    fold = crc_fold(F.col("doc_id"))
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").where("toxic is not null").where(fold != 0)
    if labels.count() * LABEL_BYTES <= BROADCAST_BYTES:
        labels = F.broadcast(labels)
    labelled = docs.join(labels, "doc_id")
    model = toxicity.fit(labelled, held_back=fold == 4)
    return toxicity.assess(docs, model, keep_text=False).select("doc_id", (fold == 0).alias("held_out"), "toxicity.score", (F.col("toxicity.score") >= 0.5).cast("int").alias("predicted"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, action string")
    return url_filter.judge(table(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "filter.host", "filter.path", "filter.rule", "filter.verdict")


def op5_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 50 == 0, k=5)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs.where(crc_fold(F.col("doc_id")) != 0), PIECES)
    return langid.identify(docs.select("doc_id", "text"), model, PIECES).select("doc_id", (crc_fold(F.col("doc_id")) == 0).alias("held_out"), "language.lang_pred", "language.score")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.token_counts(docs, PIECES).select("doc_id", "tokens.n_bytes", "tokens.n_tokens", (F.col("tokens.n_tokens") > 4096).alias("over_limit"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.scan(docs, table(spark, sf_dir, "benchmark"))
    hits = F.size("scan.hit").cast("long")
    return found.select("doc_id", "scan.n_words", hits.alias("n_hit"), F.size("scan.items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "scan.items"), 256).alias("items_sha256"), (hits > 0).alias("contaminated"))


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return minhash.near_duplicates(docs, shingle=2, similarity=(80, 100))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text"), WORD_BPE)


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), MULTI_BPE, public_tokenizers.PATTERN, keep=["doc_id"])
    found = bpe.decode(encoded, MULTI_BPE)
    listed = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    model = whitening.fit(rows)
    error = whitening.identity_error(rows, model)
    share = F.array(*[F.lit(e) for e in model.explained[:8]]).cast("array<double>")
    found = whitening.whiten(rows, model).select("vec_id", "whitening.deviation", F.posexplode("whitening.whitened").alias("at", "whitened"))
    return found.select("vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", F.element_at(share, F.col("at") + 1).alias("explained"), F.lit(error).alias("identity_error"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(table(spark, sf_dir, "documents").select("lang", "text"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_substring_dedup, op2_warc, op3_toxicity, op4_url_filter, op5_ann, op6_language_id, op7_token_counts, op8_decontaminate, op9_minhash, op10_packing, op11_byte_bpe, op12_whitening, op13_collocations)}


def oracle_sql() -> dict[str, str]:
    return {name: sql.strip() for name, sql in oracles.ORACLES.items()}
