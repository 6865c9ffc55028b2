"""The queries of this subpackage: one per operator over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, jaccard, licenses, pieces, pii, preference, quality, suffix_dedup, token_counts, toxicity
from .tables import table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= toxicity.LIMIT).cast("int").alias("predicted"), "n_hits")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(table(spark, sf_dir, "documents")).drop("ids", "nbest_ids")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pii.personal_data(docs, pii.fit(docs)).drop("masked")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.quality(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(table(spark, sf_dir, "documents"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), keep_bytes=False, passage=suffix_dedup.PASSAGE)


def op8_chat_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preference.preference_pairs(preference.pair_by_parity(table(spark, sf_dir, "conversations")))


def op9_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"))


def op10_token_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.length_histogram(token_counts.document_lengths(table(spark, sf_dir, "documents")))


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_decontamination, op3_sentencepiece, op4_pii, op5_quality, op6_licenses, op7_suffix_dedup, op8_chat_preference, op9_jaccard, op10_token_lengths)}
ORACLE_SQL = {"op8_chat_preference": preference.SQL}
