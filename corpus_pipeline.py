"""The corpus pipeline: each stage works on all that its predecessor kept, through a table written and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from seriesloom.llm import decontaminate, jaccard, pieces, pii, toxicity
from seriesloom.llm.tables import shared_dir, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored toxic go. Null and empty texts have no match and stay; repeated rows have one score each."""
    return toxicity.keep_clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents connected by n-gram similarity the one with the smallest id stays, a repeated row once.

    Texts without words are linked with nothing and stay; rows without id count after all others."""
    return jaccard.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go, each decided by its own text. Null and empty texts hold none."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts is replaced by its kind; n_chars follows. Null texts stay null. No row goes."""
    return pii.masked(docs, pii.fit(docs))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts become piece ids, and the digests of their best segmentations; decoding the ids gives the text back.

    Null and empty texts have no ids; repeated rows give repeated results."""
    return pieces.encode(docs).drop("nbest_ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("PII", mask_personal_data),
    ("SentencePiece", encode_pieces),
]

#: SQL cannot express these stages; the pipeline is tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, at = table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{k}")
        docs = spark.read.parquet(f"{at}/{k}")
    return docs
