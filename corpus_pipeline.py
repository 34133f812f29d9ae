"""The corpus pipeline: five stages over ``documents``, each working on all that its predecessor kept.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; ``run`` writes it as Parquet to the shared
checkpoint folder and reads it back as the next one's ``docs``, so a lost executor costs a stage at most. All
but the last return the columns of ``documents``.

Null and empty texts have no words and go in the first stage, like all that it rejects; rows with null ids or sources are
documents like any others. Repeated rows are judged alike by the first two stages, the third keeps one row of a class of
near-duplicates (the smallest id, then the smallest text hash). Ties in the mix are settled by a hash of id and size. An
empty table gives an empty result. Extra columns are carried along up to the last stage, whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftframe.llm import bpe, line_dedup, mixture, order_minhash, quality_bayes
from driftframe.llm.text import stored


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it is fitted to the table of labels."""
    return quality_bayes.keep(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated and nearly repeated lines go; ``n_chars`` follows the text."""
    return line_dedup.dedup(docs).select(*(F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays."""
    return order_minhash.keep(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: its words taken over its size, a remainder of at least half
    as one more time. A document that the mix takes less than half of goes."""
    return mixture.repeated(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every text."""
    encoded = bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return encoded.select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [("quality_classifier", quality), ("line_dedup", lines), ("minhash_near_dedup", near_duplicates), ("mixing", mix), ("byte_bpe", tokens)]

#: The classifier's fit and the closure over near-duplicates have no SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
