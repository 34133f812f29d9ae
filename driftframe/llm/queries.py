"""The registered queries ``opN_<name>`` and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from driftframe.llm import ann, bpe, exact_dedup, host_reputation, line_dedup, merkle, mixture, order_minhash, pii, quality_bayes, quality_rules, sharding, token_alignment

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op5_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every document."""
    return order_minhash.classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "kept")


def op6_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule or reputation verdict on every page."""
    return host_reputation.judge(table(spark, sf_dir, "pages"))


def _is(kind: int) -> Callable[[Column], Column]:
    return lambda x: x["kind"] == kind


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, digest and all spans of every document."""
    out = pii.spans(table(spark, sf_dir, "documents"))
    counts = [F.size(F.filter("base", _is(k))).cast("long").alias(f"n_{name}") for k, name in enumerate(pii.KINDS[:4])]
    return out.select("doc_id", *counts, F.sha2(pii.listed(F.col("base")), 256).alias("base_sha256"), pii.listed(F.col("spans")).alias("spans"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without its repeated and nearly repeated lines."""
    return line_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place in eight shards of near equal bytes."""
    out = sharding.assign(table(spark, sf_dir, "documents"), shards=8)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "tokens")


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text encoded, decoded again, and both hashed."""
    import public_tokenizers

    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op1_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest neighbours of every vector whose id is divisible by 50."""
    base = ann.vectors(table(spark, sf_dir, "embeddings"))
    return ann.search(base, base.where(F.col("vec_id") % 50 == 0), k=5)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document."""
    return mixture.mix(table(spark, sf_dir, "documents")).drop("source")


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence, site posterior, score and verdict of every document."""
    return quality_bayes.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdict of every document."""
    return quality_rules.apply_rules(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens, groups and overlaps of two tokenizers over every whole text."""
    import public_tokenizers

    paths = (public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    return token_alignment.align(table(spark, sf_dir, "documents"), *paths)


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the one of its equal texts that stays."""
    return exact_dedup.groups(table(spark, sf_dir, "documents"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's leaf, roots and proof, and whether it still verifies once its text has been tampered with."""
    docs = table(spark, sf_dir, "documents")
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    return merkle.manifest(docs, tampered).drop("source")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of the corpus pipeline."""
    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Query]:
    return {"op1_cross_polytope": op1_cross_polytope, "op2_mixing": op2_mixing, "op3_quality_classifier": op3_quality_classifier, "op4_quality_rules": op4_quality_rules, "op5_order_minhash": op5_order_minhash, "op6_url_reputation": op6_url_reputation, "op7_pii": op7_pii, "op8_line_dedup": op8_line_dedup, "op9_sharding": op9_sharding, "op10_byte_bpe": op10_byte_bpe, "op11_token_alignment": op11_token_alignment, "op12_exact_dedup": op12_exact_dedup, "op13_merkle_manifest": op13_merkle_manifest, "pipeline": pipeline}


def oracle_sql() -> dict[str, str]:
    return {"op2_mixing": mixture.sql(), "op4_quality_rules": quality_rules.sql(), "op6_url_reputation": host_reputation.sql(), "op8_line_dedup": line_dedup.sql(), "op12_exact_dedup": exact_dedup.sql(), "op13_merkle_manifest": merkle.sql()}
