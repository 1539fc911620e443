"""The queries of the text operators: opN_<name>(spark, sf_dir) -> DataFrame, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, compression, decontam, histshard, idcoder, langid, packing, pii, quality, simhash, toxicity


def vocabulary(name: str) -> str:
    """Where a public vocabulary file is installed."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.detect(common.documents(spark, sf_dir))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")


def op2_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compression.judge(common.documents(spark, sf_dir))


def op3_range_coder(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = common.scratch_path(spark, "ids")
    idcoder.write(common.documents(spark, sf_dir), vocabulary("word_bpe_49k.json"), path)
    return idcoder.read(spark, path, with_ids=False)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels, out = common.documents(spark, sf_dir, "labels"), common.held_out(F.col("doc_id"), 5, 0)
    found = toxicity.score(common.documents(spark, sf_dir), labels, ~out)
    return found.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "nearest")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = packing.pack(common.documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"))
    return found.drop("ids")


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    out = common.held_out(F.col("doc_id"), 3, 1)
    model = langid.train(docs.where(~out).select("text", "lang"))
    return langid.predict(docs.select("doc_id", out.alias("held_out"), "text"), model).drop("text")


def op7_histogram_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = histshard.shard(common.documents(spark, sf_dir))
    digest = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32")
    return found.select("doc_id", "size", digest, "law", "shard", "slot", "grown_shard")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(common.documents(spark, sf_dir), common.documents(spark, sf_dir, "benchmark"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(common.documents(spark, sf_dir))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = common.documents(spark, sf_dir, "labels")
    found = quality.score(common.documents(spark, sf_dir), labels, ~common.held_out(F.col("doc_id"), 5, 0))
    return found.select("doc_id", common.held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    """None of these operators can be said in SQL: hashes, compressors, tokenizers and models; tests hold them against brute force."""
    return {}
