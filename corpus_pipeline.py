"""The corpus pipeline: documents in, packed token sequences out.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; all but the last return the columns
of documents. run() writes each stage's rows to the shared folder as Parquet and reads them again for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rastrel.llm import common, decontam, langid, packing, pii, queries, simhash

#: The least probability of a predicted language that keeps a document.
SURE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents whose language the model can't tell: null texts, texts without a letter (`und`), and those it is less
    than `SURE` sure of. Where no row names a language there is no model, and only the first two go. lang stays as given."""
    model = langid.train(docs.where(~common.held_out(F.col("doc_id"), 3, 1)).select("text", "lang"))
    found, score = common.fresh(docs, "_lang", "_score")
    told = langid.predict(docs, model, found, score)
    sure = (F.col(found) != langid.UNKNOWN) & (F.col(score) >= SURE) if model.langs else F.col("text").rlike(r"\p{L}")
    return told.where(sure).drop(found, score)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each component of near duplicates."""
    return simhash.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a benchmark item."""
    return decontam.clean(docs, common.documents(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data and the terms that reveal it; n_chars follows the new text."""
    new = pii.sanitise(docs)
    if "n_chars" in docs.columns:
        kind = dict(docs.dtypes)["n_chars"]
        new = new.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(kind)))
    return new


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of power-of-two lengths, none across documents."""
    return packing.pack(docs, queries.vocabulary("byte_bpe_50k.json"))


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("personal_data", personal_data),
    ("pack", pack),
]

#: SQL can express none of the models, fingerprints and tokenizers; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = common.table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
