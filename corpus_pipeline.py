"""Corpus pipeline: documents through the stages in order, each written as Parquet and reread."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from civiclens.llm import credentials, jaccard_join, langid, merge_dropout, spaced_seeds
from civiclens.llm.shared import stored

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the model rejects go."""
    rows = docs.select(*COLUMNS)
    return langid.predict(rows, langid.train(rows)).where("not rejected").select(*COLUMNS)


def jaccard_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that link on five-word shingles (Jaccard 0.8 or more) the one with the smallest id stays."""
    return jaccard_join.deduplicate(docs.select(*COLUMNS), size=5, percent=80, by_row=True)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap a benchmark item go."""
    return spaced_seeds.clean(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), by_row=True)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; documents without any stay as they are."""
    clean = credentials.redact(docs.select(*COLUMNS))
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def tokenization(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, with merge-dropout; `lossless` tells that they decode to the text."""
    import public_tokenizers

    coded = merge_dropout.encode(docs.select(*COLUMNS), public_tokenizers.path("piece_bpe_32k.model"), decoded=True)
    return coded.select("doc_id", "lang", "source", "ids", F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_tokens"),
                        F.col("decoded").eqNullSafe(F.col("text")).alias("lossless"))


STAGES = [
    ("language_id", language_id),
    ("jaccard_deduplication", jaccard_deduplication),
    ("benchmark_decontamination", benchmark_decontamination),
    ("secret_scan", secret_scan),
    ("tokenization", tokenization),
]

#: Trained models and tokenizers cannot be expressed in SQL; tests/llm compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
