"""From raw documents to token ids: five stages, each over all that the one before kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kairograph.llm import decontaminate, language, near_copies, pii, sentencepiece_scan
from kairograph.llm.common import unused, written


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without a letter and texts of which hardly any n-gram is of a known language."""
    found = language.identify(docs.withColumn("__t", F.col("text")), language.fit(docs), "__t", [*docs.columns])
    return found.where((F.col("lang_pred") != language.UNKNOWN) & (F.col("coverage") >= language.LEAST_COVERAGE)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near copies: 5-word shingles, Jaccard similarity 0.8 or more."""
    return near_copies.one_of_each(docs)


def remove_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the benchmark contaminates."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate.decontaminate(docs, benchmark, keep=[*docs.columns])
    return found.where(~F.col("contaminated")).select(*docs.columns)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in the texts, and corrects ``n_chars``."""
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, and whether they decode to it."""
    return sentencepiece_scan.encode_decode(docs, keep=["doc_id"]).select("doc_id", "n_pieces", "ids", "round_trip")


STAGES = [
    ("language", identify_language),
    ("near_duplicates", near_duplicates),
    ("decontamination", remove_benchmarks),
    ("personal_data", redact_personal_data),
    ("sentencepiece", encode_pieces),
]

#: XXH64 fingerprints, trained filters and token ids have no SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each written to the shared folder and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs, _ = written(stage(spark, docs, sf_dir), unused([], name))
    return STAGES[-1][1](spark, docs, sf_dir)
