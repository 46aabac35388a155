"""A corpus pipeline: language identification, near-duplicate removal, decontamination, redaction, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before it kept; its result is written as
Parquet and read again as the next one's ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from heliosite.llm import decontamination, jaccard_join, language_id, packing, pii
from heliosite.llm.storage import persisted


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Train on the stage's own labelled rows; documents of no determined language go."""
    return language_id.accepted(docs, language_id.fit(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.keep_one(docs)


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs, pii.fit(pii.examples(spark)))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("language_id", keep_known_languages),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("decontamination", drop_benchmark_passages),
    ("pii", redact_personal_data),
    ("best_fit_packing", pack_sequences),
]

#: Language models, exact set joins and tokenisation have no SQL form; tests/llm holds the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = persisted(docs)
    return docs
