"""The corpus pipeline: stages over the documents table, each written as Parquet and read again by the next.

Toxic documents go, one document of each near-duplicate group (5-word shingles, Jaccard 0.8) stays, documents with benchmark passages go, sources are
mixed to target weights (no document is lost, those of small sources are repeated), and token files are written and read.

A stage's plan runs when its caller writes it, so each stage sets the size of Arrow batches (`BATCHES`) for the session; run() puts back
what was set before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from addrloom.llm import decontaminate, mixing, simhash, token_files, toxicity
from addrloom.llm.common import materialise, table

#: Arrow batches of the stages: texts may be long, and tasks of several stages share an executor's memory.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}


def small_batches(spark: SparkSession) -> None:
    for k, v in BATCHES.items():
        spark.conf.set(k, v)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return toxicity.mild_rows(docs, toxicity.trained(spark, sf_dir))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return simhash.one_of_each(docs, shingle=5, similarity=0.8)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return decontaminate.clean_rows(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_rows(docs, repetition_limit=2.0)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return token_files.token_digest(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("source_mixing", mix_sources),
    ("token_files", write_tokens),
]

#: SQL can't express the toxicity model, components of near copies or the tokenizer; tests compare with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    before = {k: spark.conf.get(k, None) for k in BATCHES}
    try:
        for name, stage in STAGES:
            docs = materialise(stage(spark, docs, sf_dir), name)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return docs


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
