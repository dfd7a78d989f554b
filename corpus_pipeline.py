"""From documents to packed token ids: each stage works on all that the one before kept.

Every stage takes any table with doc_id, text and source; other columns pass through unchanged, whatever their names. Rows
are never lost to a null, an empty or a very long text, a tie or a repeat but as the stage says, and an empty table gives
an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import decontaminate, jaccard_join, mixing, token_files, toxicity
from tidemark.llm.queries import tokenizer_path
from tidemark.llm.shared import scratch


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts to be toxic go, each decided by its text alone: null and empty texts count as empty, repeated rows go or stay together. Without labels all stay."""
    return toxicity.without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the document with the least doc_id stays, of rows that repeat its doc_id and words one. Rows without words or without a doc_id stay."""
    return jaccard_join.one_of_each_class(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go, each row decided by its text alone. Null and empty texts stay; without items all stay."""
    return decontaminate.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's rate says; a document that is taken twice is there twice. A null source is one of its own; rows that repeat a doc_id and text draw each by a number of its own."""
    return mixing.mix(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files, and of each document what they hold: doc_id, start, n_tokens, ids_crc32. Null and empty texts are the end id alone; rows without a doc_id come first."""
    return token_files.round_trip(docs, tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("near duplicates", drop_near_duplicates),
    ("benchmark decontamination", drop_leaks),
    ("mixing", mix_sources),
    ("token output", write_tokens),
]

#: No SQL says what the models and searches decide; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents of sf_dir; each stage's table is written to the shared folder, which cuts the lineage, and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = scratch(spark, f"stage-{name.replace(' ', '-')}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
