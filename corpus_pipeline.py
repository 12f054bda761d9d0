"""Corpus pipeline: toxicity, near duplicates, benchmark passages, source mixture, token files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vecweave.llm.common import remove_path, shared_path, table
from vecweave.llm.decontaminate import drop_contaminated
from vecweave.llm.mixing import mixed
from vecweave.llm.nearcopies import keep_one_near
from vecweave.llm.tokens import digest_tokens, write_tokens
from vecweave.llm.toxicity import drop_toxic


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't predicted toxic."""
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def near_copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word similarity of 0.8 or more)."""
    return keep_one_near(docs)


def benchmark_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def sources_mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents replicated to their source's target weight, in shuffled order."""
    return mixed(docs)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files, and each document's place, length and checksum read back from them."""
    return digest_tokens(write_tokens(docs))


STAGES = [
    ("toxicity", toxic_out),
    ("near duplicates", near_copies_out),
    ("decontamination", benchmark_out),
    ("mixing", sources_mixed),
    ("token output", token_files),
]

#: Trees, components and tokenizers can't be written in SQL; the stages are tested against plain versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written as Parquet in the shared folder and read again.

    A stage's folder goes once the next one is written; the last one and the token files are the result and stay. A row
    without a doc_id goes through all stages like any other, by its own text; null and empty texts are copies of each
    other, of which one stays; rows that repeat as a whole are one document until mixing, where each copy has a place of
    its own. An empty table gives an empty result.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(path := shared_path(spark, f"pipeline-{k}"))
        docs = spark.read.parquet(path)
        if before:
            remove_path(spark, before)
        before = path
    return docs
