"""From raw documents to a mixed training corpus, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a frame; all but the last return the columns of `documents`. `run` writes what a
stage returns as Parquet to the shared folder and reads it again for the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.shipping import ship_code
from runsight.llm import decontamination, line_dedup, mixing, near_dup, toxicity
from runsight.sources.staging import stage


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go. The model learns from the labelled ones among the documents that aren't held out."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.less_toxic(docs, toxicity.fit(docs, labels))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes repeated lines out of the texts; every document stays, with its new number of characters."""
    return line_dedup.dedup_lines(docs).withColumn("n_chars", F.length("text").cast("long"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five words, similarity 0.8."""
    return near_dup.distinct_documents(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontamination.without_items(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How often, and with how many words, each document is in the mix."""
    return mixing.mix(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("near duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
]

ORACLE_SQL = None
"""Toxicity, near duplicates and decontamination can't be expressed in SQL; the tests hold them against brute force."""


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_code(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for position, (name, work) in enumerate(STAGES):
        docs = work(spark, docs, sf_dir)
        if position < len(STAGES) - 1:
            docs = stage(docs, "pipeline_" + name.replace(" ", "_"))
    return docs
