from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession


def load(spark: SparkSession, sf_dir: str, name: str, spread: bool = False) -> DataFrame:
    """A given table. With `spread`, one that is a single small file is cut up for all cores.

    That is for work that is heavy per row; a table of many files keeps its own partitions.
    """
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if spread and df.rdd.getNumPartitions() < cores else df


_stored: dict[tuple[str, str, str], Any] = {}


def stored(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], Any]) -> Any:
    """A table, or its place, derived from the given ones that several queries read, built once per application."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _stored:
        _stored[key] = build()
    return _stored[key]
