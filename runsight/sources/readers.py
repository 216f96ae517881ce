from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_event_log(
    spark: SparkSession,
    paths: str | Sequence[str],
    cluster_id: str,
    record_col: str = "logMessage",
    cluster_col: str = "clusterId",
) -> DataFrame:
    """One JSON event per line, from any paths or globs (compressed and rolling logs too)."""
    lines = spark.read.text([paths] if isinstance(paths, str) else list(paths))
    return lines.select(F.col("value").alias(record_col), F.lit(cluster_id).alias(cluster_col))


def read_prompts(spark: SparkSession, paths: str | Sequence[str], column: str = "question") -> DataFrame:
    """One prompt per line, stripped."""
    lines = spark.read.text([paths] if isinstance(paths, str) else list(paths))
    return lines.select(F.regexp_replace("value", r"^\s+|\s+$", "").alias(column))


def read_json_dir(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """JSON files under `path`; unreadable files and files that vanish meanwhile are skipped."""
    return (
        spark.read.schema(schema)
        .option("ignoreCorruptFiles", "true")
        .option("ignoreMissingFiles", "true")
        .option("mode", "DROPMALFORMED")
        .json(path)
    )
