"""Intermediate results as tables in the cluster's shared folder.

A staged table cuts the lineage: a lost executor costs a re-read of files, not a re-run of the upstream plan.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_local_root: str | None = None
_recorders: list[list[str]] = []


@contextmanager
def recorded_staging() -> Iterator[list[str]]:
    """Lists the folders that are staged meanwhile, so that the caller can remove them when the results are no longer read."""
    paths: list[str] = []
    _recorders.append(paths)
    try:
        yield paths
    finally:
        _recorders.remove(paths)


def remove_staged(spark: SparkSession, paths: Iterable[str]) -> None:
    """Remove staged folders. Frames that read them can't be read any more."""
    for text in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(text)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def scratch_root(spark: SparkSession) -> str:
    """The folder named by `spark.checkpoint.dir`; a temporary one only on a local master."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    global _local_root
    if _local_root is None:
        _local_root = tempfile.mkdtemp(prefix="runsight-")
    return _local_root


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{scratch_root(spark)}/runsight/{name}_{uuid.uuid4().hex}"
    for paths in _recorders:
        paths.append(path)
    return path


def stage(df: DataFrame, name: str, partition_by: Sequence[str] = (), row_group: int | None = None) -> DataFrame:
    """Write `df` as Parquet to the shared folder and read it back. `row_group` is the bytes that readers can't cut up."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if row_group:
        writer = writer.option("parquet.block.size", row_group)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
