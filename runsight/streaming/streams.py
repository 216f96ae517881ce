from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from runsight.sources.staging import scratch_path


def rate_stream(spark: SparkSession, rows_per_second: int) -> DataFrame:
    return spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load()


def event_stream(
    spark: SparkSession,
    path: str,
    schema: StructType | str,
    name_filter: str | None = None,
    files_per_batch: int | None = None,
) -> DataFrame:
    """Parquet files of a folder as a stream."""
    reader = spark.readStream.schema(schema)
    if name_filter:
        reader = reader.option("pathGlobFilter", name_filter)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def run_kept(
    stream: DataFrame,
    name: str,
    path: str,
    checkpoint: str,
    *,
    every: str | None = None,
    partition_by: Sequence[str] = (),
) -> StreamingQuery:
    """Start a named query that appends each batch to the Parquet folder `path`, and counts its rows as `run_counted` does.

    The folder's own log names the files of finished batches, and Spark's reader goes by it: a batch that was cut short and
    repeated after a restart from `checkpoint` is there once. `stream` must allow append mode.
    """
    counted = stream.observe("batch", F.count(F.lit(1)).alias("rows"))
    writer = counted.writeStream.queryName(name).outputMode("append").format("parquet")
    writer = writer.option("path", path).option("checkpointLocation", checkpoint)
    writer = writer.partitionBy(*partition_by) if partition_by else writer
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def run_counted(
    stream: DataFrame,
    name: str,
    *,
    every: str | None = None,
    checkpoint: str | None = None,
    on_batch: Callable[[DataFrame, int], None] | None = None,
) -> StreamingQuery:
    """Start a named query that counts the rows of each batch and keeps nothing.

    The count is in the progress of each batch, as metric `rows` of observation `batch`. With `every` a batch starts at
    that interval, without it the query ends when all data is read. `on_batch` is called with each batch; it runs in the
    driver and makes Spark open its callback connection.
    """
    counted = stream.observe("batch", F.count(F.lit(1)).alias("rows"))
    checkpoint = checkpoint or scratch_path(stream.sparkSession, f"stream_{name}")
    writer = counted.writeStream.queryName(name).option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    writer = writer.foreachBatch(on_batch) if on_batch else writer.format("noop")
    return writer.start()
