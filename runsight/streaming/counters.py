"""Counts of query events that outlive the session they were heard in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from runsight.streaming.streams import run_kept

EVENT_SCHEMA = "event string, id string, runId string, name string, timestamp string, batchId bigint, numInputRows bigint, observedMetrics map<string, map<string, string>>"


def _event_key() -> Column:
    """One event: a progress by query, batch and time, the others by their run."""
    one = F.when(F.col("kind") == "progress", F.concat_ws("_", F.col("batchId").cast("string"), "timestamp")).otherwise(F.col("runId"))
    return F.concat_ws("_", "kind", "id", one)


def count_events(
    spark: SparkSession,
    log_path: str,
    counted_path: str,
    checkpoint: str,
    *,
    late: str = "1 day",
    files_per_batch: int | None = None,
    every: str | None = None,
) -> StreamingQuery:
    """Start a query that reads what `ProgressLog`s write to `log_path` and appends each event once to `counted_path`.

    The same event may be written by several listeners, or again after a failure: its key stays in the state store until the
    watermark, `late` behind the newest event, has passed it. An event that comes later than that is dropped, and reported by this
    query's own progress as such. Restarted from `checkpoint`, it goes on where it stopped. Lines that can't be read are left out.
    """
    reader = spark.readStream.schema(EVENT_SCHEMA).option("mode", "DROPMALFORMED")
    reader = reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader
    lines = reader.json(log_path).filter("id IS NOT NULL")
    kind = F.coalesce("event", F.when(F.col("batchId").isNotNull(), "progress"))
    events = lines.withColumn("kind", kind).filter("kind IS NOT NULL").withColumn("event_time", F.to_timestamp("timestamp"))
    once = events.withColumn("key", _event_key()).withWatermark("event_time", late).dropDuplicatesWithinWatermark(["key"])
    counted = F.col("observedMetrics")["batch"]["rows"].cast("bigint").alias("counted_rows")
    kept = once.select("kind", "id", "runId", "name", F.col("batchId").alias("batch_id"), "event_time", F.col("numInputRows").alias("input_rows"), counted)
    return run_kept(kept, "event counts", counted_path, checkpoint, every=every)


def event_totals(spark: SparkSession, counted_path: str) -> DataFrame:
    """Per query name and kind of event: events; of progress also distinct batches, input rows and counted rows."""
    events = spark.read.parquet(counted_path)
    return events.groupBy("name", "kind").agg(
        F.count(F.lit(1)).alias("events"),
        F.countDistinct("id", "batch_id").alias("_batches"),
        F.sum("input_rows").alias("input_rows"),
        F.sum("counted_rows").alias("counted_rows"),
    ).select("name", "kind", "events", F.when(F.col("kind") == "progress", F.col("_batches")).alias("batches"), "input_rows", "counted_rows")
