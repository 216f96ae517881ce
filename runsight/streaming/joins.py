"""Tasks and stages of an event log that is still being written."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runsight.operators.events import parse_records, stage_rows, task_rows


def event_log_stream(
    spark: SparkSession,
    path: str,
    cluster_id: str,
    files_per_batch: int | None = None,
    record_col: str = "logMessage",
    cluster_col: str = "clusterId",
) -> DataFrame:
    """The lines of the log files in a folder as a stream, one JSON event each."""
    reader = spark.readStream.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else spark.readStream
    return reader.text(path).select(F.col("value").alias(record_col), F.lit(cluster_id).alias(cluster_col))


def attach_stages_stream(
    raw: DataFrame,
    *,
    grace_ms: int = 30_000,
    longest_ms: int = 7 * 86_400_000,
    late: str = "1 day",
    slot_ms: int = 3_600_000,
    metric_keys: Sequence[str] = (),
    accumulable_keys: Sequence[str] = (),
) -> DataFrame:
    """Each task with the stage it ran in, as `attach_stages` finds it, from a stream of raw records. Append mode.

    A task may come before or after its stage: both sides are held until the watermarks, `late` behind the newest finish and
    completion, say that no partner can come any more. A stage runs for at most `longest_ms`; a longer one is an error, since
    tasks that it could need are let go. Records that come later than `late` are dropped, as the query's progress reports. The
    key holds the time slot of a task's launch besides cluster and stage id, so a stage id in constant use is many keys;
    a task that ends before its launch, by a wrong clock, meets only the stages of its launch's slot.
    """
    options = {"metric_keys": metric_keys, "accumulable_keys": accumulable_keys}
    tasks = task_rows(parse_records(raw, **options))
    stages = stage_rows(parse_records(raw, metric_keys=(), accumulable_keys=())).drop("event_time")
    tasks = tasks.withColumn("_finished", F.timestamp_millis("task_finish_time")).withColumn("_slot", F.floor(F.col("task_launch_time") / F.lit(slot_ms)))
    lasted = F.col("stage__completion_time") - F.col("stage__submission_time")
    too_long = F.raise_error(F.concat(F.lit("a stage runs longer than the longest: "), F.col("stage__id").cast("string")))
    completed = F.when(lasted > longest_ms, too_long.cast("timestamp")).otherwise(F.timestamp_millis("stage__completion_time"))
    last = F.floor((F.col("stage__completion_time") + grace_ms) / F.lit(slot_ms))
    first = F.floor(F.col("stage__submission_time") / F.lit(slot_ms))
    # The same test again, since slots may be listed before the column above is computed.
    slots = F.when((lasted <= longest_ms) & (first <= last), F.sequence(first, last))
    stages = stages.withColumn("_completed", completed).withColumn("_of_slot", F.explode(slots))
    # Its finish is no earlier than its launch, nor this than the stage's submission.
    in_time = (F.col("_finished") <= F.col("_completed") + F.make_interval(secs=F.lit(grace_ms / 1000))) & (
        F.col("_finished") >= F.col("_completed") - F.make_interval(secs=F.lit(longest_ms / 1000))
    )
    inside = (F.col("task_launch_time") >= F.col("stage__submission_time")) & (F.col("task_finish_time") <= F.col("stage__completion_time") + grace_ms)
    same = (F.col("cluster_id") == F.col("stage__cluster_id")) & (F.col("stage_id") == F.col("stage__id")) & (F.col("_slot") == F.col("_of_slot"))
    joined = tasks.withWatermark("_finished", late).join(stages.withWatermark("_completed", late), same & inside & in_time)
    return joined.drop("_finished", "_slot", "_completed", "_of_slot")
