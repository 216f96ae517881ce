"""Event-log records as typed rows: one per finished task, one per completed stage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runsight.operators.metric_keys import ACCUMULABLE_KEYS, TASK_METRIC_KEYS
from runsight.operators.metrics import accumulable_struct, flatten_ints, latest_values, metric_struct

TASK_END = "SparkListenerTaskEnd"
STAGE_COMPLETED = "SparkListenerStageCompleted"

_TASK_FIELDS = (
    "`Stage ID` bigint",
    "`Task Type` string",
    "`Task End Reason` struct<Reason: string>",
)
_TASK_INFO = (
    "`Task ID`: bigint",
    "`Launch Time`: bigint",
    "`Finish Time`: bigint",
    "`Executor ID`: string",
    "Host: string",
    "Locality: string",
    "Speculative: boolean",
)
_TASK_ITEMS = "Accumulables: array<struct<ID: bigint, Name: string, Update: string, Value: string>>"
_TASK_SECTION = "`Task Metrics` map<string, variant>"
_STAGE_FIELDS = (
    "`Stage Info` struct<`Stage ID`: bigint, `Stage Attempt ID`: bigint, `Number of Tasks`: bigint, "
    "`Submission Time`: bigint, `Completion Time`: bigint>"
)


def _mentions(record: Column, kinds: Sequence[str]) -> Column:
    """Cheap necessary test before the parse. A text with escapes may spell the name differently."""
    test = record.contains("\\u")
    for kind in kinds:
        test = test | record.contains(kind)
    return test


def parse_records(
    raw: DataFrame,
    kinds: Sequence[str] = (TASK_END, STAGE_COMPLETED),
    *,
    metric_keys: Sequence[str] = TASK_METRIC_KEYS,
    accumulable_keys: Sequence[str] = ACCUMULABLE_KEYS,
    accumulable_field: str = "Value",
    where: Column | str | None = None,
    keep_raw: bool = False,
    keep_bad: bool = False,
    record_col: str = "logMessage",
    cluster_col: str = "clusterId",
) -> DataFrame:
    """Parse each wanted record once into the columns of both kinds; those of the other kind are NULL.

    `where` drops rows before metrics and accumulables are extracted. It may use `event_time` (a task's launch, a stage's
    submission) and the plain columns of a kind. With `keep_bad` a column `bad_record` holds the text of records that
    can't be read as a whole, see `bad_records`.
    """
    tasks, stages = TASK_END in kinds, STAGE_COMPLETED in kinds
    fields = ["Event string"]
    if tasks:
        info = list(_TASK_INFO) + ([_TASK_ITEMS] if accumulable_keys else [])
        fields += [*_TASK_FIELDS, f"`Task Info` struct<{', '.join(info)}>"]
        fields += [_TASK_SECTION] if metric_keys else []
    if stages:
        fields.append(_STAGE_FIELDS)
    fields += ["_corrupt_record string"] if keep_bad else []

    record = F.col(record_col)
    # A generator, so that the filter on its output can't pull the parse below itself and run it twice.
    parsed = (
        raw.filter(_mentions(record, kinds))
        .select(record, F.col(cluster_col), F.inline(F.array(F.from_json(record, ", ".join(fields)))))
        .filter(F.coalesce(F.col("Event").isin(*kinds), F.lit(False)) | (F.col("_corrupt_record").isNotNull() if keep_bad else F.lit(False)))
    )
    columns = [F.col(cluster_col).alias("cluster_id"), F.col("Event").alias("event")]
    if tasks:
        info = F.col("`Task Info`")
        columns += [
            F.col("`Stage ID`").alias("stage_id"),
            F.col("`Task End Reason`.Reason").alias("task_end_reason"),
            info["Finish Time"].alias("task_finish_time"),
            info["Launch Time"].alias("task_launch_time"),
            (info["Finish Time"] - info["Launch Time"]).alias("task_time"),
            info["Task ID"].alias("task_id"),
            info["Executor ID"].alias("executor_id"),
            info["Host"].alias("host"),
            info["Locality"].alias("locality"),
            info["Speculative"].alias("speculative"),
            F.col("`Task Type`").alias("task_type"),
        ]
        columns += [F.col("`Task Metrics`").alias("_metrics")] if metric_keys else []
        columns += [info["Accumulables"].alias("_items")] if accumulable_keys else []
    if stages:
        info = F.col("`Stage Info`")
        columns += [
            info["Stage ID"].alias("stage__id"),
            info["Stage Attempt ID"].alias("stage__attempt_id"),
            info["Number of Tasks"].alias("stage__num_tasks"),
            info["Submission Time"].alias("stage__submission_time"),
            info["Completion Time"].alias("stage__completion_time"),
        ]
    if keep_raw:
        columns.append(record.alias(record_col))
    if keep_bad:
        columns.append(F.col("_corrupt_record").alias("bad_record"))
    rows = parsed.select(*columns)
    if where is not None:
        times = [name for name in ("task_launch_time", "stage__submission_time") if name in rows.columns]
        rows = rows.withColumn("event_time", F.coalesce(*times)).filter(where).drop("event_time")
    extracted = {}
    if tasks and metric_keys:
        extracted["task_metrics"] = F.from_json(flatten_ints(F.col("_metrics")), metric_struct(metric_keys))
    if tasks and accumulable_keys:
        text = latest_values(F.col("_items"), accumulable_keys, accumulable_field)
        extracted["task_accumulables"] = F.from_json(text, accumulable_struct(accumulable_keys))
    return rows.withColumns(extracted).drop("_metrics", "_items") if extracted else rows


def bad_records(parsed: DataFrame) -> DataFrame:
    """(cluster_id, bad_record) of the wanted records that can't be read as a whole, such as cut lines. `parsed` has them by `keep_bad`."""
    return parsed.filter(F.col("bad_record").isNotNull()).select("cluster_id", "bad_record")


def task_rows(
    parsed: DataFrame, where: Column | str | None = None, keep_raw: bool = False, record_col: str = "logMessage"
) -> DataFrame:
    """The task rows of parsed records. `where` may use any projected name, `event_time` is the launch time."""
    names = [
        "task_end_reason",
        "task_finish_time",
        "task_launch_time",
        "task_time",
        "task_id",
        "executor_id",
        "host",
        "locality",
        "speculative",
        "task_type",
    ]
    names += [name for name in ("task_metrics", "task_accumulables") if name in parsed.columns]
    names += [record_col] if keep_raw else []
    tasks = parsed.filter(F.col("event") == TASK_END).select(
        "cluster_id", "stage_id", F.col("task_launch_time").alias("event_time"), *names
    )
    return tasks if where is None else tasks.filter(where)


def stage_rows(
    parsed: DataFrame, where: Column | str | None = None, keep_raw: bool = False, record_col: str = "logMessage"
) -> DataFrame:
    """The stage rows of parsed records. `where` may use any projected name, `event_time` is the submission time."""
    columns = [
        F.col("stage__id"),
        F.col("stage__attempt_id"),
        F.col("cluster_id").alias("stage__cluster_id"),
        F.col("stage__submission_time").alias("stage__event_time"),
        F.col("stage__submission_time").alias("event_time"),
        F.col("event"),
        F.col("stage__num_tasks"),
        F.col("stage__submission_time"),
        F.col("stage__completion_time"),
    ]
    if keep_raw:
        columns.append(F.col(record_col).alias(f"stage__{record_col}"))
    stages = parsed.filter(F.col("event") == STAGE_COMPLETED).select(*columns)
    return stages if where is None else stages.filter(where)


def task_events(
    raw: DataFrame,
    where: Column | str | None = None,
    *,
    keep_raw: bool = False,
    record_col: str = "logMessage",
    **parse_options,
) -> DataFrame:
    """One row per task-end record. Pass empty key lists to leave the metric structs out."""
    parsed = parse_records(raw, (TASK_END,), keep_raw=keep_raw, record_col=record_col, **parse_options)
    return task_rows(parsed, where, keep_raw, record_col)


def stage_events(
    raw: DataFrame,
    where: Column | str | None = None,
    *,
    keep_raw: bool = False,
    record_col: str = "logMessage",
    **parse_options,
) -> DataFrame:
    """One row per stage-completed record."""
    parsed = parse_records(raw, (STAGE_COMPLETED,), keep_raw=keep_raw, record_col=record_col, **parse_options)
    return stage_rows(parsed, where, keep_raw, record_col)
