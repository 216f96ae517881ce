"""From raw event records to one row per task with stage statistics, outlier flags and scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession

from runsight.operators.events import parse_records, stage_rows, task_rows
from runsight.operators.metric_keys import ACCUMULABLE_KEYS, TASK_METRIC_KEYS
from runsight.operators.outliers import Thresholds, add_outliers
from runsight.operators.windows import attach_stages
from runsight.sources.readers import read_event_log
from runsight.sources.staging import stage
from runsight.sources.writers import materialize, run_name


def task_outliers(
    raw: DataFrame,
    *,
    where: Column | str | None = None,
    accumulable_keys: Sequence[str] = ACCUMULABLE_KEYS,
    metric_keys: Sequence[str] = TASK_METRIC_KEYS,
    accumulable_field: str = "Value",
    thresholds: Thresholds = Thresholds(),
    grace_ms: int = 30_000,
    slot_ms: int | None = 3_600_000,
    keep_raw: bool = False,
    record_col: str = "logMessage",
    cluster_col: str = "clusterId",
) -> DataFrame:
    """The outlier rows of raw records.

    The raw text is read and parsed once; the parsed records and the joined rows are staged, because both are read
    several times. `where` is applied before metrics are extracted and anything is staged; it filters tasks by launch time and stages by submission time if it uses `event_time`, so
    tasks of a stage that began before a cut are left out.
    """
    parsed = parse_records(
        raw,
        metric_keys=metric_keys,
        accumulable_keys=accumulable_keys,
        accumulable_field=accumulable_field,
        where=where,
        keep_raw=keep_raw,
        record_col=record_col,
        cluster_col=cluster_col,
    )
    parsed = stage(parsed, "records", partition_by=("event",))
    tasks = task_rows(parsed, where, keep_raw, record_col)
    stages = stage_rows(parsed, where, keep_raw, record_col)
    joined = stage(attach_stages(tasks, stages, grace_ms, slot_ms), "task_stages")
    return add_outliers(joined, accumulable_keys, metric_keys, thresholds=thresholds)


def task_outliers_from_events(
    raw: DataFrame, results_table: str | None = None, *, run_id: str | None = None, path: str | None = None, **options
) -> str:
    """Write the outlier rows of raw records to a table and return its name."""
    table = results_table or run_name("tasks_with_stage_info_results", run_id)
    materialize(task_outliers(raw, **options), table, path=path)
    return table


def task_outliers_from_logs(
    spark: SparkSession, paths: Sequence[str], cluster_id: str, results_table: str | None = None, **options
) -> str:
    """`task_outliers_from_events` for the log files of one cluster."""
    return task_outliers_from_events(read_event_log(spark, paths, cluster_id), results_table, **options)
