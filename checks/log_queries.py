"""Queries over the event log: extraction, join, outliers and reports."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.log_fixture import (
    ACCUMULABLE_KEYS,
    CLUSTER,
    DAY_MS,
    METRIC_KEYS,
    TASKS_SQL,
    event_log,
    event_log_path,
    joined_sql,
    outliers_sql,
)
from checks.tables import stored
from runsight.functions import from_epoch_ms, whole_units_between
from runsight.functions.sql import register_sql_functions
from runsight.operators import events, metrics
from runsight.operators.outliers import Thresholds, classify
from runsight.operators.windows import attach_stages
from runsight.plans import reports
from runsight.plans.report_scan import bundle_of_one_scan
from runsight.plans.task_outliers import task_outliers, task_outliers_from_logs
from runsight.sources import run_name
from runsight.sources.staging import scratch_path, stage

THRESHOLDS = Thresholds(low=1, high=2)
NAMES = reports.Names(outlier="gt_p95_2")


def outlier_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored result of the outlier analysis: the reports read it as a table."""

    def analyse() -> DataFrame:
        rows = task_outliers(
            event_log(spark, sf_dir),
            metric_keys=METRIC_KEYS,
            accumulable_keys=ACCUMULABLE_KEYS,
            thresholds=THRESHOLDS,
        )
        return stage(rows, "outliers")

    return stored(spark, sf_dir, "outliers", analyse)


def _task_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.task_events(event_log(spark, sf_dir), metric_keys=(), accumulable_keys=())


def _stage_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.stage_events(event_log(spark, sf_dir)).drop("event_time")


def _event_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = event_log(spark, sf_dir)
    half = "timestamp_millis(event_time) < timestamp'2024-01-16'"
    tasks = events.task_events(log, half, metric_keys=(), accumulable_keys=())
    stages = events.stage_events(log, half)
    return (
        tasks.groupBy(F.lit("task").alias("kind"), "stage_id")
        .agg(F.count(F.lit(1)).alias("n"))
        .unionByName(
            stages.groupBy(F.lit("stage").alias("kind"), F.col("stage__id").alias("stage_id")).agg(
                F.count(F.lit(1)).alias("n")
            )
        )
    )


def _flatten_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = (*METRIC_KEYS, "jvm_gc_time", "result_size")
    tasks = events.task_events(event_log(spark, sf_dir), metric_keys=keys, accumulable_keys=())
    return tasks.select("task_id", "task_metrics.*")


def _flatten_in_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics and accumulables of tasks by SQL text alone."""
    functions = register_sql_functions(spark, "runsight_")
    view = f"log_{uuid.uuid4().hex}"
    event_log(spark, sf_dir).createOrReplaceTempView(view)
    flatten, latest = (next(name for name in functions if name.endswith(end)) for end in ("flatten_metrics", "latest_values"))
    return spark.sql(f"""
        SELECT task_id, m.*, a.* FROM (
            SELECT CAST(get_json_object(logMessage, "$['Task Info']['Task ID']") AS BIGINT) AS task_id,
                from_json({flatten}(logMessage), 'input_metrics__records_read BIGINT, executor_cpu_time BIGINT, jvm_gc_time BIGINT, result_size BIGINT') AS m,
                from_json({latest}(logMessage, array('number of output rows', 'peak_memory_usage')), 'number_of_output_rows BIGINT, number_of_output_rows_id INT, peak_memory_usage BIGINT, peak_memory_usage_id INT') AS a
            FROM {view} WHERE get_json_object(logMessage, '$.Event') = '{events.TASK_END}')""")


def _latest_accumulable(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ("number of output rows", "peak_memory_usage", "internal_metrics_resultsize")
    tasks = events.task_events(event_log(spark, sf_dir), metric_keys=(), accumulable_keys=keys)
    return tasks.select("task_id", "task_accumulables.*")


def _discover_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.discover_keys(event_log(spark, sf_dir))


def _raw_structs(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = event_log(spark, sf_dir).withColumn(
        "task_id", F.get_json_object("logMessage", "$['Task Info']['Task ID']").cast("bigint")
    )
    with_both = metrics.with_accumulables(
        metrics.with_metrics(log, METRIC_KEYS), ACCUMULABLE_KEYS, where="task_id is not null"
    )
    return with_both.select("task_id", "task_metrics.*", "task_accumulables.*")


def _attach_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = stage(events.parse_records(event_log(spark, sf_dir), metric_keys=(), accumulable_keys=()), "records")
    joined = attach_stages(events.task_rows(parsed), events.stage_rows(parsed), grace_ms=1_800_000)
    return joined.select("task_id", "stage_id", "stage__submission_time", "stage__completion_time", "stage__num_tasks")


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({column: F.round(column, 6) for column in columns})


def _bad_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log with the lines of every 50th task cut short: what is read and what is bad."""
    log, task = event_log(spark, sf_dir), F.get_json_object("logMessage", "$['Task Info']['Task ID']").cast("bigint")
    cut = log.withColumn("logMessage", F.when(task % 50 == 0, F.left("logMessage", F.length("logMessage") - 30)).otherwise(F.col("logMessage")))
    parsed = stage(events.parse_records(cut, metric_keys=(), accumulable_keys=(), keep_bad=True), "records")
    bad = events.bad_records(parsed).groupBy("cluster_id").agg(F.count(F.lit(1)).alias("bad"))
    whole = parsed.filter("bad_record IS NULL").groupBy("cluster_id").agg(
        F.count(F.when(F.col("event") == events.TASK_END, 1)).alias("tasks"), F.count(F.when(F.col("event") == events.STAGE_COMPLETED, 1)).alias("stages")
    )
    return whole.join(bad, "cluster_id")


def _task_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = task_outliers(
        event_log(spark, sf_dir), metric_keys=METRIC_KEYS, accumulable_keys=ACCUMULABLE_KEYS, thresholds=THRESHOLDS
    )
    return _outlier_columns(rows)


def _task_outliers_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = task_outliers(
        event_log(spark, sf_dir),
        where="timestamp_millis(event_time) < timestamp'2024-01-16'",
        metric_keys=METRIC_KEYS,
        accumulable_keys=ACCUMULABLE_KEYS,
        thresholds=THRESHOLDS,
    )
    return _outlier_columns(rows)


def _outliers_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From log files to a named result table, which is read back."""
    table = task_outliers_from_logs(
        spark,
        [event_log_path(spark, sf_dir)],
        CLUSTER,
        run_name("outliers_of_run"),
        path=scratch_path(spark, "outliers_of_run"),
        metric_keys=METRIC_KEYS,
        accumulable_keys=ACCUMULABLE_KEYS,
        thresholds=THRESHOLDS,
    )
    return _outlier_columns(spark.table(table))


def _outlier_columns(rows: DataFrame) -> DataFrame:
    return _rounded(
        rows.select(
            "task_id",
            "stage__cluster_id",
            "stage_id",
            "stage__submission_time",
            "task_time",
            "stage_num_task_finish_events",
            "stage_num_tasks",
            "stage_avg_task_time",
            "stage_median_task_time",
            "stage_p95_task_time",
            "gt_p95_1",
            "gt_p95_2",
            "gt_median_10",
            "accumulables_overall_score",
            "task_metrics_overall_score",
            "overall_score",
        ),
        "stage_avg_task_time",
        "stage_median_task_time",
        "stage_p95_task_time",
    )


def _task_outliers_all_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = task_outliers(event_log(spark, sf_dir), thresholds=THRESHOLDS)
    return rows.select(
        "task_id",
        "stage_id",
        "stage__submission_time",
        "gt_p95_1",
        "gt_p95_2",
        "accumulables_overall_score",
        "task_metrics_overall_score",
        "overall_score",
    )


def _report(report, spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    return report({"run": outlier_table(spark, sf_dir)}, names=NAMES, **options)


def _multi_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = outlier_table(spark, sf_dir)
    early = F.col("stage__submission_time") < F.unix_millis(F.lit("2024-01-16").cast("timestamp"))
    return reports.all_tasks({"early": rows.filter(early), "late": rows.filter(~early)}, names=NAMES)


def _bundle(spark: SparkSession, sf_dir: str, bundle: Callable[..., dict[str, DataFrame]] = reports.bundle) -> DataFrame:
    found = bundle({"run": outlier_table(spark, sf_dir)}, level="all", names=NAMES)
    counts = [
        df.groupBy().agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("report"), "n")
        for name, df in found.items()
    ]
    total = counts[0]
    for part in counts[1:]:
        total = total.unionByName(part)
    return total


def _one_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Executors, hosts and stages by one scan: their totals side by side."""
    found = bundle_of_one_scan({"run": outlier_table(spark, sf_dir)}, level="all", names=NAMES)
    ranked = found["stages_ranked"].select(
        F.lit("stage").alias("report"), F.concat_ws(" ", F.col("stage_id").cast("string"), F.date_format("stage__submission_ts", "yyyy-MM-dd HH:mm:ss")).alias("of"),
        "total_tasks", "gt_p95_2_tasks", "gt_p95_2_unexplained_tasks", F.round("p95_task_time", 6).alias("p95_task_time"),
    )
    types = found["by_task_type"].select(F.lit("type").alias("report"), F.col("task_type").alias("of"), "total_tasks", "gt_p95_2_tasks", "gt_p95_2_unexplained_tasks", F.lit(None).cast("double").alias("p95_task_time"))
    table = found["all_tasks"].select(F.lit("table").alias("report"), F.col("tbl").alias("of"), "total_tasks", "gt_p95_2_tasks", "gt_p95_2_unexplained_tasks", F.lit(None).cast("double").alias("p95_task_time"))
    return ranked.unionByName(types).unionByName(table)


def _classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = classify(outlier_table(spark, sf_dir), outlier="gt_p95_2")
    return rows.groupBy("outlier_class").agg(F.count(F.lit(1)).alias("n"))


def _tasks_of_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reports.tasks_of_stage(
        outlier_table(spark, sf_dir), 4, ["task_metrics.input_metrics__records_read", "task_accumulables.number_of_output_rows"]
    )
    return _rounded(rows, "stage_avg_task_time", "stage_median_task_time", "stage_p95_task_time")


def _stage_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(reports.stage_timeline(outlier_table(spark, sf_dir)), "stage_avg_task_time")


def _stages_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _report(reports.stages_ranked, spark, sf_dir)
    return _rounded(
        rows.withColumn("stage__submission_ts", F.date_format("stage__submission_ts", "yyyy-MM-dd HH:mm:ss")),
        "stage_time_m",
        "p95_task_time",
        *[column for column in rows.columns if column.endswith("_pct")],
    )


def _top_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _report(reports.top_outliers, spark, sf_dir, min_stage_tasks=10, unexplained=True)
    rows = rows.withColumn("task_launch_ts", F.date_format("task_launch_ts", "yyyy-MM-dd HH:mm:ss"))
    return _rounded(rows, "stage_p95_task_time")


def _with_rounded_pcts(report, spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _report(report, spark, sf_dir)
    return _rounded(rows, *[c for c in rows.columns if c.endswith("_pct") or c.startswith("pct_")])


def _epoch_and_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    tasks = events.task_events(event_log(spark, sf_dir), metric_keys=(), accumulable_keys=())
    start, end = from_epoch_ms("task_launch_time"), from_epoch_ms("task_finish_time")
    return tasks.select(
        "task_id",
        F.date_format(start, "yyyy-MM-dd HH:mm:ss").alias("launch"),
        whole_units_between("second", start, end).alias("seconds"),
        whole_units_between("hour", start, end).alias("hours"),
    )


QUERIES = {
    "task_events": _task_events,
    "stage_events": _stage_events,
    "event_filter": _event_filter,
    "flatten_metrics": _flatten_metrics,
    "flatten_in_sql": _flatten_in_sql,
    "latest_accumulable": _latest_accumulable,
    "metric_structs_from_raw": _raw_structs,
    "discover_keys": _discover_keys,
    "epoch_and_diff": _epoch_and_diff,
    "attach_stages": _attach_stages,
    "task_outliers": _task_outliers,
    "task_outliers_filtered": _task_outliers_filtered,
    "outliers_table": _outliers_table,
    "bad_records": _bad_records,
    "task_outliers_all_keys": _task_outliers_all_keys,
    "outlier_classes": _classes,
    "report_all_tasks": partial(_with_rounded_pcts, reports.all_tasks),
    "report_by_type": partial(_with_rounded_pcts, reports.by_task_type),
    "report_affected_stages": partial(_with_rounded_pcts, reports.affected_stages),
    "report_stages_ranked": _stages_ranked,
    "report_top_executors": partial(_with_rounded_pcts, reports.top_executors),
    "report_top_hosts": partial(_with_rounded_pcts, reports.top_hosts),
    "report_top_outliers": _top_outliers,
    "report_multi_table": _multi_table,
    "report_bundle": _bundle,
    "report_bundle_one_scan": partial(_bundle, bundle=bundle_of_one_scan),
    "report_one_scan": _one_scan,
    "tasks_of_stage": _tasks_of_stage,
    "stage_timeline": _stage_timeline,
}

_HALF_MS = "epoch_ms(TIMESTAMP '2024-01-16')"
_TOTALS = """count(*) AS total_tasks, CAST(sum(gt_p95_2) AS BIGINT) AS gt_p95_2_tasks,
  CAST(sum(CASE WHEN overall_score = 0 THEN gt_p95_2 ELSE 0 END) AS BIGINT) AS gt_p95_2_unexplained_tasks,
  CAST(sum(CASE WHEN overall_score > 0 AND gt_p95_2 > 0 THEN 1 ELSE 0 END) AS BIGINT) AS explained_tasks"""
_TOTAL_PCTS = """round(gt_p95_2_tasks * 100 / total_tasks, 6) AS gt_p95_2_tasks_pct,
  round(gt_p95_2_unexplained_tasks * 100 / total_tasks, 6) AS gt_p95_2_unexplained_tasks_pct"""
_TIME = "strftime(make_timestamp({} // 1000 * 1000000), '%Y-%m-%d %H:%M:%S')"


def _places_sql(keys: str) -> str:
    return f"""WITH {outliers_sql()},
places AS (
  SELECT {keys}, count(*) AS total_tasks,
         nullif(count(*) FILTER (gt_p95_2 > 0 AND overall_score = 0), 0) AS unexplained_tasks,
         nullif(count(*) FILTER (gt_p95_2 > 0), 0) AS outlier_tasks,
         min(launch) AS first, max(launch) AS last,
         min(launch) FILTER (gt_p95_2 > 0) AS first_outlier, max(launch) FILTER (gt_p95_2 > 0) AS last_outlier
  FROM outliers GROUP BY ALL
)
SELECT 'run' AS tbl, {keys}, total_tasks, unexplained_tasks, round(unexplained_tasks * 100 / total_tasks, 6) AS unexplained_pct,
       outlier_tasks, round(outlier_tasks * 100 / total_tasks, 6) AS outlier_pct,
       {_TIME.format('first')} AS min_t_executor, {_TIME.format('last')} AS max_t_executor,
       {_TIME.format('first_outlier')} AS min_t_outlier, {_TIME.format('last_outlier')} AS max_t_outlier,
       last // 1000 - first // 1000 AS t_executor_est_duration_s,
       (last // 1000 - first // 1000) // 3600 AS "t_executor_est_duration_H"
FROM places ORDER BY outlier_tasks * 100 / total_tasks DESC NULLS LAST, {keys} LIMIT 10"""


def _classes_sql() -> str:
    parts = []
    for size, label in ((0, "all_stages"), (20, "stages with tasks>20"), (100, "stages with tasks>100")):
        parts.append(f"""SELECT 'run' AS tbl, '{label}' AS stage_class, count(*) AS total_stages,
  CAST(sum(hit) AS BIGINT) AS num_affected_stages_all_outliers,
  round(sum(hit) * 100 / count(*), 6) AS pct_affected_stages_all_outliers,
  CAST(sum(unexplained) AS BIGINT) AS num_affected_stages_unexplained_outliers,
  round(sum(unexplained) * 100 / count(*), 6) AS pct_affected_stages_unexplained_outliers
FROM per_stage WHERE total_tasks > {size}""")
    return f"""WITH {outliers_sql()},
per_stage AS (
  SELECT total_tasks, CASE WHEN gt_p95_2_tasks > 0 THEN 1 ELSE 0 END AS hit,
         CASE WHEN gt_p95_2_unexplained_tasks > 0 THEN 1 ELSE 0 END AS unexplained
  FROM (SELECT stage_id, submission, {_TOTALS} FROM outliers GROUP BY ALL)
)
""" + " UNION ALL ".join(parts)


_SCORES = """accumulables_score AS accumulables_overall_score, metrics_score AS task_metrics_overall_score, overall_score"""
_STAGE_STATS = """round(avg_time, 6) AS stage_avg_task_time, round(median_time, 6) AS stage_median_task_time,
  round(p95_time, 6) AS stage_p95_task_time"""
_OUTLIER_COLUMNS = f"""SELECT task_id, '{CLUSTER}' AS stage__cluster_id, stage_id, submission AS stage__submission_time, task_time,
  events AS stage_num_task_finish_events, num_tasks AS stage_num_tasks, {_STAGE_STATS},
  gt_p95_1, gt_p95_2, gt_median_10, {_SCORES} FROM outliers"""

_BUNDLE_SQL = f"""WITH {outliers_sql()}
SELECT * FROM (VALUES ('all_tasks', 1), ('affected_stages', 3), ('top_executors', 10), ('top_hosts', 10)) AS t(report, n)
UNION ALL SELECT 'by_task_type', count(DISTINCT task_type) FROM outliers
UNION ALL SELECT 'stages_ranked', count(*) FROM (SELECT DISTINCT stage_id, submission FROM outliers)
UNION ALL SELECT 'top_outliers', CAST(least(10, sum(gt_p95_2)) AS BIGINT) FROM outliers"""

ORACLE = {
    "task_events": f"""WITH {TASKS_SQL}
SELECT '{CLUSTER}' AS cluster_id, stage_id, launch AS event_time, 'Success' AS task_end_reason, finish AS task_finish_time,
  launch AS task_launch_time, task_time, task_id, executor_id, host, 'PROCESS_LOCAL' AS locality,
  task_id % 7 = 0 AS speculative, task_type FROM tasks""",
    "stage_events": f"""WITH {TASKS_SQL}
SELECT stage_id AS stage__id, CAST(0 AS BIGINT) AS stage__attempt_id, '{CLUSTER}' AS stage__cluster_id,
  submission AS stage__event_time, 'SparkListenerStageCompleted' AS event, num_tasks AS stage__num_tasks,
  submission AS stage__submission_time, completion AS stage__completion_time FROM stages""",
    "event_filter": f"""WITH {TASKS_SQL}
SELECT 'task' AS kind, stage_id, count(*) AS n FROM tasks WHERE launch < {_HALF_MS} GROUP BY ALL
UNION ALL SELECT 'stage', stage_id, count(*) FROM stages WHERE submission < {_HALF_MS} GROUP BY ALL""",
    "flatten_metrics": f"""WITH {TASKS_SQL}
SELECT task_id, k AS input_metrics__records_read, cpu AS executor_cpu_time, CAST(NULL AS BIGINT) AS jvm_gc_time,
  CAST(NULL AS BIGINT) AS result_size FROM tasks""",
    "flatten_in_sql": f"""WITH {TASKS_SQL}
SELECT task_id, k AS input_metrics__records_read, cpu AS executor_cpu_time, CAST(NULL AS BIGINT) AS jvm_gc_time, CAST(NULL AS BIGINT) AS result_size,
  k * 2 AS number_of_output_rows, 17 AS number_of_output_rows_id, CAST(NULL AS BIGINT) AS peak_memory_usage, 9 AS peak_memory_usage_id FROM tasks""",
    "latest_accumulable": f"""WITH {TASKS_SQL}
SELECT task_id, k * 2 AS number_of_output_rows, 17 AS number_of_output_rows_id, CAST(NULL AS BIGINT) AS peak_memory_usage,
  9 AS peak_memory_usage_id, result_size AS internal_metrics_resultsize, 20 AS internal_metrics_resultsize_id FROM tasks""",
    "metric_structs_from_raw": f"""WITH {TASKS_SQL}
SELECT task_id, k AS input_metrics__records_read, cpu AS executor_cpu_time, k * 2 AS number_of_output_rows,
  17 AS number_of_output_rows_id, result_size AS internal_metrics_resultsize, 20 AS internal_metrics_resultsize_id FROM tasks""",
    "discover_keys": """SELECT kind, name, (SELECT count(*) FROM events) AS records FROM (VALUES
  ('metric', 'executor_cpu_time'), ('metric', 'input_metrics__records_read'), ('accumulable', 'number_of_output_rows'),
  ('accumulable', 'peak_memory_usage'), ('accumulable', 'internal_metrics_resultsize')) AS t(kind, name)""",
    "epoch_and_diff": f"""WITH {TASKS_SQL}
SELECT task_id, {_TIME.format('launch')} AS launch, task_time // 1000 AS seconds, task_time // 3600000 AS hours FROM tasks""",
    "attach_stages": f"""WITH {joined_sql(1_800_000)}
SELECT task_id, j.stage_id, j.submission AS stage__submission_time, j.completion AS stage__completion_time,
  s.num_tasks AS stage__num_tasks FROM joined j JOIN stages s USING (stage_id, submission)""",
    "task_outliers": f"WITH {outliers_sql()} {_OUTLIER_COLUMNS}",
    "task_outliers_filtered": f"WITH {outliers_sql('2024-01-16')} {_OUTLIER_COLUMNS}",
    "outliers_table": f"WITH {outliers_sql()} {_OUTLIER_COLUMNS}",
    "bad_records": f"""WITH {TASKS_SQL}
SELECT '{CLUSTER}' AS cluster_id, count(*) FILTER (task_id % 50 <> 0) AS tasks, (SELECT count(*) FROM stages) AS stages,
  count(*) FILTER (task_id % 50 = 0) AS bad FROM tasks""",
    "task_outliers_all_keys": f"""WITH {outliers_sql()}
SELECT task_id, stage_id, submission AS stage__submission_time, gt_p95_1, gt_p95_2, {_SCORES} FROM outliers""",
    "outlier_classes": f"""WITH {outliers_sql()}
SELECT CASE WHEN gt_p95_2 > 0 THEN CASE WHEN overall_score > 0 THEN 'explained' ELSE 'unexplained' END END AS outlier_class,
  count(*) AS n FROM outliers GROUP BY ALL""",
    "report_all_tasks": f"""WITH {outliers_sql()}
SELECT 'run' AS tbl, *, {_TOTAL_PCTS} FROM (SELECT {_TOTALS} FROM outliers)""",
    "report_by_type": f"""WITH {outliers_sql()}
SELECT 'run' AS tbl, *, {_TOTAL_PCTS} FROM (SELECT task_type, {_TOTALS} FROM outliers GROUP BY ALL)""",
    "report_affected_stages": _classes_sql(),
    "report_stages_ranked": f"""WITH {outliers_sql()}
SELECT 'run' AS tbl, '{CLUSTER}' AS stage__cluster_id, stage_id, {_TIME.format('submission')} AS stage__submission_ts,
  * EXCLUDE (stage_id, submission, explained_tasks, first, last, p95), explained_tasks AS gt_p95_2_explained_tasks,
  first AS min_task_launch_time, last AS max_task_finish_time, round((last - first) / 60000, 6) AS stage_time_m,
  round(p95, 6) AS p95_task_time, {_TOTAL_PCTS}, round(explained_tasks * 100 / total_tasks, 6) AS gt_p95_2_explained_tasks_pct
FROM (SELECT stage_id, submission, {_TOTALS}, CAST(sum(task_time) AS BIGINT) AS total_task_time, min(launch) AS first,
        max(finish) AS last, quantile_cont(task_time, 0.95) AS p95, max(task_time) AS max_task_time
      FROM outliers GROUP BY ALL)""",
    "report_top_executors": _places_sql("executor_id, host"),
    "report_top_hosts": _places_sql("host"),
    "report_top_outliers": f"""WITH {outliers_sql()}
SELECT 'run' AS tbl, task_id, task_time AS task_time_ms, round(p95_time, 6) AS stage_p95_task_time,
  num_tasks AS stage_num_tasks, {_TIME.format('launch')} AS task_launch_ts, stage_id AS stage__id, host,
  overall_score AS explain_metrics
FROM outliers WHERE gt_p95_2 > 0 AND overall_score = 0 AND num_tasks >= 10
ORDER BY overall_score, task_time DESC, task_id LIMIT 10""",
    "report_multi_table": f"""WITH {outliers_sql()}
SELECT *, gt_p95_2_tasks * 100 / total_tasks AS gt_p95_2_tasks_pct,
  gt_p95_2_unexplained_tasks * 100 / total_tasks AS gt_p95_2_unexplained_tasks_pct
FROM (SELECT CASE WHEN submission < {_HALF_MS} THEN 'early' ELSE 'late' END AS tbl, {_TOTALS} FROM outliers GROUP BY ALL)""",
    "report_bundle": _BUNDLE_SQL,
    "report_bundle_one_scan": _BUNDLE_SQL,
    "report_one_scan": f"""WITH {outliers_sql()}
SELECT 'stage' AS report, CAST(stage_id AS VARCHAR) || ' ' || {_TIME.format('submission')} AS of, * EXCLUDE (stage_id, submission, explained_tasks)
FROM (SELECT stage_id, submission, {_TOTALS}, round(quantile_cont(task_time, 0.95), 6) AS p95_task_time FROM outliers GROUP BY ALL)
UNION ALL SELECT 'type', task_type, * EXCLUDE (task_type, explained_tasks), NULL FROM (SELECT task_type, {_TOTALS} FROM outliers GROUP BY ALL)
UNION ALL SELECT 'table', 'run', * EXCLUDE (explained_tasks), NULL FROM (SELECT {_TOTALS} FROM outliers)""",
    "tasks_of_stage": f"""WITH {outliers_sql()}
SELECT task_id, task_time AS task_duration, {_STAGE_STATS}, launch AS task_launch_time, finish AS task_finish_time,
  'Success' AS task_end_reason, k AS input_metrics__records_read, k * 2 AS number_of_output_rows
FROM outliers WHERE stage_id = 4""",
    "stage_timeline": f"""WITH {outliers_sql()}
SELECT DISTINCT stage_id, {_TIME.format('submission')} AS sst, {_TIME.format('completion')} AS sct,
  completion // 1000 - submission // 1000 AS duration, num_tasks AS stage_num_tasks,
  round(avg_time, 6) AS stage_avg_task_time FROM outliers""",
}
