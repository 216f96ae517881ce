"""The analysis on a log that Spark itself wrote."""

from __future__ import annotations

import json
import os
import subprocess
import sys
import textwrap

import pytest

from runsight.operators import events, metrics
from runsight.operators.metric_keys import TASK_METRIC_KEYS
from runsight.plans import reports
from runsight.plans.task_outliers import task_outliers_from_events, task_outliers_from_logs
from runsight.sources import read_event_log

APP = """
    import sys
    from pyspark.sql import SparkSession
    spark = (SparkSession.builder.master("local[4]").config("spark.eventLog.enabled", "true")
             .config("spark.eventLog.dir", sys.argv[1]).config("spark.ui.enabled", "false")
             .config("spark.sql.shuffle.partitions", "4").getOrCreate())
    for _ in range(2):
        spark.range(0, 20000, 1, 8).selectExpr("id % 10 AS k").groupBy("k").count().collect()
    spark.stop()
"""


@pytest.fixture(scope="module")
def log_dir(tmp_path_factory):
    path = tmp_path_factory.mktemp("eventlog")
    subprocess.run([sys.executable, "-c", textwrap.dedent(APP), f"file:{path}"], check=True, timeout=180, env=dict(os.environ))
    return str(path)


@pytest.fixture(scope="module")
def log(spark, log_dir):
    return read_event_log(spark, [f"{log_dir}/*/events_*"], "local").cache()


def count_of(log, kind):
    return sum(json.loads(row["logMessage"])["Event"] == kind for row in log.collect())


def test_every_task_has_one_stage(spark, log_dir, log):
    table = task_outliers_from_logs(spark, [f"{log_dir}/*/events_*"], "local", "real_outliers", run_id="x")
    rows = spark.table(table)
    tasks = count_of(log, events.TASK_END)
    assert tasks > 0 and rows.count() == tasks
    assert rows.select("task_id").distinct().count() == tasks
    assert rows.filter("stage_num_tasks != stage__num_tasks").count() == 0
    # 3 + 2 flags for each of 157 metrics + 3 scores, 3 statistics for each metric and the duration + 2 counts, and
    # the columns of tasks and stages.
    assert sum(c.startswith("gt_") for c in rows.columns) == 3 + 2 * 157
    assert sum(c.startswith(("stage_avg_", "stage_median_", "stage_p95_")) for c in rows.columns) == 3 * 158
    assert reports.all_tasks([table]).first()["total_tasks"] == tasks


def test_all_default_task_metrics_are_found(log):
    found = {r["name"] for r in metrics.discover_keys(log).collect() if r["kind"] == "metric"}
    assert set(TASK_METRIC_KEYS) <= found


def test_stage_records(log):
    assert events.stage_events(log).count() == count_of(log, events.STAGE_COMPLETED)


def test_default_table_name_and_filter(spark, log):
    table = task_outliers_from_events(
        log, run_id="7", where="event_time > 0", metric_keys=["jvm_gc_time"], accumulable_keys=["number_of_output_rows"], keep_raw=True
    )
    assert table == "tasks_with_stage_info_results_7"
    assert {"logMessage", "stage__logMessage"} <= set(spark.table(table).columns)
