from __future__ import annotations

import datetime

import pytest

from runsight.plans import reports
from runsight.plans.report_scan import bundle_of_one_scan, report_groups

SCHEMA = """
    stage__cluster_id string, stage_id bigint, stage__id bigint, stage__submission_time bigint, stage__completion_time bigint,
    task_id bigint, task_type string, executor_id string, host string, task_launch_time bigint, event_time bigint,
    task_finish_time bigint, task_time bigint, stage_num_tasks bigint, stage_avg_task_time double,
    stage_median_task_time double, stage_p95_task_time double, task_end_reason string, gt_p95_10 int, overall_score int
"""
T0 = 1_700_000_000_000


def row(n, stage=1, executor="1", host="a", outlier=0, score=0, took=100, kind="Map", size=30):
    start = T0 + n * 1000
    return ("c", stage, stage, T0, T0 + 9_000_000, n, kind, executor, host, start, start, start + took, took, size, 1.0, 1.0, 2.0, "Success", outlier, score)


@pytest.fixture(scope="module")
def tables(spark):
    busy = [row(n, stage=1 + n % 2, size=12 if n % 2 else 13) for n in range(25)]
    busy += [row(100 + n, stage=3, executor="2", host="b", size=120) for n in range(120)]
    busy += [row(300, stage=3, executor="2", host="b", outlier=1, score=0, took=5000, kind="Result", size=120)]
    busy += [row(301, stage=1, executor="1", host="a", outlier=1, score=2, took=7000, size=13)]
    busy += [row(4000, stage=1, executor="3", host="b", took=1)]
    busy += [row(5000, stage=1, executor=None, host=None, outlier=1, score=1)]
    busy += [row(301, stage=1, executor="1", host="a", outlier=1, score=2, took=7000, size=13)]  # a doubled row
    quiet = [row(n) for n in range(3)]
    return {"busy": spark.createDataFrame(busy, SCHEMA).cache(), "quiet": spark.createDataFrame(quiet, SCHEMA).cache()}


def by_table(df):
    return {r["tbl"]: r for r in df.collect()}


def test_all_tasks(tables):
    found = by_table(reports.all_tasks(tables))
    busy = found["busy"]
    assert (busy["total_tasks"], busy["gt_p95_10_tasks"], busy["gt_p95_10_unexplained_tasks"], busy["explained_tasks"]) == (150, 4, 1, 3)
    assert busy["gt_p95_10_tasks_pct"] == pytest.approx(400 / 150)
    assert found["quiet"]["gt_p95_10_tasks_pct"] == 0
    assert by_table(reports.all_tasks(tables, min_stage_tasks=100))["busy"]["total_tasks"] == 121


def test_by_type_and_empty_table(tables):
    rows = reports.by_task_type({"busy": tables["busy"]}).collect()
    assert {r["task_type"]: r["total_tasks"] for r in rows} == {"Map": 149, "Result": 1}
    empty = reports.all_tasks({"none": tables["quiet"].limit(0)}).first()
    assert empty["total_tasks"] == 0 and empty["gt_p95_10_tasks_pct"] is None


def test_affected_stages(tables):
    found = {(r["tbl"], r["stage_class"]): r for r in reports.affected_stages(tables).collect()}
    assert len(found) == 6
    every = found["busy", "all_stages"]
    assert (every["total_stages"], every["num_affected_stages_all_outliers"], every["num_affected_stages_unexplained_outliers"]) == (3, 2, 1)
    assert found["busy", "stages with tasks>20"]["total_stages"] == 1
    assert found["busy", "stages with tasks>100"]["pct_affected_stages_unexplained_outliers"] == 100
    none = found["quiet", "stages with tasks>20"]
    assert none["total_stages"] == 0 and none["num_affected_stages_all_outliers"] is None


def test_stages_ranked(tables):
    rows = [r for r in reports.stages_ranked(tables).collect() if r["tbl"] == "busy"]
    assert rows[0]["stage_id"] == 3
    assert rows[0]["stage__submission_ts"] == datetime.datetime.fromtimestamp(T0 / 1000, datetime.timezone.utc).replace(tzinfo=None)
    assert rows[0]["max_task_time"] == 5000 and rows[0]["p95_task_time"] == 100
    assert rows[0]["gt_p95_10_explained_tasks"] == 0


def test_top_executors_and_hosts(tables):
    rows = {r["executor_id"]: r for r in reports.top_executors({"busy": tables["busy"]}).collect()}
    assert rows["1"]["outlier_tasks"] == 2 and rows["1"]["unexplained_tasks"] is None
    assert rows["3"]["outlier_tasks"] is None and rows["3"]["outlier_pct"] is None
    assert rows[None]["outlier_tasks"] is None and rows[None]["total_tasks"] == 1
    assert rows["1"]["min_t_executor"] == "2023-11-14 22:13:20"
    assert rows["1"]["t_executor_est_duration_s"] == 301 and rows["1"]["t_executor_est_duration_H"] == 0
    assert [r["tbl"] for r in reports.top_executors(tables, limit=1).collect()] == ["busy", "quiet"]
    hosts = reports.top_hosts({"busy": tables["busy"]}).collect()
    assert hosts[0]["host"] == "a" and hosts[0]["outlier_pct"] == pytest.approx(200 / 27)


def test_top_outliers(tables):
    rows = reports.top_outliers({"busy": tables["busy"]}).collect()
    assert [r["task_id"] for r in sorted(rows, key=lambda r: r["explain_metrics"])] == [300, 5000, 301]  # the doubled row once
    assert [r["task_id"] for r in reports.top_outliers({"busy": tables["busy"]}, unexplained=True).collect()] == [300]
    assert [r["task_id"] for r in reports.top_outliers({"busy": tables["busy"]}, min_stage_tasks=100).collect()] == [300]
    assert reports.top_outliers({"busy": tables["busy"]}, limit=1).count() == 1


def test_tables_by_name_bundle_and_order(tables, spark):
    tables["busy"].createOrReplaceTempView("busy_tasks")
    assert reports.all_tasks(["busy_tasks"]).first()["tbl"] == "busy_tasks"
    assert reports.all_tasks("busy_tasks").count() == 1
    assert list(reports.bundle(tables)) == ["all_tasks", "by_task_type", "affected_stages"]
    assert len(reports.bundle(tables, "all")) == 7
    with pytest.raises(ValueError):
        reports.bundle(tables, "some")
    assert [r["tbl"] for r in reports.affected_stages(tables, order_by="tbl desc").collect()][0] == "quiet"


def test_stage_queries(tables):
    rows = reports.tasks_of_stage(tables["busy"], 3, ["host"]).collect()
    assert len(rows) == 121 and rows[0]["task_duration"] == 5000 and rows[0]["host"] == "b"
    timeline = reports.stage_timeline(tables["quiet"]).collect()
    assert len(timeline) == 1 and timeline[0]["duration"] == 9000 and timeline[0]["sst"] == "2023-11-14 22:13:20"


@pytest.mark.parametrize("level", ["basic", "all"])
def test_one_scan_gives_the_rows_of_the_single_reports(spark, tables, level):
    odd = [row(n, stage=n % 2 or None, kind=None if n % 3 else "Map", outlier=n % 4 == 0 and 1 or 0, score=n % 3) for n in range(40)]
    odd += [tuple(None if i in (8, 12, 18) else v for i, v in enumerate(row(77)))]
    every = {**tables, "odd": spark.createDataFrame(odd, SCHEMA), "none": tables["quiet"].limit(0)}
    found, expected = bundle_of_one_scan(every, level=level), reports.bundle(every, level=level)
    assert list(found) == list(expected)
    for name, df in expected.items():
        assert found[name].columns == df.columns
        assert sorted(map(repr, found[name].collect())) == sorted(map(repr, df.collect())), name


def test_one_scan_reads_each_table_once(spark, tables, tmp_path, capsys):
    tables["busy"].write.parquet(str(tmp_path / "t"))
    report_groups(spark.read.parquet(str(tmp_path / "t"))).explain()
    plan = capsys.readouterr().out
    assert plan.count("FileScan") == 1 and plan.count("Exchange") == 1
    with pytest.raises(ValueError, match="level"):
        bundle_of_one_scan(tables, level="some")
