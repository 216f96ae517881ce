from __future__ import annotations

import json

import pytest

from runsight.operators import events
from runsight.sources import read_event_log, read_prompts


def task(task_id, **extra):
    return json.dumps(
        {
            "Event": "SparkListenerTaskEnd",
            "Stage ID": 4,
            "Task Type": "ResultTask",
            "Task End Reason": {"Reason": "Success"},
            "Task Info": {
                "Task ID": task_id,
                "Launch Time": 1000,
                "Finish Time": 3500,
                "Executor ID": "1",
                "Host": "h",
                "Locality": "ANY",
                "Speculative": False,
            },
            "Task Metrics": {"JVM GC Time": 2},
            **extra,
        }
    )


STAGE = json.dumps(
    {
        "Event": "SparkListenerStageCompleted",
        "Stage Info": {
            "Stage ID": 4,
            "Stage Attempt ID": 1,
            "Number of Tasks": 3,
            "Submission Time": 900,
            "Completion Time": 4000,
        },
    }
)
OTHER = json.dumps({"Event": "SparkListenerJobStart", "Properties": {"note": "SparkListenerTaskEnd"}})
ESCAPED = task(9).replace('"SparkListenerTaskEnd"', '"Spark\\u004cistenerTaskEnd"')


def raw(spark, *lines):
    return spark.createDataFrame([(line, "c") for line in lines], "logMessage string, clusterId string")


def test_task_rows(spark):
    rows = events.task_events(raw(spark, task(1), STAGE, OTHER, "bad", ESCAPED)).orderBy("task_id").collect()
    assert [row["task_id"] for row in rows] == [1, 9]
    row = rows[0]
    assert (row["cluster_id"], row["stage_id"], row["event_time"], row["task_time"]) == ("c", 4, 1000, 2500)
    assert (row["task_end_reason"], row["executor_id"], row["speculative"]) == ("Success", "1", False)
    assert row["task_metrics"]["jvm_gc_time"] == 2
    assert "logMessage" not in row


def test_stage_rows_and_raw_record(spark):
    row = events.stage_events(raw(spark, task(1), STAGE), keep_raw=True).first()
    assert (row["stage__id"], row["stage__attempt_id"], row["stage__num_tasks"]) == (4, 1, 3)
    assert row["event_time"] == row["stage__event_time"] == row["stage__submission_time"] == 900
    assert row["stage__logMessage"] == STAGE
    assert events.task_events(raw(spark, task(1)), keep_raw=True).first()["logMessage"] == task(1)


def test_filter_uses_projected_names(spark):
    log = raw(spark, task(1), task(2), STAGE)
    assert events.task_events(log, "task_id > 1 AND event_time = 1000").count() == 1
    assert events.stage_events(log, "event_time > 900").count() == 0


def test_own_key_lists_are_honoured(spark):
    fields = events.task_events(raw(spark, task(1)), metric_keys=["jvm_gc_time"], accumulable_keys=["x"]).schema
    assert fields["task_metrics"].dataType.simpleString() == "struct<jvm_gc_time:bigint>"
    assert fields["task_accumulables"].dataType.simpleString() == "struct<x:bigint,x_id:int>"


def test_record_is_parsed_once(spark):
    plan = events.task_events(raw(spark, task(1)), metric_keys=(), accumulable_keys=())._jdf.queryExecution().executedPlan().toString()
    assert plan.count("from_json") == 1
    assert "Contains" in plan


def test_log_files_and_prompts(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "events_1").write_text(task(1) + "\n" + STAGE + "\n")
    (tmp_path / "a" / "events_2").write_text(task(2) + "\n")
    log = read_event_log(spark, [f"{tmp_path}/*/"], "c7")
    assert log.columns == ["logMessage", "clusterId"]
    assert {(r["task_id"], r["cluster_id"]) for r in events.task_events(log).collect()} == {(1, "c7"), (2, "c7")}
    (tmp_path / "prompts.txt").write_text("  What? \t\nWhy?\n")
    assert [r["question"] for r in read_prompts(spark, f"{tmp_path}/prompts.txt").collect()] == ["What?", "Why?"]


def test_where_applies_before_staging_and_bad_records_are_kept(spark):
    from runsight.plans.task_outliers import task_outliers
    from runsight.sources import recorded_staging, remove_staged
    from runsight.sources.staging import scratch_root

    def task(n, launch):
        return (f'{{"Event":"SparkListenerTaskEnd","Stage ID":1,"Task Info":{{"Task ID":{n},"Launch Time":{launch},"Finish Time":{launch + 5},"Accumulables":[]}},"Task Metrics":{{"Executor CPU Time":{n}}}}}', "c")

    def stage(start):
        return (f'{{"Event":"SparkListenerStageCompleted","Stage Info":{{"Stage ID":1,"Stage Attempt ID":0,"Number of Tasks":10,"Submission Time":{start},"Completion Time":{start + 100}}}}}', "c")

    lines = [task(n, 1000 * (n // 10) + n % 10) for n in range(50)] + [stage(1000 * n) for n in range(5)]
    raw = spark.createDataFrame(lines, "logMessage string, clusterId string")
    with recorded_staging() as paths:
        found = task_outliers(raw, where="event_time >= 2000", metric_keys=("executor_cpu_time",), accumulable_keys=(), grace_ms=0)
        rows = {r["task_id"] for r in found.collect()}
    assert rows == set(range(20, 50))
    assert len(paths) == 3 and all(path.startswith(scratch_root(spark)) for path in paths)
    records = spark.read.parquet(paths[0])
    assert records.count() == 33 and records.filter("task_metrics.executor_cpu_time IS NOT NULL").count() == 30
    everything = task_outliers(raw, metric_keys=("executor_cpu_time",), accumulable_keys=(), grace_ms=0)
    assert sorted(map(repr, everything.filter("task_id >= 20").collect())) == sorted(map(repr, found.collect()))
    remove_staged(spark, paths)
    with pytest.raises(Exception):
        spark.read.parquet(paths[0])

    cut = raw.union(spark.createDataFrame([(task(99, 5)[0][:-20], "c"), ("other line", "c")], raw.schema))
    parsed = events.parse_records(cut, metric_keys=(), accumulable_keys=(), keep_bad=True)
    assert [r["bad_record"] for r in events.bad_records(parsed).collect()] == [task(99, 5)[0][:-20]]
    assert parsed.filter("bad_record IS NULL").count() == 55
