from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from runsight.operators import outliers as outliers_module
from runsight.operators.outliers import (
    Thresholds,
    add_group_outliers,
    add_outliers,
    classify,
    only_outliers,
)

SCHEMA = """
    stage__cluster_id string, stage_id bigint, stage__submission_time bigint, stage__completion_time bigint,
    task_id bigint, task_time bigint, task_metrics struct<a: bigint, b: bigint>, task_accumulables struct<x: bigint>
"""


def stage_rows(stage, times, a=None, b=None, x=None):
    n = len(times)
    a, b, x = a or [1] * n, b or [1] * n, x or [1] * n
    return [("c", stage, 0, 10, stage * 1000 + i, times[i], (a[i], b[i]), (x[i],)) for i in range(n)]


@pytest.fixture(scope="module")
def tasks(spark):
    rows = []
    rows += stage_rows(1, [10] * 18 + [10_000])  # 19 rows: the large value pulls p95 up too far
    rows += stage_rows(2, [10] * 19 + [10_000])  # 20 rows: 10x is possible
    rows += stage_rows(3, [10] * 16 + [10_000])  # 17 rows: no 5x
    rows += stage_rows(4, [10] * 17 + [10_000])  # 18 rows: 5x
    rows += stage_rows(5, [10] * 29 + [10_000], a=[0] * 29 + [7])  # explained: p95 is 0 and the value is above
    rows += stage_rows(6, [10] * 29 + [10_000], b=[None] * 30, x=[None] * 29 + [5])  # NULL metrics explain nothing
    rows += stage_rows(7, [10] * 29 + [10_000], x=[1] * 29 + [1_000])
    rows.append((None, 8, 0, 10, 9000, 5, (1, 1), (1,)))
    return spark.createDataFrame(rows, SCHEMA).cache()


@pytest.fixture(scope="module")
def flagged(tasks):
    return add_outliers(tasks, ["x"], ["a", "b"]).cache()


def slowest(flagged, stage):
    return flagged.filter((F.col("stage_id") == stage) & (F.col("task_time") == 10_000)).first()


def test_flags_need_enough_rows(flagged):
    assert [slowest(flagged, s)["gt_p95_10"] for s in (1, 2)] == [0, 1]
    assert [slowest(flagged, s)["gt_p95_5"] for s in (3, 4)] == [0, 1]
    assert slowest(flagged, 3)["gt_median_10"] == 1
    assert flagged.filter("task_time = 10 AND (gt_p95_5 > 0 OR gt_median_10 > 0)").count() == 0


def test_scores(flagged):
    explained = slowest(flagged, 5)
    assert (explained["gt_p95_5_a"], explained["gt_p95_10_a"], explained["stage_p95_a"]) == (1, 1, 0.0)
    assert (explained["task_metrics_overall_score"], explained["accumulables_overall_score"], explained["overall_score"]) == (2, 0, 2)
    unexplained = slowest(flagged, 6)
    assert unexplained["overall_score"] == 0 and unexplained["stage_p95_b"] is None
    assert slowest(flagged, 7)["accumulables_overall_score"] == 2


def test_score_is_the_sum_of_flags(flagged):
    flags = [c for c in flagged.columns if c.startswith("gt_p95") and c.endswith(("_a", "_b", "_x"))]
    assert len(flags) == 6
    assert flagged.filter(sum(F.col(c) for c in flags) != F.col("overall_score")).count() == 0


def test_columns(flagged):
    assert flagged.columns[:3] == ["gt_p95_5", "gt_p95_10", "gt_median_10"]
    assert len(flagged.columns) == len(set(flagged.columns))
    for name in ("stage_avg_task_time", "stage_median_a", "stage_p95_x", "stage_num_tasks", "stage_num_task_finish_events"):
        assert name in flagged.columns


def test_rows_without_a_key_are_dropped(tasks, flagged):
    assert flagged.count() == tasks.count() - 1


def test_fan_out_shows_in_the_counts(spark):
    rows = stage_rows(1, [1, 2]) + stage_rows(1, [1, 2])
    row = add_outliers(spark.createDataFrame(rows, SCHEMA), ["x"], ["a"]).first()
    assert (row["stage_num_task_finish_events"], row["stage_num_tasks"]) == (4, 2)


@pytest.mark.parametrize("hot_rows, split_rows", [(18, 5_000_000), (1_000_000, 18), (1_000_000, 2_000_000), (18, 18), (0, 0)])
@pytest.mark.parametrize("cells", [10_000_000, 60, 0])
def test_large_groups_take_other_ways_to_the_same_rows(tasks, flagged, hot_rows, split_rows, cells):
    other = add_outliers(tasks, ["x"], ["a", "b"], hot_rows=hot_rows, split_rows=split_rows, broadcast_cells=cells)
    assert other.columns == flagged.columns

    def rows(df):
        return sorted(map(repr, df.collect()))

    assert rows(other) == rows(flagged)


def test_more_large_groups_than_can_be_listed(tasks, flagged, monkeypatch):
    find = outliers_module.find_hot_groups
    monkeypatch.setattr(outliers_module, "find_hot_groups", lambda df, keys, rows, most: find(df, keys, rows, 1))
    other = add_outliers(tasks, ["x"], ["a", "b"], split_rows=0, broadcast_cells=0)
    assert other.columns == flagged.columns
    assert sorted(map(repr, other.collect())) == sorted(map(repr, flagged.collect()))


def test_classes_and_filters(flagged):
    classed = classify(flagged)
    counts = {r["outlier_class"]: r["count"] for r in classed.groupBy("outlier_class").count().collect()}
    outliers = only_outliers(flagged).count()
    assert counts["explained"] + counts["unexplained"] == outliers == 4
    assert only_outliers(flagged, unexplained=True).count() == counts["unexplained"] == 2
    assert only_outliers(flagged, min_group_rows=21).count() == 3


def test_equal_metric_names_are_refused(spark):
    df = spark.range(1)
    with pytest.raises(ValueError, match="twice"):
        add_group_outliers(df, ["id"], "id", {"one": {"m": "id"}, "two": {"m": "id"}})


def test_own_thresholds_name_the_flags():
    assert Thresholds(low=1, high=2).flag_names("m") == ("gt_p95_1_m", "gt_p95_2_m")
    assert Thresholds(probability=0.99).outlier_flag == "gt_p99_10"
