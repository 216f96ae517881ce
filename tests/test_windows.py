from __future__ import annotations

import random

import pytest

from runsight.operators import windows as windows_module
from runsight.operators.windows import attach_stages, attach_window

TASK = "cluster_id string, stage_id bigint, task_id bigint, event_time bigint, task_launch_time bigint, task_finish_time bigint"
STAGE = "stage__cluster_id string, stage__id bigint, event_time bigint, stage__submission_time bigint, stage__completion_time bigint"


def attached(spark, tasks, stages, **options):
    tasks = spark.createDataFrame([(c, s, t, a, a, b) for c, s, t, a, b in tasks], TASK)
    stages = spark.createDataFrame([(c, s, a, a, b) for c, s, a, b in stages], STAGE)
    rows = attach_stages(tasks, stages, **options).select("task_id", "stage__submission_time").collect()
    return sorted((row[0], row[1]) for row in rows)


@pytest.mark.parametrize("slot", [None, 1000, 3_600_000])
def test_grace_edges(spark, slot):
    tasks = [("c", 1, 1, 100, 30_500), ("c", 1, 2, 100, 30_501), ("c", 1, 3, 99, 200), ("c", 1, 4, 100, 100)]
    assert attached(spark, tasks, [("c", 1, 100, 500)], slot_ms=slot) == [(1, 100), (4, 100)]


@pytest.mark.parametrize("slot", [None, 1000])
def test_reused_ids_other_clusters_and_retries(spark, slot):
    stages = [("c", 1, 0, 1000), ("c", 1, 100_000, 101_000), ("d", 1, 0, 1000), ("c", 1, 2000, 3000)]
    tasks = [("c", 1, 1, 10, 20), ("c", 1, 2, 100_010, 100_020), ("c", 1, 3, 2100, 2200), ("d", 2, 4, 10, 20), (None, 1, 5, 1, 2)]
    # Task 3 finishes within the grace of the first run too, and stays in both.
    assert attached(spark, tasks, stages, slot_ms=slot) == [(1, 0), (2, 100_000), (3, 0), (3, 2000)]


def brute_force(tasks, stages, grace):
    return sorted(
        (t, a)
        for c, s, t, launch, finish in tasks
        for d, i, a, b in stages
        if c == d and s == i and launch >= a and finish <= b + grace
    )


def test_slots_change_nothing(spark):
    rng = random.Random(3)
    tasks = [
        (rng.choice("cd"), rng.randrange(2), n, start := rng.randrange(-5000, 5000), start + rng.randrange(-200, 900))
        for n in range(300)
    ]
    stages = [
        (rng.choice("cd"), rng.randrange(2), start := rng.randrange(-5000, 5000), start + rng.randrange(-300, 2000))
        for _ in range(60)
    ]
    want = brute_force(tasks, stages, 150)
    assert want
    for slot in (None, 70, 1000):
        for split_rows in (None, 10):
            assert attached(spark, tasks, stages, grace_ms=150, slot_ms=slot, split_rows=split_rows) == want


@pytest.mark.parametrize("most", [0, 1, 30])
def test_many_windows(spark, most):
    """All windows are too many to broadcast; those of the large keys are too many, or few enough."""
    stages = [("c", 1, 0, 1000), ("c", 2, 0, 1000), *(("d", n, 0, 10_000) for n in range(20))]
    tasks = [("c", 1, n, 10, 20) for n in range(50)] + [("c", 2, 90, 30, 40), ("d", 3, 91, 5000, 5000)]
    want = brute_force(tasks, stages, 30_000)
    for slot in (None, 500):
        assert attached(spark, tasks, stages, slot_ms=slot, split_rows=10, broadcast_windows=most) == want


@pytest.mark.parametrize("most", [0, 100])
def test_more_large_keys_than_can_be_listed(spark, monkeypatch, most):
    find = windows_module.find_hot_groups
    monkeypatch.setattr(windows_module, "find_hot_groups", lambda df, keys, rows: find(df, keys, rows, most=1))
    stages = [("c", n, 0, 1000) for n in range(4)]
    tasks = [("c", n, 100 * n + k, 10, 20) for n in range(4) for k in range(30)]
    want = brute_force(tasks, stages, 30_000)
    for slot in (None, 500):
        assert attached(spark, tasks, stages, slot_ms=slot, split_rows=10, broadcast_windows=most) == want


@pytest.mark.parametrize("split_rows", [None, 10])
def test_long_windows_are_not_listed(spark, split_rows):
    stages = [("c", 1, 0, 10**12), ("c", 1, 900, 2000), ("c", 2, 0, 1000), ("d", 1, 5, 10**15)]
    tasks = [("c", n % 3, n, 100 * n, 100 * n + 50) for n in range(60)] + [("d", 1, 99, 10**14, 10**14 + 1)]
    assert attached(spark, tasks, stages, slot_ms=100, split_rows=split_rows, most_slots=20) == brute_force(tasks, stages, 30_000)
    plan_rows = windows_module._with_slots
    listed = []

    def seen(facts, windows, *args):
        out = plan_rows(facts, windows, *args)
        listed.append(out[1].count())
        return out

    windows_module._with_slots = seen
    try:
        attached(spark, tasks, stages, slot_ms=100, split_rows=split_rows, grace_ms=0, most_slots=20)
    finally:
        windows_module._with_slots = plan_rows
    assert listed and listed[0] <= 2 * 22


def test_listed_windows_are_not_broadcast_by_estimate(spark):
    tasks = spark.createDataFrame([("c", 1, 1, 1, 1, 2)], TASK)
    stages = spark.createDataFrame([("c", 1, 0, 0, 10)], STAGE)
    plan = attach_stages(tasks, stages, split_rows=None)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_equal_column_names_are_refused(spark):
    df = spark.range(1)
    with pytest.raises(ValueError, match="both sides"):
        attach_window(df, df, on={"id": "id"}, start="id", end="id", window_start="id", window_end="id")
