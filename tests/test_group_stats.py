from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from runsight.operators.group_stats import group_stats, percentile_label
from runsight.operators.percentiles import percentiles_by_range
from runsight.operators.skew import find_hot_groups

METRICS = {"v": "v", "w": "w * 2"}


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(1)
    data = []
    for n in range(4000):
        key = rng.choices(["hot", "warm", "rare", None], [70, 25, 1, 4])[0]
        v = rng.choice([0, 0, 0, rng.randrange(1000), None])
        data.append((key, n % 3 or None, n // 2, v, rng.random() * 100))
    data.append(("one", 1, 1, 5, None))
    data.append(("void", 1, 1, None, None))
    return spark.createDataFrame(data, "a string, b int, id int, v bigint, w double").cache()


def collected(df):
    return sorted((tuple(row) for row in df.collect()), key=repr)


def close(left, right):
    assert len(left) == len(right)
    for one, two in zip(left, right):
        for x, y in zip(one, two):
            assert x == (pytest.approx(y, rel=1e-12) if isinstance(y, float) else y)


def builtin(rows, keys):
    aggs = [F.count(F.lit(1)).alias("num_rows"), F.countDistinct("id").alias("ids")]
    for name, text in METRICS.items():
        aggs += [F.expr(f"avg({text})"), F.expr(f"percentile({text}, 0.5D)"), F.expr(f"percentile({text}, 0.95D)")]
    return rows.groupBy(*keys).agg(*aggs)


@pytest.mark.parametrize("hot_rows", [None, 100, 0])
@pytest.mark.parametrize("keys", [["a"], ["a", "b"]])
def test_same_as_builtin_for_any_split(spark, rows, keys, hot_rows):
    stats = group_stats(rows, keys, METRICS, distinct_of="id", distinct_as="ids", hot_rows=hot_rows)
    close(collected(stats), collected(builtin(rows, keys)))


def test_more_large_groups_than_listed(spark, rows):
    hot = find_hot_groups(rows, ["a"], 10, most=2)
    assert hot and not hot.complete
    stats = group_stats(rows, ["a"], METRICS, distinct_of="id", distinct_as="ids", hot=hot)
    close(collected(stats), collected(builtin(rows, ["a"])))


@pytest.mark.parametrize("partitions", [1, 3, 40])
def test_range_partitions_of_any_number(spark, rows, partitions):
    found = percentiles_by_range(rows, ["a"], {"v": "v"}, (0.0, 0.25, 1.0), partitions)
    want = rows.groupBy("a").agg(F.expr("percentile(v, array(0.0D, 0.25D, 1.0D))").alias("v")).filter("v IS NOT NULL")
    assert collected(found) == collected(want)


def test_split_by_hot_keys_keeps_every_row(spark, rows):
    hot = find_hot_groups(rows, ["a", "b"], 30)
    assert hot.rows_of(rows).count() + hot.other_rows_of(rows).count() == rows.count()
    assert hot.rows_of(rows).filter("a IS NULL").count() > 0


def test_interpolation(spark):
    row = group_stats(spark.createDataFrame([("a", x) for x in (1, 2, 3)], "k string, x bigint"), ["k"], {"x": "x"}).first()
    assert row["p95_x"] == pytest.approx(2.9)
    assert row["median_x"] == 2 and row["avg_x"] == 2


def test_labels():
    assert percentile_label(0.95) == "p95"
    assert percentile_label(0.999) == "p99_9"


def test_metrics_without_a_value_become_no_rows(spark, monkeypatch):
    from runsight.operators import percentiles

    staged, stage = [], percentiles.stage
    monkeypatch.setattr(percentiles, "stage", lambda df, name: staged.append(df) or stage(df, name))
    rows = spark.createDataFrame([("a", 1, None), ("a", 3, None), ("b", None, 7), (None, 5, 2)], "g string, x int, y bigint")
    found = percentiles.percentiles_by_range(rows, ["g"], {"x": "x", "y": "y"}, (0.5,), 2)
    assert {row["g"]: (row["x"], row["y"]) for row in found.collect()} == {"a": ([2.0], None), "b": (None, [7.0]), None: ([5.0], [2.0])}
    plan = staged[0]._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate inline" in plan and "Generate posexplode" not in plan
    assert {tuple(row) for row in staged[0].select("g", "_m", "_v", "_c").collect()} == {
        ("a", 0, 1.0, 1), ("a", 0, 3.0, 1), ("b", 1, 7.0, 1), (None, 0, 5.0, 1), (None, 1, 2.0, 1),
    }
