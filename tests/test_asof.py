from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from runsight.operators.asof import attach_last_window
from runsight.operators.windows import attach_window

BOUNDS = {"on": {"k": "wk"}, "start": "s", "end": "e", "window_start": "ws", "window_end": "we"}
FACTS, WINDOWS = "k string, s long, e long, i int", "wk string, ws long, we long, n int"


def tables(spark, seed):
    dice, windows = random.Random(seed), []
    for key in ("a", "b", "c", None):
        t = 0
        for n in range(60 if key == "a" else 5):
            t += dice.randint(1, 6)
            e = t + dice.randint(-1, 5)
            windows.append((key, t, e, n))
            t = max(t, e) + 2
    facts = [(dice.choice(["a", "a", "a", "b", "c", "d", None]), s := dice.randint(-3, 400), s + dice.choice([0, 1, 2, 5, -4]), i) for i in range(800)]
    facts += [("a", None, 3, 1), ("a", 3, None, 2), *facts[:50]]
    return spark.createDataFrame(facts, FACTS), spark.createDataFrame(windows, WINDOWS)


def rows(df):
    return sorted(map(repr, map(tuple, df.collect())))


@pytest.mark.parametrize("seed, ranges, grace", [(0, 1, 0), (1, 7, 1), (2, 60, 1), (3, None, 0)])
def test_equal_to_the_interval_join(spark, seed, ranges, grace):
    facts, windows = tables(spark, seed)
    found = attach_last_window(facts, windows, grace=grace, ranges=ranges, **BOUNDS)
    expected = attach_window(facts, windows, grace=grace, **BOUNDS)
    assert found.columns == expected.columns and rows(found) == rows(expected) and found.count() > 100


def test_a_window_reaches_over_many_ranges(spark):
    facts = spark.range(1000).select(F.lit("a").alias("k"), F.col("id").alias("s"), F.col("id").alias("e"), F.col("id").cast("int").alias("i"))
    windows = spark.createDataFrame([("a", -5, 2000, 1), ("b", 0, 9, 2)], WINDOWS)
    assert attach_last_window(facts, windows, ranges=20, **BOUNDS).filter("n = 1").count() == 1000


def test_keys_of_several_columns_dropped_columns_and_odd_names(spark):
    facts = spark.createDataFrame([(1, "x", 5, 6), (1, "y", 5, 6), (2, "x", 5, 6)], "a int, `b.c` string, s long, _at long")
    windows = spark.createDataFrame([(1, "x", 0, 9, 7), (2, "x", 6, 9, 7)], "wa int, wb string, ws long, we long, _at int")
    on = {"a": "wa", "`b.c`": "wb"}
    found = attach_last_window(facts, windows.drop("_at"), on={"a": "wa"}, start="s", end="_at", window_start="ws", window_end="we")
    assert [(r["a"], r["wb"]) for r in found.collect()] == [(1, "x"), (1, "x")] and on
    with pytest.raises(ValueError, match="both sides"):
        attach_last_window(facts, windows, on={"a": "wa"}, start="s", end="_at", window_start="ws", window_end="we")
    kept = attach_last_window(facts, windows, on={"a": "wa"}, start="s", end="s", window_start="ws", window_end="we", drop=["_at"])
    assert kept.count() == 2 and kept.columns == ["a", "b.c", "s", "_at", "wa", "wb", "ws", "we"]


@pytest.mark.parametrize("second", [(5, 20), (10, 20), (0, 3), (10, 10)])
@pytest.mark.parametrize("ranges", [1, 8])
def test_windows_that_overlap_or_touch_are_an_error(spark, second, ranges):
    facts = spark.createDataFrame([("a", i, i, i) for i in range(-20, 40)], FACTS)
    windows = spark.createDataFrame([("a", 0, 10, 1), ("a", *second, 2), ("b", 5, 20, 3)], WINDOWS)
    with pytest.raises(ValueError, match="overlap"):
        attach_last_window(facts, windows, ranges=ranges, **BOUNDS)


def test_empty_tables(spark):
    facts, windows = tables(spark, 4)
    assert attach_last_window(facts.limit(0), windows, **BOUNDS).collect() == []
    assert attach_last_window(facts, windows.limit(0), **BOUNDS).collect() == []
