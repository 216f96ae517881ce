from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from runsight.operators.group_stats import exact_percentiles, group_stats
from runsight.operators.percentile_sketches import merge_sketches, percentiles_by_sketch, sketch_values

P = (0.0, 0.5, 0.95, 1.0)


def data(spark, seed, rows=4000):
    dice = random.Random(seed)
    kinds = {
        "even": lambda: float(dice.randint(0, 10**6)),
        "steps": lambda: float(dice.choice([1, 1, 1, 1, 2, 900])),
        "one": lambda: 7.0,
        "tail": lambda: dice.paretovariate(0.5),
        None: lambda: dice.choice([None, float("nan"), -1.5, 3.0]),
    }
    names = list(kinds)
    out = [(g := dice.choice(names), kinds[g](), dice.choice([None, 5, 6])) for _ in range(rows)]
    out += [("void", None, None), ("nan", float("nan"), 1), ("nan", float("nan"), 2)]
    return spark.createDataFrame(out, "g string, v double, w int").repartition(4)


def plainly(df, keys, values, points=P):
    listed = ", ".join(map(str, points))
    return rows_of(df.groupBy(*keys).agg(*[F.expr(f"percentile({value}, array({listed})) AS {name}") for name, value in values.items()]))


def rows_of(df):
    return sorted(map(repr, map(tuple, df.collect())))


@pytest.mark.parametrize("seed, k, at_once", [(0, 800, 100), (1, 32, 20), (2, 8, 1), (3, 200, 10**6)])
def test_equal_to_the_built_in_percentile(spark, seed, k, at_once):
    df, values = data(spark, seed), {"v": "v", "w": "w * 2"}
    assert rows_of(percentiles_by_sketch(df, ["g"], values, P, k=k, at_once=at_once)) == plainly(df, ["g"], values)


def test_one_group_of_all_rows_and_none(spark):
    df, values = data(spark, 5), {"v": "v"}
    assert rows_of(percentiles_by_sketch(df, [], values, P, at_once=50)) == plainly(df, [], values)
    empty = percentiles_by_sketch(df.limit(0), ["g"], values, P)
    assert empty.collect() == [] and empty.columns == ["g", "v"]


def test_brackets_are_shuffled_to_if_they_are_many(spark):
    df, values = data(spark, 6), {"v": "v"}
    assert rows_of(percentiles_by_sketch(df, ["g"], values, P, at_once=50, broadcast_brackets=1)) == plainly(df, ["g"], values)


def test_sketches_of_parts_merge(spark):
    df, values = data(spark, 7).withColumn("day", F.col("w") % 2), {"v": "v", "w": "w"}
    daily = sketch_values(df, ["g", "day"], values, k=64)
    merged = merge_sketches(daily, ["g"], list(values), k=64)
    assert rows_of(percentiles_by_sketch(df, ["g"], values, P, sketches=merged, k=64, at_once=30)) == plainly(df, ["g"], values)


def test_sketches_of_other_rows_still_give_exact_results(spark):
    """A bracket that doesn't hold its rank is seen by the counts, and made wider."""
    df = spark.range(5000).select(F.lit("a").alias("g"), (F.col("id") * 7919 % 5000).cast("double").alias("v"))
    skewed = df.withColumn("v", F.when((F.col("v") > 10) & (F.col("v") < 4999), F.col("v") / 1000 + 10).otherwise(F.col("v")))
    sketches = sketch_values(skewed, ["g"], {"v": "v"}, k=64)
    found = percentiles_by_sketch(df, ["g"], {"v": "v"}, (0.3, 0.9), sketches=sketches, k=64, at_once=20)
    assert rows_of(found) == plainly(df, ["g"], {"v": "v"}, (0.3, 0.9))


def test_sketches_that_cannot_be_those_of_the_rows_are_an_error(spark):
    df = spark.range(5000).select(F.lit("a").alias("g"), F.col("id").cast("double").alias("v"))
    with pytest.raises(Exception, match="aren't those"):
        percentiles_by_sketch(df, ["g"], {"v": "v"}, (0.9,), sketches=sketch_values(df.withColumn("v", F.col("v") / 10), ["g"], {"v": "v"}), at_once=20).collect()


def test_large_groups_of_statistics_go_by_sketch(spark):
    df, metrics = data(spark, 8), {"v": "v", "w": "w"}
    # Averages differ by the order of their sums.
    found, expected = (group_stats(df, ["g"], metrics, distinct_of="w", **how).drop("avg_v", "avg_w") for how in ({"hot_rows": 100, "large_by": "sketch"}, {"hot_rows": 10**9}))
    assert rows_of(found) == rows_of(expected)
    with pytest.raises(ValueError, match="large_by"):
        exact_percentiles(df, ["g"], metrics, P, large_by="magic")


def test_no_values_are_sorted_by_range(spark, capsys):
    df = data(spark, 9)
    percentiles_by_sketch(df, ["g"], {"v": "v"}, P, at_once=50).explain()
    assert "rangepartitioning" not in capsys.readouterr().out
