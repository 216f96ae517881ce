"""Average, median and exact high percentile of many metrics per group."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runsight.operators.percentile_sketches import percentiles_by_sketch
from runsight.operators.percentiles import percentiles_by_range
from runsight.operators.skew import HotGroups, find_hot_groups

CELLS_PER_TASK = 4_000_000
"""Metric values of one group that one task may hold for the built-in exact percentile."""


def percentile_label(probability: float) -> str:
    return f"p{probability * 100:g}".replace(".", "_")


def _exact(values: Mapping[str, str], probabilities: Sequence[float]) -> list[Column]:
    # SQL text, here and below: building a Column takes several calls into the JVM, for each of hundreds of metrics.
    points = ", ".join(f"{p}D" for p in probabilities)
    return [F.expr(f"percentile({value}, array({points})) AS `_q_{name}`") for name, value in values.items()]


def hot_groups_for(df: DataFrame, keys: Sequence[str], metrics: int, hot_rows: int | None = None) -> HotGroups:
    """The groups whose metric values are too many for one task."""
    limit = max(1, CELLS_PER_TASK // max(1, metrics)) if hot_rows is None else hot_rows
    return find_hot_groups(df, keys, limit)


def exact_percentiles(
    df: DataFrame,
    keys: Sequence[str],
    values: Mapping[str, str],
    probabilities: Sequence[float],
    extra: Sequence[Column] = (),
    hot: HotGroups | None = None,
    large_by: str = "range",
) -> DataFrame:
    """Per group `_q_<name>` arrays of percentiles, and the `extra` aggregates.

    Groups that fit in a task take one pass. Large ones take the range-partitioned way; if there are more of those
    than the driver may list, all groups take it. With `large_by` "sketch", the listed large groups are narrowed down by
    sketches instead, without sorting their values; pass a stored table then.
    """
    if large_by not in ("range", "sketch"):
        raise ValueError("large_by must be 'range' or 'sketch'")
    keys, extra = list(keys), list(extra)
    if hot is None:
        hot = hot_groups_for(df, keys, len(values))
    if not hot:
        return df.groupBy(*keys).agg(*extra, *_exact(values, probabilities))
    large, rows = (hot.rows_of(df), hot.rows) if hot.complete else (df, df.count())
    if large_by == "sketch" and hot.complete:
        of_large = percentiles_by_sketch(large, keys, values, probabilities)
    else:
        ranges = max(df.sparkSession.sparkContext.defaultParallelism, -(-rows * len(values) // CELLS_PER_TASK))
        of_large = percentiles_by_range(large, keys, values, probabilities, ranges)
    of_large = of_large.select(*keys, *[F.col(name).alias(f"_q_{name}") for name in values])
    if extra:
        of_large = _join_by_group(large.groupBy(*keys).agg(*extra), of_large, keys)
    if not hot.complete:
        return of_large
    small = hot.other_rows_of(df).groupBy(*keys).agg(*extra, *_exact(values, probabilities))
    return small.unionByName(of_large)


def _join_by_group(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join of two tables with one row per group; NULL is a key like any other."""
    names = [f"_r_{i}" for i in range(len(keys))]
    renamed = right.select(*[F.col(key).alias(name) for key, name in zip(keys, names)], *right.columns[len(keys) :])
    same = None
    for key, name in zip(keys, names):
        test = left[key].eqNullSafe(renamed[name])
        same = test if same is None else same & test
    return left.join(renamed, same, "left").drop(*names)


def group_stats(
    df: DataFrame,
    keys: Sequence[str],
    metrics: Mapping[str, str],
    *,
    probability: float = 0.95,
    prefix: str = "",
    rows_as: str | None = "num_rows",
    distinct_of: str | None = None,
    distinct_as: str = "num_distinct",
    hot: HotGroups | None = None,
    hot_rows: int | None = None,
    large_by: str = "range",
) -> DataFrame:
    """One row per group: row count, distinct count, and `avg`, `median` and percentile of every metric.

    `metrics` maps names to SQL expressions.

    The distinct count is its own aggregation: mixed with percentiles it would keep a buffer per distinct value.
    """
    keys = list(keys)
    if hot is None:
        hot = hot_groups_for(df, keys, len(metrics), hot_rows)
    counts = [F.count(F.lit(1)).alias(rows_as)] if rows_as else []
    averages = [F.expr(f"avg({value}) AS `_a_{name}`") for name, value in metrics.items()]
    stats = exact_percentiles(df, keys, metrics, (0.5, probability), counts + averages, hot, large_by)
    if distinct_of:
        distinct = df.select(*keys, distinct_of).distinct().groupBy(*keys).agg(F.count(distinct_of).alias(distinct_as))
        stats = _join_by_group(stats, distinct, keys)
    label = percentile_label(probability)
    out = [f"`{name}`" for name in (*keys, rows_as, distinct_of and distinct_as) if name]
    for name in metrics:
        out += [
            f"`_a_{name}` AS `{prefix}avg_{name}`",
            f"`_q_{name}`[0] AS `{prefix}median_{name}`",
            f"`_q_{name}`[1] AS `{prefix}{label}_{name}`",
        ]
    return stats.selectExpr(*out)
