"""Rows far above the high percentile of their group, and whether another metric explains them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runsight.functions import canonical_text, total_of
from runsight.operators.group_stats import group_stats, hot_groups_for, percentile_label
from runsight.operators.metric_keys import ACCUMULABLE_KEYS, TASK_METRIC_KEYS
from runsight.operators.skew import MOST_HOT_GROUPS, HotGroups, find_hot_groups, join_salted
from runsight.sources.staging import stage

STAGE_KEYS = ("stage__cluster_id", "stage_id", "stage__submission_time", "stage__completion_time")

BROADCAST_CELLS = 10_000_000
"""Most statistics values sent to every executor, by default (80 MB as doubles)."""

SPLIT_ROWS = 5_000_000
"""If statistics are too many to broadcast, groups with more rows than this get theirs by broadcast all the same."""


@dataclass(frozen=True)
class Thresholds:
    probability: float = 0.95
    low: float = 5
    high: float = 10
    median: float = 10

    def flag_names(self, name: str = "") -> tuple[str, str]:
        label, suffix = percentile_label(self.probability), f"_{name}" if name else ""
        return f"gt_{label}_{self.low:g}{suffix}", f"gt_{label}_{self.high:g}{suffix}"

    @property
    def median_flag(self) -> str:
        return f"gt_median_{self.median:g}"

    @property
    def outlier_flag(self) -> str:
        return self.flag_names()[1]


def flag(value: str, limit: str, times: float, name: str) -> str:
    """SQL text: 1 where `value` exceeds `limit` x `times`, else 0; NULLs give 0."""
    return f"CASE WHEN {value} > {limit} * {times} THEN 1 ELSE 0 END AS `{name}`"


def score(flags: Sequence[str], name: str) -> str:
    """SQL text: sum of flag columns. A metric beyond both multiples counts 2."""
    return f"{total_of(flags)} AS `{name}`"


def _join_stats(
    df: DataFrame, stats: DataFrame, keys: Sequence[str], counted: HotGroups, split_rows: int, broadcast_cells: int
) -> DataFrame:
    """Rows with the statistics of their group, which are a stored table.

    Statistics go to the rows as long as they are few: the rows, which are wide, stay where they are. If there are too
    many, only those of large groups do, and the other rows are shuffled by group. If the large groups are too many to
    list, each group's rows are cut into parts.
    """
    keys = list(keys)
    most = max(1, broadcast_cells // len(stats.columns))
    if stats.count() <= most:
        return df.join(F.broadcast(stats), keys)
    none_larger = not counted and counted.rows_over <= split_rows
    hot = counted if none_larger else find_hot_groups(df, keys, split_rows, min(MOST_HOT_GROUPS, most))
    # Stored rows are far wider than their compressed files suggest, so the file size must not decide on a broadcast.
    if not hot:
        return df.join(stats.hint("merge"), keys)
    if not hot.complete:
        renamed = stats.withColumnsRenamed({key: f"_of_{key}" for key in keys})
        same = None
        for key in keys:
            test = F.col(f"`{key}`") == F.col(f"`_of_{key}`")
            same = test if same is None else same & test
        joined = join_salted(df, renamed, same, hint="merge").drop(*[f"_of_{key}" for key in keys])
        return joined.select(*keys, *[c for c in joined.columns if c not in keys])
    large = hot.rows_of(df).join(F.broadcast(hot.rows_of(stats)), keys)
    return large.unionByName(hot.other_rows_of(df).join(hot.other_rows_of(stats).hint("merge"), keys))


def add_group_outliers(
    df: DataFrame,
    keys: Sequence[str],
    duration: str,
    metric_sets: Mapping[str, Mapping[str, str]],
    *,
    thresholds: Thresholds = Thresholds(),
    prefix: str = "group_",
    rows_as: str = "group_num_rows",
    distinct_of: str | None = None,
    distinct_as: str = "group_num_distinct",
    hot_rows: int | None = None,
    split_rows: int = SPLIT_ROWS,
    broadcast_cells: int = BROADCAST_CELLS,
) -> DataFrame:
    """Add group statistics, flags and scores to each row.

    `metric_sets` maps a score's name to the metrics it sums up (names to SQL expressions); `overall_score` is the sum
    of all scores. Up to `broadcast_cells` statistics values are broadcast; beyond, groups with more than `split_rows` rows are
    kept from filling a task. Rows with a NULL key have no group and are dropped. Reads `df` several times: pass a stored table, not an expensive plan.
    """
    names = [name for metrics in metric_sets.values() for name in metrics] + [duration]
    repeated = {name for name in names if names.count(name) > 1}
    if repeated:
        raise ValueError(f"metric names used twice: {sorted(repeated)}")
    columns = {name: value for metrics in metric_sets.values() for name, value in metrics.items()}
    hot = hot_groups_for(df, keys, len(names), hot_rows)
    stats = group_stats(
        df,
        keys,
        {duration: f"`{duration}`", **columns},
        probability=thresholds.probability,
        prefix=prefix,
        rows_as=rows_as,
        distinct_of=distinct_of,
        distinct_as=distinct_as,
        hot=hot,
    )
    stats = stage(stats, "group_stats")
    joined = _join_stats(df, stats, keys, hot, split_rows, broadcast_cells)

    label = percentile_label(thresholds.probability)

    def limit(name: str) -> str:
        return f"`{prefix}{label}_{name}`"

    low, high = thresholds.flag_names()
    value = f"`{duration}`"
    out = [
        flag(value, limit(duration), thresholds.low, low),
        flag(value, limit(duration), thresholds.high, high),
        flag(value, f"`{prefix}median_{duration}`", thresholds.median, thresholds.median_flag),
    ]
    scores: dict[str, list[str]] = {}
    for score_name, metrics in metric_sets.items():
        scores[score_name] = []
        for name in metrics:
            metric_low, metric_high = thresholds.flag_names(name)
            out.append(flag(columns[name], limit(name), thresholds.low, metric_low))
            out.append(flag(columns[name], limit(name), thresholds.high, metric_high))
            scores[score_name] += [metric_low, metric_high]
    rest = [f"`{name}`" for name in (*stats.columns, *(name for name in df.columns if name not in keys))]
    flag_cols = [f"`{name}`" for flags in scores.values() for name in flags]
    return joined.selectExpr(*out, *rest).selectExpr(
        f"`{low}`",
        f"`{high}`",
        f"`{thresholds.median_flag}`",
        *flag_cols,
        *[score(flags, name) for name, flags in scores.items()],
        score([name for flags in scores.values() for name in flags], "overall_score"),
        *rest,
    )


def add_outliers(
    task_stages: DataFrame,
    accumulable_keys: Sequence[str] = ACCUMULABLE_KEYS,
    metric_keys: Sequence[str] = TASK_METRIC_KEYS,
    *,
    thresholds: Thresholds = Thresholds(),
    hot_rows: int | None = None,
    split_rows: int = SPLIT_ROWS,
    broadcast_cells: int = BROADCAST_CELLS,
) -> DataFrame:
    """Stage statistics, flags and scores for tasks joined to their stages."""
    accumulables = {name: f"task_accumulables.{name}" for name in map(canonical_text, accumulable_keys)}
    metrics = {name: f"task_metrics.{name}" for name in map(canonical_text, metric_keys)}
    return add_group_outliers(
        task_stages,
        STAGE_KEYS,
        "task_time",
        {"accumulables_overall_score": accumulables, "task_metrics_overall_score": metrics},
        thresholds=thresholds,
        prefix="stage_",
        rows_as="stage_num_task_finish_events",
        distinct_of="task_id",
        distinct_as="stage_num_tasks",
        hot_rows=hot_rows,
        split_rows=split_rows,
        broadcast_cells=broadcast_cells,
    )


def outlier_class(outlier: str = "gt_p95_10", total: str = "overall_score") -> Column:
    """`explained` or `unexplained` for an outlier, else NULL."""
    return F.when(F.col(outlier) > 0, F.when(F.col(total) > 0, "explained").otherwise("unexplained"))


def classify(df: DataFrame, outlier: str = "gt_p95_10", total: str = "overall_score", out: str = "outlier_class") -> DataFrame:
    return df.withColumn(out, outlier_class(outlier, total))


def only_outliers(
    df: DataFrame,
    *,
    unexplained: bool = False,
    min_group_rows: int | None = None,
    outlier: str = "gt_p95_10",
    total: str = "overall_score",
    group_rows: str = "stage_num_tasks",
) -> DataFrame:
    test = F.col(outlier) > 0
    if unexplained:
        test = test & (F.col(total) == 0)
    if min_group_rows:
        test = test & (F.col(group_rows) >= min_group_rows)
    return df.filter(test)


__all__ = [
    "HotGroups",
    "STAGE_KEYS",
    "Thresholds",
    "add_group_outliers",
    "add_outliers",
    "classify",
    "flag",
    "only_outliers",
    "outlier_class",
    "score",
]
