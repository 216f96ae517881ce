"""Reports over outlier tables: totals, stages, executors, hosts and single tasks.

Each report takes its tables as names, or as a mapping from the name shown in `tbl` to a DataFrame. One pass and one
aggregation per table, wherever a report needs several counts.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runsight.functions import format_epoch_ms, from_epoch_ms, pct
from runsight.operators.group_stats import exact_percentiles
from runsight.operators.outliers import only_outliers

Tables = Mapping[str, DataFrame] | Sequence[str]
Order = str | Sequence[str | Column]


@dataclass(frozen=True)
class Names:
    """Column names of the outlier table."""

    outlier: str = "gt_p95_10"
    score: str = "overall_score"
    group: tuple[str, ...] = ("stage__cluster_id", "stage_id", "stage__submission_time")
    group_id: str = "stage__id"
    group_start: str = "stage__submission_time"
    group_rows: str = "stage_num_tasks"
    group_limit: str = "stage_p95_task_time"
    row_id: str = "task_id"
    row_type: str = "task_type"
    duration: str = "task_time"
    start: str = "task_launch_time"
    end: str = "task_finish_time"
    event_time: str = "event_time"
    executor: str = "executor_id"
    host: str = "host"


DEFAULT = Names()


def _order(order_by: Order) -> list[Column]:
    if not isinstance(order_by, str):
        return [F.col(item) if isinstance(item, str) else item for item in order_by]
    columns = []
    for item in order_by.split(","):
        name, _, direction = item.strip().partition(" ")
        if direction.strip().lower() not in ("", "asc", "desc"):
            raise ValueError(f"can't order by {item.strip()!r}")
        columns.append(F.col(name).desc() if direction.strip().lower() == "desc" else F.col(name).asc())
    return columns


def over_tables(tables: Tables, report: Callable[[DataFrame], DataFrame], order_by: Order = "tbl") -> DataFrame:
    """`report` of each table under its name, equal rows once, ordered."""
    if isinstance(tables, str):
        tables = [tables]
    if not isinstance(tables, Mapping):
        spark = SparkSession.getActiveSession()
        tables = {name: spark.table(name) for name in tables}
    return over_named_tables(tables, lambda name, df: report(df), order_by)


def over_named_tables(tables: Mapping[str, DataFrame], report: Callable[[str, DataFrame], DataFrame], order_by: Order = "tbl") -> DataFrame:
    """`over_tables` for a report that asks for the table's name."""
    parts = [report(name, df).select(F.lit(name).alias("tbl"), "*") for name, df in tables.items()]
    return reduce(DataFrame.unionByName, parts).distinct().orderBy(*_order(order_by))


def outlier_totals(names: Names = DEFAULT, explained_as: str = "explained_tasks") -> list[Column]:
    """Rows, outliers, unexplained and explained outliers, as aggregates."""
    flagged, scored = F.col(names.outlier), F.col(names.score)
    return [
        F.count(F.lit(1)).alias("total_tasks"),
        F.sum(flagged).cast("bigint").alias(f"{names.outlier}_tasks"),
        F.sum(F.when(scored == 0, flagged).otherwise(0)).cast("bigint").alias(f"{names.outlier}_unexplained_tasks"),
        F.sum(F.when((scored > 0) & (flagged > 0), 1).otherwise(0)).cast("bigint").alias(explained_as),
    ]


def total_pcts(names: Names) -> list[Column]:
    return [
        pct(column, "total_tasks").alias(f"{column}_pct")
        for column in (f"{names.outlier}_tasks", f"{names.outlier}_unexplained_tasks")
    ]


def _large_enough(df: DataFrame, min_stage_tasks: int | None, names: Names) -> DataFrame:
    return df.filter(F.col(names.group_rows) >= min_stage_tasks) if min_stage_tasks else df


def all_tasks(tables: Tables, min_stage_tasks: int | None = None, names: Names = DEFAULT) -> DataFrame:
    """Totals per table."""

    def report(df: DataFrame) -> DataFrame:
        totals = _large_enough(df, min_stage_tasks, names).agg(*outlier_totals(names))
        return totals.select("*", *total_pcts(names))

    return over_tables(tables, report)


def by_task_type(tables: Tables, min_stage_tasks: int | None = None, names: Names = DEFAULT) -> DataFrame:
    """Totals per table and task type."""

    def report(df: DataFrame) -> DataFrame:
        rows = _large_enough(df, min_stage_tasks, names)
        totals = rows.groupBy(F.col(names.row_type).alias("task_type")).agg(*outlier_totals(names))
        return totals.select("*", *total_pcts(names))

    return over_tables(tables, report)


def affected_stages(
    tables: Tables, size_classes: Sequence[int] = (0, 20, 100), order_by: Order = "tbl", names: Names = DEFAULT
) -> DataFrame:
    """Stages with outliers and with unexplained outliers, for all stages and for those above each size."""
    return over_tables(tables, lambda df: classes_of_stages(df.groupBy(*names.group).agg(*outlier_totals(names)), size_classes, names), order_by)


def classes_of_stages(stages: DataFrame, size_classes: Sequence[int] = (0, 20, 100), names: Names = DEFAULT) -> DataFrame:
    """`affected_stages` from the totals of each stage."""
    measures = ("total_stages", "num_affected_stages_all_outliers", "num_affected_stages_unexplained_outliers")
    hit = F.when(F.col(f"{names.outlier}_tasks") > 0, 1).otherwise(0)
    unexplained = F.when(F.col(f"{names.outlier}_unexplained_tasks") > 0, 1).otherwise(0)
    totals, classes = [], []
    for i, size in enumerate(size_classes):
        large = F.col("total_tasks") > size
        totals += [
            F.count(F.when(large, 1)).alias(f"{measures[0]}_{i}"),
            F.sum(F.when(large, hit)).alias(f"{measures[1]}_{i}"),
            F.sum(F.when(large, unexplained)).alias(f"{measures[2]}_{i}"),
        ]
        label = f"stages with tasks>{size}" if size else "all_stages"
        fields = [F.col(f"{measure}_{i}").alias(measure) for measure in measures]
        classes.append(F.struct(F.lit(label).alias("stage_class"), *fields))
    rows = stages.agg(*totals).select(F.inline(F.array(*classes)))
    return rows.select(
        "stage_class",
        measures[0],
        measures[1],
        pct(measures[1], measures[0]).alias("pct_affected_stages_all_outliers"),
        measures[2],
        pct(measures[2], measures[0]).alias("pct_affected_stages_unexplained_outliers"),
    )


def stage_times(names: Names = DEFAULT) -> list[Column]:
    """Sums and bounds of the times of a stage's tasks, as aggregates."""
    return [
        F.sum(names.duration).alias("total_task_time"),
        F.min(names.start).alias("min_task_launch_time"),
        F.max(names.end).alias("max_task_finish_time"),
        F.max(names.duration).alias("max_task_time"),
    ]


def stages_ranked(
    tables: Tables, order_by: Order | None = None, probability: float = 0.95, names: Names = DEFAULT
) -> DataFrame:
    """One row per stage with its totals and times, most unexplained outliers first."""
    explained = f"{names.outlier}_explained_tasks"
    order_by = order_by or [F.col("tbl"), F.col(f"{names.outlier}_unexplained_tasks").desc()]

    def report(df: DataFrame) -> DataFrame:
        extra = [*outlier_totals(names, explained), *stage_times(names)]
        return ranks_of_stages(
            exact_percentiles(df, names.group, {names.duration: f"`{names.duration}`"}, (float(probability),), extra), names
        )

    return over_tables(tables, report, order_by)


def ranks_of_stages(stages: DataFrame, names: Names = DEFAULT) -> DataFrame:
    """The columns of `stages_ranked` from the totals, times and percentile of each stage."""
    explained = f"{names.outlier}_explained_tasks"
    keys = [name for name in names.group if name != names.group_start]
    span = (F.col("max_task_finish_time") - F.col("min_task_launch_time")) / F.lit(60_000)
    return stages.select(
        *keys,
        from_epoch_ms(names.group_start).alias("stage__submission_ts"),
        "total_tasks",
        f"{names.outlier}_tasks",
        f"{names.outlier}_unexplained_tasks",
        explained,
        "total_task_time",
        "min_task_launch_time",
        "max_task_finish_time",
        span.alias("stage_time_m"),
        F.col(f"_q_{names.duration}")[0].alias("p95_task_time"),
        "max_task_time",
        *total_pcts(names),
        pct(explained, "total_tasks").alias(f"{explained}_pct"),
    )


def _top_places(tables: Tables, keys: Sequence[str], order_by: Order, limit: int, names: Names) -> DataFrame:
    def report(df: DataFrame) -> DataFrame:
        places = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("total_tasks"), *place_measures(names))
        return rows_of_places(places, keys, limit)

    return over_tables(tables, report, order_by)


def place_measures(names: Names = DEFAULT) -> list[Column]:
    """Counts and times of outliers of an executor or host, as aggregates."""
    flagged = F.col(names.outlier) > 0
    unexplained = flagged & (F.col(names.score) == 0)
    time = F.col(names.event_time)
    return [
        F.count(F.when(unexplained, 1)).alias("_unexplained"),
        F.count(F.when(flagged, 1)).alias("_outliers"),
        F.min(time).alias("_first"),
        F.max(time).alias("_last"),
        F.min(F.when(flagged, time)).alias("_first_outlier"),
        F.max(F.when(flagged, time)).alias("_last_outlier"),
    ]


def rows_of_places(places: DataFrame, keys: Sequence[str], limit: int = 10) -> DataFrame:
    """The rows of `top_executors` and `top_hosts` from the measures of each place."""
    # A place without such tasks has no count, and one without a full key is never matched to any.
    known = reduce(Column.__and__, [F.col(key).isNotNull() for key in keys])

    def if_known(column: Column) -> Column:
        return F.when(known, column)

    def second_of(column: str) -> Column:
        return F.floor(F.col(column) / F.lit(1000))

    seconds = second_of("_last") - second_of("_first")
    rows = places.select(
        *keys,
        "total_tasks",
        if_known(F.nullif("_unexplained", F.lit(0))).alias("unexplained_tasks"),
        if_known(pct(F.nullif("_unexplained", F.lit(0)), "total_tasks")).alias("unexplained_pct"),
        if_known(F.nullif("_outliers", F.lit(0))).alias("outlier_tasks"),
        if_known(pct(F.nullif("_outliers", F.lit(0)), "total_tasks")).alias("outlier_pct"),
        format_epoch_ms("_first").alias("min_t_executor"),
        format_epoch_ms("_last").alias("max_t_executor"),
        if_known(format_epoch_ms("_first_outlier")).alias("min_t_outlier"),
        if_known(format_epoch_ms("_last_outlier")).alias("max_t_outlier"),
        seconds.alias("t_executor_est_duration_s"),
        F.floor(seconds / F.lit(3600)).alias("t_executor_est_duration_H"),
    )
    return rows.orderBy(F.col("outlier_pct").desc(), *keys).limit(limit)


def top_executors(
    tables: Tables, order_by: Order = "tbl, outlier_pct desc", limit: int = 10, names: Names = DEFAULT
) -> DataFrame:
    """Executors with the largest share of outliers, the first `limit` of each table."""
    return _top_places(tables, (names.executor, names.host), order_by, limit, names)


def top_hosts(
    tables: Tables, order_by: Order = "tbl, outlier_pct desc", limit: int = 10, names: Names = DEFAULT
) -> DataFrame:
    """Hosts with the largest share of outliers, the first `limit` of each table."""
    return _top_places(tables, (names.host,), order_by, limit, names)


def top_outliers(
    tables: Tables,
    min_stage_tasks: int | None = None,
    unexplained: bool = False,
    limit: int = 10,
    order_by: Order = "tbl",
    names: Names = DEFAULT,
) -> DataFrame:
    """The outliers with the lowest score, longest first, the first `limit` of each table."""

    def report(df: DataFrame) -> DataFrame:
        found = only_outliers(
            df,
            unexplained=unexplained,
            min_group_rows=min_stage_tasks,
            outlier=names.outlier,
            total=names.score,
            group_rows=names.group_rows,
        )
        return (
            found.orderBy(F.col(names.score).asc(), F.col(names.duration).desc(), F.col(names.row_id).asc())
            .limit(limit)
            .select(
                F.col(names.row_id).alias("task_id"),
                F.col(names.duration).alias("task_time_ms"),
                F.col(names.group_limit).alias("stage_p95_task_time"),
                F.col(names.group_rows).alias("stage_num_tasks"),
                from_epoch_ms(names.start).alias("task_launch_ts"),
                F.col(names.group_id).alias("stage__id"),
                F.col(names.host).alias("host"),
                F.col(names.score).alias("explain_metrics"),
            )
        )

    return over_tables(tables, report, order_by)


def bundle(tables: Tables, level: str = "basic", names: Names = DEFAULT) -> dict[str, DataFrame]:
    """Several reports at once: totals and affected stages, or all of them."""
    reports: dict[str, Callable[..., DataFrame]] = {
        "all_tasks": all_tasks,
        "by_task_type": by_task_type,
        "affected_stages": affected_stages,
    }
    if level == "all":
        reports |= {
            "stages_ranked": stages_ranked,
            "top_executors": top_executors,
            "top_hosts": top_hosts,
            "top_outliers": top_outliers,
        }
    elif level != "basic":
        raise ValueError("level must be 'basic' or 'all'")
    return {name: report(tables, names=names) for name, report in reports.items()}


def tasks_of_stage(df: DataFrame, stage_id: int, columns: Sequence[str | Column] = ()) -> DataFrame:
    """The tasks of one stage id beside the stage's statistics, longest first."""
    return (
        df.filter(F.col("stage_id") == stage_id)
        .select(
            "task_id",
            F.col("task_time").alias("task_duration"),
            "stage_avg_task_time",
            "stage_median_task_time",
            "stage_p95_task_time",
            "task_launch_time",
            "task_finish_time",
            "task_end_reason",
            *columns,
        )
        .orderBy(F.col("task_duration").desc())
    )


def stage_timeline(df: DataFrame) -> DataFrame:
    """Each stage run once with its times, by start."""
    start, end = F.col("stage__submission_time"), F.col("stage__completion_time")
    runs = df.select("stage_id", start, end, "stage_num_tasks", "stage_avg_task_time").distinct()
    return runs.select(
        "stage_id",
        format_epoch_ms(start).alias("sst"),
        format_epoch_ms(end).alias("sct"),
        (F.floor(end / F.lit(1000)) - F.floor(start / F.lit(1000))).alias("duration"),
        "stage_num_tasks",
        "stage_avg_task_time",
    ).distinct().orderBy("sst")
