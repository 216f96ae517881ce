"""All reports of an outlier table from one scan of it.

Each task counts for several groups at once: the table, its type, its stage, its stage and duration, its executor and its host; and an
outlier also for itself. These sets of groups are one aggregation, summed up in each task before they are shuffled, and stored by
set. The reports read only their set.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runsight.plans import reports
from runsight.plans.reports import DEFAULT, Names, Tables
from runsight.sources.staging import stage

TABLE, TYPE, STAGE, DURATION, EXECUTOR, HOST, ROW = range(7)


def _fields(columns: Sequence[str]) -> Column:
    return F.struct(*[F.col(name).alias(name) for name in columns])


def report_groups(df: DataFrame, names: Names = DEFAULT) -> DataFrame:
    """One row per set and group with all measures that any report takes of it."""
    explained = f"{names.outlier}_explained_tasks"
    of_row = [names.outlier, names.score, names.group_rows, names.duration, names.row_id, names.group_limit, names.start, names.group_id, names.host]
    parts = {
        "task_type": F.col(names.row_type),
        "stage": _fields(names.group),
        "duration": F.col(names.duration),
        "executor": F.struct(F.col(names.executor).alias(names.executor), F.col(names.host).alias(names.host)),
        "host": F.col(names.host),
        "row": _fields(list(dict.fromkeys(of_row))),
    }
    sets = {TABLE: (), TYPE: ("task_type",), STAGE: ("stage",), DURATION: ("stage", "duration"), EXECUTOR: ("executor",), HOST: ("host",), ROW: ("row",)}
    kinds = df.select(*[column.alias(f"_{name}") for name, column in parts.items()]).schema

    def group(number: int) -> Column:
        keys = [(column if name in sets[number] else F.lit(None).cast(kinds[f"_{name}"].dataType)).alias(f"_{name}") for name, column in parts.items()]
        return F.struct(F.lit(number).alias("_set"), *keys)

    # Few tasks are outliers, so few rows are groups of their own.
    groups = F.filter(F.array(*map(group, sets)), lambda g: (g["_set"] != ROW) | F.coalesce(F.col(names.outlier) > 0, F.lit(False)))
    measured = dict.fromkeys([names.outlier, names.score, names.duration, names.start, names.end, names.event_time])
    each = df.select(*measured, F.inline(groups))
    return each.groupBy("_set", *[f"_{name}" for name in parts]).agg(
        *reports.outlier_totals(names), F.sum(F.when((F.col(names.score) > 0) & (F.col(names.outlier) > 0), 1).otherwise(0)).cast("bigint").alias(explained),
        *reports.stage_times(names), *reports.place_measures(names),
    )


def bundle_of_one_scan(
    tables: Tables, level: str = "basic", probability: float = 0.95, size_classes: Sequence[int] = (0, 20, 100), limit: int = 10, names: Names = DEFAULT
) -> dict[str, DataFrame]:
    """The reports of `bundle`, with the same rows. Each table is read once, now; the reports read what is stored of it."""
    if level not in ("basic", "all"):
        raise ValueError("level must be 'basic' or 'all'")
    if isinstance(tables, str):
        tables = [tables]
    if not isinstance(tables, Mapping):
        spark = SparkSession.getActiveSession()
        tables = {name: spark.table(name) for name in tables}
    groups = {name: stage(report_groups(df, names), "report_groups", partition_by=["_set"]) for name, df in tables.items()}
    totals = ["total_tasks", f"{names.outlier}_tasks", f"{names.outlier}_unexplained_tasks", "explained_tasks"]

    def of(number: int, report, order_by="tbl") -> DataFrame:
        return reports.over_tables({name: df.filter(F.col("_set") == number) for name, df in groups.items()}, report, order_by)

    def whole(df: DataFrame) -> DataFrame:
        # One row, also of an empty table.
        sums = df.agg(F.coalesce(F.sum(totals[0]), F.lit(0)).alias(totals[0]), *[F.sum(name).alias(name) for name in totals[1:]])
        return sums.select("*", *reports.total_pcts(names))

    def ranked(name: str, df: DataFrame) -> DataFrame:
        counts = groups[name].filter(F.col("_set") == DURATION).groupBy(F.col("_stage").alias("_of")).agg(
            F.percentile("_duration", F.array(F.lit(float(probability))), F.col("total_tasks")).alias(f"_q_{names.duration}")
        )
        stages = df.join(counts, df["_stage"].eqNullSafe(counts["_of"])).select("_stage.*", *[c for c in (*df.columns, f"_q_{names.duration}") if not c.startswith("_") or c.startswith("_q_")])
        return reports.ranks_of_stages(stages, names)

    found = {
        "all_tasks": of(TABLE, whole),
        "by_task_type": of(TYPE, lambda df: df.select(F.col("_task_type").alias("task_type"), *totals).select("*", *reports.total_pcts(names))),
        "affected_stages": of(STAGE, lambda df: reports.classes_of_stages(df.select("_stage.*", *totals), size_classes, names)),
    }
    if level == "all":
        by_stage = {name: df.filter(F.col("_set") == STAGE) for name, df in groups.items()}
        order = [F.col("tbl"), F.col(f"{names.outlier}_unexplained_tasks").desc()]
        places = "tbl, outlier_pct desc"
        found |= {
            "stages_ranked": reports.over_named_tables(by_stage, ranked, order),
            "top_executors": of(EXECUTOR, lambda df: reports.rows_of_places(df.select("_executor.*", *[c for c in df.columns if c not in _KEYS]), (names.executor, names.host), limit), places),
            "top_hosts": of(HOST, lambda df: reports.rows_of_places(df.withColumn(names.host, F.col("_host")), (names.host,), limit), places),
            "top_outliers": reports.top_outliers({name: df.filter(F.col("_set") == ROW).select("_row.*", F.explode(F.sequence(F.lit(1).cast("bigint"), "total_tasks")).alias("_copy")) for name, df in groups.items()}, limit=limit, names=names),
        }
    return found


_KEYS = ("_set", "_task_type", "_stage", "_duration", "_executor", "_host", "_row")
