"""Exact percentiles of groups of any size.

The built-in exact percentile holds the distinct values of a group in one task. Here the values are counted,
range-partitioned by (group, metric, value) and staged, so that a large group spans many partitions. The position
of each partition inside its group follows from one count per partition; only the partitions that hold a wanted
rank are read again.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from runsight.sources.staging import stage


def percentiles_by_range(
    df: DataFrame,
    keys: Sequence[str],
    values: Mapping[str, str],
    probabilities: Sequence[float],
    partitions: int,
) -> DataFrame:
    """Per group, one `array<double>` column for each named SQL expression, in the order of `probabilities`.

    Same interpolation and NULL handling as Spark's `percentile`. `partitions` is how many ranges the values are cut
    into; a task holds one of them.
    """
    keys, names = list(keys), list(values)

    # A row may hold few of hundreds of metrics, so those without a value are dropped before they become rows.
    numbers = [f"CAST({values[name]} AS DOUBLE)" for name in names]
    cells = ", ".join(f"CASE WHEN {number} IS NOT NULL THEN struct({m} AS _m, {number} AS _v) END" for m, number in enumerate(numbers))
    counted = (
        df.select(*keys, F.expr(f"inline(array_compact(array({cells})))"))
        .groupBy(*keys, "_m", "_v")
        .agg(F.count(F.lit(1)).alias("_c"))
    )
    placed = counted.repartitionByRange(partitions, *keys, "_m", "_v").withColumn("_part", F.spark_partition_id())
    placed = stage(placed, "value_counts")

    # One row per group, metric and partition, so these windows hold at most `partitions` rows.
    series = Window.partitionBy(*keys, "_m")
    before = series.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = (
        placed.groupBy(*keys, "_m", "_part")
        .agg(F.sum("_c").alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .withColumn("_total", F.sum("_n").over(series))
    )
    wanted = F.array(
        *[F.struct(F.lit(i).alias("i"), ((F.col("_total") - 1) * F.lit(float(p))).alias("at")) for i, p in enumerate(probabilities)]
    )
    ends = F.array(F.floor("_w.at"), F.ceil("_w.at"))
    targets = (
        parts.select("*", F.explode(wanted).alias("_w"))
        .select("*", F.posexplode(ends).alias("_end", "_rank"))
        .filter((F.col("_rank") >= F.col("_before")) & (F.col("_rank") < F.col("_before") + F.col("_n")))
        .groupBy(*keys, "_m", "_part", "_before")
        .agg(F.collect_list(F.struct("_w.i", "_w.at", "_end", "_rank")).alias("_ranks"))
    )

    # Rows of one group in one partition only, so these windows are as bounded as a partition is.
    running = (
        Window.partitionBy(*keys, "_m", "_part").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    renamed = targets.select(
        *[F.col(key).alias(f"_t_{i}") for i, key in enumerate(keys)],
        F.col("_m").alias("_t_m"),
        F.col("_part").alias("_t_part"),
        "_before",
        "_ranks",
    )
    same = (placed["_m"] == renamed["_t_m"]) & (placed["_part"] == renamed["_t_part"])
    for i, key in enumerate(keys):
        same = same & placed[key].eqNullSafe(renamed[f"_t_{i}"])
    hits = (
        placed.join(renamed, same)
        .withColumn("_upto", F.col("_before") + F.sum("_c").over(running))
        .withColumn(
            "_hits",
            F.filter("_ranks", lambda r: (r["_rank"] < F.col("_upto")) & (r["_rank"] >= F.col("_upto") - F.col("_c"))),
        )
        .select(*keys, "_m", "_v", F.explode("_hits").alias("_h"))
    )
    at = F.max("_h.at")
    low = F.max(F.when(F.col("_h._end") == 0, F.col("_v")))
    high = F.max(F.when(F.col("_h._end") == 1, F.col("_v")))
    per_rank = hits.groupBy(*keys, "_m", F.col("_h.i").alias("_i")).agg(
        F.when(low == high, low).otherwise((F.ceil(at) - at) * low + (at - F.floor(at)) * high).alias("_q")
    )
    columns = [
        F.array(*[F.max(F.when((F.col("_m") == m) & (F.col("_i") == i), F.col("_q"))) for i in range(len(probabilities))])
        for m in range(len(names))
    ]
    wide = per_rank.groupBy(*keys).agg(*[column.alias(name) for column, name in zip(columns, names)])
    present = [F.when(F.col(name)[0].isNotNull(), F.col(name)).alias(name) for name in names]
    return wide.select(*keys, *present)
