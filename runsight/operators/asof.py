"""Rows joined to the last window before them, by one sorted stream of both.

Where the windows of a key don't overlap, a row can only be in the last one that has begun. So rows and windows are sorted by key and
time together, over ranges of any key, and the last window is carried on from row to row, and from range to range for a key that
crosses the border. No window is listed more than once, and a key with most of the rows is many ranges.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runsight.operators.windows import attach_window
from runsight.sources.staging import stage

ROWS_PER_RANGE = 2_000_000


def _whole(df: DataFrame) -> Column:
    return F.struct(*[F.col(f"`{name}`") for name in df.columns])


def _known(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.dropna(subset=[f"`{name}`" for name in columns])


def attach_last_window(
    facts: DataFrame,
    windows: DataFrame,
    *,
    on: Mapping[str, str],
    start: str,
    end: str,
    window_start: str,
    window_end: str,
    grace: int = 0,
    drop: Sequence[str] = (),
    ranges: int | None = None,
) -> DataFrame:
    """The rows of `attach_window`, for windows that don't overlap within a key, their `grace` included.

    Overlapping windows are an error; so are two that touch, since a row at that moment is in both. Rows with a null key, start or end, and
    windows with a null key or bound, are in no pair. Rows that end before they start, as by a wrong clock, are joined by `attach_window`.
    Reads `facts` several times: pass stored tables. `ranges` is how many parts the rows are cut into, by default one for each 2 million.
    """
    clash = (set(facts.columns) & set(windows.columns)) - set(drop)
    if clash:
        raise ValueError(f"columns on both sides: {sorted(clash)}")
    windows = windows.drop(*drop)
    keys = [f"_key_{i}" for i in range(len(on))]
    usable = _known(facts, [*on, start, end])
    forward = usable.filter(F.col(end) >= F.col(start))
    rows = forward.select(*[F.col(name).alias(key) for name, key in zip(on, keys)], F.col(start).alias("_at"), F.lit(1).alias("_kind"), _whole(facts).alias("_fact"))
    # A window that is over before it begins holds no row that goes forward, and must not hide another.
    begun = _known(windows, [*on.values(), window_start, window_end]).filter(F.col(window_end) + F.lit(grace) >= F.col(window_start))
    begun = begun.select(*[F.col(name).alias(key) for name, key in zip(on.values(), keys)], F.col(window_start).alias("_at"), F.lit(0).alias("_kind"), _whole(windows).alias("_window"))
    fact, window = rows.schema["_fact"].dataType, begun.schema["_window"].dataType
    both = begun.withColumn("_fact", F.lit(None).cast(fact)).unionByName(rows.withColumn("_window", F.lit(None).cast(window)))
    if ranges is None:
        ranges = max(facts.sparkSession.sparkContext.defaultParallelism, -(-usable.count() // ROWS_PER_RANGE))
    # A window comes before the rows that start with it.
    placed = stage(both.repartitionByRange(ranges, *keys, "_at", "_kind").withColumn("_part", F.spark_partition_id()), "asof_ranges")

    carried = _carried(placed, keys, window)
    ended = F.col(f"_window.`{window_end}`") + F.lit(grace)
    earlier = Window.partitionBy("_part", *keys).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    ordered = placed.filter("_kind = 0").withColumn("_last", F.max(ended).over(earlier)).join(F.broadcast(carried), ["_part", *keys], "left")
    before = F.greatest("_last", F.col(f"_before.`{window_end}`") + F.lit(grace))
    if ordered.filter(F.col("_at") <= before).limit(1).count():
        raise ValueError("windows of one key overlap: use attach_window")

    since = Window.partitionBy("_part", *keys).orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    along = placed.withColumn("_begun", F.last("_window", ignorenulls=True).over(since)).filter("_kind = 1")
    found = along.join(F.broadcast(carried), ["_part", *keys], "left").select("_fact", F.coalesce("_begun", "_before").alias("_begun"))
    found = found.filter(F.col(f"_fact.`{end}`") <= F.col(f"_begun.`{window_end}`") + F.lit(grace)).select("_fact.*", "_begun.*")
    backward = usable.filter(F.col(end) < F.col(start))
    if not backward.limit(1).count():
        return found
    bounds = {"start": start, "end": end, "window_start": window_start, "window_end": window_end}
    return found.unionByName(attach_window(backward, windows, on=on, grace=grace, split_rows=ROWS_PER_RANGE, **bounds))


def _carried(placed: DataFrame, keys: Sequence[str], window) -> DataFrame:
    """For each range whose first key has a window in an earlier range, the last such window: one row per range at most."""
    last = placed.filter("_kind = 0").groupBy("_part", *keys).agg(F.max_by("_window", "_at").alias("_window"))
    first = stage(placed.groupBy("_part").agg(F.min(F.struct(*keys)).alias("_first")).select("_part", "_first.*"), "asof_borders")
    ends = last.join(F.broadcast(first.select(*keys).distinct()), list(keys), "left_semi").withColumn("_asks", F.lit(0))
    asking = first.withColumn("_window", F.lit(None).cast(window)).withColumn("_asks", F.lit(1))
    # At most two rows per range and key. What a range holds itself comes after what it asks for.
    along = Window.partitionBy(*keys).orderBy("_part", F.col("_asks").desc()).rowsBetween(Window.unboundedPreceding, -1)
    known = asking.unionByName(ends).withColumn("_before", F.last("_window", ignorenulls=True).over(along))
    return stage(known.filter("_asks = 1 AND _before IS NOT NULL").select("_part", *keys, "_before"), "asof_carried")
