"""Exact percentiles of groups of any size without sorting them.

A mergeable sketch of a group's values tells between which two values a wanted rank lies. A pass over the rows counts what is below that
bracket and what is inside, which shows whether the bracket holds the rank, and sketches the inside anew; so brackets get narrower by the
sketch's accuracy with each pass. When few values are left inside, these are counted one by one and the rank is picked among them. Nothing
but sketches, counts and the last values is shuffled.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runsight.sources.staging import stage

SKETCH_K = 800
"""Size of the sketches: their error is about 0.35 % of the ranks."""
VALUES_AT_ONCE = 200_000
"""With so many values or fewer inside its bracket, a rank is picked among them."""
BROADCAST_BRACKETS = 500_000
"""Most brackets that are sent to every executor; beyond that the rows are shuffled to them."""
STEPS = 512
"""Ranks at which a sketch is read."""
MARGIN = 2.0
"""First width of a bracket on either side, in errors of the sketch."""


def sketch_values(df: DataFrame, keys: Sequence[str], values: Mapping[str, str], k: int = SKETCH_K) -> DataFrame:
    """Per group one struct (sketch, nans) for each named SQL expression; to be stored, for instance per day, and merged later."""
    columns = []
    for name, value in values.items():
        number = F.expr(f"CAST({value} AS DOUBLE)")
        # The sketch leaves NaN out.
        columns.append(F.struct(F.kll_sketch_agg_double(number, F.lit(k)).alias("sketch"), F.count_if(F.isnan(number)).alias("nans")).alias(name))
    return df.groupBy(*keys).agg(*columns)


def merge_sketches(sketches: DataFrame, keys: Sequence[str], names: Sequence[str], k: int = SKETCH_K) -> DataFrame:
    """The sketches of coarser groups."""
    merged = [F.struct(F.kll_merge_agg_double(F.col(name)["sketch"], F.lit(k)).alias("sketch"), F.sum(F.col(name)["nans"]).alias("nans")).alias(name) for name in names]
    return sketches.groupBy(*keys).agg(*merged)


def _error(k: int) -> float:
    """The sketch's error of a normalised rank, at 99 %: the published fit for this kind of sketch."""
    return 2.296 / k**0.9723


def _bracket(k: int) -> list[Column]:
    """The next bracket to try: that of the wanted ranks among the values inside the last one, by its sketch."""
    inside = F.col("inside").cast("double")
    wide = F.col("margin") * F.lit(_error(k)) + F.lit(2.0) / inside
    low = F.greatest(F.lit(0.0), (F.col("first") - F.col("below")) / inside - wide)
    high = F.least(F.lit(1.0), (F.col("second") - F.col("below") + 1) / inside + wide)
    # A sketch is asked for fixed ranks only, so these are the next ones outside.
    steps = F.kll_sketch_get_quantile_double("sketch", F.array(*[F.lit(i / STEPS) for i in range(STEPS + 1)]))
    return [F.get(steps, F.floor(low * STEPS).cast("int")).alias("try_low"), F.get(steps, F.ceil(high * STEPS).cast("int")).alias("try_high")]


def _wanted(sketches: DataFrame, keys: Sequence[str], names: Sequence[str], probabilities: Sequence[float]) -> DataFrame:
    """One row for each group, value and probability, with the bracket of all values. Without values there is no rank."""
    each = sketches.select(*keys, F.posexplode(F.array(*[F.col(name) for name in names])).alias("_m", "_s"))
    counted = each.select(*keys, "_m", F.col("_s.sketch").alias("sketch"), F.col("_s.nans").alias("nans"), F.kll_sketch_get_n_double("_s.sketch").alias("n"))
    last = F.when(F.col("n") + F.col("nans") > 0, F.col("n") + F.col("nans") - 1).cast("double")
    points = F.array(*[F.struct(F.lit(i).alias("i"), last * F.lit(float(p))) for i, p in enumerate(probabilities)])
    ranked = counted.select("*", F.inline(points).alias("_i", "at"))
    rank = lambda end: F.greatest(F.least(end("at").cast("long"), F.col("n") - 1), F.lit(0))
    edge = lambda r: F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double("sketch", F.lit(r)))
    return ranked.select(
        *keys, "_m", "_i", "at", "n", "sketch", rank(F.floor).alias("first"), rank(F.ceil).alias("second"),
        edge(0.0).alias("low"), edge(1.0).alias("high"), F.lit(0).cast("long").alias("below"), F.col("n").alias("inside"), F.lit(MARGIN).alias("margin"), F.lit(False).alias("stuck"),
    )


def _inside(values: DataFrame, brackets: DataFrame, keys: Sequence[str], limit: int) -> DataFrame:
    """Each value with the brackets of its group that don't lie below it."""
    renamed = brackets.toDF(*[f"_k_{i}" for i in range(len(keys))], "_bm", "_i", "_low", "_high")
    same = reduce(Column.__and__, [values[key].eqNullSafe(renamed[f"_k_{i}"]) for i, key in enumerate(keys)], values["_m"] == renamed["_bm"])
    few = brackets.limit(limit + 1).count() <= limit
    joined = values.join(F.broadcast(renamed) if few else renamed.hint("merge"), same & (values["_v"] <= renamed["_high"]))
    return joined.select(*keys, "_m", "_i", "_v", "_low", "_high")


def _refined(values: DataFrame, state: DataFrame, keys: Sequence[str], k: int, limit: int) -> DataFrame:
    """One pass: the open brackets are tried, and taken if they hold their ranks; the others get a wider margin."""
    tried = stage(state.select("*", *_bracket(k)), "brackets")
    met = _inside(values, tried.select(*keys, "_m", "_i", "try_low", "try_high"), keys, limit)
    held = F.col("_v") >= F.col("_low")
    seen = met.groupBy(*keys, "_m", "_i").agg(
        F.count_if(~held).alias("_below"), F.count_if(held).alias("_inside"), F.kll_sketch_agg_double(F.when(held, F.col("_v")), F.lit(k)).alias("_sketch")
    )
    renamed = seen.toDF(*[f"_k_{i}" for i in range(len(keys))], "_bm", "_bi", "_below", "_inside", "_sketch")
    same = reduce(Column.__and__, [tried[key].eqNullSafe(renamed[f"_k_{i}"]) for i, key in enumerate(keys)], (tried["_m"] == renamed["_bm"]) & (tried["_i"] == renamed["_bi"]))
    holds = F.coalesce((F.col("first") >= F.col("_below")) & (F.col("second") < F.col("_below") + F.col("_inside")), F.lit(False))
    taken = {"low": "try_low", "high": "try_high", "below": "_below", "inside": "_inside", "sketch": "_sketch"}
    # A margin over all ranks tries what the sketch itself says of its least and largest value.
    foreign = F.raise_error("the sketches aren't those of the rows").cast("double")
    margin = F.when(holds, F.lit(MARGIN)).when(F.col("margin") * F.lit(_error(k)) > 1, foreign).otherwise(F.col("margin") * 2)
    # A bracket that doesn't get narrower holds few distinct values, however many there are of each.
    narrow = ~holds | (F.col("_inside") * 2 <= F.col("inside"))
    out = tried.join(renamed, same, "left").select(
        *keys, "_m", "_i", "at", "n", "first", "second",
        *[F.when(holds, F.col(new)).otherwise(F.col(old)).alias(old) for old, new in taken.items()],
        margin.alias("margin"), (~narrow).alias("stuck"),
    )
    return stage(out.select(*state.columns), "brackets")


def _picked(values: DataFrame, brackets: DataFrame, keys: Sequence[str], limit: int) -> DataFrame:
    """The values at both ranks, among the counted values inside the brackets."""
    met = _inside(values, brackets.select(*keys, "_m", "_i", "low", "high"), keys, limit).filter("_v >= _low")
    counts = met.groupBy(*keys, "_m", "_i", "_v").agg(F.count(F.lit(1)).alias("_c"))
    upto = F.sum("_c").over(Window.partitionBy(*keys, "_m", "_i").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    renamed = brackets.select(*[F.col(key).alias(f"_k_{i}") for i, key in enumerate(keys)], F.col("_m").alias("_bm"), F.col("_i").alias("_bi"), "first", "second", "below", "at", "n")
    running = counts.withColumn("_upto", upto)
    same = reduce(Column.__and__, [running[key].eqNullSafe(renamed[f"_k_{i}"]) for i, key in enumerate(keys)], (running["_m"] == renamed["_bm"]) & (running["_i"] == renamed["_bi"]))
    placed = running.join(renamed, same)
    at = lambda rank: F.max(F.when((F.col(rank) < F.col("below") + F.col("_upto")) & (F.col(rank) >= F.col("below") + F.col("_upto") - F.col("_c")), F.col("_v")))
    return placed.groupBy(*keys, "_m", "_i", "at", "n").agg(at("first").alias("low"), at("second").alias("high"))


def percentiles_by_sketch(
    df: DataFrame,
    keys: Sequence[str],
    values: Mapping[str, str],
    probabilities: Sequence[float],
    *,
    sketches: DataFrame | None = None,
    k: int = SKETCH_K,
    at_once: int = VALUES_AT_ONCE,
    broadcast_brackets: int = BROADCAST_BRACKETS,
) -> DataFrame:
    """Per group, one `array<double>` column for each named SQL expression, in the order of `probabilities`.

    Same interpolation and handling of NULL and NaN as Spark's `percentile`. `sketches` are those of `sketch_values` or `merge_sketches` for
    exactly the rows of `df`; without them a pass makes them. Reads `df` once more for each refinement: pass a stored table.
    `keys` may be empty.
    """
    keys, names = list(keys), list(values)
    sketches = sketch_values(df, keys, values, k) if sketches is None else sketches
    listed = ", ".join(f"CAST({values[name]} AS DOUBLE)" for name in names)
    each = df.select(*keys, F.posexplode(F.expr(f"array({listed})")).alias("_m", "_v")).filter("_v IS NOT NULL AND NOT isnan(_v)")

    state = stage(_wanted(sketches, keys, names, probabilities), "brackets")
    final = (F.col("n") == 0) | (F.col("inside") <= at_once) | (F.col("low") == F.col("high")) | F.col("stuck")
    done = [state.filter(final).drop("sketch")]
    state = state.filter(~final)
    while state.limit(1).count():
        refined = _refined(each, state, keys, k, broadcast_brackets)
        done.append(refined.filter(final).drop("sketch"))
        state = refined.filter(~final)
    known = stage(reduce(DataFrame.unionByName, done), "brackets")

    single = known.filter("n = 0 OR low = high").select(*keys, "_m", "_i", "at", "n", "low", "high")
    picked = _picked(each, known.filter("low < high"), keys, broadcast_brackets)
    # NaN comes after all numbers.
    number = lambda end, value: F.when(end("at") >= F.col("n"), F.lit(float("nan"))).otherwise(F.col(value))
    low, high = number(F.floor, "low"), number(F.ceil, "high")
    between = F.when(low == high, low).otherwise((F.ceil("at") - F.col("at")) * low + (F.col("at") - F.floor("at")) * high)
    found = single.unionByName(picked).select(*keys, "_m", "_i", between.alias("_q"))
    columns = [F.array(*[F.max(F.when((F.col("_m") == m) & (F.col("_i") == i), F.col("_q"))) for i in range(len(probabilities))]) for m in range(len(names))]
    wide = found.groupBy(*keys).agg(*[column.alias(name) for column, name in zip(columns, names)])
    return wide.select(*keys, *[F.when(F.col(name)[0].isNotNull(), F.col(name)).alias(name) for name in names])
