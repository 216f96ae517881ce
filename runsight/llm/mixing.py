"""Mixes sources to target weights by exact word budgets.

Each document gets a hash-random key. The keys are uniform, so equal key ranges within a source are its range partitions: no sample
is needed, and a source with a third of all rows is cut into as many ranges as its rows call for. Ranges are sorted and summed by
themselves; a second, short prefix sum runs over the range totals. A source takes whole epochs and then the documents up to its
budget in key order, the last of them in part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runsight.llm.text import word_count
from runsight.sources.staging import stage

MAX_EPOCHS = 3
ROWS_PER_RANGE = 5_000
"""Documents in a key range. The prefix sum over a source's range totals has this many times fewer rows than the source."""


def cyclic_weights(sources: DataFrame, cycle: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """(source, weight): weights repeat over the sources in code-point order, null last. One row per source passes through one task."""
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    return sources.select("source", F.get(F.array(*[F.lit(w) for w in cycle]), place % len(cycle)).cast("long").alias("weight"))


def source_targets(totals: DataFrame, weights: DataFrame, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, source_rows, target): the sources' shares of all words, none above `max_epochs` times its own size.

    What a source can't take is shared by the others by weight until no share is above. That is the water level at which each source
    takes the lesser of its limit and level x weight: in order of limit / weight, a source is at its limit if the level of the sources
    from it onwards is no lower than that. A source of weight 0 or without a weight takes nothing. The sources are one row each.
    """
    given = weights.select(F.col("source").alias("_source"), "weight")
    known = totals.join(given, F.col("source").eqNullSafe(F.col("_source")), "left").select(
        "source", "source_size", "source_rows", F.coalesce(F.greatest("weight", F.lit(0)), F.lit(0)).alias("_weight")
    )
    cap = F.col("_cap").cast("decimal(38,0)")
    by_ratio = Window.orderBy(F.try_divide("_cap", "_weight").asc_nulls_last(), F.col("source").asc_nulls_last())
    after = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    levels = known.withColumn("_cap", F.col("source_size") * max_epochs).select(
        "*",
        F.sum("source_size").over(everything).alias("_all"),
        F.coalesce(F.sum(F.when(F.col("_weight") > 0, F.col("_cap"))).over(before), F.lit(0)).alias("_capped"),
        F.sum("_weight").over(after).alias("_weights"),
    )
    full = cap * F.col("_weights") <= (F.col("_all") - F.col("_capped")).cast("decimal(38,0)") * F.col("_weight")
    marked = levels.withColumn("_full", (F.col("_weight") > 0) & full)
    rest = F.col("_all") - F.coalesce(F.sum(F.when(F.col("_full"), F.col("_cap"))).over(everything), F.lit(0))
    share = F.coalesce(F.sum(F.when(~F.col("_full"), F.col("_weight"))).over(everything), F.lit(0))
    target = F.when(F.col("_full"), F.col("_cap").cast("double")).when(F.col("_weight") == 0, F.lit(0.0)).otherwise(F.try_divide(rest.cast("double") * F.col("_weight"), share))
    return marked.select("source", "source_size", "source_rows", F.coalesce(target, F.lit(0.0)).alias("target"))


def random_key(seed: int) -> Column:
    """Uniform in 0 .. 2^62 - 1, fixed by seed, id and text; so rows without an id are spread as well."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text")), 2)


def mix(
    docs: DataFrame, weights: DataFrame | None = None, seed: int = 17, max_epochs: int = MAX_EPOCHS, rows_per_range: int = ROWS_PER_RANGE
) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, epochs, taken.

    `size` is the number of words (null text: 0). `weights` has (source, weight); by default 1, 2, 3 repeating. The budget of a source is
    its target without the fraction. `epochs` times a document is taken whole; `taken` counts its words in the mix, with repeats and the
    part that fills the budget: epochs * size <= taken <= max_epochs * size. Reruns agree: keys depend on seed, id and text. Rows equal
    in id, text and source tie; which of them is cut makes no difference to the rows returned. A null source is a source. Empty
    tables give no rows.
    """
    sized = stage(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), random_key(seed).alias("_key")), "mix_sizes")
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("source_rows"))
    totals = stage(totals, "mix_totals")
    targets = stage(source_targets(totals, cyclic_weights(totals) if weights is None else weights, max_epochs), "mix_targets")
    budget = F.floor("target")
    targets = targets.select(
        F.col("source").alias("_source"),
        "source_size",
        "target",
        F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0)).cast("long").alias("_whole"),
        F.ceil(F.col("source_rows") / rows_per_range).cast("long").alias("_ranges"),
    )
    targets = targets.withColumn("_rest", F.floor("target") - F.col("_whole") * F.col("source_size"))
    span = F.floor(F.lit(2.0**62) / F.col("_ranges")) + 1
    ranged = sized.join(targets, F.col("source").eqNullSafe(F.col("_source"))).drop("_source").withColumn("_range", F.floor(F.col("_key") / span).cast("long"))

    place = ["source", "_range"]
    starts = ranged.groupBy(*place).agg(F.sum("size").alias("_range_size"))
    along = Window.partitionBy("source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.select(F.col("source").alias("_s"), F.col("_range").alias("_r"), F.coalesce(F.sum("_range_size").over(along), F.lit(0)).alias("_start"))
    within = Window.partitionBy(*place).orderBy("_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    summed = ranged.withColumn("_before", F.coalesce(F.sum("size").over(within), F.lit(0)))
    placed = summed.join(starts, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_range") == F.col("_r")))
    left = F.col("_rest") - F.col("_start") - F.col("_before")
    part = F.greatest(F.lit(0), F.least(F.col("size"), left))
    epochs = F.col("_whole") + F.when((left >= F.col("size")) & (F.col("size") > 0), 1).otherwise(0)
    return placed.select(
        "doc_id", "source", "size", "source_size", "target", epochs.cast("long").alias("epochs"), (F.col("_whole") * F.col("size") + part).cast("long").alias("taken")
    )
