"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runsight.sources.staging import stage


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node ties its larger neighbours to the least of its neighbours and itself."""
    both = edges.select(F.col("child").alias("u"), F.col("parent").alias("v")).union(edges.select("parent", "child"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("child"), F.col("m").alias("parent")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node ties itself and its smaller neighbours to the least of these."""
    least = edges.groupBy("child").agg(F.min("parent").alias("m"))
    tied = edges.join(least, "child")
    moved = tied.select(F.col("parent").alias("child"), F.col("m").alias("parent")).filter("child <> parent")
    return moved.union(tied.select("child", F.col("m").alias("parent"))).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("child", "parent"))).first())


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) of all nodes that a link joins to another; the component is its smallest node.

    `links` has two columns of nodes, in any direction, with repeats. Rows with a null and links of a node with itself are ignored.
    Minima are summed per task before they are shuffled, and joins on a node with many neighbours can be split, so a hub is no hot
    spot. Each round is written to the shared folder, which cuts the lineage.
    """
    a, b = (F.col(c) for c in links.columns[:2])
    edges = stage(links.filter(a != b).select(F.greatest(a, b).alias("child"), F.least(a, b).alias("parent")).distinct(), "links")
    state = _state(edges)
    while state[0]:
        edges = stage(_small_star(_large_star(edges)), "stars")
        last, state = state, _state(edges)
        if state == last:
            break
    roots = edges.select(F.col("parent").alias("node"), F.col("parent").alias("component")).distinct()
    return edges.select(F.col("child").alias("node"), F.col("parent").alias("component")).union(roots)
