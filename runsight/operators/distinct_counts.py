"""Exact distinct counts that merge: ids as bits.

An id is one bit of a bitmap for 32,768 neighbouring ids, so a group's ids are a few rows of 4 KB, if the ids are dense as task, row and
user numbers are. Bitmaps of days, runs or tables are stored and or-ed later; the ids themselves are read once and never shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def id_bitmaps(df: DataFrame, keys: Sequence[str], ids: str) -> DataFrame:
    """Per group and range of ids, the bitmap of those that occur: the keys, `bucket`, `bitmap`.

    `ids` is a column of whole numbers, negative ones too; nulls are left out, so a group of nulls only has no rows. A bitmap is
    built in each task first, so what is shuffled is one row for each group, range and task.
    """
    number = F.col(ids).cast("bigint")
    numbered = df.filter(number.isNotNull()).select(*keys, F.bitmap_bucket_number(number).alias("bucket"), F.bitmap_bit_position(number).alias("_bit"))
    return numbered.groupBy(*keys, "bucket").agg(F.bitmap_construct_agg("_bit").alias("bitmap"))


def merge_bitmaps(bitmaps: DataFrame | Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """The bitmaps of coarser groups, or of several tables together."""
    tables = [bitmaps] if isinstance(bitmaps, DataFrame) else list(bitmaps)
    every = reduce(DataFrame.unionByName, [table.select(*keys, "bucket", "bitmap") for table in tables])
    return every.groupBy(*keys, "bucket").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))


def common_bitmaps(bitmaps: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """The bitmaps of the ids that all of the tables hold. Each table has one bitmap per group and range."""
    every = reduce(DataFrame.unionByName, [table.select(*keys, "bucket", "bitmap") for table in bitmaps])
    met = every.groupBy(*keys, "bucket").agg(F.bitmap_and_agg("bitmap").alias("bitmap"), F.count(F.lit(1)).alias("_tables"))
    return met.filter(F.col("_tables") == len(bitmaps)).drop("_tables")


def distinct_counts(bitmaps: DataFrame, keys: Sequence[str], name: str = "num_distinct") -> DataFrame:
    """Per group, how many ids its bitmaps hold. Each id range of a group must be there once, as `merge_bitmaps` leaves it."""
    return bitmaps.groupBy(*keys).agg(F.sum(F.bitmap_count("bitmap")).cast("bigint").alias(name))
