"""Groups too large for one task, found by counting and held as a small fixed table."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from runsight.sources.staging import stage

MOST_HOT_GROUPS = 10_000
"""At most this many keys are held by the driver and broadcast; any other group has under 1/10,000 of the rows."""


@dataclass(frozen=True)
class HotGroups:
    keys: tuple[str, ...]
    frame: DataFrame | None
    complete: bool
    """False if there were more large groups than `frame` holds."""
    rows_over: int
    rows: int = 0
    """Rows of the listed groups."""

    def __bool__(self) -> bool:
        return self.frame is not None

    def _split(self, df: DataFrame, how: str) -> DataFrame:
        hot = self.frame.toDF(*[f"_hot_{i}" for i in range(len(self.keys))])
        same = None
        for i, key in enumerate(self.keys):
            test = df[key].eqNullSafe(hot[f"_hot_{i}"])
            same = test if same is None else same & test
        return df.join(F.broadcast(hot), same, how)

    def rows_of(self, df: DataFrame) -> DataFrame:
        return self._split(df, "left_semi")

    def other_rows_of(self, df: DataFrame) -> DataFrame:
        return self._split(df, "left_anti")


SALTS = 32
"""Parts that the rows of a key are cut into where the large keys are too many to list."""


def join_salted(left: DataFrame, right: DataFrame, on: Column, salts: int = SALTS, hint: str | None = None) -> DataFrame:
    """Inner join in which the rows of one key are dealt to `salts` tasks; each row of `right` goes to all of these."""
    part = F.pmod(F.xxhash64(*[F.col(f"`{name}`") for name, kind in left.dtypes if not kind.startswith(("map", "variant", "struct<", "array"))]), F.lit(salts))
    dealt = left.withColumn("_salt", part.cast("int"))
    every = right.withColumn("_salts", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    every = every.hint(hint) if hint else every
    return dealt.join(every, on & (F.col("_salt") == F.col("_salts"))).drop("_salt", "_salts")


def join_splitting_hot(
    left: DataFrame, right: DataFrame, keys: Sequence[str], weight: str, salts: int = SALTS, most: int = MOST_HOT_GROUPS
) -> DataFrame:
    """Inner join on columns of both sides, in which the heaviest keys are dealt to `salts` tasks each.

    `right` has one row per key, and in `weight` how many rows of `left` have it, or a number that grows with that. At most `most` keys
    are split: any other has under 1 / `most` of the rows. Their few rows on the right go to every part. `right` is read
    twice: pass a stored table; `left` is read once. Rows with a null key are in no pair.
    """
    hot = right.orderBy(F.col(weight).desc(), *keys).limit(most).select(*keys, F.lit(True).alias("_hot"))
    hot = F.broadcast(stage(hot, "hot_keys"))
    part = F.pmod(F.xxhash64(*[F.col(f"`{name}`") for name, kind in left.dtypes if not kind.startswith(("map", "variant"))]), F.lit(salts)).cast("int")
    dealt = left.join(hot, list(keys), "left").withColumn("_salt", F.when(F.col("_hot"), part).otherwise(F.lit(0))).drop("_hot")
    parts = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    every = right.join(hot, list(keys), "left").withColumn("_salt", F.explode(parts)).drop("_hot")
    return dealt.join(every, [*keys, "_salt"]).drop("_salt")


def find_hot_groups(
    df: DataFrame, keys: Sequence[str], rows_over: int, most: int = MOST_HOT_GROUPS
) -> HotGroups:
    """Count the rows per key (one pass over the key columns) and keep the largest groups over `rows_over`."""
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).filter(F.col("_rows") > rows_over)
    found = counted.orderBy(F.col("_rows").desc()).limit(most + 1).select(*keys, "_rows").collect()
    if not found:
        return HotGroups(tuple(keys), None, True, rows_over)
    schema = StructType([StructField(key, df.schema[key].dataType, True) for key in keys])
    frame = df.sparkSession.createDataFrame([tuple(row)[:-1] for row in found[:most]], schema)
    return HotGroups(tuple(keys), frame, len(found) <= most, rows_over, sum(row["_rows"] for row in found[:most]))
