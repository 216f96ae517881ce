"""Column expressions that several of the text operators share."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WHITESPACE = " \t\n\x0b\f\r"
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

ROW_KEY = ("_row_a", "_row_b")
"""Columns that stand for a row's id and text, never null. Identical rows share them, and so every decision about them."""


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z and nothing else; `lower` would also change letters outside ASCII."""
    return F.translate(text, UPPER, UPPER.lower())


def word_count(text: Column) -> Column:
    """Runs of characters other than ASCII whitespace; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def hash_pair(*values: Column) -> tuple[Column, Column]:
    """Two independent 64-bit hashes of the values, together as safe as one of 128 bits."""
    return F.xxhash64(F.lit(0), *values), F.xxhash64(F.lit(1), *values)


def identified(docs: DataFrame, columns: Sequence[Column | str] = ("doc_id", "text")) -> DataFrame:
    """The named columns of each row and its ROW_KEY, which works for null and repeated ids as well."""
    first, second = hash_pair(F.col("doc_id"), F.col("text"))
    return docs.select(*columns, first.alias(ROW_KEY[0]), second.alias(ROW_KEY[1]))


def whole_row(docs: DataFrame) -> Column:
    """All columns as one, so that their names can't clash with those an operator adds; `select("_all.*")` gives them back."""
    return F.struct(*[F.col("`" + name.replace("`", "``") + "`") for name in docs.columns]).alias("_all")


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with the value computed once per row, also where `use` reads it for each element of an array."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def runs(positions: Column) -> Column:
    """Distinct positions as runs of (start, length), in linear time: a start has no predecessor, an end no successor."""
    starts = F.array_sort(F.array_except(positions, F.transform(positions, lambda x: x + 1)))
    ends = F.array_sort(F.array_except(positions, F.transform(positions, lambda x: x - 1)))
    return F.zip_with(starts, ends, lambda s, e: F.struct(s.alias("start"), (e - s + 1).alias("length")))


def outside(items: Column, removed: Column) -> Column:
    """The items whose position is in none of the runs (null: no run), in linear time."""
    gone = F.flatten(F.transform(removed, lambda r: F.sequence(r["start"], r["start"] + r["length"] - 1)))

    def kept(each: Column) -> Column:
        # An index past the end yields null, so the empty list needs no case of its own.
        places = F.array_except(F.sequence(F.lit(0), F.greatest(F.size(each) - 1, F.lit(0))), gone)
        return F.transform(places, lambda i: F.get(each, i))

    return F.when(F.coalesce(F.size(removed), F.lit(0)) <= 0, items).otherwise(bound(items, kept))
