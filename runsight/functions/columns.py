from __future__ import annotations

import re
import string
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Listed one by one: Java looks these up in a table, but tests the ranges `a-z`, `A-Z` and `0-9` in turn, which takes six times as long.
OUTSIDE_NAME = f"[^{string.ascii_letters}{string.digits}_]+"


def _column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def canonical_name(value: Column | str) -> Column:
    """Turn a display name into a column name: other characters become one `_`, then lower case."""
    return F.lower(F.regexp_replace(_column(value), OUTSIDE_NAME, "_"))


def canonical_text(name: str) -> str:
    """`canonical_name` for a name known while the plan is built."""
    return re.sub(OUTSIDE_NAME, "_", name).lower()


def from_epoch_ms(value: Column | str) -> Column:
    return F.timestamp_millis(_column(value).cast("bigint"))


def format_epoch_ms(value: Column | str) -> Column:
    return F.date_format(from_epoch_ms(value), "yyyy-MM-dd HH:mm:ss")


def whole_units_between(unit: str, start: Column | str, end: Column | str) -> Column:
    """Whole units from `start` to `end`, both timestamps."""
    if unit.upper() not in {"SECOND", "MINUTE", "HOUR", "DAY"}:
        raise ValueError(f"unsupported unit {unit!r}")
    return F.timestamp_diff(unit.upper(), _column(start), _column(end))


def pct(part: Column | str, whole: Column | str) -> Column:
    """`part` as a percentage of `whole`; NULL where `whole` is 0."""
    return F.try_divide(_column(part) * F.lit(100), _column(whole))


def total_of(names: Sequence[str]) -> str:
    """Sum of columns as SQL text: a balanced tree, so that hundreds of terms stay a shallow expression."""
    terms = [f"`{name}`" for name in names] or ["0"]
    while len(terms) > 1:
        paired = [f"({a} + {b})" for a, b in zip(terms[::2], terms[1::2])]
        terms = paired + terms[len(paired) * 2 :]
    return terms[0]
