"""Small column helpers shared by the operators."""

from runsight.functions.columns import (
    canonical_name,
    canonical_text,
    format_epoch_ms,
    from_epoch_ms,
    pct,
    total_of,
    whole_units_between,
)

__all__ = [
    "canonical_name",
    "canonical_text",
    "format_epoch_ms",
    "from_epoch_ms",
    "pct",
    "total_of",
    "whole_units_between",
]
