"""Test streams and the progress of streaming queries as tables."""

from runsight.streaming.counters import count_events, event_totals
from runsight.streaming.joins import attach_stages_stream, event_log_stream
from runsight.streaming.progress import (
    PROGRESS_SCHEMA,
    ProgressLog,
    batch_counts,
    collect_progress,
    event_counts,
    parse_progress,
    progress_by_query,
    progress_key,
    progress_table,
    register,
    unregister,
)
from runsight.streaming.streams import event_stream, rate_stream, run_counted, run_kept

__all__ = [
    "PROGRESS_SCHEMA",
    "ProgressLog",
    "attach_stages_stream",
    "batch_counts",
    "collect_progress",
    "count_events",
    "event_counts",
    "event_log_stream",
    "event_stream",
    "event_totals",
    "parse_progress",
    "progress_by_query",
    "progress_key",
    "progress_table",
    "rate_stream",
    "register",
    "run_counted",
    "run_kept",
    "unregister",
]
