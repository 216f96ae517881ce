"""Join of rows with a start and an end to the window that holds them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runsight.operators.skew import find_hot_groups, join_salted

_NO_SLOT = -(2**62)

BROADCAST_WINDOWS = 100_000
"""Most listed windows that are sent to every executor, by default."""

MOST_SLOTS = 1_000
"""Most slots that one window is listed in, by default."""


def attach_window(
    facts: DataFrame,
    windows: DataFrame,
    *,
    on: Mapping[str, str],
    start: str,
    end: str,
    window_start: str,
    window_end: str,
    grace: int = 0,
    slot: int | None = None,
    split_rows: int | None = None,
    drop: Sequence[str] = (),
    broadcast_windows: int = BROADCAST_WINDOWS,
    most_slots: int = MOST_SLOTS,
) -> DataFrame:
    """Inner join where the keys are equal, `start` >= `window_start` and `end` <= `window_end` + `grace`.

    Bounds are numbers of one unit, such as epoch milliseconds. A row in several windows appears several times.
    `drop` names columns of `windows` to leave out.

    With `slot`, time is cut into slots of that length and the slot becomes a join key: each window is listed once
    per slot it covers, and a row only meets the windows of the slot it starts in. Use it where one key has many
    windows; without it each row is compared with all windows of its key. A window that covers more than `most_slots`
    slots, for instance by a wrong clock, isn't listed; all rows of its key meet it.

    With `split_rows`, the listed windows are counted first, and broadcast if they are at most `broadcast_windows`. If there
    are more, rows are counted per join key: keys with more rows than `split_rows` meet their windows by broadcast as long
    as these are few, else by a join that cuts each key into parts, so that no task gets all rows of such a key.
    """
    clash = (set(facts.columns) & set(windows.columns)) - set(drop)
    if clash:
        raise ValueError(f"columns on both sides: {sorted(clash)}")
    kept = [name for name in windows.columns if name not in drop]
    windows = windows.select(*kept)
    inside = (F.col(start) >= F.col(window_start)) & (F.col(end) <= F.col(window_end) + F.lit(grace))
    fact_keys, window_keys = list(on), list(on.values())
    if slot is None:
        return _join(facts, windows, fact_keys, window_keys, inside, split_rows, slot, broadcast_windows)
    slots = F.floor((F.col(window_end) + F.lit(grace)) / F.lit(slot)) - F.floor(F.col(window_start) / F.lit(slot)) + 1
    is_long = F.coalesce(slots > most_slots, F.lit(False))
    long = windows.filter(is_long)
    slotted, listed = _with_slots(facts, windows.filter(~is_long), start, end, window_start, window_end, grace, slot)
    joined = _join(
        slotted, listed, [*fact_keys, "_slot"], [*window_keys, "_window_slot"], inside, split_rows, slot, broadcast_windows
    ).drop("_slot", "_window_slot")
    if not long.limit(1).count():
        return joined
    return joined.unionByName(_join(facts, long, fact_keys, window_keys, inside, split_rows, slot, broadcast_windows))


def _join(facts, windows, fact_keys, window_keys, inside, split_rows, slot, broadcast_windows) -> DataFrame:
    for fact_key, window_key in zip(fact_keys, window_keys):
        inside = (F.col(fact_key) == F.col(window_key)) & inside
    if split_rows is None:
        return facts.join(_shuffled(windows, slot), inside)
    if _few(windows, broadcast_windows):
        return facts.join(F.broadcast(windows), inside)
    return _join_split(facts, windows, fact_keys, window_keys, inside, split_rows, slot, broadcast_windows)


def _few(windows: DataFrame, most: int) -> bool:
    return windows.limit(most + 1).count() <= most


def _shuffled(windows: DataFrame, slot: int | None) -> DataFrame:
    """Spark's size estimate doesn't see that a window is listed in many slots, so it must not broadcast by it."""
    return windows if slot is None else windows.hint("merge")


def _join_split(
    facts: DataFrame,
    windows: DataFrame,
    fact_keys: Sequence[str],
    window_keys: Sequence[str],
    inside: Column,
    split_rows: int,
    slot: int | None,
    broadcast_windows: int,
) -> DataFrame:
    hot = find_hot_groups(facts, fact_keys, split_rows)
    if not hot:
        return facts.join(_shuffled(windows, slot), inside)
    if not hot.complete:
        return join_salted(facts, windows, inside, hint="merge")
    of_windows = replace(hot, keys=tuple(window_keys))
    hot_windows, hot_facts = of_windows.rows_of(windows), hot.rows_of(facts)
    other = hot.other_rows_of(facts).join(_shuffled(of_windows.other_rows_of(windows), slot), inside)
    few = _few(hot_windows, broadcast_windows)
    large = hot_facts.join(F.broadcast(hot_windows), inside) if few else join_salted(hot_facts, hot_windows, inside, hint="merge")
    return large.unionByName(other)


def _with_slots(
    facts: DataFrame,
    windows: DataFrame,
    start: str,
    end: str,
    window_start: str,
    window_end: str,
    grace: int,
    slot: int,
) -> tuple[DataFrame, DataFrame]:
    def slot_of(value):
        return F.floor(value / F.lit(slot))

    # A row that ends before it starts may fit a window that is over when it starts: it meets all windows of its key.
    fact_slot = F.when(F.col(end) < F.col(start), F.lit(_NO_SLOT)).otherwise(slot_of(F.col(start)))
    last = F.col(window_end) + F.lit(grace)
    covered = F.when(
        F.col(window_start) <= last, F.sequence(slot_of(F.col(window_start)), slot_of(last))
    ).otherwise(F.array().cast("array<bigint>"))
    slots = F.concat(F.array(F.lit(_NO_SLOT).cast("bigint")), covered)
    return facts.withColumn("_slot", fact_slot), windows.withColumn("_window_slot", F.explode(slots))


def attach_stages(
    tasks: DataFrame,
    stages: DataFrame,
    grace_ms: int = 30_000,
    slot_ms: int | None = 3_600_000,
    split_rows: int | None = 5_000_000,
    **limits: int,
) -> DataFrame:
    """Each task with the stage it ran in. Stage ids are reused, so the times decide between them.

    A task may be reported a little after its stage, hence the grace. May count tasks first: pass stored tables.
    `limits` are `broadcast_windows` and `most_slots` of `attach_window`.
    """
    return attach_window(
        tasks,
        stages,
        on={"cluster_id": "stage__cluster_id", "stage_id": "stage__id"},
        start="task_launch_time",
        end="task_finish_time",
        window_start="stage__submission_time",
        window_end="stage__completion_time",
        grace=grace_ms,
        slot=slot_ms,
        split_rows=split_rows,
        drop=("event_time",),
        **limits,
    )
