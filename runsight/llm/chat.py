"""Formats conversations by a declarative template and a finite-state machine over roles.

Everything is an expression over a conversation's sorted turns: the machine is a fold over the roles, the template a map over the
turns. A conversation is one output row, so its turns meet in one task; nothing else does.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, BROKEN = "start", "broken"


@dataclass(frozen=True)
class Template:
    """How turns are written and which of them count for the loss.

    A turn is `turn_start`, the role, a newline, the text, `turn_end`. `order` lists the roles that may follow each role, and those
    that may begin; `final` those that may end a conversation. `control` are the strings that texts must not hold; each gets the
    escape sign after its first character, and the sign itself is doubled.
    """

    turn_start: str = "<|im_start|>"
    turn_end: str = "<|im_end|>\n"
    escape: str = "\\"
    loss_roles: Sequence[str] = ("assistant",)
    order: Mapping[str, Sequence[str]] = field(
        default_factory=lambda: {START: ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}
    )
    final: Sequence[str] = ("assistant",)
    control: Sequence[str] = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")


CHAT = Template()


def escaped(text: Column, template: Template = CHAT) -> Column:
    out = F.replace(text, F.lit(template.escape), F.lit(template.escape * 2))
    for sign in template.control:
        out = F.replace(out, F.lit(sign), F.lit(sign[0] + template.escape + sign[1:]))
    return out


def escaped_role(role: Column, template: Template = CHAT) -> Column:
    return F.replace(escaped(role, template), F.lit("\n"), F.lit(template.escape + "\n"))


def unescaped(text: Column, template: Template = CHAT) -> Column:
    return F.regexp_replace(text, rf"(?s)\Q{template.escape}\E(.)", "$1")


def _state(state: Column, role: Column, template: Template) -> Column:
    """The machine's step: the role is the next state if it may follow."""
    after = F.lit(False)
    for known, following in template.order.items():
        after = after | ((state == known) & role.isin(*following))
    return F.when(after, role).otherwise(F.lit(BROKEN))


def format_conversations(turns: DataFrame, template: Template = CHAT) -> DataFrame:
    """One row per conversation: conv_id, n_turns, valid, segments (text and loss flag), formatted (the segments' texts in order).

    `turns` has conv_id, turn, role, text; turns are ordered by turn, then role and text, nulls first. A null text or role is empty.
    Rows without conv_id are one conversation. Repeated rows are repeated turns. `valid` is what the machine says of the order of
    roles; a conversation in bad order is formatted as well, so the caller decides. Empty tables give no rows.
    """
    known = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    grouped = known.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("_turns"))
    last = F.aggregate("_turns", F.lit(START), lambda state, t: _state(state, t["role"], template))

    def segments(t: Column) -> Column:
        head = F.concat(F.lit(template.turn_start), escaped_role(t["role"], template), F.lit("\n"))
        parts = ((head, F.lit(False)), (escaped(t["text"], template), t["role"].isin(*template.loss_roles)), (F.lit(template.turn_end), F.lit(False)))
        return F.array(*[F.struct(text.alias("text"), loss.alias("loss")) for text, loss in parts])

    formed = grouped.select(
        "conv_id", F.size("_turns").cast("long").alias("n_turns"), last.isin(*template.final).alias("valid"), F.flatten(F.transform("_turns", segments)).alias("segments")
    )
    return formed.withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def read_turns(formatted: Column, template: Template = CHAT) -> Column:
    """The turns (role, text) of a formatted conversation, as they were."""
    pieces = F.filter(F.split(formatted, rf"\Q{template.turn_end}\E", -1), lambda p: p != "")
    sign = rf"\Q{template.escape}\E"
    turn = rf"(?s)^\Q{template.turn_start}\E((?:(?!{sign})[^\n]|{sign}.)*+)\n(.*)$"
    return F.transform(
        pieces,
        lambda p: F.struct(
            unescaped(F.regexp_extract(p, turn, 1), template).alias("role"), unescaped(F.regexp_extract(p, turn, 2), template).alias("text")
        ),
    )


def loss_text(segments: Column, template: Template = CHAT) -> Column:
    """All text under the loss mask, as it was before escaping."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescaped(s["text"], template)), "")
