"""Conversations as training text, with a loss flag on every segment."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ChatTemplate:
    """How turns are written, which roles carry loss, and which role may follow which.

    ``turns`` is the state machine: the state is the role of the last turn, at
    first ``start``; it names the roles that may come next.  A conversation may
    end in any state of ``final``.
    """

    opening: str = "<|im_start|>"
    after_role: str = "\n"
    closing: str = "<|im_end|>\n"
    control: str = "<|"
    loss_roles: tuple[str, ...] = ("assistant",)
    turns: dict[str, tuple[str, ...]] = field(
        default_factory=lambda: {
            "start": ("system", "user"),
            "system": ("user",),
            "user": ("assistant",),
            "assistant": ("user",),
        }
    )
    final: tuple[str, ...] = ("user", "assistant")


CHAT = ChatTemplate()


def escape(text: Column, template: ChatTemplate = CHAT, line: bool = False) -> Column:
    r"""The text without any control string: ``\`` doubled, ``<|`` as ``<\|``; in a line also ``\n`` as ``<\n``.

    A single ``\`` between ``<`` and ``|`` (or ``n``) arises no other way, so
    ``unescape`` gives back exactly what was.
    """
    first, rest = template.control[0], template.control[1:]
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    text = F.replace(text, F.lit(template.control), F.lit(f"{first}\\{rest}"))
    return F.replace(text, F.lit("\n"), F.lit(f"{first}\\n")) if line else text


def unescape(text: Column, template: ChatTemplate = CHAT, line: bool = False) -> Column:
    first, rest = template.control[0], template.control[1:]
    if line:
        text = F.replace(text, F.lit(f"{first}\\n"), F.lit("\n"))
    text = F.replace(text, F.lit(f"{first}\\{rest}"), F.lit(template.control))
    return F.replace(text, F.lit("\\\\"), F.lit("\\"))


def _next_state(state: Column, role: Column, template: ChatTemplate) -> Column:
    """The role, if it may follow; else the state of error, which nothing leaves."""
    allowed = [
        (state == before) & role.isin(*after) for before, after in template.turns.items() if after
    ]
    return F.when(reduce(lambda a, b: a | b, allowed, F.lit(False)), role).otherwise(F.lit("error"))


def format_chats(
    turns: DataFrame,
    template: ChatTemplate = CHAT,
    conv_id: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
) -> DataFrame:
    """One row per conversation: ``segments`` of text with loss flags, ``formatted``, ``valid``.

    Every turn gives three segments: its heading, its text and its end; only
    texts of ``loss_roles`` carry loss.  ``formatted`` is all of them joined.
    ``valid`` says whether the order of roles is one the template allows;
    conversations that are not are formatted all the same.

    Rows are ordered by turn (nulls first), ties by role and text.  Null roles
    and texts count as empty, repeated rows are repeated turns, rows without a
    conversation form one.  Other columns of the input are not used.
    """
    rows = turns.select(
        F.col(conv_id).alias("conv_id"),
        F.struct(
            F.col(turn).alias("turn"),
            F.coalesce(F.col(role), F.lit("")).alias("role"),
            F.coalesce(F.col(text), F.lit("")).alias("text"),
        ).alias("one"),
    )
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("one")).alias("turns"))

    def segments(one: Column) -> Column:
        segment = lambda value, loss: F.struct(value.alias("text"), loss.alias("loss"))
        heading = F.concat(
            F.lit(template.opening), escape(one["role"], template, line=True), F.lit(template.after_role)
        )
        return F.array(
            segment(heading, F.lit(False)),
            segment(escape(one["text"], template), one["role"].isin(*template.loss_roles)),
            segment(F.lit(template.closing), F.lit(False)),
        )

    state = F.aggregate(
        "turns", F.lit("start"), lambda state, one: _next_state(state, one["role"], template)
    )
    return (
        whole.select("conv_id", F.flatten(F.transform("turns", segments)).alias("segments"), state.alias("state"))
        .withColumn("valid", F.col("state").isin(*template.final))
        .withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))
        .select("conv_id", "segments", "formatted", "valid")
    )


def read_turns(formatted: Column, template: ChatTemplate = CHAT) -> Column:
    """The turns of a formatted conversation, as an array of role and text."""
    pieces = F.split(formatted, f"\\Q{template.opening}\\E", -1)

    def turn(piece: Column) -> Column:
        role = F.substring_index(piece, template.after_role, 1)
        skip = F.length(role) + len(template.after_role)
        body = F.substring(piece, skip + 1, F.length(piece) - skip - len(template.closing))
        return F.struct(
            unescape(role, template, line=True).alias("role"), unescape(body, template).alias("text")
        )

    return F.transform(F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0))), turn)


def loss_text(segments: Column, template: ChatTemplate = CHAT) -> Column:
    """All text under the loss mask, as it was before escaping."""
    masked = F.filter(segments, lambda s: s["loss"])
    return F.array_join(F.transform(masked, lambda s: unescape(s["text"], template)), "")
