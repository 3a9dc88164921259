"""Chat formatting: a finite-state machine over roles and a declarative template.

Everything here is DataFrame functions; nothing runs in Python.

Defined results: a null text or role counts as the empty string; rows of one
conversation are ordered by turn (nulls first), then role, then text, and
repeated rows are turns of their own; a conversation whose roles the machine
does not accept is formatted all the same and carries ``valid = false`` and the
position of its first bad turn; an unknown role is written with the template's
generic markers; an empty table gives an empty result; other columns are not
looked at, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Turn:
    """How one role is written; ``loss`` says whether its text is trained on."""

    open: str
    close: str
    loss: bool = False


@dataclass(frozen=True)
class ChatTemplate:
    """Markers per role and the machine over roles.

    ``moves[state][role]`` is the next state. Control strings start with a
    character that stands nowhere else in any of them, so neither a text next to
    a marker nor two overlapping ones can form another; this is checked.
    """

    roles: Mapping[str, Turn] = field(
        default_factory=lambda: {
            "system": Turn("[SYS]", "[/SYS]"),
            "user": Turn("[INST]", "[/INST]"),
            "assistant": Turn("<s>", "</s>", loss=True),
        }
    )
    other: tuple[str, str, str] = ("[ROLE]", "[:]", "[/ROLE]")
    start: str = "start"
    moves: Mapping[str, Mapping[str, str]] = field(
        default_factory=lambda: {
            "start": {"system": "primed", "user": "asked"},
            "primed": {"user": "asked"},
            "asked": {"assistant": "answered"},
            "answered": {"user": "asked"},
        }
    )
    accept: tuple[str, ...] = ("answered",)

    def __post_init__(self) -> None:
        heads = {c[0] for c in self.controls}
        if any(set(c[1:]) & heads or "\\" in c or len(c) < 2 for c in self.controls) or len(set(self.controls)) < len(self.controls):
            raise ValueError("control strings must differ, hold no backslash and start with a character that no other place of them holds")

    @property
    def controls(self) -> list[str]:
        return [x for t in self.roles.values() for x in (t.open, t.close)] + list(self.other)

    @property
    def closers(self) -> list[str]:
        return [t.close for t in self.roles.values()] + [self.other[2]]


def escape(text: Column, template: ChatTemplate) -> Column:
    """A backslash goes after each backslash and after the first character of each control string."""
    rests: dict[str, list[str]] = {}
    for c in template.controls:
        rests.setdefault(c[0], []).append(re.escape(c[1:]))
    heads = [rf"{re.escape(h)}(?={'|'.join(r)})" for h, r in rests.items()]
    return F.regexp_replace(text, "(" + "|".join([r"\\", *heads]) + ")", r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _by_role(role: Column, template: ChatTemplate, known, other: Column) -> Column:
    out = None
    for name, turn in template.roles.items():
        out = (F if out is None else out).when(role == name, F.lit(known(turn)))
    return other if out is None else out.otherwise(other)


def _walk(roles: Column, template: ChatTemplate) -> Column:
    """Runs the machine: its last state and the position of the first turn it refuses."""
    pairs = [x for s, row in template.moves.items() for r, t in row.items() for x in (F.lit(f"{s}\n{r}"), F.lit(t))]
    table = F.create_map(*pairs)
    first = F.struct(F.lit(template.start).alias("state"), F.lit(0).alias("at"), F.lit(None).cast("int").alias("bad"))

    def step(acc: Column, role: Column) -> Column:
        to = F.element_at(table, F.concat(acc["state"], F.lit("\n"), role))
        return F.struct(
            F.coalesce(to, F.lit("refused")).alias("state"),
            (acc["at"] + 1).alias("at"),
            F.when(acc["bad"].isNull() & to.isNull(), acc["at"]).otherwise(acc["bad"]).alias("bad"),
        )

    return F.aggregate(roles, first, step)


def format_conversations(df: DataFrame, template: ChatTemplate | None = None, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: ``conv``, ``valid``, ``first_bad_turn``, ``segments``, ``formatted``.

    ``segments`` is an array of (text, loss) in output order; their texts joined are ``formatted``.
    """
    template = template or ChatTemplate()
    rows = df.select(
        F.col(conv).alias("conv_id"),
        F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")).alias("row"),
    )
    talks = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("row")).alias("rows"))
    opener, sep, closer = template.other

    def write(t: Column) -> Column:
        role_, no = t["role"], F.lit(False)
        head = _by_role(role_, template, lambda k: k.open, F.concat(F.lit(opener), escape(role_, template), F.lit(sep)))
        return F.array(
            F.struct(head.alias("text"), no.alias("loss")),
            F.struct(escape(t["text"], template).alias("text"), _by_role(role_, template, lambda k: k.loss, no).alias("loss")),
            F.struct(_by_role(role_, template, lambda k: k.close, F.lit(closer)).alias("text"), no.alias("loss")),
        )

    out = talks.select("conv_id", _walk(F.transform("rows", lambda t: t["role"]), template).alias("end"), F.flatten(F.transform("rows", write)).alias("segments"))
    return out.select(
        F.col("conv_id").alias(conv),
        (F.col("end.state").isin(*template.accept) & F.col("end.bad").isNull()).alias("valid"),
        F.col("end.bad").alias("first_bad_turn"),
        "segments",
        F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
    )


def parse_formatted(formatted: Column, template: ChatTemplate | None = None) -> Column:
    """The turns of a formatted conversation: an array of (role, text), the inverse of the formatting."""
    template = template or ChatTemplate()
    opener, sep, _ = template.other
    pieces = F.split(formatted, "|".join(re.escape(c) for c in template.closers), -1)

    def read(piece: Column) -> Column:
        rest = F.substr(piece, F.lit(len(opener) + 1))
        raw = F.substring_index(rest, sep, 1)
        role, body = unescape(raw), F.substr(rest, F.length(raw) + len(sep) + 1)
        for name, turn in template.roles.items():
            here = F.startswith(piece, F.lit(turn.open))
            role, body = F.when(here, F.lit(name)).otherwise(role), F.when(here, F.substr(piece, F.lit(len(turn.open) + 1))).otherwise(body)
        return F.struct(role.alias("role"), unescape(body).alias("text"))

    return F.transform(F.slice(pieces, 1, F.size(pieces) - 1), read)


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
