"""Chat formatting: turns to one marked text, with a loss flag per segment, and back.

A declarative template gives each role its marks and its loss flag, and the
finite-state machine of allowed turn orders. Formatting yields segments
(text, loss flag) whose concatenation is the formatted text. Control strings
inside texts are escaped: backslashes are doubled and one backslash is put
after the first character of each control string, so no control string of the
template ever stands inside a text and the original is read back exactly.

Everything is DataFrame expressions. The turns of one conversation are one
ordered list, since they become one text; nothing else is grouped.

Null texts and null roles count as empty strings. Roles that the template does
not know are written with the generic marks and make the conversation invalid.
Turns with the same number are ordered by role and text; repeated rows are
turns of their own. Null conversation ids form one conversation. An empty table
gives an empty table. Other columns of the input are not carried, whatever
their names.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Turn:
    """Marks before and after the text of a role, and whether its text counts for the loss."""

    before: str
    after: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    turns: dict[str, Turn]
    #: Strings that must not occur in texts.
    controls: tuple[str, ...]
    #: State -> roles that may follow; a state is the role of the last turn, the start is "".
    follows: dict[str, tuple[str, ...]]
    #: States in which a conversation may end.
    ends: tuple[str, ...]
    #: Marks of any other role: before the role, between role and text, after the text.
    other: tuple[str, str, str] = field(default=("[ROLE]", "[/ROLE] ", " [/TURN]"))

    def __post_init__(self):
        marks = [m for t in self.turns.values() for m in (t.before, t.after)] + list(self.other)
        if any("\\" in c or len(c) < 2 for c in self.controls):
            raise ValueError("control strings have two characters at least and no backslash")
        if any(not any(c in m for c in self.controls) for m in (*[t.after for t in self.turns.values()], *self.other)):
            raise ValueError("what ends a text must hold a control string")
        if any("\\" in m for m in marks):
            raise ValueError("marks have no backslash")


INSTRUCT = Template(
    turns={
        "system": Turn("<<SYS>>\n", "\n<</SYS>>\n\n"),
        "user": Turn("<s>[INST] ", " [/INST]"),
        "assistant": Turn(" ", " </s>", loss=True),
    },
    controls=("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE]", "[/ROLE]", "[/TURN]"),
    follows={"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)},
    ends=("assistant",),
)


def escape(text: Column, template: Template) -> Column:
    begins = "|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in template.controls)
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), f"({begins})", r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def _segments(turn: Column, t: Template) -> Column:
    """The segments of one turn (role, text): marks, text, marks."""

    def piece(text: Column, loss: bool) -> Column:
        return F.struct(text.alias("text"), F.lit(loss).alias("loss"))

    text = escape(turn["text"], t)
    a, b, c = (F.lit(x) for x in t.other)
    out = F.array(piece(F.concat(a, escape(turn["role"], t), b), False), piece(text, False), piece(c, False))
    for role, marks in t.turns.items():
        own = F.array(piece(F.lit(marks.before), False), piece(text, marks.loss), piece(F.lit(marks.after), False))
        out = F.when(turn["role"] == role, own).otherwise(out)
    return out


def _state(turns: Column, t: Template) -> Column:
    """The machine's last state, or "!" after a turn that may not follow."""

    def step(state: Column, turn: Column) -> Column:
        moves = F.lit(False)
        for before, roles in t.follows.items():
            moves = moves | ((state == before) & turn["role"].isin(*roles))
        return F.when(moves, turn["role"]).otherwise(F.lit("!"))

    return F.aggregate(turns, F.lit(""), step)


def format_conversations(df: DataFrame, template: Template = INSTRUCT, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: ``conv``, ``formatted``, ``segments`` (text, loss) and ``valid``."""
    rows = df.select(
        F.col(conv).alias(conv),
        F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")).alias("turn"),
    )
    turns = rows.groupBy(conv).agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    segments = turns.select(
        conv,
        F.flatten(F.transform("turns", lambda x: _segments(x, template))).alias("segments"),
        _state(F.col("turns"), template).isin(*template.ends).alias("valid"),
    )
    return segments.select(conv, F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments", "valid")


def read_back(formatted: Column, template: Template = INSTRUCT) -> Column:
    """The turns (role, text) that a formatted text holds, as an array."""
    a, b, c = template.other
    forms = [f"{re.escape(m.before)}.*?{re.escape(m.after)}" for m in template.turns.values()] + [f"{re.escape(a)}.*?{re.escape(c)}"]
    found = F.regexp_extract_all(formatted, F.lit(f"(?s)({'|'.join(forms)})"), F.lit(1))

    def inner(x: Column, before: str, after: str) -> Column:
        return F.substring(x, F.lit(len(before) + 1), F.length(x) - F.lit(len(before) + len(after)))

    def parse(x: Column) -> Column:
        both = inner(x, a, c)
        at = F.instr(both, b)
        out = F.struct(
            unescape(F.substring(both, F.lit(1), at - 1)).alias("role"),
            unescape(F.substring(both, at + len(b), F.length(both))).alias("text"),
        )
        for role, m in template.turns.items():
            own = F.struct(F.lit(role).alias("role"), unescape(inner(x, m.before, m.after)).alias("text"))
            out = F.when(F.startswith(x, F.lit(m.before)), own).otherwise(out)
        return out

    return F.transform(found, parse)


def loss_text(segments: Column) -> Column:
    """The unescaped text under the loss mask."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
