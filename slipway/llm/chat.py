"""Chat formatting with DataFrame functions only: a state machine over roles, and text segments with loss flags.

A template is data: per role an opening and a closing control string and whether its text is trained on, and the
allowed turn orders. Control strings inside texts are escaped, so the formatted text can be read back exactly.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F


@dataclass(frozen=True)
class Template:
    #: role -> (opening, closing, trained on)
    roles: dict[str, tuple[str, str, bool]]
    #: (state, role) -> state; everything else is an error. The first state is "start".
    order: dict[tuple[str, str], str]
    #: opening, end of the role's name, closing of turns with any other role
    other: tuple[str, str, str] = ("[ROLE]", "[:]", "[/ROLE]")
    controls: tuple[str, ...] = field(init=False)

    def __post_init__(self):
        controls = tuple(c for a, b, _ in self.roles.values() for c in (a, b)) + self.other
        for c in controls:
            if len(c) < 2 or "\\" in c:
                raise ValueError(f"control string {c!r} must have two characters or more and no backslash")
            for d in controls:
                if c != d and c in d or any(d.startswith(c[k:]) for k in range(1, len(c))):
                    raise ValueError(f"control strings {c!r} and {d!r} overlap")
        object.__setattr__(self, "controls", controls)


INSTRUCT = Template(
    roles={"system": ("<<SYS>>", "<</SYS>>", False), "user": ("[INST]", "[/INST]", False),
           "assistant": ("<s>", "</s>", True)},
    order={("start", "system"): "system", ("start", "user"): "user", ("system", "user"): "user",
           ("user", "assistant"): "assistant", ("assistant", "user"): "user"})


def escape(text: Column, template: Template) -> Column:
    """Double every backslash, then put one after the first character of every control string."""
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in template.controls:
        text = F.replace(text, F.lit(c), F.lit(c[0] + "\\" + c[1:]))
    return text


def unescape(text: Column, template: Template) -> Column:
    """The inverse of ``escape``: single backslashes stand in control strings only, others come in pairs."""
    for c in template.controls:
        text = F.replace(text, F.lit(c[0] + "\\" + c[1:]), F.lit(c))
    return F.replace(text, F.lit("\\\\"), F.lit("\\"))


def _segments(turn: Column, t: Template) -> Column:
    def piece(text: Column, loss: bool) -> Column:
        return F.struct(text.alias("text"), F.lit(loss).alias("loss"))

    opening, named, closing = t.other
    out = F.array(piece(F.concat(F.lit(opening), escape(turn["role"], t), F.lit(named)), False),
                  piece(escape(turn["text"], t), False), piece(F.lit(closing), False))
    for role, (a, b, trained) in t.roles.items():
        known = F.array(piece(F.lit(a), False), piece(escape(turn["text"], t), trained), piece(F.lit(b), False))
        out = F.when(turn["role"] == role, known).otherwise(out)
    return out


def format_chats(turns: DataFrame, template: Template = INSTRUCT, id_col: str = "conv_id", turn_col: str = "turn",
                 role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: conv_id, n_turns, segments (text, loss), formatted, valid, bad_turn.

    ``segments`` joined are ``formatted``; ``loss`` marks the texts of trained roles. ``valid`` says whether the state
    machine accepts the order of roles, ``bad_turn`` is the position (from 0) of the first turn it rejects. Invalid
    conversations are formatted all the same.

    Turns are ordered by turn, then role, then text, so ties and repeated rows have one order and all are kept. A null
    text is empty, a null role is the role with the empty name, null turns come first, and rows with a null
    conversation id form one conversation. An empty table gives no rows. Other columns are not read.
    """
    row = F.struct(F.col(turn_col).alias("turn"), F.coalesce(role_col, F.lit("")).alias("role"),
                   F.coalesce(text_col, F.lit("")).alias("text"))
    chats = turns.groupBy(F.col(id_col).alias("conv_id")).agg(F.sort_array(F.collect_list(row)).alias("turns"))
    table = F.create_map(*[F.lit(x) for (state, role), to in template.order.items()
                           for x in (f"{state}\n{role}", to)])
    walk = F.aggregate(
        "turns", F.struct(F.lit("start").alias("state"), F.lit(0).alias("at"), F.lit(-1).alias("bad")),
        lambda s, r: F.struct(
            F.coalesce(F.try_element_at(table, F.concat(s["state"], F.lit("\n"), r["role"])), F.lit("error")).alias("state"),
            (s["at"] + 1).alias("at"),
            F.when((s["bad"] < 0) & F.try_element_at(table, F.concat(s["state"], F.lit("\n"), r["role"])).isNull(),
                   s["at"]).otherwise(s["bad"]).alias("bad")))
    made = chats.withColumn("walk", walk).withColumn(
        "segments", F.flatten(F.transform("turns", lambda r: _segments(r, template))))
    return made.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), "segments",
        F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
        (F.col("walk.bad") < 0).alias("valid"), F.when(F.col("walk.bad") >= 0, F.col("walk.bad")).alias("bad_turn"))


def read_back(formatted: Column, template: Template = INSTRUCT) -> Column:
    """The turns of a formatted conversation: array of (role, text)."""
    pairs = [(a, b) for a, b, _ in template.roles.values()] + [(template.other[0], template.other[2])]
    pattern = "(?s)(" + "|".join(f"{_quote(a)}.*?{_quote(b)}" for a, b in pairs) + ")"

    def turn(t: Column) -> Column:
        opening, named, closing = template.other
        at = F.instr(t, F.lit(named))
        out = F.struct(
            unescape(F.substring(t, F.lit(len(opening) + 1), at - 1 - len(opening)), template).alias("role"),
            unescape(F.substring(t, at + len(named), F.length(t) - at - len(named) - len(closing) + 1), template).alias("text"))
        for role, (a, b, _) in template.roles.items():
            body = F.substring(t, F.lit(len(a) + 1), F.length(t) - len(a) - len(b))
            out = F.when(F.startswith(t, F.lit(a)), F.struct(
                F.lit(role).alias("role"), unescape(body, template).alias("text"))).otherwise(out)
        return out

    return F.transform(F.regexp_extract_all(formatted, F.lit(pattern), F.lit(1)), turn)


def loss_text(segments: Column, template: Template = INSTRUCT) -> Column:
    """All text under the loss mask, unescaped, in order and without anything between."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]),
                                    lambda s: unescape(s["text"], template)), "")


def _quote(s: str) -> str:
    return re.sub(r"([^A-Za-z0-9])", r"\\\1", s)
