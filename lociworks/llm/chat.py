"""Chat formatting with loss flags (operator 10). DataFrame functions only.

A finite-state machine over roles checks the order of turns; a declarative
template turns each conversation into text segments, each with a flag that says
whether it counts in the training loss. Control strings that occur inside texts
are escaped, so the formatted text can be read back exactly.

Escaping: a control string is a lead character and a rest without one. Wherever
a lead character, any number of backslashes and such a rest stand in a text,
one backslash is added after the lead character; reading back removes one. So
no text can hold a bare control string, and none can arise where a text meets
a mark.

Rows are ordered by turn, then role, then text, nulls first; repeated rows are
repeated turns. A null text is the empty text, a null role the empty role.
Roles the template doesn't know are written out between marks of their own and
make the conversation invalid; so does a turn order that the machine doesn't
allow. Invalid conversations are formatted and flagged, not dropped. Rows with a
null conv_id are one conversation, whose id is null. An empty
table gives no rows; extra columns are ignored. A conversation is one row of
the result, so its turns meet in one task; conversations are dealt by their id.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table


@dataclass(frozen=True)
class Marks:
    """How turns of one role begin and end, and whether their text is trained on."""

    open: str
    close: str
    loss: bool = False


@dataclass(frozen=True)
class ChatTemplate:
    roles: dict[str, Marks]
    #: Around the name of a role that isn't among roles, and after its text.
    other: tuple[str, str, str] = ("[ROLE]", "[/ROLE]", "[/TURN]")
    #: For each state the roles that may follow; a turn's role is the next state.
    turns: dict[str, tuple[str, ...]] = field(default_factory=dict)
    start: str = "start"
    accept: tuple[str, ...] = ()

    def __post_init__(self):
        leads = {c[0] for c in self.controls}
        for c in self.controls:
            if len(c) < 2 or c[0] in "\\$" or leads & {*c[1:]} or "\\" in c:
                raise ValueError(f"control string {c!r}: it needs a lead character that no control string has in its rest, and no backslash")

    @property
    def controls(self) -> list[str]:
        return [*(x for m in self.roles.values() for x in (m.open, m.close)), *self.other]

    def _pattern(self, slashes: str) -> str:
        leads = "".join(sorted({re.escape(c[0]) for c in self.controls}))
        rests = "|".join(sorted({_quoted(c[1:]) for c in self.controls}))
        return f"([{leads}]){slashes}(\\\\*)({rests})"

    def escape(self, text: Column) -> Column:
        return F.regexp_replace(text, self._pattern(""), r"$1\\$2$3")

    def unescape(self, text: Column) -> Column:
        return F.regexp_replace(text, self._pattern(r"\\"), "$1$2$3")


def _quoted(s: str) -> str:
    return re.sub(r"([^\w\s])", r"\\\1", s)


#: User and system turns are context, assistant turns are trained on.
DEFAULT = ChatTemplate(
    roles={"system": Marks("[SYS]", "[/SYS]"), "user": Marks("[INST]", "[/INST]"), "assistant": Marks("<s>", "</s>", loss=True)},
    turns={"start": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)},
    accept=("assistant",),
)


def _next_state(template: ChatTemplate, state: Column, role: Column) -> Column:
    allowed = [(state == s) & role.isin(*roles) for s, roles in template.turns.items() if roles]
    ok = F.lit(False)
    for a in allowed:
        ok = ok | a
    return F.when(ok, role).otherwise(F.lit("invalid"))


def _segments_of(template: ChatTemplate, turn: Column) -> Column:
    """Mark, text and mark of one turn."""

    def segment(text: Column, loss: bool) -> Column:
        return F.struct(text.alias("text"), F.lit(loss).alias("loss"))

    text, role = template.escape(turn["text"]), turn["role"]
    begin, end, close = template.other
    out = F.array(segment(F.concat(F.lit(begin), template.escape(role), F.lit(end)), False), segment(text, False), segment(F.lit(close), False))
    for name, marks in template.roles.items():
        out = F.when(role == name, F.array(segment(F.lit(marks.open), False), segment(text, marks.loss), segment(F.lit(marks.close), False))).otherwise(out)
    return out


def format_chat(conversations: DataFrame, template: ChatTemplate = DEFAULT) -> DataFrame:
    """(conv_id, valid, final_state, segments array<struct<text, loss>>) of every conversation."""
    turn = F.struct(
        F.col("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    turns = conversations.select("conv_id", turn.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    state = F.aggregate("turns", F.lit(template.start), lambda s, t: _next_state(template, s, t["role"]))
    segments = F.flatten(F.transform("turns", lambda t: _segments_of(template, t)))
    return turns.select("conv_id", state.isin(*template.accept).alias("valid"), state.alias("final_state"), segments.alias("segments"))


def formatted_text(segments: Column) -> Column:
    return F.array_join(F.transform(segments, lambda s: s["text"]), "")


def parse_turns(formatted: Column, template: ChatTemplate = DEFAULT) -> Column:
    """The turns that a formatted text holds: array<struct<role, text>>."""
    begin, end, close = template.other
    opens = "|".join([*(_quoted(m.open) for m in template.roles.values()), _quoted(begin)])
    closes = "|".join([*(_quoted(m.close) for m in template.roles.values()), _quoted(close)])
    whole = F.regexp_extract_all(formatted, F.lit(f"(?s)(?:{opens}).*?(?:{closes})"), F.lit(0))

    def inside(s: Column, before: Column | int, after: str) -> Column:
        before = F.lit(before) if isinstance(before, int) else before
        return s.substr(before + 1, F.char_length(s) - before - len(after))

    def turn(s: Column) -> Column:
        name_end = F.locate(end, s)  # the name comes first and holds no bare mark
        name = s.substr(F.lit(len(begin) + 1), name_end - 1 - len(begin))
        out = F.struct(template.unescape(name).alias("role"), template.unescape(inside(s, name_end - 1 + len(end), close)).alias("text"))
        for role, m in template.roles.items():
            out = F.when(
                s.startswith(m.open),
                F.struct(F.lit(role).alias("role"), template.unescape(inside(s, len(m.open), m.close)).alias("text")),
            ).otherwise(out)
        return out

    return F.transform(whole, turn)


def digests(chats: DataFrame, template: ChatTemplate = DEFAULT) -> DataFrame:
    """What the output of format_chat says when it is read back."""
    read = chats.select(
        "conv_id",
        "valid",
        "segments",
        formatted_text(F.col("segments")).alias("formatted"),
    ).select("*", parse_turns(F.col("formatted"), template).alias("turns"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    trained = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: template.unescape(s["text"])), "")
    read = read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        trained.alias("trained"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )
    return read.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        "n_turns",
        "turns_sha256",
        F.char_length("trained").cast("long").alias("loss_chars"),
        F.sha2("trained", 256).alias("loss_sha256"),
        "formatted_chars",
        "valid",
    )


#: A conversation that says control strings, added to those of the table.
CONTROL_CONVERSATION = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one that says control strings, formatted and read back."""
    own = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("long"),
        F.col("turn").cast("long"),
        F.col("role").cast("string"),
        F.col("text").cast("string"),
    )
    names = own.columns
    rows = F.array(*[F.struct(*[F.lit(v).cast(own.schema[n].dataType).alias(n) for n, v in zip(names, row)]) for row in CONTROL_CONVERSATION])
    return digests(format_chat(own.union(spark.range(1).select(F.explode(rows).alias("r")).select("r.*"))))


_LEAD_REST = r"([<\[])(\\*)(/?(?:SYS|INST|ROLE)\]|/TURN\]|/?s>)"

OP10_SQL = rf"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), marked AS (
  SELECT *, length(regexp_replace(text, '{_LEAD_REST}', '\1\\\2\3', 'g'))
    + CASE role WHEN 'system' THEN 11 WHEN 'user' THEN 13 WHEN 'assistant' THEN 7 ELSE 20 + length(regexp_replace(role, '{_LEAD_REST}', '\1\\\2\3', 'g')) END AS chars,
    lag(role, 1, 'start') OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS before,
    lead(0, 1, 1) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS last
  FROM rows
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars,
  bool_and(CASE before WHEN 'start' THEN role IN ('system', 'user') WHEN 'system' THEN role = 'user' WHEN 'user' THEN role = 'assistant' WHEN 'assistant' THEN role = 'user' ELSE false END)
    AND bool_or(last = 1 AND role = 'assistant') AS valid
FROM marked GROUP BY conv_id
"""
