"""Chat formatting from a declarative template, with a finite-state machine over roles.

A template names the text around each turn, the roles whose turns carry loss, and the moves that the state machine allows. A
conversation becomes a list of segments, each with a loss flag: the opening of a turn, its text, its end. The formatted output is
these segments joined. In texts (and in roles) the template's first characters of control strings, and the escape character,
are written behind the escape character, so no text can hold a control string and reading back is exact.

Turns are ordered by turn number, then role and text; repeated rows are repeated turns. A null text counts as empty and a null role
as an empty one. Conversations that break the order of turns are formatted all the same, with valid false. Rows without a
conversation id form one conversation. A conversation is one value of one row, as a text is; conversations are never
gathered further. An empty table gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """opening is followed by the role and by `named`, then the text, then `closing`. moves: (state, role) -> state; end: final states."""

    opening: str = "### "
    named: str = ": "
    closing: str = "</turn>\n"
    escape: str = "\\"
    loss_roles: tuple[str, ...] = ("assistant",)
    start: str = "start"
    moves: tuple[tuple[str, str, str], ...] = (
        ("start", "system", "opened"),
        ("start", "user", "asked"),
        ("opened", "user", "asked"),
        ("asked", "assistant", "answered"),
        ("answered", "user", "asked"),
    )
    end: tuple[str, ...] = ("answered",)

    @property
    def special(self) -> str:
        return "".join(dict.fromkeys((self.escape, self.opening[0], self.named[0], self.closing[0])))


def _quoted(chars: str) -> str:
    return "[" + "".join("\\" + c for c in chars) + "]"


def escaped(text: Column, t: Template) -> Column:
    return F.regexp_replace(text, f"({_quoted(t.special)})", f"\\{t.escape}$1")


def unescaped(text: Column, t: Template) -> Column:
    return F.regexp_replace(text, f"(?s)\\{t.escape}(.)", "$1")


SEGMENTS = "array<struct<text:string,loss:boolean,state:string>>"


def run_machine(turns: Column, t: Template) -> Column:
    """The state machine over an array of turns (role, text): a struct of its last state and the segments that its steps emit.

    A step moves from state to state by the turn's role (to `refused`, for good, where no move allows it), and emits the turn's opening, its
    text and its end, each with the loss flag of the template's roles and the state that the step reached.
    """

    def step(held: Column, x: Column) -> Column:
        to = F.lit("refused")
        for a, r, b in t.moves:
            to = F.when((held["state"] == a) & (x["role"] == r), F.lit(b)).otherwise(to)
        segment = lambda s, loss: F.struct(s.alias("text"), loss.alias("loss"), to.alias("state"))
        emitted = F.array(
            segment(F.concat(F.lit(t.opening), escaped(x["role"], t), F.lit(t.named)), F.lit(False)),
            segment(escaped(x["text"], t), x["role"].isin(*t.loss_roles)),
            segment(F.lit(t.closing), F.lit(False)),
        )
        return F.struct(to.alias("state"), F.concat(held["segments"], emitted).alias("segments"))

    return F.aggregate(turns, F.struct(F.lit(t.start).alias("state"), F.array().cast(SEGMENTS).alias("segments")), step)


def format_chats(df: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", template: Template = Template()) -> DataFrame:
    """key, valid (the machine ends in a final state), segments (text, loss flag and state, in order) and formatted, a row for each conversation."""
    t = template
    rows = df.select(F.col(key), F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")).alias("_t"))
    chats = rows.groupBy(key).agg(F.array_sort(F.collect_list("_t")).alias("_turns"))
    out = chats.select(key, run_machine(F.col("_turns"), t).alias("_run")).select(key, F.col("_run.state").isin(*t.end).alias("valid"), F.col("_run.segments").alias("segments"))
    return out.withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def read_back(df: DataFrame, template: Template = Template()) -> DataFrame:
    """df of format_chats with turns (role and text) parsed from formatted alone, and loss_text, the unescaped text under the mask."""
    t = template
    plain = f"(?:{_quoted(t.escape)}.|[^{''.join(chr(92) + c for c in t.special)}])*+"
    quote = lambda s: "".join("\\" + c if not c.isalnum() and not c.isspace() else c for c in s)
    one = f"(?s){quote(t.opening)}({plain}){quote(t.named)}({plain}){quote(t.closing)}"
    heads, bodies = (F.regexp_extract_all("formatted", F.lit(one), F.lit(i)) for i in (1, 2))
    turns = F.arrays_zip(heads.alias("role"), bodies.alias("text"))
    turns = F.transform(turns, lambda x: F.struct(unescaped(x["role"], t).alias("role"), unescaped(x["text"], t).alias("text")))
    under = F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescaped(s["text"], t))
    return df.withColumn("turns", turns).withColumn("loss_text", F.array_join(under, ""))
