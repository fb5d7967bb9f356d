"""Chat formatting: a finite-state machine over roles and loss-flagged segments.

Native: DataFrame expressions only. A conversation is one row of the result, so
it has to fit a string, as its formatted text must in any case; the grouping is
by conversation and each group is no longer than that text.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """How turns are written.

    A turn is ``open + role + sep + text + close``. ``escapes`` lists what is
    replaced inside texts and roles, the escape character first; after it no
    text can contain ``open`` or ``close``, and each replacement can be undone.
    ``moves`` is the state machine: state -> role -> next state.
    """

    open: str = "### "
    sep: str = ": "
    close: str = "</turn>\n"
    escapes: tuple[tuple[str, str], ...] = (("\\", "\\b"), ("###", "\\h"), ("</turn>", "\\e"))
    role_escapes: tuple[tuple[str, str], ...] = ((":", "\\c"),)
    trained: tuple[str, ...] = ("assistant",)
    start: str = "start"
    moves: dict = field(default_factory=lambda: {
        "start": {"system": "system", "user": "user"},
        "system": {"user": "user"},
        "user": {"assistant": "assistant"},
        "assistant": {"user": "user"},
    })
    accept: tuple[str, ...] = ("assistant",)


DEFAULT = Template()


def escape(text: Column, t: Template = DEFAULT, role: bool = False) -> Column:
    for plain, coded in t.escapes + (t.role_escapes if role else ()):
        text = F.replace(text, F.lit(plain), F.lit(coded))
    return text


def unescape(text: Column, t: Template = DEFAULT, role: bool = False) -> Column:
    """Undo ``escape``: the escape character itself is restored last."""
    first, *rest = t.escapes
    for plain, coded in [*rest, *(t.role_escapes if role else ()), first]:
        text = F.replace(text, F.lit(coded), F.lit(plain))
    return text


def _next_state(t: Template):
    def step(state: Column, turn: Column) -> Column:
        out = F.lit("invalid")
        for frm, moves in t.moves.items():
            for role, to in moves.items():
                out = F.when((state == frm) & (turn["role"] == role), F.lit(to)).otherwise(out)
        return out

    return step


def format_conversations(rows: DataFrame, template: Template = DEFAULT, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row for each conversation: ``conv_id``, ``formatted``, ``segments``, ``valid``, ``final_state``.

    ``segments`` is an array of (text, loss): their texts joined give
    ``formatted``; loss is true for the texts of trained roles only, not for
    headers and closing marks. ``valid`` tells whether the state machine accepts
    the order of roles; invalid conversations are returned too.

    Edge cases: rows go by turn, ties by role then text, a null turn first; null
    text and null role count as empty; rows with a null conversation id form one
    conversation; repeated rows are turns of their own; an empty table gives no
    rows; other columns are ignored.
    """
    t = template
    turns = rows.select(
        F.col(conv_id).alias("conv_id"), F.col(turn).alias("_t"),
        F.coalesce(F.col(role), F.lit("")).alias("_r"), F.coalesce(F.col(text), F.lit("")).alias("_x"),
    )
    grouped = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct(F.col("_t").alias("turn"), F.col("_r").alias("role"), F.col("_x").alias("text")))).alias("_turns"))

    def pieces(x: Column) -> Column:
        part = lambda c, loss: F.struct(c.alias("text"), loss.alias("loss"))
        return F.array(
            part(F.concat(F.lit(t.open), escape(x["role"], t, role=True), F.lit(t.sep)), F.lit(False)),
            part(escape(x["text"], t), x["role"].isin(*t.trained)),
            part(F.lit(t.close), F.lit(False)),
        )

    segments = F.flatten(F.transform("_turns", pieces))
    state = F.aggregate("_turns", F.lit(t.start), _next_state(t))
    out = grouped.select("conv_id", segments.alias("segments"), state.alias("final_state"))
    return out.select("conv_id", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments", F.col("final_state").isin(*t.accept).alias("valid"), "final_state")


def parse_turns(formatted: Column, template: Template = DEFAULT) -> Column:
    """Read (role, text) pairs back from formatted text, in order."""
    t = template
    parts = F.filter(F.split(formatted, "\\Q" + t.close + "\\E", -1), lambda p: p != "")

    def one(p: Column) -> Column:
        at = F.instr(p, t.sep) if isinstance(t.sep, str) else None
        start = len(t.open) + 1
        return F.struct(
            unescape(F.substring(p, F.lit(start), at - start), t, role=True).alias("role"),
            unescape(F.substring(p, at + len(t.sep), F.char_length(p)), t).alias("text"),
        )

    return F.transform(parts, one)


def loss_texts(segments: Column, template: Template = DEFAULT) -> Column:
    """The unescaped texts under the loss mask, in order."""
    return F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"], template))


def digests(formatted: DataFrame, template: Template = DEFAULT) -> DataFrame:
    """Counts and digests read back from the output of ``format_conversations``."""
    read = formatted.select("conv_id", "formatted", "valid", parse_turns(F.col("formatted"), template).alias("t"), F.array_join(loss_texts(F.col("segments"), template), "").alias("loss"))
    joined = F.array_join(F.transform("t", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("t").cast("long").alias("n_turns"),
        F.sha2(joined.cast("binary"), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )
