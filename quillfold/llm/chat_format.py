"""Chat formatting with Spark expressions only: no Python runs on the executors.

A conversation is one row of the result, so it must fit a Spark row, as the formatted string must.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Control strings of the template (fixed values).
START, SEP, END, NEWLINE = "<|im_start|>", "<|im_sep|>", "<|im_end|>\n", "<|nl|>"


def escape(text: Column) -> Column:
    """Put a backslash after ``<`` wherever ``<|`` (or an escaped form of it) stands in a text."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def format_chat(
    turns: DataFrame,
    *,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    loss_role: str = "assistant",
) -> DataFrame:
    """Per conversation: ``conv_id``, ``segments`` (text, loss) and ``formatted``.

    Turns are collected as structs and sorted as they are; adjacent turns of one role are merged into
    one block that keeps the list of their texts; texts are escaped and divided by a separator, so
    the turns can be read back; the pieces of all blocks are concatenated.  ``segments`` are these
    pieces with the loss mask: true for the texts of ``loss_role``, false for marks and all other
    texts.  No text can contain a control string after :func:`escape`.

    Defined cases: a null text or role is empty; turns with equal numbers are ordered by role and
    text, null numbers first; repeated rows are turns of their own; a null conversation id is a
    conversation like any other; other columns are ignored whatever their names; an empty table
    gives an empty result.
    """
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    one = F.struct(F.col(turn_col).alias("turn"), plain(role_col).alias("role"), plain(text_col).alias("text"))
    chats = turns.groupBy(F.col(conv_col).alias("conv_id")).agg(F.sort_array(F.collect_list(one)).alias("t"))
    blocks = chats.select("conv_id", merged_turns(F.col("t")).alias("b"))

    def pieces(b: Column) -> Column:
        mark = lambda s: F.struct(s.alias("text"), F.lit(False).alias("loss"))
        role = F.replace(escape(b["role"]), F.lit("\n"), F.lit(NEWLINE))
        said = lambda x: F.struct(escape(x).alias("text"), (b["role"] == loss_role).alias("loss"))
        parts = F.transform(b["texts"], lambda x, j: F.when(j == 0, F.array(said(x))).otherwise(F.array(mark(F.lit(SEP)), said(x))))
        return F.concat(F.array(mark(F.concat(F.lit(START), role, F.lit("\n")))), F.flatten(parts), F.array(mark(F.lit(END))))

    parts = blocks.select("conv_id", F.filter(F.flatten(F.transform("b", pieces)), lambda s: s["text"] != "").alias("segments"))
    return parts.withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def merged_turns(t: Column) -> Column:
    """Sorted turns as blocks of one role: an array of ``role, texts``.

    The places where the role changes are found first and each block is one slice, so the work grows
    with the number of turns and not with its square, however many one conversation has.
    """
    n = F.size(t)
    starts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.get(t, i - 1)["role"] != F.get(t, i)["role"]))
    ends = F.concat(F.slice(starts, 2, n), F.array(n))
    block = lambda s, e: F.struct(F.get(t, s)["role"].alias("role"), F.transform(F.slice(t, s + 1, e - s), lambda x: x["text"]).alias("texts"))
    return F.zip_with(starts, ends, block)


def read_turns(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation, unescaped."""
    blocks = F.filter(F.split(formatted, END.replace("|", r"\|")), lambda b: b != "")
    body = lambda b: F.substring(b, len(START) + 1, F.length(b))

    def turns(b: Column) -> Column:
        role = F.substring_index(body(b), "\n", 1)
        rest = F.substring(body(b), F.length(role) + 2, F.length(b))
        plain = unescape(F.replace(role, F.lit(NEWLINE), F.lit("\n")))
        return F.transform(F.split(rest, SEP.replace("|", r"\|")), lambda t: F.struct(plain.alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def read_loss(segments: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
