"""Chat formatting with Spark expressions only.

A conversation's turns are collected as structs and sorted by (turn, role, text). The places where
the role changes cut the array into runs of one role; each run is merged into a block by joining
its array of texts, and blocks are joined to one string:

    <|role|>user<|text|>first text<|next|>second text<|end|>

``<|next|>`` stands between the merged turns of a block, so every turn can be read back. Control
strings inside roles and texts, the template's own and those of other public templates, are
written as ``~`` and a code letter, and ``~`` itself as ``~0``; ``unescape`` reverses that.

``loss_spans`` are the (start, length) in code points, counted from 0, of the assistant texts in
the formatted string, escaped as they stand there.

Defined results: a null text or role is empty; equal turns are all kept; a conversation of one
turn is one block; an empty table gives an empty table; a null conversation id is a conversation
of its own; extra columns are ignored, whatever their names. A very long text is formatted whole. The
formatted string is one value, so a conversation must fit in a row; its turns are gathered by
map-side partial arrays, and cost grows in proportion to their number (running sums are taken in
runs of ``_RUN``, so that no array is copied for each of its turns).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import column

ROLE, TEXT, NEXT, END = "<|role|>", "<|text|>", "<|next|>", "<|end|>"
#: Control strings and their codes (fixed values).
CONTROL = (
    (ROLE, "1"), (TEXT, "2"), (NEXT, "3"), (END, "4"), ("[INST]", "5"), ("[/INST]", "6"), ("<s>", "7"), ("</s>", "8"), ("<<SYS>>", "9"),
    ("<</SYS>>", "A"), ("<|im_start|>", "B"), ("<|im_end|>", "C"), ("<|endoftext|>", "D"), ("<|startoftext|>", "E"), ("<|eot_id|>", "F"),
)

_RUN = 64


def escape(text: Column) -> Column:
    return reduce(lambda c, x: F.replace(c, F.lit(x[0]), F.lit("~" + x[1])), CONTROL, F.replace(text, F.lit("~"), F.lit("~0")))


def unescape(text: Column) -> Column:
    return F.replace(reduce(lambda c, x: F.replace(c, F.lit("~" + x[1]), F.lit(x[0])), CONTROL, text), F.lit("~0"), F.lit("~"))


def _summed(values: Column) -> Column:
    """The running sums of an array of numbers."""
    last = lambda sums: F.coalesce(F.get(sums, F.size(sums) - 1), F.lit(0).cast("long"))
    return F.aggregate(values, F.array().cast("array<bigint>"), lambda sums, x: F.concat(sums, F.array(last(sums) + x)))


def _with(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, as a lambda's argument; within a lambda it would be computed for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running(values: Column) -> Column:
    """The running sums of a long array, run by run."""
    parts = lambda v: F.transform(F.sequence(F.lit(1), F.size(v), F.lit(_RUN)), lambda at: _summed(F.slice(v, at, F.lit(_RUN))))
    moved = lambda sums, before: F.transform(sums, lambda x: x + before)
    carried = lambda inner, whole: F.flatten(F.transform(inner, lambda sums, k: moved(sums, F.coalesce(F.get(whole, k - 1), F.lit(0).cast("long")))))
    ends = lambda inner: F.transform(inner, lambda sums: F.element_at(sums, -1))
    return _with(_with(values, parts), lambda inner: _with(_summed(ends(inner)), lambda whole: carried(inner, whole)))


def format_chats(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", trained: str = "assistant") -> DataFrame:
    """(conv_col, formatted, loss_spans, n_blocks) of each conversation."""
    turn = F.struct(column(turn_col).alias("turn"), F.coalesce(column(role_col), F.lit("")).alias("role"), F.coalesce(column(text_col), F.lit("")).alias("text"))
    turns = rows.groupBy(column(conv_col).alias("conv")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    new = lambda t, i: (i == 0) | ~F.get("turns", i - 1)["role"].eqNullSafe(t["role"])
    said = F.transform("turns", lambda t, i: F.struct(new(t, i).alias("opens"), (t["role"] == trained).alias("loss"), escape(t["role"]).alias("role"), escape(t["text"]).alias("text")))
    told = turns.select("conv", said.alias("said"))
    told = told.withColumn("opens", F.array_compact(F.transform("said", lambda t, i: F.when(t["opens"], i))))
    # Turns from one change of role up to the next are a block.
    block = F.transform("opens", lambda at, k: F.slice("said", at + 1, F.coalesce(F.get("opens", k + 1), F.size("said")) - at))
    merged = F.transform(block, lambda b: F.concat(F.lit(ROLE), F.get(b, F.lit(0))["role"], F.lit(TEXT), F.array_join(F.transform(b, lambda t: t["text"]), NEXT), F.lit(END)))
    # Before a text stand the marks and the role of its block, or the mark between turns.
    lead = lambda t, i: F.when(t["opens"], F.length(t["role"]) + F.when(i == 0, 0).otherwise(len(END)) + len(ROLE) + len(TEXT)).otherwise(len(NEXT))
    taken = F.transform("said", lambda t, i: (lead(t, i) + F.length(t["text"])).cast("long"))
    told = told.select("conv", "said", F.size("opens").alias("n_blocks"), F.array_join(merged, "").alias("formatted"), taken.alias("taken"))
    told = told.withColumn("ends", running(F.col("taken")))
    spans = F.zip_with("said", "ends", lambda t, e: F.when(t["loss"], F.struct((e - F.length(t["text"])).cast("int").alias("start"), F.length(t["text"]).alias("length"))))
    return told.select(F.col("conv").alias(conv_col), "formatted", F.array_compact(spans).alias("loss_spans"), "n_blocks")


def read_back(formatted: DataFrame, text_col: str = "formatted", spans_col: str = "loss_spans") -> DataFrame:
    """``formatted`` with turns (role, text) and loss_texts, parsed from the string alone."""
    text = column(text_col)
    blocks = F.slice(F.split(text, "<\\|role\\|>"), F.lit(2), F.size(F.split(text, "<\\|role\\|>")))

    def turns(block: Column) -> Column:
        role = F.substring_index(block, TEXT, 1)
        body = F.substr(block, F.length(role) + F.lit(len(TEXT) + 1), F.length(block))
        body = F.substr(body, F.lit(1), F.length(body) - F.lit(len(END)))
        return F.transform(F.split(body, "<\\|next\\|>"), lambda x: F.struct(unescape(role).alias("role"), unescape(x).alias("text")))

    loss = F.transform(column(spans_col), lambda s: unescape(F.substr(text, s["start"] + 1, s["length"])))
    return formatted.withColumns({"turns": F.flatten(F.transform(blocks, turns)), "loss_texts": loss})
