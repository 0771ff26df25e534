"""Chat formatting with Spark expressions only.

The turns of a conversation are collected, sorted, and runs of one role merged:

    <|start|>role<|text|>first text<|next|>second text<|end|>\\n

Inside roles and texts ``\\`` becomes ``\\\\`` and ``<|`` becomes ``<\\|``, so a
control string never comes from data and reading back is exact.  The loss mask
is a list of spans of the formatted text, one for each assistant text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, TEXT, NEXT, END = "<|start|>", "<|text|>", "<|next|>", "<|end|>\n"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _let(value: Column, use) -> Column:
    """use(value), with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _before(lengths: Column) -> Column:
    """Of each length, the sum of those before it: one pass that grows a list of numbers."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(lengths, start, lambda a, n: F.struct((a["at"] + n).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")), lambda a: a["out"])


def format_conversations(turns: DataFrame, masked: str = "assistant") -> DataFrame:
    """conv_id, formatted, loss_spans array<struct<start,length>> (code points from 0).

    Null roles and texts are empty; turns are ordered by turn (null first), role
    and text, so ties and repeated rows have one order and all stay.  Rows of a
    null conv_id are one conversation.  A conversation is one output row and
    so must fit one; it is never split.
    """
    row = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    held = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(row)).alias("turns"))
    n = F.size("turns")
    begins = F.filter(F.sequence(F.lit(1), n), lambda i: (i == 1) | (F.element_at("turns", i)["role"] != F.element_at("turns", F.greatest(i - 1, F.lit(1)))["role"]))
    runs = _let(begins, lambda b: F.transform(b, lambda s, j: F.struct(F.element_at("turns", s)["role"].alias("role"), F.transform(F.slice("turns", s, F.coalesce(F.get(b, j + 1), n + 1) - s), lambda t: escape(t["text"])).alias("texts"))))
    merged = held.select("conv_id", runs.alias("runs"))
    formatted = F.concat(F.array_join(F.transform("runs", lambda r: F.concat(F.lit(START), escape(r["role"]), F.lit(TEXT), F.array_join(r["texts"], NEXT))), END), F.lit(END))
    spans = "array<struct<start:int,length:int>>"

    def before(run: Column) -> Column:
        return len(START) + F.length(escape(run["role"])) + len(TEXT)

    def length(run: Column) -> Column:
        return before(run) + F.aggregate(run["texts"], F.lit(0), lambda a, t: a + F.length(t)) + len(NEXT) * (F.size(run["texts"]) - 1) + len(END)

    def inside(run: Column, start: Column) -> Column:
        lengths = F.transform(run["texts"], lambda t: F.length(t))
        return _let(F.struct(_before(lengths).alias("at"), lengths.alias("n")), lambda x: F.transform(x["n"], lambda n, j: F.struct((start + before(run) + F.get(x["at"], j) + len(NEXT) * j).alias("start"), n.alias("length"))))

    def masks(starts: Column) -> Column:
        return F.flatten(F.transform("runs", lambda r, i: F.when(r["role"] == masked, inside(r, F.get(starts, i))).otherwise(F.array().cast(spans))))

    return merged.select("conv_id", formatted.alias("formatted"), _let(_before(F.transform("runs", length)), masks).alias("loss_spans"))


def read_turns(formatted: Column) -> Column:
    """array<struct<role,text>> read back from a formatted conversation."""
    runs = F.filter(F.split(formatted, r"<\|end\|>\n"), lambda r: r != "")

    def run(r: Column) -> Column:
        body = F.split(F.substring(r, F.lit(len(START) + 1), F.length(r)), r"<\|text\|>", 2)
        return _let(body, lambda b: F.transform(F.split(b[1], r"<\|next\|>"), lambda t: F.struct(unescape(b[0]).alias("role"), unescape(t).alias("text"))))

    return F.flatten(F.transform(runs, run))


def masked_text(formatted: Column, spans: Column) -> Column:
    """All text under the mask, unescaped, with nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["length"]))), "")
