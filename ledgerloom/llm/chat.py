"""Chat formatting with Spark expressions only.

Method. Each turn knows from the turns beside it (a window in turn order) whether it starts or ends a
block of one role, and how many code points of the output stand before its text. The turns of a
conversation are collected as structs and sorted; adjacent turns of one role merge by array aggregation
(the turns from one block start to the next); the blocks are concatenated. All of it is linear in a
conversation's length. The output can be read back exactly.

Template, for each block of one role::

    <|role|>ROLE<|text|>TEXT<|part|>TEXT ... <|end|>

<|part|> stands between the merged turns. Control strings inside roles and texts - anything that
starts with <| as well as <s>, </s>, [INST] and [/INST] - get a backslash after their first
character (one more if there are some), so no text can fake a mark; unescape() takes it away again.
Loss spans are (start, length) in code points of the output, one for each assistant turn's text.

Nulls: a null role or text is empty; a null turn sorts first; a turn without a conv_id belongs to no
conversation and stands alone, with a null conv_id in the result. Repeated rows stay as turns; ties of
turn are ordered by role, then text. An empty table gives no conversation. A conversation is one output
value, so it must fit a task, however long its texts; nothing else is collected. Extra columns are
ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bind

_CONTROL = r"(?=\||/?s>|/?INST\])"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])(\\*){_CONTROL}", r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])\\(\\*){_CONTROL}", r"$1$2")


_START, _TEXT, _PART, _END = "<|role|>", "<|text|>", "<|part|>", "<|end|>"


def _blocks(turns: Column) -> Column:
    """Blocks of the sorted turns: the turns from each block start up to the next."""
    starts = F.transform(F.filter(F.transform(turns, lambda t, i: F.struct(i.alias("i"), t["first"].alias("first"))), lambda x: x["first"]), lambda x: x["i"])
    ends = lambda s, j: F.coalesce(F.get(s, j + 1), F.size(turns))
    return bind(starts, lambda s: F.transform(s, lambda i, j: F.slice(turns, i + 1, ends(s, j) - i)))


def format_conversations(turns: DataFrame, learn_from: str = "assistant") -> DataFrame:
    """(conv_id, formatted, loss_spans) for each conversation of (conv_id, turn, role, text)."""
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    rows = turns.select("conv_id", F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id()).alias("alone"), F.col("turn").alias("turn"), role.alias("role"), text.alias("text"))
    rows = rows.select("*", escape(F.col("text")).alias("shown"), escape(F.col("role")).alias("name"))
    order = Window.partitionBy("conv_id", "alone").orderBy("turn", "role", "text")
    rows = rows.select("*", F.coalesce(F.lag("role").over(order) != F.col("role"), F.lit(True)).alias("first"), F.coalesce(F.lead("role").over(order) != F.col("role"), F.lit(True)).alias("last"))
    head = F.when(F.col("first"), F.length("name") + len(_START) + len(_TEXT)).otherwise(len(_PART)).cast("long")
    size = head + F.length("shown") + F.when(F.col("last"), len(_END)).otherwise(0)
    before = F.coalesce(F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    # `at` grows with the order of the turns, equal ones included, so it is what the structs are sorted by
    turn = F.struct((before + head).alias("at"), "role", "first", "shown", "name")
    sorted_ = rows.select("conv_id", "alone", turn.alias("t")).groupBy("conv_id", "alone").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    block = lambda b: F.concat(F.lit(_START), b[0]["name"], F.lit(_TEXT), F.array_join(F.transform(b, lambda t: t["shown"]), _PART), F.lit(_END))
    learnt = F.filter("turns", lambda t: t["role"] == learn_from)
    return sorted_.select(
        "conv_id",
        F.array_join(F.transform(_blocks(F.col("turns")), block), "").alias("formatted"),
        F.transform(learnt, lambda t: F.struct(t["at"].alias("start"), F.length(t["shown"]).cast("long").alias("length"))).alias("loss_spans"),
    )


def read_back(formatted: Column) -> Column:
    """array<struct<role, text>>: the turns that an output of the template holds."""
    blocks = F.filter(F.split(formatted, r"<\|end\|>", -1), lambda x: x != "")

    def turns(b: Column) -> Column:
        head = F.split(F.substring_index(b, "<|text|>", 1), r"<\|role\|>", -1)
        body = F.split(b, r"<\|text\|>", 2)[1]
        return F.transform(F.split(body, r"<\|part\|>", -1), lambda p: F.struct(unescape(head[1]).alias("role"), unescape(p).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def learnt_text(formatted: Column, loss_spans: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return bind(formatted, lambda f: F.array_join(F.transform(loss_spans, lambda s: unescape(F.substr(f, (s["start"] + 1).cast("int"), s["length"].cast("int")))), ""))


def digest(formatted: DataFrame) -> DataFrame:
    """Counts and digests of formatted conversations, read back from the output."""
    got = formatted.select("conv_id", "formatted", read_back(F.col("formatted")).alias("turns"), learnt_text(F.col("formatted"), F.col("loss_spans")).alias("learnt"))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return got.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.length("learnt").cast("long").alias("loss_chars"),
        F.sha2("learnt", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
