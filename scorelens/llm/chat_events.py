"""Chat formatting from event logs.

A log holds events (conv_id, message, seq, kind, role, text). They are partitioned by conversation, ordered by ``seq``
and folded into final messages, which are then rendered:

* ``open`` begins a message with a role; ``delta`` appends text; ``edit`` replaces the text;
* ``regenerate`` empties the message and drops all that later messages had received before it.

The fold runs per message, so the messages of one very long conversation are spread over tasks. Only the rendered
pieces of a conversation meet, as its text is one value. ``message`` orders the messages; it and ``seq`` may be of any
orderable type.

Equal events count once, as redelivered. Null text is empty; a null or missing role is the empty role; events with a
null ``conv_id`` form a conversation of their own; nulls of ``message`` and ``seq`` sort first. Messages without a
living event vanish. Extra columns are dropped.

Template: ``<|im_start|>role\\ntext<|im_end|>\\n``. Inside roles and texts a backslash is doubled and ``<|`` becomes
``<\\|``, and a line feed in a role becomes ``\\n``; so no control string comes from a text, and all is reversible.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"
LOSS_ROLE = "assistant"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    parts = F.transform(F.split(role, r"\\\\", -1), lambda p: unescape(F.replace(p, F.lit("\\n"), F.lit("\n"))))
    return F.array_join(parts, "\\")


def fold_events(events: DataFrame) -> DataFrame:
    """(conv_id, message, role, text) of the final messages."""
    event = F.struct("seq", "kind", "role", F.coalesce("text", F.lit("")).alias("text"))
    messages = events.groupBy("conv_id", "message").agg(
        F.max(F.when(F.col("kind") == "regenerate", F.col("seq"))).alias("_again"),
        F.array_sort(F.array_distinct(F.collect_list(event))).alias("_events"),
    )
    earlier = Window.partitionBy("conv_id").orderBy("message").rowsBetween(Window.unboundedPreceding, -1)
    messages = messages.withColumn("_cut", F.max("_again").over(earlier))
    living = F.filter("_events", lambda e: F.col("_cut").isNull() | (e["seq"] > F.col("_cut")))
    messages = messages.withColumn("_events", living).filter(F.size("_events") > 0)
    reset = F.array_max(F.transform(
        F.filter("_events", lambda e: e["kind"].isin("edit", "regenerate")), lambda e: F.struct(e["seq"].alias("seq"), e["kind"].alias("kind"))
    ))
    messages = messages.withColumn("_reset", reset)
    counted = F.filter("_events", lambda e: (
        F.col("_reset").isNull()
        | (e["seq"] > F.col("_reset.seq"))
        | ((e["seq"] == F.col("_reset.seq")) & (e["kind"] == "edit") & (F.col("_reset.kind") == "edit"))
    ) & (e["kind"] != "regenerate"))
    roles = F.filter(F.transform("_events", lambda e: e["role"]), lambda r: r.isNotNull())
    return messages.select(
        "conv_id", "message",
        F.coalesce(F.try_element_at(roles, F.lit(-1)), F.lit("")).alias("role"),
        F.array_join(F.transform(counted, lambda e: e["text"]), "").alias("text"),
    )


def render(messages: DataFrame) -> DataFrame:
    """(conv_id, n_turns, formatted, pieces): the text of each conversation and its pieces with the loss mask.

    ``pieces`` is an array of (text, loss) whose texts joined are ``formatted``; the loss falls on assistants' texts.
    """
    piece = F.struct(
        "message",
        F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n")).alias("head"),
        escape(F.col("text")).alias("body"),
        (F.col("role") == LOSS_ROLE).alias("loss"),
    )
    turns = messages.groupBy("conv_id").agg(F.array_sort(F.collect_list(piece)).alias("turns"))
    pieces = F.flatten(F.transform("turns", lambda t: F.array(
        F.struct(t["head"].alias("text"), F.lit(False).alias("loss")),
        F.struct(t["body"].alias("text"), t["loss"].alias("loss")),
        F.struct(F.lit(END).alias("text"), F.lit(False).alias("loss")),
    )))
    return turns.select("conv_id", F.size("turns").cast("long").alias("n_turns"), pieces.alias("pieces")).select(
        "conv_id", "n_turns", F.array_join(F.col("pieces.text"), "").alias("formatted"), "pieces"
    )


def parse(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of (role, text)."""
    turns = F.filter(F.split(formatted, r"<\|im_end\|>\n", -1), lambda t: t.startswith(START))
    return F.transform(turns, lambda t: F.struct(
        unescape_role(F.regexp_extract(t, r"(?s)^<\|im_start\|>(.*?)\n", 1)).alias("role"),
        unescape(F.regexp_replace(t, r"(?s)^<\|im_start\|>.*?\n", "")).alias("text"),
    ))
