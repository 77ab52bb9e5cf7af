"""Chat formatting from an event log.

Events of a conversation (streamed deltas, edits, regenerations) are folded into final messages and rendered by a
template. Messages are folded first, each on its own, so a long conversation is taken apart by message before its
rendered turns meet. All of it is DataFrame code.

Template, per turn: ``<s>`` + role + newline + text + ``</s>``. In roles and texts every ``\\``, ``<`` and ``[`` (and the
newline of a role) is written as an escape that holds none of these, so no control string of this or a bracket
template (``<s>``, ``</s>``, ``[INST]``, ``[/INST]``, ``<|...|>``) can occur inside a text; ``unescape`` takes it back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE = "<s>", "</s>"
#: Order matters: the escape character is the first to be written and the last to be taken back.
ESCAPES = (("\\", "\\e;"), ("<", "\\l;"), ("[", "\\b;"), ("\n", "\\n;"))
TEXT_ESCAPES = ESCAPES[:3]


def escape(text: Column, table=TEXT_ESCAPES) -> Column:
    for raw, code in table:
        text = F.replace(text, F.lit(raw), F.lit(code))
    return text


def unescape(text: Column, table=TEXT_ESCAPES) -> Column:
    for raw, code in reversed(table):
        text = F.replace(text, F.lit(code), F.lit(raw))
    return text


def fold(events: DataFrame, *, conv: str = "conv_id", message: str = "turn", seq: str = "seq", kind: str = "kind", role: str = "role", text: str = "text") -> DataFrame:
    """Final messages (conv_id, turn, role, text) of an event log.

    kind: ``delta`` appends its text to the message; ``edit`` replaces the text so far by its own; ``regenerate`` discards
    the text so far and begins again with its own (null: empty); any other kind, null too, counts as ``delta``. The role is
    that of the last event that has one. Ties in seq are taken in order of kind, then text. Null texts are empty.
    Messages are folded apart from each other; a message's events meet in one row, as its text does. Repeated events count
    each on its own. No rows in: no rows out. Other columns are not read.
    """
    e = events.select(
        F.col(conv).alias("conv_id"), F.col(message).alias("turn"),
        F.struct(F.col(seq).alias("seq"), F.coalesce(F.col(kind), F.lit("delta")).alias("kind"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.col(role).alias("role")).alias("e"))
    e = e.groupBy("conv_id", "turn").agg(F.array_sort(F.collect_list("e")).alias("log"))
    # events before the last one that replaces the text have no effect
    resets = F.transform("log", lambda x, i: F.when(x["kind"].isin("edit", "regenerate"), i))
    start = F.coalesce(F.array_max(resets), F.lit(0))
    kept = F.slice("log", start + 1, F.size("log"))
    said = F.filter(F.transform("log", lambda x: x["role"]), lambda r: r.isNotNull())
    return e.select("conv_id", "turn", F.try_element_at(said, F.lit(-1)).alias("role"), F.array_join(F.transform(kept, lambda x: x["text"]), "").alias("text"))


def render(messages: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", loss_role: str = "assistant") -> DataFrame:
    """One row per conversation: conv_id, formatted, mask.

    mask holds, for each turn in order, the code point range (start, length) of formatted that counts for the loss; the
    length is 0 for turns of other roles. Turns are in order of turn, then role, then text (null first); null roles
    and texts are empty; a null conv_id is a conversation of its own. Repeated rows are turns of their own; a very long text
    is one turn like any other. No rows in: no rows out. Other columns are not read.
    """
    head = F.concat(F.lit(OPEN), escape(F.coalesce(F.col(role), F.lit("")), ESCAPES), F.lit("\n"))
    body = escape(F.coalesce(F.col(text), F.lit("")))
    m = messages.select(F.col(conv).alias("conv_id"), F.struct(
        F.col(turn).alias("turn"), F.col(role).alias("role"), F.concat(head, body, F.lit(CLOSE)).alias("out"),
        F.length(head).alias("head"), F.when(F.col(role) == loss_role, F.length(body)).otherwise(0).alias("size"),
        (F.length(head) + F.length(body) + len(CLOSE)).alias("all")).alias("t"))
    # where each turn starts: a running sum over the conversation's turns, in linear time
    before = Window.partitionBy("conv_id").orderBy("t").rowsBetween(Window.unboundedPreceding, -1)
    m = m.withColumn("at", F.coalesce(F.sum("t.all").over(before), F.lit(0)).cast("long"))
    m = m.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("at", "t"))).alias("ts"))
    mask = F.transform("ts", lambda x: F.struct((x["at"] + x["t"]["head"]).alias("start"), x["t"]["size"].cast("long").alias("length")))
    return m.select("conv_id", F.array_join(F.transform("ts", lambda x: x["t"]["out"]), "").alias("formatted"), mask.alias("mask"))


def read_back(rendered: DataFrame) -> DataFrame:
    """Takes formatted apart again: adds turns (role, text) and loss_text (all text under the mask, unescaped). rendered has a
    row for each conv_id, as render gives it. No rows in: no rows out."""
    raw = F.split("formatted", F.lit(CLOSE))
    raw = F.slice(raw, 1, F.size(raw) - 1)
    # a turn and its own part of the mask go together, so a row carries no array
    parts = rendered.select("conv_id", F.posexplode(F.arrays_zip(raw.alias("x"), F.col("mask").alias("m"))).alias("pos", "z")).select("conv_id", "pos", "z.x", "z.m")
    before = Window.partitionBy("conv_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    at = F.coalesce(F.sum(F.length("x") + len(CLOSE)).over(before), F.lit(0))
    # the part of the mask, counted from the turn's own start
    parts = parts.withColumn("under", F.substr("x", (F.col("m.start") - at + 1).cast("int"), F.col("m.length").cast("int")))
    turn = F.struct(
        unescape(F.substr(F.substring_index("x", "\n", 1), F.lit(len(OPEN) + 1)), ESCAPES).alias("role"),
        unescape(F.substr("x", F.length(F.substring_index("x", "\n", 1)) + 2)).alias("text"))
    read = parts.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("pos", turn.alias("turn"), "under"))).alias("ps"))
    read = read.select(F.col("conv_id").alias("_conv"), F.transform("ps", lambda p: p["turn"]).alias("turns"), unescape(F.array_join(F.transform("ps", lambda p: p["under"]), "")).alias("loss_text"))
    return rendered.join(read, rendered["conv_id"].eqNullSafe(read["_conv"])).drop("_conv")


def digest(messages: DataFrame) -> DataFrame:
    """Contract columns, from what is read back: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.
    Nulls, repeats, empty tables and other columns as in render."""
    r = read_back(render(messages))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return r.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))
