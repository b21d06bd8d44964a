"""Chat formatting from event logs.

An event is (conv_id, message, seq, kind, role, text). `open` starts a message, `delta` adds
to it, `edit` replaces its text, `regenerate` starts it anew with the role and text given.
Messages are folded first, each on its own, from the events since the last that replaces;
then a conversation's messages are rendered in order of `message`:

    <s>[INST]role[/INST]text</s>

Inside roles and texts a backslash is doubled and one is put after every `<` and `[`, so no
control string can occur in them and the text can be read back exactly.

Null texts and roles are empty. Events of one message with equal seq are taken in order of
kind and text; a message without an event that opens it is made of its deltas. Rows without
conv_id form one conversation. An empty log gives no conversations. A conversation is one
row of output, so its text has to fit in a task; its messages are folded apart from it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

BEGIN, ROLE_END, END = "<s>[INST]", "[/INST]", "</s>"
DELTA_CHARS = 400


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for first in "<[":
        out = F.replace(out, F.lit(first), F.lit(first + "\\"))
    return out


def unescape(text: Column) -> Column:
    out = text
    for first in "[<":
        out = F.replace(out, F.lit(first + "\\"), F.lit(first))
    return F.replace(out, F.lit("\\\\"), F.lit("\\"))


def fold(events: DataFrame) -> DataFrame:
    """(conv_id, message, role, text): the final messages."""
    replaces = F.col("kind") != "delta"
    event = F.struct("seq", "kind", F.coalesce("text", F.lit("")).alias("text"), replaces.alias("replaces"))
    folded = events.groupBy("conv_id", "message").agg(
        F.sort_array(F.collect_list(event)).alias("events"),
        F.max_by("role", F.when(F.col("role").isNotNull(), F.struct("seq", "kind"))).alias("role"))
    last = F.array_max(F.transform("events", lambda e, i: F.when(e["replaces"], i).otherwise(0)))
    folded = folded.withColumn("last", last)
    live = F.expr("filter(events, (e, i) -> i >= last)")
    return folded.select("conv_id", "message", F.coalesce("role", F.lit("")).alias("role"), F.array_join(F.transform(live, lambda e: e["text"]), "").alias("text"))


def render(messages: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """(conv_id, formatted, loss_spans): one text per conversation, and where in it (code points from 1) the loss counts."""
    head = F.concat(F.lit(BEGIN), escape(F.col("role")), F.lit(ROLE_END))
    turns = messages.select("conv_id", "message", "role", head.alias("head"), escape(F.col("text")).alias("body"))
    turns = turns.withColumn("turn", F.concat("head", "body", F.lit(END)))
    before = Window.partitionBy("conv_id").orderBy("message").rowsBetween(Window.unboundedPreceding, -1)
    turns = turns.withColumn("start", F.coalesce(F.sum(F.char_length("turn")).over(before), F.lit(0)) + F.char_length("head") + 1)
    span = F.when(F.col("role") == loss_role, F.struct(F.col("start").cast("int").alias("start"), F.char_length("body").alias("length")))
    out = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("message", "turn", span.alias("span")))).alias("turns"))
    return out.select("conv_id", F.array_join(F.transform("turns", lambda t: t["turn"]), "").alias("formatted"),
                      F.array_compact(F.transform("turns", lambda t: t["span"])).alias("loss_spans"))


def parse(formatted: Column) -> Column:
    """array<struct<role, text>> read back from a rendered conversation."""
    turns = F.filter(F.split(formatted, r"\Q" + BEGIN + r"\E", -1), lambda t, i: i > 0)
    pieces = F.transform(turns, lambda t: F.split(t, r"\Q" + ROLE_END + r"\E", -1))
    return F.transform(pieces, lambda p: F.struct(unescape(p[0]).alias("role"), unescape(F.substr(p[1], F.lit(1), F.char_length(p[1]) - len(END))).alias("text")))


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped and joined."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(formatted, s["start"], s["length"]))), "")


def streamed(conversations: DataFrame) -> DataFrame:
    """The event log that would have streamed finished conversations (conv_id, turn, role, text).

    Messages are numbered by turn, then role and text; each opens empty and arrives in deltas.
    By a hash of (conv_id, number) a quarter of the messages first receives a wrong text, which an
    edit replaces; another quarter opens under a wrong role, is regenerated, goes wrong again and is
    edited. The wrong text is the right one backwards. Null roles and texts are empty.
    """
    number = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    rows = conversations.select("conv_id", number.alias("message"), *[F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text")])
    event = lambda kind, role, text: F.struct(F.lit(kind).alias("kind"), role.cast("string").alias("role"), text.alias("text"))
    cut = lambda text: F.regexp_extract_all(text, F.lit(f"(?s).{{1,{DELTA_CHARS}}}"), F.lit(0))
    deltas = lambda parts: F.transform(parts, lambda t: event("delta", F.lit(None), t))
    empty, right, wrong = F.lit(""), deltas(cut(F.col("text"))), deltas(cut(F.reverse("text")))
    opened = lambda kind, role: F.array(event(kind, role, empty))
    edited = F.concat(F.array(event("edit", F.lit(None), F.substring("text", 1, DELTA_CHARS))), deltas(cut(F.substr(F.col("text"), F.lit(DELTA_CHARS + 1)))))
    fate = F.pmod(F.xxhash64("conv_id", "message"), F.lit(4))
    log = (F.when(fate == 0, F.concat(opened("open", F.col("role")), wrong, edited))
           .when(fate == 1, F.concat(opened("open", F.lit("draft")), wrong, opened("regenerate", F.col("role")), wrong, edited))
           .otherwise(F.concat(opened("open", F.col("role")), right)))
    return rows.select("conv_id", "message", F.posexplode(log).alias("seq", "e")).select("conv_id", "message", "seq", "e.*")
