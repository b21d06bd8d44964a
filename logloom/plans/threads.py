"""Messages between jobs: both halves paired, where each landed, who talks to whom."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from logloom.functions import envelope as env, tools
from logloom.operators import identity as idn
from logloom.operators.sizes import small_side
from logloom.operators.stages import staged
from logloom.plans.trace import address_book
from logloom.schemas import Corpus, uncut

COPY = ["session_id", "prompt_id", "ts"]


def pairs(messages: DataFrame) -> DataFrame:
    """Sender's ack row and receiver's copy of one message, on the id both carry."""
    acks = messages.filter("lane = 'tool' AND msg_id IS NOT NULL").select("msg_id", F.col("session_id").alias("sender_session"), F.col("ts").alias("acked_at"))
    copies = messages.filter("lane = 'relay' AND msg_id IS NOT NULL").select(
        "msg_id", F.col("session_id").alias("receiver_session"), F.col("ts").alias("received_at"), "peer")
    return acks.join(copies, "msg_id")


def traffic(messages: DataFrame) -> DataFrame:
    """Calls that send and copies received, stored once: the narrow part of messages that threads read."""
    sends = "type = 'assistant' AND lane = 'tool' AND tool_name = 'SendMessage'"
    rows = uncut(messages).filter(f"lane = 'relay' OR ({sends})")
    return staged(rows.select("session_id", "prompt_id", "type", "lane", "ts", "line_no", "pos", "tool_name", "tool_use_id", "msg_id", "peer", "text"), "traffic")


def sent_halves(messages: DataFrame, spawns: DataFrame | None = None, known: DataFrame | None = None) -> DataFrame:
    """SendMessage calls with their ack: address, gloss, text, delivered, reason, message id.

    Follow-ups to a session's own sub-agents are not part of any thread. `known` is the traffic
    of these messages where the caller has it already.
    """
    known = traffic(messages) if known is None else known
    calls = known.filter("lane = 'tool'")
    head = env.sent_head(tools.call_input(F.col("tool_name"), F.col("text")))
    asked = calls.select("session_id", "tool_use_id").filter("tool_use_id IS NOT NULL").distinct()
    calls = calls.select("session_id", "prompt_id", "ts", "tool_use_id", "line_no", head.alias("h")).select(
        "session_id", "prompt_id", "ts", "tool_use_id", "line_no", F.col("h.to").alias("addr"), F.col("h.summary").alias("summary"), F.col("h.message").alias("body"))
    # of all results only those of these calls are grouped
    results = uncut(messages).filter("type = 'user' AND lane = 'tool' AND tool_use_id IS NOT NULL")
    acks = results.join(small_side(asked), ["session_id", "tool_use_id"], "left_semi").groupBy("session_id", "tool_use_id").agg(
        F.max_by(F.struct("text", "msg_id"), "line_no").alias("a"))
    ack = env.ack_head(F.col("a.text"))
    rows = calls.join(acks, ["session_id", "tool_use_id"], "left").select(
        "session_id", "prompt_id", "ts", "addr", "summary", "body", F.col("a.msg_id").alias("msg_id"), ack["delivered"].alias("delivered"), ack["error"].alias("error"))
    if spawns is not None:
        rows = rows.join(spawns.select("session_id", F.col("agent_id").alias("addr")), ["session_id", "addr"], "left_anti")
    book = address_book(known)
    plain_name = F.regexp_replace("addr", r"\s+\[[0-9a-f]+\]$", "")
    return rows.join(book, ["session_id", "addr"], "left").withColumn("to_name", F.coalesce("to_name", plain_name))


def thread_rows(c: Corpus, keyed: DataFrame) -> DataFrame:
    """Every message between jobs: sender and receiver job, both halves, and where it landed.

    turn / mid-turn  the receiver's copy opened a turn or was read inside one
    lost             the ack refused it
    unseen           acked, but no copy is known
    """
    key = keyed.select("session_id", "key")
    named_rows = staged(idn.named_jobs(keyed, c.jobs), "thread-names")
    names = named_rows.select("key", "name")
    holders = idn.name_holders(keyed, c.jobs, named_rows).select(F.col("name").alias("to_name"), F.col("key").alias("named_key"))
    known = traffic(c.messages)
    # halves without an id cannot pair: each side has keys of its own for them, spread over the tasks
    alone = lambda side, half: F.concat(F.lit("\x00" + side), F.xxhash64(half, "msg_id").cast("string"))
    sent = sent_halves(c.messages, c.spawns, known).join(key.withColumnRenamed("key", "from_key"), "session_id").select(
        "from_key", F.struct(*COPY).alias("sent"), "to_name", "summary", "body", "msg_id", "delivered", "error").withColumn(
        "at", F.coalesce("msg_id", alone("s", "sent")))
    copies = known.filter("lane = 'relay'").join(key.withColumnRenamed("key", "to_key"), "session_id").select(
        "to_key", "peer", F.struct(*COPY).alias("received"), "msg_id", (F.col("type") == "attachment").alias("mid"),
        env.relay_head(F.col("text"))["text"].alias("heard")).withColumn("at", F.coalesce("msg_id", alone("r", "received"))).withColumnRenamed("msg_id", "m")
    both = sent.join(copies, "at", "full").drop("at")
    # rows without a name find nothing; a key of their own keeps them from meeting in one task
    own = F.concat(F.lit("\x00"), F.xxhash64("msg_id", "m", "sent", "received").cast("string"))
    both = both.withColumns({"to_at": F.coalesce("to_name", own), "peer_at": F.coalesce("peer", own)})
    both = both.join(holders.withColumnRenamed("to_name", "to_at"), "to_at", "left")
    sender = holders.withColumnsRenamed({"to_name": "peer_at", "named_key": "peer_key"})
    both = both.join(sender, "peer_at", "left").withColumns({
        "from_key": F.coalesce("from_key", "peer_key"), "to_key": F.coalesce("to_key", "named_key")})
    landed = (F.when(F.col("received").isNotNull(), F.when(F.col("mid"), "mid-turn").otherwise("turn"))
              .when(~F.col("delivered"), "lost").otherwise("unseen"))
    named = lambda side: names.withColumnsRenamed({"key": f"{side}_key", "name": f"{side}_job"})
    out = both.join(named("from"), "from_key", "left").join(named("to"), "to_key", "left")
    return out.select(
        "from_key", "to_key", F.coalesce("from_job", "peer").alias("from_name"), F.coalesce("to_job", "to_name").alias("to_name"),
        F.coalesce("msg_id", "m").alias("msg_id"), landed.alias("landed"), F.coalesce("sent.ts", "received.ts").alias("ts"),
        F.coalesce("heard", "body").alias("message"), "summary", "error", "sent", "received")


def own_words(c: Corpus, keyed: DataFrame, rows: DataFrame) -> DataFrame:
    """The user's own words in the sessions that took part, from the prompt each side was on."""
    took = rows.select(F.explode(F.array("sent", "received")).alias("h"), F.col("ts").alias("at")).filter("h IS NOT NULL")
    opened = took.groupBy(F.col("h.session_id").alias("session_id")).agg(F.min(F.col("h.ts")).alias("first_at"))
    typed = c.messages.filter("lane = 'prompt'").join(opened, "session_id")
    # the prompt a side stood in when its first message came or went
    on = typed.filter(F.col("ts") <= F.col("first_at")).groupBy("session_id").agg(F.max("ts").alias("from_ts"))
    kept = typed.join(on, "session_id", "left").filter(F.col("ts") >= F.coalesce("from_ts", "first_at"))
    return kept.join(keyed.select("session_id", "key"), "session_id").select(
        F.col("key").alias("to_key"), F.when(F.col("type") == "attachment", "mid-turn").otherwise("turn").alias("landed"),
        "session_id", "prompt_id", "ts", F.col("text").alias("message"))


def thread(c: Corpus, keyed: DataFrame, a: str, b: str, rows: DataFrame | None = None) -> DataFrame:
    """One pair's ledger, in order of the sender's instant when it is known."""
    rows = thread_rows(c, keyed) if rows is None else rows
    one = lambda x, y: (F.col("from_name") == x) & (F.col("to_name") == y)
    return rows.filter(one(a, b) | one(b, a)).orderBy("ts", "msg_id")


def direction_totals(rows: DataFrame) -> DataFrame:
    n = lambda cond: F.sum(cond.cast("bigint"))
    landed = lambda v: n(F.col("landed") == v)
    return rows.groupBy("from_name", "to_name").agg(
        n(F.col("sent").isNotNull()).alias("sent"), landed("turn").alias("turn"), landed("mid-turn").alias("mid_turn"),
        landed("lost").alias("lost"), landed("unseen").alias("unseen"))


def thread_list(c: Corpus, keyed: DataFrame) -> DataFrame:
    """Pairs of jobs with received copies, both directions merged; a lost send is no copy."""
    names = idn.named_jobs(keyed, c.jobs).select("key", F.coalesce("name", "key").alias("me"))
    me = keyed.select("session_id", "key").join(names, "key").select("session_id", "me")
    rows = c.messages.filter("lane = 'relay' AND peer IS NOT NULL").join(me, "session_id").filter("me <> peer")
    return rows.groupBy(F.least("me", "peer").alias("a"), F.greatest("me", "peer").alias("b")).agg(
        F.count("*").alias("messages"), F.min("ts").alias("first"), F.max("ts").alias("last"))
