"""Session traces for all sessions at once: transactions, instructions, notes, annotations.

A single session's trace is the same frame behind a filter on session_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from logloom.functions import envelope as env, fixed_values as fv, models, pricing, tools
from logloom.functions.text import cut, extract
from logloom.functions.timekeys import millis_between
from logloom.operators import identity as idn
from logloom.operators.ordered import scan
from logloom.operators.sizes import small_side
from logloom.operators.stages import staged
from logloom.plans import waits
from logloom.schemas import Corpus, uncut

TRACE_LANES = ["prompt", "meta", "text", "thinking", "tool", "relay"]
TX = ["session_id", "tx"]


def _ord() -> Column:
    return F.struct("line_no", "pos")


def bucketed(messages: DataFrame) -> DataFrame:
    """Messages with their transaction number and instruction cursor.

    tx  consecutive rows of one prompt id (NULL is a value); the same id later is a new one
    seq instructions of the session up to and including the row
    """
    rows = uncut(messages).filter(F.col("lane").isin(TRACE_LANES))
    call = (F.col("type") == "assistant") & (F.col("lane") == "tool")
    return scan(rows.withColumn("is_call", call), ["session_id"], ["line_no", "pos"],
                island={"tx": ["prompt_id"]}, running={"seq": F.col("is_call").cast("bigint")})


def openers(rows: DataFrame) -> DataFrame:
    """Who opened each transaction, what kind it is, and its message with the envelope off."""
    head = F.col("lane").isin("prompt", "meta", "relay")
    meta = env.meta_head(F.col("text"))
    rows = rows.withColumn("mh", F.when(F.col("lane") == "meta", meta))
    # first command-tagged meta row, else first tagged, else first
    tier = F.when(F.col("mh.tag") == "command", 0).when(F.col("mh.tag").isNotNull(), 1).otherwise(2)
    opener = F.struct("lane", "peer", "text")
    per = rows.groupBy(*TX).agg(
        F.min_by(opener, F.when(head, _ord())).alias("o"),
        F.min_by(F.col("mh"), F.when(F.col("lane") == "meta", F.struct(tier.alias("tier"), "line_no", "pos"))).alias("m"),
        F.min_by("prompt_id", _ord()).alias("prompt_id"),
        F.min_by(F.struct("ts"), _ord())["ts"].alias("ts"), F.max_by(F.struct("ts"), _ord())["ts"].alias("last_ts"))
    relay = env.relay_head(F.col("o.text"))
    kind = (F.when(F.col("o.lane") == "relay", "relay")
            .when(F.col("o.lane") == "meta", F.when(F.col("m.tag") == "command", "command").otherwise("meta"))
            .otherwise("prompt"))
    tag = F.when(kind == "relay", F.coalesce("o.peer", relay["from_name"])).when(kind == "meta", F.col("m.tag"))
    said = F.when(kind == "relay", relay["text"]).when(F.col("o.lane") == "meta", F.col("m.text")).otherwise(F.coalesce("o.text", F.lit("")))
    return per.select(*TX, "prompt_id", "ts", F.greatest(millis_between(F.col("ts"), F.col("last_ts")), F.lit(0)).alias("ms"),
                      kind.alias("kind"), tag.alias("tag"), said.alias("message"))


def instructions(rows: DataFrame) -> DataFrame:
    """Calls paired with their last result in the same transaction.

    Latency runs from the end of the response: the newest stamp among the
    blocks of the same request.
    """
    ended = rows.filter((F.col("type") == "assistant") & F.col("request_id").isNotNull()).groupBy("session_id", "request_id").agg(
        F.max("ts").alias("ended"))
    calls = rows.filter("is_call")
    found = rows.filter((F.col("type") == "user") & (F.col("lane") == "tool") & F.col("tool_use_id").isNotNull())
    results = found.groupBy(*TX, "tool_use_id").agg(
        F.max_by(F.struct(F.col("ts").alias("result_ts"), F.col("is_error").alias("failed"), F.col("text").alias("result")), _ord()).alias("r"))
    tool = F.coalesce("tool_name", F.lit("?"))
    at = [F.col("at")] if "at" in rows.columns else []
    paired = (calls.join(results, [*TX, "tool_use_id"], "left").join(ended, ["session_id", "request_id"], "left")
              .select(*TX, *at, "line_no", "pos", "seq", "ts", "request_id", "tool_use_id", tool.alias("tool"),
                      tools.call_input(tool, F.col("text")).alias("payload"),
                      F.coalesce("r.failed", F.lit(False)).alias("error"), F.coalesce("r.result", F.lit("")).alias("result"),
                      F.col("r").isNotNull().alias("answered"),
                      F.greatest(millis_between(F.coalesce("ended", "ts"), F.col("r.result_ts")), F.lit(0)).alias("ms_raw"),
                      F.col("r.result_ts").isNotNull().alias("timed")))
    return paired.withColumn("ms", F.when(F.col("timed"), F.col("ms_raw"))).drop("ms_raw", "timed").withColumn(
        "class", tools.call_class(F.col("tool"), F.col("payload")))


def cursors(rows: DataFrame) -> DataFrame:
    """Rows with `at`: instructions of the same transaction before the row."""
    base = rows.groupBy(*TX).agg(F.min(F.col("seq") - F.col("is_call").cast("bigint")).alias("base"),
                                 F.max("seq").alias("top"))
    return rows.join(base, TX).withColumns({
        "at": F.col("seq") - F.col("is_call").cast("bigint") - F.col("base"), "calls": F.col("top") - F.col("base")}).drop("base", "top")


def trace_rows(c: Corpus) -> DataFrame:
    """Bucketed messages with cursors, written once: the base every trace report reads."""
    return staged(cursors(bucketed(c.messages)), "trace-rows")


def trace_calls(rows: DataFrame) -> DataFrame:
    return staged(instructions(rows), "trace-calls")


def notes_and_replies(at_rows: DataFrame, head: int = 160) -> DataFrame:
    """Assistant texts: the last one after the last call is the reply, the rest are notes."""
    texts = at_rows.filter((F.col("type") == "assistant") & (F.col("lane") == "text"))
    last = texts.groupBy(*TX).agg(F.max(_ord()).alias("last"))
    reply = (_ord() == F.col("last")) & (F.col("at") == F.col("calls"))
    return texts.join(last, TX).select(*TX, "line_no", "pos", "ts", "at",
                                       F.when(reply, "reply").otherwise("note").alias("part"), cut(F.col("text"), head).alias("text"),
                                       F.col("text").alias("body"))


def thoughts(at_rows: DataFrame, head: int = 160) -> DataFrame:
    rows = at_rows.filter((F.col("type") == "assistant") & (F.col("lane") == "thinking"))
    return rows.select(*TX, "line_no", "pos", "ts", "at", cut(F.col("text"), head).alias("text"))


def received(at_rows: DataFrame) -> DataFrame:
    """Messages read inside a turn, at the cursor, with their envelope off."""
    rows = at_rows.filter((F.col("type") == "attachment") & F.col("lane").isin("prompt", "relay", "meta"))
    relay, meta = env.relay_head(F.col("text")), env.meta_head(F.col("text"))
    by_lane = lambda r, m, p: F.when(F.col("lane") == "relay", r).when(F.col("lane") == "meta", m).otherwise(p)
    return rows.select(*TX, "line_no", "pos", "ts", "at", F.col("lane").alias("kind"),
                       by_lane(F.coalesce("peer", relay["from_name"]), meta["tag"], F.lit(None)).alias("tag"),
                       by_lane(relay["text"], meta["text"], F.col("text")).alias("text"))


def address_book(rows: DataFrame) -> DataFrame:
    """Socket address -> peer name, as inbound envelopes of the same session said (last one wins)."""
    head = env.relay_head(F.col("text"))
    named = rows.filter(F.col("lane") == "relay").select(
        "session_id", "line_no", "pos", head["addr"].alias("addr"), F.coalesce("peer", head["from_name"]).alias("name"))
    return named.filter(F.col("addr").isNotNull() & F.col("name").isNotNull()).groupBy("session_id", "addr").agg(
        F.max_by("name", _ord()).alias("to_name"))


def sends(calls: DataFrame, rows: DataFrame, spawns: DataFrame | None = None) -> DataFrame:
    """Outbound messages: address, its peer name or own sub-agent, gloss, and what the ack said."""
    head = env.sent_head(F.col("payload"))
    out = calls.filter(F.col("tool") == "SendMessage").select(
        *TX, "line_no", "pos", "ts", "tool_use_id", "request_id", head["to"].alias("addr"), head["summary"].alias("summary"),
        head["message"].alias("message"), F.when(F.col("answered"), env.ack_head(F.col("result"))["delivered"]).alias("delivered"))
    out = out.join(address_book(rows), ["session_id", "addr"], "left")
    if spawns is None:
        return out.withColumn("to_agent", F.lit(None).cast("string"))
    own = spawns.select("session_id", F.col("agent_id").alias("addr"),
                        F.coalesce("description", "agent_type", "agent_id").alias("to_agent"))
    return out.join(own, ["session_id", "addr"], "left")


def annotations(calls: DataFrame) -> DataFrame:
    """Per transaction: files touched, commands, test verdicts, commits, verbatim retries.

    Every distinct item is combined on its own key, so a long transaction never
    becomes one collected list.
    """
    bash = F.col("tool") == "Bash"
    cmd = tools.raw_command(F.col("payload"))
    ran = bash & cmd.rlike(fv.TEST_COMMANDS)
    fail_n = F.regexp_extract(F.col("result"), fv.TEST_FAIL, 1)
    # a failure without a count is one failure; "0 failed" is none
    failing = F.col("result").rlike(fv.TEST_FAIL) & F.when(fail_n == "", True).otherwise(fail_n.cast("bigint") > 0)
    failed = ran & (failing | F.col("error"))
    passed = ran & ~failed & F.col("result").rlike(fv.TEST_PASS)
    path = F.when(F.col("tool").isin(fv.FILE_TOOLS), extract(F.col("payload"), r'"(?:file_path|notebook_path)":"((?:[^"\\]|\\.)*+)"'))
    rows = calls.select(*TX, "tool", F.when(bash, cmd).alias("cmd"), F.nullif(path, F.lit("")).alias("path"), "result", "error",
                        ran.alias("ran"), failed.alias("failed"), passed.alias("passed"))
    n = lambda c: F.sum(F.col(c).cast("bigint")).alias("tests_" + c)
    per_cmd = rows.groupBy(*TX, "cmd").agg(F.count("cmd").alias("n"), n("ran"), n("passed"), n("failed"))
    base = per_cmd.groupBy(*TX).agg(
        F.sum("n").alias("commands"), *[F.sum(f"tests_{x}").alias(f"tests_{x}") for x in ("ran", "passed", "failed")],
        F.sum(F.when(F.col("n") > 1, F.col("n") - 1).otherwise(0)).alias("retries"))
    files = rows.filter("path IS NOT NULL").groupBy(*TX, "path").agg(F.lit(1)).groupBy(*TX).agg(F.count("*").alias("files"))
    shas = F.explode(F.regexp_extract_all("result", F.lit(fv.COMMIT_LINE), F.lit(1)))
    commits = (rows.filter("cmd IS NOT NULL").select(*TX, shas.alias("sha"))
               .select(*TX, F.substring("sha", 1, 7).alias("sha")).distinct()
               .groupBy(*TX).agg(F.count("*").alias("commits")))
    return base.join(files, TX, "left").join(commits, TX, "left").fillna(0, ["files", "commits"])


def touched_files(calls: DataFrame) -> DataFrame:
    """Distinct paths per transaction, long form."""
    path = extract(F.col("payload"), r'"(?:file_path|notebook_path)":"((?:[^"\\]|\\.)*+)"')
    return calls.filter(F.col("tool").isin(fv.FILE_TOOLS)).select(*TX, path.alias("path")).filter("path <> ''").distinct()


def steps(c: Corpus, rows: DataFrame, priced: DataFrame | None = None) -> DataFrame:
    """API requests of each transaction that holds one of their blocks, priced."""
    ids = rows.filter(F.col("request_id").isNotNull()).select(*TX, F.col("request_id").alias("message_id")).distinct()
    reqs = waits.priced_requests(c) if priced is None else priced
    return ids.join(reqs.withColumnRenamed("ts", "step_ts"), ["session_id", "message_id"], "left")


def unplaced(c: Corpus) -> DataFrame:
    """Requests no message row holds."""
    held = c.messages.filter(F.col("lane").isin(TRACE_LANES)).select("session_id", F.col("request_id").alias("message_id")).filter("message_id IS NOT NULL")
    return c.requests.join(held, ["session_id", "message_id"], "left_anti")


STEP_TOKENS = ["input_tokens", "cache_write_tokens", "cache_read_tokens", "output_tokens", "thinking_tokens"]


def transactions(c: Corpus, rows: DataFrame | None = None, calls: DataFrame | None = None) -> DataFrame:
    """One row per transaction: opener, counters, fee (unrounded), dominant model, annotations."""
    rows = trace_rows(c) if rows is None else rows
    calls = trace_calls(rows) if calls is None else calls
    placed = steps(c, rows)
    fee = placed.groupBy(*TX).agg(
        F.count("*").alias("steps"), *[F.coalesce(F.sum(t), F.lit(0)).alias(t) for t in STEP_TOKENS],
        pricing.poisoned_sum(F.col("list_usd")).alias("usd"))
    mix = models.tally(placed, TX).groupBy(*TX).agg(F.min_by("model", F.struct(-F.col("requests"), "model")).alias("model"))
    acted = calls.groupBy(*TX).agg(F.count("*").alias("instructions"), F.sum(F.col("error").cast("bigint")).alias("errors"))
    out = (openers(rows).join(fee, TX, "left").join(mix, TX, "left").join(acted, TX, "left").join(annotations(calls), TX, "left"))
    zeros = ["steps", *STEP_TOKENS, "instructions", "errors", "commands", "tests_ran", "tests_passed", "tests_failed", "retries", "files", "commits"]
    return out.withColumns({z: F.coalesce(z, F.lit(0)) for z in zeros}).withColumn(
        "usd", F.when(F.col("steps") == 0, 0.0).otherwise(F.col("usd")))


def session_totals(c: Corpus, txs: DataFrame | None = None, sent: DataFrame | None = None) -> DataFrame:
    """Turn kinds, steps, fee and sends of each session, unplaced requests included.

    Unrounded fees are summed and rounded once.
    """
    rows = trace_rows(c)
    calls = trace_calls(rows)
    txs = transactions(c, rows, calls) if txs is None else txs
    sent = sends(calls, rows) if sent is None else sent
    kind = lambda k: F.sum((F.col("kind") == k).cast("bigint")).alias(f"{k}_turns")
    placed = txs.groupBy("session_id").agg(
        *[kind(k) for k in ("prompt", "command", "relay", "meta")], F.sum("steps").alias("steps"),
        F.sum("instructions").alias("instructions"), F.sum("errors").alias("errors"),
        *[F.sum(t).alias(t) for t in STEP_TOKENS], pricing.poisoned_sum(F.col("usd")).alias("usd"))
    loose = waits.priced_requests(c, unplaced(c)).groupBy("session_id").agg(
        F.count("*").alias("l_steps"), *[F.sum(t).alias("l_" + t) for t in STEP_TOKENS],
        pricing.poisoned_sum(F.col("list_usd")).alias("l_usd"))
    acks = sent.groupBy("session_id").agg(
        F.count("*").alias("sent"), F.sum((~F.coalesce("delivered", F.lit(True))).cast("bigint")).alias("lost"))
    both = placed.join(loose, "session_id", "full").join(acks, "session_id", "left")
    counts = ["prompt_turns", "command_turns", "relay_turns", "meta_turns", "instructions", "errors", "sent", "lost"]
    usd = F.when(F.col("l_steps").isNull(), F.col("usd")).otherwise(
        F.when(F.col("steps").isNull(), F.col("l_usd")).otherwise(F.col("usd") + F.col("l_usd")))
    plus = lambda n: (F.coalesce(n, F.lit(0)) + F.coalesce("l_" + n, F.lit(0)))
    return both.select(
        "session_id", *[F.coalesce(n, F.lit(0)).alias(n) for n in counts], plus("steps").alias("steps"),
        *[plus(t).alias(t) for t in STEP_TOKENS], pricing.round2(usd).alias("list_usd")).withColumn(
        "transactions", F.col("prompt_turns") + F.col("command_turns") + F.col("relay_turns"))


def fee_by_class(c: Corpus) -> DataFrame:
    """Dollars by token class over all steps of a session, and how many were unpriced."""
    return waits.priced_requests(c).groupBy("session_id").agg(
        *[F.coalesce(F.sum(u), F.lit(0.0)).alias(u) for u in ("usd_input", "usd_cache_write", "usd_cache_read", "usd_output")],
        F.sum(F.col("list_usd").isNull().cast("bigint")).alias("unpriced"))


# --- the same trace read as a dialogue -----------------------------------------

def events(at_rows: DataFrame) -> DataFrame:
    """Speech in reading order: received (rank 0), said (1), sent (2), by cursor."""
    heard = received(at_rows).filter("kind <> 'meta'").select(
        *TX, "at", F.lit(0).alias("rank"), "line_no", "pos", F.when(F.col("kind") == "prompt", "you").otherwise("peer").alias("beat"), "ts", "text")
    said = notes_and_replies(at_rows).filter("part = 'note'").select(
        *TX, "at", F.lit(1).alias("rank"), "line_no", "pos", F.lit("said").alias("beat"), "ts", "text")
    sent = at_rows.filter(F.col("is_call") & (F.col("tool_name") == "SendMessage")).select(
        *TX, "at", F.lit(2).alias("rank"), "line_no", "pos", F.lit("sent").alias("beat"), "ts",
        env.sent_head(tools.call_input(F.col("tool_name"), F.col("text")))["summary"].alias("text"))
    return heard.unionByName(said).unionByName(sent)


def work_beats(c: Corpus, at_rows: DataFrame | None = None, calls: DataFrame | None = None) -> DataFrame:
    """Runs of instructions between events folded to one row each.

    A call belongs to the segment numbered by the cuts at or before it. Cuts
    sit where an event is: before the call at that cursor, and both sides of a send.
    """
    at_rows = trace_rows(c) if at_rows is None else at_rows
    calls = trace_calls(at_rows) if calls is None else calls
    cuts = events(at_rows).select(*TX, F.explode(F.when(F.col("beat") == "sent", F.array(F.col("at"), F.col("at") + 1))
                                                    .otherwise(F.array("at"))).alias("at")).distinct()
    marked = calls.filter("tool <> 'SendMessage'").select(*TX, "at", F.lit(0).alias("cut"), F.lit(1).alias("side"),
                                                         "ts", "ms", "tool", "error", "request_id")
    none = lambda t: F.lit(None).cast(t)
    edges = cuts.select(*TX, "at", F.lit(1).alias("cut"), F.lit(0).alias("side"), none("timestamp").alias("ts"), none("bigint").alias("ms"),
                        none("string").alias("tool"), none("boolean").alias("error"), none("string").alias("request_id"))
    segmented = scan(marked.unionByName(edges), TX, ["at", "side"], running={"segment": F.col("cut")}).filter("cut = 0")
    segmented = staged(segmented, "work-segments")
    key = [*TX, "segment"]
    by_tool = segmented.groupBy(*key, "tool").agg(F.count("*").alias("n"))
    tool_text = by_tool.groupBy(*key).agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("tool", "n"))), lambda t: F.concat(t["tool"], F.lit("x"), t["n"].cast("string"))), ",").alias("tools"))
    first, last = F.min_by("ts", "at"), F.max_by(F.struct("ts", "ms"), "at")
    base = segmented.groupBy(*key).agg(
        F.min("at").alias("from_at"), (F.max("at") + 1).alias("to_at"), F.count("*").alias("instructions"),
        F.sum(F.col("error").cast("bigint")).alias("errors"),
        (millis_between(first, last["ts"]) + F.coalesce(last["ms"], F.lit(0))).alias("ms"))
    reqs = segmented.filter("request_id IS NOT NULL").select(*key, F.col("request_id").alias("message_id")).distinct()
    fee = reqs.join(waits.priced_requests(c).select("session_id", "message_id", "list_usd"), ["session_id", "message_id"], "left").groupBy(*key).agg(
        F.count("*").alias("steps"), pricing.round2(pricing.poisoned_sum(F.col("list_usd"))).alias("list_usd"))
    # a notice counts where it was read: at the call it precedes, or after the very last call
    notices = at_rows.filter((F.col("type") == "attachment") & (F.col("lane") == "meta")).select(
        *TX, F.when(F.col("at") == F.col("calls"), F.col("at") - 1).otherwise(F.col("at")).alias("at"))
    heard = segmented.select(*key, "at").join(notices, [*TX, "at"]).groupBy(*key).agg(F.count("*").alias("notifications"))
    return (base.join(tool_text, key).join(fee, key, "left").join(heard, key, "left")
            .withColumns({"steps": F.coalesce("steps", F.lit(0)), "notifications": F.coalesce("notifications", F.lit(0)),
                          "list_usd": F.when(F.col("steps").isNull(), 0.0).otherwise(F.col("list_usd"))}))


def conversation(c: Corpus) -> DataFrame:
    """Numbered turns (injections stay unnumbered) with their beat counts."""
    rows = trace_rows(c)
    calls = trace_calls(rows)
    txs = staged(transactions(c, rows, calls), "transactions")
    numbered = scan(txs, ["session_id"], ["tx"], running={"turn_no": (F.col("kind") != "meta").cast("bigint")})
    spoken = events(rows).groupBy(*TX).agg(
        *[F.sum((F.col("beat") == b).cast("bigint")).alias(b) for b in ("you", "peer", "said", "sent")])
    worked = work_beats(c, rows, calls).groupBy(*TX).agg(F.count("*").alias("work"))
    counts = ["you", "peer", "said", "sent", "work"]
    return (numbered.join(spoken, TX, "left").join(worked, TX, "left")
            .withColumns({n: F.coalesce(n, F.lit(0)) for n in counts})
            .withColumn("turn_no", F.when(F.col("kind") != "meta", F.col("turn_no"))))


def conversation_tail(turns: DataFrame, session: str, n: int) -> DataFrame:
    """The newest n rows of one session, in order."""
    return turns.filter(F.col("session_id") == session).orderBy(F.col("tx").desc()).limit(n).orderBy("tx")


def job_order(keyed: DataFrame, turns: DataFrame) -> DataFrame:
    """Turns of every job, its sessions one after another: key, session_no, position beside the turn's columns.

    Sessions go by their first instant, then id; turn numbers start anew in each. A session's offset is the running
    sum of the rows before it, so a job of many sessions is never one window.
    """
    per = turns.groupBy("session_id").agg(F.count("*").alias("rows"))
    mine = keyed.select("key", "session_id", F.coalesce(F.unix_micros("first_ts"), F.lit(0)).alias("began")).join(per, "session_id")
    day = F.floor(F.col("began") / 86_400_000_000).cast("bigint")
    placed = scan(mine, ["key"], ["began", "session_id"], day, running={"upto": F.col("rows"), "session_no": F.lit(1).cast("bigint")})
    offsets = small_side(staged(placed.select("key", "session_id", "session_no", (F.col("upto") - F.col("rows")).alias("before")), "job-offsets"))
    return turns.join(offsets, "session_id").withColumn("position", F.col("before") + F.col("tx")).drop("before")


def job_conversation(c: Corpus) -> DataFrame:
    """The conversation of every job, across its sessions."""
    return job_order(idn.job_keys(c.sessions, c.jobs), conversation(c))


def job_conversation_tail(c: Corpus, key: str, n: int) -> DataFrame:
    """The newest n rows of one job's conversation, in order.

    Sessions are taken from the newest back, twice as many each time, until they hold n rows; only their
    messages and requests are read.
    """
    mine = idn.job_keys(c.sessions, c.jobs).where(F.col("key") == key).select("key", "session_id", "first_ts")
    mine = staged(mine, "job-sessions")
    newest, want = mine.orderBy(F.coalesce(F.unix_micros("first_ts"), F.lit(0)).desc(), F.col("session_id").desc()), 4
    while True:
        ids = [r.session_id for r in newest.limit(want).collect()]
        rows = bucketed(c.messages.where(F.col("session_id").isin(ids))).select(*TX).distinct()
        if len(ids) < want or rows.limit(n).count() >= n:
            break
        want *= 2
    within = [F.col("session_id").isin(ids)]
    few = c.with_tables(messages=c.messages.where(*within), requests=c.requests.where(*within), sessions=c.sessions.where(*within))
    turns = job_order(mine.where(*within), conversation(few))
    return turns.orderBy(F.col("position").desc()).limit(n).orderBy("position").drop("position", "session_no")
