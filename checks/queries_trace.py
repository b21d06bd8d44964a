"""Ingest, folds, islands, traces and the waiting lint."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import standins as st
from checks.queries_usage import MAIN_TABLES, PRICE, r2
from checks.registry import query
from checks.standins import with_ctes
from logloom.functions import tools
from logloom.operators import ordered
from logloom.plans import trace as trc, waits
from logloom.sources import transcripts as tr

BIG = "cast({} AS bigint)"


def ingested(spark, sf):
    lines = tr.session_lines(st.event_lines(spark, sf))
    return tr.entries_of(tr.number_records(tr.parse_lines(lines)))


# --- ingest from raw lines ----------------------------------------------------------

@query("a01_b01_ingest_messages", with_ctes(["messages_t"], """SELECT session_id, seq AS line_no, type, lane, tool_name, tool_use_id, is_error, peer, msg_id,
    prompt_id, request_id, text, cwd, epoch_ms(ts) AS ts_ms FROM messages_t JOIN (SELECT session_id, line_no,
    row_number() OVER (PARTITION BY session_id ORDER BY line_no) AS seq FROM rec) USING (session_id, line_no)"""))
def _(spark, sf):
    rows = tr.messages_of(ingested(spark, sf))
    return rows.withColumn("ts_ms", F.unix_millis("ts")).select(
        "session_id", "line_no", "type", "lane", "tool_name", "tool_use_id", "is_error", "peer", "msg_id", "prompt_id",
        "request_id", "text", "cwd", "ts_ms")


@query("a01_bad_instants", with_ctes(["messages_t"], """SELECT session_id, seq AS line_no, lane, prompt_id, CASE WHEN line_no % 7 NOT IN (3, 5, 6) THEN epoch_ms(ts) END AS ts_ms FROM messages_t
    JOIN (SELECT session_id, line_no, row_number() OVER (PARTITION BY session_id ORDER BY line_no) AS seq FROM rec) USING (session_id, line_no)"""))
def _(spark, sf):
    said = r'"timestamp":"([^"]*)"'
    lines, at = st.event_lines(spark, sf), F.col("row_seq") % 7
    millis = F.unix_millis(F.to_timestamp(F.regexp_extract("value", said, 1))).cast("string")
    put = F.when(at == 3, F.lit("not a time")).when(at == 4, millis).when(at == 5, F.lit("")).when(at == 6, F.lit("99999999999999999999"))
    bad = lines.withColumn("value", F.when(put.isNull(), F.col("value")).otherwise(F.regexp_replace("value", F.lit(said), F.concat(F.lit('"timestamp":"'), put, F.lit('"')))))
    rows = tr.messages_of(tr.entries_of(tr.number_records(tr.parse_lines(tr.session_lines(bad)))))
    return rows.select("session_id", "line_no", "lane", "prompt_id", F.unix_millis("ts").alias("ts_ms"))


SPAN = """SELECT session_id, well, lines, epoch_ms(first_ts) AS first_ms, epoch_ms(last_ts) AS last_ms, epoch_ms(last_activity_ts) AS active_ms,
    job_session_id, bridge_key FROM sessions_t"""


def _span(df):
    return df.select("session_id", "well", "lines", F.unix_millis("first_ts").alias("first_ms"), F.unix_millis("last_ts").alias("last_ms"),
                     F.unix_millis("last_activity_ts").alias("active_ms"), "job_session_id", "bridge_key")


@query("a01_c02_c03_ingest_sessions", with_ctes(["sessions_t"], SPAN))
def _(spark, sf):
    return _span(tr.sessions_of(ingested(spark, sf)))


@query("c02_c03_session_span", with_ctes(["sessions_t"], SPAN))
def _(spark, sf):
    return _span(st.corpus(spark, sf, messages=False).sessions)


FOLD = """SELECT session_id, message_id, epoch_ms(ts) AS ts_ms, model, stop_reason, input_tokens, cache_write_tokens, cache_write_1h_tokens,
    cache_read_tokens, output_tokens, thinking_tokens FROM requests_t"""


def _fold(df):
    return df.select("session_id", "message_id", F.unix_millis("ts").alias("ts_ms"), "model", "stop_reason", "input_tokens", "cache_write_tokens",
                     "cache_write_1h_tokens", "cache_read_tokens", "output_tokens", "thinking_tokens")


@query("b05_c04_ingest_requests", with_ctes(["requests_t"], FOLD))
def _(spark, sf):
    return _fold(tr.requests_of(ingested(spark, sf)))


@query("c04_snapshot_fold", with_ctes(["requests_t"], FOLD))
def _(spark, sf):
    return _fold(st.corpus(spark, sf, messages=False).requests)


@query("b02_lane_counts", with_ctes(["messages_t"], "SELECT lane, type, count(*) AS n, count(DISTINCT session_id) AS sessions FROM messages_t GROUP BY 1, 2"))
def _(spark, sf):
    return tr.messages_of(ingested(spark, sf)).groupBy("lane", "type").agg(F.count("*").alias("n"), F.count_distinct("session_id").alias("sessions"))


@query("b03_b06_tool_names_and_acks", with_ctes(["messages_t"], "SELECT tool_name, msg_id IS NOT NULL AS acked, count(*) AS n FROM messages_t WHERE lane IN ('tool', 'meta') GROUP BY 1, 2"))
def _(spark, sf):
    rows = tr.messages_of(ingested(spark, sf)).filter(F.col("lane").isin("tool", "meta"))
    return rows.groupBy("tool_name", F.col("msg_id").isNotNull().alias("acked")).agg(F.count("*").alias("n"))


@query("b04_text_caps", """SELECT doc_id, CASE WHEN length(text) <= 2000 THEN text ELSE substr(text, 1, 1200) || chr(10) || '… … …' || chr(10) || substr(text, length(text) - 799) END AS kept,
    substr(text, 1, 2000) AS call_text FROM documents""")
def _(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    return docs.select("doc_id", tr._head_tail(F.col("text")).alias("kept"), F.substring("text", 1, 2000).alias("call_text"))


@query("c01_prompt_carry", with_ctes(["msg"], "SELECT session_id, line_no, prompt_id FROM msg"))
def _(spark, sf):
    return st.event_entries(spark, sf).select("session_id", "line_no", F.col("turn_id").alias("prompt_id"))


@query("c05_c08_spawn_counters", with_ctes(["spawns_t"], """SELECT agent_id, model, boot_tokens, boot_cached, requests, cast(output_tokens AS bigint) AS output_tokens,
    cast(open_requests AS bigint) AS open_requests, cast(tool_uses AS bigint) AS tool_uses, last_stop_reason, workflow_run_id,
    epoch_ms(first_ts) AS first_ms, epoch_ms(last_ts) AS last_ms FROM spawns_t"""))
def _(spark, sf):
    s = st.spawn_tables(spark, sf)[0]
    return s.select("agent_id", "model", "boot_tokens", "boot_cached", "requests", "output_tokens", "open_requests", "tool_uses",
                    "last_stop_reason", "workflow_run_id", F.unix_millis("first_ts").alias("first_ms"), F.unix_millis("last_ts").alias("last_ms"))


# --- tool classes, shapes --------------------------------------------------------------

CALLS = """calls AS (SELECT session_id, line_no, ts, request_id, tool_name AS tool, ltrim(substr(text, length(tool_name) + 1)) AS payload,
      CASE WHEN tool_name = 'Bash' THEN CASE WHEN text LIKE '%"command":"true"%' THEN 'idle' WHEN text LIKE '%/tasks/%.output%' THEN 'poll' ELSE 'shell' END
        WHEN tool_name = 'Edit' THEN 'write' WHEN tool_name = 'SendMessage' THEN 'relay' WHEN tool_name = 'Agent' THEN 'spawn' ELSE 'other' END AS class,
      CASE WHEN text LIKE '%/tasks/%.output%' THEN regexp_extract(text, '/tasks/([A-Za-z0-9_-]+)', 1) END AS ref
    FROM messages_t WHERE type = 'assistant' AND lane = 'tool')"""


@query("b20_b21_call_classes", with_ctes(["messages_t"], f"WITH {CALLS} SELECT session_id, line_no, class, ref FROM calls"))
def _(spark, sf):
    return waits.calls_of(st.corpus(spark, sf).messages).select("session_id", "line_no", "class", "ref")


@query("b20_command_lines", r"""SELECT doc_id, CASE WHEN regexp_matches(c, '^\s*(:|true)?\s*;?\s*$') THEN 'idle'
    WHEN regexp_matches(c, '(while|until) [^\n]*do [\s\S]*sleep') THEN 'wait' WHEN regexp_matches(c, '/tasks/[a-z0-9]+\.output') THEN 'poll'
    WHEN regexp_matches(c, '^sleep \d') THEN 'wait' ELSE 'shell' END AS class FROM (SELECT doc_id, CASE n_chars % 6
      WHEN 0 THEN 'true' WHEN 1 THEN 'while x; do sleep 1; cat /t/tasks/a.output; done' WHEN 2 THEN concat('sleep 5; cat /t/tasks/d', cast(doc_id AS string), '.output')
      WHEN 3 THEN 'sleep 30' WHEN 4 THEN 'cat lib/tasks/x.rake' ELSE 'true && make' END AS c FROM documents)""")
def _(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    cmds = ["true", "while x; do sleep 1; cat /t/tasks/a.output; done", None, "sleep 30", "cat lib/tasks/x.rake", "true && make"]
    poll = F.concat(F.lit("sleep 5; cat /t/tasks/d"), F.col("doc_id").cast("string"), F.lit(".output"))
    cmd = F.element_at(F.array(*[poll if c is None else F.lit(c) for c in cmds]), (F.col("n_chars") % 6 + 1).cast("int"))
    return docs.select("doc_id", tools.call_class(F.lit("Bash"), F.to_json(F.struct(cmd.alias("command")))).alias("class"))


RANK = "CASE class WHEN 'poll' THEN 9 WHEN 'write' THEN 8 WHEN 'spawn' THEN 7 WHEN 'relay' THEN 6 WHEN 'shell' THEN 5 WHEN 'read' THEN 4 WHEN 'wait' THEN 3 WHEN 'other' THEN 2 ELSE 1 END"
REQ_CLASS = f"rc AS (SELECT session_id, request_id, arg_max(class, {RANK}) AS class, bool_or(ref IS NOT NULL) AS polled FROM calls WHERE request_id IS NOT NULL GROUP BY 1, 2)"


@query("b22_request_class", with_ctes(["messages_t"], f"WITH {CALLS}, {REQ_CLASS} SELECT * FROM rc"))
def _(spark, sf):
    return waits.request_classes(waits.calls_of(st.corpus(spark, sf).messages))


@query("b28_tool_family", with_ctes(["messages_t"], """SELECT family, count(*) AS n FROM (SELECT CASE tool_name WHEN 'Bash' THEN 'run' WHEN 'Edit' THEN 'write'
    WHEN 'Agent' THEN 'agent' WHEN 'SendMessage' THEN 'agent' ELSE 'other' END AS family FROM messages_t WHERE type = 'assistant' AND lane = 'tool') GROUP BY 1"""))
def _(spark, sf):
    calls = waits.calls_of(st.corpus(spark, sf).messages)
    return calls.groupBy(tools.family(F.col("tool")).alias("family")).agg(F.count("*").alias("n"))


def shape_sql(key: str, keep: str) -> str:
    return f"""isl AS (SELECT *, sum(brk) OVER (PARTITION BY session_id ORDER BY line_no) AS run FROM (
        SELECT *, CASE WHEN lag({key}) OVER w IS DISTINCT FROM {key} OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS brk,
          CASE WHEN lag({key}) OVER w = {key} THEN (epoch_ms(ts) - epoch_ms(lag(ts) OVER w)) / 1000.0 END AS gap
        FROM calls WINDOW w AS (PARTITION BY session_id ORDER BY line_no))),
      k AS (SELECT * FROM isl WHERE {keep}),
      runs AS (SELECT session_id, run, count(*) AS n FROM k GROUP BY 1, 2),
      med AS (SELECT session_id, floor(list_sort(list(gap))[cast(floor(count(*) / 2) AS int) + 1] * 10 + 0.5) / 10 AS m FROM k WHERE gap IS NOT NULL GROUP BY 1)"""


POLL_SQL = f"""SELECT r.session_id, cast(sum(n) AS bigint) AS reads, any_value(files) AS files, cast(sum(n) - any_value(files) AS bigint) AS rereads,
    count(*) FILTER (n >= 3) AS runs, max(n) AS longest, cast(coalesce(sum(n) FILTER (n >= 3), 0) AS bigint) AS in_runs, any_value(m) AS median_gap_s
    FROM runs r LEFT JOIN med USING (session_id) JOIN (SELECT session_id, count(DISTINCT ref) AS files FROM k GROUP BY 1) USING (session_id) GROUP BY 1"""
IDLE_SQL = """SELECT r.session_id, cast(sum(n) AS bigint) AS idles, max(n) AS longest_idle, any_value(m) AS median_idle_gap_s FROM runs r LEFT JOIN med USING (session_id) GROUP BY 1"""


@query("c14_poll_shape", with_ctes(["messages_t"], f"WITH {CALLS}, {shape_sql('ref', 'ref IS NOT NULL')} {POLL_SQL}"))
def _(spark, sf):
    return waits.poll_shape(waits.calls_of(st.corpus(spark, sf).messages))


@query("c15_idle_shape", with_ctes(["messages_t"], f"WITH {CALLS}, {shape_sql('class', chr(99) + 'lass = ' + chr(39) + 'idle' + chr(39))} {IDLE_SQL}"))
def _(spark, sf):
    return waits.idle_shape(waits.calls_of(st.corpus(spark, sf).messages))


COST = f"""cell AS (SELECT session_id, message_id, model, cast(ts AS date) AS d, input_tokens AS i, cache_write_tokens AS w, cache_write_1h_tokens AS w1,
    cache_read_tokens AS rd, output_tokens AS o FROM requests_t), {PRICE}"""


@query("e19_class_rollup", with_ctes(MAIN_TABLES + ["messages_t"], f"""WITH {CALLS}, {REQ_CLASS}, {COST},
    per AS (SELECT c.session_id, coalesce(rc.class, 'text') AS class, count(*) AS requests, cast(sum(o) AS bigint) AS output_tokens,
      CASE WHEN count(usd) = count(*) THEN sum(usd) END AS usd FROM cost c LEFT JOIN rc ON rc.session_id = c.session_id AND rc.request_id = c.message_id GROUP BY 1, 2)
    SELECT session_id, class, requests, output_tokens, {r2('usd')} AS list_usd,
      CASE WHEN t <> 0 THEN floor(usd / t * 1000 + 0.5) / 1000 END AS share
    FROM (SELECT *, CASE WHEN count(usd) OVER w = count(*) OVER w THEN sum(usd) OVER w END AS t FROM per WINDOW w AS (PARTITION BY session_id))"""))
def _(spark, sf):
    return waits.class_rollup(st.corpus(spark, sf))


@query("e20_waiting_lint", with_ctes(MAIN_TABLES + ["messages_t"], f"""WITH {CALLS}, {REQ_CLASS}, {COST},
    p AS (WITH {shape_sql('ref', 'ref IS NOT NULL')} {POLL_SQL}), i AS (WITH {shape_sql('class', "class = 'idle'")} {IDLE_SQL}),
    q AS (SELECT *, class = 'idle' AS idled FROM rc WHERE polled OR class = 'idle'),
    u AS (SELECT q.session_id, count(*) FILTER (polled) AS poll_requests, count(*) FILTER (idled) AS idle_requests,
      CASE WHEN count(*) FILTER (polled) = count(usd) FILTER (polled) THEN coalesce(sum(usd) FILTER (polled), 0) END AS pu,
      CASE WHEN count(*) FILTER (idled) = count(usd) FILTER (idled) THEN coalesce(sum(usd) FILTER (idled), 0) END AS iu,
      CASE WHEN count(*) = count(usd) THEN sum(usd) END AS wu
      FROM q JOIN cost c ON c.session_id = q.session_id AND c.message_id = q.request_id GROUP BY 1),
    span AS (SELECT session_id, min(epoch_ms(ts)) AS first_ms, max(epoch_ms(ts)) AS last_ms FROM calls GROUP BY 1)
    SELECT session_id, well, first_ms, last_ms, coalesce(reads, 0) AS reads, coalesce(files, 0) AS files, coalesce(rereads, 0) AS rereads, coalesce(runs, 0) AS runs,
      coalesce(longest, 0) AS longest, coalesce(in_runs, 0) AS in_runs, median_gap_s, coalesce(idles, 0) AS idles, coalesce(longest_idle, 0) AS longest_idle,
      median_idle_gap_s, poll_requests, idle_requests, {r2('pu')} AS poll_usd, {r2('iu')} AS idle_usd, {r2('wu')} AS wasted_usd
    FROM p FULL JOIN i USING (session_id) JOIN u USING (session_id) JOIN span USING (session_id) JOIN sessions_t USING (session_id)"""))
def _(spark, sf):
    rows = waits.waiting_lint(st.corpus(spark, sf))
    return rows.withColumns({"first_ms": F.unix_millis("first"), "last_ms": F.unix_millis("last")}).drop("first", "last")


# --- transactions --------------------------------------------------------------------

ROWS = """tr AS (SELECT *, type = 'assistant' AND lane = 'tool' AS is_call, row_number() OVER (PARTITION BY session_id ORDER BY line_no) AS rn
      FROM messages_t WHERE lane <> 'event'),
    b AS (SELECT *, sum(brk) OVER (PARTITION BY session_id ORDER BY line_no) AS tx,
        sum(cast(is_call AS int)) OVER (PARTITION BY session_id ORDER BY line_no) AS seq FROM (
      SELECT *, CASE WHEN rn = 1 OR prompt_id IS DISTINCT FROM lag(prompt_id) OVER (PARTITION BY session_id ORDER BY line_no) THEN 1 ELSE 0 END AS brk FROM tr)),
    bc AS (SELECT *, seq - cast(is_call AS int) - min(seq - cast(is_call AS int)) OVER w AS cur,
        max(seq) OVER w - min(seq - cast(is_call AS int)) OVER w AS calls FROM b WINDOW w AS (PARTITION BY session_id, tx))"""
SAID = """CASE WHEN lane = 'relay' THEN regexp_extract(text, '\\nbody [0-9]+') ELSE text END"""


@query("c09_transaction_buckets", with_ctes(["messages_t"], f"WITH {ROWS} SELECT session_id, line_no, cast(tx AS bigint) AS tx, cast(cur AS bigint) AS at_call FROM bc"))
def _(spark, sf):
    return trc.cursors(trc.bucketed(st.corpus(spark, sf).messages)).select("session_id", "line_no", "tx", F.col("at").alias("at_call"))


STRIP = r"""CASE lane WHEN 'relay' THEN trim(regexp_extract(text, '(body [0-9]+)', 1))
    WHEN 'meta' THEN CASE WHEN tool_name IS NOT NULL THEN '/clear ' || regexp_extract(text, '<command-args>(a[0-9]+)', 1) ELSE regexp_extract(text, '<summary>(.*)</summary>', 1) END ELSE text END"""
TAG = "CASE lane WHEN 'relay' THEN peer WHEN 'meta' THEN CASE WHEN tool_name IS NOT NULL THEN 'command' ELSE 'task' END END"
OPENERS = f"""op AS (SELECT session_id, tx, arg_min(lane, line_no) FILTER (lane IN ('prompt', 'meta', 'relay')) AS olane,
      arg_min({STRIP}, line_no) FILTER (lane IN ('prompt', 'meta', 'relay')) AS otext, arg_min({TAG}, line_no) FILTER (lane IN ('prompt', 'meta', 'relay')) AS otag,
      arg_min(tool_name, CASE WHEN tool_name IS NOT NULL THEN line_no ELSE line_no + 10000000000 END) FILTER (lane = 'meta') AS mtool,
      arg_min({STRIP}, CASE WHEN tool_name IS NOT NULL THEN line_no ELSE line_no + 10000000000 END) FILTER (lane = 'meta') AS mtext,
      bool_or(lane = 'meta' AND tool_name IS NOT NULL) AS has_command,
      arg_min(coalesce(prompt_id, '-'), line_no) AS prompt_id, epoch_ms(min(ts)) AS ts_ms, epoch_ms(max(ts)) - epoch_ms(min(ts)) AS ms FROM b GROUP BY 1, 2),
    tk AS (SELECT session_id, cast(tx AS bigint) AS tx, nullif(prompt_id, '-') AS prompt_id, ts_ms, ms,
      CASE olane WHEN 'relay' THEN 'relay' WHEN 'meta' THEN CASE WHEN has_command THEN 'command' ELSE 'meta' END ELSE 'prompt' END AS kind,
      CASE WHEN olane = 'relay' THEN otag WHEN olane = 'meta' AND NOT has_command THEN 'task' END AS tag,
      CASE WHEN olane = 'meta' THEN mtext ELSE coalesce(otext, '') END AS message FROM op)"""


@query("c10_b07_b08_transaction_openers", with_ctes(["messages_t"], f"WITH {ROWS}, {OPENERS} SELECT * FROM tk"))
def _(spark, sf):
    o = trc.openers(trc.bucketed(st.corpus(spark, sf).messages))
    return o.withColumn("ts_ms", F.unix_millis("ts")).drop("ts")


PAIRED = """res AS (SELECT session_id, tx, tool_use_id, arg_max(ts, line_no) AS rts, arg_max(is_error, line_no) AS failed, arg_max(text, line_no) AS rtext
      FROM b WHERE type = 'user' AND lane = 'tool' GROUP BY 1, 2, 3),
    ended AS (SELECT session_id, request_id, max(ts) AS ended FROM b WHERE request_id IS NOT NULL GROUP BY 1, 2),
    ix AS (SELECT bc.session_id, tx, line_no, cur, calls, ts, request_id, tool_name AS tool, text, coalesce(failed, false) AS error, coalesce(rtext, '') AS result, rts IS NOT NULL AS answered,
      CASE WHEN rts IS NOT NULL THEN greatest(epoch_ms(rts) - epoch_ms(coalesce(ended, ts)), 0) END AS ms
      FROM bc LEFT JOIN res USING (session_id, tx, tool_use_id) LEFT JOIN ended USING (session_id, request_id) WHERE is_call)"""


@query("c11_call_result_pairing", with_ctes(["messages_t"], f"WITH {ROWS}, {PAIRED} SELECT session_id, cast(tx AS bigint) AS tx, line_no, tool, error, result, ms FROM ix"))
def _(spark, sf):
    return trc.instructions(trc.bucketed(st.corpus(spark, sf).messages)).select("session_id", "tx", "line_no", "tool", "error", "result", "ms")


@query("c12_notes_and_replies", with_ctes(["messages_t"], f"""WITH {ROWS} SELECT session_id, cast(tx AS bigint) AS tx, line_no, cast(cur AS bigint) AS at_call,
    CASE WHEN line_no = max(line_no) OVER (PARTITION BY session_id, tx) AND cur = calls THEN 'reply' ELSE 'note' END AS part, text
    FROM bc WHERE lane = 'text'"""))
def _(spark, sf):
    rows = trc.notes_and_replies(trc.cursors(trc.bucketed(st.corpus(spark, sf).messages)))
    return rows.select("session_id", "tx", "line_no", F.col("at").alias("at_call"), "part", "text")


@query("c12_thoughts", with_ctes(["messages_t"], f"WITH {ROWS} SELECT session_id, cast(tx AS bigint) AS tx, line_no, cast(cur AS bigint) AS at_call, text FROM bc WHERE lane = 'thinking'"))
def _(spark, sf):
    return trc.thoughts(trc.cursors(trc.bucketed(st.corpus(spark, sf).messages))).select("session_id", "tx", "line_no", F.col("at").alias("at_call"), "text")


@query("c13_received_mid_turn", with_ctes(["messages_t"], f"""WITH {ROWS} SELECT session_id, cast(tx AS bigint) AS tx, line_no, cast(cur AS bigint) AS at_call, lane AS kind, {TAG} AS tag, {STRIP} AS text
    FROM bc WHERE type = 'attachment'"""))
def _(spark, sf):
    rows = trc.received(trc.cursors(trc.bucketed(st.corpus(spark, sf).messages)))
    return rows.select("session_id", "tx", "line_no", F.col("at").alias("at_call"), "kind", "tag", "text")


@query("b09_d13_sends", with_ctes(["messages_t"], f"""WITH {ROWS}, {PAIRED} SELECT session_id, cast(tx AS bigint) AS tx, line_no, regexp_extract(text, '"to":"([^"]*)"', 1) AS addr,
    regexp_extract(text, '"summary":"([^"]*)"', 1) AS summary, regexp_extract(text, '"message":"([^"]*)"', 1) AS message,
    CASE WHEN result LIKE '{{"success":true%' THEN true WHEN result LIKE '{{"success":false%' THEN false END AS delivered FROM ix WHERE tool = 'SendMessage'"""))
def _(spark, sf):
    rows = trc.bucketed(st.corpus(spark, sf).messages)
    out = trc.sends(trc.instructions(rows), rows)
    return out.select("session_id", "tx", "line_no", "addr", "summary", "message", "delivered")


@query("d13_address_book", with_ctes(["messages_t"], """SELECT session_id, 'uds:/s/' || substr(peer, 2) || '.sock' AS addr, peer AS to_name FROM messages_t WHERE lane = 'relay' GROUP BY ALL"""))
def _(spark, sf):
    return trc.address_book(trc.bucketed(st.corpus(spark, sf).messages))


ANNOTATED = """an AS (SELECT session_id, tx, count(*) FILTER (tool = 'Bash') AS commands, count(DISTINCT text) FILTER (tool = 'Edit') AS files,
      count(*) FILTER (t) AS tests_ran, count(*) FILTER (t AND f) AS tests_failed, count(*) FILTER (t AND NOT f AND result LIKE '%3 passed%') AS tests_passed,
      count(*) FILTER (tool = 'Bash') - count(DISTINCT text) FILTER (tool = 'Bash') AS retries,
      count(DISTINCT regexp_extract(result, 'abc[0-9]{4}')) FILTER (tool = 'Bash' AND result LIKE '[main%') AS commits
    FROM (SELECT *, text LIKE '%pytest%' AS t, error OR (result LIKE '%failed%' AND result NOT LIKE '0 failed%') AS f FROM ix) GROUP BY 1, 2)"""


@query("e18_annotations", with_ctes(["messages_t"], f"WITH {ROWS}, {PAIRED}, {ANNOTATED} SELECT session_id, cast(tx AS bigint) AS tx, commands, files, tests_ran, tests_failed, tests_passed, retries, commits FROM an"))
def _(spark, sf):
    return trc.annotations(trc.instructions(trc.bucketed(st.corpus(spark, sf).messages)))


FEES = f"""st AS (SELECT DISTINCT session_id, tx, request_id AS message_id FROM b WHERE request_id IS NOT NULL), {COST},
    fee AS (SELECT s.session_id, s.tx, count(*) AS steps, cast(sum(o) AS bigint) AS output_tokens, CASE WHEN count(usd) = count(*) THEN sum(usd) END AS usd
      FROM st s JOIN cost c USING (session_id, message_id) GROUP BY 1, 2)"""


@query("e17_transactions", with_ctes(MAIN_TABLES + ["messages_t"], f"""WITH {ROWS}, {OPENERS}, {PAIRED}, {FEES},
    act AS (SELECT session_id, tx, count(*) AS instructions, count(*) FILTER (error) AS errors FROM ix GROUP BY 1, 2)
    SELECT tk.session_id, tk.tx, kind, tag, message, coalesce(steps, 0) AS steps, coalesce(instructions, 0) AS instructions, coalesce(errors, 0) AS errors,
      coalesce(output_tokens, 0) AS output_tokens, {r2('CASE WHEN steps IS NULL THEN 0 ELSE usd END')} AS list_usd
    FROM tk LEFT JOIN fee ON fee.session_id = tk.session_id AND fee.tx = tk.tx LEFT JOIN act ON act.session_id = tk.session_id AND act.tx = tk.tx"""))
def _(spark, sf):
    from logloom.functions.pricing import round2
    t = trc.transactions(st.corpus(spark, sf))
    return t.select("session_id", "tx", "kind", "tag", "message", "steps", "instructions", "errors", "output_tokens", round2(F.col("usd")).alias("list_usd"))


@query("e17_session_totals", with_ctes(MAIN_TABLES + ["messages_t"], f"""WITH {ROWS}, {OPENERS}, {PAIRED}, {FEES},
    k AS (SELECT session_id, count(*) FILTER (kind = 'prompt') AS prompt_turns, count(*) FILTER (kind = 'command') AS command_turns,
      count(*) FILTER (kind = 'relay') AS relay_turns, count(*) FILTER (kind = 'meta') AS meta_turns FROM tk GROUP BY 1),
    f AS (SELECT session_id, cast(sum(steps) AS bigint) AS steps, cast(sum(output_tokens) AS bigint) AS output_tokens, CASE WHEN count(usd) = count(*) THEN sum(usd) END AS usd FROM fee GROUP BY 1),
    a AS (SELECT session_id, count(*) AS instructions, count(*) FILTER (error) AS errors, count(*) FILTER (tool = 'SendMessage') AS sent,
      count(*) FILTER (tool = 'SendMessage' AND result LIKE '{{"success":false%') AS lost FROM ix GROUP BY 1)
    SELECT k.*, prompt_turns + command_turns + relay_turns AS transactions, coalesce(steps, 0) AS steps, coalesce(output_tokens, 0) AS output_tokens,
      {r2('CASE WHEN steps IS NULL THEN 0 ELSE usd END')} AS list_usd, coalesce(instructions, 0) AS instructions, coalesce(errors, 0) AS errors, coalesce(sent, 0) AS sent, coalesce(lost, 0) AS lost
    FROM k LEFT JOIN f USING (session_id) LEFT JOIN a USING (session_id)"""))
def _(spark, sf):
    t = trc.session_totals(st.corpus(spark, sf))
    return t.select("session_id", "prompt_turns", "command_turns", "relay_turns", "meta_turns", "transactions", "steps", "output_tokens", "list_usd",
                    "instructions", "errors", "sent", "lost")


@query("d14_unplaced_requests", with_ctes(["requests_t", "messages_t"], """SELECT r.session_id, r.message_id FROM requests_t r WHERE NOT EXISTS (
    SELECT 1 FROM messages_t m WHERE m.session_id = r.session_id AND m.request_id = r.message_id AND m.lane <> 'thinking')"""))
def _(spark, sf):
    c = st.corpus(spark, sf)
    return trc.unplaced(c.with_tables(messages=c.messages.filter("lane <> 'thinking'"))).select("session_id", "message_id")


@query("e33_fee_by_class", with_ctes(MAIN_TABLES, f"""WITH {COST} SELECT session_id, {', '.join(f'{r2(f"coalesce(sum({a}), 0)")} AS {b}' for a, b in (('u_in', 'usd_input'), ('u_w', 'usd_cache_write'), ('u_rd', 'usd_cache_read'), ('u_out', 'usd_output')))},
    count(*) FILTER (usd IS NULL) AS unpriced FROM cost GROUP BY 1"""))
def _(spark, sf):
    from logloom.functions.pricing import round2
    out = trc.fee_by_class(st.corpus(spark, sf, messages=False))
    return out.select("session_id", *[round2(F.col(c)).alias(c) for c in ("usd_input", "usd_cache_write", "usd_cache_read", "usd_output")], "unpriced")


EVENTS = """note AS (SELECT session_id, tx, cur, line_no, CASE WHEN line_no = max(line_no) OVER (PARTITION BY session_id, tx) AND cur = calls THEN 'reply' ELSE 'said' END AS beat FROM bc WHERE lane = 'text'),
    evn AS (SELECT session_id, tx, cur, beat FROM note WHERE beat = 'said'
      UNION ALL SELECT session_id, tx, cur, CASE WHEN lane = 'prompt' THEN 'you' ELSE 'peer' END FROM bc WHERE type = 'attachment' AND lane IN ('prompt', 'relay')
      UNION ALL SELECT session_id, tx, cur, 'sent' FROM bc WHERE is_call AND tool_name = 'SendMessage'),
    cutp AS (SELECT DISTINCT session_id, tx, cur FROM (SELECT session_id, tx, cur FROM evn UNION ALL SELECT session_id, tx, cur + 1 FROM evn WHERE beat = 'sent')),
    seg AS (SELECT i.*, (SELECT count(*) FROM cutp c WHERE c.session_id = i.session_id AND c.tx = i.tx AND c.cur <= i.cur) AS segment FROM ix i WHERE tool <> 'SendMessage')"""


@query("c19_work_beats", with_ctes(["messages_t"], f"""WITH {ROWS}, {PAIRED}, {EVENTS} SELECT session_id, cast(tx AS bigint) AS tx, segment, cast(min(cur) AS bigint) AS from_at, count(*) AS instructions,
    count(*) FILTER (error) AS errors, count(DISTINCT request_id) AS steps, epoch_ms(max(ts)) + coalesce(arg_max(coalesce(ms, 0), cur), 0) - epoch_ms(min(ts)) AS ms FROM seg GROUP BY 1, 2, 3"""))
def _(spark, sf):
    w = trc.work_beats(st.corpus(spark, sf))
    return w.select("session_id", "tx", "segment", "from_at", "instructions", "errors", "steps", "ms")


@query("e21_conversation", with_ctes(["messages_t"], f"""WITH {ROWS}, {OPENERS}, {PAIRED}, {EVENTS},
    n AS (SELECT session_id, tx, count(*) FILTER (beat = 'you') AS you, count(*) FILTER (beat = 'peer') AS peer, count(*) FILTER (beat = 'said') AS said, count(*) FILTER (beat = 'sent') AS sent FROM evn GROUP BY 1, 2),
    w AS (SELECT session_id, tx, count(DISTINCT segment) AS work FROM seg GROUP BY 1, 2)
    SELECT session_id, tx, kind, CASE WHEN kind <> 'meta' THEN cast(sum(CASE WHEN kind <> 'meta' THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY tx) AS bigint) END AS turn_no,
      coalesce(you, 0) AS you, coalesce(n.peer, 0) AS peer, coalesce(said, 0) AS said, coalesce(sent, 0) AS sent, coalesce(work, 0) AS work
    FROM tk LEFT JOIN n USING (session_id, tx) LEFT JOIN w USING (session_id, tx)"""))
def _(spark, sf):
    t = trc.conversation(st.corpus(spark, sf))
    return t.select("session_id", "tx", "kind", "turn_no", "you", "peer", "said", "sent", "work")
