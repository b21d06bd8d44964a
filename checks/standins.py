"""The given tables read as session logs.

The test tables hold no logs, so every operator runs on whole tables mapped to
the engine's shapes. The mapping itself is written once, as SQL expressions
both engines understand; operator logic is never shared between the two sides.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from logloom.functions import pricing
from logloom.operators.stages import shared_folder
from logloom.plans import text_index as ti
from logloom.schemas import Corpus
from logloom.sources import transcripts as tr

RATES = [
    ("alpha", "2024-01-01", 2.0, 2.5, 4.0, 0.25, 10.0),
    ("alpha", "2024-01-15", 4.0, 5.0, 8.0, 0.5, 20.0),
    ("alpha-2-mini", "2024-01-10", 1.0, 1.25, 2.0, 0.125, 5.0),
    ("beta", "2024-01-20", 3.0, 3.75, 6.0, 0.25, 15.0),
    ("beta", "2024-01-25", 3.5, 4.0, 7.0, 0.25, 16.0),
]
ORDER_SLOTS = 200  # sub-agents and relayed messages hang on the first 200 sessions


def hex8(expr: str, d: str) -> str:
    return f"format_string('%08x', {expr})" if d == "spark" else f"printf('%08x', {expr})"


def sid(expr: str, d: str) -> str:
    return f"concat({hex8(expr, d)}, '-s')"


def div(a: str, b: int) -> str:
    return f"cast(floor(({a}) / {b}) AS bigint)"


def s(expr: str) -> str:
    return f"cast({expr} AS string)"


def record_columns(d: str) -> dict[str, str]:
    """events row -> one parsed log record with at most one entry."""
    peer = f"concat('n', {s('k % 7')})"
    envelope = (f"concat('<cross-session-message from=\"uds:/s/', {s('k % 7')}, '.sock\" from-name=\"', {peer}, "
                f"'\">\nbody ', {s('k')}, '\n</cross-session-message>')")
    notice = f"concat('<task-notification><status>completed</status><summary>job ', {s('k')}, ' done</summary></task-notification>')"
    command = f"concat('<command-name>/clear</command-name><command-args>a', {s('k')}, '</command-args>')"
    call = f"""CASE
        WHEN m <= 3 THEN concat('Bash {{"command":"cat /tmp/x/tasks/t', {s('cast(m = 3 AS int)')}, '.output"}}')
        WHEN m <= 5 THEN 'Bash {{"command":"true"}}'
        WHEN m = 6 THEN concat('Edit {{"file_path":"/src/f', {s('k')}, '.py"}}')
        WHEN m = 7 THEN concat('Bash {{"command":"pytest -q x', {s(div('k', 20))}, '"}}')
        WHEN m = 8 THEN concat('SendMessage {{"to":"', {peer}, '","summary":"note ', {s('k')}, '","message":"hello ', {s('k')}, '"}}')
        ELSE 'Agent {{"description":"look"}}' END"""
    result = f"""CASE
        WHEN m = 8 THEN concat('{{"success":', CASE WHEN k % 3 = 0 THEN 'false' ELSE 'true' END, ',"message":"x","msg_id":"m', {s('line_no')}, '"}}')
        WHEN m = 7 THEN concat({s('k % 4')}, ' failed, 3 passed')
        WHEN m = 6 THEN concat('[main abc', {s('1000 + k')}, '] msg')
        ELSE concat('ok ', {s('k')}) END"""
    steer = f"""concat('auto_mode: {{"bashFirst":', CASE WHEN k >= 50 THEN 'true' ELSE 'false' END, ',"bashFirstSteer":"', CASE WHEN k % 20 = 9 THEN 'strict' ELSE 'relaxed' END, '","steerOnly":null,"bypass":null}}')"""
    user = "et = 'signup'"
    assistant = "et IN ('click', 'purchase')"
    return {
        "type": f"""CASE WHEN {user} THEN CASE WHEN m >= 7 THEN 'attachment' ELSE 'user' END
            WHEN {assistant} THEN 'assistant' WHEN et = 'view' THEN 'user'
            WHEN m = 8 THEN 'bridge-session' WHEN m = 9 THEN 'attachment' ELSE 'system' END""",
        "lane": f"""CASE WHEN {user} THEN CASE WHEN m <= 3 OR m = 7 THEN 'prompt' WHEN m IN (4, 8) THEN 'relay' ELSE 'meta' END
            WHEN et IN ('click', 'view') THEN 'tool'
            WHEN et = 'purchase' THEN CASE WHEN k % 3 = 0 THEN 'thinking' ELSE 'text' END
            WHEN m = 8 THEN NULL ELSE 'event' END""",
        "text": f"""CASE WHEN {user} THEN CASE WHEN m <= 3 THEN concat('please do task ', {s('k')})
              WHEN m = 7 THEN concat('also ', {s('k')}) WHEN m IN (4, 8) THEN {envelope}
              WHEN m = 5 THEN {command} ELSE {notice} END
            WHEN et = 'click' THEN {call} WHEN et = 'view' THEN {result}
            WHEN et = 'purchase' THEN concat(CASE WHEN k % 3 = 0 THEN 'hmm ' ELSE 'note ' END, {s('k')})
            WHEN m = 9 THEN {steer} ELSE concat('bridge_status: beat ', {s('k')}) END""",
        "tool_name": f"""CASE WHEN {user} AND m = 5 THEN 'command:clear'
            WHEN et = 'click' THEN CASE WHEN m <= 5 OR m = 7 THEN 'Bash' WHEN m = 6 THEN 'Edit'
              WHEN m = 8 THEN 'SendMessage' ELSE 'Agent' END END""",
        "tool_use_id": f"CASE WHEN et IN ('click', 'view') THEN concat('c', {s('k % 5')}) END",
        "is_error": "et = 'view' AND m = 3",
        "peer": f"CASE WHEN {user} AND m IN (4, 8) THEN {peer} END",
        "msg_id": f"CASE WHEN ({user} AND m IN (4, 8)) OR (et = 'view' AND m = 8) THEN concat('m', {s('line_no')}) END",
        "own_prompt": f"CASE WHEN {user} AND m <= 6 THEN concat('P', {s('line_no')}) END",
        "cwd": f"concat('/u/code/w', {s('uid % 12')}, CASE WHEN k % 17 = 0 THEN '/.claude/worktrees/x' ELSE '' END)",
        "root_id": f"CASE WHEN uid % 3 <> 0 THEN {sid('uid - uid % 3', d)} END",
        "bridge_id": f"CASE WHEN et = 'error' AND m = 8 AND uid % 5 = 0 THEN concat('B', {s(div('uid', 15))}) END",
        "request_id": f"CASE WHEN {assistant} THEN concat('r', {s(div('line_no', 600))}) END",
        "model": "CASE WHEN k = 7 THEN 'gamma-1' WHEN m < 5 THEN 'alpha-2' WHEN m < 8 THEN 'alpha-2-mini' ELSE 'beta-1' END",
        "stop_reason": "CASE WHEN k % 5 = 0 THEN NULL WHEN et = 'click' THEN 'tool_use' ELSE 'end_turn' END",
        "input_tokens": "cast(k + 1 AS bigint)",
        "cache_write_tokens": "cast(k * 10 AS bigint)",
        "cache_write_5m_tokens": "cast(0 AS bigint)",
        "cache_write_1h_tokens": "cast((k % 3) * k * 6 AS bigint)",
        "cache_read_tokens": "cast(round(value * 100) AS bigint)",
        "output_tokens": "cast(round(value) AS bigint)",
        "thinking_tokens": "cast(k % 7 AS bigint)",
    }


def event_base(d: str) -> dict[str, str]:
    k = "cast(regexp_extract(props, '([0-9]+)', 1) AS int)"
    unit = "MILLISECOND" if d == "spark" else "milliseconds"
    return {
        "line_no": "event_id", "ts": f"cast(date_trunc('{unit}', ts) AS timestamp)", "uid": "user_id", "et": "event_type", "value": "value",
        "k": k, "m": f"{k} % 10", "session_id": sid("user_id", d),
        "well": f"concat('-u-code-w', {s('user_id % 12')})",
    }


def spawn_columns(d: str) -> dict[str, str]:
    """lineitem ⋈ orders row -> one assistant record of a sub-agent."""
    return {
        "agent_id": f"concat('a', {s('l_orderkey')})",
        "session_id": sid(f"o_custkey % {ORDER_SLOTS}", d),
        "well": f"concat('-u-code-w', {s(f'(o_custkey % {ORDER_SLOTS}) % 12')})",
        "workflow_run_id": f"CASE WHEN o_orderstatus = 'P' THEN concat('wf_', {s(div('l_orderkey', 20))}) END",
        "agent_type": "o_orderpriority",
        "requested_model": "CASE o_orderstatus WHEN 'F' THEN 'beta' WHEN 'O' THEN 'alpha' END",
        "line_no": "cast(l_linenumber AS bigint) * 1000000000000 + l_partkey * 1000000 + l_suppkey",
        "message_id": f"concat('q', {s(div('l_linenumber', 2))})",
        "ts": "cast(l_shipdate AS timestamp)",
        "model": "CASE WHEN l_quantity = 50 AND l_returnflag = 'N' THEN NULL WHEN l_returnflag = 'R' THEN 'beta-1' WHEN l_linestatus = 'F' THEN 'alpha-2' ELSE 'alpha-2-mini' END",
        "stop_reason": "CASE WHEN l_tax >= 0.07 THEN NULL WHEN l_linestatus = 'O' THEN 'end_turn' ELSE 'tool_use' END",
        "input_tokens": "cast(l_quantity AS bigint)",
        "cache_write_tokens": "cast(l_quantity * 20 AS bigint)",
        "cache_write_5m_tokens": "cast(0 AS bigint)",
        "cache_write_1h_tokens": "cast(l_quantity AS bigint) * (l_linenumber % 3) * 15",
        "cache_read_tokens": "cast(floor(l_extendedprice) AS bigint)",
        "output_tokens": "cast(floor(l_extendedprice / 100) AS bigint)",
        "thinking_tokens": "cast(l_linenumber AS bigint)",
        "tool_uses": "CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END",
    }


def message_pair_columns(d: str) -> dict[str, str]:
    """orders row -> one message between two sessions: call, ack and copy."""
    return {
        "msg": f"concat('o', {s('o_orderkey')})",
        "sender": sid(f"o_custkey % {ORDER_SLOTS}", d),
        "receiver": sid(f"o_orderkey % {ORDER_SLOTS}", d),
        "sender_no": f"o_custkey % {ORDER_SLOTS}",
        "receiver_no": f"o_orderkey % {ORDER_SLOTS}",
        "sent_at": "cast(o_orderdate AS timestamp)",
        "refused": "o_orderpriority = '5-LOW' AND o_orderstatus = 'F'",
        "copied": "NOT (o_orderpriority = '5-LOW' AND o_orderstatus = 'F') AND o_orderpriority <> '4-NOT SPECIFIED'",
        "acked": "o_orderpriority <> '1-URGENT'",
        "mid_turn": "o_orderstatus = 'P'",
    }


def job_columns(d: str) -> dict[str, str]:
    """supplier row -> one job-state row."""
    root = "s_suppkey * 3"
    return {
        "job_id": hex8(root, d),
        "session_id": sid(root, d),
        "bridge_key": f"CASE WHEN s_nationkey % 2 = 0 THEN concat('J', {s('s_suppkey')}) END",
        "name": f"concat('n', {s('s_suppkey % 40')})",
        "cwd": f"concat('/u/code/w', {s('s_nationkey % 12')})",
        "state": "CASE s_nationkey % 4 WHEN 0 THEN 'working' WHEN 1 THEN 'blocked' WHEN 2 THEN 'gone' ELSE 'done' END",
        "source": "CASE WHEN s_nationkey % 5 = 4 THEN 'peer' ELSE 'state' END",
    }


def ledger_columns(d: str) -> dict[str, str]:
    """part row -> one spawn-ledger line."""
    parent = "p_partkey * 7 % 150"
    return {
        "child": hex8("p_partkey % 70", d),
        "seq": "p_partkey",
        "kind": "CASE WHEN p_size % 2 = 0 THEN 'spawn' ELSE 'fork' END",
        "parent_session": f"CASE WHEN p_size % 4 = 0 THEN {sid(parent, d)} END",
        "parent_bridge": f"CASE WHEN p_size % 4 IN (0, 1) THEN concat('cse_B', {s('p_partkey % 12')}) END",
        "parent_job": f"CASE WHEN p_size % 4 = 2 THEN {hex8(parent, d)} END",
    }


def limit_columns() -> dict[str, str]:
    """events row -> one reading of a rate-limit window."""
    return {
        "kind": """CASE event_type WHEN 'click' THEN 'five_hour' WHEN 'view' THEN 'seven_day'
            WHEN 'purchase' THEN 'seven_day_alpha' WHEN 'signup' THEN 'seven_day_overage_included'
            ELSE 'spend_limit' END""",
        "pct": "least(value, 100.0)",
        "source": "CASE WHEN user_id % 9 = 0 THEN 'transcript' ELSE 'mod' END",
    }


def _load(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _mapped(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    return df.selectExpr(*[f"{e} AS {n}" for n, e in columns.items()])


def flat_entries(spark: SparkSession, sf: str) -> DataFrame:
    """Events as exploded log records (at most one entry each)."""
    base = _mapped(_load(spark, sf, "events"), event_base("spark"))
    flat = base.selectExpr("*", *[f"{e} AS {n}" for n, e in record_columns("spark").items()])
    none = F.lit(None).cast("string")
    rows = flat.withColumns({"uuid": none, "git_branch": F.lit("main"), "effort": none, "pos": F.lit(0),
                             "head": F.lit(True)}).drop("uid", "et", "value", "k", "m")
    return rows.withColumnRenamed("own_prompt", "prompt_id")


def event_entries(spark: SparkSession, sf: str) -> DataFrame:
    """The same with prompt ids carried by the engine."""
    return tr.carry_prompts(flat_entries(spark, sf))


def event_lines(spark: SparkSession, sf: str) -> DataFrame:
    """The same records as raw JSON log lines, one file per session."""
    base = _mapped(_load(spark, sf, "events"), event_base("spark"))
    r = base.selectExpr("*", *[f"{e} AS {n}" for n, e in record_columns("spark").items()])
    origin = F.when(F.col("lane") == "relay", F.struct(F.lit("peer").alias("kind"), F.col("peer").alias("name"), "msg_id"))
    typed = F.col("type")
    payload = F.substring_index(F.substring(F.col("text"), F.length("tool_name") + 2, F.length("text")), "\u0000", 1)
    block = (F.when(F.col("et") == "click",
                    F.concat(F.lit('[{"type":"tool_use","id":"'), F.col("tool_use_id"), F.lit('","name":"'),
                             F.col("tool_name"), F.lit('","input":'), payload, F.lit("}]")))
             .when(F.col("et") == "view",
                   F.to_json(F.array(F.struct(F.lit("tool_result").alias("type"), "tool_use_id",
                                              F.col("text").alias("content"), "is_error"))))
             .when(F.col("lane") == "thinking",
                   F.to_json(F.array(F.struct(F.lit("thinking").alias("type"), F.col("text").alias("thinking")))))
             .when(F.col("lane") == "text",
                   F.to_json(F.array(F.struct(F.lit("text").alias("type"), "text")))))
    usage = F.when(typed == "assistant", F.struct(
        "input_tokens", F.col("cache_write_tokens").alias("cache_creation_input_tokens"),
        F.col("cache_read_tokens").alias("cache_read_input_tokens"), "output_tokens",
        F.struct(F.col("cache_write_5m_tokens").alias("ephemeral_5m_input_tokens"),
                 F.col("cache_write_1h_tokens").alias("ephemeral_1h_input_tokens")).alias("cache_creation"),
        F.struct("thinking_tokens").alias("output_tokens_details")))
    head = F.to_json(F.struct(
        "type", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("timestamp"),
        F.col("session_id").alias("sessionId"), F.coalesce("root_id", "session_id").alias("session_id"),
        "cwd", F.lit("main").alias("gitBranch"), F.col("own_prompt").alias("promptId"),
        F.when(typed == "bridge-session", F.concat(F.lit("cse_"), "bridge_id")).alias("bridgeSessionId"),
        F.when(typed == "user", F.col("lane").isin("meta", "relay")).alias("isMeta"),
        F.when(typed == "user", origin).alias("origin"),
        F.when(typed == "system", "bridge_status").alias("subtype"),
        F.when(typed == "system", F.regexp_replace("text", "^bridge_status: ", "")).alias("content"),
        F.when((typed == "attachment") & (F.col("et") == "signup"), F.struct(
            F.lit("queued_command").alias("type"), F.col("text").alias("prompt"), origin.alias("origin"))).alias("attachment")))
    body = (F.when(typed == "assistant",
                   F.concat(F.lit(',"message":{"role":"assistant","id":"'), F.col("request_id"), F.lit('","model":"'),
                            F.col("model"), F.lit('"'),
                            F.coalesce(F.concat(F.lit(',"stop_reason":"'), F.col("stop_reason"), F.lit('"')), F.lit("")),
                            F.lit(',"content":'), block, F.lit(',"usage":'), F.to_json(usage), F.lit("}")))
            .when(F.col("et") == "view", F.concat(F.lit(',"message":{"role":"user","content":'), block, F.lit("}")))
            .when(typed == "user", F.concat(F.lit(',"message":'),
                                            F.to_json(F.struct(F.lit("user").alias("role"), F.col("text").alias("content")))))
            .when((typed == "attachment") & (F.col("et") == "error"),
                  F.concat(F.lit(',"attachment":{"type":"auto_mode",'),
                           F.substring(F.col("text"), F.lit(13), F.length("text"))))
            .otherwise(F.lit("")))
    line = F.concat(F.expr("substring(head, 1, length(head) - 1)"), F.col("body"), F.lit("}"))
    lines = (r.withColumns({"head": head, "body": body})
            .select(line.alias("value"), F.concat(F.lit("/logs/"), "well", F.lit("/"), "session_id", F.lit(".jsonl")).alias("file_path"),
                    F.lit(0).cast("bigint").alias("size"), F.lit(0).cast("bigint").alias("mtime_ms"),
                    F.floor(F.col("line_no") / 4096).cast("bigint").alias("block_start"), F.col("line_no").alias("row_seq")))
    # the line text ends here, as it would in a file: nothing is optimised across it
    return lines.mapInArrow(lambda batches: batches, lines.schema)


def spawn_records(spark: SparkSession, sf: str) -> DataFrame:
    joined = _load(spark, sf, "lineitem").join(_load(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    none = F.lit(None).cast("string")
    return _mapped(joined, spawn_columns("spark")).withColumnRenamed("message_id", "reply_id").withColumns({
        "answered": F.lit(True), "synthetic": F.lit(False), "has_usage": F.lit(True), "refused": F.lit(False),
        "closing_tool": none, "closing_id": none,
        "results": F.lit(None).cast("array<struct<tool_use_id:string,is_error:boolean>>")})


def spawn_tables(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    records = spawn_records(spark, sf)
    meta = records.groupBy("agent_id").agg(F.first("agent_type").alias("agent_type"),
                                           F.first("requested_model").alias("requested_model"))
    return tr.spawns_of(records, meta), tr.spawn_requests_of(records)


def pair_messages(spark: SparkSession, sf: str) -> DataFrame:
    """Messages between sessions as engine rows: call, ack and the receiver's copy."""
    p = _mapped(_load(spark, sf, "orders"), message_pair_columns("spark"))
    order = F.regexp_extract("msg", "([0-9]+)", 1).cast("bigint") * 10
    name = F.concat(F.lit("n"), (F.col("receiver_no") % 40).cast("string"))
    sender_name = F.concat(F.lit("n"), (F.col("sender_no") % 40).cast("string"))
    base = dict(uuid=None, git_branch=None, cwd=None, prompt_id=None, tool_name=None, tool_use_id=None,
                is_error=None, request_id=None, peer=None, msg_id=None)

    def rows(df, **cols):
        out = {**{n: F.lit(None).cast("boolean" if n == "is_error" else "string") for n in base}, **cols}
        return df.select(*[c.alias(n) for n, c in out.items()])

    call_id = F.concat(F.lit("t"), "msg")
    body = F.to_json(F.struct(name.alias("to"), F.concat(F.lit("about "), "msg").alias("summary"),
                              F.concat(F.lit("text "), "msg").alias("message")))
    turn = F.concat(F.lit("Q"), "msg")
    calls = rows(p, session_id=F.col("sender"), line_no=order, pos=F.lit(0), ts=F.col("sent_at"), lane=F.lit("tool"),
                 type=F.lit("assistant"), tool_name=F.lit("SendMessage"), tool_use_id=call_id, prompt_id=turn,
                 is_error=F.lit(False), text=F.concat(F.lit("SendMessage "), body))
    said = F.when(F.col("refused"), F.lit('{"success":false,"message":"ENOENT"}')).otherwise(
        F.concat(F.lit('{"success":true,"message":"ok","msg_id":"'), "msg", F.lit('"}')))
    acks = rows(p.filter("acked"), session_id=F.col("sender"), line_no=order + 1, pos=F.lit(0), prompt_id=turn,
                ts=F.col("sent_at") + F.expr("interval 1 second"), lane=F.lit("tool"), type=F.lit("user"),
                tool_use_id=call_id, is_error=F.lit(False), msg_id=F.when(~F.col("refused"), F.col("msg")), text=said)
    copies = rows(p.filter("copied"), session_id=F.col("receiver"), line_no=order + 2, pos=F.lit(0),
                  ts=F.col("sent_at") + F.expr("interval 2 seconds"), lane=F.lit("relay"), prompt_id=F.concat(F.lit("R"), "msg"),
                  type=F.when(F.col("mid_turn"), "attachment").otherwise("user"), peer=sender_name, msg_id=F.col("msg"),
                  is_error=F.lit(False), text=F.concat(F.lit("text "), "msg"))
    return calls.unionByName(acks).unionByName(copies)


def limits(spark: SparkSession, sf: str) -> DataFrame:
    ev = _load(spark, sf, "events")
    base = ev.selectExpr("event_id AS seq", "cast(date_trunc('MILLISECOND', ts) AS timestamp) AS ts", f"{sid('user_id', 'spark')} AS session_id",
                         *[f"{e} AS {n}" for n, e in limit_columns().items()])
    week = F.date_trunc("week", "ts") + F.expr("interval 7 days")
    five = F.timestamp_seconds((F.floor(F.unix_seconds("ts") / 18000) + 1) * 18000)
    return base.withColumn("resets_at", F.when(F.col("kind") == "five_hour", five).when(F.col("kind") != "spend_limit", week))


def ref_columns(d: str) -> dict[str, str]:
    """customer row -> one shell call whose answer prints the id of a spawned job."""
    return {"session_id": sid("c_custkey % 150", d), "tool_use_id": f"concat('b', {s('c_custkey')})", "seq": "c_custkey",
            "child": hex8("(c_custkey * 13) % 150", d)}


def ref_messages(spark: SparkSession, sf: str) -> DataFrame:
    rows = _mapped(_load(spark, sf, "customer"), ref_columns("spark"))
    start = F.unix_seconds(F.lit("2024-01-01").cast("timestamp"))
    rows = rows.withColumns({"ts": F.timestamp_seconds(start + F.col("seq") * 60), "lane": F.lit("tool"), "line_no": F.col("seq") * 2, "pos": F.lit(0)})
    calls = rows.withColumns({"type": F.lit("assistant"), "tool_name": F.lit("Bash"), "text": F.lit('Bash {"command":"spawn"}')})
    said = rows.withColumns({"type": F.lit("user"), "tool_name": F.lit(None).cast("string"), "line_no": F.col("line_no") + 1,
                             "text": F.concat(F.lit('{"ref": "'), "child", F.lit('", "state": "up"} backgrounded · '), "child")})
    return calls.drop("child", "seq").unionByName(said.drop("child", "seq"))


def jobs(spark: SparkSession, sf: str) -> DataFrame:
    return _mapped(_load(spark, sf, "supplier"), job_columns("spark"))


def ledger(spark: SparkSession, sf: str) -> DataFrame:
    rows = _mapped(_load(spark, sf, "part"), ledger_columns("spark"))
    start = F.lit("2024-01-01").cast("timestamp")
    return rows.withColumn("ts", F.timestamp_seconds(F.unix_seconds(start) + F.col("seq") * 60))


def wells_of(sessions: DataFrame) -> DataFrame:
    return sessions.select(F.col("well").alias("dir")).distinct().withColumns({
        "real_path": F.concat(F.lit("/u/code/"), F.regexp_extract("dir", "-code-(.*)$", 1)),
        "is_worktree": F.lit(False), "has_memory": F.lit(False)})


def corpus(spark: SparkSession, sf: str, *, messages: bool = True, spawns: bool = False) -> Corpus:
    entries = flat_entries(spark, sf)
    sessions = tr.sessions_of(entries)
    out = Corpus(sessions=sessions, requests=tr.requests_of(entries), wells=wells_of(sessions),
                 rates=pricing.rate_table(spark, RATES))
    if messages:
        out = out.with_tables(messages=tr.messages_of(tr.carry_prompts(entries)))
    if spawns:
        spawned, requests = spawn_tables(spark, sf)
        out = out.with_tables(spawns=spawned, spawn_requests=requests)
    return out


# --- the same mapping as DuckDB common table expressions ---------------------------

_INDEXES: dict[tuple, object] = {}


def stored_index(spark: SparkSession, sf: str, kind: str, build):
    """A text index of these tables, written once for the session and read by all its queries."""
    at = (spark.sparkContext.applicationId, sf, kind)
    if at not in _INDEXES:
        _INDEXES[at] = build(f"{shared_folder(spark)}/logloom/index-{kind}-{uuid.uuid4().hex}")
    return _INDEXES[at]


def document_index(spark: SparkSession, sf: str):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    return stored_index(spark, sf, "documents", lambda path: ti.TextIndex(spark, path, ("doc_id",), "source").write(docs, F.col("text")))


def message_index(spark: SparkSession, sf: str):
    return stored_index(spark, sf, "messages", lambda path: ti.index_messages(spark, corpus(spark, sf).messages, path))


def typed_history(spark: SparkSession, sf: str) -> DataFrame:
    """User turns as lines of a prompt history: epoch milliseconds as text, a conversation an hour."""
    ts = F.lit(1704067200000) + F.col("conv_id") * 3600000 + F.col("turn") * 60000
    return _load(spark, sf, "conversations").filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("display"), ts.cast("string").alias("ts"),
                                                                            F.lit("p").alias("project"), F.concat(F.lit("c"), "conv_id").alias("session_id"))


def history_index(spark: SparkSession, sf: str):
    return stored_index(spark, sf, "history", lambda path: ti.index_history(spark, typed_history(spark, sf), path, ("conv_id", "turn"), "conv_id"))


def _select(columns: dict[str, str], source: str, extra: str = "") -> str:
    return "SELECT " + extra + ", ".join(f"{e} AS {n}" for n, e in columns.items()) + f" FROM {source}"


def oracle_ctes() -> dict[str, str]:
    rates = ", ".join("('%s', DATE '%s', %s)" % (r[0], r[1], ", ".join(f"{v}::double" for v in r[2:])) for r in RATES)
    week = "date_trunc('week', ts) + INTERVAL 7 DAY"
    five = "make_timestamp(cast((floor(epoch(ts) / 18000) + 1) * 18000 * 1000000 AS bigint))"
    tokens = ["input_tokens", "cache_write_tokens", "cache_write_5m_tokens", "cache_write_1h_tokens",
              "cache_read_tokens", "output_tokens", "thinking_tokens"]
    fold = ", ".join(f"max({t}) AS {t}" for t in tokens)
    return {
        "ev": _select(event_base("duckdb"), "events"),
        "rec": _select(record_columns("duckdb"), "ev", "ev.*, "),
        "msg": """SELECT *, last_value(own_prompt IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY line_no
            ROWS UNBOUNDED PRECEDING) AS prompt_id FROM rec""",
        "messages_t": "SELECT * FROM msg WHERE lane IS NOT NULL",
        "requests_t": f"""SELECT session_id, request_id AS message_id, arg_min(ts, line_no) AS ts,
            arg_min(model, line_no) AS model, arg_max(stop_reason, line_no) FILTER (stop_reason IS NOT NULL) AS stop_reason,
            {fold} FROM rec WHERE request_id IS NOT NULL GROUP BY 1, 2""",
        "sessions_t": """SELECT session_id, min(well) AS well, count(*) AS lines, arg_min(ts, line_no) AS first_ts,
            arg_max(ts, line_no) AS last_ts,
            arg_max(ts, line_no) FILTER (lane IN ('prompt','text','thinking','tool','relay')) AS last_activity_ts,
            arg_min(root_id, line_no) FILTER (root_id IS NOT NULL) AS job_session_id,
            arg_min(bridge_id, line_no) FILTER (bridge_id IS NOT NULL) AS bridge_key FROM rec GROUP BY 1""",
        "rates_t": f"SELECT * FROM (VALUES {rates}) AS t(prefix, from_day, r_in, r_w5, r_w1, r_rd, r_out)",
        "sline": _select(spawn_columns("duckdb"), "lineitem JOIN orders ON l_orderkey = o_orderkey"),
        "sreq_t": f"""SELECT agent_id, session_id, message_id, arg_min(ts, line_no) AS ts,
            arg_min(model, line_no) FILTER (model IS NOT NULL) AS model,
            arg_max(stop_reason, line_no) FILTER (stop_reason IS NOT NULL) AS stop_reason,
            arg_max(CASE WHEN stop_reason IS NULL THEN 1 ELSE 0 END, line_no) AS is_open,
            {fold} FROM sline GROUP BY 1, 2, 3""",
        "spawns_t": """SELECT a.*, r.requests, r.output_tokens, r.open_requests FROM (
              SELECT agent_id, min(well) AS well_dir, min(session_id) AS session_id, min(workflow_run_id) AS workflow_run_id,
                min(agent_type) AS agent_type, min(requested_model) AS requested_model,
                arg_min(ts, line_no) AS first_ts, arg_max(ts, line_no) AS last_ts, sum(tool_uses) AS tool_uses,
                arg_min(coalesce(model, '-'), line_no) AS model0,
                arg_min(input_tokens + cache_write_tokens + cache_read_tokens, line_no) AS boot_tokens,
                arg_min(cache_read_tokens, line_no) AS boot_cached,
                nullif(arg_max(coalesce(stop_reason, '-'), line_no), '-') AS last_stop_reason,
                nullif(arg_min(coalesce(model, '-'), line_no), '-') AS model
              FROM sline GROUP BY 1) a JOIN (
              SELECT agent_id, count(*) AS requests, sum(output_tokens) AS output_tokens, sum(is_open) AS open_requests
              FROM sreq_t GROUP BY 1) r USING (agent_id)""",
        "pair": _select(message_pair_columns("duckdb"), "orders"),
        "jobs_t": _select(job_columns("duckdb"), "supplier"),
        "ref_t": _select(ref_columns("duckdb"), "customer", "TIMESTAMP '2024-01-01' + to_seconds(c_custkey * 60) AS ts, "),
        "ledger_t": _select(ledger_columns("duckdb"), "part",
                            "TIMESTAMP '2024-01-01' + to_seconds(p_partkey * 60) AS ts, "),
        "limits_t": f"""SELECT *, CASE WHEN kind = 'five_hour' THEN {five} WHEN kind <> 'spend_limit' THEN {week} END AS resets_at
            FROM (SELECT event_id AS seq, date_trunc('milliseconds', ts) AS ts, {sid('user_id', 'duckdb')} AS session_id, {', '.join(f'{e} AS {n}' for n, e in limit_columns().items())} FROM events)""",
    }


_NEEDS = {"rec": ["ev"], "msg": ["rec"], "messages_t": ["msg"], "requests_t": ["rec"], "sessions_t": ["rec"],
          "sreq_t": ["sline"], "spawns_t": ["sline", "sreq_t"]}


def with_ctes(names: list[str], query: str) -> str:
    """query with the named mapping expressions (and what they need) in front."""
    ctes, ordered = oracle_ctes(), []

    def add(n: str) -> None:
        for dep in _NEEDS.get(n, []):
            add(dep)
        if n not in ordered:
            ordered.append(n)

    for n in names:
        add(n)
    body = query.strip()
    heads = ", ".join(f"{n} AS ({ctes[n]})" for n in ordered)
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {heads}, {body[15:]}"
    if body.upper().startswith("WITH "):
        return f"WITH {heads}, {body[5:]}"
    return f"WITH {heads} {body}"
