"""Session and sub-agent logs: scan, parse, number, fold into tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from logloom.functions import fixed_values as fv
from logloom.functions.envelope import ack_msg_id, bridge_key
from logloom.functions.text import extract
from logloom.operators.ordered import scan
from logloom.schemas import BLOCKS, LIST_KINDS, RECORD, RESULT_KINDS, REQUEST_TOKENS, TEXT_BLOCKS, whole
from logloom.sources.side_files import instant

SESSION_PATH = r"/([^/]+)/([^/]+)\.jsonl$"
SPAWN_PATH = r"/([^/]+)/([^/]+)/subagents/(?:workflows/(wf_[^/]+)/)?agent-([^/]+)\.jsonl$"


def read_lines(spark: SparkSession, root: str | list[str]) -> DataFrame:
    """Raw lines with the position that orders them inside their file.

    The position is taken at the scan, before any shuffle: byte start of the
    split, then row number inside the task.
    """
    return (spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").text(root)
            .select("value",
                    F.col("_metadata.file_path").alias("file_path"),
                    F.col("_metadata.file_size").alias("size"),
                    F.unix_millis(F.col("_metadata.file_modification_time")).alias("mtime_ms"),
                    F.col("_metadata.file_block_start").alias("block_start"),
                    F.monotonically_increasing_id().alias("row_seq")))


def session_lines(lines: DataFrame) -> DataFrame:
    """Lines of main-thread logs: <root>/<well>/<session>.jsonl."""
    path = F.col("file_path")
    return (lines.filter(path.rlike(SESSION_PATH) & ~F.contains(path, F.lit("/subagents/")))
            .withColumns({"well": F.regexp_extract(path, SESSION_PATH, 1),
                          "session_id": F.regexp_extract(path, SESSION_PATH, 2)}))


def spawn_lines(lines: DataFrame) -> DataFrame:
    """Lines of sub-agent logs; the path names well, session, workflow run and agent."""
    path = F.col("file_path")
    run = F.regexp_extract(path, SPAWN_PATH, 3)
    return (lines.filter(path.rlike(SPAWN_PATH))
            .withColumns({"well": F.regexp_extract(path, SPAWN_PATH, 1),
                          "session_id": F.regexp_extract(path, SPAWN_PATH, 2),
                          "workflow_run_id": F.when(run != "", run),
                          "agent_id": F.regexp_extract(path, SPAWN_PATH, 4)}))


# --- one line -> one record ------------------------------------------------------

def parse_lines(lines: DataFrame) -> DataFrame:
    """Parsed records: blank and malformed lines dropped, one row per remaining line.

    `blocks` holds what may become entries, whatever shape the record had: content
    blocks as they are, or one text block for a plain string. A timestamp that is no
    instant gives a record without one: it keeps its place in the file.
    """
    ids = [c for c in lines.columns if c != "value"]
    parsed = (lines.filter(F.trim("value") != "")
              .select(*ids, "value", F.from_json("value", RECORD, {"columnNameOfCorruptRecord": "_corrupt"}).alias("r"))
              .filter(F.col("r._corrupt").isNull() | F.col("r.type").isNotNull()))
    c = lambda n: F.col(f"r.{n}")
    opt = lambda n: F.coalesce(c(n), F.lit(""))
    subtype = F.coalesce(c("subtype"), F.lit("system"))
    said = F.concat(subtype, F.lit(": "), opt("content"))
    title = F.coalesce(c("customTitle"), c("aiTitle"), c("title"))
    mode = F.to_json(F.struct(*[c(f"attachment.{n}").alias(n) for n in ("bashFirst", "bashFirstSteer", "steerOnly", "bypass")]),
                     {"ignoreNullFields": "false"})
    content, prompt = c("message.content"), c("attachment.prompt")
    is_array, prompt_is_array = (F.col(f"kinds.{n}").isNotNull() for n in ("message.content", "attachment.prompt"))
    event = (F.when(c("type") == "system", said)
             .when(c("type") == "pr-link", F.trim(F.concat(F.lit("pr-link: "), opt("prRepository"), F.lit("#"),
                                                           opt("prNumber"), F.lit(" "), opt("prUrl"))))
             .when(c("type").isin("custom-title", "ai-title"), F.concat(F.lit("title: "), F.nullif(title, F.lit(""))))
             .when(c("type") == "summary", F.concat(F.lit("summary: "), F.nullif(c("summary"), F.lit(""))))
             .when((c("type") == "attachment") & (c("attachment.type") == "auto_mode"), F.concat(F.lit("auto_mode: "), mode)))
    # text that starts like a list may be a string: the type in the line decides
    starts = lambda x: F.coalesce(x.rlike(r"^\s*\["), F.lit(False))
    parsed = parsed.withColumn("kinds", F.from_json(F.when(starts(content) | starts(prompt), F.col("value")), LIST_KINDS))
    plain_text = (F.when((c("type") == "user") & ~is_array, content)
                  .when((c("type") == "attachment") & (c("attachment.type") == "queued_command"), _joined_text(prompt, prompt_is_array)))
    parsed = parsed.withColumns({
        "plain_text": plain_text, "event_text": event,
        "listed": F.from_json(F.when(is_array & c("type").isin("user", "assistant"), content), BLOCKS),
        "list_results": F.transform(F.from_json(F.when(is_array & F.contains(content, F.lit("tool_result")), content), RESULT_KINDS), lambda b: b["content"].isNotNull())})
    typed_text = lambda kind, col: F.array(F.struct(
        F.lit(kind).alias("type"), F.col(col).alias("text"),
        *[F.lit(None).cast("string").alias(n) for n in ("thinking", "id", "name", "input", "tool_use_id", "content")],
        F.lit(None).cast("boolean").alias("is_error"))).cast(BLOCKS)
    blocks = (F.when(F.col("plain_text").isNotNull(), typed_text("text", "plain_text"))
              .when(F.col("event_text").isNotNull(), typed_text("event", "event_text"))
              .otherwise(F.col("listed")))
    u, m = "r.message.usage", "r.message"
    token = lambda path: F.coalesce(F.col(f"{u}.{path}"), F.lit(0)).cast("bigint")
    limit = F.col("r.apiErrorParams.rate_limit_info")
    queued = F.col("r.type") == "attachment"
    origin = F.when(queued, F.col("r.attachment.origin")).otherwise(F.col("r.origin"))
    return parsed.select(
        *ids,
        F.coalesce("r.type", F.lit("unknown")).alias("type"),
        F.col("r.uuid").alias("uuid"),
        instant(F.col("r.timestamp")).alias("ts"),
        F.col("r.cwd").alias("cwd"), F.col("r.gitBranch").alias("git_branch"),
        F.nullif(F.col("r.promptId"), F.lit("")).alias("prompt_id"),
        F.when(~F.col("r.session_id").eqNullSafe(F.col("r.sessionId")), F.col("r.session_id")).alias("root_id"),
        F.when(F.col("r.type") == "bridge-session", bridge_key(F.col("r.bridgeSessionId"))).alias("bridge_id"),
        F.when(queued, F.col("r.attachment.isMeta")).otherwise(F.col("r.isMeta")).alias("is_meta"),
        origin.alias("origin"),
        F.col(f"{m}.id").alias("reply_id"), F.col(f"{m}.model").alias("model"), F.col("r.effort").alias("effort"),
        F.col(f"{m}.stop_reason").alias("stop_reason"), F.col(u).isNotNull().alias("has_usage"),
        token("input_tokens").alias("input_tokens"),
        token("cache_creation_input_tokens").alias("cache_write_tokens"),
        token("cache_creation.ephemeral_5m_input_tokens").alias("cache_write_5m_tokens"),
        token("cache_creation.ephemeral_1h_input_tokens").alias("cache_write_1h_tokens"),
        token("cache_read_input_tokens").alias("cache_read_tokens"),
        token("output_tokens").alias("output_tokens"),
        token("output_tokens_details.thinking_tokens").alias("thinking_tokens"),
        F.when((F.col("r.type") == "assistant") & (F.col("r.apiError") == "usage_limit_reached"),
               limit["rateLimitType"]).alias("limit_kind"),
        limit["resetsAt"].try_cast("timestamp").alias("limit_resets_at"),
        F.col("r.toolDenialKind").alias("denial_kind"), F.col("r.toolUseResult").alias("tool_use_result"),
        blocks.alias("blocks"), "list_results")


def _joined_text(content: Column, is_array: Column) -> Column:
    """A string as it is, or the text blocks of an array joined by newlines."""
    blocks = F.from_json(F.when(is_array, content), TEXT_BLOCKS)
    texts = F.filter(blocks, lambda b: (b["type"] == "text") & (F.coalesce(b["text"], F.lit("")) != ""))
    return F.coalesce(F.array_join(F.transform(texts, lambda b: b["text"]), "\n"), content, F.lit(""))


def with_requests(records: DataFrame) -> DataFrame:
    """Mark the records that carry an API request (a synthetic model is no request)."""
    synthetic = F.coalesce(F.startswith("model", F.lit("<")), F.lit(False)) & (F.col("type") == "assistant")
    carries = (F.col("type") == "assistant") & F.col("reply_id").isNotNull() & F.col("has_usage") & ~synthetic
    return records.withColumns({"synthetic": synthetic, "request_id": F.when(carries, F.col("reply_id"))})


# --- one record -> entries -------------------------------------------------------

def entries_of(records: DataFrame) -> DataFrame:
    """One row per content block (one per record at least): lane, text and tool fields.

    `text` is the log format's preview: tool inputs and most system events by their head, results by
    head and tail. `whole_text` is never cut, and what search, traces and payload readers go by.

    Blocks that say nothing keep a NULL lane, so record counts survive; `head`
    marks the first row of each record.
    """
    rows = with_requests(records).select("*", F.posexplode_outer("blocks").alias("pos", "b")).drop("blocks")
    b = lambda n: F.col(f"b.{n}")
    filled = lambda x: F.coalesce(x, F.lit("")) != ""
    user_side = F.col("type").isin("user", "attachment")
    said = user_side & (b("type") == "text") & filled(F.trim(F.translate(b("text"), "\n\t\r", "   ")))
    result = (F.col("type") == "user") & (b("type") == "tool_result")
    replied = F.col("type") == "assistant"
    call = replied & (b("type") == "tool_use")
    peer = F.coalesce(F.col("origin.kind") == "peer", F.lit(False))
    injected = F.coalesce(F.col("is_meta"), F.lit(False)) | b("text").rlike(fv.META_PREFIX)
    lane = (F.when(said, F.when(peer, "relay").when(injected, "meta").otherwise("prompt"))
            .when(result | call, "tool")
            .when(replied & (b("type") == "text") & filled(b("text")), "text")
            .when(replied & (b("type") == "thinking") & filled(b("thinking")), "thinking")
            .when(b("type") == "event", "event"))
    rows = rows.withColumns({"lane": lane, "result_text": F.when(result, _joined_text(b("content"), F.coalesce(F.get("list_results", F.col("pos")), F.lit(False))))})
    skill = F.when(call & (b("name") == "Skill"), F.get_json_object(b("input"), "$.skill"))
    called = lambda shown: F.concat(F.coalesce(b("name"), F.lit("?")), F.lit(" "), shown)
    payload = F.coalesce(b("input"), F.lit(""))
    whole = (F.when(call, called(payload)).when(result, F.col("result_text"))
             .when(F.col("lane") == "thinking", b("thinking")).otherwise(b("text")))
    noted = (F.col("lane") == "event") & (F.col("type") == "system") & ~F.startswith(b("text"), F.lit("away_summary: "))
    text = (F.when(call, called(F.substring(payload, 1, fv.CALL_TEXT_CAP)))
            .when(result, _head_tail(F.col("result_text")))
            .when(noted, F.substring(b("text"), 1, fv.CALL_TEXT_CAP)).otherwise(whole))
    command = F.when(F.col("lane") == "meta", extract(b("text"), fv.COMMAND_NAME))
    tool = (F.when(skill.isNotNull(), F.concat(F.lit("Skill:"), skill)).when(call, b("name"))
            .otherwise(F.concat(F.lit("command:"), command)))
    relayed = F.col("lane") == "relay"
    name = F.when(relayed & ~F.coalesce(F.col("origin.handback"), F.lit(False)), F.nullif(F.col("origin.name"), F.lit("")))
    msg_id = F.when(relayed, F.nullif(F.col("origin.msg_id"), F.lit(""))).when(result, ack_msg_id(F.col("result_text")))
    return rows.withColumns({
        "head": F.coalesce("pos", F.lit(0)) == 0, "pos": F.coalesce("pos", F.lit(0)),
        "text": text, "whole_text": whole, "tool_name": tool,
        "tool_use_id": F.when(call, b("id")).when(result, b("tool_use_id")),
        "is_error": result & F.coalesce(b("is_error"), F.lit(False)),
        "peer": name, "msg_id": msg_id}).drop("b", "result_text", "list_results", "origin")


def _head_tail(text: Column) -> Column:
    both = F.concat(F.substring(text, 1, fv.RESULT_HEAD), F.lit(fv.RESULT_GAP), F.right(text, F.lit(fv.RESULT_TAIL)))
    return F.when(F.length(text) > fv.CALL_TEXT_CAP, both).otherwise(text)


def number_records(records: DataFrame, key: str = "file_path") -> DataFrame:
    """Dense line numbers in file order, and the prompt id carried forward (one scan)."""
    return scan(records, [key], ["block_start", "row_seq"], F.col("block_start"),
                running={"line_no": F.lit(1)}, carry={"turn_id": F.col("prompt_id")})


def carry_prompts(records: DataFrame) -> DataFrame:
    """The same carry for records that already know their line number."""
    return scan(records, ["session_id"], ["line_no"], carry={"turn_id": F.col("prompt_id")})


# --- records -> tables -------------------------------------------------------------

MESSAGE = ["session_id", "line_no", "pos", "uuid", "ts", "lane", "type", "git_branch", "cwd", "tool_name",
           "prompt_id", "tool_use_id", "is_error", "request_id", "peer", "msg_id", "text", "whole_text"]


def messages_of(entries: DataFrame) -> DataFrame:
    """One row per entry; every entry of a record carries the running prompt id."""
    return entries.filter(F.col("lane").isNotNull()).withColumns({"prompt_id": F.col("turn_id"), "whole_text": whole(entries)}).select(*MESSAGE)


def _folded(snapshots: DataFrame, keys: list[str], *more: Column) -> DataFrame:
    last_known = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("line_no")))
    first_known = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("line_no")))
    return snapshots.groupBy(*keys).agg(
        F.min_by("ts", "line_no").alias("ts"), first_known("model").alias("model"),
        first_known("effort").alias("effort"), last_known("stop_reason").alias("stop_reason"),
        *[F.max(t).alias(t) for t in REQUEST_TOKENS], *more)


def fold_requests(snapshots: DataFrame, keys: list[str]) -> DataFrame:
    """Snapshots of one request folded: max tokens, last known stop, first known model, first instant."""
    return _folded(snapshots, keys)


def requests_of(entries: DataFrame) -> DataFrame:
    snaps = entries.filter(F.col("request_id").isNotNull() & F.col("head")).select(
        "session_id", "line_no", "ts", F.col("request_id").alias("message_id"), "model", "effort", "stop_reason",
        *REQUEST_TOKENS)
    return fold_requests(snaps, ["session_id", "message_id"])


def sessions_of(entries: DataFrame, attributes: list[str] = ("well",)) -> DataFrame:
    """Span, activity and first-seen ids of each session (all by file order)."""
    at = lambda cond: F.when(cond, F.col("line_no"))
    timed = F.col("ts").isNotNull()
    return entries.groupBy("session_id").agg(
        *[F.first(a, ignorenulls=True).alias(a) for a in attributes],
        F.sum(F.col("head").cast("bigint")).alias("lines"),
        F.min_by("ts", at(timed)).alias("first_ts"), F.max_by("ts", at(timed)).alias("last_ts"),
        F.max_by("ts", at(timed & F.col("lane").isin(fv.WORK_LANES))).alias("last_activity_ts"),
        F.min_by("root_id", at(F.col("root_id").isNotNull())).alias("job_session_id"),
        F.min_by("bridge_id", at(F.col("bridge_id").isNotNull())).alias("bridge_key"))


def refusals_of(entries: DataFrame) -> DataFrame:
    """Usage-limit refusals: the one instant a window is known to read 100."""
    return (entries.filter(F.col("limit_kind").isNotNull() & F.col("ts").isNotNull() & F.col("head"))
            .withColumn("source", F.lit("transcript")).withColumnRenamed("limit_kind", "kind")
            .groupBy("source", "session_id", "ts", "kind")
            .agg(F.lit(100.0).alias("pct"), F.min_by("limit_resets_at", "line_no").alias("resets_at")))


# --- sub-agents --------------------------------------------------------------------

def spawn_fields(records: DataFrame) -> DataFrame:
    """What the sub-agent ledger reads off each numbered record."""
    last = F.try_element_at("blocks", F.lit(-1))
    results = F.transform(F.filter("blocks", lambda b: b["type"] == "tool_result"),
                          lambda b: F.struct(b["tool_use_id"].alias("tool_use_id"),
                                             F.coalesce(b["is_error"], F.lit(False)).alias("is_error")))
    return with_requests(records).withColumns({
        "answered": F.col("type") == "assistant",
        "tool_uses": F.coalesce(F.size(F.filter("blocks", lambda b: b["type"] == "tool_use")), F.lit(0)),
        "closing_tool": F.when(last["type"] == "tool_use", last["name"]),
        "closing_id": F.when(last["type"] == "tool_use", last["id"]),
        "results": F.when(F.col("type") == "user", results),
        "refused": F.coalesce(F.get_json_object("tool_use_result", "$.success") == "false", F.lit(False)),
    }).drop("blocks", "list_results")


def spawn_requests_of(fields: DataFrame) -> DataFrame:
    """Folded requests of sub-agents; a record without usage still counts, at zero."""
    snaps = fields.filter(F.col("answered") & ~F.col("synthetic")).withColumns({
        "message_id": F.coalesce("reply_id", F.concat(F.lit("line-"), F.col("line_no").cast("string"))),
        "effort": F.lit(None).cast("string")})
    keys = ["agent_id", "session_id", "message_id"]
    return _folded(snaps, keys, F.max_by(F.struct("stop_reason"), "line_no")["stop_reason"].isNull().alias("open")).drop("effort")


def spawns_of(fields: DataFrame, meta: DataFrame | None = None) -> DataFrame:
    """One row per sub-agent: boot envelope, counters, ending."""
    live = F.col("answered") & ~F.col("synthetic")
    at = lambda cond: F.when(cond, F.col("line_no"))
    timed = F.col("ts").isNotNull()
    sent = F.col("input_tokens") + F.col("cache_write_tokens") + F.col("cache_read_tokens")
    boot = F.struct("model", F.when(F.col("has_usage"), sent).alias("boot_tokens"),
                    F.when(F.col("has_usage"), F.col("cache_read_tokens")).alias("boot_cached"))
    end = F.struct("stop_reason", "closing_tool", "closing_id", "synthetic", "line_no")
    by_agent = fields.groupBy("agent_id").agg(
        F.first("well", ignorenulls=True).alias("well_dir"), F.first("session_id").alias("session_id"),
        F.first("workflow_run_id", ignorenulls=True).alias("workflow_run_id"),
        F.min_by("ts", at(timed)).alias("first_ts"), F.max_by("ts", at(timed)).alias("last_ts"),
        F.coalesce(F.sum(F.when(live, F.col("tool_uses"))), F.lit(0)).alias("tool_uses"),
        F.min_by(boot, at(live)).alias("boot"), F.max_by(end, at(F.col("answered"))).alias("end"))
    totals = spawn_requests_of(fields).groupBy("agent_id").agg(
        F.count("*").alias("requests"), F.sum("output_tokens").alias("output_tokens"),
        F.sum(F.col("open").cast("int")).alias("open_requests"))
    # a delivered hand-back: its result lands after the last assistant record
    closing = (by_agent.filter((F.col("end.closing_tool") == fv.HANDBACK_TOOL) & ~F.col("end.synthetic"))
               .select("agent_id", F.col("end.closing_id").alias("tool_use_id"), F.col("end.line_no").alias("closed_at")))
    answers = (fields.filter((F.size("results") > 0) & ~F.col("refused"))
               .select("agent_id", F.col("line_no").alias("answered_at"), F.explode("results").alias("x"))
               .filter(~F.col("x.is_error"))
               .select("agent_id", "answered_at", F.col("x.tool_use_id").alias("tool_use_id")))
    handed = (answers.join(closing, ["agent_id", "tool_use_id"]).filter(F.col("answered_at") > F.col("closed_at"))
              .select("agent_id").distinct().withColumn("handed", F.lit(True)))
    out = (by_agent.join(totals, "agent_id", "left").join(handed, "agent_id", "left").select(
        "agent_id", "well_dir", "session_id", "workflow_run_id", "boot.model", "boot.boot_tokens", "boot.boot_cached",
        F.coalesce("requests", F.lit(0)).alias("requests"), F.coalesce("output_tokens", F.lit(0)).alias("output_tokens"),
        "tool_uses", "first_ts", "last_ts",
        F.when(F.col("handed"), "handback").otherwise(F.col("end.stop_reason")).alias("last_stop_reason"),
        F.coalesce("open_requests", F.lit(0)).alias("open_requests")))
    return out if meta is None else out.join(meta, "agent_id", "left")
