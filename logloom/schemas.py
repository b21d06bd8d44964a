"""Explicit schemas of the inputs and of the tables the engine builds."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, functions as F

SCHEMA_VERSION = 1

_ORIGIN = "struct<kind:string,name:string,msg_id:string,handback:boolean>"
_USAGE = ("struct<input_tokens:bigint,cache_creation_input_tokens:bigint,cache_read_input_tokens:bigint,"
          "output_tokens:bigint,"
          "cache_creation:struct<ephemeral_5m_input_tokens:bigint,ephemeral_1h_input_tokens:bigint>,"
          "output_tokens_details:struct<thinking_tokens:bigint>>")

# One line of a session or sub-agent log. Values that may be a string or a
# structure stay text here and are read a second time where they are needed.
RECORD = (
    "type string, uuid string, parentUuid string, sessionId string, session_id string, timestamp string, "
    "cwd string, gitBranch string, sessionKind string, promptId string, bridgeSessionId string, effort string, "
    f"isMeta boolean, origin {_ORIGIN}, "
    f"message struct<id:string,model:string,role:string,stop_reason:string,content:string,usage:{_USAGE}>, "
    f"attachment struct<type:string,prompt:string,isMeta:boolean,origin:{_ORIGIN},bashFirst:boolean,"
    "bashFirstSteer:string,steerOnly:boolean,bypass:boolean>, "
    "subtype string, content string, prRepository string, prNumber string, prUrl string, "
    "customTitle string, aiTitle string, title string, summary string, "
    "apiError string, apiErrorParams struct<rate_limit_info:struct<rateLimitType:string,resetsAt:double>>, "
    "toolDenialKind string, toolUseResult string, _corrupt string"
)
BLOCKS = ("array<struct<type:string,text:string,thinking:string,id:string,name:string,input:string,"
          "tool_use_id:string,content:string,is_error:boolean>>")
# The same values read as lists: null where the line has a string.
LIST_KINDS = "message struct<content:array<string>>, attachment struct<prompt:array<string>>"
RESULT_KINDS = "array<struct<content:array<string>>>"
TEXT_BLOCKS = "array<struct<type:string,text:string>>"
HISTORY = "display string, project string, sessionId string, timestamp string, _corrupt string"
LIMIT_LINE = "ts string, session string, kind string, pct double, resetsAt string, _corrupt string"
LEDGER_LINE = (
    "v double, ts string, kind string, child string, host string, via string, name string, model string, "
    "effort string, cwd string, worktree string, branch string, replaced string, draft boolean, "
    "parent struct<job:string,session:string,bridge:string>, _corrupt string"
)
JOB_STATE = ("sessionId string, bridgeSessionId string, name string, cwd string, state string, "
             "createdAt string, updatedAt string, detail string, tempo string, tokens bigint, _corrupt string")
SPAWN_META = "agentType string, description string, spawnDepth int, model string, _corrupt string"
WORKFLOW_RUN = "runId string, timestamp string, taskId string, script string, _corrupt string"

REQUEST_TOKENS = ["input_tokens", "cache_write_tokens", "cache_write_5m_tokens", "cache_write_1h_tokens",
                  "cache_read_tokens", "output_tokens", "thinking_tokens"]


def whole(messages: DataFrame) -> Column:
    """The text of messages as it was said; rows stored before whole_text was have only their preview."""
    return F.coalesce("whole_text", "text") if "whole_text" in messages.columns else F.col("text")


def uncut(messages: DataFrame) -> DataFrame:
    """Messages with the whole text as `text`, for all that reads into it."""
    return messages.withColumn("text", whole(messages)).drop("whole_text")


@dataclass(frozen=True)
class Corpus:
    """The tables the reports read. A table a report does not use may be absent."""

    wells: DataFrame | None = None
    sessions: DataFrame | None = None
    messages: DataFrame | None = None
    requests: DataFrame | None = None
    spawns: DataFrame | None = None
    spawn_requests: DataFrame | None = None
    workflow_runs: DataFrame | None = None
    limits: DataFrame | None = None
    jobs: DataFrame | None = None
    spawn_ledger: DataFrame | None = None
    history: DataFrame | None = None
    repos: DataFrame | None = None
    docs: DataFrame | None = None
    rates: DataFrame | None = None
    extra: dict = field(default_factory=dict)

    def with_tables(self, **tables) -> "Corpus":
        return replace(self, **tables)
