"""Word lists, patterns and tables that results depend on.

Patterns are Java regular expressions (Spark's dialect).
"""

# --- lanes ------------------------------------------------------------------
LANES = ["prompt", "text", "thinking", "tool", "event", "meta", "relay"]
WORK_LANES = ["prompt", "text", "thinking", "tool", "relay"]
META_PREFIX = (
    r"^\s*(<(local-command|command-name|command-message|system-remind|task-notification)"
    r"|Base directory for this skill:|\[Request interrupted by user)"
)
COMMAND_NAME = r"<command-name>/?([\w:-]+)</command-name>"
ACK_MSG_ID = r'"msg_id":\s*"([^"]+)"'
ACK_SUCCESS = r'"success":\s*(true|false)'
CALL_TEXT_CAP = 2000
RESULT_HEAD = 1200
RESULT_TAIL = 800
RESULT_GAP = "\n… … …\n"

# --- tool classes -----------------------------------------------------------
CLASS_RANK = {
    "poll": 9, "write": 8, "spawn": 7, "relay": 6, "shell": 5,
    "read": 4, "wait": 3, "other": 2, "idle": 1, "text": 0,
}
READ_TOOLS = ["Read", "Grep", "Glob", "LSP", "WebFetch", "WebSearch",
              "ReadMcpResourceTool", "ListMcpResourcesTool"]
WRITE_TOOLS = ["Edit", "Write", "MultiEdit", "NotebookEdit"]
SPAWN_TOOLS = ["Agent", "Task", "Workflow"]
TASK_PATH = r"/tasks/([A-Za-z0-9_-]+)\*?\.output\b"
TASK_ID = r'"task_id":"([^"]+)"'
BLOCKING = r'"block":true'
LOOP_WAIT = r"\b(?:until|while)\b[^\n]*?\bdo\b[\s\S]*?\bsleep\b"
BARE_SLEEP = r"^\s*sleep\s+\d"
IDLE_NOOP = r"^\s*(?::|true)?\s*;?\s*$"
IDLE_ECHO = (
    r"^\s*echo(?:\s+-n)?(?:\s+(?:[\w.,:!?-]+|\"[^\"'$`\\|;&<>()]*\"|'[^'|;&<>()]*'))?\s*;?\s*$"
)
RUN_MIN = 3
TOOL_FAMILIES = {
    "read": ["Read", "Grep", "Glob", "LS", "WebFetch", "WebSearch", "ToolSearch", "LSP",
             "TaskList", "TaskGet", "ListAgents"],
    "write": ["Edit", "Write", "MultiEdit", "NotebookEdit"],
    "run": ["Bash"],
    "agent": ["Agent", "Task", "Workflow", "Skill", "SendMessage"],
}

# --- annotations ------------------------------------------------------------
FILE_TOOLS = ["Edit", "Write", "Read", "MultiEdit", "NotebookEdit"]
TEST_COMMANDS = (
    r"\b(bun test|cargo test|cargo nextest|pytest|npm test|pnpm test|yarn test|go test"
    r"|vitest|jest|swift test|mix test)\b"
)
TEST_FAIL = (
    r"(?i)\b(\d+) fail(?:ed|ures?)?\b|\bFAILED\b|\bfailures:|\btest result: FAILED|\bError: Exit code"
)
TEST_PASS = r"(?i)\b(\d+) pass(?:ed)?\b|\btest result: ok\b|\bok\s+\d+ passed|\ball tests passed"
COMMIT_LINE = r"\[[\w./-]+ (?:\(root-commit\) )?([0-9a-f]{7,40})\]"

# --- sub-agents -------------------------------------------------------------
TERMINAL_STOPS = ["end_turn", "stop_sequence", "max_tokens", "handback"]
HANDBACK_TOOL = "SubagentHandback"
LEDGER_VERSION = 1
LEDGER_KINDS = ["spawn", "fork"]
CHILD_ID = r'"ref"\s*:\s*"([0-9a-f]{8})|backgrounded · ([0-9a-f]{8})'

# --- models -----------------------------------------------------------------
MODEL_FAMILIES = ["opus", "fable", "sonnet", "haiku", "other"]
VENDOR_PREFIX = r"^claude-"

# --- rate-limit windows -----------------------------------------------------
KIND_ALIAS = {"seven_day_overage_included": "seven_day_fable"}
SURFACE_KINDS = ["seven_day_oauth_apps", "seven_day_cowork", "seven_day_omelette"]
RESET_DROP = 5.0
MIN_POINTS = 5.0

# --- roster -----------------------------------------------------------------
STATE_RANK = {"working": 0, "blocked": 1, "failed": 2, "stopped": 3, "done": 4}
LIVE_STATES = ["working", "blocked"]

# --- denials ----------------------------------------------------------------
DENIAL_NEEDLE = "toolDenialKind"
BORING_TOKENS = ["users", "home", "code", "claude", "worktrees", "projects", "2>&1",
                 "tail", "head", "grep", "echo", "false", "true", "null", "usr/bin"]
TARGET_FIELDS = ["command", "file_path", "path", "url", "query"]
SHAPE_STOPPED = "stopped, handed to the human"
SHAPE_NONE = "no further tool call"
SHAPE_VERBATIM = "RETRIED VERBATIM"
SHAPE_SWITCHED = "switched to another tool"
SHAPE_SPLIT = "split the compound, ran the allowed part"
SHAPE_RESHAPED = "same program, reshaped"
SHAPE_ROUTED = "different program, same target (READ THIS)"
SHAPE_DROPPED = "dropped it, moved on"

# --- release notes ----------------------------------------------------------
NOTE_KINDS = {
    "added": "added", "add": "added", "new": "added",
    "fixed": "fixed", "fix": "fixed", "bug": "fixed",
    "improved": "improved", "reduced": "improved", "updated": "improved",
    "changed": "changed", "renamed": "changed", "moved": "changed", "reverted": "changed",
    "removed": "removed", "deprecated": "removed",
}
PREFIX_SURFACES = ["windows", "vscode", "sdk", "ide", "bedrock", "vertex", "foundry",
                   "self-hosted runner", "jetbrains"]
NOTE_TOPICS = {
    "daemon": r"(?i)\bdaemon\b|background (session|agent|job)s?|--bg\b|/bg\b|`claude agents`|respawn|worker restart",
    "spawn": r"(?i)subagents?|\bAgent tool\b|teammates?|workflows?",
    "messaging": r"(?i)SendMessage|other sessions?|another (agent|session)|queued|--channels|\bchannels?\b",
    "worktree": r"(?i)worktrees?",
    "transcript": r"(?i)transcripts?|\bresum(e|ed|ing)\b|--continue|compact(ed|ing|ion)?\b",
    "model": r"(?i)\b(Fable|Opus|Sonnet|Haiku)\b|model id|`/model`|\[1m\]|fallback model",
    "permissions": r"(?i)auto mode|classifier|permission|workspace trust|sandbox|--dangerously",
    "config": r"(?i)\bhooks?\b|settings\.json|CLAUDE\.md|auto-memory|MEMORY\.md|\bskills?\b",
    "macos": r"(?i)macOS|keychain|\bTCC\b|Screen Recording",
    "usage": r"(?i)usage limit|rate limit|prompt cach|\bcache\b|`/usage`",
    "update": r"(?i)auto-?updat|`claude (update|install)`|release channel",
}

# --- envelopes --------------------------------------------------------------
RELAY = r"<cross-session-message\b([^>]*)>([\s\S]*?)(?:</cross-session-message>|$)"
HANDED_BACK = r"<agent-message\b([^>]*)>([\s\S]*?)(?:</agent-message>|$)"
HAND_BACK_PREAMBLE = r"^\[Subagent hand-back\][\s\S]*?The report follows:\n"
SKILL_FOLDER = r"^Base directory for this skill: (\S+)"
IMAGE_MARK = r"^\[Image: (?:source: )?(.+?)\]"
MODEL_LINE = r"\*\*Model:\*\*\s*(\S+)"
TOKENS_LINE = r"\*\*Tokens:\*\*\s*(.+)"

# --- redaction --------------------------------------------------------------
SECRET_KEYS = r"(?i)auth$|^bridgeOwner|^providerEnv$|^output$|^token$|secret|password"
PROSE_KEYS = ["intent", "detail", "needs", "label", "question", "header", "description"]
ARGUMENT_KEYS = ["args", "respawnFlags"]
ARGUMENT_CHARS, ARGUMENT_HEAD, TITLE_CHARS = 200, 48, 80
LINK_KEY, LINK_STANDIN = "href", "https://example.invalid/link"
FRAME_KIND = "frame"
FRAME_STANDINS = {"id": "frame.html", "title": "frame"}
HOME_STANDIN = "/Users/u"
HOME_SLUG_STANDIN = "-Users-u"

# --- documents --------------------------------------------------------------
WORKTREE_MARK = "--claude-worktrees-"
WORKTREE_PATH = "/.claude/worktrees/"
SNIPPET_TOKENS = 24
BM25_K1 = 1.2
BM25_B = 0.75
BM25_IDF_FLOOR = 1e-6

# characters of a denial that a listing prints
DENIAL_CUTS = {"reason": 240, "next_text": 600}
