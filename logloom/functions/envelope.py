"""Harness envelopes: what a wrapped message says once the wrapper is off."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from logloom.functions import fixed_values as fv
from logloom.functions.text import extract, plain, strip

def _blank_to_null(c: Column) -> Column:
    return F.when(c != "", c)


def _attr(name: str, s: Column) -> Column:
    return _blank_to_null(F.regexp_extract(s, rf'\b{name}="([^"]*)"', 1))


def _tag_body(name: str, s: Column) -> Column:
    """Body of a tag, up to its close or the end of a cut text."""
    found = extract(s, rf"<{name}(?:\s[^>]*)?>([\s\S]*?)(?:</{name}>|$(?![\s\S]))")
    return strip(found)


def relay_head(text: Column) -> Column:
    """struct<from_name, addr, text> of a relayed message or a sub-agent hand-back."""
    relayed, handed = text.rlike(fv.RELAY), text.rlike(fv.HANDED_BACK)
    body = strip(plain(F.regexp_extract(text, fv.RELAY, 2)))
    report = F.regexp_replace(F.regexp_replace(strip(F.regexp_extract(text, fv.HANDED_BACK, 2)), fv.HAND_BACK_PREAMBLE, ""), "(?m)^ {2}", "")
    relay_attrs, agent_attrs = F.regexp_extract(text, fv.RELAY, 1), F.regexp_extract(text, fv.HANDED_BACK, 1)
    said = F.when(relayed, body).when(handed, report)
    return F.struct(
        F.when(relayed, _attr("from-name", relay_attrs)).alias("from_name"),
        F.when(relayed, _attr("from", relay_attrs)).when(handed, _attr("from", agent_attrs)).alias("addr"),
        F.coalesce(_blank_to_null(said), plain(text)).alias("text"),
    )


def meta_head(text: Column) -> Column:
    """struct<tag, text>: ordered rules, the first that matches names the injection."""
    t = strip(plain(text))
    command = extract(t, fv.COMMAND_NAME)
    args = _blank_to_null(_tag_body("command-args", t))
    task = _tag_body("task-notification", t)
    status = _blank_to_null(_tag_body("status", task))
    stdout = _tag_body("local-command-stdout", t)
    reminder = _tag_body("system-reminder", t)
    skill = extract(t, fv.SKILL_FOLDER)
    image = extract(t, fv.IMAGE_MARK)
    model = extract(t, fv.MODEL_LINE)
    tokens = F.trim(extract(t, fv.TOKENS_LINE))
    last_segment = lambda p: F.regexp_extract(p, r"([^/]+)/*$", 1)
    rules = [
        (command.isNotNull(), "command",
         F.concat(F.lit("/"), command, F.coalesce(F.concat(F.lit(" "), args), F.lit("")))),
        (task.isNotNull(), "task",
         F.coalesce(_tag_body("summary", task), F.concat(F.lit("task "), status), task)),
        (stdout.isNotNull(), "stdout", F.when(stdout == "(no content)", "").otherwise(stdout)),
        (F.startswith(t, F.lit("<local-command-caveat>")), "caveat", F.lit("")),
        (reminder.isNotNull(), "reminder", reminder),
        (skill.isNotNull(), "skill", last_segment(skill)),
        (image.isNotNull(), "image", F.regexp_extract(image, r"([^/]*)$", 1)),
        (F.startswith(t, F.lit("[Request interrupted by user")), "interrupted",
         F.regexp_replace(F.substring(t, F.lit(2), F.length(t) - 2), r"^Request interrupted by user\s*", "")),
        (F.startswith(t, F.lit("## Context Usage")), "context",
         F.concat_ws(" · ", _blank_to_null(model), _blank_to_null(tokens))),
    ]
    tag, body = F.lit(None).cast("string"), t
    for cond, name, value in reversed(rules):
        tag, body = F.when(cond, name).otherwise(tag), F.when(cond, value).otherwise(body)
    return F.struct(tag.alias("tag"), body.alias("text"))


# --- outbound messages --------------------------------------------------------

_OUT = "struct<to:string,summary:string,message:string>"


def _decode(body: Column) -> Column:
    """JSON string escapes of a raw string body, decoded by the JSON reader."""
    return F.from_json(F.concat(F.lit('["'), body, F.lit('"]')), "array<string>",
                       {"allowUnquotedControlChars": "true"})[0]


def loose_field(name: str, s: Column, partial: bool = False) -> Column:
    """A string field of JSON that may be cut anywhere.

    A complete field comes back whole; a cut one only when `partial`, as far as
    it goes, ending in one ellipsis, without a half-written escape.
    """
    head = rf'"{name}"\s*:\s*"'
    whole = _decode(extract(s, head + r'((?:[^"\\]|\\.)*+)"'))
    if not partial:
        return whole
    rest = extract(s, head + r'((?:[^"\\]|\\.)*+\\?)$(?![\s\S])')
    rest = F.regexp_replace(rest, r"(?<!\\)((?:\\\\)*)\\(?:u[0-9a-fA-F]{0,3})?$", "$1")
    rest = F.regexp_replace(rest, r"\\u[dD][89abAB][0-9a-fA-F]{2}$", "")
    said = _decode(rest)
    cut = F.when(said.isin("", "…"), None).when(F.endswith(said, F.lit("…")), said).otherwise(F.concat(said, F.lit("…")))
    return F.coalesce(whole, cut)


def _whole_json(payload: Column) -> Column:
    return F.try_parse_json(payload).isNotNull()


def sent_head(payload: Column) -> Column:
    """struct<to, summary, message> of a SendMessage input, whole or cut."""
    whole, obj = _whole_json(payload), F.from_json(payload, _OUT)
    return F.struct(
        F.when(whole, obj["to"]).otherwise(loose_field("to", payload)).alias("to"),
        F.when(whole, F.coalesce(obj["summary"], obj["message"]))
        .otherwise(F.coalesce(loose_field("summary", payload), loose_field("message", payload, True))).alias("summary"),
        F.when(whole, obj["message"]).otherwise(loose_field("message", payload, True)).alias("message"),
    )


def ack_head(result: Column) -> Column:
    """struct<delivered, error>: a refused send is not a tool error, only its ack says so."""
    said = F.when(F.startswith(result, F.lit("{")), extract(result, fv.ACK_SUCCESS))
    return F.struct((said == "true").alias("delivered"),
                    F.when(said == "false", loose_field("message", result)).alias("error"))


def ack_msg_id(result: Column) -> Column:
    return F.when(F.startswith(result, F.lit("{")), extract(result, fv.ACK_MSG_ID))


# --- ids and paths --------------------------------------------------------------

def bridge_key(raw: Column) -> Column:
    """A bridge id in any spelling: URL prefix and session_/cse_ marker removed."""
    return F.regexp_replace(F.regexp_replace(raw, r"^.*/(?=session_)", ""), r"^(session|cse)_", "")


def repo_of(path: Column) -> Column:
    """A worktree checkout folded into the repository that owns it."""
    return F.substring_index(path, fv.WORKTREE_PATH, 1)


def repo_name(cwd: Column) -> Column:
    base = F.regexp_replace(repo_of(F.coalesce(cwd, F.lit(""))), r"^.*/", "")
    return F.when(base == "", "?").otherwise(base)


def short_path(path: Column) -> Column:
    home = F.regexp_replace(path, r"^/Users/[^/]+/code/", "")
    at = F.instr(home, fv.WORKTREE_PATH)
    return F.when(at > 0, F.concat(F.substring(home, F.lit(1), at - 1), F.lit(" · "),
                                   F.substring(home, at + len(fv.WORKTREE_PATH), F.length(home)))).otherwise(home)


def short_well(well: Column) -> Column:
    """Readable name of a well directory: repository · worktree."""
    tail = F.when(F.contains(well, F.lit("-code-")), F.regexp_replace(well, r"^.*?-code-", "")).otherwise(
        F.regexp_replace(well, "^-", ""))
    tail = F.regexp_replace(tail, fv.WORKTREE_MARK, " · ")
    return F.regexp_replace(tail, r"^(fun|work|personal|games)-", "$1/")
