"""Tool-call classes, task references, families and command dissection."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from logloom.functions import fixed_values as fv
from logloom.functions.text import extract, fold_space

_COMMAND = r'"command":"((?:[^"\\]|\\.)*+)"'


def call_input(tool: Column, text: Column) -> Column:
    """A call row's text without the tool name that heads it."""
    return F.when(F.startswith(text, tool), F.trim(F.substring(text, F.length(tool) + 1, F.length(text)))).otherwise(text)


def raw_command(payload: Column) -> Column:
    return F.coalesce(extract(payload, _COMMAND), payload)


def bash_command(payload: Column) -> Column:
    c = F.regexp_replace(raw_command(payload), r"\\n", "\n")
    return F.replace(F.replace(c, F.lit('\\"'), F.lit('"')), F.lit("\\\\"), F.lit("\\"))


def task_ref(tool: Column, payload: Column) -> Column:
    return (F.when(tool == "TaskOutput", extract(payload, fv.TASK_ID))
            .when(tool == "Bash", extract(bash_command(payload), fv.TASK_PATH)))


def call_class(tool: Column, payload: Column) -> Column:
    cmd = bash_command(payload)
    shell = (F.when(cmd.rlike(fv.IDLE_NOOP) | cmd.rlike(fv.IDLE_ECHO), "idle")
             .when(cmd.rlike(fv.LOOP_WAIT), "wait")
             .when(cmd.rlike(fv.TASK_PATH), "poll")
             .when(cmd.rlike(fv.BARE_SLEEP), "wait")
             .otherwise("shell"))
    return (F.when(tool == "Bash", shell)
            .when(tool == "TaskOutput", F.when(payload.rlike(fv.BLOCKING), "wait").otherwise("poll"))
            .when(tool == "Monitor", "wait")
            .when(tool.isin(fv.READ_TOOLS), "read")
            .when(tool.isin(fv.WRITE_TOOLS), "write")
            .when(tool.isin(fv.SPAWN_TOOLS), "spawn")
            .when(tool == "SendMessage", "relay")
            .otherwise("other"))


def class_rank(cls: Column) -> Column:
    rank = F.lit(0)
    for name, n in sorted(fv.CLASS_RANK.items(), key=lambda kv: kv[1]):
        if n:
            rank = F.when(cls == name, n).otherwise(rank)
    return rank


def class_of_rank(rank: Column) -> Column:
    out = F.lit("text")
    for name, n in fv.CLASS_RANK.items():
        if n:
            out = F.when(rank == n, name).otherwise(out)
    return out


def request_class(cls: Column) -> Column:
    """Aggregate: the highest-ranked class among a request's calls; none = text."""
    return class_of_rank(F.coalesce(F.max(class_rank(cls)), F.lit(0)))


def family(tool: Column) -> Column:
    out = F.lit("other")
    for name, tools in fv.TOOL_FAMILIES.items():
        out = F.when(tool.isin(tools), name).otherwise(out)
    return out


# --- command dissection (denials) -------------------------------------------

def statements(cmd: Column) -> Column:
    """Trimmed, non-empty statements of a command whose white space is folded."""
    parts = F.split(fold_space(F.coalesce(cmd, F.lit(""))), r"&&|\|\||;|\n")
    return F.filter(F.transform(parts, lambda p: F.trim(p)), lambda s: s != "")


def programs(cmd: Column) -> Column:
    """Base name of the first word of each statement that is no VAR=value prefix."""
    def program(st: Column) -> Column:
        words = F.filter(F.split(st, r"\s+"), lambda w: ~(F.contains(w, F.lit("=")) & ~F.startswith(w, F.lit("-"))))
        return F.regexp_replace(F.ltrim(F.try_element_at(words, F.lit(1)), F.lit("(")), r"^.*/", "")

    return F.array_distinct(F.filter(F.transform(statements(cmd), program), lambda p: p.isNotNull()))


def target_tokens(cmd: Column) -> Column:
    found = F.regexp_extract_all(fold_space(F.coalesce(cmd, F.lit(""))), F.lit(r"([A-Za-z0-9_.:/-]{6,})"), F.lit(1))
    return F.array_except(F.transform(found, lambda t: F.lower(t)), F.array(*[F.lit(b) for b in fv.BORING_TOKENS]))
