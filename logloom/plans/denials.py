"""Denied tool calls: why, and what the session did next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from logloom.functions import envelope as env, fixed_values as fv, tools
from logloom.functions.text import fold_space
from logloom.operators.ordered import scan
from logloom.operators.sizes import small_side
from logloom.operators.stages import staged

FILES_AT_ONCE = 5_000


def denial_files(lines: DataFrame) -> DataFrame:
    """Files that hold a denial at all: a raw-text test before any parsing."""
    return lines.filter(F.contains("value", F.lit(fv.DENIAL_NEEDLE))).select("file_path").distinct()


def matching_files(lines: DataFrame) -> DataFrame:
    """Lines of the files that hold a denial. Lines are not shuffled on their file as long as the list of files is measured small."""
    return lines.join(small_side(staged(denial_files(lines), "denial-files")), "file_path", "left_semi")


def input_target(payload: Column) -> Column:
    """The one string worth comparing: a command, else a path, else the payload."""
    fields = [F.nullif(F.get_json_object(payload, f"$.{f}"), F.lit("")) for f in fv.TARGET_FIELDS]
    return F.coalesce(*fields, payload, F.lit(""))


def record_steps(records: DataFrame) -> DataFrame:
    """Numbered log records -> the fields the report follows, one row per record.

    A record may hold several calls or results: `calls` and `result_ids` list them all, so that any
    of them is found again. What came next, and what was denied, goes by the first.
    """
    calls = F.filter("blocks", lambda b: b["type"] == "tool_use")
    first = F.try_element_at(calls, F.lit(1))
    results = F.filter("blocks", lambda b: b["type"] == "tool_result")
    result = F.try_element_at(results, F.lit(1))
    texts = F.array_join(F.transform(F.filter("blocks", lambda b: b["type"] == "text"), lambda b: b["text"]), " ")
    assistant, user = F.col("type") == "assistant", F.col("type") == "user"
    raw = F.coalesce("tool_use_result", result["content"])
    return records.select(
        "file_path", "session_id", "line_no", "ts", "cwd", F.col("denial_kind").alias("kind"),
        F.when(assistant, first["id"]).alias("call_id"), F.when(assistant, first["name"]).alias("call_tool"),
        F.when(assistant & first.isNotNull(), input_target(first["input"])).alias("call_cmd"),
        F.when(assistant, F.nullif(F.trim(texts), F.lit(""))).alias("said"),
        F.when(assistant, F.transform(calls, lambda b: F.struct(b["id"].alias("id"), b["name"].alias("tool"), input_target(b["input"]).alias("cmd")))).alias("calls"),
        F.when(user, result["tool_use_id"]).alias("result_id"), F.when(user, F.transform(results, lambda b: b["tool_use_id"])).alias("result_ids"),
        (user & (F.coalesce(F.size(results), F.lit(0)) <= 0) & ~F.coalesce("is_meta", F.lit(False))).alias("human"),
        F.when(F.col("denial_kind").isNotNull(), fold_space(F.regexp_extract(raw, r"(?s)Reason:\s*(.*?)(?:\s*If you have other tasks|$(?![\s\S]))", 1))).alias("reason"))


def denial_rows(steps: DataFrame) -> DataFrame:
    """One row per denial, with the next call, the text before it, and who spoke first.

    The denied call is any call of the file under the result's id, the last one if the id returns.
    "Next" is a backward scan over chunks: the nearest following call, text and
    human record are carried towards the denial.
    """
    call = F.struct("line_no", F.col("call_id").alias("id"), F.col("call_tool").alias("tool"), F.col("call_cmd").alias("cmd"))
    acted = F.col("call_tool").isNotNull()
    rows = scan(steps, ["file_path"], ["line_no"], descending=True, carry_before={
        "next_call": F.when(acted, call), "next_said": F.when(F.col("said").isNotNull(), F.struct("line_no", "said")),
        "next_human": F.when(F.col("human"), F.col("line_no"))})
    rows = rows.filter(F.col("kind").isNotNull()).drop("calls", "result_ids")
    made = steps.select("file_path", "line_no", F.posexplode("calls").alias("pos", "c"))
    calls = made.groupBy("file_path", F.col("c.id").alias("result_id")).agg(F.max_by(F.struct("c.tool", "c.cmd"), F.struct("line_no", "pos")).alias("src"))
    told = steps.filter("kind IS NOT NULL").select("file_path", "line_no", "kind", F.explode("result_ids").alias("nid"))
    denied = told.groupBy("file_path", "nid").agg(F.max_by("kind", "line_no").alias("next_denied"))
    before = F.col("next_call").isNull() | (F.col("next_said.line_no") <= F.col("next_call.line_no"))
    human = F.col("next_human").isNotNull() & (F.col("next_call").isNull() | (F.col("next_human") < F.col("next_call.line_no")))
    return (rows.join(calls, ["file_path", "result_id"], "left").withColumn("nid", F.col("next_call.id")).join(denied, ["file_path", "nid"], "left")
            .select("file_path", "session_id", "line_no", "kind", "ts", "cwd", env.repo_name(F.col("cwd")).alias("repo"),
                    F.coalesce("src.tool", F.lit("?")).alias("tool"), F.coalesce("src.cmd", F.lit("")).alias("cmd"),
                    F.coalesce("reason", F.lit("")).alias("reason"),
                    F.coalesce("next_call.tool", F.lit("")).alias("next_tool"), F.coalesce("next_call.cmd", F.lit("")).alias("next_cmd"),
                    F.coalesce("next_denied", F.lit("")).alias("next_denied"),
                    F.when(before, fold_space(F.coalesce("next_said.said", F.lit("")))).otherwise("").alias("next_text"),
                    human.alias("human_first")))


def page(rows: DataFrame) -> DataFrame:
    """The rows as a listing prints them, long values cut; every count and test works on the whole ones."""
    return rows.withColumns({c: F.substring(c, 1, n) for c, n in fv.DENIAL_CUTS.items()})


def in_window(rows: DataFrame, since: str | None = None, until: str | None = None, kind: str | None = None) -> DataFrame:
    day = F.date_format("ts", "yyyy-MM-dd")
    rows = rows.filter(day >= since) if since else rows
    rows = rows.filter(day < until) if until else rows
    return rows.filter(F.col("kind") == kind) if kind else rows


def response_shape() -> Column:
    """What the session did after the denial; the first rule that holds."""
    a, b = fold_space(F.col("cmd")), fold_space(F.col("next_cmd"))
    return (F.when(F.col("human_first"), fv.SHAPE_STOPPED)
            .when(F.col("next_cmd") == "", fv.SHAPE_NONE)
            .when(a == b, fv.SHAPE_VERBATIM)
            .when(F.col("next_tool") != F.col("tool"), fv.SHAPE_SWITCHED)
            .when((F.size(tools.statements(a)) > 1) & F.arrays_overlap(tools.statements(a), tools.statements(b)), fv.SHAPE_SPLIT)
            .when(F.arrays_overlap(tools.programs(a), tools.programs(b)), fv.SHAPE_RESHAPED)
            .when(F.arrays_overlap(tools.target_tokens(a), tools.target_tokens(b)), fv.SHAPE_ROUTED)
            .otherwise(fv.SHAPE_DROPPED))


def _pct(part: Column, n: Column) -> Column:
    return F.bround(100.0 * part / n).cast("bigint")  # half to even


def by_kind(rows: DataFrame) -> DataFrame:
    n = lambda cond: F.sum(cond.cast("bigint"))
    verbatim = (F.col("next_cmd") != "") & (fold_space(F.col("next_cmd")) == fold_space(F.col("cmd")))
    per = rows.groupBy("kind").agg(F.count("*").alias("n"), n(F.col("human_first")).alias("stopped"), n(verbatim).alias("verbatim"),
                                   n(F.col("next_denied") != "").alias("re_denied"))
    return per.withColumns({f"{x}_pct": _pct(F.col(x), F.col("n")) for x in ("stopped", "verbatim", "re_denied")}).orderBy(F.col("n").desc(), "kind")


def judged(rows: DataFrame) -> DataFrame:
    """The classifier-blocked rows, or all rows when there are none."""
    blocked = F.col("kind") == "automode-blocked"
    any_blocked = rows.agg(F.coalesce(F.max(blocked.cast("int")), F.lit(0))).scalar()
    return rows.filter(blocked | (any_blocked == 0))


def shapes(rows: DataFrame) -> DataFrame:
    rows = judged(rows)
    n = rows.agg(F.count("*")).scalar()
    per = rows.groupBy(response_shape().alias("shape")).agg(F.count("*").alias("n"))
    return per.withColumn("pct", _pct(F.col("n"), n)).orderBy(F.col("n").desc(), "shape")


def places(rows: DataFrame) -> DataFrame:
    """Repositories, tools, command heads and masked reasons, counted in one pass."""
    head = F.array_join(F.slice(F.split(fold_space(F.col("cmd")), " "), 1, 2), " ")
    reason = F.when(F.col("reason") != "", F.substring(F.regexp_replace("reason", "[0-9a-f-]{16,}", "<id>"), 1, 70))
    what = F.explode(F.array_compact(F.array(
        F.struct(F.lit("repo").alias("what"), F.col("repo").alias("value")), F.struct(F.lit("tool").alias("what"), F.col("tool").alias("value")),
        F.when(F.col("tool") == "Bash", F.struct(F.lit("command").alias("what"), head.alias("value"))),
        F.when(reason.isNotNull(), F.struct(F.lit("reason").alias("what"), reason.alias("value"))))))
    return judged(rows).select(what.alias("w")).groupBy("w.what", "w.value").agg(F.count("*").alias("n")).orderBy("what", F.col("n").desc(), "value")


def route_arounds(rows: DataFrame) -> DataFrame:
    return judged(rows).filter(response_shape() == fv.SHAPE_ROUTED)


def handovers(rows: DataFrame) -> DataFrame:
    """How many closing messages quote a runnable command, and how many name the `!` prefix."""
    stops = judged(rows).filter("human_first")
    n = lambda pattern: F.coalesce(F.sum(F.col("next_text").rlike(pattern).cast("bigint")), F.lit(0))
    return stops.agg(F.count("*").alias("stops"), n(r"`[^`]{6,}`|```").alias("quoted"), n(r"`!\s|the `!` prefix").alias("named_prefix"))


def read_denials(lines: DataFrame) -> DataFrame:
    """Raw numbered-scan lines -> denial rows: prefilter, parse the matching files only, follow."""
    return _followed(matching_files(lines))


def _followed(lines: DataFrame) -> DataFrame:
    from logloom.sources import transcripts as tr

    records = tr.number_records(tr.parse_lines(tr.session_lines(lines)))
    return denial_rows(staged(record_steps(records), "denial-steps"))


def scan_denials(spark: SparkSession, root: str) -> DataFrame:
    """Denials under a folder: all files are searched for one, and those that hold any are opened again, no others.

    The list of files goes through the driver up to FILES_AT_ONCE; a longer one is joined with all lines.
    """
    from logloom.sources import transcripts as tr

    files = staged(denial_files(tr.read_lines(spark, root)), "denial-files")
    names = [r.file_path for r in files.limit(FILES_AT_ONCE + 1).collect()]
    if len(names) > FILES_AT_ONCE:
        return _followed(tr.read_lines(spark, root).join(files, "file_path", "left_semi"))
    return _followed(tr.read_lines(spark, names) if names else tr.read_lines(spark, root).where("false"))
