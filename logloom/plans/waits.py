"""Waiting lint: polling and idle shapes of every session, and what they cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from logloom.functions import fixed_values as fv, pricing, tools
from logloom.functions.timekeys import utc_day, window_filter
from logloom.operators.filters import in_wells
from logloom.operators.ordered import scan, upper_median
from logloom.operators.stages import staged
from logloom.schemas import Corpus, uncut, whole


def calls_of(messages: DataFrame) -> DataFrame:
    """Instructions in order, with class, task reference and idleness."""
    calls = uncut(messages).filter((F.col("type") == "assistant") & (F.col("lane") == "tool"))
    tool = F.coalesce("tool_name", F.lit("?"))
    rows = calls.select("session_id", "line_no", "pos", "ts", "request_id", tool.alias("tool"),
                        tools.call_input(tool, F.col("text")).alias("payload"))
    rows = rows.withColumn("class", tools.call_class(F.col("tool"), F.col("payload")))
    ref = F.when(F.col("class") == "poll", tools.task_ref(F.col("tool"), F.col("payload")))
    return rows.withColumns({"ref": ref, "idle": F.col("class") == "idle"})


def _runs(calls: DataFrame, key: str, keep: Column) -> DataFrame:
    """Runs of adjacent instructions with the same key; gaps between neighbours, in tenths of a second."""
    rows = scan(calls, ["session_id"], ["line_no", "pos"],
                lag={"prev_key": F.col(key), "prev_ts": F.col("ts")}, island={"run": [key]}).filter(keep)
    gap = F.unix_millis("ts") - F.unix_millis("prev_ts")
    same = F.col(key).eqNullSafe(F.col("prev_key"))
    # rounding first keeps order, so the median of the rounded gaps is the rounded median
    return rows.withColumn("gap_ds", F.when(same, F.floor(gap / 100.0 + 0.5).cast("bigint")))


def poll_shape(calls: DataFrame, run_min: int = fv.RUN_MIN) -> DataFrame:
    """Per session: reads, files, rereads, runs, longest, inRuns and the upper median gap."""
    rows = _runs(calls, "ref", F.col("ref").isNotNull())
    runs = rows.groupBy("session_id", "run", "ref").agg(F.count("*").alias("n"))
    long = F.col("n") >= run_min
    shape = runs.groupBy("session_id").agg(
        F.sum("n").alias("reads"), F.count_distinct("ref").alias("files"),
        F.sum(long.cast("bigint")).alias("runs"), F.max("n").alias("longest"),
        F.sum(F.when(long, F.col("n")).otherwise(0)).alias("in_runs"))
    median = upper_median(rows, ["session_id"], "gap_ds", "gap")
    return (shape.join(median, "session_id", "left")
            .withColumns({"rereads": F.col("reads") - F.col("files"), "median_gap_s": F.col("gap") / 10}).drop("gap"))


def idle_shape(calls: DataFrame) -> DataFrame:
    """Per session: idle calls, longest unbroken stretch, upper median gap."""
    rows = _runs(calls, "idle", F.col("idle"))
    shape = (rows.groupBy("session_id", "run").agg(F.count("*").alias("n")).groupBy("session_id")
             .agg(F.sum("n").alias("idles"), F.max("n").alias("longest_idle")))
    median = upper_median(rows, ["session_id"], "gap_ds", "gap")
    return shape.join(median, "session_id", "left").withColumn("median_idle_gap_s", F.col("gap") / 10).drop("gap")


def request_classes(calls: DataFrame) -> DataFrame:
    """What each request was spent on: its highest-ranked call class."""
    return calls.filter(F.col("request_id").isNotNull()).groupBy("session_id", "request_id").agg(
        tools.request_class(F.col("class")).alias("class"),
        F.max(F.col("ref").isNotNull()).alias("polled"))


def priced_requests(c: Corpus, requests: DataFrame | None = None) -> DataFrame:
    reqs = (c.requests if requests is None else requests).withColumn("rate_day", utc_day(F.col("ts")))
    return pricing.priced(reqs, c.rates)


def class_rollup(c: Corpus, classes: DataFrame | None = None) -> DataFrame:
    """Per session and class: requests, output, dollars and share of the whole.

    One unpriced request nulls its class and every share of its session. A
    request without calls counts as text.
    """
    if classes is None:
        classes = request_classes(calls_of(c.messages))
    steps = priced_requests(c).join(
        classes.withColumnRenamed("request_id", "message_id"), ["session_id", "message_id"], "left")
    per = steps.groupBy("session_id", F.coalesce("class", F.lit("text")).alias("class")).agg(
        F.count("*").alias("requests"), F.sum("output_tokens").alias("output_tokens"),
        pricing.poisoned_sum(F.col("list_usd")).alias("usd"))
    whole = per.groupBy("session_id").agg(pricing.poisoned_sum(F.col("usd")).alias("total"))
    share = F.when(F.col("total") != 0, pricing.round3(F.col("usd") / F.col("total")))
    return per.join(whole, "session_id").select(
        "session_id", "class", "requests", "output_tokens", pricing.round2(F.col("usd")).alias("list_usd"), share.alias("share"))


def waiting_sessions(messages: DataFrame) -> DataFrame:
    """Loose prefilter: sessions with a call that might poll or idle. The classes judge."""
    text = whole(messages)
    maybe = (F.contains(text, F.lit("tasks/")) | F.contains(text, F.lit('"command":"true"'))
             | F.contains(text, F.lit('"command":":"')) | F.contains(text, F.lit('"command":""'))
             | F.contains(text, F.lit('"command":"echo ')))
    return messages.filter((F.col("lane") == "tool") & (F.col("type") == "assistant")
                           & F.col("tool_name").isin("Bash", "TaskOutput") & maybe).select("session_id").distinct()


def waiting_lint(c: Corpus, well=None, exact=False, since=None, until=None, tz="UTC", limit: int | None = None) -> DataFrame:
    """Sessions that polled or idled, costliest first; a session that did neither is no row."""
    active = F.coalesce("last_activity_ts", "last_ts")
    picked = in_wells(c.sessions.select("session_id", "well", "first_ts", active.alias("last")), c.wells, "well", well, exact)
    if since:
        picked = picked.filter(window_filter(F.col("last"), since, None, tz))
    if until:
        picked = picked.filter(window_filter(F.col("first_ts"), None, until, tz))
    messages = c.messages.join(waiting_sessions(c.messages), "session_id", "left_semi")
    if well or since or until:
        messages = messages.join(picked.select("session_id"), "session_id", "left_semi")
    calls = staged(calls_of(messages), "waiting-calls")
    span = calls.groupBy("session_id").agg(F.min(F.col("ts")).alias("first"), F.max("ts").alias("last"))
    shapes = poll_shape(calls).join(idle_shape(calls), "session_id", "full")

    waits = request_classes(calls).filter(F.col("polled") | (F.col("class") == "idle")).select(
        "session_id", F.col("request_id").alias("message_id"), "polled", (F.col("class") == "idle").alias("idled"))
    cost = priced_requests(c).join(waits, ["session_id", "message_id"])
    side = lambda flag: F.when(F.count(F.when(flag, F.lit(1))) == F.count(F.when(flag, F.col("list_usd"))),
                               F.coalesce(F.sum(F.when(flag, F.col("list_usd"))), F.lit(0.0)))
    usd = cost.groupBy("session_id").agg(
        side(F.col("polled")).alias("poll_usd"), side(F.col("idled")).alias("idle_usd"),
        pricing.poisoned_sum(F.col("list_usd")).alias("wasted_usd"), F.lit(True).alias("paid"))
    n = waits.groupBy("session_id").agg(F.sum(F.col("polled").cast("bigint")).alias("poll_requests"),
                                        F.sum(F.col("idled").cast("bigint")).alias("idle_requests"))
    counts = ["reads", "files", "rereads", "runs", "longest", "in_runs", "idles", "longest_idle", "poll_requests", "idle_requests"]
    money = ["poll_usd", "idle_usd", "wasted_usd"]
    rows = (shapes.join(span, "session_id").join(n, "session_id", "left").join(usd, "session_id", "left")
            .withColumns({x: F.coalesce(x, F.lit(0)) for x in counts})
            .withColumns({x: F.when(F.col("paid"), pricing.round2(F.col(x))).otherwise(0.0) for x in money}).drop("paid"))
    ordered = rows.join(picked.select("session_id", "well"), "session_id").orderBy(
        F.coalesce("wasted_usd", F.lit(-1.0)).desc(), *[F.col(x).desc() for x in ("idles", "in_runs", "rereads", "reads")], "session_id")
    return ordered.limit(limit) if limit else ordered


def waiting_totals(rows: DataFrame) -> DataFrame:
    """Totals over every row of the lint (take them before a limit)."""
    usd = lambda n: pricing.round2(pricing.poisoned_sum(F.col(n))).alias(n)
    return rows.agg(*[F.sum(n).alias(n) for n in ("reads", "in_runs", "rereads", "poll_requests", "idles", "idle_requests")],
                    usd("poll_usd"), usd("idle_usd"), usd("wasted_usd"))
