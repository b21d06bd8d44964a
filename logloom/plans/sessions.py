"""Session listings, dumps, tool counts, corpus statistics, well pages, record census."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from logloom.functions import envelope as env, models, pricing
from logloom.functions.text import headline
from logloom.functions.timekeys import local_day, window_filter
from logloom.operators.filters import in_wells
from logloom.operators.ordered import top_one
from logloom.plans import usage as us
from logloom.schemas import Corpus


def prompt_counts(messages: DataFrame) -> DataFrame:
    return messages.filter("lane = 'prompt'").groupBy("session_id").agg(F.count("*").alias("prompts"))


def work_dirs(messages: DataFrame) -> DataFrame:
    """Modal and distinct working directories per session (counted before ranked)."""
    n = messages.filter("cwd IS NOT NULL").groupBy("session_id", "cwd").agg(F.count("*").alias("n"))
    return n.groupBy("session_id").agg(F.min_by("cwd", F.struct(-F.col("n"), "cwd")).alias("work_dir"), F.count("*").alias("work_dirs"))


def openers(messages: DataFrame) -> DataFrame:
    """First prompt or relay by time; a relay is headed by its body and names its sender."""
    rows = messages.filter(F.col("lane").isin("prompt", "relay"))
    first = top_one(rows, ["session_id"], F.struct("ts", "line_no", "pos"), ["lane", "peer", "text"])
    relay = env.relay_head(F.col("text"))
    is_relay = F.col("lane") == "relay"
    return first.select("session_id", headline(F.when(is_relay, relay["text"]).otherwise(F.col("text"))).alias("first_prompt"),
                        F.when(is_relay, F.coalesce("peer", relay["from_name"])).alias("opened_by"))


def steers(messages: DataFrame) -> DataFrame:
    """off, or the steer (strict by default), from the first auto-mode event of a session."""
    mark = "auto_mode: "
    rows = messages.filter((F.col("lane") == "event") & F.startswith("text", F.lit(mark)))
    mode = F.from_json(F.substring(F.col("text"), F.lit(len(mark) + 1), F.length("text")), "struct<bashFirst:boolean,bashFirstSteer:string>")
    parsed = rows.withColumn("mode", mode).filter(F.col("mode").isNotNull())
    first = top_one(parsed, ["session_id"], F.struct("line_no", "pos"), ["mode"])
    return first.select("session_id", F.when(F.col("mode.bashFirst"), F.coalesce("mode.bashFirstSteer", F.lit("strict"))).otherwise("off").alias("steer"))


def session_list(c: Corpus, limit: int | None = None, by_activity: bool = False, well=None, exact=False, since=None, tz="UTC") -> DataFrame:
    """The newest `limit` sessions, oldest first: picked before they are decorated.

    Without a limit the newest 100 are listed, and with `since` all of the window. `capped` tells
    whether as many were found as the limit allows.
    """
    limit = limit if limit is not None or since else 100
    last = F.coalesce("last_activity_ts", "last_ts")
    rows = in_wells(c.sessions, c.wells, "well", well, exact).withColumn("last_at", last)
    if since:
        rows = rows.filter(window_filter(F.col("last_at"), since, None, tz))
    newest = F.col("last_at") if by_activity else F.col("first_ts")
    picked = rows if limit is None else rows.orderBy(newest.desc(), "session_id").limit(limit)
    full = F.lit(False) if limit is None else picked.agg(F.count("*") >= limit).scalar()
    picked = picked.select(
        "session_id", "well", "lines", "first_ts", "last_at",
        F.when(F.col("last_activity_ts").isNotNull() & (F.col("last_ts") > F.col("last_activity_ts")), F.col("last_ts")).alias("idle_until"))
    mine = c.messages.join(picked.select("session_id"), "session_id", "left_semi")
    mix = models.model_lists(models.tally(c.requests.join(picked.select("session_id"), "session_id", "left_semi"), ["session_id"]), ["session_id"])
    out = picked
    for part in (prompt_counts(mine), work_dirs(mine), openers(mine), steers(mine), mix):
        out = out.join(part, "session_id", "left")
    out = out.withColumns({"prompts": F.coalesce("prompts", F.lit(0)), "work_dirs": F.coalesce("work_dirs", F.lit(0)),
                           "first_day": local_day(F.col("first_ts"), tz), "last_day": local_day(F.col("last_at"), tz)})
    out = out.withColumn("capped", full)
    return out.orderBy(*(["last_at", "first_ts"] if by_activity else ["first_ts"]), "session_id")


def session_dump(c: Corpus, session_prefix: str, lanes: list[str], since=None, until=None, tz="UTC", limit: int | None = None) -> DataFrame:
    rows = c.messages.filter(F.startswith("session_id", F.lit(session_prefix)) & F.col("lane").isin(lanes))
    rows = rows.filter(window_filter(F.col("ts"), since, until, tz)).orderBy("session_id", "line_no", "pos")
    return rows.limit(limit) if limit else rows


def cwd_histogram(messages: DataFrame) -> DataFrame:
    return messages.filter("cwd IS NOT NULL").groupBy("session_id", "cwd").agg(F.count("*").alias("n")).orderBy("session_id", F.col("n").desc(), "cwd")


def tool_counts(c: Corpus, prefix: str | None = None, well=None, exact=False, since=None, tz="UTC", limit: int | None = None) -> DataFrame:
    rows = c.messages.filter(F.col("tool_name").isNotNull())
    if prefix:
        rows = rows.filter(F.col("tool_name").ilike(f"{prefix}%"))
    if since:
        rows = rows.filter(window_filter(F.col("ts"), since, None, tz))
    # one row per (tool, session) before wells are looked up: distinct counts stay cheap and skew-free
    per = rows.groupBy("tool_name", "session_id").agg(F.count("*").alias("n"), F.min("ts").alias("a"), F.max("ts").alias("b"))
    per = per.join(in_wells(c.sessions.select("session_id", "well"), c.wells, "well", well, exact), "session_id")
    out = per.groupBy("tool_name").agg(
        F.sum("n").alias("n"), F.count("*").alias("sessions"), F.count_distinct("well").alias("wells"),
        local_day(F.min("a"), tz).alias("first"), local_day(F.max("b"), tz).alias("last")).orderBy(F.col("n").desc(), "tool_name")
    return out.limit(limit) if limit else out


def lane_counts(messages: DataFrame) -> DataFrame:
    return messages.groupBy("lane").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "lane")


def top_wells(c: Corpus, limit: int = 15) -> DataFrame:
    n = c.messages.groupBy("session_id").agg(F.count("*").alias("m"))
    per = c.sessions.select("session_id", "well").join(n, "session_id", "left").groupBy("well").agg(
        F.count("*").alias("sessions"), F.coalesce(F.sum("m"), F.lit(0)).alias("messages"))
    return (c.wells.select(F.col("dir").alias("well")).join(per, "well", "left").na.fill(0, ["sessions", "messages"])
            .orderBy(F.col("messages").desc(), "well").limit(limit))


def peers(messages: DataFrame) -> DataFrame:
    return messages.filter("lane = 'relay' AND peer IS NOT NULL").groupBy("peer").agg(
        F.count("*").alias("messages"), F.count_distinct("session_id").alias("sessions"),
        F.min("ts").alias("first"), F.max("ts").alias("last")).orderBy(F.col("messages").desc(), "peer")


def corpus_totals(c: Corpus) -> DataFrame:
    """One row: table sizes, date range and emptiness warnings."""
    span = c.sessions.agg(F.count("*").alias("sessions"), F.min("first_ts").alias("earliest"), F.max("last_ts").alias("latest"))
    size = lambda df: df.agg(F.count("*")).scalar() if df is not None else F.lit(0)
    out = span.withColumns({"messages": size(c.messages), "history_rows": size(c.history), "repos": size(c.repos), "docs": size(c.docs),
                            "requests": size(c.requests), "jobs": size(c.jobs)})
    warn = F.array_compact(F.array(
        F.when((F.col("docs") == 0) | (F.col("repos") == 0), "documents are empty"),
        F.when(F.col("sessions") == 0, "no sessions indexed")))
    return out.withColumn("warnings", F.array_join(warn, "; "))


def well_page(c: Corpus, well: str, weeks: int = 26) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sessions with usage, the weekly trend, and the model tally of one well."""
    usage = us.usage(c, "session", well=well, exact=True).withColumnRenamed("key", "session_id").drop("sessions")
    rows = in_wells(c.sessions, c.wells, "well", well, True).join(usage, "session_id", "left")
    mix = models.tally(us.main_requests(c, well=well, exact=True), ["well"])
    return rows, us.usage(c, "week", well=well, exact=True, limit=weeks), mix


def job_day_sums(keyed: DataFrame, usage_rows: DataFrame, tz: str = "UTC") -> DataFrame:
    """Dollars of a job per local day its sessions began; NULL when one session is unpriced."""
    rows = keyed.select("session_id", "key", local_day(F.col("first_ts"), tz).alias("day")).join(usage_rows, "session_id", "left")
    none = F.col("requests").isNull()
    usd = lambda n: pricing.round2(pricing.poisoned_sum(F.when(none, 0.0).otherwise(F.col(n)))).alias(n)
    return rows.groupBy("key", "day").agg(F.count("*").alias("sessions"), usd("list_usd"))


def record_census(entries: DataFrame) -> DataFrame:
    """Lines per record type and the share of conversational lines."""
    speaks = F.col("lane").isin("prompt", "text", "relay")
    per = entries.filter("head").groupBy("type").agg(F.count("*").alias("n"), F.sum(F.coalesce(speaks, F.lit(False)).cast("bigint")).alias("spoken"))
    return per.withColumn("spoken_share", pricing.round3(F.col("spoken") / F.col("n")))
