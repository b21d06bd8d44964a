"""Token and cost profile: main thread, sub-agents, splits and totals.

Cells (key, model, UTC day) are summed first, so only cells, never requests, are
priced; grouping sets count sessions in the same pass over the requests. A row's dollars are NULL when any of its cells is unpriced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from logloom.functions import fixed_values as fv, models, pricing
from logloom.functions.timekeys import TIME_KEYS, utc_day
from logloom.operators.filters import in_wells, scoped
from logloom.schemas import Corpus

GROUPINGS = ["well", "session", "model", "day", "week", "month"]
SUMS = ["input_tokens", "cache_write_tokens", "cache_write_1h_tokens", "cache_read_tokens", "output_tokens", "thinking_tokens"]


def _key(by: str, tz: str) -> Column:
    if by in TIME_KEYS:
        return TIME_KEYS[by](F.col("ts"), tz)
    return {"well": F.col("well"), "session": F.col("session_id"),
            "model": F.coalesce("model", F.lit("?"))}[by]


def main_requests(c: Corpus, by: str = "well", **scope) -> DataFrame:
    """Requests in scope; they meet their sessions only where the well is asked for."""
    well, exact = scope.pop("well", None), scope.pop("exact", False)
    requests = scoped(c.requests, **scope)
    if by != "well" and not well:
        return requests
    sessions = in_wells(c.sessions.select("session_id", "well"), c.wells, "well", well, exact)
    return requests.join(sessions, "session_id")


def sub_requests(c: Corpus, by: str = "well", **scope) -> DataFrame:
    """Sub-agent requests under their parent session, in the well their log sits in."""
    well, exact = scope.pop("well", None), scope.pop("exact", False)
    if by != "well" and not well:
        return scoped(c.spawn_requests, **scope)
    spawns = in_wells(c.spawns.select("agent_id", F.col("well_dir").alias("well")), c.wells, "well", well, exact)
    return scoped(c.spawn_requests, **scope).join(spawns, "agent_id")


def cells(requests: DataFrame, by: str, rates: DataFrame, tz: str = "UTC", keys: list[Column] | None = None) -> DataFrame:
    key = [_key(by, tz).alias("key")] if keys is None else keys
    grouped = requests.groupBy(*key, "model", utc_day(F.col("ts")).alias("rate_day")).agg(
        F.count("*").alias("requests"), *[F.sum(t).alias(t) for t in SUMS])
    return pricing.priced(grouped, rates)


def main_rows(c: Corpus, by: str, tz: str = "UTC", **scope) -> DataFrame:
    """Per key: requests, distinct sessions, token sums and list price."""
    reqs = main_requests(c, by, tz=tz, **scope).withColumns({"key": _key(by, tz), "rate_day": utc_day(F.col("ts"))})
    # one pass gives the cells, which are priced as sums, and the distinct sessions of each key
    sets = reqs.groupingSets([["key", "model", "rate_day"], ["key", "session_id"]], "key", "model", "rate_day", "session_id")
    grouped = sets.agg(F.grouping("session_id").alias("cell"), F.count("*").alias("requests"), *[F.sum(t).alias(t) for t in SUMS])

    def of_cells(name: str) -> Column:
        return F.when(F.col("cell") == 1, F.col(name))

    usd = of_cells("list_usd")
    priced_all = F.count(usd) == F.sum("cell")
    return pricing.priced(grouped, c.rates).groupBy("key").agg(
        *[F.sum(of_cells(n)).alias(n) for n in ("requests", *SUMS)],
        pricing.round2(F.when(priced_all, F.coalesce(F.sum(usd), F.lit(0.0)))).alias("list_usd"),
        F.count(F.when(F.col("cell") == 0, F.col("session_id"))).alias("sessions"))


def sub_rows(c: Corpus, by: str, tz: str = "UTC", **scope) -> DataFrame:
    priced = _billed(cells(sub_requests(c, by, tz=tz, **scope), by, c.rates, tz))
    return priced.groupBy("key").agg(
        F.sum("requests").alias("spawn_requests"), F.sum("cache_write_tokens").alias("spawn_cache_write"),
        F.sum("cache_read_tokens").alias("spawn_cache_read"), F.sum("output_tokens").alias("spawn_request_output"),
        pricing.round2(pricing.poisoned_sum(F.col("sub_usd"))).alias("spawn_usd"))


def _billed(priced: DataFrame) -> DataFrame:
    """A cell that bills nothing never unprices its row."""
    billed = F.col("input_tokens") + F.col("cache_write_tokens") + F.col("cache_read_tokens") + F.col("output_tokens") > 0
    return priced.withColumns({"billed": billed, "sub_usd": F.when(~billed & F.col("list_usd").isNull(), 0.0).otherwise(F.col("list_usd"))})


def usage(c: Corpus, by: str = "day", tz: str = "UTC", subagents: bool = False, limit: int | None = None, **scope) -> DataFrame:
    rows = main_rows(c, by, tz, **scope)
    if subagents:
        counts = ["requests", "sessions", *SUMS]
        subs = ["spawn_requests", "spawn_cache_write", "spawn_cache_read", "spawn_request_output"]
        both = rows.withColumn("has_main", F.lit(True)).join(
            sub_rows(c, by, tz, **scope).withColumn("has_sub", F.lit(True)), "key", "full")
        zero = {n: F.coalesce(n, F.lit(0)) for n in counts + subs}
        # a side that is absent costs 0; a side that is unpriced stays NULL
        zero["list_usd"] = F.when(F.col("has_main"), F.col("list_usd")).otherwise(0.0)
        zero["spawn_usd"] = F.when(F.col("has_sub"), F.col("spawn_usd")).otherwise(0.0)
        if by == "session":
            zero["sessions"] = F.lit(1).cast("bigint")
        rows = both.withColumns(zero).drop("has_main", "has_sub")
        rows = rows.withColumn("all_in_usd", pricing.round2(F.col("list_usd") + F.col("spawn_usd")))
    if by in ("well", "session"):
        rows = rows.join(spawn_rollup(c, by, tz, **scope), "key", "left").withColumns(
            {n: F.coalesce(n, F.lit(0)) for n in ("spawns", "spawn_output")}) if c.spawns is not None else rows
    return _page(rows, by, subagents, limit)


def _page(rows: DataFrame, by: str, subagents: bool, limit: int | None) -> DataFrame:
    """Newest buckets in ascending order, or costliest keys first (unpriced last)."""
    if by in TIME_KEYS:
        newest = rows.orderBy(F.col("key").desc()).limit(limit) if limit else rows
        return newest.orderBy("key")
    cost = F.coalesce("list_usd", F.lit(-1.0))
    if subagents:
        cost = F.coalesce(F.col("all_in_usd"), cost + F.coalesce("spawn_usd", F.lit(0.0)))
    ordered = rows.orderBy(cost.desc(), F.col("output_tokens").desc(), "key")
    return ordered.limit(limit) if limit else ordered


def spawn_rollup(c: Corpus, by: str, tz: str = "UTC", **scope) -> DataFrame:
    """Spawns by when they started, under the filters of the row they sit on."""
    well, exact = scope.pop("well", None), scope.pop("exact", False)
    rows = scoped(in_wells(c.spawns, c.wells, "well_dir", well, exact), ts="first_ts", tz=tz, **scope)
    return rows.groupBy(F.col("well_dir" if by == "well" else "session_id").alias("key")).agg(
        F.count("*").alias("spawns"), F.sum("output_tokens").alias("spawn_output"))


def totals(c: Corpus, by: str = "day", tz: str = "UTC", subagents: bool = False, **scope) -> DataFrame:
    """Totals over every row, not the page: rounded rows summed, sessions recounted."""
    rows = usage(c, by, tz, subagents, **scope)
    sums = [F.sum(n).alias(n) for n in ("requests", *SUMS)]
    usd = lambda n: pricing.round2(pricing.poisoned_sum(F.col(n))).alias(n)
    out = [*sums, usd("list_usd")]
    if subagents:
        out += [F.sum("spawn_requests").alias("spawn_requests"), usd("spawn_usd")]
    folded = rows.agg(*out)
    if subagents:
        folded = folded.withColumn("all_in_usd", pricing.round2(F.col("list_usd") + F.col("spawn_usd")))
    distinct = main_requests(c, "model", tz=tz, **scope).agg(F.count_distinct("session_id").alias("sessions"))
    return folded.withColumn("sessions", distinct.scalar())


def unpriced(c: Corpus, subagents: bool = False, **scope) -> DataFrame:
    """Model ids with no rate, sorted."""
    main = cells(main_requests(c, "model", **scope), "model", c.rates).filter(F.col("list_usd").isNull())
    names = main.select(F.coalesce("model", F.lit("?")).alias("model"))
    if subagents:
        sub = _billed(cells(sub_requests(c, "model", **scope), "model", c.rates)).filter(F.col("sub_usd").isNull())
        names = names.union(sub.select(F.coalesce("model", F.lit("?"))))
    return names.distinct().orderBy("model")


def class_split(c: Corpus, by: str, tz: str = "UTC", subagents: bool = False, **scope) -> DataFrame:
    """Dollars of a row by token class (priced cells only), both sides when asked."""
    rows = cells(main_requests(c, by, tz=tz, **scope), by, c.rates, tz)
    if subagents:
        rows = rows.unionByName(cells(sub_requests(c, by, tz=tz, **scope), by, c.rates, tz))
    names = ["usd_input", "usd_cache_write", "usd_cache_read", "usd_output"]
    return rows.groupBy("key").agg(*[F.coalesce(F.sum(n), F.lit(0.0)).alias(n) for n in names])


def model_split(c: Corpus, by: str, tz: str = "UTC", subagents: bool = False, **scope) -> DataFrame:
    """One row per (key, model): requests and dollars of each side."""
    named = lambda df: df.withColumn("model", F.coalesce("model", F.lit("?")))
    main = named(cells(main_requests(c, by, tz=tz, **scope), by, c.rates, tz)).groupBy("key", "model").agg(
        F.sum("requests").alias("requests"), pricing.poisoned_sum(F.col("list_usd")).alias("list_usd"))
    if not subagents:
        return main
    sub = _billed(cells(sub_requests(c, by, tz=tz, **scope), by, c.rates, tz)).filter("billed OR list_usd IS NOT NULL")
    sub = named(sub).groupBy("key", "model").agg(
        F.sum("requests").alias("spawn_requests"), pricing.poisoned_sum(F.col("list_usd")).alias("spawn_usd"))
    both = main.withColumn("m", F.lit(True)).join(sub.withColumn("s", F.lit(True)), ["key", "model"], "full")
    return both.withColumns({
        "requests": F.coalesce("requests", F.lit(0)), "spawn_requests": F.coalesce("spawn_requests", F.lit(0)),
        "list_usd": F.when(F.col("m"), F.col("list_usd")).otherwise(0.0),
        "spawn_usd": F.when(F.col("s"), F.col("spawn_usd")).otherwise(0.0),
    }).withColumn("all_in_usd", F.col("list_usd") + F.col("spawn_usd")).drop("m", "s")


def models_of_rows(c: Corpus, by: str, tz: str = "UTC", **scope) -> DataFrame:
    """models[] of each row, most requests first (bounded by the model vocabulary)."""
    split = model_split(c, by, tz, **scope)
    return models.model_lists(split.select("key", "model", "requests"), ["key"])


def cost_by_family(c: Corpus, by: str = "day", tz: str = "UTC", subagents: bool = True, **scope) -> DataFrame:
    """Stacked series: one column of dollars per model family, in the fixed legend order."""
    split = model_split(c, by, tz, subagents, **scope)
    usd = F.coalesce("all_in_usd" if subagents else "list_usd", F.lit(0.0))
    rows = split.select("key", models.family(F.col("model")).alias("family"), usd.alias("usd"))
    return rows.groupBy("key").agg(*[
        F.coalesce(F.sum(F.when(F.col("family") == f, F.col("usd"))), F.lit(0.0)).alias(f) for f in fv.MODEL_FAMILIES]).orderBy("key")
