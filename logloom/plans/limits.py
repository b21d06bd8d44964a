"""Rate-limit windows: newest reading, resets, usage inside the window, exchange rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from logloom.functions import fixed_values as fv, pricing
from logloom.functions.timekeys import utc_day, window_filter
from logloom.operators.ordered import scan, top_one
from logloom.operators.sizes import small_side
from logloom.operators.stages import staged
from logloom.schemas import Corpus

HOUR = 3600


def canonical(kind: Column) -> Column:
    out = kind
    for said, name in fv.KIND_ALIAS.items():
        out = F.when(kind == said, name).otherwise(out)
    return out


def window_seconds(kind: Column) -> Column:
    return F.when(kind == "five_hour", 5 * HOUR).when((kind == "seven_day") | F.startswith(kind, F.lit("seven_day_")), 7 * 24 * HOUR)


def scope_model(kind: Column) -> Column:
    """The model a scoped week counts, as the substring its model ids carry."""
    scoped = F.startswith(kind, F.lit("seven_day_")) & ~kind.isin(fv.SURFACE_KINDS)
    return F.when(scoped, F.substring(kind, F.lit(11), F.length(kind)))


def resets(readings: DataFrame, keys: list[str]) -> DataFrame:
    """Last drop of at least five points between neighbouring readings of one window."""
    rows = readings.withColumn("at_us", F.unix_micros("ts"))
    hour = F.floor(F.col("at_us") / 3_600_000_000).cast("bigint")
    rows = scan(rows, keys, ["at_us", "seq"], hour, lag={"was": F.col("pct"), "was_at": F.col("ts")})
    drops = rows.filter(F.col("was") - F.col("pct") >= fv.RESET_DROP)
    return drops.groupBy(*keys).agg(F.max_by(F.struct("ts", "pct", "was", "was_at"), F.struct("at_us", "seq")).alias("r")).select(
        *keys, F.col("r.ts").alias("reset_at"), F.col("r.pct").alias("reset_pct"), "r.was", "r.was_at")


def latest_readings(readings: DataFrame, now: Column) -> DataFrame:
    """Per kind the newest reading that names an open boundary, else the newest one."""
    open_ = F.coalesce(F.col("resets_at").isNotNull() & F.col("length").isNotNull() & (F.col("resets_at") > now), F.lit(False))
    best = F.struct(open_.cast("int").alias("o"), F.unix_micros("ts").alias("t"), "seq")
    return top_one(readings, ["kind"], best, ["pct", "ts", "session_id", "source", "resets_at", "length"], largest=True)


def _hour(at: Column) -> Column:
    return F.floor(F.unix_seconds(at) / HOUR).cast("bigint")


def _usage_in(c: Corpus, spans: DataFrame) -> DataFrame:
    """All-in ledger of [from_ts, until_ts) spans (kind, span, from_ts, until_ts, scope).

    Requests are summed once, by model and by hour, an hour being cut where a span begins or ends;
    a span is then the sum of the whole pieces it covers. So requests meet only the cuts (two a
    span) on their way into the sums, and never the spans.
    """
    spans = spans.filter("from_ts < until_ts")
    cuts = spans.select(F.explode(F.array("from_ts", "until_ts")).alias("at")).groupBy(_hour(F.col("at")).alias("hour")).agg(
        F.collect_set("at").alias("cuts"))
    n_cuts = lambda cond: F.coalesce(F.size(F.filter("cuts", cond)), F.lit(0))
    cols = ["ts", "model", *pricing_tokens()]
    main = c.requests.select(*cols, F.lit(True).alias("main"))
    reqs = main.unionByName(c.spawn_requests.select(*cols, F.lit(False).alias("main"))) if c.spawn_requests is not None else main
    reqs = reqs.filter((F.col("ts") >= spans.agg(F.min("from_ts")).scalar()) & (F.col("ts") < spans.agg(F.max("until_ts")).scalar()))
    pieces = (reqs.withColumn("hour", _hour(F.col("ts"))).join(small_side(cuts), "hour", "left")
              .groupBy("hour", n_cuts(lambda at: at <= F.col("ts")).alias("piece"), "main", "model")
              .agg(F.count("*").alias("requests"), *[F.sum(t).alias(t) for t in pricing_tokens()]))
    # a piece is inside when it begins at or after from_ts and ends by until_ts
    covered = (spans.withColumn("hour", F.explode(F.sequence(_hour(F.col("from_ts")), _hour(F.col("until_ts")))))
               .join(small_side(cuts), "hour", "left")
               .select("kind", "span", "scope", "hour", n_cuts(lambda at: at <= F.col("from_ts")).alias("lo"), n_cuts(lambda at: at < F.col("until_ts")).alias("hi")))
    hit = pieces.join(covered, "hour").filter(F.col("piece").between(F.col("lo"), F.col("hi"))).filter(
        F.col("scope").isNull() | F.contains(F.lower("model"), F.col("scope")))
    cell = hit.groupBy("kind", "span", "main", "model", utc_day(F.timestamp_seconds(F.col("hour") * HOUR)).alias("rate_day")).agg(
        *[F.sum(t).alias(t) for t in ["requests", *pricing_tokens()]])
    priced = pricing.priced(cell, c.rates)
    side = lambda flag, x: F.sum(F.when(F.col("main") == flag, F.col(x)))
    whole = lambda flag: F.when(F.count(F.when(F.col("main") == flag, F.lit(1))) == F.count(F.when((F.col("main") == flag), F.col("list_usd"))),
                                F.coalesce(side(flag, "list_usd"), F.lit(0.0))).otherwise(0.0)
    rows = priced.groupBy("kind", "span").agg(
        F.sum("requests").alias("requests"), F.sum("cache_read_tokens").alias("cache_read"), F.sum("output_tokens").alias("output"),
        F.coalesce(side(True, "requests"), F.lit(0)).alias("main_requests"),
        pricing.round2(whole(True)).alias("main_usd"), pricing.round2(whole(False)).alias("sub_usd"))
    return rows.withColumn("list_usd", pricing.round2(F.col("main_usd") + F.col("sub_usd"))).drop("sub_usd")


def pricing_tokens() -> list[str]:
    return ["input_tokens", "cache_write_tokens", "cache_write_1h_tokens", "cache_read_tokens", "output_tokens"]


def prepared(limits: DataFrame, kind: str | None = None) -> DataFrame:
    rows = limits.withColumnRenamed("kind", "said").withColumn("kind", canonical(F.col("said"))).withColumn("length", window_seconds(F.col("kind")))
    if "seq" not in rows.columns:
        rows = rows.withColumn("seq", F.xxhash64("source", "session_id", "said"))
    if kind:
        rows = rows.filter(F.col("kind") == canonical(F.lit(kind)))
    return rows


def limit_windows(c: Corpus, now: str, kind: str | None = None) -> DataFrame:
    """One row per kind: its window, reset, usage up to the reading, implied whole and dollars per point.

    `ended` marks a window whose last boundary has passed: nothing is priced there.
    """
    at = F.to_timestamp(F.lit(now))
    readings = prepared(c.limits, kind)
    latest = latest_readings(readings, at)
    seconds = lambda n: F.timestamp_seconds(F.unix_seconds("resets_at") - n)
    until = F.when(F.col("length").isNotNull(), F.col("resets_at"))
    ended = F.coalesce(until <= at, F.lit(False))
    windows = staged(latest.withColumns({
        "until": until, "from": F.when(~ended & until.isNotNull(), seconds(F.col("length"))), "ended": ended,
        "model": scope_model(F.col("kind")), "counted": ~F.col("kind").isin(fv.SURFACE_KINDS)}), "limit-windows")
    bounds = windows.filter("from IS NOT NULL").select("kind", F.col("from").alias("w_from"), F.col("until").alias("w_until"))
    near = F.abs(F.unix_millis("resets_at") - F.unix_millis("w_until")) < 60_000
    inside = readings.join(bounds, "kind").filter((F.col("ts") >= F.col("w_from")) & (F.col("ts") < F.col("w_until")) & near)
    inside = staged(inside.select("kind", "ts", "seq", "pct", "source"), "limit-readings")
    out = windows.join(resets(inside, ["kind"]), "kind", "left").withColumn("ledger_from", F.coalesce("reset_at", "from"))
    mod = inside.filter("source = 'mod'").join(out.select("kind", "ledger_from"), "kind").filter(F.col("ts") >= F.col("ledger_from"))
    order = F.struct("ts", "seq")
    edge = mod.groupBy("kind").agg(F.min_by(F.struct("ts", "pct"), order).alias("a"), F.max_by(F.struct("ts", "pct"), order).alias("z"))
    edge = edge.withColumn("gained", F.col("z.pct") - F.col("a.pct")).filter(F.col("gained") >= fv.MIN_POINTS)
    out = staged(out, "limit-windows")
    spans = out.filter("counted AND ledger_from IS NOT NULL").select(
        "kind", F.lit("window").alias("span"), F.col("ledger_from").alias("from_ts"), F.col("ts").alias("until_ts"), F.col("model").alias("scope"))
    rate = edge.join(out.filter("counted").select("kind", F.col("model").alias("scope")), "kind").select(
        "kind", F.lit("mod").alias("span"), F.col("a.ts").alias("from_ts"), F.col("z.ts").alias("until_ts"), "scope")
    used = staged(_usage_in(c, staged(spans.unionByName(rate), "limit-spans")), "limit-usage")
    measures = ["requests", "cache_read", "output", "list_usd", "main_requests", "main_usd"]
    window = used.filter("span = 'window'").drop("span")
    whole = spans.filter("from_ts < until_ts").select("kind").withColumn("spanned", F.lit(True))
    per_point = used.filter("span = 'mod'").join(edge.select("kind", "gained"), "kind").select(
        "kind", pricing.round2(F.col("list_usd") / F.col("gained")).alias("usd_per_point"),
        pricing.round2(F.col("main_usd") / F.col("gained")).alias("main_usd_per_point"))
    points = F.col("pct") - F.coalesce("reset_pct", F.lit(0.0))
    out = out.join(whole, "kind", "left").join(window, "kind", "left").join(per_point, "kind", "left")
    out = out.withColumns({m: F.when(F.col("spanned"), F.coalesce(m, F.lit(0))) for m in measures})
    factor = F.when(points >= fv.MIN_POINTS, 100.0 / points)
    scaled = {f"implied_{m}": (pricing.round2 if m.endswith("usd") else pricing.round_half_up)(F.col(m) * factor) for m in measures}
    return out.withColumns(scaled).drop("spanned", "counted").orderBy(F.col("length").desc_nulls_last(), "kind")


def hits(c: Corpus, since: str | None = None, tz: str = "UTC", limit: int | None = None) -> DataFrame:
    """Refusals newest first, with the harness's own word for the window."""
    rows = prepared(c.limits).filter("source = 'transcript'").filter(window_filter(F.col("ts"), since, None, tz)).orderBy(F.col("ts").desc(), "seq")
    return rows.limit(limit) if limit else rows


def history(c: Corpus, since: str | None = None, tz: str = "UTC", limit: int | None = None) -> DataFrame:
    rows = prepared(c.limits).filter("source = 'mod'").filter(window_filter(F.col("ts"), since, None, tz)).orderBy(F.col("ts").desc(), "seq")
    return rows.limit(limit) if limit else rows
