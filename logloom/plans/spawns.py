"""Sub-agent and workflow observatories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from logloom.functions import fixed_values as fv, models
from logloom.functions.pricing import round_half_up
from logloom.functions.timekeys import millis_between, week_key, window_filter
from logloom.operators.filters import in_wells
from logloom.schemas import Corpus


def matching(c: Corpus, well=None, exact=False, agent=None, since=None, workflow=None, session=None, tz="UTC") -> DataFrame:
    rows = in_wells(c.spawns, c.wells, "well_dir", well, exact)
    if agent:
        rows = rows.filter(F.col("agent_type") == agent)
    if since:
        rows = rows.filter(window_filter(F.col("first_ts"), since, None, tz))
    if workflow:
        rows = rows.filter(F.startswith("workflow_run_id", F.lit(workflow)))
    if session:
        rows = rows.filter(F.startswith("session_id", F.lit(session)))
    return rows


def ending(stop: Column, open_requests: Column) -> Column:
    """NULL for a clean ending, else why the totals are a floor."""
    ended = F.coalesce(stop.isin(fv.TERMINAL_STOPS), F.lit(False))
    return F.when(~ended, "in-flight").when(open_requests > 0, "floor")


def observatory(c: Corpus, limit: int | None = None, **where) -> DataFrame:
    """Spawns newest first, with duration, drift and the partial flag."""
    rows = matching(c, **where).withColumns({
        "duration_ms": millis_between(F.col("first_ts"), F.col("last_ts")),
        "drift": models.drift(F.col("requested_model"), F.col("model")),
        "partial_reason": ending(F.col("last_stop_reason"), F.col("open_requests"))}
    ).orderBy(F.col("first_ts").desc(), "agent_id")
    return rows.limit(limit) if limit else rows


def partial_counts(c: Corpus, **where) -> DataFrame:
    """Counted over every match, never over the page."""
    reason = ending(F.col("last_stop_reason"), F.col("open_requests"))
    n = lambda cond: F.coalesce(F.sum(cond.cast("bigint")), F.lit(0))
    return matching(c, **where).withColumn("why", reason).agg(
        F.count("*").alias("spawns"), n(F.col("why").isNotNull()).alias("partial"),
        n(F.coalesce(F.col("why") == "floor", F.lit(False))).alias("floors"),
        n(F.coalesce(F.col("why") == "in-flight", F.lit(False))).alias("in_flight"))


def _reuse(cached: Column, boot: Column) -> Column:
    return round_half_up(100.0 * cached / F.nullif(boot, F.lit(0)))


def _rollup(rows: DataFrame, *keys) -> DataFrame:
    # the model list is folded from a per-(key, model) aggregate, so it stays as small as the vocabulary
    return rows.groupBy(*keys).agg(
        F.count("*").alias("n"), F.floor(F.avg("boot_tokens")).cast("bigint").alias("avg_boot"),
        _reuse(F.sum("boot_cached"), F.sum("boot_tokens")).alias("boot_reuse_pct"))


def distinct_models(rows: DataFrame, key: str) -> DataFrame:
    named = rows.filter(F.col("model").isNotNull()).select(key, "model").distinct()
    return named.groupBy(key).agg(F.array_join(F.array_sort(F.collect_list("model")), ",").alias("models"))


def by_agent_type(c: Corpus, **where) -> DataFrame:
    rows = matching(c, **where)
    names = distinct_models(rows, "agent_type").withColumnRenamed("agent_type", "t")
    out = _rollup(rows, "agent_type").join(names, F.col("agent_type").eqNullSafe(F.col("t")), "left").drop("t")
    return out.withColumn("models", F.coalesce("models", F.lit(""))).orderBy(F.col("n").desc(), "agent_type")


def by_week(c: Corpus, tz: str = "UTC", **where) -> DataFrame:
    rows = matching(c, tz=tz, **where).filter(F.col("first_ts").isNotNull())
    return _rollup(rows, week_key(F.col("first_ts"), tz).alias("week"), "agent_type").orderBy("week", F.col("n").desc(), "agent_type")


def fan_out(c: Corpus, session: str | None = None) -> DataFrame:
    """Spawns of each session by type, served and requested model."""
    return matching(c, session=session).groupBy("session_id", "agent_type", "model", "requested_model").agg(
        F.count("*").alias("n"), F.sum("output_tokens").alias("output_tokens"))


def session_miss(c: Corpus, asked: str, shown: int) -> tuple[DataFrame, DataFrame]:
    """What an empty session prefix did match (the `shown` longest), and which job-mates hold spawns."""
    job = F.coalesce("job_session_id", "session_id")
    hit = c.sessions.filter(F.startswith("session_id", F.lit(asked)))
    matched = hit.orderBy(F.col("lines").desc(), "session_id").limit(shown).select("session_id", "lines")
    mates = c.sessions.withColumn("job", job).join(hit.select(job.alias("job")).distinct(), "job", "left_semi")
    held = c.spawns.groupBy("session_id").agg(F.count("*").alias("spawns"))
    siblings = (mates.join(held, "session_id").join(matched.select("session_id"), "session_id", "left_anti")
                .select("session_id", "job", "spawns", "lines").orderBy(F.col("spawns").desc(), F.col("lines").desc(), "session_id"))
    return matched, siblings


# --- workflows ---------------------------------------------------------------

def _runs(c: Corpus, well=None, exact=False, name=None, since=None, tz="UTC") -> DataFrame:
    runs = in_wells(c.workflow_runs, c.wells, "well_dir", well, exact)
    if name:
        runs = runs.filter(F.col("name").ilike(f"%{name}%"))
    if since:
        runs = runs.filter(window_filter(F.col("recorded_ts"), since, None, tz))
    return runs


def _per_run(spawns: DataFrame) -> DataFrame:
    drift = F.coalesce(models.drift(F.col("requested_model"), F.col("model")), F.lit(False))
    return spawns.filter(F.col("workflow_run_id").isNotNull()).groupBy(F.col("workflow_run_id").alias("run_id")).agg(
        F.count("*").alias("agents"), F.sum("output_tokens").alias("output_tokens"),
        F.sum("boot_tokens").alias("boot_tokens"), F.sum("boot_cached").alias("boot_cached"),
        F.sum(drift.cast("bigint")).alias("drift"), F.min("first_ts").alias("started"), F.max("last_ts").alias("ended"))


def workflow_runs(c: Corpus, limit: int | None = None, **where) -> DataFrame:
    runs = _runs(c, **where)
    names = distinct_models(c.spawns.filter(F.col("workflow_run_id").isNotNull()), "workflow_run_id").withColumnRenamed("workflow_run_id", "run_id")
    out = (runs.join(_per_run(c.spawns), "run_id", "left").join(names, "run_id", "left").select(
        "run_id", F.col("well_dir").alias("well"), "session_id", "name",
        F.coalesce("agents", F.lit(0)).alias("agents"), "output_tokens", "boot_tokens",
        _reuse(F.col("boot_cached"), F.col("boot_tokens")).alias("boot_reuse_pct"), "models",
        F.coalesce("drift", F.lit(0)).alias("drift"), F.coalesce("started", "recorded_ts").alias("first_ts"),
        millis_between(F.col("started"), F.col("ended")).alias("duration_ms")).orderBy(F.col("first_ts").desc(), "run_id"))
    return out.limit(limit) if limit else out


def workflows_by_name(c: Corpus, **where) -> DataFrame:
    """Averages of per-run values, per workflow name."""
    per = _runs(c, **where).join(_per_run(c.spawns), "run_id", "left")
    return per.groupBy("name").agg(
        F.count("*").alias("n"), F.floor(F.avg(F.coalesce("agents", F.lit(0)))).cast("bigint").alias("avg_agents"),
        F.floor(F.avg("output_tokens")).cast("bigint").alias("avg_output_tokens"),
        _reuse(F.sum("boot_cached"), F.sum("boot_tokens")).alias("boot_reuse_pct")).orderBy(F.col("n").desc(), "name")


def phase_labels(phases: Column) -> Column:
    """'title — detail' per declared phase."""
    return F.transform(phases, lambda p: F.when(p["detail"].isNotNull(), F.concat(p["title"], F.lit(" — "), p["detail"])).otherwise(p["title"]))
