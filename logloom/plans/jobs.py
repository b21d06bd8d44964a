"""Jobs, lanes, loops, runs, rosters and the fleet tree."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F

from logloom.functions import envelope as env, fixed_values as fv, models, pricing
from logloom.functions.timekeys import window_filter
from logloom.operators import identity as idn
from logloom.operators.ordered import CHUNK_ROWS, scan, top_one
from logloom.operators.stages import staged
from logloom.plans import sessions as ses, usage as us
from logloom.schemas import Corpus

MONEY = ["list_usd", "spawn_usd", "all_in_usd"]


def keyed_sessions(c: Corpus) -> DataFrame:
    return staged(idn.job_keys(c.sessions, c.jobs), "job-keys")


def _fees(c: Corpus, keyed: DataFrame, **scope) -> DataFrame:
    """Per job: requests, output and dollars over its sessions; a side is priced when any session is."""
    # without the spawn table no spawn counts are joined on: none are shown
    per = us.usage(c.with_tables(spawns=None), "session", subagents=True, **scope).withColumnRenamed("key", "session_id").select(
        "session_id", "requests", "output_tokens", "list_usd", "spawn_usd")
    rows = per.join(keyed.select("session_id", "key"), "session_id")
    out = rows.groupBy("key").agg(
        F.sum("requests").alias("requests"), F.sum("output_tokens").alias("output_tokens"),
        pricing.round2(F.sum("list_usd")).alias("list_usd"), pricing.round2(F.sum("spawn_usd")).alias("spawn_usd"))
    return out.withColumn("all_in_usd", pricing.round2(F.col("list_usd") + F.col("spawn_usd")))


def job_models(c: Corpus, keyed: DataFrame) -> DataFrame:
    tallied = models.tally(c.requests.join(keyed.select("session_id", "key"), "session_id"), ["key"])
    return models.model_lists(tallied, ["key"])


def peers_of(c: Corpus, keyed: DataFrame, messages: DataFrame | None = None) -> DataFrame:
    """Peers loudest first, ranked without collecting a job's messages."""
    return idn.peer_credit(c.messages if messages is None else messages, keyed, c.jobs)


def job_list(c: Corpus, all_kinds: bool = False, since: str | None = None, tz: str = "UTC", limit: int | None = None,
             keyed: DataFrame | None = None) -> DataFrame:
    """Jobs newest activity first. The background filter is on the group, after it is formed."""
    keyed = keyed_sessions(c) if keyed is None else keyed
    rows = keyed.join(c.wells.select(F.col("dir").alias("well"), "real_path"), "well", "left")
    last = F.expr(idn.ACTIVE)
    groups = rows.groupBy("key", "kind").agg(
        F.count("*").alias("sessions"), F.count_distinct(F.coalesce("job_session_id", "session_id")).alias("incarnations"),
        F.min("first_ts").alias("first"), F.max(last).alias("last"), F.sum("lines").alias("lines"),
        F.count_distinct("well").alias("wells"), F.min(F.coalesce("real_path", "well")).alias("path"),
        F.max_by("session_id", F.struct(last, "first_ts", "session_id")).alias("latest_session"))
    if not all_kinds:
        groups = groups.filter("kind <> 'session'")
    if since:
        groups = groups.filter(window_filter(F.col("last"), since, None, tz))
    groups = groups.orderBy(F.col("last").desc(), F.col("first").desc(), "key")
    if limit:
        groups = groups.limit(limit)
    named = idn.named_jobs(keyed, c.jobs).select("key", "job_id", "name", "cwd", "state", "source")
    out = groups.join(named, "key", "left").join(_fees(c, keyed), "key", "left").join(job_models(c, keyed), "key", "left")
    state_row = F.col("source") == "state"
    out = out.withColumns({
        "name_source": F.when(F.col("source").isNotNull(), F.when(F.col("source") == "peer", "peer").otherwise("state")),
        "job_id": F.when(state_row, F.col("job_id")), "repo": env.repo_of(F.coalesce("cwd", "path")),
        "requests": F.coalesce("requests", F.lit(0)), "output_tokens": F.coalesce("output_tokens", F.lit(0))})
    if c.spawn_ledger is not None:
        parents = idn.spawn_edges(keyed, c.jobs, c.spawn_ledger, c.messages).select(F.col("child_key").alias("key"), "parent_key")
        out = out.join(parents, "key", "left")
    return out


def lanes(c: Corpus, keyed: DataFrame | None = None) -> DataFrame:
    """Jobs each session spawned, priced, with the instant of the spawn."""
    keyed = keyed_sessions(c) if keyed is None else keyed
    edges = idn.spawn_edges(keyed, c.jobs, c.spawn_ledger, c.messages)
    fees = _fees(c, keyed)
    named = idn.named_jobs(keyed, c.jobs).select("key", "name", "state", "first", "last")
    return (edges.withColumnRenamed("child_key", "key").withColumnRenamed("ts", "spawned_at")
            .join(named, "key", "left").join(fees, "key", "left")
            .select("session_id", "key", "parent_key", "name", "state", "spawned_at", "first", "last", "requests", "output_tokens", *MONEY))


def lane_totals(lane_rows: DataFrame) -> DataFrame:
    """Per spawning session: lanes and their price, NULL when one is unpriced."""
    return lane_rows.groupBy("session_id").agg(F.count("*").alias("lanes"), pricing.round2(pricing.poisoned_sum(F.col("list_usd"))).alias("lane_usd"))


def loop_report(c: Corpus, job_key: str, since: str | None = None, until: str | None = None, deep: int = 300_000,
                roster: DataFrame | None = None, tz: str = "UTC", keyed: DataFrame | None = None) -> DataFrame:
    """The lanes of one job inside a window: live first, then newest spawn; never its own parent."""
    keyed = keyed_sessions(c) if keyed is None else keyed
    edges = idn.spawn_edges(keyed, c.jobs, c.spawn_ledger, c.messages)
    parent = edges.filter(F.col("child_key") == job_key).select(F.col("parent_key").alias("child_key"))
    mine = edges.filter(F.col("parent_key") == job_key).join(parent, "child_key", "left_anti").select(
        F.col("child_key").alias("key"), F.col("ts").alias("spawned_at"))
    held = keyed.join(mine.select("key"), "key", "left_semi")
    scope = dict(since=since, until=until, tz=tz)
    fees = _fees(c, held, **scope)
    reqs = c.requests.filter(window_filter(F.col("ts"), since, until, tz)).join(held.select("session_id", "key"), "session_id")
    peak = reqs.groupBy("key").agg(F.max(F.col("input_tokens") + F.col("cache_read_tokens") + F.col("cache_write_tokens")).alias("peak"))
    mix = models.model_lists(models.tally(reqs, ["key"]), ["key"]).select("key", F.col("dominant_model").alias("model"))
    named = idn.named_jobs(keyed, c.jobs).select("key", "name", "state", "first", "last")
    live = F.coalesce(F.col("state").isin(fv.LIVE_STATES), F.lit(False)) if roster is not None else F.lit(False)
    out = mine.join(named, "key", "left")
    if roster is not None:
        now = roster.select("key", F.col("state").alias("live_state"), "ctx").dropDuplicates(["key"])
        out = out.join(now, "key", "left").withColumn("state", F.coalesce("live_state", "state")).drop("live_state")
    else:
        out = out.withColumn("ctx", F.lit(None).cast("bigint"))
    out = out.join(fees, "key", "left").join(peak, "key", "left").join(mix, "key", "left").withColumn("live", live)
    spawned = F.coalesce("spawned_at", "first")
    inside = window_filter(spawned, since, None, tz) & (F.lit(True) if not until else spawned <= F.to_timestamp(F.lit(until)))
    keep = inside if until else (F.col("live") | inside)
    is_deep = F.when(F.col("live") & F.col("ctx").isNotNull(), F.col("ctx") >= deep).otherwise(F.coalesce(F.col("peak") >= deep, F.lit(False)))
    zero = {n: F.when(F.col("requests").isNull(), 0.0).otherwise(F.col(n)) for n in MONEY}
    return (out.filter(keep).withColumns({"spawned_at": spawned, "deep": is_deep, **zero}).withColumn("requests", F.coalesce("requests", F.lit(0)))
            .orderBy(F.col("live").desc(), F.col("spawned_at").desc(), "key"))


def spend(job_fee: DataFrame, lane_rows: DataFrame) -> DataFrame:
    """What the job and its lanes cost together; NULL as soon as a part is unpriced."""
    own = job_fee.agg(*[F.first(n).alias("job_" + n) for n in MONEY])
    lanes_ = lane_rows.agg(*[pricing.round2(pricing.poisoned_sum(F.col(n))).alias("lane_" + n) for n in MONEY])
    both = lanes_.withColumns({"job_" + n: own.select("job_" + n).scalar() for n in MONEY})
    total = F.col("job_list_usd") + F.col("job_spawn_usd") + F.col("lane_list_usd") + F.col("lane_spawn_usd")
    return both.withColumn("total_usd", pricing.round2(total))


def last_spoke(c: Corpus, keyed: DataFrame) -> DataFrame:
    """Per job: last prompt, last text, last message sent."""
    m = c.messages.join(keyed.select("session_id", "key"), "session_id")
    at = lambda cond: F.max(F.when(F.expr(cond), F.col("ts")))
    return m.groupBy("key").agg(
        at("lane = 'prompt' AND type = 'user'").alias("last_prompt"), at("lane = 'text'").alias("last_text"),
        at("lane = 'tool' AND type = 'assistant' AND tool_name = 'SendMessage'").alias("last_sent"))


def overlapping(keyed: DataFrame, since: Column, until: Column, reach_minutes: int = 0) -> DataFrame:
    """Sessions at work inside a window, widened backwards by `reach_minutes`."""
    start = since - F.make_dt_interval(mins=F.lit(reach_minutes))
    return keyed.filter((F.col("first_ts") <= until) & (F.expr(idn.ACTIVE) >= start))


def run_report(c: Corpus, now: str, since: str | None = None, until: str | None = None, reach_minutes: int = 30,
               keyed: DataFrame | None = None) -> DataFrame:
    """Every spawned job's run: its sessions in the window and its parent's, with a longer reach.

    Without a window the last 24 hours before `now` are read.
    """
    keyed = keyed_sessions(c) if keyed is None else keyed
    end = F.to_timestamp(F.lit(until or now))
    start = F.to_timestamp(F.lit(since)) if since else end - F.expr("interval 24 hours")
    edges = idn.spawn_edges(keyed, c.jobs, c.spawn_ledger, c.messages).select(F.col("child_key").alias("job"), "parent_key")
    own = overlapping(keyed, start, end).groupBy(F.col("key").alias("job")).agg(F.count("*").alias("job_sessions"))
    above = overlapping(keyed, start, end, reach_minutes).groupBy(F.col("key").alias("parent_key")).agg(F.count("*").alias("parent_sessions"))
    return edges.join(own, "job").join(above, "parent_key", "left").withColumn("parent_sessions", F.coalesce("parent_sessions", F.lit(0)))


def lane_messages(c: Corpus, keyed: DataFrame, job_key: str) -> DataFrame:
    """Instants at which each named peer wrote to the job."""
    mine = keyed.filter(F.col("key") == job_key).select("session_id")
    return c.messages.filter("lane = 'relay' AND peer IS NOT NULL").join(mine, "session_id", "left_semi").select("peer", "ts").orderBy("peer", "ts")


def respawns(keyed: DataFrame) -> DataFrame:
    """Sessions of a job where a new root began: root differs from the last known one."""
    rows = keyed.withColumn("at_us", F.unix_micros("first_ts"))
    out = scan(rows, ["key"], ["at_us", "session_id"], F.floor(F.col("at_us") / 86_400_000_000).cast("bigint"),
               carry_before={"prev_root": F.col("job_session_id")})
    mark = F.col("job_session_id").isNotNull() & F.col("prev_root").isNotNull() & (F.col("job_session_id") != F.col("prev_root"))
    return out.withColumn("respawn", mark).drop("at_us")


def recent_by_job(c: Corpus, n: int = 100, keyed: DataFrame | None = None) -> DataFrame:
    """Sessions folded into jobs, newest session at the head, empty ones dropped; the n last active jobs."""
    keyed = keyed_sessions(c) if keyed is None else keyed
    newest = keyed.withColumn("last_at", F.expr(idn.ACTIVE))
    prompts = ses.prompt_counts(c.messages)
    fee = us.usage(c, "session", subagents=True).withColumnRenamed("key", "session_id").select("session_id", "requests", "output_tokens", *MONEY)
    rows = newest.join(prompts, "session_id", "left").join(fee, "session_id", "left").withColumn("prompts", F.coalesce("prompts", F.lit(0)))
    rows = rows.filter("prompts > 0 OR requests IS NOT NULL")
    return rows.groupBy("key", "kind").agg(
        F.max_by("session_id", F.struct("last_at", "session_id")).alias("session_id"), F.max("last_at").alias("last_at"),
        F.count("*").alias("sessions"), F.sum("prompts").alias("prompts"),
        *[F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in ("requests", "output_tokens")],
        *[pricing.round2(F.coalesce(F.sum(x), F.lit(0.0))).alias(x) for x in MONEY]).orderBy(F.col("last_at").desc(), "key", "kind").limit(n)


# --- roster and fleet -------------------------------------------------------------------

def state_rank(state: Column) -> Column:
    rank = F.lit(5)
    for name, n in fv.STATE_RANK.items():
        rank = F.when(state == name, n).otherwise(rank)
    return rank


def latest_model_and_context(entries: DataFrame) -> DataFrame:
    """Per session, off its last non-synthetic assistant record: model and context size."""
    rows = entries.filter("type = 'assistant' AND model IS NOT NULL").filter(~F.startswith("model", F.lit("<")))
    ctx = F.col("input_tokens") + F.col("cache_read_tokens") + F.col("cache_write_tokens")
    return rows.groupBy("session_id").agg(F.max_by(F.struct("model", ctx.alias("ctx")), "line_no").alias("r")).select("session_id", "r.*")


def context_band(ctx: Column) -> Column:
    return F.when(ctx >= 800_000, "full").when(ctx >= 600_000, "high")


def roster(listed: DataFrame, jobs: DataFrame, usage_rows: DataFrame, tails: DataFrame) -> DataFrame:
    """Live listing joined to job state, index usage and the latest model; working first, then recency.

    The transcript's model overrides the index only for live rows.
    """
    st = jobs.select(F.col("job_id").alias("id"), *[F.col(c).alias("st_" + c) for c in ("session_id", "name", "state")])
    rows = listed.join(st, "id", "left").withColumns({
        "session_id": F.coalesce("session_id", "st_session_id"), "name": F.coalesce("name", "st_name"),
        "state": F.coalesce("state", "st_state", F.lit("unknown"))}).drop("st_session_id", "st_name", "st_state")
    rows = rows.join(usage_rows, "session_id", "left").join(tails.withColumnRenamed("model", "tail_model"), "session_id", "left")
    verified = F.col("state").isin(fv.LIVE_STATES) & F.col("tail_model").isNotNull()
    return rows.withColumns({
        "model": F.when(verified, F.col("tail_model")).otherwise(F.col("index_model")),
        "model_source": F.when(verified, "transcript").when(F.col("index_model").isNotNull(), "index"),
    }).drop("tail_model", "index_model").orderBy(state_rank(F.col("state")), F.coalesce("updated_at", "started_at").desc(), "id")


def merged_roster(job_rows: DataFrame, live: DataFrame) -> DataFrame:
    """Jobs and live rows as one listing: every job once, every live row once."""
    l = live.select(F.col("key").alias("live_key"), F.col("id").alias("live_id"), F.col("state").alias("live_state"), F.col("cwd").alias("live_cwd"))
    both = job_rows.join(l, F.col("key") == F.col("live_key"), "full")
    active = F.when(F.col("live_state") == "working", 0).when(F.col("live_state") == "blocked", 1).otherwise(2)
    return both.withColumns({"key": F.coalesce("key", "live_key"), "active": active}).drop("live_key").orderBy("active", F.col("last").desc_nulls_last(), "key")


def fleet_tree(rows: DataFrame, depth_cap: int = 3) -> DataFrame:
    """rows(key, parent_key, repo) -> top, depth (capped), repo of the chain's top.

    Parents outside the listing do not count. Of a cycle the least key is the
    top; the others, and what hangs on them, nest under it.
    """
    _, walk = _forest(rows)
    home = rows.select(F.col("key").alias("top"), F.col("repo").alias("top_repo"))
    out = walk.select("key", F.coalesce("anc", "key").alias("top"), F.least(F.col("hops"), F.lit(depth_cap)).alias("depth"))
    return out.join(home, "top", "left")


def _forest(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, repo, up) with unlisted parents and one link of each cycle cut, and its _ancestors."""
    listed = rows.select(F.col("key").alias("parent_key"))
    base = rows.join(listed.distinct().withColumn("known", F.lit(True)), "parent_key", "left").select(
        "key", "repo", F.when(F.col("known") & (F.col("parent_key") != F.col("key")), F.col("parent_key")).alias("up"))
    base = staged(base, "fleet-up")
    walk = _ancestors(base)
    circling = walk.where("anc IS NOT NULL").join(base.filter("up IS NULL").select(F.col("key").alias("anc")), "anc", "left_anti")
    if not circling.isEmpty():
        # after as many hops as there are keys, whoever still moves stands on a cycle
        first = _least_on_cycle(base.join(circling.select(F.col("anc").alias("key")).distinct(), "key", "left_semi"))
        cut = first.filter("key = least").select("key", F.lit(True).alias("cut"))
        base = staged(base.join(cut, "key", "left").select("key", "repo", F.when(F.col("cut").isNull(), F.col("up")).alias("up")), "fleet-cut")
        # no other chain holds a cut link
        again = staged(circling.select("key").distinct(), "fleet-circling")
        walk = walk.join(again, "key", "left_anti").unionByName(_ancestors(base.join(again, "key", "left_semi")))
    return base, walk


def fleet_listing(rows: DataFrame, depth_cap: int = 3) -> DataFrame:
    """rows(key, parent_key, repo, rank, live) -> the fleet as it is printed: position, kind, repo, key, depth, n, live.

    Repositories come in the order in which their first job is listed, each as a `group` row with its
    number of jobs and of live ones; below it every job (`row`), jobs that none of the listing spawned by
    rank, and after each job those it spawned. A job goes where the top of its chain is. Keys are
    unique; equal ranks are ordered by key. Cycles are cut as in fleet_tree.

    A job's place is the sum, over it and those above it, of the entries between each and the one above: one
    and the sizes of the siblings listed before. Sizes, and the sums, are climbed by pointer doubling: log2 of the
    longest chain's length joins, of the jobs still under way only, whatever the size of a group.
    """
    base, walk = _forest(rows)
    home = rows.select(F.col("key").alias("anc"), F.coalesce("repo", F.lit("elsewhere")).alias("home"))
    placed = walk.select("key", F.coalesce("anc", "key").alias("anc"), "hops", "under").join(home, "anc").select("key", "home", "hops", "under")
    jobs = staged(base.select("key", "up").join(placed, "key").join(rows.select("key", F.col("rank").cast("bigint").alias("rank"), F.coalesce("live", F.lit(False)).alias("live")), "key"), "fleet-jobs")
    groups = staged(jobs.groupBy("home").agg(F.min("rank").alias("rank"), F.count("*").alias("n"), F.count_if("live").alias("n_live")), "fleet-groups")
    heads = _listed_after(groups.select("home", "rank", "n", "n_live", (F.col("n") + 1).alias("under"), F.lit("").alias("above")), "home").withColumnRenamed("after", "position")
    above = F.coalesce(F.concat(F.lit("r:"), "up"), F.concat(F.lit("g:"), "home"))
    sums = _ancestors(_listed_after(jobs.select("key", "up", "rank", "under", above.alias("above")), "key").select("key", "up", F.col("after").alias("weight"))).select("key", "total")
    body = jobs.join(sums, "key").join(heads.select("home", F.col("position").alias("head")), "home")
    return heads.select(F.lit("group").alias("kind"), F.col("home").alias("repo"), F.lit(None).cast("string").alias("key"), F.lit(None).cast("bigint").alias("depth"),
                        "n", F.col("n_live").alias("live"), "position").unionByName(
        body.select(F.lit("row").alias("kind"), F.col("home").alias("repo"), "key", F.least("hops", F.lit(depth_cap)).cast("bigint").alias("depth"),
                    F.lit(None).cast("bigint").alias("n"), F.col("live").cast("bigint").alias("live"), (F.col("head") + F.col("total")).alias("position")))


def _listed_after(nodes: DataFrame, name: str) -> DataFrame:
    """nodes(name, above, rank, under) with `after`: how many entries a node comes after the one above it. Siblings go by rank, then name."""
    # in chunks: a parent may have any number of children
    chunk = F.coalesce(F.floor(F.col("rank") / CHUNK_ROWS).cast("bigint"), F.lit(-(1 << 62)))
    rows = scan(nodes, ["above"], ["rank", name], chunk, running={"upto": F.col("under")})
    return rows.withColumn("after", F.col("upto") - F.col("under") + 1).drop("upto")


def _ancestors(base: DataFrame) -> DataFrame:
    """base(key, up, and a weight if sums are wanted) -> key, anc: the furthest ancestor; hops to it; under: how
    many keys hang on a key, itself counted; total: the weights of the key and its ancestors.

    Pointer doubling: a chain of n keys takes log2 n joins. A key takes part while it has an ancestor as
    far as the round reaches, or is one; the rounds end when none has, or all keys are passed (cycles).
    """
    weight = F.col("weight") if "weight" in base.columns else F.lit(0).cast("bigint")
    live = staged(base.select("key", "up", F.lit(None).cast("string").alias("anc"), F.col("up").isNotNull().cast("bigint").alias("hops"),
                              F.lit(1).cast("bigint").alias("under"), weight.alias("total"), F.lit(True).alias("on")), "fleet-walk")
    columns, done, reach, keys = ["key", "anc", "hops", "under", "total"], [], 1, live.count()
    while reach <= keys and not live.where("up IS NOT NULL").isEmpty():
        # `up` is as far as the round reaches, and `hops`, `under` and `total` are of the keys nearer than that
        below = live.where("up IS NOT NULL").groupBy(F.col("up").alias("key")).agg(F.sum("under").alias("more"))
        both = live.join(below, "key", "left").withColumns({"on": F.col("more").isNotNull(), "under": F.col("under") + F.coalesce("more", F.lit(0))})
        step = both.where("on").select(F.col("key").alias("up"), F.col("up").alias("next"), F.coalesce("anc", "key").alias("top"), F.col("hops").alias("further"), F.col("total").alias("rest"))
        moved = both.where("up IS NOT NULL").join(step, "up").select(
            "key", F.col("next").alias("up"), F.when(F.col("next").isNull(), F.col("top")).alias("anc"), (F.col("hops") + F.col("further")).alias("hops"),
            "under", (F.col("total") + F.col("rest")).alias("total"), (F.col("on") | F.col("next").isNotNull()).alias("on"))
        walk = staged(moved.unionByName(both.where("up IS NULL").select(*moved.columns)), "fleet-walk")
        done.append(walk.where("NOT on").select(*columns))
        live, reach = walk.where("on"), reach * 2
    out = live.select("key", F.coalesce("anc", "up").alias("anc"), "hops", "under", "total")
    for part in done:
        out = out.unionByName(part)
    return out


def _least_on_cycle(ring: DataFrame) -> DataFrame:
    """(key, least) for keys that all lie on cycles: the least key of each one's cycle, by pointer doubling."""
    seen = ring.select("key", F.col("up").alias("far"), F.least("key", "up").alias("least"))
    reach, keys = 1, ring.count()
    while reach < keys:
        step = seen.select(F.col("key").alias("far"), F.col("far").alias("next"), F.col("least").alias("other"))
        seen = staged(seen.join(step, "far").select("key", F.col("next").alias("far"), F.least("least", "other").alias("least")), "fleet-ring")
        reach *= 2
    return seen.select("key", "least")
