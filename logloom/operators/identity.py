"""Which job a session belongs to, what it is called, who spawned whom, who wrote to whom."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from logloom.functions import fixed_values as fv
from logloom.functions.envelope import bridge_key
from logloom.operators import ranges
from logloom.operators.ordered import top_one
from logloom.schemas import uncut

ACTIVE = "coalesce(last_activity_ts, last_ts)"


def job_keys(sessions: DataFrame, jobs: DataFrame) -> DataFrame:
    """session_id -> key, kind. The bridge id, else the root, else the session itself.

    The bridge of a session is its own, else that of a job row matching its root
    by full id or by the root's first eight characters: two equi-joins, each
    against one row per key, never one OR join.
    """
    bridged = jobs.filter(F.col("bridge_key").isNotNull())
    by_root = bridged.filter("session_id IS NOT NULL").groupBy(F.col("session_id").alias("root")).agg(F.min("bridge_key").alias("b_root"))
    by_id = bridged.groupBy(F.col("job_id").alias("root8")).agg(F.min("bridge_key").alias("b_id"))
    root = F.coalesce("job_session_id", "session_id")
    s = sessions.withColumns({"root": root, "root8": F.substring(root, 1, 8)})
    keyed = (s.join(by_root, "root", "left").join(by_id, "root8", "left")
             .withColumn("bridge", F.coalesce("bridge_key", "b_root", "b_id"))
             .withColumn("key", F.coalesce("bridge", "job_session_id", "session_id")))
    kinds = keyed.groupBy("key").agg(
        F.when(F.max("bridge").isNotNull(), "bridge").when(F.max("job_session_id").isNotNull(), "root").otherwise("session").alias("kind"))
    return keyed.drop("root8", "b_root", "b_id").join(kinds, "key")


def backfill_names(sessions: DataFrame, messages: DataFrame, jobs: DataFrame) -> DataFrame:
    """Job rows for nameless jobs: the peer name most used on paired messages (ties by name)."""
    state = jobs.filter(F.col("source") == "state")
    own = F.coalesce("bridge_key", "job_session_id")
    s = sessions.filter(own.isNotNull()).select("session_id", "job_session_id", F.col("bridge_key").alias("bridge"), own.alias("key"))
    taken = [
        (state.select(F.col("bridge_key").alias("bridge")).filter("bridge IS NOT NULL").distinct(), "bridge", F.lit(True)),
        (state.select(F.col("session_id").alias("key")).filter("key IS NOT NULL").distinct(), "key", F.col("bridge").isNull()),
    ]
    for held, on, when in taken:
        mark = held.withColumn("held", F.lit(True))
        s = s.join(mark, on, "left").filter(~(F.coalesce("held", F.lit(False)) & when)).drop("held")
    ids = state.select(F.col("job_id").alias("root8")).distinct().withColumn("held", F.lit(True))
    s = (s.withColumn("root8", F.substring("job_session_id", 1, 8)).join(ids, "root8", "left")
         .filter(~(F.coalesce("held", F.lit(False)) & F.col("bridge").isNull())).drop("held", "root8"))
    acks = messages.filter("lane = 'tool' AND msg_id IS NOT NULL").select("session_id", "msg_id")
    copies = messages.filter("lane = 'relay' AND peer IS NOT NULL AND msg_id IS NOT NULL").select("msg_id", "peer")
    used = acks.join(copies, "msg_id").join(s, "session_id").groupBy("key", "bridge", "peer").agg(F.count("*").alias("n"))
    best = top_one(used, ["key"], F.struct(-F.col("n"), F.col("peer")), ["bridge", "peer"])
    return best.select(
        F.concat(F.lit("peer:"), "key").alias("job_id"), F.when(F.col("bridge").isNull(), F.col("key")).alias("session_id"),
        F.when(F.col("bridge").isNotNull(), F.col("key")).alias("bridge_key"), F.col("peer").alias("name"),
        F.lit(None).cast("string").alias("cwd"), F.lit(None).cast("string").alias("state"), F.lit("peer").alias("source"))


def job_spans(keyed: DataFrame) -> DataFrame:
    return keyed.groupBy("key", "kind").agg(F.min("first_ts").alias("first"), F.max(F.expr(ACTIVE)).alias("last"))


def job_rank() -> Column:
    """The daemon's live rows, then rows it has forgotten, then names peers remembered."""
    return F.when(F.col("source") != "state", 2).when(F.col("state") == "gone", 1).otherwise(0)


def named_jobs(keyed: DataFrame, jobs: DataFrame) -> DataFrame:
    """Job row of each key: bridge ids by bridge, roots by session id, else by daemon id."""
    spans = job_spans(keyed)
    seen = spans.select(F.col("key").alias("k"), "last")
    rows = (jobs.join(seen.withColumnsRenamed({"k": "bridge_key", "last": "lb"}), "bridge_key", "left")
            .join(seen.withColumnsRenamed({"k": "session_id", "last": "ls"}), "session_id", "left")
            .withColumn("seen", F.coalesce("lb", "ls")).withColumn("rank", job_rank()))
    best = F.struct("rank", -F.coalesce(F.unix_micros("seen"), F.lit(0)), "job_id")
    cols = ["job_id", "name", "cwd", "state", "source"]
    # a job row answers to each of its ids, a key asks by its kind and then by daemon id: one pass over either
    by = lambda how, value, rank=0: F.struct(F.lit(how).alias("how"), value.alias("id"), F.lit(rank).alias("nth"))
    answers = F.array(by("bridge", F.col("bridge_key")), by("root", F.col("session_id")), by("daemon", F.when(F.col("source") == "state", F.col("job_id"))))
    picked = top_one(rows.withColumn("to", F.explode(answers)).filter("to.id IS NOT NULL").withColumns({"how": F.col("to.how"), "id": F.col("to.id")}),
                     ["how", "id"], best, cols).filter("job_id IS NOT NULL")
    asks = F.array_compact(F.array(
        F.struct(F.col("kind").alias("how"), F.col("key").alias("id"), F.lit(0).alias("nth")),
        F.when(F.col("kind") == "root", by("daemon", F.substring("key", 1, 8), 1))))
    asked = spans.select("key", "kind", "first", "last", F.explode(asks).alias("ask")).select("key", "kind", "first", "last", "ask.*")
    found = asked.join(picked, ["how", "id"], "left")
    return found.groupBy("key", "kind", "first", "last").agg(
        F.min_by(F.struct(*cols), F.when(F.col("job_id").isNotNull(), F.col("nth"))).alias("r")).select("key", "kind", "first", "last", "r.*")


def name_holders(keyed: DataFrame, jobs: DataFrame, named: DataFrame | None = None) -> DataFrame:
    """name -> the job that holds it now: live before gone before remembered, then last active.

    `named` are the named jobs where the caller has them already.
    """
    rows = (named_jobs(keyed, jobs) if named is None else named).filter("name IS NOT NULL")
    best = F.struct(job_rank(), -F.coalesce(F.unix_micros("last"), F.lit(0)), "key")
    return top_one(rows, ["name"], best, ["key", "kind", "job_id", "state", "source"])


def resolve_ids(asked: DataFrame, keyed: DataFrame, jobs: DataFrame) -> DataFrame:
    """q -> job key, for a whole table of questions.

    A name, a bridge id in any spelling, a daemon id, a root, then a session id
    or unique prefix; the first rule that answers wins. Prefixes meet sessions by
    equality on the prefix of that length, not by a theta join.
    """
    key_of = keyed.select(F.col("session_id").alias("sid"), "key")
    names = name_holders(keyed, jobs).select(F.col("name").alias("q"), "key", F.lit(0).alias("rule"))
    bridges = keyed.filter("kind = 'bridge'").select(F.col("key").alias("b"), "key").distinct()
    via_bridge = asked.withColumn("b", bridge_key(F.col("q"))).join(bridges, "b").select("q", "key", F.lit(1).alias("rule"))
    ids = jobs.filter("source = 'state' AND session_id IS NOT NULL").join(key_of, F.col("session_id") == F.col("sid")).select(
        F.col("job_id").alias("q"), "key", F.lit(2).alias("rule"))
    roots = keyed.filter("job_session_id IS NOT NULL").groupBy(F.col("job_session_id").alias("q")).agg(
        F.min("key").alias("key"), F.lit(3).alias("rule"))
    matched = _prefixed(asked, keyed).groupBy("q").agg(F.min("key").alias("key"), F.count_distinct("stub").alias("hits"), F.lit(4).alias("rule")).filter("hits = 1").drop("hits")
    found = names.unionByName(via_bridge).unionByName(ids).unionByName(roots).unionByName(matched)
    answers = top_one(found.join(asked.select("q").distinct(), "q", "left_semi"), ["q"], F.struct("rule", "key"), ["key", "rule"])
    return asked.select("q").distinct().join(answers, "q", "left")


def _prefixed(asked: DataFrame, keyed: DataFrame) -> DataFrame:
    """q, session_id, key, stub of all sessions whose id begins with q; stubs leave out what an orphaned copy's id ends in."""
    probes = asked.select("q", F.length("q").alias("n")).filter("n > 0")
    # the lengths in question: at most one per character of an id
    sizes = probes.agg(F.collect_set("n")).scalar()
    prefixes = keyed.select("session_id", "key", sizes.alias("sizes")).select("session_id", "key", F.explode("sizes").alias("n")).filter(
        F.col("n") <= F.length("session_id")).withColumn("q", F.substring(F.col("session_id"), F.lit(1), F.col("n")))
    found = prefixes.join(probes.select("q").distinct(), "q", "left_semi")
    return found.select("q", "session_id", "key", F.regexp_replace("session_id", r"\.orphaned-.*$", "").alias("stub"))


def ambiguous_ids(asked: DataFrame, keyed: DataFrame, jobs: DataFrame, shown: int = 5) -> DataFrame:
    """Questions that no rule answers because several sessions begin so: q, hits, and the first `shown` of them."""
    open_ = resolve_ids(asked, keyed, jobs).filter("key IS NULL").select("q")
    stubs = _prefixed(open_, keyed).select("q", "stub").distinct()
    hits = stubs.groupBy("q").agg(F.count("*").alias("hits")).filter("hits > 1")
    first = Window.partitionBy("q").orderBy("stub")  # the limit on its number is applied before the shuffle too
    few = stubs.withColumn("i", F.row_number().over(first)).filter(F.col("i") <= shown).groupBy("q").agg(F.sort_array(F.collect_list("stub")).alias("candidates"))
    return hits.join(few, "q")


class AmbiguousId(ValueError):
    """An id prefix that several sessions share."""


def resolve_one(q: str, keyed: DataFrame, jobs: DataFrame) -> str | None:
    """The job key of one question, None if nothing answers; AmbiguousId names the sessions in question."""
    asked = keyed.sparkSession.range(1).select(F.lit(q).alias("q"))
    answer = resolve_ids(asked, keyed, jobs).first()
    if answer.key is not None:
        return answer.key
    several = ambiguous_ids(asked, keyed, jobs).first()
    if several is None:
        return None
    more = f" and {several.hits - len(several.candidates)} more" if several.hits > len(several.candidates) else ""
    raise AmbiguousId(f"{q!r} fits {several.hits} sessions: {', '.join(several.candidates)}{more}")


# --- spawn edges --------------------------------------------------------------------

def child_keys(keyed: DataFrame) -> DataFrame:
    """First eight characters of a root or session id -> job key."""
    short = keyed.select(F.explode(F.array_compact(F.array(F.substring("job_session_id", 1, 8), F.substring("session_id", 1, 8)))).alias("child"), "key")
    return short.groupBy("child").agg(F.min("key").alias("child_key"))


def spawn_edges(keyed: DataFrame, jobs: DataFrame, ledger: DataFrame, messages: DataFrame | None = None) -> DataFrame:
    """child job -> parent job, with the session and instant of the spawn.

    The ledger decides first: the earliest line of a child wins and marks it
    held, even when it names no parent. Refs printed in shell results decide
    only children the ledger does not hold; there the earliest call wins.
    """
    kids = child_keys(keyed)
    lines = ledger.join(kids, "child")
    tie = F.struct("ts", "child", *[F.coalesce(c, F.lit("")) for c in ("parent_session", "parent_bridge", "parent_job")])
    first = top_one(lines, ["child_key"], tie, ["ts", "parent_session", "parent_bridge", "parent_job"])
    by_session = keyed.select(F.col("session_id").alias("parent_session"), F.col("key").alias("k_session"))
    known = (keyed.select(F.col("bridge_key").alias("b")).union(jobs.select("bridge_key")).filter("b IS NOT NULL").distinct()
             .withColumn("k_bridge", F.col("b")))
    by_job = kids.withColumnsRenamed({"child": "parent_job", "child_key": "k_job"})
    held = (first.withColumn("b", bridge_key(F.col("parent_bridge")))
            .join(by_session, "parent_session", "left").join(known, "b", "left").join(by_job, "parent_job", "left")
            .withColumn("parent_key", F.coalesce("k_session", "k_bridge", "k_job")))
    cols = ["child_key", "parent_key", "session_id", "ts"]
    edges = held.withColumn("session_id", F.coalesce("parent_session", F.lit(""))).select(cols)
    if messages is not None:
        bash = messages.filter("type = 'assistant' AND lane = 'tool' AND tool_name = 'Bash' AND tool_use_id IS NOT NULL").select(
            "session_id", "tool_use_id", "ts")
        said = uncut(messages).filter("type = 'user' AND lane = 'tool' AND tool_use_id IS NOT NULL").filter(
            F.contains("text", F.lit("backgrounded · ")) | F.contains("text", F.lit('"ref"')))
        refs = said.select("session_id", "tool_use_id", F.explode(F.array_union(
            F.regexp_extract_all("text", F.lit(fv.CHILD_ID), F.lit(1)), F.regexp_extract_all("text", F.lit(fv.CHILD_ID), F.lit(2)))).alias("child")).filter("child <> ''")
        told = (refs.join(bash, ["session_id", "tool_use_id"]).join(keyed.select("session_id", F.col("key").alias("parent_key")), "session_id")
                .join(kids, "child").filter("parent_key <> child_key"))
        # the ledger's row of a child comes before anything told, so it is worked out once
        both = edges.withColumn("told", F.lit(0)).unionByName(told.select(*cols, F.lit(1).alias("told")))
        edges = top_one(both, ["child_key"], F.struct("told", "ts", "session_id", "parent_key"), ["parent_key", "session_id", "ts"]).select(cols)
    return edges.filter("parent_key IS NOT NULL AND parent_key <> child_key")


# --- peers ----------------------------------------------------------------------------

def relayed(messages: DataFrame, keyed: DataFrame) -> DataFrame:
    """Received copies with the receiving job and, when the ack is known, the sending job."""
    key = keyed.select("session_id", "key")
    copies = messages.filter("lane = 'relay' AND peer IS NOT NULL").join(key, "session_id").select("key", "peer", "ts", "msg_id")
    acks = messages.filter("lane = 'tool' AND msg_id IS NOT NULL").join(key, "session_id").groupBy("msg_id").agg(F.min("key").alias("sender"))
    return copies.join(acks, "msg_id", "left")


def holder_at(asks: DataFrame, named: DataFrame) -> DataFrame:
    """Which job held a name at an instant: alive with the latest start, else the
    latest started before it, else the earliest.

    asks(name, at_ms) -> + holder. Job intervals become blocks holding one
    winner each, so no (message, namesake) pairs are made.
    """
    ms = lambda c: F.unix_millis(c)
    spans = named.filter("name IS NOT NULL AND first IS NOT NULL").select("name", "key", ms("first").alias("lo"), ms("last").alias("hi"))
    by_start = F.struct("lo", "key")

    def stabbed(intervals: DataFrame, column: str) -> DataFrame:
        blocks = intervals.select("name", "lo", "key", F.explode(ranges.cover(F.col("lo"), F.col("hi"))).alias("b")).groupBy(
            "name", "b.level", "b.block").agg(F.max(by_start).alias("w"))
        hits = points.select("name", "at_ms", F.explode(ranges.probe(F.col("at_ms"))).alias("b")).select("name", "at_ms", "b.level", "b.block")
        return hits.join(blocks, ["name", "level", "block"]).groupBy("name", "at_ms").agg(F.max("w")["key"].alias(column))

    points = asks.select("name", "at_ms").distinct()
    far = F.lit(1 << 43)  # open end: every later instant
    alive = stabbed(spans.filter("hi >= lo"), "alive")
    started = stabbed(spans.withColumn("hi", far), "started")
    oldest = spans.groupBy("name").agg(F.min(by_start)["key"].alias("oldest"))
    return (points.join(alive, ["name", "at_ms"], "left").join(started, ["name", "at_ms"], "left").join(oldest, "name", "left")
            .select("name", "at_ms", F.coalesce("alive", "started", "oldest").alias("holder")))


def peer_credit(messages: DataFrame, keyed: DataFrame, jobs: DataFrame) -> DataFrame:
    """(key, peer) -> n: who a job exchanged messages with, both directions credited."""
    named = named_jobs(keyed, jobs)
    names = named.filter("name IS NOT NULL").select(F.col("key").alias("k"), F.col("name").alias("receiver"))
    rows = relayed(messages, keyed)
    # unpaired rows are counted per instant first; only those instants look for a holder
    counted = rows.groupBy("key", "peer", "sender", F.when(F.col("sender").isNull(), F.unix_millis("ts")).alias("at_ms")).agg(F.count("*").alias("n"))
    loose = counted.filter("sender IS NULL")
    held = holder_at(loose.select(F.col("peer").alias("name"), "at_ms").filter("at_ms IS NOT NULL"), named)
    found = loose.join(held.withColumnRenamed("name", "peer"), ["peer", "at_ms"], "left").select("key", "peer", "n", F.col("holder").alias("sender"))
    all_rows = counted.filter("sender IS NOT NULL").select("key", "peer", "n", "sender").unionByName(found)
    out = all_rows.filter("sender IS NOT NULL").join(names, F.col("key") == F.col("k")).select(F.col("sender").alias("key"), F.col("receiver").alias("peer"), "n")
    return all_rows.select("key", "peer", "n").unionByName(out).groupBy("key", "peer").agg(F.sum("n").alias("n"))
