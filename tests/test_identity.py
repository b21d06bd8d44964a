import pytest
from pyspark.sql import functions as F

from logloom.operators import identity as idn
from logloom.plans import jobs as jb, limits as lm, search as sr, threads as th
from logloom.functions import pricing
from logloom.schemas import Corpus

SESSION = "session_id string, job_session_id string, bridge_key string, first string, last string, well string, lines bigint"
JOB = "job_id string, session_id string, bridge_key string, name string, cwd string, state string, source string"
MSG = ("session_id string, line_no bigint, pos int, t string, lane string, type string, tool_name string, prompt_id string, tool_use_id string, is_error boolean, peer string, msg_id string, text string")


def sessions(spark, rows):
    df = spark.createDataFrame([(*r, "w", 1) for r in rows], SESSION)
    at = lambda c: F.to_timestamp(c)
    return df.select("session_id", "job_session_id", "bridge_key", "well", "lines", at("first").alias("first_ts"), at("last").alias("last_ts"), at("last").alias("last_activity_ts"))


@pytest.fixture(scope="module")
def world(spark):
    """Two jobs named ann and bob; ann's first session has no pointer and no bridge record."""
    s = sessions(spark, [("ann-1", None, None, "2026-09-02 06:00", "2026-09-02 07:00"), ("ann-2", "ann-1", "A", "2026-09-02 07:10", "2026-09-02 08:00"),
                         ("bob-1", None, "B", "2026-09-02 06:00", "2026-09-02 08:00"), ("solo", None, None, "2026-09-02 06:00", "2026-09-02 06:01")])
    jobs = spark.createDataFrame([("j1", "ann-1", "A", "ann", "/r", "working", "state"), ("j2", "bob-1", "B", "bob", "/r", "gone", "state")], JOB)
    send = lambda s_, n, t, tid, to, text: (s_, n, 0, t, "tool", "assistant", "SendMessage", "P" + s_, tid, False, None, None, 'SendMessage {"to":"%s","summary":"%s","message":"%s"}' % (to, text, text))
    ack = lambda s_, n, t, tid, m, ok=True: (s_, n, 0, t, "tool", "user", None, "P" + s_, tid, False, None, m, '{"success":true,"msg_id":"%s"}' % m if ok else '{"success":false,"message":"ENOENT"}')
    copy = lambda s_, n, t, frm, m, typ, body: (s_, n, 0, t, "relay", typ, None, "Q" + s_, None, False, frm, m, f'<cross-session-message from="uds:/{frm}" from-name="{frm}">\n{body}\n</cross-session-message>')
    said = lambda s_, n, t, text: (s_, n, 0, t, "prompt", "user", None, "P" + s_, None, False, None, None, text)
    rows = [
        said("bob-1", 0, "2026-09-02 06:50:00", "standby"), said("ann-1", 0, "2026-09-02 06:52:00", "brief bob"),
        send("ann-1", 1, "2026-09-02 06:55:01", "k", "bob [65f02e]", "kick"), ack("ann-1", 2, "2026-09-02 06:55:03", "k", "m1"), copy("bob-1", 1, "2026-09-02 06:55:03", "ann", "m1", "user", "kick whole"),
        send("bob-1", 2, "2026-09-02 06:57:00", "c", "uds:/ann", "lost one"), ack("bob-1", 3, "2026-09-02 06:57:01", "c", None, False),
        send("bob-1", 4, "2026-09-02 07:28:00", "d", "uds:/ann", "again"), ack("bob-1", 5, "2026-09-02 07:28:01", "d", "m2"), copy("ann-2", 1, "2026-09-02 07:28:02", "bob", "m2", "attachment", "again whole"),
        send("ann-2", 2, "2026-09-02 07:32:00", "e", "bob", "nobody saw"), ack("ann-2", 3, "2026-09-02 07:32:01", "e", "m3"),
        send("bob-1", 6, "2026-09-02 07:40:00", "f", "agent17", "to own agent"), ack("bob-1", 7, "2026-09-02 07:40:01", "f", None, True),
    ]
    m = spark.createDataFrame(rows, MSG).withColumn("ts", F.to_timestamp("t")).drop("t")
    spawns = spark.createDataFrame([("bob-1", "agent17")], "session_id string, agent_id string")
    return Corpus(sessions=s, jobs=jobs, messages=m, spawns=spawns)


def test_keys_and_kinds(world):
    got = {r.session_id: (r.key, r.kind) for r in idn.job_keys(world.sessions, world.jobs).collect()}
    assert got == {"ann-1": ("A", "bridge"), "ann-2": ("A", "bridge"), "bob-1": ("B", "bridge"), "solo": ("solo", "session")}


def test_thread_rows_and_totals(world):
    keyed = idn.job_keys(world.sessions, world.jobs)
    rows = th.thread(world, keyed, "ann", "bob")
    got = [(r.from_name, r.to_name, r.landed, r.msg_id, r.message) for r in rows.collect()]
    assert got == [("ann", "bob", "turn", "m1", "kick whole"), ("bob", "ann", "lost", None, "lost one"), ("bob", "ann", "mid-turn", "m2", "again whole"), ("ann", "bob", "unseen", "m3", "nobody saw")]
    totals = {(r.from_name, r.to_name): tuple(r)[2:] for r in th.direction_totals(rows).collect()}
    assert totals == {("ann", "bob"): (2, 1, 0, 0, 1), ("bob", "ann"): (2, 0, 1, 1, 0)}
    assert [tuple(r)[:3] for r in th.thread_list(world, keyed).collect()] == [("ann", "bob", 2)]
    own = [(r.to_key, r.message) for r in th.own_words(world, keyed, rows).orderBy("ts").collect()]
    assert own == [("B", "standby"), ("A", "brief bob")]


def test_names_resolve_to_the_live_holder(spark, world):
    jobs = world.jobs.unionByName(spark.createDataFrame([("j0", "solo", None, "ann", None, "gone", "state")], JOB))
    keyed = idn.job_keys(world.sessions, jobs)
    asked = spark.createDataFrame([("ann",), ("cse_B",), ("j2",), ("ann-1",), ("sol",), ("an",), ("zzz",)], "q string")
    got = {r.q: r.key for r in idn.resolve_ids(asked, keyed, jobs).collect()}
    assert got == {"ann": "A", "cse_B": "B", "j2": "B", "ann-1": "A", "sol": "solo", "an": None, "zzz": None}


def test_edges_ledger_decides_before_text(spark):
    s = sessions(spark, [(f"{n:08x}-x", None, None, "2026-01-01 00:00", "2026-01-01 01:00") for n in range(5)])
    jobs = spark.createDataFrame([], JOB)
    keyed = idn.job_keys(s, jobs)
    led = spark.createDataFrame([("00000001", "2026-01-01 00:00", "00000000-x", None, None), ("00000001", "2026-01-02 00:00", "00000002-x", None, None), ("00000002", "2026-01-01 00:00", None, None, None)],
                                "child string, t string, parent_session string, parent_bridge string, parent_job string").withColumn("ts", F.to_timestamp("t"))
    call = lambda s_, tid, t: (s_, 0, 0, t, "tool", "assistant", "Bash", None, tid, False, None, None, "Bash {}")
    said = lambda s_, tid, t, text: (s_, 1, 0, t, "tool", "user", None, None, tid, False, None, None, text)
    m = spark.createDataFrame([call("00000000-x", "a", "2026-01-01 02:00"), said("00000000-x", "a", "2026-01-01 02:01", '{"ref":"00000003"} backgrounded · 00000004'),
                               call("00000001-x", "b", "2026-01-01 01:00"), said("00000001-x", "b", "2026-01-01 01:01", '{"ref": "00000003"} {"ref": "00000002"}')], MSG).withColumn("ts", F.to_timestamp("t"))
    got = {r.child_key: r.parent_key for r in idn.spawn_edges(keyed, jobs, led, m).collect()}
    # 1 by its first ledger line; 2 is held without a parent; 3 by the earliest call; 4 by the harness's own line
    assert got == {"00000001-x": "00000000-x", "00000003-x": "00000001-x", "00000004-x": "00000000-x"}


def test_holder_of_a_name_at_an_instant(spark):
    named = spark.createDataFrame([("n", "k1", 10, 20), ("n", "k2", 15, 17), ("n", "k3", 40, 50)], "name string, key string, a bigint, b bigint").select(
        "name", "key", F.timestamp_millis("a").alias("first"), F.timestamp_millis("b").alias("last"))
    asks = spark.createDataFrame([("n", t) for t in (5, 12, 16, 18, 30, 45, 60)], "name string, at_ms bigint")
    assert {r.at_ms: r.holder for r in idn.holder_at(asks, named).collect()} == {5: "k1", 12: "k1", 16: "k2", 18: "k1", 30: "k2", 45: "k3", 60: "k3"}


def test_fleet_tree_survives_cycles(spark):
    rows = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("d", "c"), ("e", "d"), ("x", "y"), ("y", "x"), ("z", "missing"), ("s", "s")], "key string, parent_key string").withColumn("repo", F.col("key"))
    got = {r.key: (r.top, r.depth) for r in jb.fleet_tree(rows).collect()}
    assert got == {"a": ("a", 0), "b": ("a", 1), "c": ("a", 2), "d": ("a", 3), "e": ("a", 3), "x": ("x", 0), "y": ("x", 1), "z": ("z", 0), "s": ("s", 0)}


def test_limit_window_reset_and_stale_reading(spark):
    r = lambda ts, pct, resets, kind="seven_day", src="mod": (ts, "s", kind, pct, resets, src)
    week, past = "2026-11-14 11:00:00", "2026-11-07 11:00:00"
    rows = [r("2026-11-08 12:00", 30.0, week), r("2026-11-11 12:00", 100.0, week, src="transcript"), r("2026-11-12 04:00", 0.0, week), r("2026-11-13 04:00", 10.0, week),
            r("2026-11-13 05:00", 97.0, past), r("2026-10-30 05:00", 3.0, "2026-10-30 08:00:00", "five_hour")]
    lim = spark.createDataFrame(rows, "t string, session_id string, kind string, pct double, z string, source string").select(
        F.to_timestamp("t").alias("ts"), "session_id", "kind", "pct", F.to_timestamp("z").alias("resets_at"), "source")
    toks = {k: F.lit(v).cast("bigint") for k, v in dict(input_tokens=0, cache_write_tokens=0, cache_write_1h_tokens=0, cache_read_tokens=1_000_000, output_tokens=0).items()}
    reqs = spark.createDataFrame([("2026-11-09 00:00",), ("2026-11-12 10:00",), ("2026-11-13 03:00",)], "t string").select(F.to_timestamp("t").alias("ts"), F.lit("claude-opus-5").alias("model"), *[v.alias(k) for k, v in toks.items()])
    c = Corpus(limits=lim, requests=reqs, rates=pricing.rate_table(spark, [("claude-opus-5", "2026-01-01", 5.0, 6.25, 10.0, 0.5, 25.0)]))
    got = {w.kind: w for w in lm.limit_windows(c, "2026-11-13T12:00:00Z").collect()}
    w = got["seven_day"]
    assert (w.pct, w.reset_pct, w.was, w.requests, w.list_usd, w.implied_requests, w.usd_per_point) == (10.0, 0.0, 100.0, 2, 1.0, 20, 0.1)
    assert got["five_hour"].ended and got["five_hour"].requests is None


def test_search_semantics(spark):
    docs = spark.createDataFrame([(1, "Alpha beta gamma"), (2, "alpha gamma beta alpha"), (3, "Délta alphabet"), (4, "nothing")], "id int, text string")
    ids = lambda q: sorted(r.id for r in sr.scored(docs, q).collect())
    assert ids(sr.all_words("alpha beta")) == [1, 2] and ids(sr.phrase("alpha", "beta")) == [1] and ids(sr.starts("alph")) == [1, 2, 3]
    assert ids(sr.word("delta") | sr.word("nothing")) == [3, 4] and ids(sr.starts("alph") - sr.word("gamma")) == [3]
    assert ids(sr.near(sr.word("alpha"), sr.word("gamma"), distance=0)) == [2] and ids(sr.near(sr.word("alpha"), sr.word("gamma"), distance=1)) == [1, 2]
    top = sr.search(docs, sr.word("alpha"), 1, tie="id").first()
    assert top.id == 2 and top.rank < 0 and top.snippet == "«alpha» gamma beta «alpha»"


def test_fleet_tree_of_long_chains_and_rings(spark):
    from logloom.plans import jobs as jb

    rows = [(f"c{i:03}", f"c{i - 1:03}" if i else None, f"r{i}") for i in range(300)]
    rows += [("x1", "x2", "a"), ("x2", "x3", "b"), ("x3", "x1", "c"), ("tail", "x2", "d"), ("self", "self", "e"), ("orphan", "gone", "f")]
    got = {r.key: (r.top, r.depth, r.top_repo) for r in jb.fleet_tree(spark.createDataFrame(rows, "key string, parent_key string, repo string")).collect()}
    assert all(got[f"c{i:03}"] == ("c000", min(i, 3), "r0") for i in range(300))
    assert got["x1"] == ("x1", 0, "a") and got["x3"] == ("x1", 1, "a") and got["x2"] == ("x1", 2, "a") and got["tail"] == ("x1", 3, "a")
    assert got["self"] == ("self", 0, "e") and got["orphan"] == ("orphan", 0, "f")


def test_search_folds_accents_and_marks_inside_words(spark):
    from logloom.plans import search as sr

    docs = spark.createDataFrame([(1, "az őz és şu"), (2, "nichts und-mit dabei"), (3, "other")], "id int, text string")
    assert {r.id for r in sr.scored(docs, sr.word("oz") & sr.word("su")).collect()} == {1}
    assert [r.snippet for r in sr.search(docs, sr.word("und"), 5).collect()] == [" … «und-mit» dabei"]
    scoped = sr.scored(docs, sr.word("und"), scope=F.col("id") > 1).collect()
    assert [(r.id, round(r.rank, 9)) for r in scoped] == [(r.id, round(r.rank, 9)) for r in sr.scored(docs, sr.word("und")).collect()]
