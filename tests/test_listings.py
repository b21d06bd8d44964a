"""The fleet as it is printed, ambiguous ids, capped lists, a job's conversation."""

import random

import pytest
from pyspark.sql import functions as F

from logloom.operators import identity as idn
from logloom.plans import jobs as jb, sessions as ses, trace as trc
from logloom.schemas import Corpus


def _printed(rows, cap=3):
    """Group rows and jobs depth first; of a ring the least key is the top."""
    listed = {r[0]: r for r in rows}
    up = {k: p if p in listed and p != k else None for k, p, *_ in rows}
    for k in sorted(listed):
        seen, at = [], k
        while at is not None and at not in seen:
            seen.append(at)
            at = up[at]
        if at is not None:
            up[min(seen[seen.index(at):])] = None
    top = {}
    for k in listed:
        at = k
        while up[at] is not None:
            at = up[at]
        top[k] = listed[at][2] or "elsewhere"
    order = sorted(listed, key=lambda k: (listed[k][3], k))
    homes = sorted(set(top.values()), key=lambda h: (min(listed[k][3] for k in listed if top[k] == h), h))
    below = {}
    for k in order:
        below.setdefault(up[k], []).append(k)
    out = []
    for h in homes:
        mine = [k for k in listed if top[k] == h]
        out.append(("group", h, None, None, len(mine), sum(bool(listed[k][4]) for k in mine)))
        stack = [(k, 0) for k in reversed(below.get(None, [])) if top[k] == h]
        while stack:
            k, d = stack.pop()
            out.append(("row", h, k, min(d, cap), None, int(bool(listed[k][4]))))
            stack += [(c, d + 1) for c in reversed(below.get(k, []))]
    return out


def test_fleet_listing_is_depth_first(spark, monkeypatch):
    monkeypatch.setattr(jb, "CHUNK_ROWS", 40)  # siblings of one parent lie in several chunks
    draw = random.Random(2)
    rows = [(f"c{i:04}", f"c{i - 1:04}" if i else None, "chain", 5000 - i, i % 3 == 0) for i in range(1000)]
    rows += [(f"n{i}", f"n{draw.randrange(i)}" if i and draw.random() < 0.7 else draw.choice([None, "gone", f"n{i}"]), draw.choice(["a", "b", None]), draw.randrange(200), draw.choice([True, False, None])) for i in range(300)]
    rows += [("x1", "x3", "ring", 7, True), ("x2", "x1", "ring2", 3, True), ("x3", "x2", "a", 1, False), ("x4", "x2", "b", 0, None)]
    got = jb.fleet_listing(spark.createDataFrame(rows, "key string, parent_key string, repo string, rank int, live boolean")).orderBy("position").collect()
    assert [r.position for r in got] == list(range(1, len(got) + 1))
    assert [(r.kind, r.repo, r.key, r.depth, r.n, r.live) for r in got] == _printed(rows)


def test_a_job_takes_part_in_a_round_only_while_its_chain_is_that_long(spark, monkeypatch):
    """Few long chains among many short ones: what the rounds write is about one row a job, not one a job and round."""
    rows = [(f"c{i:03}", f"c{i - 1:03}" if i else None, "chain", i, True) for i in range(65)] + [(f"n{i:04}", f"n{i % 100:04}" if i >= 100 else None, "a", i, False) for i in range(1000)]
    written, stage = [], jb.staged

    def counting(df, name):
        out = stage(df, name)
        written.append((name, out.count()))
        return out
    monkeypatch.setattr(jb, "staged", counting)
    got = jb.fleet_listing(spark.createDataFrame(rows, "key string, parent_key string, repo string, rank int, live boolean")).orderBy("position").collect()
    assert [(r.kind, r.repo, r.key, r.depth, r.n, r.live) for r in got] == _printed(rows)
    assert sum(n for name, n in written if name in ("fleet-walk", "fleet-tour")) <= 5 * len(rows)
    assert not [name for name, _ in written if name == "fleet-cut"]  # without a cycle nothing is walked again


def test_fleet_listing_of_nothing(spark):
    assert jb.fleet_listing(spark.createDataFrame([], "key string, parent_key string, repo string, rank int, live boolean")).count() == 0


SESSIONS = "session_id string, well string, job_session_id string, bridge_key string, first string, lines bigint"


def _sessions(spark, rows):
    at = F.to_timestamp("first")
    return spark.createDataFrame(rows, SESSIONS).select("session_id", "well", "job_session_id", "bridge_key", at.alias("first_ts"), at.alias("last_ts"), at.alias("last_activity_ts"), "lines")


JOBS = "job_id string, session_id string, bridge_key string, name string, state string, source string, cwd string"


def test_an_ambiguous_prefix_names_its_sessions(spark):
    rows = [(f"ab{i}c", "w", None, None, "2026-01-01", 1) for i in range(7)] + [("xyz1", "w", None, None, "2026-01-01", 1), ("xyz1.orphaned-17-aa", "w", None, None, "2026-01-01", 1)]
    jobs = spark.createDataFrame([], JOBS)
    keyed = idn.job_keys(_sessions(spark, rows), jobs)
    assert idn.resolve_one("xyz", keyed, jobs) == "xyz1"
    with pytest.raises(idn.AmbiguousId, match="'ab' fits 7 sessions: ab0c, ab1c, ab2c, ab3c, ab4c and 2 more"):
        idn.resolve_one("ab", keyed, jobs)


def _job_world(spark):
    rows, said = [], []
    for i in range(12):
        sid = f"s{i:02}"
        rows.append((sid, "w", "root" if i != 5 else None, None, f"2026-01-{20 - i:02} 00:00:00", 3))
        for n in range(i % 3):
            said.append((sid, n, 0, "user", "prompt", f"P{n}", f"go {sid} {n}", f"2026-01-{20 - i:02} 00:00:0{n}"))
    messages = spark.createDataFrame(said, "session_id string, line_no bigint, pos int, type string, lane string, prompt_id string, text string, t string").select(
        "session_id", "line_no", "pos", "type", "lane", "prompt_id", "text", F.to_timestamp("t").alias("ts"),
        *[F.lit(None).cast("string").alias(n) for n in ("tool_name", "tool_use_id", "request_id", "peer", "msg_id", "cwd", "model")], F.lit(False).alias("is_error"))
    requests = spark.createDataFrame([], "session_id string, message_id string, model string, ts timestamp, input_tokens bigint, cache_write_tokens bigint, cache_write_5m_tokens bigint, "
                                         "cache_write_1h_tokens bigint, cache_read_tokens bigint, output_tokens bigint, thinking_tokens bigint")
    from logloom.functions import pricing
    return Corpus(sessions=_sessions(spark, rows), messages=messages, requests=requests, jobs=spark.createDataFrame([], JOBS), rates=pricing.rate_table(spark, [("a", "2024-01-01", 1.0, 1.0, 1.0, 1.0, 1.0)]))


def test_a_jobs_conversation_runs_across_its_sessions(spark):
    c = _job_world(spark)
    rows = trc.job_conversation(c).where("key = 'root'").orderBy("position").collect()
    want = [(f"s{i:02}", n + 1) for i in range(11, -1, -1) if i != 5 for n in range(i % 3)]
    assert [(r.session_id, r.tx) for r in rows] == want and [r.position for r in rows] == list(range(1, len(want) + 1))
    assert [(r.session_id, r.tx) for r in trc.job_conversation_tail(c, "root", 7).collect()] == want[-7:]


def test_a_list_says_when_its_limit_was_met(spark):
    c = _job_world(spark)
    assert {(r.capped, n) for n in (5, 12, 13) for r in ses.session_list(c, n).select("capped").distinct().collect()} == {(True, 5), (True, 12), (False, 13)}
    since = ses.session_list(c, since="2026-01-15").select("session_id", "capped").collect()
    assert len(since) == 6 and not any(r.capped for r in since)
