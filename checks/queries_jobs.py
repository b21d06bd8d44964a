"""Identity, jobs, threads, lanes, runs, rosters."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import queries_trace as qt, standins as st
from checks.queries_usage import KEYS, PRICE, SUB_TABLES, all_in_sql, r2
from checks.registry import query
from checks.standins import with_ctes
from logloom.functions import envelope as env
from logloom.functions.python_helpers import slug
from logloom.operators import identity as idn, packing
from logloom.operators.stages import staged
from logloom.plans import jobs as jb, sessions as ses, threads as th, trace as trc

BASE = ["sessions_t", "jobs_t"]
KEYED = """br AS (SELECT session_id AS root, min(bridge_key) AS b FROM jobs_t WHERE bridge_key IS NOT NULL GROUP BY 1),
    bi AS (SELECT job_id AS r8, min(bridge_key) AS b FROM jobs_t WHERE bridge_key IS NOT NULL GROUP BY 1),
    k0 AS (SELECT s.*, coalesce(s.bridge_key, br.b, bi.b) AS bridge FROM (SELECT *, coalesce(job_session_id, session_id) AS root FROM sessions_t) s
      LEFT JOIN br ON br.root = s.root LEFT JOIN bi ON bi.r8 = substr(s.root, 1, 8)),
    k1 AS (SELECT *, coalesce(bridge, job_session_id, session_id) AS key, coalesce(last_activity_ts, last_ts) AS act FROM k0),
    jk AS (SELECT *, CASE WHEN count(bridge) OVER w > 0 THEN 'bridge' WHEN count(job_session_id) OVER w > 0 THEN 'root' ELSE 'session' END AS kind
      FROM k1 WINDOW w AS (PARTITION BY key)),
    spans AS (SELECT key, kind, min(first_ts) AS first, max(act) AS last FROM jk GROUP BY 1, 2)"""
RANK = "CASE WHEN source <> 'state' THEN 2 WHEN state = 'gone' THEN 1 ELSE 0 END"
NAMED = f"""jr AS (SELECT j.*, {RANK} AS rank, -coalesce(epoch_us(coalesce(a.last, b.last)), 0) AS seen FROM jobs_t j
      LEFT JOIN spans a ON a.key = j.bridge_key LEFT JOIN spans b ON b.key = j.session_id),
    byb AS (SELECT * FROM jr WHERE bridge_key IS NOT NULL QUALIFY row_number() OVER (PARTITION BY bridge_key ORDER BY rank, seen, job_id) = 1),
    byr AS (SELECT * FROM jr QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY rank, seen, job_id) = 1),
    byd AS (SELECT * FROM jr WHERE source = 'state' QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY rank, seen) = 1),
    nj AS (SELECT s.key, s.kind, s.first, s.last, coalesce(b.job_id, r.job_id, d.job_id) AS job_id, coalesce(b.name, r.name, d.name) AS name,
        coalesce(b.cwd, r.cwd, d.cwd) AS cwd, coalesce(b.state, r.state, d.state) AS state, coalesce(b.source, r.source, d.source) AS source
      FROM spans s LEFT JOIN byb b ON s.kind = 'bridge' AND b.bridge_key = s.key LEFT JOIN byr r ON s.kind = 'root' AND r.session_id = s.key
      LEFT JOIN byd d ON s.kind = 'root' AND d.job_id = substr(s.key, 1, 8))"""
HOLD = f"""hold AS (SELECT name, key, kind, job_id, state, source FROM nj WHERE name IS NOT NULL
      QUALIFY row_number() OVER (PARTITION BY name ORDER BY {RANK}, -coalesce(epoch_us(last), 0), key) = 1)"""
EDGES = """kid AS (SELECT child, min(key) AS child_key FROM (SELECT substr(job_session_id, 1, 8) AS child, key FROM jk WHERE job_session_id IS NOT NULL
        UNION ALL SELECT substr(session_id, 1, 8), key FROM jk) GROUP BY 1),
    held AS (SELECT k.child_key, l.* FROM ledger_t l JOIN kid k USING (child) QUALIFY row_number() OVER (PARTITION BY k.child_key ORDER BY l.ts, l.child) = 1),
    led AS (SELECT h.child_key, coalesce(s.key, b.b, p.child_key) AS parent_key, coalesce(h.parent_session, '') AS session_id, h.ts FROM held h
      LEFT JOIN jk s ON s.session_id = h.parent_session
      LEFT JOIN (SELECT bridge_key AS b FROM sessions_t UNION SELECT bridge_key FROM jobs_t) b ON b.b = substr(h.parent_bridge, 5)
      LEFT JOIN kid p ON p.child = h.parent_job),
    told AS (SELECT k.child_key, s.key AS parent_key, r.session_id, r.ts FROM ref_t r JOIN jk s USING (session_id) JOIN kid k USING (child)
      WHERE k.child_key <> s.key AND k.child_key NOT IN (SELECT child_key FROM held)
      QUALIFY row_number() OVER (PARTITION BY k.child_key ORDER BY r.ts, r.session_id) = 1),
    edges AS (SELECT * FROM led WHERE parent_key IS NOT NULL AND parent_key <> child_key UNION ALL SELECT child_key, parent_key, session_id, ts FROM told)"""


def corpus(spark, sf, **kw):
    return st.corpus(spark, sf, **kw).with_tables(jobs=st.jobs(spark, sf), spawn_ledger=st.ledger(spark, sf))


def keyed(spark, sf):
    c = st.corpus(spark, sf, messages=False)
    return staged(idn.job_keys(c.sessions, st.jobs(spark, sf)), "job-keys")


def pair_corpus(spark, sf):
    return corpus(spark, sf, messages=False).with_tables(messages=st.pair_messages(spark, sf))


@query("d03_d04_job_keys", with_ctes(BASE, f"WITH {KEYED} SELECT session_id, key, kind FROM jk"))
def _(spark, sf):
    return keyed(spark, sf).select("session_id", "key", "kind")


PAIR_ROWS = """acks AS (SELECT msg AS msg_id, sender AS session_id, sent_at FROM pair WHERE acked AND NOT refused),
    copies AS (SELECT msg AS msg_id, receiver AS session_id, sent_at + INTERVAL 2 SECOND AS ts, 'n' || cast(sender_no % 40 AS string) AS peer, mid_turn FROM pair WHERE copied)"""


@query("d05_name_backfill", with_ctes(BASE + ["pair"], f"""WITH {PAIR_ROWS},
    s AS (SELECT *, coalesce(bridge_key, job_session_id) AS key FROM sessions_t s WHERE coalesce(bridge_key, job_session_id) IS NOT NULL AND NOT EXISTS (
      SELECT 1 FROM jobs_t j WHERE j.source = 'state' AND ((s.bridge_key IS NOT NULL AND j.bridge_key = s.bridge_key)
        OR (s.bridge_key IS NULL AND (j.session_id = s.job_session_id OR j.job_id = substr(s.job_session_id, 1, 8))))))
    SELECT 'peer:' || key AS job_id, peer AS name, bridge_key FROM (SELECT key, bridge_key, peer, count(*) AS n FROM acks JOIN copies USING (msg_id) JOIN s ON s.session_id = acks.session_id GROUP BY 1, 2, 3)
    QUALIFY row_number() OVER (PARTITION BY key ORDER BY n DESC, peer) = 1"""))
def _(spark, sf):
    c = pair_corpus(spark, sf)
    return idn.backfill_names(c.sessions, c.messages, c.jobs).select("job_id", "name", "bridge_key")


@query("d06_name_holders", with_ctes(BASE, f"WITH {KEYED}, {NAMED}, {HOLD} SELECT name, key, kind, job_id FROM hold"))
def _(spark, sf):
    return idn.name_holders(keyed(spark, sf), st.jobs(spark, sf)).select("name", "key", "kind", "job_id")


@query("d07_ambiguous_prefixes", with_ctes(BASE, f"""WITH {KEYED}, {NAMED}, {HOLD}, q AS (SELECT DISTINCT session_id AS sid, substr(session_id, 1, n::INT) AS q FROM sessions_t, range(1, 9) r(n)),
    h AS (SELECT q, count(DISTINCT sid) AS hits, array_to_string(list_sort(list(DISTINCT sid))[1:5], ',') AS candidates FROM q GROUP BY 1 HAVING count(DISTINCT sid) > 1)
    SELECT * FROM h WHERE q NOT IN (SELECT name FROM hold) AND q NOT IN (SELECT key FROM jk WHERE kind = 'bridge') AND q NOT IN (SELECT job_id FROM jobs_t) AND q NOT IN (SELECT job_session_id FROM jk WHERE job_session_id IS NOT NULL)"""))
def _(spark, sf):
    k, jobs = keyed(spark, sf), st.jobs(spark, sf)
    asked = k.select(F.explode(F.transform(F.sequence(F.lit(1), F.lit(8)), lambda n: F.substring("session_id", F.lit(1), n))).alias("q")).distinct()
    rows = idn.ambiguous_ids(asked, k, jobs)
    return rows.select("q", "hits", F.array_join("candidates", ",").alias("candidates"))


@query("d07_id_resolution", with_ctes(BASE, f"""WITH {KEYED}, {NAMED}, {HOLD},
    ask AS (SELECT DISTINCT q FROM (SELECT substr(session_id, 1, 8) AS q FROM sessions_t UNION ALL SELECT session_id FROM sessions_t UNION ALL SELECT name FROM jobs_t
      UNION ALL SELECT 'cse_' || bridge_key FROM jobs_t WHERE bridge_key IS NOT NULL UNION ALL SELECT substr(session_id, 1, 7) FROM sessions_t)),
    f AS (SELECT name AS q, key, 0 AS rule FROM hold UNION ALL SELECT a.q, j.key, 1 FROM ask a JOIN (SELECT DISTINCT key FROM jk WHERE kind = 'bridge') j ON j.key = substr(a.q, 5)
      UNION ALL SELECT j.job_id, k.key, 2 FROM jobs_t j JOIN jk k ON k.session_id = j.session_id WHERE j.source = 'state'
      UNION ALL SELECT job_session_id, min(key), 3 FROM jk WHERE job_session_id IS NOT NULL GROUP BY 1
      UNION ALL SELECT a.q, min(k.key), 4 FROM ask a JOIN jk k ON starts_with(k.session_id, a.q) GROUP BY 1 HAVING count(DISTINCT k.session_id) = 1)
    SELECT q, key, rule FROM ask LEFT JOIN (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY q ORDER BY rule, key) = 1) USING (q)"""))
def _(spark, sf):
    k, jobs = keyed(spark, sf), st.jobs(spark, sf)
    ids = k.select(F.explode(F.array(F.substring("session_id", 1, 8), F.col("session_id"), F.substring("session_id", 1, 7))).alias("q"))
    names = jobs.select(F.explode(F.array_compact(F.array("name", F.concat(F.lit("cse_"), "bridge_key")))).alias("q"))
    return idn.resolve_ids(ids.union(names), k, jobs)


@query("d08_message_pairs", with_ctes(["pair"], "SELECT msg AS msg_id, sender AS sender_session, receiver AS receiver_session FROM pair WHERE acked AND NOT refused AND copied"))
def _(spark, sf):
    return th.pairs(st.pair_messages(spark, sf)).select("msg_id", "sender_session", "receiver_session")


THREAD = f"""{PAIR_ROWS}, snd AS (SELECT k.key AS fk, 'n' || cast(receiver_no % 40 AS string) AS tn, CASE WHEN acked AND NOT refused THEN msg END AS m, acked AND refused AS lost, sent_at, 'text ' || msg AS body, 'about ' || msg AS summary
      FROM pair JOIN jk k ON k.session_id = pair.sender),
    rcv AS (SELECT k.key AS tk, c.peer, c.msg_id, c.ts, c.mid_turn FROM copies c JOIN jk k USING (session_id)),
    tr AS (SELECT coalesce(fk, hp.key) AS from_key, coalesce(tk, ht.key) AS to_key, x.peer, x.tn, coalesce(m, msg_id) AS msg_id, summary,
        CASE WHEN tk IS NOT NULL THEN CASE WHEN mid_turn THEN 'mid-turn' ELSE 'turn' END WHEN lost THEN 'lost' ELSE 'unseen' END AS landed,
        epoch_ms(coalesce(sent_at, ts)) AS ts_ms, coalesce('text ' || msg_id, body) AS message, fk IS NOT NULL AS has_sent
      FROM (SELECT * FROM snd FULL JOIN rcv ON m = msg_id) x LEFT JOIN hold ht ON ht.name = x.tn LEFT JOIN hold hp ON hp.name = x.peer),
    thr AS (SELECT tr.* EXCLUDE (peer, tn), coalesce(a.name, peer) AS from_name, coalesce(b.name, tn) AS to_name FROM tr LEFT JOIN nj a ON a.key = from_key LEFT JOIN nj b ON b.key = to_key)"""


@query("d09_thread_rows", with_ctes(BASE + ["pair"], f"WITH {KEYED}, {NAMED}, {HOLD}, {THREAD} SELECT from_key, to_key, from_name, to_name, msg_id, landed, ts_ms, message, summary FROM thr"))
def _(spark, sf):
    rows = th.thread_rows(pair_corpus(spark, sf), keyed(spark, sf))
    return rows.select("from_key", "to_key", "from_name", "to_name", "msg_id", "landed", F.unix_millis("ts").alias("ts_ms"), "message", "summary")


@query("d09_thread_totals", with_ctes(BASE + ["pair"], f"""WITH {KEYED}, {NAMED}, {HOLD}, {THREAD} SELECT from_name, to_name, count(*) FILTER (has_sent) AS sent, count(*) FILTER (landed = 'turn') AS turn,
    count(*) FILTER (landed = 'mid-turn') AS mid_turn, count(*) FILTER (landed = 'lost') AS lost, count(*) FILTER (landed = 'unseen') AS unseen FROM thr GROUP BY 1, 2"""))
def _(spark, sf):
    return th.direction_totals(th.thread_rows(pair_corpus(spark, sf), keyed(spark, sf)))


@query("d09_own_words", with_ctes(BASE + ["messages_t"], f"""WITH {KEYED}, o AS (SELECT session_id, min(ts) AS at_ts FROM messages_t WHERE lane = 'relay' GROUP BY 1),
    p AS (SELECT m.*, o.at_ts FROM messages_t m JOIN o USING (session_id) WHERE lane = 'prompt'), f AS (SELECT session_id, max(ts) AS ft FROM p WHERE ts <= at_ts GROUP BY 1)
    SELECT key AS to_key, CASE WHEN type = 'attachment' THEN 'mid-turn' ELSE 'turn' END AS landed, p.session_id, prompt_id, text AS message, epoch_ms(ts) AS ts_ms
    FROM p LEFT JOIN f USING (session_id) JOIN jk ON jk.session_id = p.session_id WHERE ts >= coalesce(ft, at_ts)"""))
def _(spark, sf):
    c, k = corpus(spark, sf), keyed(spark, sf)
    none = F.lit(None).cast("struct<session_id:string,prompt_id:string,ts:timestamp>")
    took = c.messages.filter("lane = 'relay'").select(none.alias("sent"), F.struct("session_id", "prompt_id", "ts").alias("received"), "ts")
    rows = th.own_words(c, k, took)
    return rows.withColumn("ts_ms", F.unix_millis("ts")).drop("ts")


@query("d10_thread_list", with_ctes(BASE + ["pair"], f"""WITH {KEYED}, {NAMED}, {PAIR_ROWS}, r AS (SELECT coalesce(n.name, n.key) AS me, c.peer, c.ts FROM copies c JOIN jk USING (session_id) JOIN nj n ON n.key = jk.key)
    SELECT least(me, peer) AS a, greatest(me, peer) AS b, count(*) AS messages, epoch_ms(min(ts)) AS first_ms, epoch_ms(max(ts)) AS last_ms FROM r WHERE me <> peer GROUP BY 1, 2"""))
def _(spark, sf):
    t = th.thread_list(pair_corpus(spark, sf), keyed(spark, sf))
    return t.select("a", "b", "messages", F.unix_millis("first").alias("first_ms"), F.unix_millis("last").alias("last_ms"))


# every copy is matched to its sender by id, or to whoever held the name then
CREDIT = """rl AS (SELECT jk.key, peer, epoch_ms(ts) AS at_ms, (SELECT min(key) FROM acks a JOIN jk k ON k.session_id = a.session_id WHERE a.msg_id = c.msg_id) AS sender FROM cp c JOIN jk USING (session_id)),
    hh AS (SELECT r.peer, r.at_ms, n.key, CASE WHEN epoch_ms(n.first) <= r.at_ms AND epoch_ms(n.last) >= r.at_ms THEN 0 WHEN epoch_ms(n.first) <= r.at_ms THEN 1 ELSE 2 END AS tier, epoch_ms(n.first) AS f
      FROM (SELECT DISTINCT peer, at_ms FROM rl WHERE sender IS NULL) r JOIN nj n ON n.name = r.peer),
    hb AS (SELECT peer, at_ms, key AS holder FROM hh QUALIFY row_number() OVER (PARTITION BY peer, at_ms ORDER BY tier, CASE WHEN tier = 2 THEN f ELSE -f END, CASE WHEN tier = 2 THEN key END, key DESC) = 1),
    al AS (SELECT rl.key, rl.peer, coalesce(sender, holder) AS sender FROM rl LEFT JOIN hb ON sender IS NULL AND hb.peer = rl.peer AND hb.at_ms = rl.at_ms),
    cr AS (SELECT key, peer FROM al UNION ALL SELECT al.sender, n.name FROM al JOIN nj n ON n.key = al.key WHERE n.name IS NOT NULL AND al.sender IS NOT NULL)"""


@query("d11_peer_credit", with_ctes(BASE + ["messages_t"], f"""WITH {KEYED}, {NAMED}, acks AS (SELECT msg_id, session_id FROM messages_t WHERE lane = 'tool' AND msg_id IS NOT NULL),
    cp AS (SELECT * FROM messages_t WHERE lane = 'relay'), {CREDIT} SELECT key, peer, count(*) AS n FROM cr GROUP BY 1, 2"""))
def _(spark, sf):
    c = corpus(spark, sf)
    return idn.peer_credit(c.messages, keyed(spark, sf), c.jobs)


@query("d11_peer_credit_paired", with_ctes(BASE + ["pair"], f"""WITH {KEYED}, {NAMED}, {PAIR_ROWS}, cp AS (SELECT * FROM copies), {CREDIT} SELECT key, peer, count(*) AS n FROM cr GROUP BY 1, 2"""))
def _(spark, sf):
    c = pair_corpus(spark, sf)
    return idn.peer_credit(c.messages, keyed(spark, sf), c.jobs)


def edges_of(spark, sf):
    return idn.spawn_edges(keyed(spark, sf), st.jobs(spark, sf), st.ledger(spark, sf), st.ref_messages(spark, sf))


@query("d12_spawn_edges", with_ctes(BASE + ["ledger_t", "ref_t"], f"WITH {KEYED}, {EDGES} SELECT child_key, parent_key, session_id, epoch_ms(ts) AS ts_ms FROM edges"))
def _(spark, sf):
    return edges_of(spark, sf).withColumn("ts_ms", F.unix_millis("ts")).drop("ts")


@query("d16_roster", with_ctes(["jobs_t", "sessions_t", "requests_t", "rec"], """WITH mix AS (SELECT session_id, model FROM (SELECT session_id, model, count(*) AS n FROM requests_t GROUP BY 1, 2)
      QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY n DESC, model) = 1),
    tail AS (SELECT session_id, arg_max(model, line_no) AS tm, arg_max(input_tokens + cache_read_tokens + cache_write_tokens, line_no) AS ctx FROM rec WHERE type = 'assistant' GROUP BY 1)
    SELECT j.job_id AS id, j.name, j.state, j.session_id, ctx, CASE WHEN j.state IN ('working', 'blocked') AND tm IS NOT NULL THEN tm ELSE mix.model END AS model,
      CASE WHEN j.state IN ('working', 'blocked') AND tm IS NOT NULL THEN 'transcript' WHEN mix.model IS NOT NULL THEN 'index' END AS model_source
    FROM jobs_t j LEFT JOIN mix USING (session_id) LEFT JOIN tail USING (session_id)"""))
def _(spark, sf):
    from logloom.functions import models

    jobs = st.jobs(spark, sf)
    none = lambda t: F.lit(None).cast(t)
    listed = jobs.select(F.col("job_id").alias("id"), "cwd", none("string").alias("session_id"), none("string").alias("name"), none("string").alias("state"),
                         none("timestamp").alias("updated_at"), F.lit("2024-01-01").cast("timestamp").alias("started_at"))
    c = st.corpus(spark, sf, messages=False)
    mix = models.model_lists(models.tally(c.requests, ["session_id"]), ["session_id"]).select("session_id", F.col("dominant_model").alias("index_model"))
    tails = jb.latest_model_and_context(st.event_entries(spark, sf))
    return jb.roster(listed, jobs, mix, tails).select("id", "name", "state", "session_id", "ctx", "model", "model_source")


@query("d17_latest_model_and_context", with_ctes(["rec"], """SELECT session_id, arg_max(model, line_no) AS model, arg_max(input_tokens + cache_read_tokens + cache_write_tokens, line_no) AS ctx
    FROM rec WHERE type = 'assistant' GROUP BY 1"""))
def _(spark, sf):
    return jb.latest_model_and_context(st.event_entries(spark, sf))


@query("d18_semi_anti_shapes", with_ctes(["messages_t", "sessions_t", "spawns_t"], """SELECT session_id, lines FROM sessions_t s
    WHERE EXISTS (SELECT 1 FROM messages_t m WHERE m.session_id = s.session_id AND m.lane = 'relay') AND NOT EXISTS (SELECT 1 FROM spawns_t p WHERE p.session_id = s.session_id AND p.open_requests > 3)"""))
def _(spark, sf):
    c = st.corpus(spark, sf, spawns=True)
    relayed = c.messages.filter("lane = 'relay'").select("session_id")
    return c.sessions.join(relayed, "session_id", "left_semi").join(c.spawns.filter("open_requests > 3").select("session_id"), "session_id", "left_anti").select("session_id", "lines")


FLEET = """listed AS (SELECT cast(p_partkey AS string) AS key, CASE WHEN p_partkey >= 10 THEN cast(p_partkey // 10 AS string) END AS up, p_brand AS repo FROM part
      UNION ALL SELECT concat('chain', c_custkey), CASE WHEN c_custkey % 900 > 0 THEN concat('chain', c_custkey - 1) END, c_mktsegment FROM customer
      UNION ALL SELECT concat('ring', s_suppkey), CASE WHEN s_suppkey > 5 THEN concat('ring', s_suppkey - 5) WHEN s_suppkey > 1 THEN concat('ring', s_suppkey % 5 + 1) END, s_name FROM supplier)"""


def fleet(spark, sf):
    part = spark.read.parquet(f"{sf}/part.parquet")
    up = F.floor(F.col("p_partkey") / 10).cast("bigint")
    rows = part.select(F.col("p_partkey").cast("string").alias("key"), F.when(F.col("p_partkey") >= 10, up.cast("string")).alias("parent_key"), F.col("p_brand").alias("repo"))
    c, s = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("customer", "supplier"))
    chain = c.select(F.expr("concat('chain', c_custkey)"), F.expr("CASE WHEN c_custkey % 900 > 0 THEN concat('chain', c_custkey - 1) END"), "c_mktsegment")
    # the first five suppliers spawn each other in a ring, which the SQL cuts at the least key; the rest hang on it
    ring = s.select(F.expr("concat('ring', s_suppkey)"), F.expr("CASE WHEN s_suppkey > 5 THEN concat('ring', s_suppkey - 5) WHEN s_suppkey > 0 THEN concat('ring', s_suppkey % 5 + 1) END"), "s_name")
    return rows.union(chain).union(ring)


@query("d19_fleet_tree", f"""WITH RECURSIVE {FLEET},
    t AS (SELECT key, key AS top, 0 AS depth, repo FROM listed WHERE up IS NULL
    UNION ALL SELECT l.key, t.top, t.depth + 1, t.repo FROM listed l JOIN t ON t.key = l.up)
    SELECT key, top, cast(least(depth, 3) AS bigint) AS depth, repo AS top_repo FROM t""")
def _(spark, sf):
    return jb.fleet_tree(fleet(spark, sf)).select("key", "top", "depth", "top_repo")


# the order of the listing is drawn from the key; siblings and groups follow it
@query("d19_fleet_listing", f"""WITH RECURSIVE {FLEET}, r AS (SELECT key, up, repo, ('0x' || substr(md5(key), 1, 5))::BIGINT AS rank, substr(md5(key), 1, 1) IN ('0', '7') AS live FROM listed),
    t AS (SELECT key, 0 AS depth, repo, [printf('%09d', rank) || key] AS way FROM r WHERE up IS NULL
      UNION ALL SELECT r.key, t.depth + 1, t.repo, list_append(t.way, printf('%09d', rank) || r.key) FROM r JOIN t ON t.key = r.up),
    j AS (SELECT t.*, r.rank, r.live FROM t JOIN r USING (key)),
    g AS (SELECT repo, min(rank) AS first, count(*) AS n, count(*) FILTER (live) AS live FROM j GROUP BY 1),
    o AS (SELECT 'group' AS kind, repo, NULL::VARCHAR AS key, NULL::BIGINT AS depth, n, live, [printf('%09d', first) || repo] AS way FROM g
      UNION ALL SELECT 'row', repo, key, least(depth, 3)::BIGINT, NULL::BIGINT, j.live::BIGINT, list_concat([printf('%09d', first) || repo], way) FROM j JOIN g USING (repo))
    SELECT row_number() OVER (ORDER BY way) AS position, kind, repo, key, depth, n, live FROM o""")
def _(spark, sf):
    rows = fleet(spark, sf).toDF("key", "parent_key", "repo")
    digest = F.md5(F.col("key").cast("binary"))
    rows = rows.withColumns({"rank": F.conv(F.substring(digest, 1, 5), 16, 10).cast("bigint"), "live": F.substring(digest, 1, 1).isin("0", "7")})
    return jb.fleet_listing(rows).select("position", "kind", "repo", "key", "depth", "n", "live")


FEES = f"""fee0 AS (SELECT key AS sid, requests, output_tokens, list_usd, spawn_usd FROM ({all_in_sql('session')})),
    fee AS (SELECT jk.key, cast(sum(requests) AS bigint) AS requests, cast(sum(output_tokens) AS bigint) AS output_tokens, {r2('sum(list_usd)')} AS list_usd, {r2('sum(spawn_usd)')} AS spawn_usd
      FROM fee0 JOIN jk ON jk.session_id = sid GROUP BY 1)"""


@query("e22_job_list", with_ctes(SUB_TABLES + ["jobs_t", "ledger_t", "ref_t"], f"""WITH {KEYED}, {NAMED}, {EDGES}, {FEES},
    g AS (SELECT key, kind, count(*) AS sessions, count(DISTINCT root) AS incarnations, epoch_ms(min(first_ts)) AS first_ms, epoch_ms(max(act)) AS last_ms, cast(sum(lines) AS bigint) AS lines,
      count(DISTINCT well) AS wells, arg_max(session_id, act) AS latest_session, min('/u/code/' || substr(well, 9)) AS path FROM jk GROUP BY 1, 2)
    SELECT g.* EXCLUDE (path), n.name, CASE WHEN n.source IS NOT NULL THEN n.source END AS name_source, n.state, coalesce(n.cwd, path) AS repo, coalesce(fee.requests, 0) AS requests,
      coalesce(fee.output_tokens, 0) AS output_tokens, fee.list_usd, fee.spawn_usd, {r2('fee.list_usd + fee.spawn_usd')} AS all_in_usd, e.parent_key
    FROM g JOIN nj n ON n.key = g.key LEFT JOIN fee ON fee.key = g.key LEFT JOIN edges e ON e.child_key = g.key WHERE g.kind <> 'session'"""))
def _(spark, sf):
    c = corpus(spark, sf, messages=False, spawns=True).with_tables(messages=st.ref_messages(spark, sf))
    j = jb.job_list(c)
    return j.select("key", "kind", "sessions", "incarnations", F.unix_millis("first").alias("first_ms"), F.unix_millis("last").alias("last_ms"), "lines", "wells", "latest_session",
                    "name", "name_source", "state", "repo", "requests", "output_tokens", "list_usd", "spawn_usd", "all_in_usd", "parent_key")


TURNS = f"""n AS (SELECT session_id, tx, count(*) FILTER (beat = 'you') AS you, count(*) FILTER (beat = 'peer') AS peer, count(*) FILTER (beat = 'said') AS said, count(*) FILTER (beat = 'sent') AS sent FROM evn GROUP BY 1, 2),
    w AS (SELECT session_id, tx, count(DISTINCT segment) AS work FROM seg GROUP BY 1, 2),
    tn AS (SELECT session_id, tx, kind, CASE WHEN kind <> 'meta' THEN cast(sum(CASE WHEN kind <> 'meta' THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY tx) AS bigint) END AS turn_no,
      coalesce(you, 0) AS you, coalesce(n.peer, 0) AS peer, coalesce(said, 0) AS said, coalesce(sent, 0) AS sent, coalesce(work, 0) AS work
      FROM tk LEFT JOIN n USING (session_id, tx) LEFT JOIN w USING (session_id, tx)),
    jt AS (SELECT key, tn.*, row_number() OVER (PARTITION BY key ORDER BY first_ts, session_id, tx) AS position FROM tn JOIN (SELECT session_id, key, first_ts FROM jk) USING (session_id))"""


def job_corpus(spark, sf):
    return st.corpus(spark, sf).with_tables(jobs=st.jobs(spark, sf))


@query("e21_job_conversation", with_ctes(["messages_t", *BASE], f"WITH {KEYED}, {qt.ROWS}, {qt.OPENERS}, {qt.PAIRED}, {qt.EVENTS}, {TURNS} SELECT * FROM jt"))
def _(spark, sf):
    t = trc.job_conversation(job_corpus(spark, sf))
    return t.select("key", "session_id", "tx", "kind", "turn_no", "you", "peer", "said", "sent", "work", "position")


@query("e21_job_conversation_tail", with_ctes(["messages_t", *BASE], f"""WITH {KEYED}, {qt.ROWS}, {qt.OPENERS}, {qt.PAIRED}, {qt.EVENTS}, {TURNS}
    SELECT * EXCLUDE (position) FROM jt WHERE key = 'B0' ORDER BY position DESC LIMIT 9"""))
def _(spark, sf):
    t = trc.job_conversation_tail(job_corpus(spark, sf), "B0", 9)
    return t.select("key", "session_id", "tx", "kind", "turn_no", "you", "peer", "said", "sent", "work")


LANES = f"""ln AS (SELECT e.session_id, e.child_key AS key, e.parent_key, n.name, n.state, epoch_ms(e.ts) AS spawned_ms, coalesce(fee.requests, 0) AS requests, fee.list_usd, fee.spawn_usd,
      {r2('fee.list_usd + fee.spawn_usd')} AS all_in_usd FROM edges e LEFT JOIN nj n ON n.key = e.child_key LEFT JOIN fee ON fee.key = e.child_key)"""


@query("e32_lanes", with_ctes(SUB_TABLES + ["jobs_t", "ledger_t", "ref_t"], f"WITH {KEYED}, {NAMED}, {EDGES}, {FEES}, {LANES} SELECT * FROM ln"))
def _(spark, sf):
    c = corpus(spark, sf, messages=False, spawns=True).with_tables(messages=st.ref_messages(spark, sf))
    rows = jb.lanes(c)
    return rows.select("session_id", "key", "parent_key", "name", "state", F.unix_millis("spawned_at").alias("spawned_ms"), F.coalesce("requests", F.lit(0)).alias("requests"),
                       "list_usd", "spawn_usd", "all_in_usd")


LOOP_JOB = "B0"


@query("e23_loop_report", with_ctes(SUB_TABLES + ["jobs_t", "ledger_t", "ref_t"], f"""WITH {KEYED}, {NAMED}, {EDGES},
    up AS (SELECT parent_key FROM edges WHERE child_key = '{LOOP_JOB}'), m AS (SELECT child_key AS key, ts FROM edges WHERE parent_key = '{LOOP_JOB}' AND child_key NOT IN (SELECT parent_key FROM up)),
    pk AS (SELECT jk.key, max(input_tokens + cache_read_tokens + cache_write_tokens) AS peak, count(*) AS requests FROM requests_t r JOIN jk USING (session_id) WHERE ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-01-25' GROUP BY 1)
    SELECT m.key, n.name, n.state, epoch_ms(m.ts) AS spawned_ms, peak, coalesce(requests, 0) AS requests, coalesce(peak >= 30000, false) AS deep
    FROM m LEFT JOIN nj n ON n.key = m.key LEFT JOIN pk ON pk.key = m.key WHERE m.ts >= TIMESTAMP '2024-01-01' AND m.ts <= TIMESTAMP '2024-01-25'"""))
def _(spark, sf):
    c = corpus(spark, sf, messages=False, spawns=True).with_tables(messages=st.ref_messages(spark, sf))
    rows = jb.loop_report(c, LOOP_JOB, since="2024-01-01", until="2024-01-25", deep=30_000)
    return rows.select("key", "name", "state", F.unix_millis("spawned_at").alias("spawned_ms"), "peak", "requests", "deep")


@query("e24_run_report", with_ctes(BASE + ["ledger_t", "ref_t"], f"""WITH {KEYED}, {EDGES}, o AS (SELECT key, count(*) AS n FROM jk WHERE first_ts <= TIMESTAMP '2024-01-02' AND act >= TIMESTAMP '2024-01-01' GROUP BY 1),
    a AS (SELECT key, count(*) AS n FROM jk WHERE first_ts <= TIMESTAMP '2024-01-02' AND act >= TIMESTAMP '2023-12-31 23:30:00' GROUP BY 1)
    SELECT child_key AS job, parent_key, o.n AS job_sessions, coalesce(a.n, 0) AS parent_sessions FROM edges JOIN o ON o.key = child_key LEFT JOIN a ON a.key = parent_key"""))
def _(spark, sf):
    c = corpus(spark, sf, messages=False).with_tables(messages=st.ref_messages(spark, sf))
    return jb.run_report(c, "2024-01-02T00:00:00Z")


@query("e24_last_spoke", with_ctes(BASE + ["messages_t"], f"""WITH {KEYED} SELECT key, epoch_ms(max(ts) FILTER (lane = 'prompt' AND type = 'user')) AS prompt_ms, epoch_ms(max(ts) FILTER (lane = 'text')) AS text_ms,
    epoch_ms(max(ts) FILTER (tool_name = 'SendMessage')) AS sent_ms FROM (SELECT jk.key, m.* FROM messages_t m JOIN jk USING (session_id)) GROUP BY 1"""))
def _(spark, sf):
    s = jb.last_spoke(corpus(spark, sf), keyed(spark, sf))
    return s.select("key", F.unix_millis("last_prompt").alias("prompt_ms"), F.unix_millis("last_text").alias("text_ms"), F.unix_millis("last_sent").alias("sent_ms"))


@query("e28_recent_by_job", with_ctes(SUB_TABLES + ["jobs_t", "messages_t"], f"""WITH {KEYED}, n AS (SELECT * FROM jk),
    p AS (SELECT session_id, count(*) AS prompts FROM messages_t WHERE lane = 'prompt' GROUP BY 1), f AS (SELECT key AS session_id, requests, list_usd, spawn_usd FROM ({all_in_sql('session')})),
    r AS (SELECT n.*, coalesce(prompts, 0) AS prompts, requests, list_usd, spawn_usd FROM n LEFT JOIN p USING (session_id) LEFT JOIN f USING (session_id) WHERE coalesce(prompts, 0) > 0 OR requests IS NOT NULL)
    SELECT key, kind, arg_max(session_id, act) AS session_id, count(*) AS sessions, cast(sum(prompts) AS bigint) AS prompts, cast(coalesce(sum(requests), 0) AS bigint) AS requests,
      {r2('coalesce(sum(list_usd), 0)')} AS list_usd, {r2('coalesce(sum(spawn_usd), 0)')} AS spawn_usd FROM r GROUP BY 1, 2 ORDER BY max(act) DESC, key, kind LIMIT 100"""))
def _(spark, sf):
    return jb.recent_by_job(corpus(spark, sf, spawns=True)).select("key", "kind", "session_id", "sessions", "prompts", "requests", "list_usd", "spawn_usd")


@query("e30_job_day_sums", with_ctes(SUB_TABLES + ["jobs_t"], f"""WITH {KEYED}, f AS (SELECT key AS session_id, requests, list_usd FROM ({all_in_sql('session')}))
    SELECT jk.key, strftime(first_ts, '%Y-%m-%d') AS day, count(*) AS sessions, {r2('CASE WHEN count(CASE WHEN requests IS NULL THEN 0 ELSE list_usd END) = count(*) THEN sum(CASE WHEN requests IS NULL THEN 0 ELSE list_usd END) END')} AS list_usd
    FROM jk LEFT JOIN f USING (session_id) GROUP BY 1, 2"""))
def _(spark, sf):
    from logloom.plans import usage as us

    c = corpus(spark, sf, messages=False, spawns=True)
    rows = us.usage(c, "session", subagents=True).withColumnRenamed("key", "session_id").drop("sessions")
    return ses.job_day_sums(keyed(spark, sf), rows)


@query("c17_respawns", with_ctes(BASE, f"""WITH {KEYED} SELECT session_id, key, coalesce(job_session_id <> prev, false) AS respawn FROM (SELECT *, last_value(job_session_id IGNORE NULLS) OVER (PARTITION BY key ORDER BY first_ts, session_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM jk)"""))
def _(spark, sf):
    return jb.respawns(keyed(spark, sf)).select("session_id", "key", F.coalesce("respawn", F.lit(False)).alias("respawn"))


def spawn_lanes(spark, sf):
    s = st.spawn_tables(spark, sf)[0]
    start = F.unix_millis(F.least("first_ts", "last_ts"))
    return s.select(F.col("session_id").alias("parent"), F.col("agent_id").alias("lane"), start.alias("start_ms"), F.unix_millis(F.greatest("first_ts", "last_ts")).alias("end_ms"))


# one lane per parent and step, in start order; `ends` holds when each row falls free
@query("c20_lane_packing", with_ctes(["spawns_t"], """WITH RECURSIVE l AS (SELECT session_id AS parent, agent_id AS lane, epoch_ms(least(first_ts, last_ts)) AS a, epoch_ms(greatest(first_ts, last_ts)) AS z FROM spawns_t),
    b AS (SELECT *, row_number() OVER w AS i, max(z) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS busy FROM l WINDOW w AS (PARTITION BY parent ORDER BY a, lane)),
    o AS MATERIALIZED (SELECT *, sum(CASE WHEN busy > a THEN 0 ELSE 1 END) OVER (PARTITION BY parent ORDER BY i) AS cluster FROM b),
    s AS (SELECT parent, i, lane, cluster, [z] AS ends, 0 AS "row" FROM o WHERE i = 1
      UNION ALL SELECT parent, i, lane, cluster, CASE WHEN p IS NULL THEN list_append(ends, z) ELSE list_transform(ends, lambda e, j: CASE WHEN j = p THEN z ELSE e END) END, coalesce(p - 1, len(ends))
      FROM (SELECT o.parent, o.i, o.lane, o.cluster, o.z, s.ends, nullif(list_position(list_transform(s.ends, lambda e: e <= o.a), true), 0) AS p FROM s JOIN o ON o.parent = s.parent AND o.i = s.i + 1))
    SELECT parent, cast(cluster AS bigint) AS cluster, lane, cast("row" AS int) AS "row" FROM s"""))
def _(spark, sf):
    return packing.pack(spawn_lanes(spark, sf))


@query("c20_concurrency_peak", with_ctes(["spawns_t"], """WITH l AS (SELECT session_id AS parent, least(first_ts, last_ts) AS a, greatest(first_ts, last_ts) AS b FROM spawns_t),
    e AS (SELECT parent, a AS at_, 1 AS step FROM l UNION ALL SELECT parent, b, -1 FROM l) SELECT parent, cast(max(o) AS bigint) AS peak FROM (
      SELECT parent, sum(step) OVER (PARTITION BY parent ORDER BY at_, step RANGE UNBOUNDED PRECEDING) AS o FROM e) GROUP BY 1"""))
def _(spark, sf):
    return packing.concurrency_peak(spawn_lanes(spark, sf))


@query("b10_bridge_ids", "SELECT c_custkey, 'B' || cast(c_custkey AS string) AS key FROM customer")
def _(spark, sf):
    c = spark.read.parquet(f"{sf}/customer.parquet")
    heads = F.array(*[F.lit(h) for h in ("cse_", "session_", "https://host.example/code/session_", "")])
    raw = F.concat(F.element_at(heads, (F.col("c_custkey") % 4 + 1).cast("int")), F.lit("B"), F.col("c_custkey").cast("string"))
    return c.select("c_custkey", env.bridge_key(raw).alias("key"))


@query("b11_slugs_and_repos", """SELECT page_id, regexp_replace('/home/' || url, '[^a-zA-Z0-9]', '-', 'g') AS slug, '/home/' || split_part(url, '?', 1) AS repo FROM pages""")
def _(spark, sf):
    p = spark.read.parquet(f"{sf}/pages.parquet")
    path = F.concat(F.lit("/home/"), F.col("url"))
    tree = F.concat(F.lit("/home/"), F.split_part("url", F.lit("?"), F.lit(1)), F.lit("/.claude/worktrees/x"))
    return p.select("page_id", slug(path).alias("slug"), env.repo_of(tree).alias("repo"))


@query("b29_display_names", "SELECT c_custkey, 'repo' || cast(c_custkey AS string) || ' · att' AS path, 'fun/repo' || cast(c_custkey AS string) || ' · att' AS well FROM customer")
def _(spark, sf):
    c = spark.read.parquet(f"{sf}/customer.parquet")
    n = F.col("c_custkey").cast("string")
    return c.select("c_custkey", env.short_path(F.concat(F.lit("/Users/u/code/repo"), n, F.lit("/.claude/worktrees/att"))).alias("path"),
                    env.short_well(F.concat(F.lit("-Users-u-code-fun-repo"), n, F.lit("--claude-worktrees-att"))).alias("well"))


@query("b30_context_bands", "SELECT o_orderkey, CASE WHEN o_totalprice * 2 >= 800000 THEN 'full' WHEN o_totalprice * 2 >= 600000 THEN 'high' END AS band FROM orders")
def _(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet")
    return o.select("o_orderkey", jb.context_band(F.col("o_totalprice") * 2).alias("band"))
