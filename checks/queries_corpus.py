"""Sources, sinks, documents, release notes and table keeping."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import standins as st
from checks.registry import query
from checks.standins import with_ctes
from logloom.operators.stages import shared_folder
from logloom.plans import denials as dn, documents as dc, spawns as sp
from logloom.sources import refresh as rf, side_files as sd, transcripts as tr, wells as wl

FILES = """files AS (SELECT '/logs/' || well || '/' || session_id || '.jsonl' AS file_path, well, session_id, lines * 100 AS size, epoch_ms(last_ts) AS mtime_ms FROM sessions_t)"""


def files(spark, sf):
    s = st.corpus(spark, sf, messages=False).sessions
    path = F.concat(F.lit("/logs/"), "well", F.lit("/"), "session_id", F.lit(".jsonl"))
    return s.select(path.alias("file_path"), "well", "session_id", (F.col("lines") * 100).alias("size"), F.unix_millis("last_ts").alias("mtime_ms"))


def table(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def as_lines(df, value):
    return df.select(value.alias("value"), F.lit(0).cast("bigint").alias("block_start"), F.col("seq").alias("row_seq"))


@query("a02_well_discovery", with_ctes(["sessions_t"], f"""WITH {FILES} SELECT well AS dir, count(*) AS sessions, cast(sum(size) AS bigint) AS bytes, well IN ('-u-code-w1', '-u-code-w5') AS has_memory,
    arg_max(session_id, mtime_ms) AS newest_session, false AS is_worktree FROM files GROUP BY 1"""))
def _(spark, sf):
    f = files(spark, sf)
    memory = f.filter(F.col("well").isin("-u-code-w1", "-u-code-w5")).select(F.concat(F.lit("/logs/"), "well", F.lit("/memory/note.md")).alias("file_path"), "size", "mtime_ms").distinct()
    return wl.discover(f.select("file_path", "size", "mtime_ms").unionByName(memory))


@query("a03_real_paths", with_ctes(["rec"], "SELECT well, '/u/code/' || substr(well, 9) AS real_path FROM rec WHERE k % 17 <> 0 GROUP BY 1"))
def _(spark, sf):
    e = st.event_entries(spark, sf).withColumn("mtime_ms", F.unix_millis("ts"))
    return wl.real_paths(e.select("well", "cwd", "mtime_ms", "line_no"))


@query("a04_deslugged_paths", "SELECT '-home-' || regexp_replace(url, '[^a-zA-Z0-9]', '-', 'g') AS dir, min('/home/' || url) AS real_path FROM pages GROUP BY 1")
def _(spark, sf):
    known = table(spark, sf, "pages").select(F.concat(F.lit("/home/"), "url").alias("path"))
    dirs = known.select(F.regexp_replace("path", "[^a-zA-Z0-9]", "-").alias("dir"), F.lit(None).cast("string").alias("real_path")).distinct()
    return wl.deslugged(dirs, known)


@query("a05_history_scan", "SELECT cast(conv_id * 1000 + turn AS string) AS ts, 'p' || cast(conv_id % 5 AS string) AS project, 's' || cast(conv_id AS string) AS session_id, text AS display FROM conversations WHERE role = 'user' AND turn <> 4")
def _(spark, sf):
    c = table(spark, sf, "conversations").filter("role = 'user'").withColumn("seq", F.col("conv_id") * 1000 + F.col("turn"))
    line = F.to_json(F.struct(F.col("text").alias("display"), F.concat(F.lit("p"), (F.col("conv_id") % 5).cast("string")).alias("project"),
                              F.concat(F.lit("s"), F.col("conv_id").cast("string")).alias("sessionId"), F.col("seq").alias("timestamp")))
    torn = F.when(F.col("turn") == 4, F.substring(line, F.lit(1), F.length(line) - 3)).otherwise(line)
    return sd.history(as_lines(c, torn))


@query("a06_limit_log", with_ctes(["limits_t"], "SELECT session_id, epoch_ms(ts) AS ts_ms, kind, pct, CASE WHEN seq % 10 <> 6 THEN epoch_ms(resets_at) END AS resets_ms FROM limits_t WHERE seq % 10 NOT IN (3, 5, 7)"))
def _(spark, sf):
    l = st.limits(spark, sf)
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    line = F.to_json(F.struct(F.when(F.col("seq") % 10 == 5, "not a time").when(F.col("seq") % 10 == 4, F.unix_millis("ts").cast("string")).otherwise(iso("ts")).alias("ts"), F.col("session_id").alias("session"),
                                F.when(F.col("seq") % 10 != 3, F.col("kind")).alias("kind"), "pct", F.when(F.col("seq") % 10 == 6, "soon").otherwise(iso("resets_at")).alias("resetsAt")))
    torn = F.when(F.col("seq") % 10 == 7, F.substring(line, 1, 25)).otherwise(line)
    rows = sd.limit_log(as_lines(l, torn))
    return rows.select("session_id", F.unix_millis("ts").alias("ts_ms"), "kind", "pct", F.unix_millis("resets_at").alias("resets_ms"))


@query("a07_refusals", with_ctes(["limits_t"], "SELECT session_id, epoch_ms(ts) AS ts_ms, kind, 100.0::double AS pct, epoch_ms(resets_at) AS resets_ms FROM limits_t WHERE source = 'transcript' AND kind <> 'spend_limit'"))
def _(spark, sf):
    l = st.limits(spark, sf).filter("source = 'transcript' AND kind <> 'spend_limit'")
    line = F.to_json(F.struct(F.lit("assistant").alias("type"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("timestamp"), F.lit("usage_limit_reached").alias("apiError"),
                              F.struct(F.lit("<synthetic>").alias("model")).alias("message"),
                              F.struct(F.struct(F.col("kind").alias("rateLimitType"), F.unix_seconds("resets_at").alias("resetsAt")).alias("rate_limit_info")).alias("apiErrorParams")))
    lines = l.select(line.alias("value"), F.concat(F.lit("/logs/w/"), "session_id", F.lit(".jsonl")).alias("file_path"), F.lit(0).cast("bigint").alias("block_start"), F.col("seq").alias("row_seq"))
    rows = tr.refusals_of(tr.entries_of(tr.number_records(tr.parse_lines(tr.session_lines(lines)))))
    return rows.select("session_id", F.unix_millis("ts").alias("ts_ms"), "kind", "pct", F.unix_millis("resets_at").alias("resets_ms"))


def ledger_text(spark, sf):
    l = st.ledger(spark, sf)
    odd = F.col("seq") % 11
    line = F.to_json(F.struct(F.when(odd == 1, 2).otherwise(1).alias("v"), F.when(odd == 2, F.lit("soon")).otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("ts"),
                              F.when(odd == 3, F.lit("join")).otherwise(F.col("kind")).alias("kind"), "child",
                              F.struct(F.col("parent_job").alias("job"), F.col("parent_session").alias("session"), F.col("parent_bridge").alias("bridge")).alias("parent")))
    return sd.ledger_lines(as_lines(l, F.when(odd == 4, F.substring(line, 1, 30)).otherwise(line)))


@query("a08_ledger_scan", with_ctes(["ledger_t"], "SELECT child, kind, epoch_ms(ts) AS ts_ms, parent_job, parent_session, parent_bridge FROM ledger_t WHERE seq % 11 NOT IN (1, 2, 3, 4)"))
def _(spark, sf):
    rows = sd.ledger_append(None, ledger_text(spark, sf))
    return rows.select("child", "kind", F.unix_millis("ts").alias("ts_ms"), "parent_job", "parent_session", "parent_bridge")


@query("a08_ledger_counters", "SELECT count(*) AS lines, count(*) FILTER (p_partkey % 11 = 1) AS version, count(*) FILTER (p_partkey % 11 = 3) AS kind, count(*) FILTER (p_partkey % 11 IN (2, 4)) AS malformed FROM part")
def _(spark, sf):
    return sd.ledger_stats(ledger_text(spark, sf))


@query("a08_ledger_append", with_ctes(["ledger_t"], """SELECT child, epoch_ms(ts) AS ts_ms, CASE WHEN seq % 4 = 0 THEN 'old' ELSE kind END AS kind FROM ledger_t WHERE seq % 11 NOT IN (1, 2, 3, 4) OR seq % 4 = 0"""))
def _(spark, sf):
    old = st.ledger(spark, sf).filter("seq % 4 = 0").withColumn("kind", F.lit("old"))
    for c in sd.LEDGER_COLUMNS:
        if c not in old.columns:
            old = old.withColumn(c, F.lit(None).cast("boolean" if c == "draft" else "string"))
    rows = sd.ledger_append(old.select(*sd.LEDGER_COLUMNS), ledger_text(spark, sf))
    return rows.select("child", F.unix_millis("ts").alias("ts_ms"), "kind")


@query("a09_job_snapshot", with_ctes(["jobs_t"], """SELECT job_id, CASE WHEN n % 3 <> 1 THEN 'new' || name ELSE name END AS name, CASE WHEN n % 3 <> 1 THEN 'working' WHEN source = 'state' THEN 'gone' ELSE state END AS state,
    CASE WHEN n % 3 = 0 THEN 'state' ELSE source END AS source FROM (SELECT *, row_number() OVER (ORDER BY job_id) - 1 AS n FROM jobs_t)""".replace("n % 3 = 0 THEN 'state'", "n % 3 = 0 THEN 'state'")))
def _(spark, sf):
    n = F.conv("job_id", 16, 10).cast("bigint") / 3 % 3
    old = st.jobs(spark, sf).withColumn("n", n).filter("n <> 0").drop("n")
    new = st.jobs(spark, sf).withColumn("n", n).filter("n <> 1").withColumn("name", F.concat(F.lit("new"), "name"))
    body = F.to_json(F.struct(F.col("session_id").alias("sessionId"), F.col("bridge_key").alias("bridgeSessionId"), "name", "cwd", F.lit("working").alias("state")))
    snap = sd.job_states(new.select(F.concat(F.lit("/jobs/"), "job_id", F.lit("/state.json")).alias("file_path"), body.alias("value")))
    return sd.upsert_jobs(old, snap.select(*old.columns)).select("job_id", "name", "state", "source")


@query("a10_spawn_sidecars", "SELECT 'a' || cast(o_orderkey AS string) AS agent_id, CASE WHEN o_orderkey % 9 <> 0 THEN o_orderpriority END AS agent_type, CASE WHEN o_orderkey % 9 <> 0 THEN 'alpha' END AS requested_model FROM orders")
def _(spark, sf):
    o = table(spark, sf, "orders")
    body = F.to_json(F.struct(F.col("o_orderpriority").alias("agentType"), F.lit("alpha").alias("model")))
    torn = F.when(F.col("o_orderkey") % 9 == 0, F.substring(body, 1, 12)).otherwise(body)
    path = F.concat(F.lit("/logs/w/s/subagents/agent-a"), F.col("o_orderkey").cast("string"), F.lit(".meta.json"))
    return sd.spawn_meta(o.select(path.alias("file_path"), torn.alias("value"))).select("agent_id", "agent_type", "requested_model")


@query("a10_spawn_paths", "SELECT 'a' || cast(o_orderkey AS string) AS agent_id, 'w' || cast(o_custkey % 9 AS string) AS well, 's' || cast(o_custkey AS string) AS session_id, CASE WHEN o_orderstatus = 'P' THEN 'wf_7' END AS workflow_run_id FROM orders")
def _(spark, sf):
    o = table(spark, sf, "orders")
    run = F.when(F.col("o_orderstatus") == "P", F.lit("workflows/wf_7/")).otherwise("")
    path = F.concat(F.lit("/logs/w"), (F.col("o_custkey") % 9).cast("string"), F.lit("/s"), F.col("o_custkey").cast("string"), F.lit("/subagents/"), run, F.lit("agent-a"), F.col("o_orderkey").cast("string"), F.lit(".jsonl"))
    return tr.spawn_lines(o.select(path.alias("file_path"))).select("agent_id", "well", "session_id", "workflow_run_id")


@query("a11_b23_b27_workflow_runs", """SELECT 'wf_' || cast(p_partkey AS string) AS run_id, 'w' AS well_dir, 's1' AS session_id, CASE WHEN p_partkey % 5 <> 0 THEN p_name END AS name,
    CASE WHEN p_partkey % 5 <> 0 THEN 'find {' || p_type || '} parts' END AS description, CASE WHEN p_partkey % 5 <> 0 THEN 'scan — read } all|' || p_brand END AS phases,
    CASE WHEN p_partkey % 4 IN (1, 2) THEN 1704067200000 + p_partkey * 1000 END AS recorded_ms FROM part WHERE p_partkey % 8 <> 3""")
def _(spark, sf):
    p = table(spark, sf, "part")
    meta = F.concat(F.lit("export const meta = { name: '"), "p_name", F.lit("', description: \"find {"), "p_type",
                    F.lit("} parts\", phases: [ { title: 'scan', detail: `read } all` }, { title: '"), "p_brand", F.lit("' } ] }\nrun({ name: 'other' })"))
    script = F.when(F.col("p_partkey") % 5 != 0, meta).otherwise("run()")
    run = F.concat(F.lit("wf_"), F.col("p_partkey").cast("string"))
    ms = F.lit(1704067200000) + F.col("p_partkey") * 1000
    at = F.when(F.col("p_partkey") % 4 == 1, ms.cast("string")).when(F.col("p_partkey") % 4 == 2, F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(F.col("p_partkey") % 4 == 3, "9" * 30)
    body = F.to_json(F.struct(run.alias("runId"), script.alias("script"), at.alias("timestamp")))
    torn = F.when(F.col("p_partkey") % 8 == 3, F.substring(body, 1, 20)).otherwise(body)
    rows = sd.workflow_runs(p.select(F.concat(F.lit("/logs/w/s1/workflows/"), run, F.lit(".json")).alias("file_path"), torn.alias("value")))
    return rows.select("run_id", "well_dir", "session_id", "name", "description", F.array_join(sp.phase_labels(F.col("phases")), "|").alias("phases"), F.unix_millis("recorded_ts").alias("recorded_ms"))


# --- documents -------------------------------------------------------------------------

REPO = """refs AS (SELECT source AS repo, CASE WHEN doc_id % 2 = 0 THEN 'local' ELSE 'remote' END AS side, max(doc_id) AS commit_ts, count(*) FILTER (lang = 'fr') AS docs FROM documents WHERE lang <> 'de' OR doc_id % 2 = 1 GROUP BY 1, 2),
    cr AS (SELECT repo, max(CASE WHEN side = 'local' THEN commit_ts END) AS lt, max(CASE WHEN side = 'remote' THEN commit_ts END) AS rt, max(CASE WHEN side = 'local' THEN docs END) AS ld, max(CASE WHEN side = 'remote' THEN docs END) AS rd FROM refs GROUP BY 1),
    ch AS (SELECT repo, lt IS NULL OR coalesce(rt > lt, false) AS rem, * EXCLUDE (repo) FROM cr)"""


def refs(spark, sf):
    d = table(spark, sf, "documents").filter("lang <> 'de' OR doc_id % 2 = 1")
    side = F.when(F.col("doc_id") % 2 == 0, "local").otherwise("remote")
    return d.groupBy(F.col("source").alias("repo"), side.alias("side")).agg(
        F.max("doc_id").alias("commit_ts"), F.sum((F.col("lang") == "fr").cast("bigint")).alias("docs")).withColumns(
        {"ref": F.when(F.col("side") == "local", "HEAD").otherwise("origin/main"), "sha": F.concat(F.lit("c"), F.col("commit_ts").cast("string"))})


@query("a13_ref_choice", f"""WITH {REPO} SELECT repo, CASE WHEN rem THEN 'origin/main' ELSE 'HEAD' END AS ref, CASE WHEN rem THEN rt ELSE lt END AS commit_ts, coalesce(rem AND rd > 0 AND coalesce(ld, 0) = 0, false) AS is_husk FROM ch""")
def _(spark, sf):
    return dc.choose_refs(refs(spark, sf)).select("repo", "ref", "commit_ts", "is_husk")


def owned(spark, sf):
    d = table(spark, sf, "documents")
    per = d.groupBy(F.col("source").alias("repo")).agg(F.max(F.col("doc_id") % 7 == 0).alias("up"), F.sum((F.col("lang") == "en").cast("bigint")).alias("authored"))
    no = F.regexp_extract("repo", "([0-9]+)", 1).cast("int")
    return per.withColumn("ownership", dc.ownership(no % 6 == 0, F.when(no % 5 != 0, "me@example.com"), F.when(no % 3 != 0, F.col("authored"))))


OWN = "CASE WHEN n % 6 = 0 THEN 'foreign' WHEN n % 5 <> 0 AND n % 3 <> 0 THEN 'mine' ELSE 'assisted' END"


@query("a14_ownership", f"SELECT repo, {OWN} AS ownership FROM (SELECT DISTINCT source AS repo, cast(regexp_extract(source, '([0-9]+)', 1) AS int) AS n FROM documents)")
def _(spark, sf):
    return owned(spark, sf).select("repo", "ownership")


def blobs(spark, sf):
    d = table(spark, sf, "documents")
    path = F.concat(F.when(F.col("doc_id") % 10 == 0, F.lit("node_modules/")).otherwise(""), F.lit("docs/d"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 4 == 0, ".txt").otherwise(".md"))
    return d.select(F.col("source").alias("repo"), F.lit("HEAD").alias("ref"), path.alias("path"), (F.col("n_chars") * 500).alias("size"), "text", "doc_id")


REPOS_NOW = f"rn AS (SELECT repo, {OWN} AS ownership, n FROM (SELECT DISTINCT source AS repo, cast(regexp_extract(source, '([0-9]+)', 1) AS int) AS n FROM documents) WHERE n % 4 <> 1)"
KEPT = "doc_id % 4 <> 0 AND doc_id % 10 <> 0 AND n_chars * 500 <= 2000000"


@query("a12_document_index", f"""WITH {REPOS_NOW} SELECT doc_id, rn.repo, n_chars * 500 AS size FROM documents JOIN rn ON rn.repo = source AND ownership <> 'foreign' WHERE {KEPT}""")
def _(spark, sf):
    no = F.regexp_extract("repo", "([0-9]+)", 1).cast("int")
    repos = owned(spark, sf).withColumns({"ref": F.lit("HEAD"), "sha": F.concat(F.lit("s"), "repo")})
    known = repos.filter(no % 4 == 1)  # unchanged since the last run: skipped
    changed, docs = dc.index_documents(repos, blobs(spark, sf), known, max_bytes=2_000_000)
    return docs.select("doc_id", "repo", "size")


@query("a12_document_refresh", f"""SELECT doc_id, repo FROM (SELECT doc_id, source AS repo, cast(regexp_extract(source, '([0-9]+)', 1) AS int) AS n, n_chars FROM documents)
    WHERE n <> 3 AND CASE WHEN n % 4 <> 1 THEN NOT (n % 6 = 0) AND {KEPT} ELSE true END""")
def _(spark, sf):
    no = F.regexp_extract("repo", "([0-9]+)", 1).cast("int")
    repos = owned(spark, sf).withColumns({"ref": F.lit("HEAD"), "sha": F.concat(F.lit("s"), "repo")}).filter(no != 3)  # repository 3 vanished
    old = blobs(spark, sf).select("repo", "doc_id")
    changed, fresh = dc.index_documents(repos, blobs(spark, sf), repos.filter(no % 4 == 1), max_bytes=2_000_000)
    return dc.refreshed_documents(old, changed, fresh, repos).select("doc_id", "repo")


@query("e15_repo_list", f"SELECT source AS repo, count(*) AS docs, cast(sum(n_chars) * 500 AS bigint) AS bytes FROM documents GROUP BY 1")
def _(spark, sf):
    repos = owned(spark, sf).withColumn("sha", F.lit("0123456789"))
    return dc.repo_list(repos, blobs(spark, sf)).select("repo", "docs", "bytes")


# --- release notes ----------------------------------------------------------------------

def note_lines(spark, sf):
    """Each source is a change log: a heading every tenth document, an entry per document."""
    d = table(spark, sf, "documents")
    n = F.col("doc_id")
    entry = F.element_at(F.array(F.lit("- Added daemon respawn"), F.lit("- [VSCode] Fixed transcripts"), F.lit("- Windows: Improved cache"), F.lit("- Weird worktree hooks"), F.lit("plain line")), (n % 5 + 1).cast("int"))
    head = F.concat(F.lit("## 2."), F.floor(n / 100).cast("string"), F.lit("."), (F.floor(n / 10) % 10).cast("string"))
    value = F.when(n % 10 == 0, head).otherwise(F.concat(entry, F.lit(" "), n.cast("string")))
    return d.select(F.lit("notes").alias("doc"), F.floor(n / 64).cast("bigint").alias("block_start"), n.alias("row_seq"), value.alias("value"))


NOTES = """nt AS (SELECT doc_id AS n, '2.' || cast(doc_id // 100 AS string) || '.' || cast(doc_id // 10 % 10 AS string) AS version, doc_id // 10 AS ord,
      CASE doc_id % 5 WHEN 1 THEN 'vscode' WHEN 2 THEN 'windows' ELSE 'cli' END AS surface, CASE doc_id % 5 WHEN 0 THEN 'added' WHEN 1 THEN 'fixed' WHEN 2 THEN 'improved' ELSE 'other' END AS kind,
      CASE doc_id % 5 WHEN 0 THEN 'daemon' WHEN 1 THEN 'transcript' WHEN 2 THEN 'usage' ELSE 'worktree,config' END AS topics FROM documents WHERE doc_id % 10 <> 0 AND doc_id % 5 <> 4)"""


@query("a15_release_notes", f"WITH {NOTES} SELECT n, version, surface, kind, topics FROM nt")
def _(spark, sf):
    e = dc.release_entries(note_lines(spark, sf))
    return e.select(F.col("row_seq").alias("n"), "version", "surface", "kind", F.array_join("topics", ",").alias("topics"))


@query("e27_release_status", f"""WITH {NOTES} SELECT version, count(*) AS entries, count(*) FILTER (surface = 'cli') AS cli, count(*) FILTER (surface = 'cli' AND kind = 'added') AS added, count(*) FILTER (surface = 'cli' AND kind = 'other') AS other
    FROM nt WHERE ord > 2 AND ord <= 15 GROUP BY 1""")
def _(spark, sf):
    return dc.release_status(dc.release_entries(note_lines(spark, sf)), "2.0.2", "2.1.5").select("version", "entries", "cli", "added", "other")


@query("e27_notes_query", f"WITH {NOTES} SELECT n, version FROM nt WHERE ord > 2 AND ord <= 15 AND surface = 'cli' AND kind = 'other' AND topics LIKE '%worktree%' AND cast(n AS string) LIKE '%3%'")
def _(spark, sf):
    rows = dc.query_notes(dc.release_entries(note_lines(spark, sf)), "2.0.2", "2.1.5", kind="other", topic="worktree", grep="3")
    return rows.select(F.col("row_seq").alias("n"), "version")


@query("e27_surface_and_topic_counts", f"""WITH {NOTES} SELECT surface AS name, count(*) AS n FROM nt WHERE ord > 2 AND ord <= 15 GROUP BY 1
    UNION ALL SELECT t, count(*) FROM (SELECT unnest(string_split(topics, ',')) AS t FROM nt WHERE ord > 2 AND ord <= 15 AND surface = 'cli') GROUP BY 1""")
def _(spark, sf):
    e = dc.release_entries(note_lines(spark, sf))
    t = dc.topic_counts(e, "2.0.2", "2.1.5").groupBy(F.col("topic").alias("name")).agg(F.sum("n").alias("n"))
    return dc.surface_counts(e, "2.0.2", "2.1.5").withColumnRenamed("surface", "name").unionByName(t)


@query("b24_version_compare", """SELECT p_partkey, CASE WHEN p_partkey < 777 THEN -1 WHEN p_partkey > 777 THEN 1 ELSE 0 END AS cmp, p_partkey < 777 AS behind FROM part""")
def _(spark, sf):
    p = table(spark, sf, "part")
    n = F.col("p_partkey")
    v = F.concat(F.floor(n / 100).cast("string"), F.lit("."), (F.floor(n / 10) % 10).cast("string"), F.lit("."), (n % 10).cast("string"))
    return p.select("p_partkey", dc.compare_versions(v, F.lit("7.7.7")).alias("cmp"), (dc.compare_versions(v, F.lit("7.7.7.0")) < 0).alias("behind"))


@query("e27_worker_drift", "SELECT s_suppkey, s_suppkey % 4 < 2 AS behind FROM supplier WHERE s_suppkey % 4 <> 2")
def _(spark, sf):
    w = table(spark, sf, "supplier").select("s_suppkey", F.concat(F.lit("2.1."), (F.col("s_suppkey") % 4).cast("string")).alias("version"))
    return dc.worker_drift(w, "2.1.2").select("s_suppkey", "behind")


# --- keeping the tables --------------------------------------------------------------------

@query("a16_denial_file_scan", with_ctes(["ev"], "SELECT session_id, count(*) AS lines FROM ev WHERE session_id IN (SELECT session_id FROM ev WHERE et = 'error' AND k = 50) GROUP BY 1"))
def _(spark, sf):
    ev = table(spark, sf, "events").selectExpr(*[f"{e} AS {n}" for n, e in st.event_base("spark").items()])
    line = F.to_json(F.struct(F.lit("user").alias("type"), F.when((F.col("et") == "error") & (F.col("k") == 50), "automode-blocked").alias("toolDenialKind")))
    return dn.matching_files(ev.select(F.col("session_id").alias("file_path"), line.alias("value"))).groupBy(F.col("file_path").alias("session_id")).agg(F.count("*").alias("lines"))


SPLIT = "(SELECT max(event_id) * 9 // 10 FROM events)"


def versions(spark, sf):
    """File versions before and after the last tenth of the events was appended."""
    ev = table(spark, sf, "events").select("user_id", "event_id", "ts")
    cut = ev.agg(F.floor(F.max("event_id") * 9 / 10)).scalar()
    per = lambda df: df.groupBy(F.col("user_id").cast("string").alias("file_path")).agg(F.count("*").alias("size"), F.unix_millis(F.max(F.col("ts").cast("timestamp"))).alias("mtime_ms"))
    return per(ev.withColumn("cut", cut).filter("event_id <= cut")), per(ev)


@query("a17_changed_files", f"SELECT cast(user_id AS string) AS file_path FROM events WHERE event_id > {SPLIT} GROUP BY 1")
def _(spark, sf):
    old, now = versions(spark, sf)
    return rf.changed_files(now, old).select("file_path")


@query("a17_refresh_counters", f"SELECT count(DISTINCT user_id) FILTER (event_id > {SPLIT}) AS indexed, count(DISTINCT user_id) - count(DISTINCT user_id) FILTER (event_id > {SPLIT}) AS skipped, count(*) AS messages FROM events")
def _(spark, sf):
    old, now = versions(spark, sf)
    return rf.refresh_counters(now, old, table(spark, sf, "events"))


@query("a17_incremental_rows", "SELECT event_id, user_id FROM events")
def _(spark, sf):
    old, now = versions(spark, sf)
    ev = table(spark, sf, "events").select("event_id", F.col("user_id").cast("string").alias("file_path"))
    changed = rf.changed_files(now, old)
    before = ev.withColumn("cut", ev.agg(F.floor(F.max("event_id") * 9 / 10)).scalar()).filter("event_id <= cut").drop("cut")
    fresh = ev.join(changed.select("file_path"), "file_path", "left_semi").select("event_id", "file_path")
    return rf.replaced(before, fresh, changed, "file_path").select("event_id", F.col("file_path").cast("bigint").alias("user_id"))


@query("a18_archive_mirror", f"SELECT count(DISTINCT user_id) AS files, cast(sum(n) AS bigint) AS bytes FROM (SELECT user_id, count(*) AS n FROM events WHERE user_id IN (SELECT user_id FROM events WHERE event_id > {SPLIT}) GROUP BY 1)")
def _(spark, sf):
    old, now = versions(spark, sf)
    return rf.mirror(old, now, F.lit("2024-02-01").cast("timestamp"))[1].select("files", "bytes")


PURGE = "00000006-s"


def purge_corpus(spark, sf):
    return st.corpus(spark, sf, spawns=True).with_tables(jobs=st.jobs(spark, sf), limits=st.limits(spark, sf))


@query("a19_purge_dry_run", with_ctes(["sessions_t", "messages_t", "requests_t", "spawns_t", "sreq_t", "limits_t", "jobs_t"], f"""SELECT 'sessions' AS "table", count(*) AS rows FROM sessions_t WHERE session_id = '{PURGE}'
    UNION ALL SELECT 'messages', count(*) FROM messages_t WHERE session_id = '{PURGE}' UNION ALL SELECT 'requests', count(*) FROM requests_t WHERE session_id = '{PURGE}'
    UNION ALL SELECT 'spawns', count(*) FROM spawns_t WHERE session_id = '{PURGE}' UNION ALL SELECT 'spawn_requests', count(*) FROM sreq_t WHERE session_id = '{PURGE}'
    UNION ALL SELECT 'limits', count(*) FROM limits_t WHERE session_id = '{PURGE}' AND source = 'transcript'
    UNION ALL SELECT 'jobs', count(*) FROM jobs_t j WHERE session_id = '{PURGE}' AND NOT EXISTS (SELECT 1 FROM sessions_t s WHERE s.session_id <> '{PURGE}' AND (s.job_session_id = j.session_id OR s.bridge_key = j.bridge_key))"""))
def _(spark, sf):
    return rf.purge_report(purge_corpus(spark, sf), PURGE)


@query("a19_purge", with_ctes(["messages_t", "limits_t"], f"""SELECT session_id, count(*) AS n, 'messages' AS t FROM messages_t WHERE session_id <> '{PURGE}' GROUP BY 1 UNION ALL
    SELECT session_id, count(*), 'limits' FROM limits_t WHERE NOT (session_id = '{PURGE}' AND source = 'transcript') GROUP BY 1"""))
def _(spark, sf):
    c = rf.purge(purge_corpus(spark, sf), PURGE)
    n = lambda df, t: df.groupBy("session_id").agg(F.count("*").alias("n")).withColumn("t", F.lit(t))
    return n(c.messages, "messages").unionByName(n(c.limits, "limits"))


@query("a20_redacted_snapshot", """SELECT doc_id, '/Users/u/' || source AS path, 'x-Users-u-' || source AS slug, CASE WHEN lang = 'en' THEN '' ELSE 'label' END AS label, length(text) AS text_chars FROM documents""")
def _(spark, sf):
    d = table(spark, sf, "documents")
    rows = d.select("doc_id", F.concat(F.lit("/home/me/"), "source").alias("path"), F.concat(F.lit("x-home-me-"), "source").alias("slug"),
                    F.when(F.col("lang") == "en", "").otherwise(F.col("lang")).alias("label"), F.lit("hush").alias("api_secret"), "text")
    return rf.redacted(rows, "/home/me")


_BRIEF = "concat('/home/me/', text)"


@query("a20_redacted_nested", f"""SELECT doc_id, 'https://example.invalid/link' AS href, CASE WHEN doc_id % 2 = 0 THEN 'frame' ELSE source END AS title, CASE WHEN doc_id % 2 = 0 THEN 'frame.html' ELSE doc_id::VARCHAR END AS id,
    CASE WHEN length({_BRIEF}) > 200 THEN concat(replace(substr({_BRIEF}, 1, 48), '/home/me', '/Users/u'), '…') ELSE replace({_BRIEF}, '/home/me', '/Users/u') END AS arg,
    'question' AS question, '/Users/u/a' AS kept, 1 AS n_keys, 'kind,title,href,id' AS fields FROM documents""")
def _(spark, sf):
    kind = F.when(F.col("doc_id") % 2 == 0, "frame").otherwise("shell")
    child = F.struct(kind.alias("kind"), F.col("source").alias("title"), F.col("text").alias("href"), F.col("doc_id").cast("string").alias("id"), F.col("text").alias("api_secret"))
    state = F.struct(F.array(child).alias("children"), F.struct(F.array(F.concat(F.lit("/home/me/"), "text")).alias("args")).alias("launch"),
                     F.array(F.struct(F.col("text").alias("question"))).alias("questions"), F.create_map(F.lit("at"), F.lit("/home/me/a"), F.lit("Password"), F.col("text")).alias("env"))
    rows = table(spark, sf, "documents").select("doc_id", state.alias("state"))
    typed = rf.redacted(rows, "/home/me").select("doc_id", F.col("state.children")[0].alias("child"), F.col("state.launch.args")[0].alias("arg"),
                                                F.col("state.questions")[0]["question"].alias("question"), F.col("state.env").alias("env"))
    return typed.select("doc_id", "child.href", "child.title", "child.id", "arg", "question", F.col("env")["at"].alias("kept"), F.size("env").alias("n_keys"),
                        F.array_join(F.json_object_keys(F.to_json("child")), ",").alias("fields"))


@query("a20_redacted_json", """SELECT doc_id, '/Users/u/' || source AS path, 'label' AS label, CASE WHEN text = '' THEN '' ELSE 'question' END AS question, source AS title, 1.5::DOUBLE AS n, 'id,unknown,title,question,n' AS keys,
    'path,list' AS inner_keys, 'label' AS innermost_keys, NULL::VARCHAR AS secret FROM documents""")
def _(spark, sf):
    deep = F.struct(F.concat(F.lit("/home/me/"), "source").alias("path"), F.col("text").alias("password"), F.array(F.struct(F.coalesce("lang", F.lit("x")).alias("label"), F.col("text").alias("api_secret"))).alias("list"))
    said = F.to_json(F.struct(F.col("doc_id").alias("id"), deep.alias("unknown"), F.col("source").alias("title"), F.col("text").alias("question"), F.lit(1.5).alias("n"), F.col("text").alias("token")))
    rows = rf.redacted(table(spark, sf, "documents").select("doc_id", said.alias("state")), "/home/me", json={"state": None})
    at = lambda path: F.get_json_object("state", path)
    keys = lambda x: F.array_join(F.json_object_keys(x), ",")
    return rows.select("doc_id", at("$.unknown.path").alias("path"), at("$.unknown.list[0].label").alias("label"), at("$.question").alias("question"), at("$.title").alias("title"), at("$.n").cast("double").alias("n"),
                       keys(F.col("state")).alias("keys"), keys(at("$.unknown")).alias("inner_keys"), keys(at("$.unknown.list[0]")).alias("innermost_keys"), at("$.unknown.password").alias("secret"))


@query("a21_table_sink", with_ctes(["requests_t"], "SELECT session_id, message_id, output_tokens FROM requests_t"))
def _(spark, sf):
    import uuid

    path = f"{shared_folder(spark)}/logloom/requests-{uuid.uuid4().hex}"
    rf.write_table(st.corpus(spark, sf, messages=False).requests, path)
    return rf.read_table(spark, path).select("session_id", "message_id", "output_tokens")


# --- content by its type in the line: strings that look like lists stay texts ------------

_SAID = """CASE doc_id % 5 WHEN 0 THEN concat('[{"a":1}] ', text) WHEN 1 THEN '[]' WHEN 2 THEN '[{"id":1,"title":"x"}]' WHEN 3 THEN concat('{"b":2} ', text) ELSE text END"""
_SHOWN = f"CASE WHEN length({_SAID}) > 2000 THEN concat(substr({_SAID}, 1, 1200), chr(10), '… … …', chr(10), substr({_SAID}, length({_SAID}) - 799)) ELSE {_SAID} END"


@query("b01_content_by_type", f"""SELECT doc_id, lane, text FROM (SELECT doc_id, 'prompt' AS lane, {_SAID} AS text FROM documents
    UNION ALL SELECT doc_id, 'queued', {_SAID} FROM documents UNION ALL SELECT doc_id, 'tool', {_SHOWN} FROM documents UNION ALL SELECT doc_id, 'listed', text FROM documents)
    WHERE trim(text, E' \t\n\r') <> '' OR lane = 'tool'""")
def _(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.expr(_SAID.replace("text", "`text`")).alias("said"), "text")
    user = lambda content: F.to_json(F.struct(F.lit("user").alias("type"), F.struct(F.lit("user").alias("role"), content.alias("content")).alias("message")))
    result = F.array(F.struct(F.lit("tool_result").alias("type"), F.lit("t").alias("tool_use_id"), F.col("said").alias("content")))
    listed = F.array(F.struct(F.lit("tool_result").alias("type"), F.lit("t").alias("tool_use_id"), F.array(F.struct(F.lit("text").alias("type"), "text")).alias("content")))
    queued = F.to_json(F.struct(F.lit("attachment").alias("type"), F.struct(F.lit("queued_command").alias("type"), F.col("said").alias("prompt")).alias("attachment")))
    kinds = {"prompt": user(F.col("said")), "queued": queued, "tool": user(result), "listed": user(listed)}
    lines = d.select("doc_id", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("value")) for k, v in kinds.items()])).alias("l")).select("doc_id", "l.*")
    rows = tr.entries_of(tr.parse_lines(lines))
    short = F.when(F.col("kind") == "listed", F.col("raw")).otherwise(F.col("text"))
    whole = d.select("doc_id", F.col("text").alias("raw"))
    # the preview of a long list result is cut as any result's is; here it is held against the whole text by its ends
    joined = rows.filter("lane IS NOT NULL").join(whole, "doc_id")
    ends = (F.length("raw") <= 2000) & (F.col("text") == F.col("raw")) | (F.length("raw") > 2000) & (F.left("text", F.lit(1200)) == F.left("raw", F.lit(1200))) & (F.right("text", F.lit(800)) == F.right("raw", F.lit(800)))
    kept = joined.filter((F.col("kind") != "listed") | ends)
    return kept.select("doc_id", F.col("kind").alias("lane"), short.alias("text")).filter("trim(BOTH ' \t\n\r' FROM text) <> '' OR lane = 'tool'")
