"""Sessions, tools, statistics, search, limits, denials."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import standins as st
from checks.queries_trace import STRIP
from checks.queries_usage import KEYS, MAIN_TABLES, PRICE, main_sql, r2
from checks.registry import query
from checks.standins import with_ctes
from logloom.functions import pricing, text as tx, tools
from logloom.plans import denials as dn, limits as lm, query_text as qt, search as sr, sessions as ses, text_index as ti
from logloom.schemas import Corpus

# --- sessions, tools, statistics ---------------------------------------------------------

OPENER = f"""op AS (SELECT session_id, {STRIP} AS first_prompt, CASE WHEN lane = 'relay' THEN peer END AS opened_by FROM messages_t WHERE lane IN ('prompt', 'relay')
      QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY ts, line_no) = 1)"""


@query("e11_b26_session_list", with_ctes(["sessions_t", "messages_t", "requests_t"], f"""WITH {OPENER},
    pr AS (SELECT session_id, count(*) AS prompts FROM messages_t WHERE lane = 'prompt' GROUP BY 1),
    wd AS (SELECT session_id, cwd, count(*) AS n FROM messages_t GROUP BY 1, 2), wm AS (SELECT session_id, cwd AS work_dir FROM wd QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY n DESC, cwd) = 1),
    wc AS (SELECT session_id, count(*) AS work_dirs FROM wd GROUP BY 1),
    stx AS (SELECT session_id, CASE WHEN text LIKE '%"bashFirst":true%' THEN regexp_extract(text, '"bashFirstSteer":"([a-z]+)"', 1) ELSE 'off' END AS steer FROM messages_t WHERE text LIKE 'auto_mode: %'
      QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY line_no) = 1),
    mo AS (SELECT session_id, string_agg(model || 'x' || cast(n AS string), ',' ORDER BY n DESC, model) AS models FROM (SELECT session_id, model, count(*) AS n FROM requests_t GROUP BY 1, 2) GROUP BY 1)
    SELECT session_id, well, lines, epoch_ms(first_ts) AS first_ms, epoch_ms(coalesce(last_activity_ts, last_ts)) AS last_ms, CASE WHEN last_ts > last_activity_ts THEN epoch_ms(last_ts) END AS idle_ms,
      coalesce(prompts, 0) AS prompts, work_dir, work_dirs, first_prompt, opened_by, steer, models, (SELECT count(*) >= 40 FROM sessions_t) AS capped
    FROM (SELECT * FROM sessions_t ORDER BY first_ts DESC, session_id LIMIT 40) LEFT JOIN op USING (session_id) LEFT JOIN pr USING (session_id) LEFT JOIN wm USING (session_id) LEFT JOIN wc USING (session_id)
    LEFT JOIN stx USING (session_id) LEFT JOIN mo USING (session_id)"""))
def _(spark, sf):
    from logloom.functions.models import models_text

    rows = ses.session_list(st.corpus(spark, sf), limit=40)
    return rows.select("session_id", "well", "lines", F.unix_millis("first_ts").alias("first_ms"), F.unix_millis("last_at").alias("last_ms"), F.unix_millis("idle_until").alias("idle_ms"),
                       "prompts", "work_dir", "work_dirs", "first_prompt", "opened_by", "steer", models_text(F.col("models")).alias("models"), "capped")


@query("e11_session_list_since", with_ctes(["sessions_t"], """SELECT session_id, epoch_ms(coalesce(last_activity_ts, last_ts)) AS last_ms, false AS capped FROM sessions_t
    WHERE coalesce(last_activity_ts, last_ts) >= TIMESTAMP '2024-01-10'"""))
def _(spark, sf):
    return ses.session_list(st.corpus(spark, sf), since="2024-01-10").select("session_id", F.unix_millis("last_at").alias("last_ms"), "capped")


@query("e12_session_dump", with_ctes(["messages_t"], """SELECT session_id, line_no, lane, type, peer, text FROM messages_t WHERE starts_with(session_id, '0000000') AND lane IN ('prompt', 'text', 'relay')
    AND ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-01-20'"""))
def _(spark, sf):
    rows = ses.session_dump(st.corpus(spark, sf), "0000000", ["prompt", "text", "relay"], since="2024-01-03", until="2024-01-20")
    return rows.select("session_id", "line_no", "lane", "type", "peer", "text")


@query("e12_cwd_histogram", with_ctes(["messages_t"], "SELECT session_id, cwd, count(*) AS n FROM messages_t GROUP BY 1, 2"))
def _(spark, sf):
    return ses.cwd_histogram(st.corpus(spark, sf).messages)


@query("e09_tool_counts", with_ctes(["messages_t", "sessions_t"], """SELECT tool_name, count(*) AS n, count(DISTINCT session_id) AS sessions, count(DISTINCT s.well) AS wells,
    strftime(min(ts), '%Y-%m-%d') AS first, strftime(max(ts), '%Y-%m-%d') AS last FROM messages_t JOIN (SELECT session_id, well FROM sessions_t) s USING (session_id) WHERE tool_name IS NOT NULL GROUP BY 1"""))
def _(spark, sf):
    return ses.tool_counts(st.corpus(spark, sf))


@query("e10_lane_counts", with_ctes(["messages_t"], "SELECT lane, count(*) AS n FROM messages_t GROUP BY 1"))
def _(spark, sf):
    return ses.lane_counts(st.corpus(spark, sf).messages)


@query("e10_top_wells", with_ctes(["messages_t", "sessions_t"], """SELECT s.well, count(DISTINCT session_id) AS sessions, count(m.line_no) AS messages FROM sessions_t s LEFT JOIN (SELECT session_id, line_no FROM messages_t) m USING (session_id)
    GROUP BY 1 ORDER BY messages DESC, s.well LIMIT 15"""))
def _(spark, sf):
    return ses.top_wells(st.corpus(spark, sf))


@query("e10_peers", with_ctes(["messages_t"], "SELECT peer, count(*) AS messages, count(DISTINCT session_id) AS sessions, epoch_ms(min(ts)) AS first_ms, epoch_ms(max(ts)) AS last_ms FROM messages_t WHERE lane = 'relay' GROUP BY 1"))
def _(spark, sf):
    p = ses.peers(st.corpus(spark, sf).messages)
    return p.select("peer", "messages", "sessions", F.unix_millis("first").alias("first_ms"), F.unix_millis("last").alias("last_ms"))


@query("e10_corpus_totals", with_ctes(["messages_t", "sessions_t", "requests_t"], """SELECT (SELECT count(*) FROM sessions_t) AS sessions, (SELECT count(*) FROM messages_t) AS messages, (SELECT count(*) FROM requests_t) AS requests,
    (SELECT count(*) FROM supplier) AS jobs, (SELECT count(*) FROM documents) AS docs, 0 AS repos, (SELECT epoch_ms(min(first_ts)) FROM sessions_t) AS earliest_ms, 'documents are empty' AS warnings"""))
def _(spark, sf):
    c = st.corpus(spark, sf).with_tables(jobs=st.jobs(spark, sf), docs=spark.read.parquet(f"{sf}/documents.parquet"))
    t = ses.corpus_totals(c)
    return t.select("sessions", "messages", "requests", "jobs", "docs", "repos", F.unix_millis("earliest").alias("earliest_ms"), "warnings")


@query("e30_well_page_weeks", with_ctes(MAIN_TABLES, main_sql(KEYS["week"], "well = '-u-code-w1'")))
def _(spark, sf):
    return ses.well_page(st.corpus(spark, sf), "-u-code-w1")[1]


@query("e30_well_page_sessions", with_ctes(MAIN_TABLES, f"SELECT session_id, lines, u.requests, u.list_usd FROM sessions_t LEFT JOIN ({main_sql(KEYS['session'])}) u ON u.key = session_id WHERE well = '-u-code-w1'"))
def _(spark, sf):
    return ses.well_page(st.corpus(spark, sf), "-u-code-w1")[0].select("session_id", "lines", "requests", "list_usd")


@query("e34_record_census", with_ctes(["rec"], """SELECT type, count(*) AS n, count(*) FILTER (lane IN ('prompt', 'text', 'relay')) AS spoken,
    floor(count(*) FILTER (lane IN ('prompt', 'text', 'relay')) / count(*) * 1000 + 0.5) / 1000 AS spoken_share FROM rec GROUP BY 1"""))
def _(spark, sf):
    return ses.record_census(st.event_entries(spark, sf))


@query("b15_text_normalisers", r"""SELECT doc_id, CASE WHEN length(one) > 160 THEN substr(one, 1, 159) || '…' ELSE one END AS cut,
    CASE WHEN length(one) > 140 THEN substr(one, 1, 140) || '…' ELSE one END AS headline FROM (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS one FROM documents)""")
def _(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    return d.select("doc_id", tx.cut(F.col("text"), 160).alias("cut"), tx.headline(F.col("text")).alias("headline"))


@query("b15_cut_prose", r"""SELECT doc_id, CASE WHEN length(t) > 400 THEN substr(t, 1, 399) || '…' ELSE t END AS prose FROM (SELECT doc_id,
    regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[ \t\r\f\v]+', ' ', 'g'), ' ?\n ?', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS t FROM documents)""")
def _(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    return d.select("doc_id", tx.cut_prose(F.col("text"), 400).alias("prose"))


# --- search -----------------------------------------------------------------------------

FOLD = "strip_accents(lower({}))"


def bm25_sql(table: str, doc_id: str, where: str, leaves: list[str], text: str = "text") -> str:
    toks = f"list_filter(regexp_split_to_array({FOLD.format(text)}, '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"
    tf = ", ".join(f"len(list_filter(w, lambda x, i: {leaf})) AS tf{i}" for i, leaf in enumerate(leaves))
    df = ", ".join(f"sum(CASE WHEN tf{i} > 0 THEN 1.0 ELSE 0.0 END) AS df{i}" for i in range(len(leaves)))
    rank = " + ".join(f"greatest(ln((n - df{i} + 0.5) / (df{i} + 0.5)), 1e-6) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * dl / al))" for i in range(len(leaves)))
    return f"""tok AS (SELECT *, {toks} AS w FROM {table}), tfs AS (SELECT *, len(w) AS dl, {tf} FROM tok), st AS (SELECT count(*)::double AS n, avg(dl) AS al, {df} FROM tfs),
        hit AS (SELECT {doc_id}, round(-({rank}), 6) AS rank FROM tfs, st WHERE {where})"""


def _search(key, q, where, leaves, scan=False):
    @query(key, f"WITH {bm25_sql('documents', 'doc_id', where, leaves)} SELECT * FROM hit")
    def run(spark, sf):
        said = q() if callable(q) else qt.read(q)
        hits = sr.scored(spark.read.parquet(f"{sf}/documents.parquet"), said) if scan else st.document_index(spark, sf).hits(said)
        return hits.select("doc_id", F.round("rank", 6).alias("rank"))


_search("e15_search_two_words", lambda: sr.word("und") & sr.word("mit"), "tf0 > 0 AND tf1 > 0", ["x = 'und'", "x = 'mit'"])
_search("e15_search_or_not", lambda: (sr.word("und") | sr.word("avec")) - sr.word("der"), "(tf0 > 0 OR tf1 > 0) AND NOT list_contains(w, 'der')", ["x = 'und'", "x = 'avec'"])
_search("e15_search_prefix", lambda: sr.all_words("les retre", last_is_prefix=True), "tf0 > 0 AND tf1 > 0", ["x = 'les'", "starts_with(x, 'retre')"])
_search("e15_scan_or_not", "(und OR avec) NOT der", "(tf0 > 0 OR tf1 > 0) AND NOT list_contains(w, 'der')", ["x = 'und'", "x = 'avec'"], scan=True)
# strings: NOT before AND before OR, words side by side before all; what is no query is taken word by word
_search("e15_string_binding", "und OR avec AND par NOT des", "tf0 > 0 OR (tf1 > 0 AND tf2 > 0 AND NOT list_contains(w, 'des'))", ["x = 'und'", "x = 'avec'", "x = 'par'"])
_search("e15_string_group", "( und OR avec ) AND text:les", "(tf0 > 0 OR tf1 > 0) AND tf2 > 0", ["x = 'und'", "x = 'avec'", "x = 'les'"])
_search("e15_string_start", "^the AND tha*", "w[1] = 'the' AND tf1 > 0", ["x = 'the' AND w[1] = 'the' AND i = 1", "starts_with(x, 'tha')"])
_search("e15_string_retried", 'und "mit (', "tf0 > 0 AND tf1 > 0", ["x = 'und'", "x = 'mit'"])
_search("e15_string_no_words", "und !!! ... mit", "tf0 > 0 AND tf1 > 0", ["x = 'und'", "x = 'mit'"])


@query("e13_search_messages", with_ctes(["messages_t"], f"""WITH {bm25_sql("messages_t", 'session_id, line_no', "lane IN ('prompt', 'text', 'tool') AND tf0 > 0 AND tf1 > 0", ["x = 'please'", "x = '42'"])} SELECT * FROM hit"""))
def _(spark, sf):
    scope = F.col("lane").isin("prompt", "text", "tool")
    return st.message_index(spark, sf).hits("please 42", scope).select("session_id", "line_no", F.round("rank", 6).alias("rank"))


@query("e13_search_in_scope", with_ctes(["messages_t", "sessions_t"], f"""WITH m AS (SELECT messages_t.*, s.well FROM messages_t JOIN (SELECT session_id, well FROM sessions_t) s USING (session_id)),
    {bm25_sql("m", 'session_id, line_no, lane, prompt_id, well', "lane IN ('prompt', 'text') AND (tf0 > 0 OR tf1 > 0) AND well LIKE '%w1%' AND starts_with(session_id, '000000') AND ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-01-20 12:00:00'", ["x = '42'", "x = '17'"])}
    SELECT *, replace(well, '-u-code-', '/u/code/') AS real_path FROM hit"""))
def _(spark, sf):
    c = st.corpus(spark, sf)
    rows = ti.search_messages(c, st.message_index(spark, sf), "42 OR 17", ["prompt", "text"], 1_000_000, well="w1", since="2024-01-03", until="2024-01-20T12:00:00Z", session="000000")
    return rows.select("session_id", "line_no", "lane", "prompt_id", "well", "real_path", F.round("rank", 6).alias("rank"))


@query("e15_search_phrase", f"""WITH t AS (SELECT doc_id, ' ' || array_to_string(list_filter(regexp_split_to_array({FOLD.format('text')}, '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> ''), ' ') || ' ' AS s FROM documents)
    SELECT doc_id FROM t WHERE contains(s, ' of the ')""")
def _(spark, sf):
    return st.document_index(spark, sf).hits('"of the"').select("doc_id")


@query("e15_search_near", f"""WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array({FOLD.format('text')}, '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS w FROM documents),
    p AS (SELECT doc_id, unnest(w) AS term, generate_subscripts(w, 1) AS i FROM t)
    SELECT DISTINCT a.doc_id FROM p a JOIN p b ON a.doc_id = b.doc_id AND a.term = 'und' AND b.term = 'mit' AND abs(a.i - b.i) BETWEEN 1 AND 6""")
def _(spark, sf):
    return st.document_index(spark, sf).hits("NEAR(und mit, 5)").select("doc_id")


@query("e15_near_three", f"""WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array({FOLD.format('text')}, '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS w FROM documents),
    p AS (SELECT doc_id, unnest(w) AS term, generate_subscripts(w, 1) AS i FROM t),
    l AS (SELECT doc_id, i, max(CASE WHEN term = 'that' THEN i END) OVER w AS a, max(CASE WHEN starts_with(term, 'for') THEN i END) OVER w AS b,
          max(CASE WHEN term = 'the' AND before = 'of' THEN i - 1 END) OVER w AS c
          FROM (SELECT *, lag(term) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM p) WINDOW w AS (PARTITION BY doc_id ORDER BY i))
    SELECT DISTINCT doc_id FROM l WHERE a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL AND greatest(a, b, c) - a - 1 <= 12 AND greatest(a, b, c) - b - 1 <= 12 AND greatest(a, b, c) - c - 2 <= 12""")
def _(spark, sf):
    return st.document_index(spark, sf).hits('NEAR(that for* "of the", 12)').select("doc_id")


@query("e15_scan_near_three", f"""WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array({FOLD.format('text')}, '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS w FROM documents),
    p AS (SELECT doc_id, unnest(w) AS term, generate_subscripts(w, 1) AS i FROM t),
    l AS (SELECT doc_id, i, max(CASE WHEN term = 'que' THEN i END) OVER w AS a, max(CASE WHEN term = 'para' THEN i END) OVER w AS b, max(CASE WHEN term = 'con' THEN i END) OVER w AS c FROM p WINDOW w AS (PARTITION BY doc_id ORDER BY i))
    SELECT DISTINCT doc_id FROM l WHERE a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL AND greatest(a, b, c) - least(a, b, c) <= 7""")
def _(spark, sf):
    return sr.scored(spark.read.parquet(f"{sf}/documents.parquet"), qt.read("NEAR(que para con, 6)")).select("doc_id")


@query("e15_search_documents_flags", f"""WITH {bm25_sql("documents", 'doc_id, source', "tf0 > 0 AND source LIKE '%rc1%'", ["x = 'avec'"])}
    SELECT source AS repo, doc_id::VARCHAR AS path, rank, 'main' AS ref, length(source) = 4 AS is_husk, CASE WHEN source = 'src1' THEN 'mine' ELSE 'assisted' END AS ownership FROM hit""")
def _(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("source").alias("repo"), F.col("doc_id").cast("string").alias("path"), "text")
    repos = docs.select("repo").distinct().select("repo", F.lit("main").alias("ref"), (F.length("repo") == 4).alias("is_husk"), F.when(F.col("repo") == "src1", "mine").otherwise("assisted").alias("ownership"))
    index = st.stored_index(spark, sf, "repos", lambda path: ti.index_documents(spark, docs, path))
    rows = ti.search_documents(Corpus(docs=docs, repos=repos), index, "avec", 1_000_000, repo="rc1")
    return rows.select("repo", "path", F.round("rank", 6).alias("rank"), "ref", "is_husk", "ownership")


@query("e13_e15_index_refresh", f"""WITH now AS (SELECT doc_id, CASE WHEN source IN ('src1', 'src2') THEN 'mit und ' || text ELSE text END AS text FROM documents WHERE source <> 'src3'),
    {bm25_sql("now", 'doc_id', 'tf0 > 0 AND tf1 > 0', ["x = 'und'", "x = 'mit'"])} SELECT * FROM hit""")
def _(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source", "text")
    changed = docs.filter(F.col("source").isin("src1", "src2")).withColumn("text", F.concat(F.lit("mit und "), "text"))
    first = st.stored_index(spark, sf, "refreshed", lambda path: ti.TextIndex(spark, path, ("doc_id",), "source").write(docs, F.col("text"))
                            .update(changed, F.col("text"), docs.filter("source = 'src3'").select("source")))
    return first.hits("und mit").select("doc_id", F.round("rank", 6).alias("rank"))


@query("e14_search_history", f"""WITH {bm25_sql("(SELECT * FROM conversations WHERE role = 'user')", 'conv_id, turn', 'tf0 > 0', ["x = 'elle'"])} SELECT * FROM hit""")
def _(spark, sf):
    return st.history_index(spark, sf).hits("elle").select("conv_id", "turn", F.round("rank", 6).alias("rank"))


@query("e14_search_history_window", f"""WITH {bm25_sql("(SELECT * FROM conversations WHERE role = 'user')", 'conv_id, turn', "tf0 > 0 AND 1704067200000 + conv_id * 3600000 + turn * 60000 >= epoch_ms(TIMESTAMP '2024-01-02') AND 1704067200000 + conv_id * 3600000 + turn * 60000 < epoch_ms(TIMESTAMP '2024-01-04 06:00:00') AND starts_with('c' || conv_id, 'c3')", ["x = 'the'"])}
    SELECT *, 1704067200000 + conv_id * 3600000 + turn * 60000 AS at_ms FROM hit""")
def _(spark, sf):
    rows = ti.search_history(st.typed_history(spark, sf), st.history_index(spark, sf), "the", 1_000_000, since="2024-01-02", until="2024-01-04T06:00:00Z", session="c3")
    return rows.select("conv_id", "turn", F.round("rank", 6).alias("rank"), F.unix_millis("at").alias("at_ms"))


@query("e16_sessions_first", with_ctes(["messages_t", "sessions_t"], f"""WITH {bm25_sql("messages_t", 'session_id, line_no', "lane IN ('prompt', 'relay') AND tf0 > 0", ["starts_with(x, 'tas')"])},
    top AS (SELECT * FROM hit) SELECT session_id, count(*) AS hits, min(rank) AS best_rank, epoch_ms(any_value(coalesce(last_activity_ts, last_ts))) AS last_ms
    FROM top JOIN sessions_t USING (session_id) GROUP BY 1 ORDER BY best_rank, hits DESC, last_ms DESC LIMIT 20"""))
def _(spark, sf):
    rows = sr.sessions_first(st.corpus(spark, sf), qt.read(qt.with_open_end("tas")), ["prompt", "relay"], index=st.message_index(spark, sf))
    return rows.select("session_id", "hits", F.round("best_rank", 6).alias("best_rank"), F.unix_millis("last_at").alias("last_ms"))


@query("e15_index_terms", f"""WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array({FOLD.format('text')}, '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS w FROM documents),
    p AS (SELECT doc_id, unnest(w) AS term, generate_subscripts(w, 1) - 1 AS i FROM t) SELECT term, count(*) AS occurrences, count(DISTINCT doc_id) AS docs, sum(i)::BIGINT AS places FROM p GROUP BY 1""")
def _(spark, sf):
    places = F.aggregate("positions", F.lit(0).cast("long"), lambda s, i: s + i)
    return st.document_index(spark, sf).postings().groupBy("term").agg(F.sum(F.size("positions")).alias("occurrences"), F.count("*").alias("docs"), F.sum(places).alias("places"))


@query("e13_index_messages", with_ctes(["messages_t"], f"""WITH t AS (SELECT list_filter(regexp_split_to_array({FOLD.format('text')}, '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS w, session_id FROM messages_t)
    SELECT session_id AS owner, count(*) AS docs, sum(len(w))::BIGINT AS tokens FROM t GROUP BY 1"""))
def _(spark, sf):
    return st.message_index(spark, sf).live_owners().select("owner", "docs", "tokens")


@query("e13_snippets", r"""WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM documents WHERE regexp_matches(' ' || lower(text) || ' ', '[^\p{L}\p{N}]und[^\p{L}\p{N}]')),
    p AS (SELECT *, list_position(list_transform(w, lambda x: list_contains(regexp_split_to_array(lower(x), '[^\p{L}\p{N}]+'), 'und')), true) AS i FROM d)
    SELECT doc_id, (CASE WHEN i > 1 THEN ' … ' ELSE '' END) || array_to_string(list_transform(w[i:i + 23], lambda x: CASE WHEN list_contains(regexp_split_to_array(lower(x), '[^\p{L}\p{N}]+'), 'und') THEN '«' || x || '»' ELSE x END), ' ')
      || (CASE WHEN len(w) > i + 23 THEN ' … ' ELSE '' END) AS snippet FROM p""")
def _(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    q = sr.word("und")
    return docs.filter(q.test(sr.token_text(F.col("text")))).select("doc_id", sr.snippet(F.col("text"), q).alias("snippet"))


@query("e15_postings", f"""WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array({FOLD.format('text')}, '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS w FROM documents),
    p AS (SELECT doc_id, unnest(w) AS term FROM t) SELECT term, count(*) AS occurrences, count(DISTINCT doc_id) AS docs FROM p GROUP BY 1""")
def _(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    return sr.postings(docs, "doc_id").groupBy("term").agg(F.sum("tf").alias("occurrences"), F.count("*").alias("docs"))


# --- limits -----------------------------------------------------------------------------

NOW = "2024-01-24T06:00:00Z"
READ = """lr AS (SELECT * EXCLUDE (kind), kind AS said, CASE WHEN kind = 'seven_day_overage_included' THEN 'seven_day_fable' ELSE kind END AS kind FROM limits_t)"""


@query("c18_window_resets", with_ctes(["limits_t"], f"""WITH {READ}, d AS (SELECT *, lag(pct) OVER w AS was, lag(ts) OVER w AS was_at FROM lr WHERE resets_at IS NOT NULL WINDOW w AS (PARTITION BY kind, resets_at ORDER BY ts, seq))
    SELECT kind, epoch_ms(resets_at) AS window_ms, arg_max(pct, seq) AS reset_pct, arg_max(was, seq) AS was, epoch_ms(max(ts)) AS reset_ms FROM d WHERE was - pct >= 5 GROUP BY 1, 2"""))
def _(spark, sf):
    r = lm.resets(lm.prepared(st.limits(spark, sf)).filter("resets_at IS NOT NULL"), ["kind", "resets_at"])
    return r.select("kind", F.unix_millis("resets_at").alias("window_ms"), "reset_pct", "was", F.unix_millis("reset_at").alias("reset_ms"))


# sub-agents' instants moved by whole days into the month of the readings
SPAWN_AT = "ts - to_days(1 * (date_diff('day', TIMESTAMP '1970-01-01', ts) - 19723 - abs(date_diff('day', TIMESTAMP '1970-01-01', ts)) % 30)::int)"


@query("e25_limit_windows", with_ctes(MAIN_TABLES + ["sreq_t", "limits_t"], f"""WITH {READ}, l0 AS (SELECT *, CASE WHEN kind = 'five_hour' THEN 5 WHEN kind LIKE 'seven_day%' THEN 168 END AS hours FROM lr),
    la AS (SELECT * FROM l0 QUALIFY row_number() OVER (PARTITION BY kind ORDER BY CASE WHEN resets_at > TIMESTAMP '2024-01-24 06:00:00' THEN 0 ELSE 1 END, ts DESC, seq DESC) = 1),
    w AS (SELECT *, resets_at - to_hours(hours) AS wf, resets_at <= TIMESTAMP '2024-01-24 06:00:00' AS ended, CASE WHEN kind LIKE 'seven_day_%' THEN substr(kind, 11) END AS scope FROM la),
    ins AS (SELECT l.* FROM l0 l JOIN w ON w.kind = l.kind AND NOT w.ended AND l.ts >= w.wf AND l.ts < w.resets_at AND l.resets_at = w.resets_at),
    dr AS (SELECT *, lag(pct) OVER (PARTITION BY kind ORDER BY ts, seq) AS was FROM ins),
    rs AS (SELECT kind, max(ts) AS rat, arg_max(pct, seq) AS rpct FROM dr WHERE was - pct >= 5 GROUP BY 1),
    lf AS (SELECT w.*, coalesce(rat, CASE WHEN NOT ended THEN wf END) AS ff, rat, rpct FROM w LEFT JOIN rs USING (kind)),
    rq AS (SELECT ts, model, input_tokens, cache_write_tokens, cache_write_1h_tokens, cache_read_tokens, output_tokens, true AS main FROM requests_t
      UNION ALL SELECT {SPAWN_AT}, model, input_tokens, cache_write_tokens, cache_write_1h_tokens, cache_read_tokens, output_tokens, false FROM sreq_t),
    cell AS (SELECT lf.kind, r.main, r.model, cast(r.ts AS date) AS d, count(*) AS nreq, sum(input_tokens) AS i, sum(cache_write_tokens) AS w, sum(cache_write_1h_tokens) AS w1, sum(cache_read_tokens) AS rd, sum(output_tokens) AS o
      FROM lf JOIN rq r ON r.ts >= lf.ff AND r.ts < lf.ts AND (lf.scope IS NULL OR contains(r.model, lf.scope)) GROUP BY 1, 2, 3, 4), {PRICE},
    side AS (SELECT kind, main, sum(nreq) AS n, sum(rd) AS rd, sum(o) AS o, {r2('CASE WHEN count(usd) = count(*) THEN sum(usd) ELSE 0 END')} AS usd FROM cost GROUP BY 1, 2),
    us AS (SELECT kind, cast(sum(n) AS bigint) AS requests, cast(sum(rd) AS bigint) AS cache_read, cast(sum(o) AS bigint) AS output, cast(coalesce(sum(n) FILTER (main), 0) AS bigint) AS main_requests,
      coalesce(max(usd) FILTER (main), 0) AS main_usd, {r2('coalesce(max(usd) FILTER (main), 0) + coalesce(max(usd) FILTER (NOT main), 0)')} AS list_usd FROM side GROUP BY 1)
    SELECT lf.kind, pct, epoch_ms(ts) AS ts_ms, coalesce(ended, false) AS ended, scope AS model, epoch_ms(CASE WHEN NOT ended THEN wf END) AS from_ms, epoch_ms(rat) AS reset_ms, rpct AS reset_pct,
      {', '.join(f"CASE WHEN ff < ts THEN coalesce({m}, 0) END AS {m}" for m in ("requests", "cache_read", "output", "list_usd", "main_requests", "main_usd"))},
      CASE WHEN ff < ts AND pct - coalesce(rpct, 0) >= 5 THEN cast(floor(coalesce(requests, 0) * (100.0::double / (pct - coalesce(rpct, 0))) + 0.5) AS bigint) END AS implied_requests
    FROM lf LEFT JOIN us USING (kind)"""))
def _(spark, sf):
    c = st.corpus(spark, sf, messages=False, spawns=True).with_tables(limits=st.limits(spark, sf))
    day = F.datediff("ts", F.lit("1970-01-01").cast("date"))
    moved = F.timestamp_micros(F.unix_micros("ts") - (day - 19723 - day % 30).cast("bigint") * 86_400_000_000)
    w = lm.limit_windows(c.with_tables(spawn_requests=c.spawn_requests.withColumn("ts", moved)), NOW)
    return w.select("kind", "pct", F.unix_millis("ts").alias("ts_ms"), "ended", "model", F.unix_millis("from").alias("from_ms"), F.unix_millis("reset_at").alias("reset_ms"), "reset_pct",
                    "requests", "cache_read", "output", "list_usd", "main_requests", "main_usd", "implied_requests")


@query("e25_hits_and_history", with_ctes(["limits_t"], f"WITH {READ} SELECT source, kind, said, count(*) AS n, max(pct) AS peak FROM lr WHERE ts >= TIMESTAMP '2024-01-10' GROUP BY 1, 2, 3"))
def _(spark, sf):
    c = st.corpus(spark, sf, messages=False).with_tables(limits=st.limits(spark, sf))
    both = lm.hits(c, "2024-01-10").unionByName(lm.history(c, "2024-01-10"))
    return both.groupBy("source", "kind", "said").agg(F.count("*").alias("n"), F.max("pct").alias("peak"))


# --- denials ----------------------------------------------------------------------------

# some closing texts quote a command or name the prefix, some after more than a listing prints
SAID = """concat('said ', CASE WHEN {k} % 4 = 0 THEN repeat('x', 700) ELSE '' END, cast({k} AS string), CASE WHEN {k} % 5 = 0 THEN ' run `make deploy` now' ELSE '' END,
    CASE WHEN {k} % 3 = 0 THEN ' with the `!` prefix' ELSE '' END)"""


def denial_steps(spark, sf):
    """error events are denials of a call; signups are human turns. Some records make two calls, some deny the second, some deny two."""
    ev = spark.read.parquet(f"{sf}/events.parquet").selectExpr(*[f"{e} AS {n}" for n, e in st.event_base("spark").items()])
    cmd = F.concat(F.lit("run x"), (F.col("k") % 4).cast("string"), F.when(F.col("k") % 3 == 0, F.lit(" && make all")).otherwise(F.lit("")))
    act, n = F.col("et") == "click", (F.col("k") % 5).cast("string")
    second = F.when(F.col("k") % 3 == 1, F.struct(F.concat(F.lit("d"), n).alias("id"), F.lit("Bash").alias("tool"), F.concat(F.lit("also y"), (F.col("k") % 4).cast("string")).alias("cmd")))
    return ev.select(
        F.col("session_id").alias("file_path"), "session_id", "line_no", "ts", F.concat(F.lit("/u/code/"), "well").alias("cwd"),
        F.when(F.col("et") == "error", F.when(F.col("k") % 2 == 0, "automode-blocked").otherwise("user-rejected")).alias("kind"),
        F.when(act, F.concat(F.lit("c"), (F.col("k") % 5).cast("string"))).alias("call_id"), F.when(act, F.when(F.col("k") % 7 == 0, "Edit").otherwise("Bash")).alias("call_tool"),
        F.when(act, cmd).alias("call_cmd"), F.when(F.col("et") == "purchase", F.expr(SAID.format(k="k"))).alias("said"),
        F.when(act, F.array_compact(F.array(F.struct(F.concat(F.lit("c"), n).alias("id"), F.when(F.col("k") % 7 == 0, "Edit").otherwise("Bash").alias("tool"), cmd.alias("cmd")), second))).alias("calls"),
        F.when(F.col("et") == "error", F.concat(F.when(F.col("k") % 3 == 2, "d").otherwise("c"), n)).alias("result_id"),
        F.when(F.col("et") == "error", F.when(F.col("k") % 6 == 2, F.array(F.concat(F.lit("d"), n), F.concat(F.lit("c"), n))).otherwise(F.array(F.concat(F.when(F.col("k") % 3 == 2, "d").otherwise("c"), n)))).alias("result_ids"), (F.col("et") == "signup").alias("human"),
        F.when(F.col("et") == "error", F.concat(F.lit("because "), (F.col("k") % 6).cast("string"))).alias("reason"))


DENIED = f"""st0 AS (SELECT *, et = 'click' AS act, CASE WHEN et = 'error' AND k % 3 = 2 THEN 'd' ELSE 'c' END || cast(k % 5 AS string) AS id, CASE WHEN k % 7 = 0 THEN 'Edit' ELSE 'Bash' END AS tool,
      'run x' || cast(k % 4 AS string) || CASE WHEN k % 3 = 0 THEN ' && make all' ELSE '' END AS cmd, CASE WHEN k % 2 = 0 THEN 'automode-blocked' ELSE 'user-rejected' END AS dk FROM ev),
    nx AS (SELECT *, first_value(CASE WHEN act THEN line_no END IGNORE NULLS) OVER w AS nl, first_value(CASE WHEN et = 'purchase' THEN line_no END IGNORE NULLS) OVER w AS sl,
        first_value(CASE WHEN et = 'signup' THEN line_no END IGNORE NULLS) OVER w AS hl FROM st0 WINDOW w AS (PARTITION BY session_id ORDER BY line_no ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
    src AS (SELECT session_id, id, arg_max(tool, line_no) AS tool, arg_max(cmd, line_no) AS cmd FROM (SELECT session_id, id, tool, cmd, line_no FROM st0 WHERE act
      UNION ALL SELECT session_id, 'd' || cast(k % 5 AS string), 'Bash', 'also y' || cast(k % 4 AS string), line_no FROM st0 WHERE act AND k % 3 = 1) GROUP BY 1, 2),
    den AS (SELECT session_id, id, arg_max(dk, line_no) AS nd FROM (SELECT session_id, id, dk, line_no FROM st0 WHERE et = 'error'
      UNION ALL SELECT session_id, 'c' || cast(k % 5 AS string), dk, line_no FROM st0 WHERE et = 'error' AND k % 6 = 2) GROUP BY 1, 2),
    dr AS (SELECT n.session_id, n.line_no, n.dk AS kind, 'because ' || cast(n.k % 6 AS string) AS reason, coalesce(s.tool, '?') AS tool, coalesce(s.cmd, '') AS cmd, coalesce(c.tool, '') AS next_tool, coalesce(c.cmd, '') AS next_cmd,
        coalesce(d.nd, '') AS next_denied, CASE WHEN sl IS NOT NULL AND (nl IS NULL OR sl <= nl) THEN {SAID.format(k='t.k')} ELSE '' END AS next_text, hl IS NOT NULL AND (nl IS NULL OR hl < nl) AS human_first,
        regexp_extract(n.well, 'w[0-9]+') AS w
      FROM nx n LEFT JOIN src s ON s.session_id = n.session_id AND s.id = n.id LEFT JOIN st0 c ON c.line_no = nl LEFT JOIN st0 t ON t.line_no = sl
      LEFT JOIN den d ON d.session_id = n.session_id AND d.id = c.id WHERE n.et = 'error')"""


@query("c16_e26_denial_rows", with_ctes(["ev"], f"WITH {DENIED} SELECT session_id, line_no, kind, tool, cmd, next_tool, next_cmd, next_denied, next_text, human_first FROM dr"))
def _(spark, sf):
    rows = dn.denial_rows(denial_steps(spark, sf))
    return rows.select("session_id", "line_no", "kind", "tool", "cmd", "next_tool", "next_cmd", "next_denied", "next_text", "human_first")


def half_even(x: str) -> str:
    return f"cast(round_even({x}, 0) AS bigint)"


@query("e26_by_kind", with_ctes(["ev"], f"""WITH {DENIED}, g AS (SELECT kind, count(*) AS n, count(*) FILTER (human_first) AS stopped, count(*) FILTER (next_cmd <> '' AND next_cmd = cmd) AS verbatim,
    count(*) FILTER (next_denied <> '') AS re_denied FROM dr GROUP BY 1) SELECT *, {half_even('100.0 * stopped / n')} AS stopped_pct, {half_even('100.0 * verbatim / n')} AS verbatim_pct, {half_even('100.0 * re_denied / n')} AS re_denied_pct FROM g"""))
def _(spark, sf):
    return dn.by_kind(dn.denial_rows(denial_steps(spark, sf)))


@query("e26_response_shapes", with_ctes(["ev"], f"""WITH {DENIED}, s AS (SELECT CASE WHEN human_first THEN 'stopped, handed to the human' WHEN next_cmd = '' THEN 'no further tool call' WHEN cmd = next_cmd THEN 'RETRIED VERBATIM'
      WHEN tool <> next_tool THEN 'switched to another tool' WHEN cmd LIKE '%&&%' AND (split_part(cmd, ' && ', 1) = split_part(next_cmd, ' && ', 1) OR next_cmd LIKE '%make all%') THEN 'split the compound, ran the allowed part'
      WHEN cmd LIKE 'run %' THEN 'same program, reshaped' ELSE 'dropped it, moved on' END AS shape FROM dr WHERE kind = 'automode-blocked')
    SELECT shape, count(*) AS n, {half_even('100.0 * count(*) / (SELECT count(*) FROM s)')} AS pct FROM s GROUP BY 1"""))
def _(spark, sf):
    return dn.shapes(dn.denial_rows(denial_steps(spark, sf)))


@query("e26_places", with_ctes(["ev"], f"""WITH {DENIED}, b AS (SELECT * FROM dr WHERE kind = 'automode-blocked') SELECT 'tool' AS what, tool AS value, count(*) AS n FROM b GROUP BY 2 UNION ALL SELECT 'reason', reason, count(*) FROM b GROUP BY 2
    UNION ALL SELECT 'repo', '-u-code-' || w, count(*) FROM b GROUP BY 2 UNION ALL SELECT 'command', split_part(cmd, ' ', 1) || ' ' || split_part(cmd, ' ', 2), count(*) FROM b WHERE tool = 'Bash' GROUP BY 2"""))
def _(spark, sf):
    return dn.places(dn.denial_rows(denial_steps(spark, sf)))


@query("e26_handovers", with_ctes(["ev"], f"WITH {DENIED} SELECT count(*) AS stops, count(*) FILTER (regexp_matches(next_text, '`[^`]{{6,}}`')) AS quoted, count(*) FILTER (contains(next_text, 'the `!` prefix')) AS named_prefix FROM dr WHERE kind = 'automode-blocked' AND human_first"))
def _(spark, sf):
    return dn.handovers(dn.denial_rows(denial_steps(spark, sf)))


@query("b25_command_dissection", r"""SELECT doc_id, cast(len(list_filter(string_split(replace(replace(trim(regexp_replace(text, '\s+', ' ', 'g')), ';', '&&'), '||', '&&'), '&&'), lambda x: trim(x) <> '')) AS int) AS statements,
    cast(len(list_distinct(list_transform(regexp_extract_all(trim(regexp_replace(text, '\s+', ' ', 'g')), '[A-Za-z0-9_.:/-]{6,}'), lambda x: lower(x)))) AS int) AS tokens FROM documents""")
def _(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    boring = F.array_distinct(F.transform(F.regexp_extract_all(tx.fold_space(F.col("text")), F.lit(r"([A-Za-z0-9_.:/-]{6,})"), F.lit(1)), F.lower))
    stop = F.size(F.array_except(boring, tools.target_tokens(F.col("text"))))
    return d.select("doc_id", F.size(tools.statements(F.col("text"))).alias("statements"), (F.size(tools.target_tokens(F.col("text"))) + stop).alias("tokens"))
