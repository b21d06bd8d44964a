"""Structured Streaming twins (S1-S8): file streams drained with availableNow, compared with batch SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from checks import standins as st
from checks.queries_trace import CALLS
from checks.registry import query
from checks.standins import with_ctes
from logloom.operators.stages import shared_folder
from logloom.plans import limits as lm, waits
from logloom.sources import transcripts as tr
from logloom.streaming import twins

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def places(spark, name):
    base = f"{shared_folder(spark)}/logloom/{name}-{uuid.uuid4().hex}"
    return base + "-out", base + "-checkpoint"


def stream_of(spark, sf, name):
    schema = spark.read.parquet(f"{sf}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf)


def flat_events(df):
    base = df.selectExpr(*[f"{e} AS {n}" for n, e in st.event_base("spark").items()])
    return base.selectExpr("*", *[f"{e} AS {n}" for n, e in st.record_columns("spark").items()])


def drained(spark, stream, name):
    return twins.run_to_folder(stream, *places(spark, name))


@query("s01_stream_ingest", with_ctes(["messages_t"], "SELECT session_id, lane, type, count(*) AS n, count(prompt_id) AS prompted FROM messages_t GROUP BY 1, 2, 3"))
def _(spark, sf):
    folder, checkpoint = places(spark, "ingest")
    closed = f"{folder}-lines"
    lines = st.event_lines(spark, sf)
    lines.write.parquet(closed)
    stream = spark.readStream.schema(lines.schema).parquet(closed)

    def write(batch, epoch):
        rows = tr.messages_of(tr.entries_of(tr.number_records(tr.parse_lines(tr.session_lines(batch)))))
        twins.write_epoch(rows, epoch, folder)

    q = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(folder).groupBy("session_id", "lane", "type").agg(F.count("*").alias("n"), F.count("prompt_id").alias("prompted"))


TOKENS = ["input_tokens", "cache_write_tokens", "cache_read_tokens", "output_tokens"]


@query("s02_stream_snapshot_fold", with_ctes(["requests_t"], f"SELECT session_id, message_id, epoch_us(ts) AS ts_us, model, stop_reason, {', '.join(TOKENS)} FROM requests_t"))
def _(spark, sf):
    ev = flat_events(stream_of(spark, sf, "events")).filter("request_id IS NOT NULL").select("session_id", F.col("request_id").alias("message_id"), "line_no", "ts", "model", "stop_reason", *TOKENS)
    rows = twins.run_updates(twins.folded_requests(ev), *places(spark, "fold"))
    newest = rows.groupBy("session_id", "message_id").agg(F.max_by(F.struct("ts", "model", "stop_reason", *TOKENS), "epoch").alias("r"))
    return newest.select("session_id", "message_id", F.unix_micros("r.ts").alias("ts_us"), "r.model", "r.stop_reason", *[f"r.{t}" for t in TOKENS])


@query("s03_stream_usage_by_day", """SELECT strftime(l, '%Y-%m-%d') AS day, event_type AS model, count(*) AS requests, cast(sum(cast(round(value) AS bigint)) AS bigint) AS output_tokens
    FROM (SELECT *, timezone('America/New_York', timezone('UTC', ts)) AS l FROM events) GROUP BY 1, 2""")
def _(spark, sf):
    ev = stream_of(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("model"), F.round("value").cast("bigint").alias("output_tokens"))
    return twins.run_to_end(ev, lambda rows: twins.usage_by_day(rows, "America/New_York"), "ts", *places(spark, "usage")).select("day", "model", "requests", "output_tokens")


@query("s04_stream_activity_sessions", """WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    r AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts) AS run FROM g)
    SELECT user_id AS session_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) + 21600000000 AS end_us, count(*) AS n FROM r GROUP BY user_id, run""")
def _(spark, sf):
    ev = stream_of(spark, sf, "events").select(F.col("user_id").alias("session_id"), F.col("ts").cast("timestamp").alias("ts"))
    out = twins.run_to_end(ev, lambda rows: twins.activity_sessions(rows, "6 hours", "1 hour"), "ts", *places(spark, "activity"))
    return out.select("session_id", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "n")


@query("s05_stream_poll_alerts", with_ctes(["messages_t"], f"""WITH {CALLS}, isl AS (SELECT *, sum(brk) OVER (PARTITION BY session_id ORDER BY line_no) AS run FROM (
      SELECT *, CASE WHEN lag(ref) OVER w IS DISTINCT FROM ref OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS brk FROM calls WINDOW w AS (PARTITION BY session_id ORDER BY line_no)))
    SELECT session_id, line_no, ref FROM isl WHERE ref IS NOT NULL QUALIFY row_number() OVER (PARTITION BY session_id, run ORDER BY line_no) = 3"""))
def _(spark, sf):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    rows = flat_events(stream_of(spark, sf, "events")).withColumn("pos", F.lit(0))
    return drained(spark, twins.poll_alerts(waits.calls_of(rows).select("session_id", "line_no", "ref", "ts")), "polls")


@query("s06_stream_limit_resets", with_ctes(["limits_t"], """SELECT kind, strftime(resets_at, '%Y-%m-%dT%H') AS window_id, seq, pct, was FROM (SELECT *, lag(pct) OVER (PARTITION BY kind, resets_at ORDER BY seq) AS was
    FROM limits_t WHERE resets_at IS NOT NULL) WHERE was - pct >= 5"""))
def _(spark, sf):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    ev = stream_of(spark, sf, "events").selectExpr("event_id AS seq", "cast(date_trunc('MILLISECOND', ts) AS timestamp) AS ts", *[f"{e} AS {n}" for n, e in st.limit_columns().items()])
    week = F.date_trunc("week", "ts") + F.expr("interval 7 days")
    five = F.timestamp_seconds((F.floor(F.unix_seconds("ts") / 18000) + 1) * 18000)
    resets = F.when(F.col("kind") == "five_hour", five).when(F.col("kind") != "spend_limit", week)
    rows = ev.withColumn("window_id", F.date_format(resets, "yyyy-MM-dd'T'HH")).filter("window_id IS NOT NULL").select("kind", "window_id", "seq", "pct", "ts")
    return drained(spark, twins.reset_alerts(rows), "resets")


@query("s07_stream_message_pairs", with_ctes(["pair"], "SELECT msg AS msg_id, sender AS sender_session, receiver AS receiver_session FROM pair WHERE acked AND NOT refused AND copied"))
def _(spark, sf):
    p = stream_of(spark, sf, "orders").selectExpr(*[f"{e} AS {n}" for n, e in st.message_pair_columns("spark").items()])
    q = stream_of(spark, sf, "orders").selectExpr(*[f"{e} AS {n}" for n, e in st.message_pair_columns("spark").items()])
    acks = p.filter("acked AND NOT refused").select(F.col("msg").alias("msg_id"), F.col("sender").alias("session_id"), F.col("sent_at").alias("ts"))
    copies = q.filter("copied").select(F.col("msg").alias("msg_id"), F.col("receiver").alias("session_id"), (F.col("sent_at") + F.expr("interval 2 seconds")).alias("ts"))
    return drained(spark, twins.paired_messages(acks, copies), "pairs").select("msg_id", "sender_session", "receiver_session")


@query("s08_stream_ledger_dedupe", "SELECT l_orderkey, count(DISTINCT l_linenumber) AS lines FROM lineitem GROUP BY 1")
def _(spark, sf):
    li = stream_of(spark, sf, "lineitem").select("l_orderkey", F.concat_ws("-", "l_orderkey", "l_linenumber").alias("child"), F.lit("2024-01-01").cast("timestamp").alias("ts"))
    out = drained(spark, twins.deduplicated_ledger(li), "ledger")
    return out.groupBy("l_orderkey").agg(F.count("*").alias("lines"))
