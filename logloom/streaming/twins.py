"""Structured Streaming forms of the batch operators. Each has a batch twin with equal results."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from logloom.functions import fixed_values as fv
from logloom.functions.timekeys import local


def log_stream(spark: SparkSession, root: str, files_per_trigger: int | None = None) -> DataFrame:
    """Lines of closed log files, each file read once (S1). Growing files stay on the refresh path."""
    reader = spark.readStream.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.text(root).select(
        "value", F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_block_start").alias("block_start"),
        F.col("_metadata.file_size").alias("size"), F.unix_millis(F.col("_metadata.file_modification_time")).alias("mtime_ms"))


def ingest(stream: DataFrame, write_batch, checkpoint: str):
    """Run a batch ingest on every micro-batch of closed files; write_batch may see an epoch again after a failure (see write_epoch)."""
    def each(batch: DataFrame, epoch: int) -> None:
        write_batch(batch.withColumn("row_seq", F.monotonically_increasing_id()), epoch)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def write_epoch(rows: DataFrame, epoch: int, folder: str) -> None:
    """Rows of one micro-batch into a partition of its own; a batch that is tried again replaces what it left."""
    rows.write.mode("overwrite").parquet(f"{folder}/epoch={epoch}")


def folded_requests(snapshots: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Snapshot fold in update mode (S2): maximum of each token class, first instant, first known model, last known stop per request."""
    tokens = [c for c in snapshots.columns if c.endswith("_tokens")]
    known = lambda c: F.when(F.col(c).isNotNull(), F.col("line_no"))
    return snapshots.withWatermark("ts", delay).groupBy("session_id", "message_id").agg(
        F.min_by("ts", "line_no").alias("ts"), F.min_by("model", known("model")).alias("model"),
        F.max_by("stop_reason", known("stop_reason")).alias("stop_reason"), *[F.max(t).alias(t) for t in tokens])


def usage_by_day(requests: DataFrame, tz: str = "UTC", delay: str = "1 day") -> DataFrame:
    """Tokens per local day in append mode (S3): tumbling windows after the zone shift."""
    rows = requests.withColumn("local_ts", local(F.col("ts"), tz)).withWatermark("local_ts", delay)
    tokens = [c for c in requests.columns if c.endswith("_tokens")]
    out = rows.groupBy(F.window("local_ts", "1 day"), "model").agg(F.count("*").alias("requests"), *[F.sum(t).alias(t) for t in tokens])
    return out.withColumn("day", F.date_format("window.start", "yyyy-MM-dd")).drop("window")


def activity_sessions(rows: DataFrame, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """Bursts of work per session, closed by a gap."""
    out = rows.withWatermark("ts", delay).groupBy("session_id", F.session_window("ts", gap)).agg(F.count("*").alias("n"))
    return out.select("session_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


POLL_ALERT = T.StructType([T.StructField("session_id", T.StringType()), T.StructField("line_no", T.LongType()), T.StructField("ref", T.StringType())])
STATE_DAYS = 30


class _Watch(StatefulProcessor):
    """One key's rows of a trigger in order, and state that goes when the watermark is `days` past the key's last row.

    The trigger size (files per trigger) bounds the rows. A key has one timer, moved on with each row; without `days`
    nothing expires.
    """

    state: str

    def __init__(self, days: int | None = STATE_DAYS):
        self.days = days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.seen = handle, handle.getValueState("seen", self.state)

    def in_order(self, rows: Iterator[pd.DataFrame], order: str, value: str):
        held = pd.concat(rows)
        if self.days is not None:
            timers = list(self.handle.listTimers())
            until = max([*timers, int(held["at_ms"].max()) + self.days * 86_400_000])
            for t in timers:
                self.handle.deleteTimer(t)
            self.handle.registerTimer(until)
        return held[[order, value]].sort_values(order).itertuples(index=False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.seen.clear()
        return iter([])

    def close(self) -> None:
        pass


def _alerting(rows: DataFrame, keys: list[str], columns: list[str], processor: _Watch, schema: T.StructType, delay: str) -> DataFrame:
    """Timers follow event time, so a drained stream ends by itself; rows later than `delay`, or without an instant, do not count."""
    if processor.days is None:
        return rows.select(*keys, *columns).groupBy(*keys).transformWithStateInPandas(processor, schema, "Append", "None")
    timed = rows.where("ts IS NOT NULL").withWatermark("ts", delay).select(*keys, *columns, "ts", F.unix_millis("ts").alias("at_ms"))
    return timed.groupBy(*keys).transformWithStateInPandas(processor, schema, "Append", "EventTime")


class PollGuard(_Watch):
    """Alert on every third consecutive read of one task file (S5). State: the current run only."""

    state = "ref string, n bigint"

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        ref, n = self.seen.get() if self.seen.exists() else (None, 0)
        alerts = []
        for line, seen in self.in_order(rows, "line_no", "ref"):
            seen = None if pd.isna(seen) else seen
            n = n + 1 if seen is not None and seen == ref else (0 if seen is None else 1)
            ref = seen
            if n == fv.RUN_MIN:
                alerts.append((key[0], int(line), ref))
        self.seen.update((ref, n))
        yield pd.DataFrame(alerts, columns=["session_id", "line_no", "ref"])


def poll_alerts(calls: DataFrame, days: int | None = STATE_DAYS, delay: str = "1 day") -> DataFrame:
    """calls(session_id, line_no, ref, ts), in order within a trigger; ts may be left out if nothing expires."""
    return _alerting(calls, ["session_id"], ["line_no", "ref"], PollGuard(days), POLL_ALERT, delay)


RESET_ALERT = T.StructType([T.StructField("kind", T.StringType()), T.StructField("window_id", T.StringType()), T.StructField("seq", T.LongType()),
                            T.StructField("pct", T.DoubleType()), T.StructField("was", T.DoubleType())])


class ResetWatch(_Watch):
    """Alert on every drop of at least five points inside one window (S6). State: the last reading."""

    state = "pct double"

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        was = self.seen.get()[0] if self.seen.exists() else None
        alerts = []
        for seq, pct in self.in_order(rows, "seq", "pct"):
            if was is not None and was - pct >= fv.RESET_DROP:
                alerts.append((key[0], key[1], int(seq), float(pct), float(was)))
            was = float(pct)
        self.seen.update((was,))
        yield pd.DataFrame(alerts, columns=["kind", "window_id", "seq", "pct", "was"])


def reset_alerts(readings: DataFrame, days: int | None = STATE_DAYS, delay: str = "1 day") -> DataFrame:
    """readings(kind, window_id, seq, pct, ts): keyed by window, so one kind's history is split over its windows."""
    return _alerting(readings, ["kind", "window_id"], ["seq", "pct"], ResetWatch(days), RESET_ALERT, delay)


def paired_messages(acks: DataFrame, copies: DataFrame, delay: str = "1 hour", reach: str = "1 day") -> DataFrame:
    """Stream-stream join of both halves of a message (S7), bounded on both sides."""
    a = acks.select(F.col("msg_id"), F.col("session_id").alias("sender_session"), F.col("ts").alias("acked_at")).withWatermark("acked_at", delay)
    b = copies.select(F.col("msg_id").alias("m"), F.col("session_id").alias("receiver_session"), F.col("ts").alias("received_at")).withWatermark("received_at", delay)
    near = F.expr(f"received_at BETWEEN acked_at - INTERVAL {reach} AND acked_at + INTERVAL {reach}")
    return a.join(b, (F.col("msg_id") == F.col("m")) & near).drop("m")


def deduplicated_ledger(rows: DataFrame, delay: str = "7 days") -> DataFrame:
    """First line per (child, ts) within the watermark."""
    return rows.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["child", "ts"])


def run_updates(stream: DataFrame, folder: str, checkpoint: str) -> DataFrame:
    """Drain an update-mode stream: every batch's changed rows land in Parquet, in a partition per batch."""
    write_epoch(stream.sparkSession.createDataFrame([], stream.schema), -1, folder)  # a stream without rows reads as empty

    def each(batch: DataFrame, epoch: int) -> None:
        write_epoch(batch, epoch, folder)

    schema = T.StructType(stream.schema.fields + [T.StructField("epoch", T.LongType())])
    q = stream.writeStream.foreachBatch(each).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(schema).parquet(folder)


def run_to_folder(stream: DataFrame, folder: str, checkpoint: str) -> DataFrame:
    """Drain an append-mode stream into Parquet and read it back."""
    q = (stream.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(folder)


def run_to_end(rows: DataFrame, plan: Callable[[DataFrame], DataFrame], time: str, folder: str, checkpoint: str) -> DataFrame:
    """Drain rows through an append-mode plan over event time, the last windows included.

    Append mode keeps a window back until the watermark has passed it. When the rows are
    drained, the same query goes on with one closing row that is null but for a far `time`: the
    watermark passes every window of the rows, and the closing row's own window stays open.
    """
    spark, marks = rows.sparkSession, f"{folder}-marks"
    spark.createDataFrame([], rows.schema).write.parquet(marks)
    both = rows.unionByName(spark.readStream.schema(rows.schema).parquet(marks))
    run_to_folder(plan(both), folder, checkpoint)
    far = {time: F.lit("9999-01-01").cast("timestamp")}
    spark.range(1).select(*[far.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in rows.schema]).write.mode("append").parquet(marks)
    return run_to_folder(plan(both), folder, checkpoint)
