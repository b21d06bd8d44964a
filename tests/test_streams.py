"""Streams on real files: ingest of closed logs, state that expires by event time."""

import json
import time

from pyspark.sql import functions as F

from logloom.sources import transcripts as tr
from logloom.streaming import twins

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _ended(spark, frame, tmp_path, name):
    """The rows of a stream that is drained and has to end by itself."""
    return twins.run_to_folder(frame, str(tmp_path / f"{name}-out"), str(tmp_path / f"{name}-checkpoint"))


def _fed(spark, tmp_path, name, schema, triggers):
    """A stream that reads one file a trigger, in the order given."""
    folder = tmp_path / name
    folder.mkdir()
    for i, rows in enumerate(triggers):
        (folder / f"{i}.json").write_text("\n".join(json.dumps(r) for r in rows))
        time.sleep(0.05)  # files are taken by their time
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(folder)).withColumn("ts", F.to_timestamp("t"))


def test_a_run_of_reads_is_forgotten_when_the_watermark_has_passed_it(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    call = lambda s, n, day, ref="f": {"session_id": s, "line_no": n, "ref": ref, "t": f"2026-01-{day:02} 00:00:00"}
    feed = [[call("old", 1, 1), call("old", 2, 1), call("kept", 1, 1), call("kept", 2, 1)], [call("kept", 3, 4, "f")], [call("other", 1, 20)], [call("other", 2, 20, "g")], [call("old", 3, 21), call("old", 4, 21), call("old", 5, 21)]]
    schema = "session_id string, line_no bigint, ref string, t string"
    got = lambda name, days: sorted(tuple(r) for r in _ended(spark, twins.poll_alerts(_fed(spark, tmp_path, name, schema, feed), days), tmp_path, name).collect())
    assert got("forgets", 5) == [("kept", 3, "f"), ("old", 5, "f")]
    assert got("remembers", None) == [("kept", 3, "f"), ("old", 3, "f")]


def test_a_last_reading_is_forgotten_when_the_watermark_has_passed_it(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    read = lambda w, seq, day, pct: {"kind": "five_hour", "window_id": w, "seq": seq, "pct": pct, "t": f"2026-01-{day:02} 00:00:00"}
    feed = [[read("a", 1, 1, 60.0), read("b", 1, 1, 70.0)], [read("b", 2, 2, 50.0)], [read("c", 1, 25, 1.0)], [read("c", 2, 25, 2.0)], [read("a", 2, 26, 10.0)]]
    schema = "kind string, window_id string, seq bigint, pct double, t string"
    got = lambda name, days: sorted(tuple(r)[1:] for r in _ended(spark, twins.reset_alerts(_fed(spark, tmp_path, name, schema, feed), days), tmp_path, name).collect())
    assert got("forgets", 10) == [("b", 2, 50.0, 70.0)]
    assert got("remembers", None) == [("a", 2, 10.0, 60.0), ("b", 2, 50.0, 70.0)]


def test_closed_files_stream_into_the_tables_of_a_batch(spark, tmp_path):
    logs = tmp_path / "logs" / "w"
    logs.mkdir(parents=True)
    for s in ("s1", "s2"):
        recs = [{"type": "user", "timestamp": f"2026-01-01T00:00:0{i}Z", "sessionId": s, "promptId": f"P{i // 2}", "message": {"role": "user", "content": f"{s} says {i}"}} for i in range(5)]
        (logs / f"{s}.jsonl").write_text("\n".join(map(json.dumps, recs)) + "\n\n{torn")
    folder = str(tmp_path / "tables")

    def tables(lines):
        return tr.messages_of(tr.entries_of(tr.number_records(tr.parse_lines(tr.session_lines(lines))))).select("session_id", "line_no", "lane", "prompt_id", "text")

    twins.ingest(twins.log_stream(spark, str(tmp_path / "logs"), 1), lambda batch, epoch: twins.write_epoch(tables(batch), epoch, folder), str(tmp_path / "checkpoint")).awaitTermination(120)
    got = sorted(map(tuple, spark.read.parquet(folder).drop("epoch").collect()))
    assert got == sorted(map(tuple, tables(tr.read_lines(spark, str(tmp_path / "logs"))).collect())) and len(got) == 10
