"""Keeping the tables: incremental refresh, additive mirror, purge, redacted copies, sinks."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F, types as T

from logloom.functions import fixed_values as fv
from logloom.functions.python_helpers import scrubbed_json
from logloom.schemas import SCHEMA_VERSION, Corpus
from logloom.sources import transcripts as tr


def changed_files(current: DataFrame, manifest: DataFrame | None, full: bool = False) -> DataFrame:
    """Files to read again: new, or another size or modification time than the manifest holds."""
    if full or manifest is None:
        return current
    return current.join(manifest.select("file_path", "size", "mtime_ms"), ["file_path", "size", "mtime_ms"], "left_anti")


def unfilled_spawns(spawns: DataFrame, spawn_requests: DataFrame) -> DataFrame:
    """Sub-agents that count requests but have none stored: read again whatever the manifest says."""
    return spawns.filter("requests > 0").join(spawn_requests.select("agent_id").distinct(), "agent_id", "left_anti").select("agent_id")


def replaced(old: DataFrame, fresh: DataFrame, changed: DataFrame, key: str) -> DataFrame:
    """Delete-and-insert by key: rows of changed keys come from the fresh read only."""
    return old.join(changed.select(key).distinct(), key, "left_anti").unionByName(fresh, allowMissingColumns=True)


def index_sessions(spark: SparkSession, root: str, lines: DataFrame | None = None) -> Corpus:
    """Read session logs under root into messages, requests, sessions and refusals."""
    raw = tr.session_lines(tr.read_lines(spark, root) if lines is None else lines)
    entries = tr.entries_of(tr.number_records(tr.parse_lines(raw)))
    return Corpus(messages=tr.messages_of(entries), requests=tr.requests_of(entries), sessions=tr.sessions_of(entries, ["well", "size", "mtime_ms"]),
                  limits=tr.refusals_of(entries), extra={"entries": entries})


def refresh_counters(current: DataFrame, manifest: DataFrame | None, messages: DataFrame, full: bool = False) -> DataFrame:
    """indexed, skipped, messages of one refresh."""
    todo = changed_files(current, manifest, full)
    n = lambda df: df.agg(F.count("*")).scalar()
    one = current.sparkSession.range(1).select(n(todo).alias("indexed"), n(current).alias("files"), n(messages).alias("messages"))
    return one.select("indexed", (F.col("files") - F.col("indexed")).alias("skipped"), "messages")


def write_table(df: DataFrame, path: str, partition: list[str] | None = None, mode: str = "overwrite") -> dict:
    """Parquet sink with the schema version beside the data; returns the observed row count.

    Partitioned writes replace only the partitions present in df.
    """
    seen = Observation()
    writer = df.observe(seen, F.count(F.lit(1)).alias("rows")).withColumn("schema_version", F.lit(SCHEMA_VERSION)).write.mode(mode)
    if partition:
        writer = writer.partitionBy(*partition).option("partitionOverwriteMode", "dynamic")
    writer.parquet(path)
    return seen.get


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """Parquet source; a table written by a newer version is refused."""
    df = spark.read.parquet(path)
    newest = df.agg(F.max("schema_version")).first()[0]
    if newest is not None and newest > SCHEMA_VERSION:
        raise ValueError(f"{path} has schema version {newest}, this engine reads {SCHEMA_VERSION}")
    return df.drop("schema_version")


def mirror(archive: DataFrame, current: DataFrame, run_ts: Column) -> tuple[DataFrame, DataFrame]:
    """Additive mirror: (new or changed file versions, one manifest row). Deletions never propagate."""
    second = F.floor(F.col("mtime_ms") / 1000)
    have = archive.select("file_path", "size", second.alias("sec")).distinct()
    fresh = current.withColumn("sec", second).join(have, ["file_path", "size", "sec"], "left_anti").drop("sec")
    manifest = fresh.agg(F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")).withColumn("ts", run_ts)
    return fresh, manifest


PURGED = ["messages", "requests", "spawns", "spawn_requests", "workflow_runs", "history"]


def _purged_rows(name: str, df: DataFrame, session: str, sessions: DataFrame | None) -> DataFrame:
    mine = df.filter(F.col("session_id") == session)
    if name == "limits":
        return mine.filter("source = 'transcript'")
    if name == "jobs" and sessions is not None:
        others = sessions.filter(F.col("session_id") != session)
        roots = others.select(F.col("job_session_id").alias("session_id")).filter("session_id IS NOT NULL").distinct()
        bridges = others.select("bridge_key").filter("bridge_key IS NOT NULL").distinct()
        return mine.join(roots, "session_id", "left_anti").join(bridges, "bridge_key", "left_anti")
    return mine


def purge_report(c: Corpus, session: str) -> DataFrame:
    """Dry run: rows a purge would remove, per table."""
    names = ["sessions", *PURGED, "limits", "jobs"]
    counts = [_purged_rows(n, getattr(c, n), session, c.sessions).agg(F.count("*").alias("rows")).withColumn("table", F.lit(n))
              for n in names if getattr(c, n) is not None]
    out = counts[0]
    for x in counts[1:]:
        out = out.unionByName(x)
    return out.select("table", "rows")


def purge(c: Corpus, session: str) -> Corpus:
    """Every table without one session; a job row goes only if no other session refers to it."""
    keep = {}
    for n in ["sessions", *PURGED, "limits"]:
        df = getattr(c, n)
        if df is not None:
            gone = F.coalesce(F.col("session_id") == session, F.lit(False))
            keep[n] = df.filter(~(gone & (F.col("source") == "transcript"))) if n == "limits" else df.filter(~gone)
    if c.jobs is not None:
        keep["jobs"] = c.jobs.join(_purged_rows("jobs", c.jobs, session, c.sessions).select("job_id"), "job_id", "left_anti")
    return c.with_tables(**keep)


class _Redaction:
    """Rules by key name, applied at every depth of a typed value."""

    def __init__(self, home: str):
        self.home = home
        self.slug = "".join(ch if ch.isalnum() and ch.isascii() else "-" for ch in home)

    def rewritten(self, text: Column) -> Column:
        at_home = F.replace(text, F.lit(self.home), F.lit(fv.HOME_STANDIN))
        return F.replace(at_home, F.lit(self.slug), F.lit(fv.HOME_SLUG_STANDIN))

    def text(self, text: Column, key: Column, frame: Column) -> Column:
        """A string under `key`; what is cut is cut before paths are rewritten."""
        def cut(over: int, to: int) -> Column:
            return F.when(F.char_length(text) > over, F.concat(F.substring(text, 1, to), F.lit("…"))).otherwise(text)

        out = F.when(text.isNull(), F.lit(None).cast("string")).when(key == fv.LINK_KEY, fv.LINK_STANDIN)
        for name, standin in fv.FRAME_STANDINS.items():
            out = out.when(frame & (key == name), standin)
        out = out.when(key.isin(fv.PROSE_KEYS), F.when(text == "", "").otherwise(key))
        out = out.when(key.isin(fv.ARGUMENT_KEYS), self.rewritten(cut(fv.ARGUMENT_CHARS, fv.ARGUMENT_HEAD)))
        out = out.when(key == "title", self.rewritten(cut(fv.TITLE_CHARS, fv.TITLE_CHARS)))
        return out.otherwise(self.rewritten(text))

    def value(self, value: Column, kind: T.DataType, key: Column, frame: Column) -> Column:
        if isinstance(kind, T.StringType):
            return self.text(value, key, frame)
        if isinstance(kind, T.ArrayType):
            return F.transform(value, lambda v: self.value(v, kind.elementType, key, F.lit(False)))
        if isinstance(kind, T.MapType):
            open_ = F.map_filter(value, lambda k, _: ~k.rlike(fv.SECRET_KEYS))
            return F.transform_values(open_, lambda k, v: self.value(v, kind.valueType, k, F.lit(False)))
        if isinstance(kind, T.StructType):
            own = [f for f in kind.fields if not re.search(fv.SECRET_KEYS, f.name)]
            framed = F.coalesce(value["kind"] == fv.FRAME_KIND, F.lit(False)) if "kind" in kind.names else F.lit(False)
            parts = [self.value(value[f.name], f.dataType, F.lit(f.name), framed).alias(f.name) for f in own]
            return F.when(value.isNotNull(), F.struct(*parts)) if parts else F.lit(None)
        return value


def redacted(rows: DataFrame, home: str, text: str = "text", json: dict[str, str | None] | None = None) -> DataFrame:
    """A copy without secrets or prose, at any depth of structs, arrays and maps: secret-like keys
    dropped, prose replaced by its key name (empty stays empty), links and the names of frames by
    stand-ins, launch arguments and titles cut, home paths rewritten, long text kept as its length.

    `json` names columns that hold JSON text. With a type they come back as JSON of its fields, and what
    the type does not name is left out; with None all fields stay, whatever they are, in their order.
    Text that is no such JSON becomes an empty object.
    """
    rules, out = _Redaction(home), {}
    for f in rows.schema.fields:
        if re.search(fv.SECRET_KEYS, f.name):
            continue
        col = F.col(f"`{f.name}`")
        if f.name in (text, f"whole_{text}") and isinstance(f.dataType, T.StringType):
            out[f"{f.name}_chars"] = F.length(col)
        elif json and f.name in json and json[f.name] is None:
            out[f.name] = scrubbed_json(col, f.name, home, rules.slug)
        elif json and f.name in json:
            kind = T.DataType.fromDDL(json[f.name])
            out[f.name] = F.to_json(rules.value(F.from_json(col, kind), kind, F.lit(f.name), F.lit(False)))
        else:
            out[f.name] = rules.value(col, f.dataType, F.lit(f.name), F.lit(False))
    return rows.select(*[e.alias(n) for n, e in out.items()])
