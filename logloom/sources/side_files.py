"""The small logs and state files beside the transcripts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from logloom import schemas
from logloom.functions import fixed_values as fv
from logloom.functions.envelope import bridge_key
from logloom.functions.python_helpers import workflow_meta
from logloom.operators.ordered import top_one

_CORRUPT = {"columnNameOfCorruptRecord": "_corrupt"}
META_PATH = r"/agent-([^/]+)\.meta\.json$"
RUN_PATH = r"/([^/]+)/([^/]+)/workflows/(wf_[^/]+)\.json$"
JOB_PATH = r"/([^/]+)/state\.json$"


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select("value", F.col("_metadata.file_block_start").alias("block_start"),
                                        F.monotonically_increasing_id().alias("row_seq"))


def whole_files(spark: SparkSession, root: str, glob: str) -> DataFrame:
    return (spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).option("wholetext", "true").text(root)
            .select("value", F.col("_metadata.file_path").alias("file_path")))


def _parsed(lines: DataFrame, schema: str) -> DataFrame:
    keep = [c for c in lines.columns if c != "value"]
    return lines.filter(F.trim("value") != "").select(*keep, F.from_json("value", schema, _CORRUPT).alias("r"))


def instant(s):
    """An instant spelled in ISO or as epoch milliseconds; NULL where it is neither."""
    return F.when(s.rlike(r"^\d{9,14}$"), F.timestamp_millis(s.try_cast("bigint"))).otherwise(F.try_to_timestamp(s))


def history(lines: DataFrame) -> DataFrame:
    """Prompt history, reloaded whole; torn lines skipped. ts stays epoch milliseconds as text."""
    rows = _parsed(lines, schemas.HISTORY).filter("r._corrupt IS NULL")
    return rows.select(F.col("r.timestamp").alias("ts"), F.col("r.project").alias("project"), F.col("r.sessionId").alias("session_id"),
                       F.coalesce("r.display", F.lit("")).alias("display"))


def limit_log(lines: DataFrame) -> DataFrame:
    """Window readings of source 'mod'; invalid lines skipped (also those without a readable time), the first of equal keys kept."""
    rows = _parsed(lines, schemas.LIMIT_LINE).withColumn("ts", instant(F.col("r.ts"))).filter("r._corrupt IS NULL AND ts IS NOT NULL AND r.kind IS NOT NULL AND r.pct IS NOT NULL")
    rows = rows.select(F.lit("mod").alias("source"), F.col("r.session").alias("session_id"), "ts", F.col("r.kind").alias("kind"),
                       F.col("r.pct").alias("pct"), instant(F.col("r.resetsAt")).alias("resets_at"), "block_start", "row_seq")
    at = F.struct("block_start", "row_seq")
    return top_one(rows, ["source", "session_id", "ts", "kind"], at, ["pct", "resets_at"])


def rebuilt_limits(limits: DataFrame, fresh: DataFrame) -> DataFrame:
    """The limits table with the rows of source 'mod' rebuilt; other sources stay."""
    return limits.filter("source <> 'mod'").unionByName(fresh)


LEDGER_COLUMNS = ["child", "ts", "kind", "host", "via", "name", "model", "effort", "cwd", "worktree", "branch", "replaced", "draft",
                  "parent_job", "parent_session", "parent_bridge"]


def ledger_lines(lines: DataFrame) -> DataFrame:
    """Ledger lines with the reason a line is left out (NULL = kept)."""
    rows = _parsed(lines, schemas.LEDGER_LINE)
    broken = F.col("r._corrupt").isNotNull() | F.col("r.v").isNull() | F.col("r.ts").isNull() | F.col("r.kind").isNull() | F.col("r.child").isNull()
    ts = F.try_to_timestamp("r.ts")
    why = (F.when(broken, "malformed").when(F.col("r.v") != fv.LEDGER_VERSION, "version")
           .when(~F.col("r.kind").isin(fv.LEDGER_KINDS), "kind").when(ts.isNull(), "malformed"))
    plain = ["child", "kind", "host", "via", "name", "model", "effort", "cwd", "worktree", "branch", "replaced", "draft"]
    return rows.select(why.alias("skipped"), ts.alias("ts"), *[F.col(f"r.{n}").alias(n) for n in plain],
                       *[F.col(f"r.parent.{n}").alias(f"parent_{n}") for n in ("job", "session", "bridge")], "block_start", "row_seq")


def ledger_stats(rows: DataFrame) -> DataFrame:
    n = lambda why: F.sum(F.coalesce(F.col("skipped") == why, F.lit(False)).cast("bigint")).alias(why)
    return rows.agg(F.count("*").alias("lines"), n("version"), n("kind"), n("malformed"))


def ledger_append(ledger: DataFrame | None, rows: DataFrame) -> DataFrame:
    """Insert-or-ignore on (child, ts): the first line wins and rows outlive the file."""
    good = rows.filter("skipped IS NULL")
    fresh = top_one(good, ["child", "ts"], F.struct("block_start", "row_seq"), [c for c in LEDGER_COLUMNS if c not in ("child", "ts")]).select(*LEDGER_COLUMNS)
    if ledger is None:
        return fresh
    return ledger.unionByName(fresh.join(ledger.select("child", "ts"), ["child", "ts"], "left_anti"))


def job_states(files: DataFrame) -> DataFrame:
    """One row per job-state file; malformed files skipped."""
    rows = files.select(F.regexp_extract("file_path", JOB_PATH, 1).alias("job_id"), F.from_json("value", schemas.JOB_STATE, _CORRUPT).alias("r"))
    rows = rows.filter("r._corrupt IS NULL")
    return rows.select("job_id", F.col("r.sessionId").alias("session_id"), bridge_key(F.col("r.bridgeSessionId")).alias("bridge_key"), F.col("r.name").alias("name"),
                       F.col("r.cwd").alias("cwd"), F.col("r.state").alias("state"), instant(F.col("r.createdAt")).alias("created_at"),
                       instant(F.col("r.updatedAt")).alias("updated_at"), F.lit("state").alias("source"))


def upsert_jobs(jobs: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Jobs after a snapshot: listed ones replaced, unlisted ones of source 'state' become 'gone'."""
    old, new = jobs.alias("o"), snapshot.withColumn("listed", F.lit(True)).alias("n")
    both = old.join(new, "job_id", "full")
    listed = F.col("n.listed").isNotNull()
    gone = ~listed & (F.col("o.source") == "state")
    cols = [c for c in jobs.columns if c != "job_id"]
    pick = lambda c: F.when(listed, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))
    out = {c: pick(c) for c in cols}
    out["state"] = F.when(gone, "gone").otherwise(pick("state"))
    out["source"] = F.coalesce("o.source", "n.source")
    return both.select("job_id", *[e.alias(c) for c, e in out.items()])


def spawn_meta(files: DataFrame) -> DataFrame:
    """Sidecars of sub-agent logs; malformed ones read as nulls."""
    rows = files.select(F.regexp_extract("file_path", META_PATH, 1).alias("agent_id"), F.from_json("value", schemas.SPAWN_META, _CORRUPT).alias("r"))
    return rows.select("agent_id", F.col("r.agentType").alias("agent_type"), F.col("r.description").alias("description"),
                       F.col("r.spawnDepth").alias("spawn_depth"), F.col("r.model").alias("requested_model"))


def workflow_runs(files: DataFrame) -> DataFrame:
    """One row per workflow-run file, described by the meta literal heading its script."""
    rows = files.select("file_path", F.from_json("value", schemas.WORKFLOW_RUN, _CORRUPT).alias("r")).filter(
        "r._corrupt IS NULL AND r.runId IS NOT NULL AND r.script IS NOT NULL")
    rows = rows.withColumn("m", workflow_meta(F.col("r.script")))
    return rows.select(F.col("r.runId").alias("run_id"), F.regexp_extract("file_path", RUN_PATH, 1).alias("well_dir"),
                       F.regexp_extract("file_path", RUN_PATH, 2).alias("session_id"), F.col("m.name").alias("name"), F.col("m.description").alias("description"),
                       F.when(F.size("m.phases") > 0, F.col("m.phases")).alias("phases"), F.col("r.taskId").alias("task_id"), F.col("r.script").alias("script"),
                       instant(F.col("r.timestamp")).alias("recorded_ts"))
