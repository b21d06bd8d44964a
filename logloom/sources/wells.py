"""Wells: the directories sessions live in, and the real paths behind their slugs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from logloom.functions import fixed_values as fv
from logloom.functions.python_helpers import slug


def file_index(spark: SparkSession, root: str) -> DataFrame:
    """Path, size and modification time of every file; contents are not read."""
    return (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
            .select(F.col("path").alias("file_path"), F.col("length").alias("size"), F.unix_millis("modificationTime").alias("mtime_ms")))


def discover(files: DataFrame, worktrees_only: bool = False) -> DataFrame:
    """Per directory: sessions, bytes, worktree flag, memory flag, newest session."""
    path = F.col("file_path")
    log = path.rlike(r"/([^/]+)/[^/]+\.jsonl$") & ~F.contains(path, F.lit("/subagents/"))
    memory = path.rlike(r"/([^/]+)/memory/")
    rows = files.select(
        F.when(log, F.regexp_extract(path, r"/([^/]+)/[^/]+\.jsonl$", 1)).when(memory, F.regexp_extract(path, r"/([^/]+)/memory/", 1)).alias("dir"),
        F.when(log, F.regexp_extract(path, r"/([^/]+)\.jsonl$", 1)).alias("session_id"), F.when(log, F.col("size")).alias("size"),
        "mtime_ms", memory.alias("memory")).filter("dir IS NOT NULL")
    wells = rows.groupBy("dir").agg(
        F.count("session_id").alias("sessions"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.max("memory").alias("has_memory"),
        F.max_by("session_id", F.when(F.col("session_id").isNotNull(), F.struct("mtime_ms", "session_id"))).alias("newest_session"))
    wells = wells.withColumn("is_worktree", F.contains("dir", F.lit(fv.WORKTREE_MARK)))
    return wells.filter("is_worktree") if worktrees_only else wells


def real_paths(records: DataFrame) -> DataFrame:
    """records(well, cwd, mtime_ms, line_no) -> the working directory whose slug is the well.

    Newest session first, its last line first. Slugs are computed once per
    distinct (well, path), not per line.
    """
    absolute = F.col("cwd").rlike(r"^([/\\]|[A-Za-z]:[/\\])")
    best = records.filter(absolute).groupBy("well", "cwd").agg(F.max(F.struct("mtime_ms", "line_no")).alias("at"))
    return best.filter(slug(F.col("cwd")) == F.col("well")).groupBy("well").agg(F.max_by("cwd", "at").alias("real_path"))


def deslugged(wells: DataFrame, known_paths: DataFrame) -> DataFrame:
    """Fallback for wells without a matching working directory: an equi-join on the slug of known paths."""
    paths = known_paths.select(slug(F.col("path")).alias("dir"), "path").groupBy("dir").agg(F.min("path").alias("path"))
    return wells.join(paths, "dir", "left").withColumn("real_path", F.coalesce("real_path", "path")).drop("path")
