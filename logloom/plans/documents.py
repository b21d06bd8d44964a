"""Document corpora and release notes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from logloom.functions import fixed_values as fv
from logloom.functions.text import extract
from logloom.operators.ordered import scan


def choose_refs(refs: DataFrame) -> DataFrame:
    """refs(repo, side local|remote, ref, sha, commit_ts, docs) -> the newer side, and whether the local one is a husk."""
    local, remote = F.col("side") == "local", F.col("side") == "remote"
    at = lambda side: F.max(F.when(side, F.col("commit_ts")))
    per = refs.groupBy("repo").agg(
        at(local).alias("lt"), at(remote).alias("rt"),
        F.max_by(F.struct("ref", "sha", "commit_ts", "docs"), F.when(local, F.col("commit_ts"))).alias("l"),
        F.max_by(F.struct("ref", "sha", "commit_ts", "docs"), F.when(remote, F.col("commit_ts"))).alias("r"))
    use_remote = F.col("lt").isNull() | F.coalesce(F.col("rt") > F.col("lt"), F.lit(False))
    pick = F.when(use_remote, F.col("r")).otherwise(F.col("l"))
    husk = use_remote & (F.col("r.docs") > 0) & (F.coalesce("l.docs", F.lit(0)) == 0)
    return per.select("repo", pick.alias("p"), F.coalesce(husk, F.lit(False)).alias("is_husk")).select("repo", "p.*", "is_husk")


def ownership(has_upstream: Column, identity: Column, authored: Column, forced: Column | None = None) -> Column:
    """foreign with an upstream remote; mine when the identity authored commits; else assisted."""
    known = F.coalesce(identity, F.lit("")) != ""
    found = F.when(has_upstream, "foreign").when(known & (F.coalesce(authored, F.lit(0)) > 0), "mine").otherwise("assisted")
    return found if forced is None else F.when(F.coalesce(forced, F.lit(False)), "assisted").otherwise(found)


def listed_suffix(path: Column, suffixes: list[str]) -> Column:
    """Whether a path is, or ends in, one of the suffixes at a path boundary."""
    cond = F.lit(False)
    for s in suffixes:
        cond = cond | (path == s) | F.endswith(path, F.lit("/" + s))
    return cond


def index_documents(repos: DataFrame, blobs: DataFrame, known: DataFrame | None = None, max_bytes: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(repositories to re-read, their documents): markdown (up to max_bytes, if given), nothing vendored, foreign repositories empty.

    A repository whose (ref, sha, ownership) is unchanged is skipped.
    """
    changed = repos if known is None else repos.join(known.select("repo", "ref", "sha", "ownership"), ["repo", "ref", "sha", "ownership"], "left_anti")
    keep = F.endswith("path", F.lit(".md")) & ~F.contains("path", F.lit("node_modules/"))
    if max_bytes is not None:
        keep = keep & (F.col("size") <= max_bytes)
    docs = blobs.filter(keep).join(changed.filter("ownership <> 'foreign'").select("repo", "ref"), ["repo", "ref"])
    return changed, docs


def refreshed_documents(docs: DataFrame, changed: DataFrame, fresh: DataFrame, live: DataFrame) -> DataFrame:
    """The document table after a refresh: changed repositories replaced, vanished ones pruned."""
    kept = docs.join(changed.select("repo"), "repo", "left_anti").join(live.select("repo").distinct(), "repo", "left_semi")
    return kept.unionByName(fresh.select(*kept.columns))


def repo_list(repos: DataFrame, docs: DataFrame) -> DataFrame:
    per = docs.groupBy("repo").agg(F.count("*").alias("docs"), F.sum("size").alias("bytes"))
    return repos.join(per, "repo", "left").na.fill(0, ["docs", "bytes"]).withColumn("sha", F.substring("sha", 1, 8)).orderBy("repo")


# --- release notes ------------------------------------------------------------------

def version_parts(version: Column) -> Column:
    return F.transform(F.split(version, r"\."), lambda p: F.coalesce(p.try_cast("int"), F.lit(0)))


def compare_versions(a: Column, b: Column) -> Column:
    """-1, 0, 1 by dotted numbers; a missing part is 0."""
    x, y = version_parts(a), version_parts(b)
    n = F.greatest(F.size(x), F.size(y))
    pad = lambda v: F.slice(F.concat(v, F.array_repeat(F.lit(0), n)), F.lit(1), n)
    return F.when(pad(x) < pad(y), -1).when(pad(x) > pad(y), 1).otherwise(0)


def release_entries(lines: DataFrame) -> DataFrame:
    """lines(doc, block_start, row_seq, value) -> entries under the heading they follow.

    The heading is carried forward over chunks, as prompt ids are.
    """
    head = extract(F.col("value"), r"^##\s+(\d+\.\d+\.\d+)\s*$")
    rows = scan(lines, ["doc"], ["block_start", "row_seq"], F.col("block_start"), carry={"version": head})
    rows = rows.filter(F.startswith("value", F.lit("- ")) & F.col("version").isNotNull())
    text = F.trim(F.substring(F.col("value"), F.lit(3), F.length("value")))
    tag = F.lower(extract(text, r"^\[([^\]]+)\]\s+"))
    pre = F.lower(extract(text, r"^([A-Z][A-Za-z -]{2,24}):\s+"))
    is_pre = tag.isNull() & F.coalesce(pre.isin(fv.PREFIX_SURFACES), F.lit(False))
    surface = (F.when(tag.isNotNull(), tag).when(is_pre, pre).when(text.rlike(r"\bClaude apps gateway\b"), "gateway")
               .when(text.rlike(r"(?i)\bself-hosted runners?\b"), "self-hosted runner").otherwise("cli"))
    body = (F.when(tag.isNotNull(), F.regexp_replace(text, r"^\[[^\]]+\]\s+", ""))
            .when(is_pre, F.regexp_replace(text, r"^[A-Z][A-Za-z -]{2,24}:\s+", "")).otherwise(text))
    rows = rows.select("doc", "block_start", "row_seq", "version", surface.alias("surface"), body.alias("text"))
    verb = F.lower(F.regexp_extract("text", "^[A-Za-z]+", 0))
    kind = F.lit("other")
    for name in dict.fromkeys(fv.NOTE_KINDS.values()):
        kind = F.when(verb.isin([v for v, k in fv.NOTE_KINDS.items() if k == name]), name).otherwise(kind)
    topics = F.array_compact(F.array(*[F.when(F.col("text").rlike(p), t) for t, p in fv.NOTE_TOPICS.items()]))
    return rows.withColumns({"kind": kind, "topics": topics})


def pending(entries: DataFrame, installed: str, latest: str) -> DataFrame:
    """Entries of releases in (installed, latest]."""
    v = F.col("version")
    return entries.filter((compare_versions(v, F.lit(installed)) > 0) & (compare_versions(v, F.lit(latest)) <= 0))


def release_status(entries: DataFrame, installed: str, latest: str) -> DataFrame:
    """Per pending release: entries, command-line entries, and counts by kind."""
    rows = pending(entries, installed, latest)
    cli = F.col("surface") == "cli"
    n = lambda cond: F.sum(cond.cast("bigint"))
    kinds = [*dict.fromkeys(fv.NOTE_KINDS.values()), "other"]
    return rows.groupBy("version").agg(F.count("*").alias("entries"), n(cli).alias("cli"), *[n(cli & (F.col("kind") == k)).alias(k) for k in kinds])


def topic_counts(entries: DataFrame, installed: str, latest: str) -> DataFrame:
    rows = pending(entries, installed, latest).filter("surface = 'cli'")
    return rows.select("version", F.explode("topics").alias("topic")).groupBy("version", "topic").agg(F.count("*").alias("n"))


def query_notes(entries: DataFrame, installed: str, latest: str, surface: str = "cli", kind=None, topic=None, grep=None) -> DataFrame:
    rows = pending(entries, installed, latest)
    if surface != "all":
        rows = rows.filter(F.col("surface") == surface)
    rows = rows.filter(F.col("kind") == kind) if kind else rows
    rows = rows.filter(F.array_contains("topics", topic)) if topic else rows
    return rows.filter(F.col("text").rlike(f"(?i){grep}")) if grep else rows


def surface_counts(entries: DataFrame, installed: str, latest: str) -> DataFrame:
    return pending(entries, installed, latest).groupBy("surface").agg(F.count("*").alias("n"))


def worker_drift(workers: DataFrame, installed: str) -> DataFrame:
    """Workers still on another version than the installed one."""
    return workers.filter(F.col("version") != installed).withColumn("behind", compare_versions(F.col("version"), F.lit(installed)) < 0)
