"""SimHash near-duplicate groups by multi-index hashing.

Fingerprints are cut into three segments (22, 21 and 21 bits). Two that differ in at most
four bits differ in at most one bit of some segment, so each fingerprint looks up, per
segment, the values within one bit of its own; what it meets is verified over all 64 bits.
Of two values a bit apart only the one without the bit asks, so a pair meets once per
segment. Equal fingerprints count as one node throughout.

A segment value that very many fingerprints share is not joined with itself. Whoever would
meet there lists the words within two bits of its fingerprint instead: two fingerprints
have such a word in common exactly if they differ in at most four bits, and each links to
the smallest that lists the word. That is linear in the group and loses no link.

Links are joined into components by repeated large-star and small-star steps, each written
to the shared folder. Null and empty texts have fingerprint zero. Repeated rows and
doc_ids are rows of one node or of several, as their texts say; component_id is the smallest
non-null doc_id of the component, so components may share it or have none: root, the
component's smallest fingerprint, is what tells them apart. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from logloom.operators.sizes import small_side
from logloom.operators.stages import staged

SEGMENTS = ((0, 22), (22, 21), (43, 21))
RADIUS, SHINGLE, SEED = 4, 4, 42
HOT = 2_000
_BLOCK = 1 << 16


def text_fingerprint(text: str | None) -> int:
    """64 bits: which bits are set in over half of the hashes of the text's word shingles."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    if len(words) < SHINGLE:
        spans = [(0, len(joined))]
    else:
        spans = list(zip(starts[:len(words) - SHINGLE + 1].tolist(), ends[SHINGLE - 1:].tolist()))
    ones = np.zeros(64, np.int64)
    for at in range(0, len(spans), _BLOCK):
        hashes = np.array([xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in spans[at:at + _BLOCK]], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(spans), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, fp), written once; fp is the fingerprint as a signed long."""

    @F.pandas_udf("long")
    def fingerprint(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([text_fingerprint(t) for t in texts], np.uint64).view(np.int64))

    return staged(docs.select("doc_id", F.xxhash64("text").alias("text_hash"), fingerprint("text").alias("fp")), "fingerprints")


def _segment(offset: int, width: int):
    return F.shiftrightunsigned("fp", offset).bitwiseAND(F.lit((1 << width) - 1))


def _close(a: str, b: str):
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= RADIUS


def _around(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """All words within two bits of each fingerprint."""
    bits = np.uint64(1) << np.arange(64, dtype=np.uint64)
    i, j = np.triu_indices(64, 1)
    ball = np.concatenate([[np.uint64(0)], bits, bits[i] | bits[j]])
    for batch in batches:
        fps = batch["fp"].to_numpy().view(np.uint64)
        for at in range(0, len(fps), 64):
            part = fps[at:at + 64]
            yield pd.DataFrame({"word": (part[:, None] ^ ball[None, :]).ravel().view(np.int64), "fp": np.repeat(part, len(ball)).view(np.int64)})


def links(nodes: DataFrame, hot: int = HOT) -> DataFrame:
    """(a, b) over distinct fingerprints `fp`: enough verified pairs within the radius to connect all that are."""
    entries = nodes.select("fp", F.explode(F.array(*[F.struct(F.lit(i).alias("seg"), _segment(*s).alias("value")) for i, s in enumerate(SEGMENTS)])).alias("e")).select("fp", "e.*")
    entries = staged(entries, "segments")
    crowded = staged(entries.groupBy("seg", "value").count().where(F.col("count") > hot).drop("count"), "segments-crowded")
    width = F.element_at(F.array(*[F.lit(w) for _, w in SEGMENTS]), F.col("seg") + 1)
    flips = F.transform(F.filter(F.sequence(F.lit(0), width - 1), lambda i: F.getbit("value", i) == 0), lambda i: F.col("value") + F.pow(F.lit(2.0), i).cast("long"))
    asks = entries.select("seg", F.col("fp").alias("a"), F.explode(F.concat(F.array("value"), flips)).alias("value"))
    here = ["seg", "value"]
    if crowded.isEmpty():
        table = entries
        star = None
    else:
        few = small_side(crowded)
        table = entries.join(few, here, "left_anti")
        meeting = asks.join(few, here, "left_semi").select(F.col("a").alias("fp")).union(entries.join(few, here, "left_semi").select("fp")).distinct()
        listed = staged(meeting.mapInPandas(_around, "word long, fp long"), "words-around")
        least = listed.groupBy("word").agg(F.min("fp").alias("b"), F.count("*").alias("n")).where("n > 1").drop("n")
        star = listed.join(least, "word").where("fp <> b").select(F.col("fp").alias("a"), "b").distinct()
    pairs = asks.join(table.withColumnRenamed("fp", "b"), here).where((F.col("a") != F.col("b")) & _close("a", "b")).select("a", "b")
    return staged((pairs if star is None else pairs.union(star)).distinct(), "links")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): connected components of undirected edges (a, b), root the smallest node; isolated nodes are absent."""
    step, before = 0, None
    edges = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(down.select("u", F.col("m").alias("v"))).distinct()
        new = staged(small, f"stars-{step}")
        step += 1
        now = new.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if now == before:
            return new.select(F.col("u").alias("node"), F.col("v").alias("root")).union(new.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        edges, before = new, now


def grouped(prints: DataFrame) -> DataFrame:
    """rows with doc_id and fp -> the same with root, which tells components apart, and component_id, which may be null or shared."""
    nodes = staged(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    roots = components(links(nodes.select("fp")))
    joined = nodes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    of = joined.join(named, "root").select("fp", "root", "component_id")
    return prints.join(of, "fp")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, fp, root, component_id), one row per row of docs."""
    return grouped(fingerprints(docs))


def keep_one(docs: DataFrame) -> DataFrame:
    """docs with one document of each component, also of those without an id or with the same one: the smallest doc_id; of repeated rows with that id and text, one."""
    found = near_duplicates(docs)
    kept = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_hash", "fp")).alias("k"))
    kept = kept.select(F.col("k.doc_id").alias("keep_id"), F.col("k.text_hash").alias("keep_hash"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("text_hash"))
    met = rows.join(kept, F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("text_hash") == F.col("keep_hash")), "left_semi")
    return met.dropDuplicates(["id", "text_hash"]).select("row.*")
