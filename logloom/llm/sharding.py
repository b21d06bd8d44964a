"""Sharding by rendezvous hashing of record keys over weighted shards.

Every (key, shard) pair draws a uniform number u; the record goes to the shard with the
largest -weight / ln u. The key and the shards alone decide, and one more shard only takes
the records it wins. Slots number the records of a shard without gaps: records are counted
by (shard, bucket of the key's hash), running sums give each bucket its first slot, and only
the rows of one bucket are ordered together. A bucket that a repeated key has made too large
is split by row position.

A null key hashes as the word null. Equal rows get neighbouring slots in any order. Null
texts have no bytes. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from logloom.llm.common import key_draw, packed, unpacked
from logloom.operators.sizes import small_side
from logloom.operators.stages import staged

BUCKET_ROWS, BUCKET_LIMIT = 2_000, 50_000


def _score(key: Column, shard: int, weight: float) -> Column:
    digits = F.substring(F.md5(F.concat_ws(":", key, F.lit(str(shard))).cast("binary")), 1, 13)
    u = (F.conv(digits, 16, 10).cast("double") + 0.5) / float(2**52)
    return F.lit(-weight) / F.log(u)


def shard_of(key: Column, weights: list[float]) -> Column:
    """The winning shard, 0 to len(weights) - 1; the lower one of two equal scores."""
    key = F.coalesce(key.cast("string"), F.lit("null"))
    return -F.array_max(F.array(*[F.struct(_score(key, i, w).alias("score"), F.lit(-i).alias("shard")) for i, w in enumerate(weights)]))["shard"]


def _slots(rows: DataFrame, shards: int) -> DataFrame:
    """rows with shard, draw (and columns to break ties by) -> the same with slot."""
    wanted = max(1, rows.count() // (shards * BUCKET_ROWS))
    rows = rows.withColumn("bucket", F.floor(F.col("draw") / float(2**60) * wanted).cast("long"))
    sums = rows.groupBy("shard", "bucket").count()
    over = staged(sums.where(F.col("count") > BUCKET_LIMIT).select(F.col("shard").alias("s"), F.col("bucket").alias("b"), F.ceil(F.col("count") / BUCKET_LIMIT).alias("parts")), "shard-over")
    if over.isEmpty():
        rows = rows.withColumn("part", F.lit(0).cast("long"))
    else:
        rows = staged(rows.withColumn("position", F.monotonically_increasing_id()), "shard-rows")
        rows = rows.join(small_side(over), (F.col("shard") == F.col("s")) & (F.col("bucket") == F.col("b")), "left").withColumn("part", F.pmod("position", F.coalesce("parts", F.lit(1)))).drop("s", "b")
    counts = rows.groupBy("shard", "bucket", "part").count()
    first = F.sum("count").over(Window.partitionBy("shard").orderBy("bucket", "part")) - F.col("count")
    firsts = counts.select(F.col("shard").alias("s"), F.col("bucket").alias("b"), F.col("part").alias("p"), first.alias("first"))
    own = F.row_number().over(Window.partitionBy("shard", "bucket", "part").orderBy("draw", "size", "text_crc32")) - 1
    here = (F.col("shard") == F.col("s")) & (F.col("bucket") == F.col("b")) & (F.col("part") == F.col("p"))
    return rows.withColumn("own", own).join(firsts, here).withColumn("slot", F.col("first") + F.col("own"))


def _measured(docs: DataFrame, weights: list[float], grown: float) -> DataFrame:
    data = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    key = F.col("doc_id")
    return packed(docs, size=(F.length(data) + 8).cast("long"), text_crc32=F.crc32(data), shard=shard_of(key, weights),
                  grown_shard=shard_of(key, [*weights, grown]), draw=key_draw(key, F.lit("null")))


def shard(docs: DataFrame, weights: list[float], grown: float = 1.0) -> DataFrame:
    """docs with size, text_crc32, shard, slot and grown_shard, the shard if one of weight `grown` joined.

    An input column named like one of these is replaced.
    """
    return unpacked(_slots(_measured(docs, weights, grown), len(weights)), docs.columns, "size", "text_crc32", "shard", "slot", "grown_shard")
