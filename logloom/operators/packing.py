"""Lane packing: rows for overlapping intervals, and how many ran at once."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from logloom.operators.ordered import scan

PACKED = T.StructType([T.StructField("parent", T.StringType()), T.StructField("cluster", T.LongType()), T.StructField("lane", T.StringType()),
                       T.StructField("row", T.IntegerType())])


def _first_fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Lowest row whose end is at or before the start, for lanes sorted by (parent, cluster, start, lane).

    What is kept between lanes is one heap of the busy rows by end and one of the free: as many
    entries as lanes ran at once, however many lanes a cluster has.
    """
    at, busy, free = None, [], []
    for lanes in batches:
        rows = []
        for parent, cluster, start, end in zip(lanes.parent, lanes.cluster, lanes.start_ms, lanes.end_ms):
            if (parent, cluster) != at:
                at, busy, free = (parent, cluster), [], []
            while busy and busy[0][0] <= start:
                heapq.heappush(free, heapq.heappop(busy)[1])
            row = heapq.heappop(free) if free else len(busy)
            heapq.heappush(busy, (end, row))
            rows.append(row)
        yield lanes[["parent", "cluster", "lane"]].assign(row=rows)


def clustered(lanes: DataFrame) -> DataFrame:
    """lanes(parent, lane, start_ms, end_ms) + cluster: where every earlier lane has ended a new one begins.

    First-fit starts afresh at such a point, so clusters pack independently and
    a parent's lanes never have to sit in one task.
    """
    hour = F.floor(F.col("start_ms") / 3_600_000).cast("bigint")
    rows = scan(lanes, ["parent"], ["start_ms", "lane"], hour, running_max={"busy_until": F.col("end_ms")})
    rows = rows.withColumn("opens", F.coalesce((F.col("busy_until") <= F.col("start_ms")).cast("bigint"), F.lit(1).cast("bigint")))
    return scan(rows, ["parent"], ["start_ms", "lane"], hour, running={"cluster": F.col("opens")})


def pack(lanes: DataFrame) -> DataFrame:
    rows = clustered(lanes).select("parent", "cluster", "lane", "start_ms", "end_ms")
    keys = ["parent", "cluster"]
    # sorted by Spark, which spills, and read batch by batch: a cluster is one pass, never one frame
    return rows.repartition(*keys).sortWithinPartitions(*keys, "start_ms", "lane").mapInPandas(_first_fit, PACKED)


def concurrency_peak(lanes: DataFrame) -> DataFrame:
    """Most lanes running at once per parent: a running sum of +1/-1 edges (ends first)."""
    edges = lanes.select("parent", F.explode(F.array(
        F.struct(F.col("start_ms").alias("at"), F.lit(1).alias("step")), F.struct(F.col("end_ms").alias("at"), F.lit(-1).alias("step")))).alias("e")).select("parent", "e.*")
    per = edges.groupBy("parent", "at", "step").agg(F.sum("step").alias("delta"))
    hour = F.floor(F.col("at") / 3_600_000).cast("bigint")
    return scan(per, ["parent"], ["at", "step"], hour, running={"open": F.col("delta")}).groupBy("parent").agg(F.max("open").alias("peak"))
