"""A training corpus from raw documents, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept; its result
is written as Parquet and read again as the next one's docs. All but the last return the
columns of documents, the last adds size, text_crc32, shard, slot and grown_shard.

- toxicity: documents that score as toxic go; the model is fitted on this stage's documents
  and the labels that op8 may use.
- near_dedup: one document of each SimHash group stays, the one with the smallest doc_id.
- decontamination: documents that leak a benchmark item go.
- mixing: every document is repeated as often as the mix takes it, or goes if it is not taken.
- sharding: every row gets its shard and its slot there.

Nulls, empty texts and tables, repeated rows and further columns are treated as the operators'
docstrings say; further columns are kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from logloom.llm import decontamination, mixing, sharding, simhash_dedup, toxicity
from logloom.llm.common import id_remainder, small_batches, table
from logloom.operators.stages import staged
from logloom.session import tune

SHARDS = 24


def _ready(spark: SparkSession) -> SparkSession:
    return small_batches(tune(spark))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_clean(docs, table(_ready(spark), sf_dir, "labels"), id_remainder(3) != 1)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _ready(spark)
    return simhash_dedup.keep_one(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.clean(docs, table(_ready(spark), sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _ready(spark)
    return mixing.repeated(docs)


def place_in_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _ready(spark)
    return sharding.shard(docs, [1.0] * SHARDS)


STAGES = [("toxicity", drop_toxic), ("near_dedup", drop_near_copies), ("decontamination", drop_leaks), ("mixing", mix_sources), ("sharding", place_in_shards)]

#: SQL cannot train a string-kernel classifier or take XXH64 fingerprints; the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLES = {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
