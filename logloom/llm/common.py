"""What several of the operators share: words, keys, rows kept whole beside computed columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

WORD = r"[^\x20\x09-\x0D]+"
SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> SparkSession:
    """Python workers get few rows at once: texts may be very long.

    Join keys here are hashes worked out in the same plan, and never null; an inferred not-null
    filter would work them out a second time (in sharding: one hash per row and shard).
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    spark.conf.set("spark.sql.constraintPropagation.enabled", "false")
    return spark


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def id_remainder(divisor: int) -> Column:
    """crc32 of doc_id as text, modulo divisor; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(divisor))


def key_draw(key: Column, otherwise: Column) -> Column:
    """A number below 2^60 that the key alone decides; rows without a key draw from `otherwise`."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), otherwise).cast("binary")), 1, 15), 16, 10).cast("long")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value evaluated once however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def packed(df: DataFrame, **columns: Column) -> DataFrame:
    """The whole row as one struct, with computed columns beside it, so that no name can clash."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), *[c.alias(k) for k, c in columns.items()])


def unpacked(df: DataFrame, columns: list[str], *added: str) -> DataFrame:
    """Undo packed(); an added column takes the place of an input column of the same name."""
    names = {a.lower() for a in added}
    return df.select(*[F.col(f"row.`{c}`") for c in columns if c.lower() not in names], *added)
