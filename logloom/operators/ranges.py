"""Range joins without pairs: intervals as power-of-64 blocks, points as one block per level.

An interval [lo, hi] is covered by at most 126 aligned blocks per level and a
point lies in exactly one block of every level, so "which intervals hold this
point" becomes an equi-join on (level, block). Intervals can be reduced to one
winner per block before the join.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

BASE = 64
LEVELS = 7  # the top blocks are about two years of milliseconds; longer spans take more of them


def _level(lo: Column, hi: Column, level: int) -> Column:
    size, up = BASE**level, BASE ** (level + 1)
    first = F.ceil(lo / F.lit(size)).cast("bigint")
    last = (F.floor((hi + 1) / F.lit(size)) - 1).cast("bigint")
    pfirst = (F.ceil(lo / F.lit(up)) * BASE).cast("bigint")
    plast = (F.floor((hi + 1) / F.lit(up)) * BASE - 1).cast("bigint")

    def blocks(a: Column, b: Column) -> Column:
        return F.when(a <= b, F.sequence(a, b)).otherwise(F.array().cast("array<bigint>"))

    if level == LEVELS - 1:
        found = blocks(first, last)
    else:
        split = F.concat(blocks(first, F.least(last, pfirst - 1)), blocks(F.greatest(first, plast + 1), last))
        found = F.when(pfirst <= plast, split).otherwise(blocks(first, last))
    return F.transform(found, lambda b: F.struct(F.lit(level).alias("level"), b.alias("block")))


def cover(lo: Column, hi: Column) -> Column:
    """array<struct<level, block>> whose disjoint union is exactly [lo, hi] (integers)."""
    return F.concat(*[_level(lo, hi, n) for n in range(LEVELS)])


def probe(at: Column) -> Column:
    """The block holding a point at every level."""
    return F.array(*[
        F.struct(F.lit(n).alias("level"), F.floor(at / F.lit(BASE**n)).cast("bigint").alias("block"))
        for n in range(LEVELS)])
