"""Broadcast only what has been measured."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

SMALL_ROWS = 20_000


def small_side(df: DataFrame, limit: int = SMALL_ROWS) -> DataFrame:
    """Broadcast df when a bounded count proves it small; otherwise leave it to a shuffle join.

    The count stops at limit + 1 rows, so measuring a large table stays cheap.
    """
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df
