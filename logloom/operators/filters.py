"""Row filters shared by the reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from logloom.functions.timekeys import window_filter


def _like(text: str) -> str:
    return f"%{text}%"


def well_match(dir_: Column, real_path: Column, well: str | None, exact: bool = False) -> Column:
    """Substring (any case) over the directory or its real path, or whole-string equality."""
    if not well:
        return F.lit(True)
    if exact:
        return (dir_ == well) | F.coalesce(real_path == well, F.lit(False))
    return dir_.ilike(_like(well)) | F.coalesce(real_path.ilike(_like(well)), F.lit(False))


def in_wells(df: DataFrame, wells: DataFrame | None, column: str, well: str | None, exact: bool = False) -> DataFrame:
    if not well:
        return df
    dims = wells.filter(well_match(F.col("dir"), F.col("real_path"), well, exact)).select(F.col("dir").alias(column))
    return df.join(dims, column, "left_semi")


def scoped(df: DataFrame, *, ts: str = "ts", since=None, until=None, tz: str = "UTC", session: str | None = None,
           model: str | None = None, model_column: str = "model") -> DataFrame:
    """Window, session-id prefix and model substring."""
    if since or until:
        df = df.filter(window_filter(F.col(ts), since, until, tz))
    if session:
        df = df.filter(F.startswith("session_id", F.lit(session)))
    if model:
        df = df.filter(F.col(model_column).ilike(_like(model)))
    return df
