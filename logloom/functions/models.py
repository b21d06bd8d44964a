"""Model identity: label, family, tallies, drift."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from logloom.functions import fixed_values as fv

_TAG = r"(\[[^\]]*\])$"


def _base(model: Column) -> Column:
    bare = F.regexp_replace(model, _TAG, "")
    return F.regexp_replace(F.regexp_replace(bare, fv.VENDOR_PREFIX, ""), r"-\d{8}$", "")


def family(model: Column) -> Column:
    head = F.split_part(_base(model), F.lit("-"), F.lit(1))
    known = [f for f in fv.MODEL_FAMILIES if f != "other"]
    return F.when(head.isin(known), head).otherwise(F.lit("other"))


def label(model: Column) -> Column:
    base = _base(model)
    tag = F.regexp_extract(model, _TAG, 1)
    versioned = base.rlike(r"^[a-z]+-\d+(-\d+)*$")
    name = F.regexp_extract(base, r"^([a-z]+)-", 1)
    version = F.translate(F.regexp_extract(base, r"^[a-z]+-(.*)$", 1), "-", ".")
    pretty = F.when(versioned, F.concat(name, F.lit("-"), version)).otherwise(base)
    return F.when(F.coalesce(model, F.lit("")) == "", F.lit("?")).otherwise(F.concat(pretty, tag))


def css_class(model: Column) -> Column:
    return F.concat(F.lit("m-"), family(model))


def drift(requested: Column, served: Column) -> Column:
    """NULL unless both are known; true when the served id lacks the requested alias."""
    known = (F.coalesce(requested, F.lit("")) != "") & (F.coalesce(served, F.lit("")) != "")
    return F.when(known, ~F.contains(served, requested))


def tally(rows: DataFrame, keys: list[str], model: str = "model") -> DataFrame:
    """Requests per (keys, model): bounded by the model vocabulary, never by rows."""
    return rows.filter(F.col(model).isNotNull()).groupBy(*keys, model).agg(F.count("*").alias("requests"))


def model_lists(tallied: DataFrame, keys: list[str], model: str = "model") -> DataFrame:
    """models[] most requests first (ties by id) and the dominant model, from a tally."""
    by_work = F.struct((-F.col("requests")).alias("neg"), F.col(model).alias("model"))
    ordered = F.array_sort(F.collect_list(by_work))
    return tallied.groupBy(*keys).agg(
        F.transform(ordered, lambda s: F.struct(s["model"].alias("model"), (-s["neg"]).alias("requests"))).alias("models"),
        F.min(by_work)["model"].alias("dominant_model"),
    )


def models_text(models: Column) -> Column:
    return F.array_join(F.transform(models, lambda m: F.concat(m["model"], F.lit("x"), m["requests"].cast("string"))), ",")
