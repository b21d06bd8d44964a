"""Dated prefix rates, list price of token classes, poisoned sums, rounding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from logloom.functions import fixed_values as fv

RATE_SCHEMA = ("prefix string, from_day date, rate_input double, rate_write5m double, "
               "rate_write1h double, rate_read double, rate_output double")
TOKENS = ["input_tokens", "cache_write_tokens", "cache_write_1h_tokens", "cache_read_tokens",
          "output_tokens", "thinking_tokens"]
RATE_NAMES = ["rate_input", "rate_write5m", "rate_write1h", "rate_read", "rate_output"]
MAP_RATES = 1_000


def rate_table(spark: SparkSession, rows) -> DataFrame:
    """Dated rates in USD per million tokens: prefix, from day, input, 5-minute write, 1-hour write, cache read, output."""
    import datetime as dt

    return spark.createDataFrame(
        [(r[0], dt.date.fromisoformat(r[1]), *map(float, r[2:])) for r in rows], RATE_SCHEMA)


def rates_for(pairs: DataFrame, rates: DataFrame) -> DataFrame:
    """Rates of distinct (model, rate_day) pairs.

    The longest prefix of the model id wins; then the latest rate dated on or
    before the day, else the earliest; a null day takes the latest. The join is
    an equi-join on the prefixes of the model, so no theta join is needed.
    """
    prefixes = F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.length("model"), F.lit(1))),
                                     lambda n: F.substring(F.col("model"), F.lit(1), n)))
    probe = (pairs.select("model", "rate_day").filter(F.length("model") > 0).distinct()
             .withColumn("prefix", prefixes))
    valid = F.col("rate_day").isNull() | (F.col("from_day") <= F.col("rate_day"))
    # among valid rates the latest day ranks first, else the earliest day
    dated = F.datediff("from_day", F.lit("1970-01-01").cast("date"))
    rank = F.struct(F.length("prefix"), valid, F.when(valid, dated).otherwise(-dated))
    picked = F.max_by(F.struct(*RATE_NAMES), rank)
    return probe.join(rates, "prefix").groupBy("model", "rate_day").agg(picked.alias("r")).select(
        "model", "rate_day", "r.*")


def usd_columns(prefix: str = "") -> dict[str, Column]:
    """Dollars per class; the 1-hour slice is capped at the write total."""
    c = lambda n: F.col(prefix + n)
    w1h = F.least(F.coalesce(c("cache_write_1h_tokens"), F.lit(0)), c("cache_write_tokens"))
    w5m = c("cache_write_tokens") - w1h
    return {
        "usd_input": c("input_tokens") * F.col("rate_input") / 1e6,
        "usd_cache_write": (w5m * F.col("rate_write5m") + w1h * F.col("rate_write1h")) / 1e6,
        "usd_cache_read": c("cache_read_tokens") * F.col("rate_read") / 1e6,
        "usd_output": c("output_tokens") * F.col("rate_output") / 1e6,
    }


def with_rates(rows: DataFrame, rates: DataFrame) -> DataFrame:
    """rows with the rates of their (model, rate_day), picked as rates_for does, without a join.

    The rate table is read once, as one array beside the rows: for at most MAP_RATES rows.
    """
    entry = F.struct("prefix", "from_day", F.struct(*RATE_NAMES).alias("rates"))
    table = rates.where(F.length("prefix") > 0).agg(F.collect_list(entry).alias("t")).scalar()

    def ranked(r: Column) -> Column:
        valid = F.col("rate_day").isNull() | (r["from_day"] <= F.col("rate_day"))
        dated = F.datediff(r["from_day"], F.lit("1970-01-01").cast("date"))
        return F.struct(F.length(r["prefix"]).alias("n"), valid.alias("valid"), F.when(valid, dated).otherwise(-dated).alias("day"), r["rates"].alias("rates"))

    fitting = F.filter("__table", lambda r: F.startswith(F.col("model"), r["prefix"]))
    best = F.array_max(F.transform(fitting, ranked))["rates"]
    return rows.withColumn("__table", table).withColumn("__best", best).select(*rows.columns, "__best.*")


def priced(rows: DataFrame, rates: DataFrame) -> DataFrame:
    """rows(model, rate_day, token columns) plus usd_* per class and list_usd (NULL = unpriced).

    A rate table of measured size is an expression over the row, so rows are read once and
    never shuffled on their model; beyond it, the distinct (model, day) pairs meet the table
    and come back as a dimension.
    """
    if rates.limit(MAP_RATES + 1).count() <= MAP_RATES:
        joined = with_rates(rows, rates)
    else:
        dim = rates_for(rows.select("model", "rate_day"), rates).withColumnsRenamed({"model": "rm", "rate_day": "rd"})
        joined = rows.join(dim, (F.col("model") == F.col("rm")) & F.col("rate_day").eqNullSafe(F.col("rd")), "left")
    out = joined.withColumns(usd_columns())
    total = F.col("usd_input") + F.col("usd_cache_write") + F.col("usd_cache_read") + F.col("usd_output")
    return out.withColumn("list_usd", total).drop("rm", "rd", *RATE_NAMES)


def poisoned_sum(x: Column) -> Column:
    """NULL as soon as one member is NULL."""
    return F.when(F.count(x) == F.count(F.lit(1)), F.coalesce(F.sum(x), F.lit(0.0)))


def round2(x: Column) -> Column:
    """Half-up on n*100 in binary floating point."""
    return F.floor(x * 100 + 0.5) / 100


def round3(x: Column) -> Column:
    return F.floor(x * 1000 + 0.5) / 1000


def round_half_up(x: Column) -> Column:
    return F.floor(x + 0.5).cast("bigint")
