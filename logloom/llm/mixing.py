"""Mixing sources to target weights by hash-threshold histograms.

Every document draws a fixed number below 2^60 from its key. Per source, words are
summed by the leading bits of that number; running sums find the bucket in which the
source's budget ends, and only that bucket is refined with the next bits. What is left
is one threshold per source: a document below it is taken once more than the others.
Nothing is sorted but the histograms, and repeats are nested: who is taken twice is
taken once as well.

Null or empty texts have size 0. A null source is a source of its own, the last one.
Rows that share a doc_id draw the same number and are taken or left together; rows
without one draw by their text. An empty table gives an empty mix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from logloom.llm.common import key_draw, packed, unpacked, word_count
from logloom.operators.sizes import small_side
from logloom.operators.stages import staged

DRAW_BITS, LEVEL_BITS = 60, 10


def targets(sources: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, cap: int = 2) -> DataFrame:
    """(source, source_size) -> the same with target: `share` of all sizes dealt by weight.

    Sources take the weights in turn, by code point, null last. A target stops at `cap`
    times the source's size and the excess is dealt again by weight. With the sources in
    order of cap*size/weight, level i is what a unit of weight gets if the i sources before
    are capped; it rises while sources are rightly capped and falls after, so the final
    level is its maximum. The frame has one row per source.
    """
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    given = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(turn, F.lit(len(weights))) + 1)
    limit = F.col("source_size") * F.lit(float(cap))
    ranked = sources.withColumn("turn", turn).withColumn("weight", given).withColumn("limit", limit)
    by_need = Window.orderBy(F.col("limit") / F.col("weight"), "turn")
    before = by_need.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_need.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    level = (F.lit(share) * F.sum("source_size").over(everything) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / F.sum("weight").over(onward)
    dealt = ranked.withColumn("level", level).withColumn("level", F.max("level").over(everything))
    return dealt.select("source", "source_size", F.least("limit", F.col("level") * F.col("weight")).alias("target"))


def _edges(rows: DataFrame, budgets: DataFrame, shift: int) -> DataFrame:
    """Per source the bucket (draw >> shift) in which its budget ends, and the budget left there."""
    sums = rows.groupBy("source", F.shiftright("draw", shift).alias("bucket")).agg(F.sum("size").alias("words"))
    upto = F.sum("words").over(Window.partitionBy("source").orderBy("bucket"))
    budgets = budgets.select(F.col("source").alias("of"), "budget")
    return (sums.withColumn("before", upto - F.col("words")).join(small_side(budgets), F.col("source").eqNullSafe(F.col("of")))
            .where("before <= budget AND budget < before + words")
            .select("source", "bucket", (F.col("budget") - F.col("before")).alias("budget"), "words"))


def plan(rows: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, cap: int = 2) -> DataFrame:
    """(source, draw, size) -> per source: source_size, target, base copies and the draw below which one more is taken.

    The last bucket holds one draw; its documents are taken if that comes nearer to the budget.
    """
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = staged(targets(sources, weights, share, cap)
                     .withColumn("base", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int"))
                     .withColumn("budget", F.col("target") - F.col("base") * F.col("source_size")), "mix-targets")
    budgets, shift = sources.select("source", "budget"), DRAW_BITS
    while True:
        shift -= LEVEL_BITS
        edges = staged(_edges(rows, budgets, shift), "mix-edges")
        of = edges.select(F.col("source").alias("of"), F.col("bucket").alias("in_bucket"))
        inside = F.col("source").eqNullSafe(F.col("of")) & (F.shiftright("draw", shift) == F.col("in_bucket"))
        rows = staged(rows.join(small_side(of), inside).select("source", "draw", "size"), "mix-boundary")
        draws = rows.groupBy("source").agg(F.min("draw").alias("low"), F.max("draw").alias("draw"))
        if shift == 0 or draws.where("low < draw").isEmpty():
            break
        budgets = edges.select("source", "budget")
    nearer = F.col("words") - F.col("budget") < F.col("budget")
    ends = (edges.join(draws.select(F.col("source").alias("of"), "draw"), F.col("source").eqNullSafe(F.col("of")))
            .select(F.col("source").alias("of"), (F.col("draw") + F.when(nearer, 1).otherwise(0)).alias("below")))
    return (sources.join(ends, F.col("source").eqNullSafe(F.col("of")), "left")
            .select("source", "source_size", "target", "base", F.coalesce("below", F.lit(0)).cast("long").alias("below")))


def with_copies(rows: DataFrame, planned: DataFrame) -> DataFrame:
    """rows with source, draw, size -> the same with source_size, target, copies and taken words."""
    planned = planned.withColumnRenamed("source", "of")
    return (rows.join(small_side(planned), F.col("source").eqNullSafe(F.col("of"))).drop("of")
            .withColumn("copies", F.col("base") + F.when(F.col("draw") < F.col("below"), 1).otherwise(0))
            .withColumn("taken", F.col("copies") * F.col("size")).drop("base", "below"))


def measured(docs: DataFrame) -> DataFrame:
    """The three columns a mix is planned from, beside the whole row."""
    text = F.col("text")
    return packed(docs, source=F.col("source").cast("string"), draw=key_draw(F.col("doc_id"), F.md5(F.coalesce(text, F.lit("")).cast("binary"))), size=word_count(text))


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, cap: int = 2) -> DataFrame:
    """docs with size, source_size, target, copies and taken (an input column so named is replaced)."""
    planned = plan(staged(measured(docs).select("source", "draw", "size"), "mix-sizes"), weights, share, cap)
    return unpacked(with_copies(measured(docs), planned), docs.columns, "size", "source_size", "target", "copies", "taken")


def repeated(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, cap: int = 2) -> DataFrame:
    """The mix itself: each document as many times as it is taken, with the columns of docs."""
    planned = plan(staged(measured(docs).select("source", "draw", "size"), "mix-sizes"), weights, share, cap)
    taken = with_copies(measured(docs), planned).where("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), "copies")).alias("copy")).select("row.*")
