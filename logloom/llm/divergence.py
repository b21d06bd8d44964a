"""Source divergence audit: how far each source's vocabulary is from its language's and its siblings'.

Terms are counted per (lang, source) group. A group's count fixes its smoothed share p of a term,
so two groups' divergence is a sum over pairs of counts: cells (a, b), the number of terms
counted a times in one and b times in the other, times f of their shares. Cells come from
bitmaps: kept terms get ids, and per group and count the ids are a bitset, cut into words of 64
terms. AND and popcount of two groups' words give the joint cells of counts above zero. Cells with
a zero follow by complement from each level's size, so terms that a group lacks cost nothing:

    sum f = sum over a of |a| f(a, 0) + sum over b of |b| f(0, b) + (V - |A| - |B|) f(0, 0)
            + sum over cells of |a and b| (f(a, b) - f(a, 0) - f(0, b) + f(0, 0))

Ids follow the terms' totals, so a word holds terms of like counts, and few levels. Groups meet
by (lang, word) and never over a whole language: at most 64 terms of each source are together.

Null text, lang and source are empty strings. Every row is a document, also repeated ones. A group
without terms, or a language without kept terms, still has its `pair` rows. Shares are exact
decimals, all else is exact in 64 bits up to 9e9 kept terms a language. An empty table gives no rows.
Texts are cut into terms in Arrow batches; a task holds at most FLUSH distinct terms at once.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from logloom.operators.sizes import small_side
from logloom.operators.stages import staged

#: Bytes of UTF-8 after A-Z went to lower case: letters, and every byte of a code point beyond ASCII.
_TERM = re.compile(rb"[a-z\x80-\xff]+")
MIN_DOCS, TOP, FLUSH, WIDTH = 10, 10, 200_000, 64


def _tallies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of each term of a group, added up over a bounded number of terms."""
    uses, holders, held = {}, {}, 0

    def flushed() -> Iterator[pa.RecordBatch]:
        for (lang, source), counted in uses.items():
            docs, terms = holders[lang, source], list(counted)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(terms), pa.string()), pa.array([source] * len(terms), pa.string()), pa.array(terms, pa.binary()).cast(pa.string()),
                                              pa.array(counted.values(), pa.int64()), pa.array([docs[t] for t in terms], pa.int64())], ["lang", "source", "term", "n", "docs"])
    for batch in batches:
        for lang, source, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "text"))):
            said = _TERM.findall(text.encode().lower())
            counted = uses.setdefault((lang, source), Counter())
            held -= len(counted)
            counted.update(said)  # a list or a set is counted without a step of Python per term, a mapping is not
            held += len(counted)
            holders.setdefault((lang, source), Counter()).update(set(said))
            if held > FLUSH:
                yield from flushed()
                uses, holders, held = {}, {}, 0
    yield from flushed()


def grouped(docs: DataFrame) -> DataFrame:
    return docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])


def kept_terms(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """lang, source, term, n, total: terms that enough documents of the language hold."""
    tallies = grouped(docs).mapInArrow(_tallies, "lang string, source string, term string, n bigint, docs bigint")
    counts = tallies.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    of_term = Window.partitionBy("lang", "term")
    counts = counts.withColumn("holders", F.sum("docs").over(of_term)).withColumn("total", F.sum("n").over(of_term))
    return counts.where(F.col("holders") >= min_docs).select("lang", "source", "term", "n", "total")


def share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10^9 (n + 2) / (total + 2 terms))."""
    whole = (n.cast("decimal(20,0)") + 2) * F.lit(1_000_000_000).cast("decimal(10,0)")
    return F.call_function("div", whole, total.cast("decimal(20,0)") + terms.cast("decimal(19,0)") * 2) + 1


def distance(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def group_sizes(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """Every group with the sums it is measured by: lang, source, own, own_terms, lang_total, lang_terms, none (the share of a term it lacks)."""
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("own"), F.count("*").alias("own_terms"))
    langs = kept.groupBy("lang", "term").agg(F.any_value("total").alias("total")).groupBy("lang").agg(F.sum("total").alias("lang_total"), F.count("*").alias("lang_terms"))
    every = grouped(docs.select("lang", "source", F.lit("").alias("text"))).select("lang", "source").distinct()
    sizes = every.join(own, ["lang", "source"], "left").join(small_side(langs), "lang", "left").na.fill(0)
    return sizes.withColumn("none", F.when(F.col("lang_terms") > 0, share(F.lit(0), F.col("own"), F.col("lang_terms"))).otherwise(1))


def bitsets(kept: DataFrame) -> DataFrame:
    """lang, word, source, p, bits: the terms of a word of 64 that the group counts alike."""
    by = ["lang", "total", "term"]
    ranged = kept.repartitionByRange(*by).withColumn("part", F.spark_partition_id())
    place = F.dense_rank().over(Window.partitionBy("part").orderBy(*by)) - 1
    placed = ranged.withColumn("word", F.shiftleft(F.col("part").cast("long"), 32) + F.floor(place / WIDTH)).withColumn("bit", F.pmod(place, F.lit(WIDTH)))
    return placed.groupBy("lang", "word", "source", "p").agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit"))).alias("bits"))


def _pairs(bits: DataFrame, levels: DataFrame, sizes: DataFrame) -> DataFrame:
    """lang, source, item, value of every two sources of a language."""
    def side(df: DataFrame, mark: str) -> DataFrame:
        return df.select(*[F.col(c).alias(c if c in ("lang", "word") else f"{c}_{mark}") for c in df.columns])
    a, b = side(bits, "a"), side(bits, "b")
    extra = distance(F.col("p_a"), F.col("p_b")) - distance(F.col("p_a"), F.col("none_b")) - distance(F.col("none_a"), F.col("p_b")) + distance(F.col("none_a"), F.col("none_b"))
    both = (a.join(b, ["lang", "word"]).where((F.col("source_a") < F.col("source_b")) & (F.col("bits_a").bitwiseAND(F.col("bits_b")) != 0))
            .groupBy("lang", "source_a", "source_b").agg(F.sum(F.bit_count(F.col("bits_a").bitwiseAND(F.col("bits_b"))) * extra).alias("value")))
    groups = small_side(sizes.select("lang", F.col("source").alias("other"), F.col("none").alias("other_none"), F.col("own_terms").alias("other_terms")))
    # half of the complement for each direction: the levels of one side against a zero of the other
    lone = (levels.join(groups, "lang").where("source <> other")
            .groupBy("lang", "source", "other").agg(F.sum(F.col("terms") * distance(F.col("p"), F.col("other_none"))).alias("value")))
    first, second = F.least("source", "other"), F.greatest("source", "other")
    neither = (sizes.join(groups, "lang").where("source < other")
               .select("lang", "source", "other", ((F.col("lang_terms") - F.col("own_terms") - F.col("other_terms")) * distance(F.col("none"), F.col("other_none"))).alias("value")))
    parts = both.select("lang", F.col("source_a").alias("source"), F.col("source_b").alias("other"), "value").union(neither)
    parts = parts.union(lone.select("lang", first, second, "value"))
    summed = parts.groupBy("lang", "source", "other").agg(F.sum("value").alias("value"))
    way = F.explode(F.array(F.struct(F.col("source").alias("source"), F.col("other").alias("item")), F.struct(F.col("other").alias("source"), F.col("source").alias("item"))))
    return summed.select("lang", way.alias("x"), "value").select("lang", "x.source", "x.item", "value")


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank: `pair` against every other source, `term` the top terms above the language's share."""
    kept = staged(kept_terms(docs, min_docs), "audit-terms")
    sizes = staged(group_sizes(docs, kept), "audit-groups")
    terms = kept.join(small_side(sizes), ["lang", "source"])
    terms = terms.withColumn("p", share(F.col("n"), F.col("own"), F.col("lang_terms")))
    levelled = terms.select("lang", "source", "term", "total", "p", "none")
    bits = staged(bitsets(levelled).join(small_side(sizes.select("lang", "source", "none")), ["lang", "source"]), "audit-bitsets")
    levels = bits.groupBy("lang", "source", "p").agg(F.sum(F.bit_count("bits")).alias("terms"))
    pairs = _pairs(bits, levels, sizes).withColumn("part", F.lit("pair"))
    terms = terms.withColumn("q", share(F.col("total"), F.col("lang_total"), F.col("lang_terms"))).where("p > q")
    terms = terms.select("lang", "source", F.col("term").alias("item"), distance(F.col("p"), F.col("q")).alias("value"))
    best = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), F.col("item"))
    out = pairs.withColumn("rank", F.row_number().over(best)).unionByName(
        terms.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top).withColumn("part", F.lit("term")))
    return out.select("lang", "source", "part", "item", "value", "rank")
