"""Filter interaction audit: what five filters remove in every order, and each one's Shapley share.

A document fails a set of the filters A to E; everything the audit says follows from how many
documents of a part fail exactly each of the 32 sets. A coalition S removes v(S) documents: those
that fail at least one of its filters. Filters applied in some order are growing coalitions, so a
step removes the difference of two coalition values. Shares come from the Hart-Mas-Colell
potential, P(S) = (v(S) + sum of P(S without i)) / |S|: a filter's Shapley value is P of all filters
minus P without it. P is kept 120-fold, so that all divisions are exact.

The filters (words are maximal runs without ASCII white space): A under 200 words; B fewer
distinct words than half of all; C more than 3% of the code points in A-Z; D any of #$%&*|;
E the text of a document with a smaller doc_id, anywhere in the table.

A null text is empty, a null part is the empty string. A row without doc_id neither fails E nor is
anyone's predecessor; rows that share a doc_id are not copies of each other, and each counts. Of
several label rows of a document any 1 counts; labels without doc_id are ignored. Texts are
compared by two 64-bit hashes and their length. An empty table gives no rows. Rows meet as
narrow hashes; copies are summed before the shuffle, so a text that most rows share is a few
rows. Very long texts cost one array of their words in the task that reads them.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window, functions as F

from logloom.llm.common import let
from logloom.operators.stages import staged

FILTERS = "ABCDE"
ALL, COPY = 31, 16
ORDERS = ["".join(p) for p in permutations(FILTERS)]
_SPACES = r"[\x20\x09-\x0D]+"


def _bits() -> Column:
    return F.array(*[F.lit(1 << i) for i in range(len(FILTERS))])


def text_failures(text: Column) -> Column:
    """Bits of the filters A to D that a text fails."""
    def bits(words: Column) -> Column:
        n = F.size(words)
        return (F.when(n < 200, 1).otherwise(0) + F.when(F.size(F.array_distinct(words)) * 100 < n * 50, 2).otherwise(0)
                + F.when(F.char_length(F.regexp_replace(text, "[^A-Z]+", "")) * 100 > F.char_length(text) * 3, 4).otherwise(0)
                + F.when(text.rlike(r"[#$%&*|]"), 8).otherwise(0))
    return let(F.array_remove(F.split(text, _SPACES), ""), bits)


def marked(docs: DataFrame, part: str) -> DataFrame:
    """doc_id, part, failures of A to D, and the key of the text; one row for equal ones, with their number n."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id"), F.coalesce(F.col(part), F.lit("")).alias("part"), text_failures(text).alias("fails"),
                       F.xxhash64(text).alias("a"), F.xxhash64(F.lit("second"), text).alias("b"), F.char_length(text).alias("c"))
    return rows.groupBy(*rows.columns).agg(F.count("*").alias("n"))


def with_labels(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """rows with good and toxic; rows without an id are dealt by their text, where no label can be."""
    flags = (labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("id"))
             .agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
             .where("good = 1 OR toxic = 1").withColumn("unnamed", F.lit(False)))
    keyed = rows.withColumn("unnamed", F.col("doc_id").isNull()).withColumn("id", F.coalesce(F.col("doc_id").cast("long"), F.col("a")))
    met = keyed.join(flags.withColumn("id", F.col("id").cast("long")), ["unnamed", "id"], "left")
    return met.select(*rows.columns, F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))


def failure_counts(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """Per part and exact set of failed filters: n, good, toxic. At most 32 rows a part."""
    rows = with_labels(staged(marked(docs, part), "audit-rows"), labels)
    text, kind = ["a", "b", "c"], ["part", "fails", "good", "toxic"]
    groups = rows.groupBy(*text, *kind).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n"))).alias("unnamed"),
                                            F.min("doc_id").alias("first"), F.min_by("n", "doc_id").alias("firsts"))
    groups = groups.withColumn("least", F.min("first").over(Window.partitionBy(*text)))
    spared = F.coalesce("unnamed", F.lit(0)) + F.when(F.col("first") == F.col("least"), F.col("firsts")).otherwise(0)
    both = F.array(F.struct(F.col("fails").alias("fails"), spared.alias("n")), F.struct((F.col("fails") + COPY).alias("fails"), (F.col("n") - spared).alias("n")))
    one = groups.select("part", "good", "toxic", F.explode(both).alias("x")).where("x.n > 0")
    return one.groupBy("part", F.col("x.fails").alias("fails")).agg(F.sum("x.n").alias("n"), F.sum(F.col("x.n") * F.col("good")).alias("good"), F.sum(F.col("x.n") * F.col("toxic")).alias("toxic"))


def coalition_values(counts: Column, of: str) -> Column:
    """array of 32: how many of the counted documents fail any filter of the coalition."""
    zero = F.lit(0).cast("long")
    return F.transform(F.sequence(F.lit(0), F.lit(ALL)), lambda s: F.aggregate(counts, zero, lambda t, x: t + F.when(x["fails"].bitwiseAND(s) != 0, x[of]).otherwise(0)))


def potentials(values: Column) -> Column:
    """array of 32: 120 times the potential of each coalition, smaller coalitions first."""
    def grown(done: Column, s: Column) -> Column:
        less = F.aggregate(F.sequence(F.lit(0), F.lit(len(FILTERS) - 1)), F.lit(0).cast("long"),
                           lambda t, i: t + F.when(F.get(_bits(), i).bitwiseAND(s) != 0, F.get(done, s.bitwiseXOR(F.get(_bits(), i)))).otherwise(0))
        whole = F.get(values, s) * len(ORDERS) + less
        return F.concat(done, F.array(F.when(s == 0, F.lit(0).cast("long")).otherwise(F.call_function("div", whole, F.bit_count(s)))))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ALL)), F.array().cast("array<bigint>"), grown)



def audit(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """part, filter_order, step and that step's figures: all 120 orders of every part."""
    counts = failure_counts(docs, labels, part).groupBy("part").agg(F.collect_list(F.struct("fails", "n", "good", "toxic")).alias("counts"))
    games = counts.select("part", "counts", *[coalition_values(F.col("counts"), of).alias(of) for of in ("n", "good", "toxic")],
                          F.aggregate("counts", F.lit(0).cast("long"), lambda t, x: t + x["n"]).alias("all"))
    games = games.withColumn("p", potentials(F.col("n")))
    orders = games.withColumn("filter_order", F.explode(F.array(*[F.lit(o) for o in ORDERS])))
    steps = orders.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    applied = F.transform(F.split("filter_order", ""), lambda c: F.get(_bits(), F.instr(F.lit(FILTERS), c) - 1))
    steps = steps.withColumn("applied", applied).withColumn("bit", F.get("applied", F.col("step") - 1))
    steps = steps.withColumn("before", F.aggregate(F.slice("applied", F.lit(1), F.col("step") - 1), F.lit(0), lambda s, b: s + b)).withColumn("after", F.col("before") + F.col("bit"))

    def removed(of: str) -> Column:
        return F.get(of, F.col("after")) - F.get(of, F.col("before"))
    alone = F.aggregate("counts", F.lit(0).cast("long"), lambda t, x: t + F.when(x["fails"] == F.col("bit"), x["n"]).otherwise(0))
    return steps.select("part", "filter_order", "step", (F.col("all") - F.get("n", F.col("after"))).alias("kept"), removed("n").alias("removed"),
                        (F.get("n", F.col("bit")) - removed("n")).alias("redundant"), alone.alias("unique_fails"), removed("good").alias("good_lost"),
                        removed("toxic").alias("toxic_lost"), (F.get("p", F.lit(ALL)) - F.get("p", F.lit(ALL) - F.col("bit"))).alias("shapley"))
