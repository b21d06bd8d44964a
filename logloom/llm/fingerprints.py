"""Document fingerprints: a homomorphic multiset hash over paragraphs.

A paragraph (the text between newlines) hashes to a wide vector: four 32-bit lanes of two
independent 64-bit hashes of it, and 64 lanes in which every pair of neighbouring words of
the paragraph adds +1 or -1 by the bits of its hash, whatever space is between them. Pairs
overlap: n words are n - 1 pairs; a paragraph of one word adds that word. A document's
fingerprint is the sum of its paragraphs' vectors, modulo 2^32 in the first four lanes and
modulo 2^16 in the others. So the order of paragraphs does not matter, and paragraphs can be added to or taken from a
fingerprint without the text (`plus`, `minus`). Equal multisets of paragraphs have equal
fingerprints; the +-1 lanes of a difference estimate how many word pairs two documents do
not share, which gives `likeness`.

Null texts are empty: one empty paragraph. Very long texts are summed in pieces, so that no
lane overflows. All of it is built of column expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from logloom.llm.common import let
from logloom.operators.sizes import small_side
from logloom.operators.stages import staged

EXACT, SIGNS = 4, 64
_W, _S = r"[^\x20\x09-\x0D]", r"[\x20\x09\x0B-\x0D]"
#: Every word is a match. Its group 1 is only looked at, not used up: the word and the next one of its line, or the
#: only word of a line; it is empty at the last of several words.
WORD_PAIR = rf"(?:(?={_W}++{_S}++{_W})|(?<![^\n]){_S}*+(?={_W}++{_S}*+(?![^\n])))(?=({_W}++(?:{_S}++{_W}++)?)){_W}++|{_W}++"
WIDE_SPACE = rf"{_S}{{2,}}+|[\x09\x0B-\x0D]"
_LOW = 0x0001000100010001
_PIECE = 16_384


def _exact_lanes(paragraphs: Column) -> Column:
    """Two hashes of every paragraph, summed by halves."""
    def summed(h: Column, shift: int) -> Column:
        return F.aggregate(h, F.lit(0).cast("long"), lambda a, x: (a + F.shiftrightunsigned(x, shift).bitwiseAND(F.lit(0xFFFFFFFF))).bitwiseAND(F.lit(0xFFFFFFFF)))

    def halves(hashes: Column) -> Column:
        return F.array(summed(hashes, 32), summed(hashes, 0))
    return F.concat(let(F.transform(paragraphs, lambda p: F.xxhash64(p)), halves), let(F.transform(paragraphs, lambda p: F.xxhash64(F.lit("second"), p)), halves))


def _ones(hashes: Column) -> Column:
    """How often each of the 64 bits is set in up to _PIECE hashes: 16 sums of four 16-bit counters each."""
    zero = F.struct(*[F.lit(0).cast("long").alias(f"s{i}") for i in range(16)])
    sums = F.aggregate(hashes, zero, lambda a, x: F.struct(*[(a[f"s{i}"] + F.shiftrightunsigned(x, i).bitwiseAND(F.lit(_LOW))).alias(f"s{i}") for i in range(16)]),
                       lambda a: F.array(*[a[f"s{i}"] for i in range(16)]))
    return F.flatten(F.transform(sums, lambda s: F.array(*[F.shiftrightunsigned(s, 16 * k).bitwiseAND(F.lit(0xFFFF)) for k in range(4)])))


def _sign_lanes(pairs: Column) -> Column:
    return let(F.transform(pairs, lambda p: F.xxhash64(p)), _sign_sums)


def _sign_sums(hashes: Column) -> Column:
    pieces = F.transform(F.sequence(F.lit(0), F.floor(F.size(hashes) / F.lit(_PIECE)).cast("int")), lambda i: F.slice(hashes, i * _PIECE + 1, _PIECE))
    none = F.array_repeat(F.lit(0).cast("long"), SIGNS)
    ones = F.aggregate(F.transform(pieces, _ones), none, lambda a, x: F.zip_with(a, x, lambda p, q: p + q))
    return let(F.size(hashes), lambda n: F.transform(ones, lambda c: (c * 2 - n).bitwiseAND(F.lit(0xFFFF))))


def word_pairs(text: Column) -> Column:
    """Every two words next to each other in a paragraph, with one space between; of a one-word paragraph the word."""
    return F.array_remove(F.regexp_extract_all(F.regexp_replace(text, WIDE_SPACE, " "), F.lit(WORD_PAIR), F.lit(1)), "")


def fingerprint(text: Column) -> Column:
    """array<long>: EXACT lanes below 2^32, then SIGNS lanes below 2^16."""
    text = F.coalesce(text, F.lit(""))
    return F.concat(let(F.split(text, "\n", -1), _exact_lanes), _sign_lanes(word_pairs(text)))


def _lanewise(a: Column, b: Column, sign: int) -> Column:
    def part(x: Column, y: Column) -> Column:
        return x + y * sign
    both = F.zip_with(a, b, part)
    return F.transform(both, lambda v, i: F.when(i < EXACT, v.bitwiseAND(F.lit(0xFFFFFFFF))).otherwise(v.bitwiseAND(F.lit(0xFFFF))))


def plus(a: Column, b: Column) -> Column:
    """Fingerprint of the paragraphs of both."""
    return _lanewise(a, b, 1)


def minus(a: Column, b: Column) -> Column:
    """Fingerprint of a without the paragraphs of b."""
    return _lanewise(a, b, -1)


def as_hex(lanes: Column) -> Column:
    digits = F.transform(lanes, lambda v, i: F.when(i < EXACT, F.lpad(F.hex(v), 8, "0")).otherwise(F.lpad(F.hex(v), 4, "0")))
    return F.lower(F.array_join(digits, ""))


def _square(lanes: Column) -> Column:
    """Estimated squared norm: the mean square of the signed lanes."""
    signed = F.transform(F.slice(lanes, EXACT + 1, SIGNS), lambda v: F.when(v < 32768, v).otherwise(v - 65536).cast("double"))
    return F.aggregate(signed, F.lit(0.0), lambda s, v: s + v * v)


def likeness(a: Column, b: Column) -> Column:
    """1 for equal fingerprints, else the share of word pairs in common as the +-1 lanes estimate it, 0 to 1."""
    whole = _square(a) + _square(b)
    shared = F.lit(1.0) - _square(minus(a, b)) / whole
    return F.when(a == b, F.lit(1.0)).when(whole == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), shared)))


def successors(keys: DataFrame, order: list[Column]) -> DataFrame:
    """Distinct rows of key columns with `next`, the following row in this order; after the last comes the first.

    Rows are ranged by the order and written with their position; windows run per range, and
    a range's last row takes the first row of the next range: one row per range, not per key.
    """
    columns = keys.columns
    placed = keys.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = staged(placed.withColumn("place", F.monotonically_increasing_id()), "ordered").withColumn("part", F.shiftright("place", 33))
    row = F.struct(*columns)
    firsts = placed.groupBy("part").agg(F.min_by(row, "place").alias("first"))
    along = Window.partitionBy().orderBy("part")
    start = F.first("first").over(along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    firsts = firsts.select(F.col("part").alias("of"), F.coalesce(F.lead("first").over(along), start).alias("beyond"))
    inside = placed.withColumn("follows", F.lead(row).over(Window.partitionBy("part").orderBy("place")))
    return inside.join(small_side(firsts), F.col("part") == F.col("of")).select(*columns, F.coalesce("follows", "beyond").alias("next"))


def edited_pairs(docs: DataFrame) -> DataFrame:
    """Per document its fingerprint, its edited text and both neighbours' fingerprints.

    The edited text keeps the first n - floor(n/2) code points and goes on with the first
    floor(n/2) (or all) of the next document by descending doc_id, null ids last, then by
    text hash. Rows that agree in doc_id and text share one result, whose next document is
    the next different one. Columns: doc_id, copies, text, fingerprint, edited_text, next_fingerprint.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    # keys without nulls: plain equality lets the joins keep the partitioning of the grouped texts
    key = ["unnamed", "id", "hash"]
    rows = docs.select(F.col("doc_id").isNull().alias("unnamed"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.xxhash64(text).alias("hash"), text.alias("text"))
    keys = rows.select(*key, F.char_length("text").cast("long").alias("n")).distinct()
    links = staged(successors(keys, [F.col("unnamed").asc(), F.col("id").desc(), F.col("hash").asc()]), "links")
    # one exchange of the texts serves both joins: what a document gives and what it becomes
    whole = rows.withColumn("lanes", fingerprint(F.col("text"))).groupBy(*key).agg(F.any_value("text").alias("text"), F.any_value("lanes").alias("lanes"), F.count("*").alias("copies"))
    takers = links.select(*[F.col(f"next.{k}").alias(k) for k in key], F.struct(*key).alias("taker"), F.floor(F.col("n") / 2).cast("int").alias("half"))
    given = (whole.where("copies > 0").join(takers, key)
             .select("taker.*", "half", F.expr("substring(text, 1, half)").alias("tail"), F.col("lanes").alias("next_fingerprint")))
    met = whole.join(given, key)
    return met.select(F.when(~F.col("unnamed"), F.col("id")).alias("doc_id"), "copies", "text", F.col("lanes").alias("fingerprint"), "next_fingerprint",
                      F.concat(F.expr("substring(text, 1, char_length(text) - half)"), "tail").alias("edited_text"))
