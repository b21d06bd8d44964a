"""Line dedup: lines that many documents hold stay in one of them.

Texts are split at newlines; a line's key is the line stripped of ASCII white space with
A-Z lower-cased. Long enough keys are exploded as 128-bit hashes with their positions and
counted over distinct documents. Positions of keys over the threshold go back to the
documents that lose them, one set per text, and the other lines are joined in order.
The text itself moves once, to meet that set.

Null texts are one empty line. A doc_id that several rows share is one document, and the
rows keep or lose a key together; a null doc_id is the smallest document. Short keys are
never dropped. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from logloom.llm.common import LOWER, SPACE, UPPER, packed, unpacked
from logloom.operators.stages import staged

MIN_CHARS, MIN_DOCS = 20, 3


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(SPACE)), UPPER, LOWER)


def _hash(key: Column) -> Column:
    return F.struct(F.xxhash64(key).alias("a"), F.xxhash64(F.lit("second"), key).alias("b"))


def _lost_positions(rows: DataFrame, min_chars: int, min_docs: int) -> DataFrame:
    """(doc_id, text_hash, lost): positions of the lines that a text loses."""
    keys = F.transform(F.transform(_lines(F.col("text")), _key), lambda k: F.when(F.char_length(k) >= min_chars, _hash(k)))
    held = staged(rows.select("doc_id", "text_hash", F.posexplode(keys).alias("position", "key")).where("key IS NOT NULL"), "lines")
    common = (held.groupBy("key", "doc_id").agg(F.lit(1).alias("one")).groupBy("key").agg(F.count("*").alias("docs"), F.max("doc_id").alias("keeper"))
              .where(F.col("docs") >= min_docs).select(F.col("key").alias("common"), "keeper"))
    return (held.join(common, F.col("key") == F.col("common")).where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
            .groupBy(F.col("doc_id").alias("in_doc"), F.col("text_hash").alias("in_text")).agg(F.collect_set("position").alias("lost")))


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """docs with kept_text, n_lines and n_dropped (an input column so named is replaced)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = packed(docs, doc_id=F.col("doc_id"), text=text, text_hash=F.xxhash64(text))
    lost = _lost_positions(rows.drop("row"), min_chars, min_docs)
    met = rows.join(lost, (F.col("text_hash") == F.col("in_text")) & F.col("doc_id").eqNullSafe(F.col("in_doc")), "left")
    met = met.withColumn("lines", _lines(F.col("text")))
    stays = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "lost")
    met = met.withColumn("n_lines", F.size("lines").cast("long")).withColumn("stays", stays)
    kept = F.array_join(F.transform("stays", lambda i: F.get("lines", i)), "\n")
    met = (met.withColumn("kept_text", F.when(F.col("lost").isNull(), F.col("text")).otherwise(kept))
           .withColumn("n_dropped", F.coalesce(F.size("lost"), F.lit(0)).cast("long")))
    return unpacked(met, docs.columns, "kept_text", "n_lines", "n_dropped")
