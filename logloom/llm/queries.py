"""The operators over the given tables, one registered query each, with SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from logloom.llm import audit_queries, chat, decontamination, fingerprints, line_dedup, lm_scoring, mixing, quality, sharding, simhash_dedup, toxicity
from logloom.llm.common import id_remainder, small_batches, table
from logloom.operators.stages import staged
from logloom.session import tune

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(small_batches(tune(spark)), sf_dir)
        if sql:
            ORACLES[name] = sql
        return fn
    return wrap


@query("op1_mixing", r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, md5(coalesce(text, '')))), 1, 15))::BIGINT AS draw FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS turn FROM d GROUP BY source),
r AS (SELECT *, [5.0, 2.0, 1.0][turn % 3 + 1]::DOUBLE AS weight, source_size * 2.0::DOUBLE AS lim FROM s),
l AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(lim) OVER (ORDER BY lim / weight, turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / sum(weight) OVER (ORDER BY lim / weight, turn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev FROM r),
t AS (SELECT source, source_size, least(lim, max(lev) OVER () * weight) AS target FROM l),
b AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::INT ELSE 0 END AS base FROM t),
g AS (SELECT d.source, draw, sum(size)::BIGINT AS words FROM d GROUP BY d.source, draw),
c AS (SELECT source, draw, words, sum(words) OVER (PARTITION BY source ORDER BY draw)::BIGINT - words AS before FROM g),
e AS (SELECT b.source, max(c.draw + CASE WHEN c.words - (b.target - b.base * b.source_size - c.before) < b.target - b.base * b.source_size - c.before THEN 1 ELSE 0 END) AS below
      FROM b JOIN c ON b.source IS NOT DISTINCT FROM c.source
      WHERE c.before <= b.target - b.base * b.source_size AND b.target - b.base * b.source_size < c.before + c.words GROUP BY b.source)
SELECT d.doc_id, d.size, b.source_size, b.target, ((b.base + CASE WHEN d.draw < coalesce(e.below, 0) THEN 1 ELSE 0 END) * d.size)::BIGINT AS taken
FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source LEFT JOIN e ON b.source IS NOT DISTINCT FROM e.source
""")
def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = staged(mixing.measured(docs).select("row.doc_id", "source", "draw", "size"), "mix-rows")
    mixed = mixing.with_copies(rows, mixing.plan(rows.select("source", "draw", "size")))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


_SHARDS = 24
# CRC-32 by half bytes, low half first; the table is that of the reversed polynomial 0xEDB88320
_CRC_SQL = """xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(range(length(hex(encode(coalesce(text, '')))) // 2),
    lambda i: [('0x' || substr(hex(encode(coalesce(text, ''))), 2 * i + 2, 1))::BIGINT, ('0x' || substr(hex(encode(coalesce(text, ''))), 2 * i + 1, 1))::BIGINT]))),
    lambda c, b: xor([0, 498536548, 997073096, 651767980, 1994146192, 1802195444, 1303535960, 1342533948, 3988292384, 4027552580, 3604390888,
                      3412177804, 2607071920, 2262029012, 2685067896, 3183342108][(xor(c, b) & 15) + 1]::BIGINT, c >> 4)), 4294967295::BIGINT)"""


def _shard_sql(n: int) -> str:
    u = "(('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || ':' || i), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0"
    return f"(SELECT arg_max(i, -1.0 / ln({u})) FROM range({n}) t(i))::INT"


@query("op3_sharding", f"""
WITH d AS (SELECT doc_id, (octet_length(encode(coalesce(text, ''))) + 8)::BIGINT AS size, {_CRC_SQL} AS text_crc32,
        {_shard_sql(_SHARDS)} AS shard, {_shard_sql(_SHARDS + 1)} AS grown_shard,
        ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT AS draw FROM documents)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY draw, size, text_crc32) - 1 AS slot, grown_shard FROM d
""")
def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    placed = sharding.shard(docs, [1.0] * _SHARDS)
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), "grown_shard")


_CONTROL = r"""replace(replace(replace({}, '\', '\\'), '<', '<\'), '[', '[\')"""


@query("op5_chat_formatting", f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -1, i, r, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) v(i, r))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(20 + length({_CONTROL.format('role')}) + length({_CONTROL.format('text')}))::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
""")
def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.element_at(F.array(F.lit("user"), F.lit("assistant")), (F.col("id") + 1).cast("int")).alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    out = chat.render(chat.fold(chat.streamed(rows.unionByName(planted))))
    turns, loss = chat.parse(F.col("formatted")), chat.loss_text(F.col("formatted"), F.col("loss_spans"))
    out = out.withColumn("read", turns).withColumn("loss", loss)
    told = F.array_join(F.transform("read", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select("conv_id", F.size("read").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"), F.char_length("loss").cast("long").alias("loss_chars"),
                      F.sha2("loss", 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"))


@query("op7_fingerprints")
def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = fingerprints.edited_pairs(table(spark, sf_dir, "documents"))
    pairs = pairs.withColumn("edited", fingerprints.fingerprint(F.col("edited_text")))
    own, edited, beyond = F.col("fingerprint"), F.col("edited"), F.col("next_fingerprint")
    one = pairs.select("copies", "doc_id", F.char_length("text").cast("long").alias("n_chars"), F.sha2("edited_text", 256).alias("edited_sha256"),
                       fingerprints.as_hex(own).alias("fingerprint"), fingerprints.as_hex(edited).alias("edited_fingerprint"),
                       fingerprints.likeness(own, edited).alias("near_edited"), fingerprints.likeness(own, beyond).alias("near_next"))
    return one.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).drop("copy", "copies")


@query("op9_line_dedup", r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, generate_subscripts(lines, 1) AS position, unnest(lines) AS line FROM d),
k AS (SELECT *, translate(trim(line, E' \t\n\x0B\x0C\r'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT k.doc_id, k.position, k.line, c.key IS NOT NULL AND k.doc_id <> c.keeper AS dropped FROM k LEFT JOIN c ON k.key = c.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY position) FILTER (NOT dropped), '')) AS kept_sha256
FROM m GROUP BY doc_id
""")
def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


@query("op2_simhash_dedup")
def op2_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query("op4_decontamination")
def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op10_lm_scoring")
def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score(table(spark, sf_dir, "documents"))


def _judged(docs: DataFrame, score, divisor: int, remainder: int, threshold: float) -> DataFrame:
    scored = docs.select("doc_id", (id_remainder(divisor) == remainder).alias("held_out"), score.alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


@query("op6_quality")
def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, sf_dir, "labels"), id_remainder(4) != 2)
    return _judged(docs, quality.quality(model), 4, 2, quality.THRESHOLD)


@query("op8_toxicity")
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), id_remainder(3) != 1)
    return _judged(docs, toxicity.toxicity(model), 3, 1, toxicity.THRESHOLD)


query("op11_filter_audit", audit_queries.FILTER_AUDIT_SQL)(audit_queries.op11_filter_audit)
query("op12_quality_rules", audit_queries.QUALITY_RULES_SQL)(audit_queries.op12_quality_rules)
query("op13_source_divergence", audit_queries.DIVERGENCE_SQL)(audit_queries.op13_source_divergence)
