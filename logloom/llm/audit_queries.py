"""The filter audit, the weakly supervised rules and the divergence audit over the given tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from logloom.llm import divergence, filter_audit, quality_rules
from logloom.llm.common import table
from logloom.operators.stages import staged

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

FILTER_AUDIT_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, {_WORDS} AS words FROM documents),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
        CASE WHEN len(words) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 'B' ELSE '' END
        || CASE WHEN 100 * len(regexp_extract_all(text, '[A-Z]')) > 3 * length(text) THEN 'C' ELSE '' END || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END
        || CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 'E' ELSE '' END AS fails
      FROM d LEFT JOIN l USING (doc_id)),
c AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY ALL),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM x a, x b, x c, x d, x e
      WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
t AS (SELECT part, filter_order, fails, n, good, toxic,
        coalesce(list_min(list_filter(range(1, 6), lambda k: contains(fails, substr(filter_order, k::INT, 1)))), 6) AS gone FROM c, o),
s AS (SELECT part, filter_order, step::INT AS step, substr(filter_order, step::INT, 1) AS letter,
        coalesce(sum(n) FILTER (gone > step), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (gone = step), 0)::BIGINT AS removed,
        coalesce(sum(n) FILTER (gone < step AND contains(fails, substr(filter_order, step::INT, 1))), 0)::BIGINT AS redundant,
        coalesce(sum(n) FILTER (fails = substr(filter_order, step::INT, 1)), 0)::BIGINT AS unique_fails,
        coalesce(sum(good) FILTER (gone = step), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (gone = step), 0)::BIGINT AS toxic_lost
      FROM t, range(1, 6) r(step) GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley FROM s
"""


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


_N = len(quality_rules.RULES)
_LEAST, _PRIOR = quality_rules.LEAST, quality_rules.PRIOR
_LOG_ODDS = " + ".join(["ln(share / (1 - share))", *(f"CASE v[{j}] WHEN 1 THEN ln(gf[{j}] / bf[{j}]) WHEN -1 THEN ln(ga[{j}] / ba[{j}]) ELSE 0.0 END" for j in range(1, _N + 1))])


def _rates_sql(weight: str, vote: int, start: float) -> str:
    return "[" + ", ".join(f"greatest({_LEAST}::DOUBLE, least(1 - {_LEAST}::DOUBLE, (coalesce(sum({weight}) FILTER (v[{j}] = {vote}), 0.0) + {_PRIOR * start}::DOUBLE) / (sum({weight}) + {_PRIOR}::DOUBLE)))"
                           for j in range(1, _N + 1)) + "]"


def _start_sql(rate: float) -> str:
    return f"[{', '.join([f'{rate}::DOUBLE'] * _N)}]"


_RIGHT, _WRONG = quality_rules.RIGHT, quality_rules.WRONG
_VOTES_SQL = "[" + ", ".join(f"CASE WHEN {good} THEN 1 WHEN {bad} THEN -1 ELSE 0 END" for _, good, bad in quality_rules.RULES) + "]"

QUALITY_RULES_SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS} AS words FROM documents),
i AS (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM d),
w AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, words[i], words[i + 1], words[i + 2]) AS times FROM i),
r AS (SELECT doc_id, count(DISTINCT place) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS place FROM w WHERE times > 1) GROUP BY doc_id),
m AS (SELECT doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars, coalesce(n_repeat_words, 0) AS n_repeat_words,
        len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, len(list_filter(string_split(text, chr(10)), lambda s: regexp_matches(s, '[^\x20\x09-\x0D]'))) AS n_lines,
        len(list_filter(string_split(text, chr(10)), lambda s: regexp_matches(s, '[^\x20\x09-\x0D]'))) - len(list_distinct(list_filter(string_split(text, chr(10)), lambda s: regexp_matches(s, '[^\x20\x09-\x0D]')))) AS n_dup_lines,
        len(regexp_extract_all(text, '!')) AS n_bangs, len(regexp_extract_all(text, '[A-Z]')) AS n_caps,
        length(regexp_replace(text, '[\x00-\x40\x5B-\x60\x7B-\x7F]+', '', 'g')) AS n_letters, len(regexp_extract_all(text, '[.?]([\x20\x09-\x0D]|\z)')) AS n_ends
      FROM d LEFT JOIN r USING (doc_id)),
b AS (SELECT *, {_VOTES_SQL} AS v FROM m),
p AS (SELECT v, count(*)::DOUBLE AS n FROM b WHERE n_words > 0 GROUP BY v),
e AS (SELECT 0 AS round, 0.5::DOUBLE AS share, {_start_sql(_RIGHT)} AS gf, {_start_sql(_WRONG)} AS ga, {_start_sql(_WRONG)} AS bf, {_start_sql(_RIGHT)} AS ba
      UNION ALL
      SELECT round + 1, (sum(g) + 1) / (sum(g) + sum(h) + 2), {_rates_sql('g', 1, _RIGHT)}, {_rates_sql('g', -1, _WRONG)}, {_rates_sql('h', 1, _WRONG)}, {_rates_sql('h', -1, _RIGHT)}
      FROM (SELECT round, v, n * post AS g, n * (1 - post) AS h FROM (SELECT round, v, n, 1 / (1 + exp(-({_LOG_ODDS}))) AS post FROM e, p WHERE round < {quality_rules.ROUNDS})) GROUP BY round),
z AS (SELECT * FROM e WHERE round = {quality_rules.ROUNDS}),
j AS (SELECT b.*, n_words < {quality_rules.MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed, 1 / (1 + exp(-({_LOG_ODDS}))) AS post FROM b, z)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
       n_repeat_words::BIGINT AS n_repeat_words, base_failed, NOT base_failed AND round(post, 6) >= 0.5 AS kept FROM j
"""


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = staged(quality_rules.measured(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text"), "quality-measures")
    return quality_rules.judged(rows, quality_rules.learn(rows)).select("doc_id", *quality_rules.MEASURES[:5], "base_failed", "kept")


DIVERGENCE_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
t AS (SELECT k, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
v AS (SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT k) >= {divergence.MIN_DOCS}),
s AS (SELECT lang, count(*) AS terms, sum(n) AS total FROM v GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN v USING (lang, term) GROUP BY ALL),
o AS (SELECT lang, source, sum(n) AS own FROM c GROUP BY ALL),
p AS (SELECT g.lang, g.source, v.term, coalesce(c.n, 0) AS n, ((coalesce(c.n, 0) + 2)::HUGEINT * 1000000000 // (coalesce(own, 0) + 2 * terms)::HUGEINT + 1)::HUGEINT AS p,
        ((v.n + 2)::HUGEINT * 1000000000 // (total + 2 * terms)::HUGEINT + 1)::HUGEINT AS q
      FROM g JOIN s USING (lang) JOIN v USING (lang) LEFT JOIN o USING (lang, source) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = v.term),
a AS (SELECT g.lang, g.source, 'pair' AS part, h.source AS item, coalesce(x.value, 0)::BIGINT AS value
      FROM g JOIN g h ON g.lang = h.lang AND g.source <> h.source
      LEFT JOIN (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
                 FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL) x
        ON x.lang = g.lang AND x.source = g.source AND x.item = h.source
      UNION ALL
      SELECT lang, source, 'term', term, ((p - q) * (p - q) // (p + q))::BIGINT FROM p WHERE n > 0 AND p > q)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM a) WHERE part = 'pair' OR rank <= {divergence.TOP}
"""


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))
