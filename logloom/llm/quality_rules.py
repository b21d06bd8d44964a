"""Quality rules under weak supervision: rules vote or abstain, EM learns how far to trust each.

Every text is measured once. Each rule votes 1 (good), -1 (bad) or 0 (abstains) by those measures.
Documents of the same votes are one pattern, at most 3^8 of them however large the table, and
expectation-maximisation runs over the counted patterns: given the share of good documents and, for
each rule, how often it votes for and against good and bad ones, every pattern has a posterior of
being good, and the posteriors give the shares anew. Abstaining tells nothing. A document stays if
its posterior is at least one half; no rule alone has to be passed.

A rule starts as voting rightly on RIGHT and wrongly on WRONG of the documents. PRIOR documents of these
rates are added to each class, and no rate goes below LEAST, so that no single vote outweighs all others.

Null and empty texts have no words and abstain throughout; they are no evidence, and fail the base
conditions. Repeated rows are judged alike and count each time. An empty table gives no rows and
the starting model. Further columns stay; one named like an added column is replaced. A very
long text costs, for its time in the task, an array of its words and one of its word windows.
All of it is built of column expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from logloom.llm.common import let, packed, unpacked
from logloom.operators.stages import staged

RIGHT, WRONG, PRIOR, LEAST, ROUNDS = 0.5, 0.1, 5.0, 0.01, 40
MIN_WORDS = 50
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_bangs", "n_caps", "n_letters", "n_ends"]
_SPACES = r"[\x20\x09-\x0D]+"

#: name, good if, bad if: over the measures, in whole numbers. A rule that is neither abstains; most only ever speak on one side,
#: since the lack of one fault says little about the others.
RULES = [
    ("symbols", "false", "100 * n_symbols > 10 * n_words"),
    ("shouts", "false", "100 * n_bangs > 10 * n_words"),
    ("capitals", "false", "100 * n_caps > 30 * n_letters"),
    ("letters", "100 * n_letters >= 92 * word_chars", "100 * n_letters < 75 * word_chars"),
    ("word_length", "false", "word_chars < 2 * n_words OR word_chars > 12 * n_words"),
    ("lines", "false", "100 * n_dup_lines > 30 * n_lines"),
    ("repeats", "false", "100 * n_repeat_words > 35 * n_words"),
    ("sentences", "100 * n_ends BETWEEN 4 * n_words AND 20 * n_words", "100 * n_ends < n_words"),
]


def repeat_words(words: Column) -> Column:
    """How many words lie in a window of three that occurs at least twice in the text."""
    def windows(w: Column) -> Column:
        return F.when(F.size(w) < 3, F.array().cast("array<bigint>")).otherwise(
            F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))))

    def covered(placed: Column) -> Column:
        """placed: (hash, place) in order; equal neighbours are the repeated windows."""
        again = F.filter(placed, lambda x, k: (x["h"] == F.get(placed, k - 1)["h"]) | (x["h"] == F.get(placed, k + 1)["h"]))
        return F.size(F.array_distinct(F.flatten(F.transform(again, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))

    def counted(h: Column) -> Column:
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(ordered, covered))
    return let(windows(words), counted)


def measures(text: Column) -> Column:
    """struct of MEASURES, all long, of one text."""
    text = F.coalesce(text, F.lit(""))

    def left_of(pattern: str) -> Column:
        return F.char_length(F.regexp_replace(text, pattern, ""))
    words = let(F.array_remove(F.split(text, _SPACES), ""), lambda w: F.struct(F.size(w).alias("n_words"), F.char_length(F.array_join(w, "")).alias("word_chars"), repeat_words(w).alias("n_repeat_words")))
    lines = let(F.filter(F.split(text, "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]")), lambda x: F.struct(F.size(x).alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines")))
    counts = F.struct(F.regexp_count(text, F.lit(r"[#*$%&|<>]")).alias("n_symbols"), F.regexp_count(text, F.lit("!")).alias("n_bangs"), left_of("[^A-Z]+").alias("n_caps"),
                      left_of(r"[\x00-\x40\x5B-\x60\x7B-\x7F]+").alias("n_letters"), F.regexp_count(text, F.lit(r"[.?]([\x20\x09-\x0D]|\z)")).alias("n_ends"))
    of = {"n_words": words, "word_chars": words, "n_repeat_words": words, "n_lines": lines, "n_dup_lines": lines}
    return let(F.struct(words.alias("w"), lines.alias("l"), counts.alias("c")), lambda x: F.struct(*[
        x["w" if of.get(m) is words else "l" if of.get(m) is lines else "c"][m].cast("long").alias(m) for m in MEASURES]))


def measured(docs: DataFrame) -> DataFrame:
    """docs with MEASURES."""
    rows = packed(docs, m=measures(F.col("text"))).select("row", "m.*")
    return unpacked(rows, docs.columns, *MEASURES)


def votes() -> Column:
    """array of 1, 0 or -1, one entry a rule; of a text without words all abstain."""
    cast = F.array(*[F.when(F.expr(good), 1).when(F.expr(bad), -1).otherwise(0) for _, good, bad in RULES])
    return F.when(F.col("n_words") > 0, cast).otherwise(F.array_repeat(F.lit(0), len(RULES)))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)


def posterior(cast: Column, model: Column) -> Column:
    """Probability of a good document, given its votes."""
    def weight(j: Column) -> Column:
        def ratio(vote: str) -> Column:
            return F.log(F.get(model[f"good_{vote}"], j) / F.get(model[f"bad_{vote}"], j))
        return F.when(F.get(cast, j) == 1, ratio("for")).when(F.get(cast, j) == -1, ratio("against")).otherwise(0.0)
    told = F.aggregate(_each(), F.log(model["share"] / (1 - model["share"])), lambda s, j: s + weight(j))
    return 1 / (1 + F.exp(-told))


def _each() -> Column:
    return F.sequence(F.lit(0), F.lit(len(RULES) - 1))


#: What a model holds beside the share of good documents: how often each rule votes for and against good, and bad, documents.
_RATES = [("good_for", "good", 1), ("good_against", "good", -1), ("bad_for", "bad", 1), ("bad_against", "bad", -1)]


def _start(of: str, vote: int) -> float:
    return RIGHT if (of == "good") == (vote == 1) else WRONG


def learn(rows: DataFrame) -> DataFrame:
    """One row, `model`: the share of good documents and each rule's rates of right and wrong votes."""
    tally = rows.where("n_words > 0").groupBy(votes().alias("v")).agg(F.count("*").cast("double").alias("n"))
    patterns = tally.agg(F.array_sort(F.collect_list(F.struct("v", "n"))).alias("patterns"))
    start = F.struct(F.lit(0.5).alias("share"), *[F.array_repeat(F.lit(_start(of, vote)), len(RULES)).alias(name) for name, of, vote in _RATES])

    def improved(model: Column, _: Column) -> Column:
        def reckoned(told: Column) -> Column:
            def mass(of: str, among=lambda x: F.lit(True)) -> Column:
                return F.aggregate(told, F.lit(0.0), lambda s, x: s + F.when(among(x), x[of]).otherwise(0.0))

            def rates(of: str, vote: int, whole: Column) -> Column:
                return F.transform(_each(), lambda j: F.greatest(F.lit(LEAST), F.least(F.lit(1 - LEAST), (
                    mass(of, lambda x: F.get(x["v"], j) == vote) + PRIOR * _start(of, vote)) / (whole + PRIOR))))
            return let(F.struct(mass("good").alias("good"), mass("bad").alias("bad")), lambda w: F.struct(
                ((w["good"] + 1) / (w["good"] + w["bad"] + 2)).alias("share"), *[rates(of, vote, w[of]).alias(name) for name, of, vote in _RATES]))
        told = F.transform("patterns", lambda x: let(posterior(x["v"], model), lambda p: F.struct(x["v"].alias("v"), (x["n"] * p).alias("good"), (x["n"] * (1 - p)).alias("bad"))))
        return let(told, reckoned)
    return patterns.select(F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, improved).alias("model"))


def judged(rows: DataFrame, model: DataFrame) -> DataFrame:
    """Measured rows with base_failed, posterior and kept; posteriors are compared to six digits."""
    seen = packed(rows, v=votes(), base_failed=F.coalesce(base_failed(), F.lit(False))).withColumn("model", model.scalar())
    seen = seen.withColumn("posterior", posterior(F.col("v"), F.col("model")))
    seen = seen.withColumn("kept", ~F.col("base_failed") & (F.round("posterior", 6) >= 0.5))
    return unpacked(seen, rows.columns, "base_failed", "posterior", "kept")


def keep_good(docs: DataFrame) -> DataFrame:
    """docs that the rules' posterior keeps, with their own columns only."""
    rows = staged(measured(packed(docs, text=F.col("text"))).drop("text"), "quality-measures")
    return unpacked(judged(rows, learn(rows)).where("kept"), docs.columns)
