"""Ranked full-text search over any table with a text column.

Queries are small expressions (word, phrase, prefix, near, &, |, -), also read from
strings (query_text). Without an index a query touches each row: term counts are column expressions over a normalised
token string, and only corpus-wide sums (documents, lengths, hits per term) are
aggregated.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from logloom.functions import fixed_values as fv
from logloom.operators.filters import in_wells
from logloom.operators.stages import staged
from logloom.plans import sessions as ses
from logloom.schemas import Corpus, whole



#: Marks that stand after their letter.
MARKS = "\u0300-\u036f"


def _accents() -> tuple[str, str]:
    """Lower-case letters that come apart into a letter and marks, and the letters under the marks."""
    apart = {c: unicodedata.normalize("NFD", c) for c in map(chr, range(0xC0, 0x2000)) if c == c.lower()}
    marked = {c: d[0] for c, d in apart.items() if len(d) > 1 and all("\u0300" <= m <= "\u036f" for m in d[1:])}
    return "".join(marked), "".join(marked.values())


ACCENTS = _accents()


def folded(text: Column) -> Column:
    """Lower case, accents removed, whether they are part of the letter or stand after it."""
    return F.translate(F.regexp_replace(F.lower(text), f"[{MARKS}]+", ""), *ACCENTS)


def token_text(text: Column) -> Column:
    """' one  two  three ': every token between its own blanks."""
    return F.regexp_replace(F.concat(F.lit(" "), folded(text), F.lit(" ")), r"[^\p{L}\p{N}]+", "  ")


def tokens(text: Column) -> Column:
    return F.filter(F.split(folded(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


@dataclass(frozen=True)
class Match:
    """A query expression: `leaves` are scored, `test` decides over a text's tokens.

    op: phrase (words in a row, the last may be a prefix, or only at the start of a text), nothing (no
    word to look for, matches no text), near, and, or, not.
    """

    op: str
    parts: tuple = ()
    words: tuple[str, ...] = ()
    prefix: bool = False
    first: bool = False
    distance: int = 10

    def __and__(self, o: "Match") -> "Match":
        return Match("and", (self, o))

    def __or__(self, o: "Match") -> "Match":
        return Match("or", (self, o))

    def __sub__(self, o: "Match") -> "Match":
        return Match("not", (self, o))

    def leaves(self, scored: bool = True) -> list["Match"]:
        """Phrases; what a NOT excludes is tested but never scored."""
        if self.op == "phrase":
            return [self]
        parts = self.parts[:1] if scored and self.op == "not" else self.parts
        return [p for part in parts for p in part.leaves(scored)]

    def pattern(self) -> str:
        body = "  ".join(re.escape(w) for w in self.words)
        return f"{'^ ?' if self.first else ''} {body}{'[^ ]*' if self.prefix else ''} "

    def decide(self, holds, starts) -> Column:
        """The condition over what `holds` says of a phrase and `starts`, the places where it begins."""
        if self.op == "nothing":
            return F.lit(False)
        if self.op == "phrase":
            return holds(self)
        if self.op == "near":
            return within([starts(p) for p in self.parts], [len(p.words) for p in self.parts], self.distance)
        a, b = (p.decide(holds, starts) for p in self.parts)
        return a & b if self.op == "and" else a | b if self.op == "or" else a & ~b

    def test(self, text: Column) -> Column:
        """The condition over a token_text column."""
        def holds(leaf: Match) -> Column:
            return text.rlike(leaf.pattern()) if leaf.prefix or leaf.first else F.contains(text, F.lit(" " + "  ".join(leaf.words) + " "))
        return self.decide(holds, lambda leaf: _starts(text, leaf))


def _event(i: int):
    return lambda p: F.struct(p.cast("int").alias("p"), F.lit(i).alias("i"))


def within(starts: list[Column], sizes: list[int], distance: int) -> Column:
    """Whether some run of tokens holds one of each phrase, at most `distance` tokens lying between any phrase's end and the last one's start.

    All starts are walked once in order, with the latest start of each phrase at hand.
    """
    events = F.array_sort(F.flatten(F.array(*[F.transform(s, _event(i)) for i, s in enumerate(starts)])))
    none = F.struct(*[F.lit(-(1 << 40)).cast("long").alias(f"l{i}") for i in range(len(starts))], F.lit(False).alias("found"))

    def step(seen: Column, e: Column) -> Column:
        near_enough = F.lit(True)
        for i, n in enumerate(sizes):
            near_enough = near_enough & ((e["i"] == i) | (seen[f"l{i}"] + n + distance >= e["p"]))
        return F.struct(*[F.when(e["i"] == i, e["p"].cast("long")).otherwise(seen[f"l{i}"]).alias(f"l{i}") for i in range(len(sizes))], (seen["found"] | near_enough).alias("found"))
    return F.aggregate(events, none, step, lambda seen: seen["found"])


def _begun(word: str, prefix: bool, after: int):
    """Where a phrase begins if its word number `after` is at hand."""
    return lambda w, i: F.when(F.startswith(w, F.lit(word)) if prefix else w == word, i - after)


def _starts(text: Column, leaf: Match) -> Column:
    """Token numbers at which a phrase begins in a token_text column."""
    said = F.split(F.btrim(text, F.lit(" ")), " +")
    places = None
    for j, word in enumerate(leaf.words):
        at = F.array_compact(F.transform(said, _begun(word, leaf.prefix and j == len(leaf.words) - 1, j)))
        places = at if places is None else F.array_intersect(places, at)
    return F.filter(places, lambda i: i == 0) if leaf.first else places


def phrase(*words: str, prefix: bool = False, first: bool = False) -> Match:
    """Words in a row. Text without a letter or digit holds no word: it matches nothing."""
    said = tuple(w for t in words for w in re.findall(r"[^\W_]+", re.sub(f"[{MARKS}]+", "", t.lower()).translate(str.maketrans(*ACCENTS))))
    return Match("phrase", words=said, prefix=prefix, first=first) if said else Match("nothing")


def word(w: str) -> Match:
    return phrase(w)


def starts(w: str) -> Match:
    return phrase(w, prefix=True)


def near(*parts: Match, distance: int = 10) -> Match:
    """Phrases close to each other, in any order."""
    if any(p.op not in ("phrase", "nothing") for p in parts):
        raise ValueError("near takes words and phrases only")
    if not parts or any(p.op == "nothing" for p in parts):
        return Match("nothing")
    return Match("near", parts, distance=distance)


def all_words(query: str, last_is_prefix: bool = False) -> Match:
    """Blank-separated words, all required; the last may be a prefix (a half-typed word lands). Words without a letter or digit are left out."""
    words = query.split()
    parts = [phrase(w, prefix=last_is_prefix and w is words[-1] and re.fullmatch(r"\w+", w) is not None) for w in words]
    parts = [p for p in parts if p.op != "nothing"] or [Match("nothing")]
    out = parts[0]
    for p in parts[1:]:
        out = out & p
    return out


def _count_of(text: Column, part: str) -> Column:
    """Non-overlapping occurrences of a plain string (no regular expression)."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)).cast("int")


def _occurrences(text: Column, leaf: Match) -> Column:
    if len(leaf.words) == 1 and not leaf.prefix and not leaf.first:
        return _count_of(text, f" {leaf.words[0]} ")
    # look-ahead: overlapping phrases each count
    return F.regexp_count(text, F.lit(f"(?={leaf.pattern()})"))


def _said(docs: DataFrame, text: str) -> Column:
    return F.coalesce(whole(docs) if text == "text" else F.col(text), F.lit(""))


def bm25(leaves: int, tf, df, n: Column, length: Column, avg_len: Column) -> Column:
    """Negative, lower is better; tf(i) and df(i) are the counts of leaf i in the text and over all texts."""
    total = F.lit(0.0)
    norm = fv.BM25_K1 * (1 - fv.BM25_B + fv.BM25_B * length / avg_len)
    for i in range(leaves):
        idf = F.greatest(F.ln((n - df(i) + 0.5) / (df(i) + 0.5)), F.lit(fv.BM25_IDF_FLOOR))
        total = total + idf * tf(i) * (fv.BM25_K1 + 1) / (tf(i) + norm)
    return -total


def scored(docs: DataFrame, query: Match, text: str = "text", scope: Column | None = None) -> DataFrame:
    """docs in scope matching the query, with their rank, by reading all texts; statistics are those of all docs.

    For a table that is searched more than once see text_index, which reads the query's terms only.
    """
    leaves = query.leaves()
    rows = docs.withColumn("__t", token_text(_said(docs, text)))
    rows = rows.withColumns({"__len": _count_of(F.col("__t"), "  ") - 1,
                             **{f"__tf{i}": _occurrences(F.col("__t"), leaf) for i, leaf in enumerate(leaves)}})
    sums = rows.agg(F.struct(
        F.count("*").cast("double").alias("n"), F.avg("__len").alias("avg_len"),
        *[F.sum((F.col(f"__tf{i}") > 0).cast("double")).alias(f"df{i}") for i in range(len(leaves))]).alias("s"))
    hits = rows.filter(query.test(F.col("__t")) if scope is None else query.test(F.col("__t")) & scope).withColumn("__s", sums.scalar())
    rank = bm25(len(leaves), lambda i: F.col(f"__tf{i}").cast("double"), lambda i: F.col(f"__s.df{i}"), F.col("__s.n"), F.col("__len"), F.col("__s.avg_len"))
    out = hits.withColumn("rank", rank)
    return out.drop(*[c for c in out.columns if c.startswith("__")])


def _one(test, term):
    return lambda w: test(w, term)


def snippet(text: Column, query: Match, size: int = fv.SNIPPET_TOKENS, marks: tuple[str, str] = ("«", "»")) -> Column:
    """The best slice of `size` words by distinct query terms hit, hits marked."""
    terms = list(dict.fromkeys((w, leaf.prefix and w is leaf.words[-1]) for leaf in query.leaves() for w in leaf.words))
    said = F.filter(F.split(text, r"\s+"), lambda w: w != "")

    def hit(w: Column, term: tuple[str, bool]) -> Column:
        return F.exists(tokens(w), lambda t: F.startswith(t, F.lit(term[0])) if term[1] else t == term[0])

    any_hit = lambda w: F.array_contains(F.array(*[hit(w, t) for t in terms]), True)
    starts_ = F.array_compact(F.transform(said, lambda w, i: F.when(any_hit(w), i)))

    def score(i: Column) -> Column:
        part = F.slice(said, i + 1, F.lit(size))
        n = sum((F.exists(part, _one(hit, t)).cast("int") for t in terms), F.lit(0))
        return F.struct(n.alias("n"), (-i).alias("at"))

    best = F.array_max(F.transform(starts_, score))
    at = F.coalesce(-best["at"], F.lit(0))
    marked = F.transform(F.slice(said, at + 1, F.lit(size)), lambda w: F.when(any_hit(w), F.concat(F.lit(marks[0]), w, F.lit(marks[1]))).otherwise(w))
    return F.concat(F.when(at > 0, " … ").otherwise(""), F.array_join(marked, " "),
                    F.when(F.size(said) > at + size, " … ").otherwise(""))


def search(docs: DataFrame, query: Match, limit: int, text: str = "text", tie: str | None = None, with_snippet: bool = True) -> DataFrame:
    """Top hits; snippets are cut for the page only."""
    top = scored(docs, query, text).orderBy("rank", *([tie] if tie else [])).limit(limit)
    return top.withColumn("snippet", snippet(_said(top, text), query)) if with_snippet else top


def postings(docs: DataFrame, doc_id: str, text: str = "text") -> DataFrame:
    """Inverted index for repeated queries: (term, doc, tf, first position), combined map-side."""
    rows = docs.select(doc_id, F.posexplode(tokens(_said(docs, text))).alias("pos", "term"))
    return rows.groupBy("term", doc_id).agg(F.count("*").alias("tf"), F.min("pos").alias("first_pos"))


def sessions_first(c: Corpus, query: Match, lanes: list[str], limit: int = 20, candidates: int | None = None, per_session: int = 3, recent: bool = False,
                   index=None, well: str | None = None, exact: bool = False) -> DataFrame:
    """Hits (all, or the first `candidates`) grouped by session: how many, best rank, first snippets; best rank, then hits, then recency.

    With an index (text_index) only the query's postings are read, and of the texts those of the
    sessions on the page.
    """
    key = ["session_id", "line_no", "pos"]
    scope = F.col("lane").isin(lanes)
    found = (scored(c.messages, query, scope=scope) if index is None else index.hits(query, scope)).select(*key, "lane", "rank")
    if well:
        found = found.join(in_wells(c.sessions, c.wells, "well", well, exact).select("session_id"), "session_id", "left_semi")
    top = staged(found if candidates is None else found.orderBy("rank", *key).limit(candidates), "search-hits")
    grouped = top.groupBy("session_id").agg(F.count("*").alias("hits"), F.min("rank").alias("best_rank"))
    s = c.sessions.select("session_id", "well", F.coalesce("last_activity_ts", "last_ts").alias("last_at"))
    order = [F.col("last_at").desc(), "best_rank"] if recent else ["best_rank", F.col("hits").desc(), F.col("last_at").desc()]
    page = staged(grouped.join(s, "session_id").orderBy(*order, "session_id").limit(limit), "search-sessions")
    ids = [r.session_id for r in page.select("session_id").collect()]
    mine = c.messages.where(F.col("session_id").isin(ids))
    w = Window.partitionBy("session_id").orderBy("rank", "line_no", "pos")  # the limit on its number is applied before the shuffle too
    few = top.where(F.col("session_id").isin(ids)).withColumn("i", F.row_number().over(w)).where(F.col("i") <= per_session).drop("lane")
    shown = (mine.join(F.broadcast(few), key).withColumn("snippet", snippet(whole(mine), query, 18)).groupBy("session_id")
             .agg(F.array_sort(F.collect_list(F.struct("i", "lane", "snippet"))).alias("snippets")))
    out = page.join(shown, "session_id", "left").join(ses.openers(mine), "session_id", "left")
    return out.orderBy(*order, "session_id")
