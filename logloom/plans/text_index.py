"""A stored positional index of a text table: searches read the postings of their own words.

The index is three plain tables under one folder, written in generations:

    postings/generation=g/bucket=b   term, keys, owner, carried columns, length of the text, positions
    owners/generation=g              owner, docs, tokens: what the generation holds of each owner

A bucket is a hash of a term's first two letters, so a word or a prefix of two letters is one folder,
and files are sorted by term, so footers narrow the read further. Postings are dealt by range of
(bucket, term, keys): a term that every text holds is spread over tasks and files. A text's places are
put together before that, and the number of ranges follows the number of tokens: a task sorts a bounded part.

An owner is what is replaced as a whole, such as a log file or session. A later generation takes the
place of everything earlier generations hold of its owners; `merged` writes the live postings anew.
Corpus-wide figures (texts, mean length) come from the owners table, a term's from its postings.

Keys name one text each and are not null; no column may have the name of an index column (term, bucket, length, positions, at_token, generation); a null owner is an owner of its own; null texts have no tokens and count
as texts. One posting holds a term's places in one text, so it is bounded by the text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from logloom.functions.timekeys import window_filter
from logloom.operators.filters import in_wells
from logloom.operators.sizes import small_side
from logloom.operators.stages import staged
from logloom.plans.search import Match, bm25, snippet, tokens
from logloom.plans.query_text import read
from logloom.schemas import Corpus, whole
from logloom.sources.side_files import instant

BUCKETS, HEAD = 64, 2
#: Tokens whose postings are one task's to sort and write.
TASK_TOKENS = 1_000_000


def _bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.substring(term, 1, HEAD)), F.lit(buckets)).cast("int")


def _moved(by: int):
    return lambda i: i - by


def _by_term(cut: DataFrame) -> DataFrame:
    """cut with its tokens `w` put together: `length`, and `runs` of each term and its places, both ascending."""
    at, begins = F.col("places"), F.col("begins")
    new = lambda i: (i == 0) | (i == F.size(at)) | (F.get(at, i)["term"] != F.get(at, i - 1)["term"])
    posting = lambda b, j: F.struct(F.get(at, b)["term"].alias("term"), F.slice(at, b + 1, F.get(begins, j + 1) - b)["at"].alias("positions"))
    rows = cut.withColumns({"length": F.size("w"), "places": F.sort_array(F.transform("w", lambda t, i: F.struct(t.alias("term"), i.alias("at"))))}).drop("w")
    rows = rows.withColumn("begins", F.filter(F.sequence(F.lit(0), F.size(at)), new))  # the last one is the end
    return rows.withColumn("runs", F.when(F.size(at) > 0, F.transform(F.slice(begins, 1, F.size(begins) - 1), posting))).drop("places", "begins")


@dataclass(frozen=True)
class TextIndex:
    spark: SparkSession
    path: str
    keys: tuple[str, ...]
    owner: str
    carry: tuple[str, ...] = field(default=())
    buckets: int = BUCKETS
    seen: dict = field(default_factory=dict, compare=False, repr=False)

    # --- writing ----------------------------------------------------------------------

    def write(self, docs: DataFrame, text: Column, generation: int = 0) -> "TextIndex":
        """Index docs as one generation; all earlier postings of their owners are out of use from then on."""
        held = list(dict.fromkeys([*self.keys, self.owner, *self.carry]))
        # cut into terms once: the owners' sums, the ranges' sample and the exchange read them from here
        rows = staged(_by_term(docs.select(*held, tokens(F.coalesce(text, F.lit(""))).alias("w"))), "index-terms")
        posted = rows.select(*held, "length", F.explode("runs").alias("run")).select(F.col("run.term").alias("term"), *held, "length", F.col("run.positions").alias("positions"))
        order = ["bucket", "term", *self.keys]
        # the one exchange: order of the files and folders follows it
        posted = self._dealt(posted.withColumn("bucket", _bucket(F.col("term"), self.buckets)), rows.agg(F.sum("length")).first()[0])
        if not rows.groupBy(*self.keys).count().where("count > 1").isEmpty():
            # rows of the same keys are one text; they lie in one range
            posted = posted.groupBy(*order).agg(*[F.any_value(c).alias(c) for c in held if c not in self.keys], F.any_value("length").alias("length"), F.sort_array(F.flatten(F.collect_list("positions"))).alias("positions"))
        self._put(posted, rows.groupBy(F.col(self.owner).alias("owner")).agg(F.count("*").alias("docs"), F.sum("length").alias("tokens")), generation)
        return self

    def _dealt(self, posted: DataFrame, tokens_in: int | None) -> DataFrame:
        """Postings in order, in ranges that hold the postings of about TASK_TOKENS tokens, however many tokens there are."""
        order, wanted = ["bucket", "term", *self.keys], -(-(tokens_in or 0) // TASK_TOKENS)
        # few tokens are left to the session's own number of partitions, which Spark may lower
        more = [wanted] if wanted > int(self.spark.conf.get("spark.sql.shuffle.partitions")) else []
        return posted.repartitionByRange(*more, *order).sortWithinPartitions(*order)

    def _put(self, posted: DataFrame, owners: DataFrame, generation: int) -> None:
        # owners go last: a generation counts once they are there
        posted.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/postings/generation={generation}")
        owners.write.mode("overwrite").parquet(f"{self.path}/owners/generation={generation}")

    def update(self, docs: DataFrame, text: Column, gone: DataFrame | None = None) -> "TextIndex":
        """Another generation: docs are all texts of the owners they name; owners in `gone` have none any more."""
        generation = max(self.generations()) + 1
        self.write(docs, text, generation)
        if gone is not None:
            none = gone.select(F.col(self.owner).alias("owner")).distinct().withColumns({"docs": F.lit(0).cast("long"), "tokens": F.lit(0).cast("long")})
            none.write.mode("append").parquet(f"{self.path}/owners/generation={generation}")
        return self

    def merged(self, path: str) -> "TextIndex":
        """The live postings as one generation in another folder."""
        into = TextIndex(self.spark, path, self.keys, self.owner, self.carry, self.buckets)
        owners = self.live_owners().where("docs > 0").drop("generation")
        into._put(into._dealt(self.postings().drop("generation"), owners.agg(F.sum("tokens")).first()[0]), owners, 0)
        return into

    # --- reading ----------------------------------------------------------------------

    def _table(self, name: str) -> DataFrame:
        # the columns stay the same from generation to generation: footers are read for them once
        found = self.spark.read.schema(self.seen[name]).parquet(f"{self.path}/{name}") if name in self.seen else self.spark.read.parquet(f"{self.path}/{name}")
        self.seen[name] = found.schema
        return found

    def generations(self) -> list[int]:
        """Told by the folders of the owners' files, without a job."""
        return sorted({int(g) for f in self._table("owners").inputFiles() for g in re.findall(r"/generation=(\d+)/", f)})

    def _owners(self) -> DataFrame:
        return self._table("owners").groupBy("owner", "generation").agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))

    def live_owners(self) -> DataFrame:
        last = F.max_by(F.struct("generation", "docs", "tokens"), "generation")
        return self._owners().groupBy("owner").agg(last.alias("x")).select("owner", "x.*")

    def postings(self, wanted: Column | None = None) -> DataFrame:
        """Postings in use, of the wanted terms."""
        generations = self.generations()
        rows = self._table("postings").where(F.col("generation").isin(generations))
        rows = rows if wanted is None else rows.where(wanted)
        if len(generations) == 1:
            return rows
        stale = self._owners().select("owner", F.col("generation").alias("old"))
        last = self.live_owners().select(F.col("owner").alias("of"), F.col("generation").alias("last"))
        stale = stale.join(last, F.col("owner").eqNullSafe(F.col("of")) & (F.col("old") < F.col("last"))).select(F.col("owner").alias("stale"), "old")
        return rows.join(small_side(stale), F.col(self.owner).eqNullSafe(F.col("stale")) & (F.col("generation") == F.col("old")), "left_anti")

    def _matched(self, query: Match) -> tuple[DataFrame, dict[Match, str]]:
        """Texts with any word of the query: keys, carried columns, length and the starts of each phrase, one column a phrase."""
        phrases = list(dict.fromkeys(query.leaves(scored=False)))
        slots = list(dict.fromkeys((w, p.prefix and j == len(p.words) - 1) for p in phrases for j, w in enumerate(p.words)))
        wanted, places = F.lit(False), []
        for w, prefix in slots:
            said = F.startswith("term", F.lit(w)) if prefix else F.col("term") == w
            near = F.lit(True) if prefix and len(w) < HEAD else F.col("bucket") == _bucket(F.lit(w), self.buckets)
            wanted = wanted | (near & said)
            places.append(F.flatten(F.collect_list(F.when(said, F.col("positions")))).alias(f"s{len(places)}"))
        held = [c for c in dict.fromkeys([self.owner, *self.carry]) if c not in self.keys]
        rows = self.postings(wanted).groupBy(*self.keys).agg(*[F.any_value(c).alias(c) for c in held], F.any_value("length").alias("length"), *places)
        columns = {}
        for p in phrases:
            at = None
            for j, w in enumerate(p.words):
                own = F.transform(f"s{slots.index((w, p.prefix and j == len(p.words) - 1))}", _moved(j))
                at = own if at is None else F.array_intersect(at, own)
            columns[p] = f"p{len(columns)}"
            rows = rows.withColumn(columns[p], F.filter(at, lambda i: i == 0) if p.first else at)
        return rows.drop(*[f"s{i}" for i in range(len(slots))]), columns

    def hits(self, query: Match | str, scope: Column | None = None) -> DataFrame:
        """Keys, owner, carried columns and rank of all texts that match; scope is a condition over these columns.

        A term's figures count all texts, in scope or not.
        """
        query = read(query) if isinstance(query, str) else query
        held = list(dict.fromkeys([*self.keys, self.owner, *self.carry]))
        if not query.leaves():
            return self._table("postings").where("false").select(*held, F.lit(0.0).alias("rank"))
        rows, columns = self._matched(query)
        leaves = [columns[p] for p in query.leaves()]
        figures = rows.agg(F.struct(*[F.sum((F.size(c) > 0).cast("double")).alias(f"df{i}") for i, c in enumerate(leaves)])).scalar()
        whole = self.live_owners().agg(F.struct(F.sum("docs").cast("double").alias("n"), (F.sum("tokens") / F.sum("docs")).alias("avg_len"))).scalar()
        decided = query.decide(lambda p: F.size(columns[p]) > 0, lambda p: F.col(columns[p]))
        found = rows.where(decided if scope is None else decided & scope).withColumns({"__f": figures, "__w": whole})
        rank = bm25(len(leaves), lambda i: F.size(leaves[i]).cast("double"), lambda i: F.col(f"__f.df{i}"), F.col("__w.n"), F.col("length"), F.col("__w.avg_len"))
        return found.select(*held, rank.alias("rank"))

    def page(self, query: Match | str, docs: DataFrame, text: Column, limit: int, scope: Column | None = None, size: int = 24, marks: tuple[str, str] = ("«", "»")) -> DataFrame:
        """The best `limit` hits with a snippet each; of docs only their rows are asked for."""
        query = read(query) if isinstance(query, str) else query
        top = staged(self.hits(query, scope).orderBy("rank", *self.keys).limit(limit), "search-page")
        return with_texts(top, docs, self.keys, snippet(text, query, size, marks))


def with_texts(top: DataFrame, docs: DataFrame, keys: tuple[str, ...], shown: Column) -> DataFrame:
    """top, a page of rows, with `snippet` from the rows of docs it names: their first key goes to the scan as a list."""
    first = [r[0] for r in top.select(keys[0]).distinct().collect()]
    said = docs.where(F.col(keys[0]).isin(first)).withColumn("snippet", shown).select(*keys, "snippet")
    return F.broadcast(top).join(said, list(keys))


def named_scope(*, lanes: list[str] | None = None, since=None, until=None, tz: str = "UTC", session: str | None = None, at: Column | None = None) -> Column:
    """Condition over carried columns: lanes, a window in local days or instants (`at` is the instant, `ts` if not given), a session id's beginning."""
    cond = F.lit(True) if lanes is None else F.col("lane").isin(lanes)
    if since or until:
        cond = cond & window_filter(F.col("ts") if at is None else at, since, until, tz)
    if session:
        cond = cond & F.startswith("session_id", F.lit(session))
    return cond


def index_messages(spark: SparkSession, messages: DataFrame, path: str) -> TextIndex:
    """Messages by session; a refresh replaces a session's."""
    return TextIndex(spark, path, ("session_id", "line_no", "pos"), "session_id", ("lane", "ts")).write(messages, whole(messages))


def index_documents(spark: SparkSession, docs: DataFrame, path: str) -> TextIndex:
    return TextIndex(spark, path, ("repo", "path"), "repo").write(docs, F.col("text"))


def index_history(spark: SparkSession, history: DataFrame, path: str, keys: tuple[str, ...], owner: str) -> TextIndex:
    """Prompt history; keys name a line, owner the file it is reloaded with."""
    return TextIndex(spark, path, keys, owner, ("ts", "project", "session_id")).write(history, F.col("display"))


def search_messages(c: Corpus, index: TextIndex, query: str, lanes: list[str], limit: int, *, well: str | None = None, exact: bool = False,
                    since=None, until=None, tz: str = "UTC", session: str | None = None) -> DataFrame:
    """Best messages of a search string, in a named scope."""
    said = read(query)
    found = index.hits(said, named_scope(lanes=lanes, since=since, until=until, tz=tz, session=session))
    if well:
        found = found.join(in_wells(c.sessions, c.wells, "well", well, exact).select("session_id"), "session_id", "left_semi")
    top = staged(found.orderBy("rank", *index.keys).limit(limit), "search-page")
    shown = F.struct("prompt_id", "git_branch", snippet(whole(c.messages), said).alias("snippet"))
    page = with_texts(top, c.messages, index.keys, shown).select(*top.columns, "snippet.*")
    # a page names few sessions, and these fewer wells
    homes = c.sessions.select("session_id", "well").join(F.broadcast(top.select("session_id").distinct()), "session_id")
    wells = c.wells.select(F.col("dir").alias("well"), "real_path").join(F.broadcast(homes.select("well").distinct()), "well")
    return page.join(F.broadcast(homes), "session_id", "left").join(F.broadcast(wells), "well", "left").orderBy("rank", *index.keys)


def search_history(history: DataFrame, index: TextIndex, query: str, limit: int, *, since=None, until=None, tz: str = "UTC", session: str | None = None) -> DataFrame:
    """Best lines of the prompt history. ts is epoch milliseconds or ISO text: the window is over the instant, which is `at` in the hits."""
    at = instant(F.col("ts"))
    page = index.page(query, history, F.col("display"), limit, named_scope(since=since, until=until, tz=tz, session=session, at=at))
    return page.withColumn("at", at).orderBy("rank", *index.keys)


def search_documents(c: Corpus, index: TextIndex, query: str, limit: int, repo: str | None = None) -> DataFrame:
    """Best documents, with what is known of their repository: ref, ownership, and whether the local side is a husk."""
    scope = None if repo is None else F.col("repo").ilike(f"%{repo}%")
    page = index.page(query, c.docs, F.col("text"), limit, scope)
    flags = c.repos.select("repo", "ref", "is_husk", "ownership").join(F.broadcast(page.select("repo").distinct()), "repo")
    return page.join(F.broadcast(flags), "repo", "left").orderBy("rank", *index.keys)
