"""Search strings and the stored index, beside the scan of all texts and brute force."""

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from logloom.plans import query_text as qt, search as sr, text_index as ti
from logloom.schemas import Corpus

TEXTS = [("a", 1, "Alpha beta gamma"), ("a", 2, "alpha gamma beta alpha"), ("b", 3, "Délta alphabet three-tier"), ("b", 4, "nothing"), ("c", 5, None),
         ("c", 6, "don't İstanbul école Ёлка"), ("c", 7, "alpha x x x beta y y gamma"), (None, 8, "")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(TEXTS, "own string, id int, text string").cache()


@pytest.fixture(scope="module")
def index(docs, spark, tmp_path_factory):
    return ti.TextIndex(spark, str(tmp_path_factory.mktemp("index")), ("id",), "own", buckets=8).write(docs, F.col("text"))


def _ranked(rows):
    return sorted((r.id, round(r.rank, 9)) for r in rows.collect())


@pytest.mark.parametrize("said, found", [
    ("alpha beta", [1, 2, 7]), ('"alpha beta"', [1]), ("alpha + beta", [1]), ("alph*", [1, 2, 3, 7]), ("a*", [1, 2, 3, 7]), ("alpha NOT gamma", []), ("delta OR nothing", [3, 4]),
    ("delta OR beta AND x NOT nothing", [3, 7]), ("(alpha OR delta) AND beta", [1, 2, 7]), ("^alpha", [1, 2, 7]), ("^gamma", []),
    ("NEAR(alpha gamma, 0)", [2]), ("NEAR(alpha beta gamma, 1)", [1, 2]), ("NEAR(gamma alpha beta, 4)", [1, 2]), ("NEAR(alpha beta gamma, 6)", [1, 2, 7]), ('NEAR("x x" beta, 0)', [7]),
    ("text:alpha", [1, 2, 7]), ("three-tier", [3]), ("don't", [6]), ('"alpha', [1, 2, 7]), ("alpha (beta", [1, 2, 7]), ("foo:alpha", []), ("three-tier OR", []),
    ("istanbul ecole", [6]), ("елка", [6]), ("!!!", []), ("alpha !!!", [1, 2, 7]), ("alpha AND !!!", []), ("near", []), ("NEAR(alpha, x)", []),
])
def test_strings_find_the_same_in_the_index_and_by_scan(docs, index, said, found):
    query = qt.read(said)
    hits = _ranked(index.hits(query))
    assert [i for i, _ in hits] == found and hits == _ranked(sr.scored(docs, query))


def test_what_is_no_query():
    for said in ("", "   "):
        with pytest.raises(qt.QueryError, match="invalid search query"):
            qt.read(said)
    assert qt.quoted('say "hi"  three-tier') == '"say" """hi""" "three-tier"'
    assert (qt.with_open_end(" half typ "), qt.with_open_end("a OR b"), qt.with_open_end("a-b"), qt.with_open_end("")) == ("half typ*", "a OR b", "a-b", "")
    with pytest.raises(ValueError):
        sr.near(sr.near(sr.word("a"), sr.word("b")), sr.word("c"))
    assert sr.all_words("").op == sr.phrase("...").op == sr.near(sr.word("a"), sr.word("-")).op == "nothing"


def test_near_is_brute_force(spark, tmp_path):
    draw = random.Random(7)
    rows = [(i, " ".join(draw.choice("a b c d e f".split()) for _ in range(draw.randint(1, 25)))) for i in range(60)]
    docs = spark.createDataFrame(rows, "id int, text string").withColumn("own", F.lit("o"))
    index = ti.TextIndex(spark, str(tmp_path), ("id",), "own", buckets=4).write(docs, F.col("text"))
    for parts, gap in ((["a", "b", "c"], 1), (["a b", "c"], 0), (["a", "b c", "d", "e"], 3), (["f"], 0), (["a", "a"], 0)):
        want = []
        for i, text in rows:
            w = text.split()
            starts = [[k for k in range(len(w)) if w[k:k + len(p.split())] == p.split()] for p in parts]
            if any(all(max(c) - s - len(p.split()) <= gap for s, p in zip(c, parts)) for c in itertools.product(*starts)):
                want.append(i)
        query = sr.near(*[sr.phrase(p) for p in parts], distance=gap)
        assert [r.id for r in index.hits(query).orderBy("id").collect()] == want
        assert [r.id for r in sr.scored(docs, query).orderBy("id").collect()] == want


def test_a_refresh_replaces_owners_and_merging_keeps_the_rest(spark, docs, tmp_path):
    index = ti.TextIndex(spark, str(tmp_path / "one"), ("id",), "own", buckets=8).write(docs, F.col("text"))
    new = spark.createDataFrame([("b", 3, "beta only"), ("d", 9, "alpha delta"), (None, 10, "alpha again")], docs.schema)
    index.update(new, F.col("text"), spark.createDataFrame([("c",)], "own string"))
    live = docs.where("own = 'a'").unionByName(new)
    whole = index.merged(str(tmp_path / "two"))
    for said in ("alpha", "beta", "nothing", "istanbul", "alpha OR beta", "del*"):
        want = _ranked(sr.scored(live, qt.read(said)))
        assert _ranked(index.hits(said)) == want == _ranked(whole.hits(said)), said
    assert whole.generations() == [0] and sorted(index.generations()) == [0, 1]


def test_a_generation_without_owners_does_not_count(spark, docs, index, tmp_path):
    one = ti.TextIndex(spark, str(tmp_path), ("id",), "own", buckets=8).write(docs, F.col("text"))
    spark.read.parquet(f"{tmp_path}/postings/generation=0").write.partitionBy("bucket").parquet(f"{tmp_path}/postings/generation=1")
    assert _ranked(one.hits("alpha")) == _ranked(index.hits("alpha"))


def test_a_search_reads_the_folders_of_its_words(index):
    plan = index.hits("alpha beta")._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[.*bucket", plan) and re.search(r"DataFilters: \[\(\(term#\d+ = alpha\) OR \(term#\d+ = beta\)\)", plan)
    assert "text" not in "".join(re.findall(r"ReadSchema: \S+", plan))


def test_pages_of_messages_and_documents(spark, tmp_path):
    rows = [("s1", 0, 0, "prompt", "p1", "main", "find alpha here", "2024-01-02 00:00:00"), ("s1", 1, 0, "tool", "p1", "main", "alpha", "2024-01-02 00:00:01"),
            ("s2", 0, 0, "prompt", "p2", "dev", "alpha alpha", "2024-02-02 00:00:00"), ("t1", 0, 0, "prompt", "p3", "dev", "beta alpha", "2024-01-02 10:00:00")]
    messages = spark.createDataFrame(rows, "session_id string, line_no bigint, pos int, lane string, prompt_id string, git_branch string, text string, t string").withColumn("ts", F.to_timestamp("t"))
    sessions = spark.createDataFrame([("s1", "-u-one"), ("s2", "-u-one"), ("t1", "-u-two")], "session_id string, well string")
    wells = spark.createDataFrame([("-u-one", "/u/one"), ("-u-two", None)], "dir string, real_path string")
    c = Corpus(messages=messages, sessions=sessions, wells=wells)
    index = ti.index_messages(spark, messages, str(tmp_path / "m"))

    def found(**scope):
        return [r.session_id for r in ti.search_messages(c, index, "alpha", ["prompt"], 10, **scope).collect()]
    assert sorted(found()) == ["s1", "s2", "t1"]
    assert sorted(found(well="/u/one", exact=True)) == ["s1", "s2"] and found(well="TWO") == ["t1"] and found(well="u/on", exact=True) == []
    assert found(session="t") == ["t1"] and sorted(found(until="2024-01-03")) == ["s1", "t1"] and found(since="2024-01-02T09:00:00Z", until="2024-02-01") == ["t1"]
    one = ti.search_messages(c, index, "beta", ["prompt"], 10).first()
    assert (one.well, one.real_path, one.prompt_id, one.git_branch, one.snippet) == ("-u-two", None, "p3", "dev", "«beta» alpha")
    docs = spark.createDataFrame([("r1", "a.md", "alpha text"), ("r2", "b.md", "more alpha")], "repo string, path string, text string")
    repos = spark.createDataFrame([("r1", "main", True, "mine")], "repo string, ref string, is_husk boolean, ownership string")
    got = ti.search_documents(Corpus(docs=docs, repos=repos), ti.index_documents(spark, docs, str(tmp_path / "d")), "alpha", 10).collect()
    assert {(r.repo, r.ref, r.is_husk, r.ownership) for r in got} == {("r1", "main", True, "mine"), ("r2", None, None, None)}
    history = spark.createDataFrame([("h", 1, "1704153600000", "p", "s1", "alpha now"), ("h", 2, "2024-03-01T00:00:00Z", "p", "s2", "alpha later")],
                                    "file_path string, line_no int, ts string, project string, session_id string, display string")
    typed = ti.index_history(spark, history, str(tmp_path / "h"), ("file_path", "line_no"), "file_path")
    assert [r.line_no for r in ti.search_history(history, typed, "alpha", 10, until="2024-02-01").collect()] == [1]
    assert [r.at.isoformat() for r in ti.search_history(history, typed, "alpha", 10, session="s2").collect()] == ["2024-03-01T00:00:00"]


def test_a_task_sorts_a_bounded_part_of_the_postings(spark, tmp_path, monkeypatch):
    """Ranges follow the tokens, also in a merge, and nothing is sorted or grouped again after the exchange."""
    docs = spark.range(400).select("id", (F.col("id") % 3).cast("string").alias("own"), F.concat(F.lit("one two one "), F.col("id").cast("string")).alias("text"))
    monkeypatch.setattr(ti, "TASK_TOKENS", 100)
    index = ti.TextIndex(spark, str(tmp_path / "one"), ("id",), "own", buckets=4).write(docs, F.col("text"))
    whole = index.merged(str(tmp_path / "two"))
    for made in (index, whole):
        files = spark.read.parquet(f"{made.path}/postings").groupBy(F.input_file_name().alias("f")).agg(F.sum(F.size("positions")).alias("n"))
        assert files.count() >= 16 and files.agg(F.max("n")).first()[0] <= 400  # 1600 tokens
        assert {(r.id, r.term, tuple(r.positions), r.length) for r in made.postings().collect()} == {
            x for i in range(400) for x in ((i, "one", (0, 2), 4), (i, "two", (1,), 4), (i, str(i), (3,), 4))}
    plan = index._dealt(index.postings(), 1600)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and plan.count("Sort ") == 1


def test_rows_of_the_same_keys_are_one_text(spark, tmp_path):
    docs = spark.createDataFrame([(1, "o", "alpha beta"), (1, "o", "alpha beta"), (None, "o", "beta"), (None, "o", "beta"), (2, "o", "")], "id int, own string, text string")
    index = ti.TextIndex(spark, str(tmp_path), ("id",), "own", buckets=4).write(docs, F.col("text"))
    assert {(r.id, r.term, tuple(r.positions)) for r in index.postings().collect()} == {(1, "alpha", (0, 0)), (1, "beta", (1, 1)), (None, "beta", (0, 0))}
    assert [tuple(r) for r in index.live_owners().select("docs", "tokens").collect()] == [(5, 6)]
