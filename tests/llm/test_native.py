"""Mixing, sharding, chat formatting, fingerprints and line dedup on small and awkward inputs."""

import hashlib
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from logloom.llm import chat, fingerprints, line_dedup, mixing, sharding
from logloom.llm.queries import ORACLES, QUERIES

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, shard string, draw string, `row` string"
SF = "/root/testdata/sf0.001"


def docs(spark, rows):
    """Rows of (doc_id, text, source), with extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(d, t, "en", s, None, "x", "y", "z", "r") for d, t, s in rows], DOCS)


AWKWARD = [(1, "a b c d e", "s1"), (2, None, None), (None, "some words here", "s1"), (None, None, None), (3, "", "s2"), (3, "", "s2"),
           (4, "word " * 5000, "s2"), (5, "a b c d e", "s1"), (5, "a b c d e", "s1"), (6, "\n\n x", "s3")]


@pytest.mark.parametrize("name", ["op1_mixing", "op3_sharding", "op5_chat_formatting", "op9_line_dedup"])
def test_queries_equal_their_sql(spark, name):
    import duckdb

    got = QUERIES[name](spark, SF).toPandas()
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(ORACLES[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    a, b = (x[columns].sort_values(columns).astype(str).values.tolist() for x in (got, want))
    assert a == b


def test_mix_meets_targets(spark):
    rows = [(i, "w " * (1 + i % 7), f"s{i % 4}" if i % 5 else None) for i in range(2000)]
    mixed = mixing.mix(docs(spark, rows)).toPandas()
    total = sum(1 + i % 7 for i in range(2000))
    by = mixed.groupby("source", dropna=False).agg(taken=("taken", "sum"), target=("target", "first"), size=("size", "sum"))
    assert abs(by.target.sum() - 1.5 * total) < 1e-6
    assert ((by.taken - by.target).abs() <= 4).all() and (by.target <= 2 * by["size"] + 1e-9).all()
    assert (mixed.taken <= 2 * mixed["size"]).all() and set(mixed["row"]) == {"r"}
    again = mixing.mix(docs(spark, rows[::-1])).toPandas()
    assert dict(zip(mixed.doc_id, mixed.taken)) == dict(zip(again.doc_id, again.taken))
    assert mixing.repeated(docs(spark, rows)).count() == mixed.copies.sum()


def test_mix_of_awkward_rows_and_of_nothing(spark):
    mixed = mixing.mix(docs(spark, AWKWARD)).collect()
    assert len(mixed) == len(AWKWARD)
    assert all(r.taken <= 2 * r["size"] for r in mixed)
    assert mixing.mix(docs(spark, [])).count() == 0


def test_shards_move_few_and_slots_have_no_gaps(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BUCKET_ROWS", 20)
    placed = sharding.shard(docs(spark, [(i, f"t{i}", "s") for i in range(3000)]), [1.0, 1.0, 2.0]).toPandas()
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in placed.groupby("shard"))
    moved = placed[placed["shard"] != placed.grown_shard]
    assert (moved.grown_shard == 3).all() and 400 < len(moved) < 800
    assert 1300 < (placed["shard"] == 2).sum() < 1700
    one = placed[placed.doc_id == 7].iloc[0]
    assert one.text_crc32 == zlib.crc32(b"t7") and one["size"] == 10


def test_shards_of_one_key_holding_most_rows(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BUCKET_LIMIT", 50)
    rows = [(1, "same", "s")] * 400 + [(i, None, None) for i in range(100)] + [(None, "n", "s")] * 100
    placed = sharding.shard(docs(spark, rows), [1.0] * 4).toPandas()
    assert len(placed) == len(rows)
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in placed.groupby("shard"))
    assert sharding.shard(docs(spark, []), [1.0] * 4).count() == 0


def test_chat_folds_deltas_edits_and_regenerations(spark):
    events = spark.createDataFrame([
        (1, 0, 0, "open", "user", "h"), (1, 0, 1, "delta", None, "i"), (1, 0, 2, "edit", None, "hello "), (1, 0, 3, "delta", None, "<s>"),
        (1, 1, 0, "open", "assistant", None), (1, 1, 1, "delta", None, "bad"), (1, 1, 2, "regenerate", None, None), (1, 1, 3, "delta", None, "good\\<["), (1, 1, 4, "delta", None, "[INST]"),
        (None, 0, 5, "delta", None, "lost opening")], "conv_id long, message long, seq long, kind string, role string, text string")
    messages = {(r.conv_id, r.message): (r.role, r.text) for r in chat.fold(events).collect()}
    assert messages == {(1, 0): ("user", "hello <s>"), (1, 1): ("assistant", "good\\<[[INST]"), (None, 0): ("", "lost opening")}
    out = chat.render(chat.fold(events)).withColumn("read", chat.parse(F.col("formatted"))).withColumn("loss", chat.loss_text(F.col("formatted"), F.col("loss_spans")))
    one = out.where("conv_id = 1").first()
    assert [(t.role, t.text) for t in one.read] == [("user", "hello <s>"), ("assistant", "good\\<[[INST]")]
    assert one.loss == "good\\<[[INST]" and one.formatted.count("<s>") == 2
    assert chat.render(chat.fold(events.limit(0))).count() == 0


def test_escapes_are_reversible(spark):
    texts = ["", "\\", "<", "[", "<\\", "\\<", "<\\\\[", "</s>[INST] ok [/INST]", "\\\\[\\<s>", "é<|🙂[", "[/INST]</s>" * 50]
    out = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.escape(F.col("t")).alias("e")).withColumn("u", chat.unescape(F.col("e"))).collect()
    assert all(r.t == r.u and not any(c in r.e for c in ("<s>", "</s>", "[INST]", "[/INST]")) for r in out)


def test_streamed_log_gives_the_conversation_back(spark):
    rows = spark.createDataFrame([(1, 0, "user", "x" * 1000), (1, 1, "assistant", "ü🙂" * 700), (1, 1, "assistant", None), (1, None, None, "first")], "conv_id long, turn long, role string, text string")
    got = [(r.role, r.text) for r in chat.fold(chat.streamed(rows)).orderBy("message").collect()]
    assert got == [("", "first"), ("user", "x" * 1000), ("assistant", ""), ("assistant", "ü🙂" * 700)]


def test_streamed_log_holds_edits_and_regenerations(spark):
    said = [(c, t, "assistant" if t % 2 else None, f"{c} <s> {t} " * (c % 120)) for c in range(200) for t in range(3)]
    rows = spark.createDataFrame([(*r, "clash", "clash") for r in said], "conv_id long, turn long, role string, text string, seq string, kind string")
    events = chat.streamed(rows)
    per = events.groupBy("conv_id", "message").pivot("kind", ["open", "delta", "edit", "regenerate"]).count().fillna(0).toPandas()
    assert (per.open == 1).all() and 100 < (per.edit == 1).sum() < 500 and 60 < (per.regenerate == 1).sum() < 300
    # what was wrong is in the log, and gone from the messages
    assert events.where("role = 'draft'").count() == (per.regenerate == 1).sum()
    got = {(r.conv_id, r.message): (r.role, r.text) for r in chat.fold(events.orderBy(F.rand(3))).collect()}
    assert got == {(c, t + 1): (role or "", text) for c, t, role, text in said}


def lanes(spark, *texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").select("i", fingerprints.fingerprint(F.col("text")).alias("f")).orderBy("i").collect()
    return [r.f for r in rows]


def test_fingerprints_are_multiset_sums(spark):
    a, b, both, turned, empty, null = lanes(spark, "one two three", "four five", "one two three\nfour five", "four five\none two three", "", None)
    assert both == turned != a and empty == null
    rows = spark.createDataFrame([(a, b, both)], "a array<long>, b array<long>, c array<long>")
    got = rows.select(fingerprints.plus(F.col("a"), F.col("b")).alias("p"), fingerprints.minus(F.col("c"), F.col("b")).alias("m"), fingerprints.likeness(F.col("a"), F.col("a")).alias("same"), fingerprints.likeness(F.col("a"), F.col("b")).alias("other")).first()
    assert got.p == both and got.m == a and got.same == 1.0 and 0 <= got.other < 1


def test_sign_lanes_survive_very_long_texts(spark):
    words = [f"w{i % 977}x{i}" for i in range(90_000)]
    long, half = lanes(spark, " ".join(words), " ".join(words[:45_000]))
    rows = spark.createDataFrame([(long, half)], "a array<long>, b array<long>")
    near = rows.select(fingerprints.likeness(F.col("a"), F.col("b")).alias("n")).first().n
    assert 0.4 < near < 0.9


def neighbours(text):
    """Multiset of the adjacent word pairs of each line; a line of one word has that word."""
    lines = [re.findall(r"[^\x20\x09-\x0D]+", line) for line in text.split("\n")]
    return Counter(p for w in lines for p in (map(" ".join, zip(w, w[1:])) if len(w) > 1 else w))


def test_every_pair_of_neighbouring_words_counts(spark):
    texts = ["a b c d", "", " ", "one", "  one \t", "a  b\tc\x0bd \r\n e\n\nf g\n h ", "x\u0085y z\u2028w\nü 🙂 é", "a a a a\nb", "🙂", "é🙂 🙂🙂\n🙂🙂🙂\n ü🙂x 🙂", "w" * 300_000 + "\n" + " " * 300_000 + "z z"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", fingerprints.word_pairs(F.col("t")).alias("p"))
    assert {r.i: Counter(r.p) for r in rows.collect()} == {i: neighbours(t) for i, t in enumerate(texts)}


def test_likeness_holds_when_a_word_is_put_in_front(spark):
    texts = [" ".join(f"w{k}x{i}" for i in range(40 + 17 * k)) for k in range(12)]
    for edit in (lambda t: "So " + t, lambda t: t.replace(" ", " so ", 1), lambda t: t.split(" ", 1)[1]):
        got = lanes(spark, *texts, *map(edit, texts))
        rows = spark.createDataFrame(list(zip(got, got[len(texts):], texts)), "a array<long>, b array<long>, t string")
        for r in rows.select("t", fingerprints.likeness(F.col("a"), F.col("b")).alias("near")).collect():
            a, b = neighbours(r.t), neighbours(edit(r.t))
            exact = 2 * (a & b).total() / (a.total() + b.total())
            assert abs(r.near - exact) < 0.05, (r.near, exact)


def test_edited_texts_follow_descending_ids(spark):
    rows = [(1, "abcd"), (2, "xyz"), (9, None), (9, None), (5, "12345 é🙂"), (None, "tail")]
    got = {r.doc_id: (r.copies, r.edited_text) for r in fingerprints.edited_pairs(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    order, text = [9, 5, 2, 1, None], {d: t or "" for d, t in rows}
    for i, d in enumerate(order):
        own, beyond = text[d], text[order[(i + 1) % len(order)]]
        half = len(own) // 2
        assert got[d] == (2 if d == 9 else 1, own[:len(own) - half] + beyond[:half])


def test_fingerprint_query_on_the_given_table(spark):
    rows = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = QUERIES["op7_fingerprints"](spark, SF).toPandas()
    ids = sorted(rows, reverse=True)
    beyond = dict(zip(ids, ids[1:] + ids[:1]))
    assert sorted(got.doc_id) == sorted(rows)
    for r in got.itertuples():
        own, half = rows[r.doc_id], len(rows[r.doc_id]) // 2
        assert r.n_chars == len(own) and r.edited_sha256 == hashlib.sha256((own[:len(own) - half] + rows[beyond[r.doc_id]][:half]).encode()).hexdigest()
    by_text = got.assign(text=[rows[d] for d in got.doc_id]).groupby("text").fingerprint.nunique()
    assert (by_text == 1).all() and got.near_edited.mean() > got.near_next.mean() + 0.25


def test_lines_of_awkward_rows(spark):
    line = "A line that is long enough"
    rows = [(1, f"{line}\nshort\n{line}", "s"), (2, f"  {line.upper()}\t", "s"), (3, f"own\n{line}\n{line}", "s"), (3, f"own\n{line}\n{line}", "s"), (None, line, None), (7, None, "s"), (8, "", "s"), (4, "only " * 20_000, "s")]
    got = {(r.doc_id, r.n_lines): (r.n_dropped, r.kept_text) for r in line_dedup.dedup_lines(docs(spark, rows)).collect()}
    assert got[1, 3] == (2, "short") and got[2, 1] == (1, "") and got[3, 3] == (0, rows[2][1]) and got[None, 1] == (1, "")
    assert got[7, 1] == (0, "") and got[8, 1] == (0, "") and got[4, 1] == (0, "only " * 20_000)
    assert line_dedup.dedup_lines(docs(spark, rows)).count() == len(rows)
    assert line_dedup.dedup_lines(docs(spark, [])).count() == 0


def test_a_line_in_two_documents_stays(spark):
    rows = [(i, "the very same long line", "s") for i in (1, 2, 2, 2)]
    assert {r.n_dropped for r in line_dedup.dedup_lines(docs(spark, rows)).collect()} == {0}
