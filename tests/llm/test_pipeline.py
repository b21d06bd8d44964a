"""The pipeline, stage by stage and as a whole."""

import random

import corpus_pipeline
from logloom.llm import decontamination, simhash_dedup

SF = "/root/testdata/sf0.001"


def test_stages_take_effect_and_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, items = docs.columns, [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    index = decontamination.ItemIndex([(str(i), t) for i, t in items])
    for name, stage in corpus_pipeline.STAGES:
        before = {(r.doc_id, r.text) for r in docs.collect()}
        out = stage(spark, docs, SF)
        rows = out.collect()
        after = {(r.doc_id, r.text) for r in rows}
        assert after <= before and rows
        if name != "sharding":
            assert out.columns == columns
        if name == "near_dedup":
            prints = [simhash_dedup.text_fingerprint(t) for _, t in after]
            assert all(bin(a ^ b).count("1") > 4 for i, a in enumerate(prints) for b in prints[:i])
        if name == "decontamination":
            assert before - after == {(d, t) for d, t in before if index.matches(t)}
        if name == "mixing":
            assert len(rows) != len(before)
        if name == "sharding":
            assert out.columns == [*columns, "size", "text_crc32", "shard", "slot", "grown_shard"]
            for s in {r.shard for r in rows}:
                assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
        docs = out


def test_run_equals_its_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    whole = corpus_pipeline.run(spark, SF)
    assert whole.columns == docs.columns
    assert sorted((r.doc_id, r.shard, r.slot) for r in whole.collect()) == sorted((r.doc_id, r.shard, r.slot) for r in docs.collect())


def test_awkward_and_empty_tables(spark, tmp_path):
    rng = random.Random(9)
    words = [" ".join(rng.choice("abcdefgh") * rng.randint(1, 5) for _ in range(40)) for _ in range(12)]
    rows = [(i, w, None, "s", None, "x") for i, w in enumerate(words)] + [(None, None, None, None, None, "x"), (3, words[3], None, "s", None, "x"), (20, "", "en", None, 0, "x"), (21, "w " * 40_000, "en", "t", 1, "x")]
    kind = "doc_id long, text string, lang string, source string, n_chars long, shard string"
    spark.createDataFrame([(1, None), (2, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for docs in (spark.createDataFrame(rows, kind), spark.createDataFrame([], kind)):
        n = docs.count()
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, str(tmp_path))
        found = docs.collect()
        assert docs.columns.count("shard") == 1 and bool(found) == bool(n)
