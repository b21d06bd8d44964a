"""SimHash dedup, decontamination, toxicity, quality and LM scoring against brute force."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from logloom.llm import decontamination, lm_scoring, quality, simhash_dedup, toxicity
from logloom.llm.common import id_remainder
from logloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
WIDE = "doc_id long, text string, fp string, component_id string, label string, m string, part string"


def docs(spark, rows):
    return spark.createDataFrame([(d, t, "a", "b", "c", "d", "e") for d, t in rows], WIDE)


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))


def brute_components(prints):
    """{index: smallest index reachable} over fingerprints at most four bits apart."""
    prints = np.array(prints, np.uint64)
    near = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 4
    root = list(range(len(prints)))
    changed = True
    while changed:
        changed = False
        for i in range(len(prints)):
            low = min(root[j] for j in np.flatnonzero(near[i]))
            changed |= low < root[i]
            root[i] = low
    return root


def test_fingerprint_is_the_majority_of_shingle_hashes():
    text = "The quick  brown\tfox jumps over THE lazy dog É"
    words = "the quick brown fox jumps over the lazy dog É".split()
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i:i + 4]).encode(), 42) for i in range(len(words) - 3)]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    assert simhash_dedup.text_fingerprint(text) == want
    assert simhash_dedup.text_fingerprint("two Words") == xxhash.xxh64_intdigest(b"two words", 42)
    assert simhash_dedup.text_fingerprint(None) == simhash_dedup.text_fingerprint(" \n") == 0
    assert simhash_dedup.text_fingerprint("a " * 200_000) == simhash_dedup.text_fingerprint("a " * 10)


@pytest.mark.parametrize("hot", [2_000, 3])
def test_components_equal_brute_force(spark, hot, monkeypatch):
    """The second run takes every shared segment value for a crowded one."""
    monkeypatch.setattr(simhash_dedup, "links", lambda nodes, f=simhash_dedup.links: f(nodes, hot))
    rng = random.Random(3)
    prints = []
    for _ in range(12):
        centre = rng.getrandbits(64)
        for _ in range(rng.randint(1, 14)):
            prints.append(centre)
            for b in rng.sample(range(64), rng.randint(0, 3)):
                centre ^= 1 << b
    prints += [prints[0]] * 3 + [0, 0]
    signed = np.array(prints, np.uint64).view(np.int64).tolist()
    frame = spark.createDataFrame([(i, f) for i, f in enumerate(signed)], "doc_id long, fp long")
    got = {r.doc_id: r.component_id for r in simhash_dedup.grouped(frame).collect()}
    assert got == dict(enumerate(brute_components(prints)))


def test_a_long_chain_is_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(500, 501)], "a long, b long")
    got = {r.node: r.root for r in simhash_dedup.components(edges).collect()}
    assert got == {i: 0 for i in range(301)} | {500: 500, 501: 500}


def test_one_document_of_each_group_stays(spark):
    rng = random.Random(1)
    text, other = prose(rng, 60), prose(rng, 60)
    rows = [(5, text), (3, text), (3, text), (9, other), (None, other), (11, None), (12, ""), (13, prose(rng, 30_000))]
    kept = simhash_dedup.keep_one(docs(spark, rows))
    assert sorted((r.doc_id, r.fp) for r in kept.collect()) == [(3, "a"), (9, "a"), (11, "a"), (13, "a")]
    assert simhash_dedup.keep_one(docs(spark, [])).count() == 0


def test_unrelated_documents_without_an_id_or_with_one_id_all_stay(spark):
    rng = random.Random(2)
    a, b, c, d, e, f = (prose(rng, 60) for _ in range(6))
    rows = [(None, a), (None, a), (None, b), (None, c), (None, ""), (None, None), (1, d), (1, e), (2, e), (None, e), (1, f), (1, f)]
    kept = [(r.doc_id, r.text or "") for r in simhash_dedup.keep_one(docs(spark, rows)).collect()]
    assert sorted(kept, key=str) == sorted([(None, a), (None, b), (None, c), (None, ""), (1, d), (1, e), (1, f)], key=str)


def test_near_dedup_of_the_given_table(spark):
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    ids = sorted(rows)
    prints = [simhash_dedup.text_fingerprint(rows[d]) for d in ids]
    want = {d: (f"{p:016x}", ids[r]) for d, p, r in zip(ids, prints, brute_components(prints))}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op2_simhash_dedup"](spark, SF).collect()} == want


def brute_leaks(rows, items):
    found = set()
    for doc_id, text in rows:
        tokens = decontamination.words(text)
        for item_id, item in items:
            own = decontamination.words(item)
            if not own or not tokens:
                continue
            k, size = min(5, len(own)), min(len(own), len(tokens))
            if any(decontamination.similarity(tokens[i:i + size], own, k) >= 0.8 for i in range(len(tokens) - size + 1)):
                found.add((doc_id, item_id))
    return found


def test_leaks_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", 2_000)
    rng = random.Random(5)
    items = [(i, prose(rng, rng.choice([1, 3, 5, 6, 20, 45, 46, 80]))) for i in range(30)] + [(30, None), (31, ""), (32, "a b " * 20), (32, "a b " * 20)]
    rows = [(i, prose(rng, 120)) for i in range(20)] + [(None, None), (50, "")]
    for i, (_, item) in enumerate(items[:30]):
        tokens = item.split()
        spoiled = list(tokens)
        spoiled[len(tokens) // 2] = "changed"
        for kind, passage in enumerate((tokens, spoiled, tokens[1:], tokens[:-3])):
            rows.append((1000 + 10 * i + kind, f"{prose(rng, rng.randint(0, 40))} {' '.join(passage).upper()}, {prose(rng, 30)}"))
    rows += [(2000, "a b " * 60), (2001, items[6][1] if items[6][1] else "x"), (2001, items[6][1]), (2002, prose(rng, 30_000) + " " + max((t for _, t in items[:30]), key=len))]
    benchmark = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, similarity string")
    got = decontamination.matches(docs(spark, rows), benchmark).collect()
    want = brute_leaks(rows, items)
    assert {(r.doc_id, r.item_id) for r in got} == want and len(want) > 40
    leaked = {d for d, _ in want}
    kept = decontamination.clean(docs(spark, rows), benchmark).collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0) for r in kept) == sorted((d is not None, d or 0) for d, _ in rows if d not in leaked)


def test_leaks_of_nothing(spark):
    nothing = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.matches(docs(spark, [(1, "a b c d e f")]), nothing).count() == 0
    assert decontamination.clean(docs(spark, [(1, "a b c d e f")]), nothing).count() == 1
    assert decontamination.matches(docs(spark, []), spark.createDataFrame([(1, "a b c")], "item_id long, text string")).count() == 0


def test_kernel_tolerates_gaps_and_other_signs():
    marks = toxicity.Landmarks(["idiot"])
    same, dashed, gapped, far = marks.values(["idiot", "i-d-i.o_t", "idxiot", "table"])[:, 0]
    assert same == pytest.approx(1) and dashed == pytest.approx(1) and 0.3 < gapped < 0.9 and far < 0.1
    spelled = toxicity.Sentences(marks).of("you i d i o t there. fine words")
    assert spelled.shape == (2, 1) and spelled[0, 0] == pytest.approx(1) and spelled[1, 0] < 0.2


def labelled(spark, rng, n):
    bad = ["blockhead", "numbskull", "dimwit"]
    rows, labels = [], []
    for i in range(n):
        words = prose(rng, rng.randint(8, 60)).split()
        toxic = i % 3 == 0
        if toxic:
            words.insert(rng.randrange(len(words)), rng.choice(bad))
        rows.append((i, " ".join(words) + "."))
        labels.append((i, 1, int(toxic)))
    rows += [(n, None), (n + 1, ""), (None, "no id here"), (0, rows[0][1]), (n + 2, "x" * 100_000), (n + 3, "word " * 50_000)]
    labels += [(0, 1, 1), (None, 1, 1), (n, None, None)]
    return docs(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), rows


def test_toxicity_learns_insults(spark):
    frame, labels, rows = labelled(spark, random.Random(2), 400)
    model = toxicity.fit(frame, labels, id_remainder(3) != 1)
    assert {"blockhead", "numbskull", "dimwit"} <= set(model.landmarks)
    scored = frame.select("doc_id", toxicity.toxicity(model).alias("s")).collect()
    assert len(scored) == len(rows) and all(0 <= r.s <= 1 for r in scored)
    right = [(r.s >= 0.7) == (r.doc_id % 3 == 0) for r in scored if r.doc_id is not None and r.doc_id < 400]
    assert sum(right) >= 0.97 * len(right)
    assert {r.doc_id for r in scored if r.s >= 0.7} & {400, 401, 402, 403, None} == set()
    kept = toxicity.keep_clean(frame, labels, id_remainder(3) != 1)
    assert kept.columns == frame.columns and kept.count() == sum(r.s < 0.7 for r in scored)


def test_toxicity_without_labels_or_rows(spark):
    frame, labels, _ = labelled(spark, random.Random(2), 30)
    assert toxicity.fit(frame, labels.where("toxic = 0"), F.lit(True)) is None
    assert toxicity.keep_clean(frame, labels.limit(0), F.lit(True)).count() == frame.count()
    assert toxicity.keep_clean(frame.limit(0), labels, F.lit(True)).count() == 0


def test_quality_tells_repetition_from_prose(spark):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(300):
        good = i % 4 != 0
        rows.append((i, prose(rng, 60) if good else " ".join(w + " " + w + " ###" for w in prose(rng, 20).split())))
        labels.append((i, int(good), 0))
    rows += [(300, None), (301, ""), (None, "no id"), (302, "long " * 60_000), (5, rows[5][1])]
    frame, told = docs(spark, rows), spark.createDataFrame([*labels, (None, 1, 0), (1, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit(frame, told, id_remainder(4) != 2)
    scored = frame.select("doc_id", quality.quality(model).alias("s")).collect()
    assert len(scored) == len(rows) and all(0 <= r.s <= 1 for r in scored)
    held = [(r.s >= 0.7) == (r.doc_id % 4 != 0) for r in scored if r.doc_id is not None and r.doc_id < 300 and zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert len(held) > 40 and sum(held) >= 0.95 * len(held)
    assert quality.fit(frame, told.where("quality = 1"), F.lit(True)) is None
    assert frame.limit(0).select(quality.quality(model).alias("s")).count() == 0


def test_word_vectors_do_not_depend_on_partitions(spark):
    rng = random.Random(8)
    frame = docs(spark, [(i, prose(rng, 50)) for i in range(60)] + [(60, None)])
    assert np.array_equal(quality.word_vectors(frame.repartition(1)), quality.word_vectors(frame.repartition(7)))


def test_lm_scores_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(lm_scoring, "CHUNK_TOKENS", 400)
    monkeypatch.setattr(lm_scoring, "RANGE_TOKENS", 1500)
    seen = {}
    monkeypatch.setattr(lm_scoring, "learned_weights", lambda bins, v, f=lm_scoring.learned_weights: seen.setdefault("w", f(bins, v)))
    rng = random.Random(6)
    pool = prose(rng, 80).split()
    rows = [(i, " ".join(rng.choice(pool) for _ in range(rng.randint(0, 60)))) for i in range(150)] + [(200, None), (201, "One TWO one two"), (3, "again"), (None, "no id"), (202, "long word " * 3000)]
    got = lm_scoring.score(docs(spark, rows).repartition(3)).collect()
    assert len(got) == len(rows)

    def tokens(text):
        return (text or "").encode().lower().split() + [b"\n"]

    def held(d):
        return zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2

    one, two, starts = Counter(), Counter(), 0
    for d, t in rows:
        if not held(d):
            one.update(tokens(t))
            two.update(zip([b""] + tokens(t)[:-1], tokens(t)))
            starts += 1
    n, v, weights = sum(one.values()), len(one), seen["w"]
    want = []
    for d, t in rows:
        base = score = 0.0
        for u, w in zip([b""] + tokens(t)[:-1], tokens(t)):
            c = starts if u == b"" else one[u]
            w2, w1, w0 = weights.get(math.frexp(c)[1], weights[-1])
            score += math.log10(w2 * (two[u, w] / c if c else 0) + w1 * one[w] / n + w0 / (v + 1))
            base += math.log10((one[w] + 1) / (n + v + 1))
        want.append((d is None, d or 0, held(d), len(tokens(t)), sum(one[w] > 0 for w in tokens(t)), n, round(base, 4), round(score, 4)))
    assert sorted((r.doc_id is None, r.doc_id or 0, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4), round(r.score, 4)) for r in got) == sorted(want)


def test_lm_weights_sum_to_one_and_prefer_pairs_that_hold():
    weights = lm_scoring.learned_weights([(5, -30, 0, 100), (1, -30, lm_scoring.MISSING, 100)], 1000)
    assert all(abs(w.sum() - 1) < 1e-9 and (w > 0).all() for w in weights.values())
    assert weights[5][0] > 0.9 > 0.1 > weights[1][0]
    assert lm_scoring.learned_weights([], 0)[-1].tolist() == pytest.approx([1 / 3] * 3)


def test_lm_scores_without_training_documents_or_rows(spark):
    out = [d for d in range(200) if zlib.crc32(str(d).encode()) % 7 == 2][:3]
    got = lm_scoring.score(docs(spark, [(d, "some text") for d in out])).collect()
    assert all(r.held_out and r.train_tokens == 0 and r.n_known == 0 and r.base_score == 0 for r in got) and len(got) == 3
    assert lm_scoring.score(docs(spark, [])).count() == 0
