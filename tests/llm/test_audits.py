"""Filter audit, weakly supervised rules and divergence audit beside brute force; odd rows."""

import re
from collections import Counter
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from logloom.llm import divergence, filter_audit, quality_rules
from logloom.llm.common import small_batches

SCHEMA = "doc_id long, text string, lang string, source string"
LABELS = "doc_id long, quality int, toxic int"
WORD = r"[^\x20\x09-\x0D]+"


@pytest.fixture(autouse=True)
def ready(spark):
    small_batches(spark)


def _texts():
    many = " ".join(f"w{i}" for i in range(250))
    few = "one two " * 150
    return [many, few, "SHOUT " + many, many + " $", "", None, "short & sweet", few + "|", many, "a\x0bb c", "x " * 40_000]


def _docs(spark, clash=""):
    texts = _texts()
    rows = [(i, t, ["en", "de", None, ""][i % 4], f"s{i % 3}" if i % 5 else None) for i, t in enumerate(texts)]
    rows += [(20, texts[0], "en", "s0"), (20, texts[0], "de", "s1"), (None, texts[0], "en", "s0"), (None, texts[0], "en", "s0"), (0, texts[1], "en", "s9"), (1, texts[0], "en", "s9")]
    docs = spark.createDataFrame(rows, SCHEMA)
    return docs.withColumn(clash, F.lit("kept")) if clash else docs


def _fails(text):
    w = re.findall(WORD, text)
    return ("A" * (len(w) < 200) + "B" * (100 * len(set(w)) < 50 * len(w)) + "C" * (100 * len(re.findall("[A-Z]", text)) > 3 * len(text)) + "D" * bool(re.search(r"[#$%&*|]", text)))


def _brute_audit(rows, labels):
    good, toxic = {d for d, q, _ in labels if q == 1}, {d for d, _, t in labels if t == 1}
    known = []
    for d, text, lang, _ in rows:
        text = text or ""
        copy = d is not None and any(o is not None and o < d and (t or "") == text for o, t, _, _ in rows)
        known.append((lang or "", _fails(text) + "E" * copy, d in good, d in toxic))
    out = set()
    for part in {k[0] for k in known}:
        mine, gone_at = [k for k in known if k[0] == part], Counter()
        table = {}
        for order in map("".join, permutations("ABCDE")):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [k for k in left if f in k[1]]
                left = [k for k in left if f not in k[1]]
                gone_at[f] += len(gone)
                table[order, step] = (len(left), len(gone), sum(f in k[1] for k in mine) - len(gone), sum(k[1] == f for k in mine), sum(k[2] for k in gone), sum(k[3] for k in gone))
        out |= {(part, o, s, *v, gone_at[o[s - 1]]) for (o, s), v in table.items()}
    return out


def test_filter_audit_is_the_audit_of_every_order(spark):
    docs = _docs(spark, "fails")
    labels = [(0, 1, 0), (1, 0, 1), (3, 1, 1), (3, 0, 0), (20, 1, 0), (None, 1, 1), (99, 1, 1), (8, None, 1)]
    got = filter_audit.audit(docs, spark.createDataFrame(labels, LABELS)).collect()
    want = _brute_audit([tuple(r)[:4] for r in docs.collect()], labels)
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_filter_audit_of_nothing(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert filter_audit.audit(none, spark.createDataFrame([], LABELS)).count() == 0
    one = filter_audit.audit(spark.createDataFrame([(1, "x", "en", "s")], SCHEMA), spark.createDataFrame([], LABELS)).where("filter_order = 'BACDE'").orderBy("step").collect()
    assert [(r.kept, r.removed, r.shapley) for r in one] == [(1, 0, 0), (0, 1, 120), (0, 0, 0), (0, 0, 0), (0, 0, 0)]


def _repeats(w):
    seen = Counter(zip(w, w[1:], w[2:]))
    return len({p for i, t in enumerate(zip(w, w[1:], w[2:])) if seen[t] > 1 for p in (i, i + 1, i + 2)})


def test_measures_are_brute_force(spark):
    texts = [t or "" for t in _texts()] + ["a b c a b c", "a b c d a b c", "ab c d a bc d", "x x x x", "same line\nsame line\n\n \n \nother!! <b>", "Ends. Here? no.\nyes. é!"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").withColumn("n_words", F.lit("own column"))
    got = {r.doc_id: r for r in quality_rules.measured(rows).collect()}
    for i, t in enumerate(texts):
        w, r = re.findall(WORD, t), got[i]
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), _repeats(w)), t[:40]
        assert (r.n_lines, r.n_dup_lines, r.n_caps, r.n_bangs) == (len(lines), len(lines) - len(set(lines)), len(re.findall("[A-Z]", t)), t.count("!")), t[:40]
        assert r.n_ends == len(re.findall(r"[.?](?:[\x20\x09-\x0D]|\Z)", t)) and r.n_letters == len(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]", t))


def _em(patterns):
    n_rules, q = len(quality_rules.RULES), quality_rules
    start = {(of, v): [q.RIGHT if (of == "good") == (v == 1) else q.WRONG] * n_rules for of in ("good", "bad") for v in (1, -1)}
    share, rates = 0.5, start

    def posterior(v):
        odds = share / (1 - share)
        for j, x in enumerate(v):
            if x:
                odds *= rates["good", x][j] / rates["bad", x][j]
        return odds / (1 + odds)
    for _ in range(q.ROUNDS):
        mass = {"good": {v: n * posterior(v) for v, n in patterns.items()}, "bad": {v: n * (1 - posterior(v)) for v, n in patterns.items()}}
        whole = {of: sum(m.values()) for of, m in mass.items()}
        rates = {(of, x): [max(q.LEAST, min(1 - q.LEAST, (sum(m for v, m in mass[of].items() if v[j] == x) + q.PRIOR * start[of, x][j]) / (whole[of] + q.PRIOR))) for j in range(n_rules)] for of, x in start}
        share = (whole["good"] + 1) / (whole["good"] + whole["bad"] + 2)
    return {v: posterior(v) for v in patterns}


def test_posteriors_are_those_of_a_plain_em(spark):
    draw = __import__("random").Random(5)

    def prose():
        return " ".join("The " + " ".join("".join(draw.choice("aeioubcdfgst") for _ in range(draw.randint(3, 8))) for _ in range(9)) + "." for _ in range(12))
    rows = [(i, prose()) for i in range(30)]
    rows += [(100 + i, " ".join(f"BUY{j}!! NOW!!" for j in range(i, i + 40))) for i in range(6)] + [(200 + i, "word*** " * 60 + str(i)) for i in range(4)] + [(300, None), (301, ""), (302, "tiny text")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("kept", F.lit(1)).withColumn("posterior", F.lit("clash"))
    measured = quality_rules.measured(docs).cache()
    got = quality_rules.judged(measured, quality_rules.learn(measured)).withColumn("v", quality_rules.votes()).collect()
    want = _em(Counter(tuple(r.v) for r in got if r.n_words))
    assert len(got) == len(rows)
    for r in got:
        if r.n_words:
            assert abs(r.posterior - want[tuple(r.v)]) < 1e-9
        assert r.kept == (not r.base_failed and round(r.posterior, 6) >= 0.5)
    kept = {r.doc_id for r in got if r.kept}
    assert kept == {r.doc_id for r in quality_rules.keep_good(docs).collect()} and kept == set(range(30))
    assert quality_rules.keep_good(docs).columns == docs.columns


def test_rules_of_an_empty_table(spark):
    none = quality_rules.measured(spark.createDataFrame([], "doc_id long, text string"))
    model = quality_rules.learn(none).first().model
    assert model.share == 0.5 and model.good_for == [quality_rules.RIGHT] * len(quality_rules.RULES)
    assert quality_rules.keep_good(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def _brute_divergence(rows, min_docs, top):
    texts = [(lang or "", source or "", re.findall("[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))) for _, text, lang, source in rows]
    out = set()
    for lang in {t[0] for t in texts}:
        mine = [t for t in texts if t[0] == lang]
        held = Counter(w for t in mine for w in set(t[2]))
        kept = sorted(w for w in held if held[w] >= min_docs)

        def shares(words):
            n = Counter(w for w in words if w in set(kept))
            return n, {w: 1 + 10**9 * (n[w] + 2) // (sum(n.values()) + 2 * len(kept)) for w in kept}
        groups = {s: shares([w for t in mine if t[1] == s for w in t[2]]) for s in {t[1] for t in mine}}
        whole = shares([w for t in mine for w in t[2]])[1]

        def f(p, q):
            return (p - q) ** 2 // (p + q)
        for s, (n, p) in groups.items():
            pairs = [(-sum(f(p[w], q[w]) for w in kept), o) for o, (_, q) in groups.items() if o != s]
            terms = [(-f(p[w], whole[w]), w) for w in kept if n[w] and p[w] > whole[w]]
            for part, found in (("pair", pairs), ("term", terms)):
                ordered = sorted(found, key=lambda x: (x[0], x[1].encode()))
                out |= {(lang, s, part, item, -v, r) for r, (v, item) in enumerate(ordered, 1) if part == "pair" or r <= top}
    return out


def test_divergence_is_brute_force(spark):
    import random

    draw = random.Random(3)
    words = "the und Mit ÉCOLE école été x1y _a_ straße \U0001f600 ΣΑΣ don't".split() + [f"t{chr(97 + i)}" for i in range(26)] * 4
    rows = [(i, " ".join(draw.choice(words) for _ in range(draw.randint(0, 30))), draw.choice(["en", "de", None]), draw.choice(["a", "b", "é", None, "c"])) for i in range(150)]
    rows += [(500, "rare", "fr", "z"), (501, None, "fr", "y"), (502, "", "xx", "only"), (7, rows[7][1], "en", "a"), (None, "the the the", "en", "a"), (None, "the", "en", "long"), (503, "the " * 50_000 + "Mit", "en", "long")]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("term", F.lit(1)).withColumn("value", F.lit(2)).repartition(5)
    got = [tuple(r) for r in divergence.audit(docs, 4, 3).collect()]
    want = _brute_divergence(rows, 4, 3)
    assert set(got) == want and len(got) == len(want)
    assert divergence.audit(spark.createDataFrame([], SCHEMA)).count() == 0


def test_tallies_flushed_midway_give_the_same(spark, monkeypatch):
    rows = [(i, "aa bb cc " + "abcdefghij"[i % 10] * 3, "en", f"s{i % 2}") for i in range(60)]
    batches = [b for b in __import__("pyarrow").Table.from_pylist([{"lang": x[2], "source": x[3], "text": x[1]} for x in rows]).to_batches(7)]

    def summed():
        out = Counter()
        for b in divergence._tallies(iter(batches)):
            for r in b.to_pylist():
                out[r["source"], r["term"], "n"] += r["n"]
                out[r["source"], r["term"], "docs"] += r["docs"]
        return out
    whole = summed()
    monkeypatch.setattr(divergence, "FLUSH", 3)
    assert summed() == whole


def test_shares_are_exact_beyond_64_bits(spark):
    n, total, terms = 9 * 10**15 + 7, 10**18 - 3, 10**9
    row = spark.range(1).select(divergence.share(F.lit(n), F.lit(total), F.lit(terms)).alias("p"))
    assert row.first().p == 1 + 10**9 * (n + 2) // (total + 2 * terms)
