import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from logloom.functions import pricing
from logloom.operators import packing, ranges
from logloom.operators.ordered import scan, upper_median
from logloom.plans import limits
from logloom.schemas import Corpus


def rows(n=400, seed=3):
    rnd = random.Random(seed)
    # one hot group holds most rows
    return [(("hot" if rnd.random() < 0.7 else f"g{rnd.randrange(5)}"), i, rnd.choice([None, "a", "a", "b"]), rnd.randrange(4)) for i in range(n)]


def expected(data):
    out = {}
    for g in {r[0] for r in data}:
        prev, held, total, island, top, last = None, None, 0, 0, None, object()
        for _, i, k, v in sorted([r for r in data if r[0] == g], key=lambda r: r[1]):
            before = held
            held = k if k is not None else held
            total += v
            island += 1 if k != last or island == 0 else 0
            last = k
            out[i] = (prev, held, before, total, top, island)
            prev, top = k, v if top is None else max(top, v)
    return out


@pytest.mark.parametrize("chunk,parts", [(1, 3), (7, 5), (1000, 2)])
def test_scan_does_not_depend_on_chunks_or_partitions(spark, chunk, parts):
    data = rows()
    df = spark.createDataFrame(data, "g string, i bigint, k string, v bigint").repartition(parts)
    got = scan(df, ["g"], ["i"], F.floor(F.col("i") / chunk).cast("bigint"), lag={"prev": F.col("k")}, carry={"held": F.col("k")}, carry_before={"before": F.col("k")},
               running={"total": F.col("v")}, running_max={"top": F.col("v")}, island={"run": ["k"]}).collect()
    assert {r.i: (r.prev, r.held, r.before, r.total, r.top, r.run) for r in got} == expected(data)


def test_descending_scan_looks_ahead(spark):
    data = rows(120, 9)
    df = spark.createDataFrame(data, "g string, i bigint, k string, v bigint")
    got = scan(df, ["g"], ["i"], F.floor(F.col("i") / 11).cast("bigint"), descending=True, carry_before={"nxt": F.col("k")}).collect()
    for r in got:
        later = [x[2] for x in sorted(data, key=lambda x: x[1]) if x[0] == r.g and x[1] > r.i and x[2] is not None]
        assert r.nxt == (later[0] if later else None)


def test_upper_median(spark):
    data = [("a", v) for v in (5, 4, 5, 6)] + [("b", 9)]
    got = upper_median(spark.createDataFrame(data, "g string, v bigint"), ["g"], "v", "m").collect()
    assert {r.g: r.m for r in got} == {"a": 5, "b": 9}


def test_interval_cover_is_exact(spark):
    rnd = random.Random(1)
    spans = [(lo, lo + rnd.choice([0, 1, 63, 64, 5000, 300000])) for lo in (rnd.randrange(10**6) for _ in range(40))]
    points = sorted({p for lo, hi in spans for p in (lo - 1, lo, hi, hi + 1) if p >= 0})
    s = spark.createDataFrame([(i, lo, hi) for i, (lo, hi) in enumerate(spans)], "i int, lo bigint, hi bigint").select("i", F.explode(ranges.cover(F.col("lo"), F.col("hi"))).alias("b"))
    p = spark.createDataFrame([(x,) for x in points], "x bigint").select("x", F.explode(ranges.probe(F.col("x"))).alias("b"))
    got = s.join(p, "b").select("i", "x").collect()
    assert sorted((r.i, r.x) for r in got) == sorted((i, x) for i, (lo, hi) in enumerate(spans) for x in points if lo <= x <= hi)


def test_packing_equals_first_fit_over_the_whole_parent(spark):
    rnd = random.Random(5)
    lanes = [("p", f"l{i:03d}", s, s + rnd.randrange(1, 9) * 600_000) for i, s in enumerate(rnd.randrange(0, 400) * 600_000 for _ in range(150))]
    ends, want = [], {}
    for _, lane, s, e in sorted(lanes, key=lambda r: (r[2], r[1])):
        row = next((i for i, x in enumerate(ends) if x <= s), len(ends))
        ends[row:row + 1] = [e]
        want[lane] = row
    df = spark.createDataFrame(lanes, "parent string, lane string, start_ms bigint, end_ms bigint")
    assert {r.lane: r.row for r in packing.pack(df).collect()} == want
    assert packing.concurrency_peak(df).first().peak == max(sum(1 for l in lanes if l[2] <= t < l[3]) for t in {l[2] for l in lanes})


def test_packing_passes_one_endless_cluster_in_batches(spark):
    n = 120_000  # each lane overlaps the next, so all are one cluster; three run at once
    df = spark.range(n).select(F.lit("p").alias("parent"), F.format_string("l%07d", "id").alias("lane"), (F.col("id") * 1000).alias("start_ms"), (F.col("id") * 1000 + 2500).alias("end_ms"))
    rows = packing.pack(df)
    assert "FlatMapGroups" not in rows._jdf.queryExecution().toString()
    assert rows.filter(F.substring("lane", 2, 7).cast("int") % 3 != F.col("row")).count() == 0
    assert rows.agg(F.count("*"), F.count_distinct("cluster")).first() == (n, 1)


def test_window_usage_cuts_hours_where_spans_begin_and_end(spark):
    rnd = random.Random(11)
    t0 = dt.datetime(2024, 1, 5)
    at = lambda: t0 + dt.timedelta(minutes=rnd.randrange(0, 3000), microseconds=rnd.choice([0, 1, 999_999]))
    # many requests of one hour, and instants that fall on a span's ends
    spans = [("k%d" % i, s, a, a + dt.timedelta(minutes=rnd.choice([0, 1, 30, 60, 300, 1440])), scope)
             for i, a in enumerate(at() for _ in range(6)) for s, scope in (("window", None), ("mod", "beta"))]
    ends = [x for s in spans for x in s[2:4]]
    reqs = [(rnd.choice(ends + [at(), t0 + dt.timedelta(seconds=rnd.randrange(3600)), None]), rnd.choice(["Alpha-1", "Beta-2", None]), *[rnd.randrange(50) for _ in range(5)]) for _ in range(900)]
    names = ["input_tokens", "cache_write_tokens", "cache_write_1h_tokens", "cache_read_tokens", "output_tokens"]
    table = lambda rows: spark.createDataFrame(rows, "ts timestamp, model string, " + ", ".join(f"{n} bigint" for n in names))
    main, sub = reqs[:600], reqs[600:]
    rates = pricing.rate_table(spark, [(m, "2020-01-01", 1e4, 1e4, 1e4, 1e4, 1e4) for m in ("Alpha", "Beta")])
    c = Corpus(requests=table(main), spawn_requests=table(sub), rates=rates)
    got = {(r.kind, r.span): r for r in limits._usage_in(c, spark.createDataFrame(spans, "kind string, span string, from_ts timestamp, until_ts timestamp, scope string")).collect()}

    for kind, span, a, z, scope in spans:
        inside = lambda rows: [r for r in rows if r[0] and a <= r[0] < z and (scope is None or (r[1] and scope in r[1].lower()))]
        usd = lambda rows: 0.0 if any(r[1] is None for r in rows) else sum(r[2] + r[3] + r[5] + r[6] for r in rows) / 100
        m, s = inside(main), inside(sub)
        if not m + s:
            assert (kind, span) not in got
            continue
        r = got[kind, span]
        assert (r.requests, r.main_requests, r.output, r.cache_read) == (len(m + s), len(m), sum(x[6] for x in m + s), sum(x[5] for x in m + s))
        assert abs(r.main_usd - usd(m)) <= 0.0051 and abs(r.list_usd - usd(m) - usd(s)) <= 0.011
    assert {k[1] for k in got} == {"window", "mod"}
