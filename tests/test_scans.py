"""Scans, order statistics and interval joins where one key or one interval is very large."""

import math
import random
from collections import Counter

from pyspark.sql import functions as F

from strandloom.operators import quantiles, scans
from strandloom.operators import relational as rel
from strandloom.plans import joins


def rows(spark, n=6000):
    """One key with nearly all rows, many ties; a null key; a key of one row."""
    g = random.Random(2)
    out = [("hot" if i % 50 else None, g.randrange(n // 20), i, g.choice([None, 1, 2, 7])) for i in range(n)] + [("one", 5, -1, 3)]
    return out, spark.createDataFrame(out, "k string, at long, id long, v long").repartition(7)


def by_key(table):
    out = {}
    for r in sorted(table, key=lambda r: (r[0] or "", r[1], r[2])):
        out.setdefault(r[0], []).append(r)
    return out


def test_one_key_is_dealt_to_all_ranges(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else so few rows are one range
    table, df = rows(spark)
    layouts = []

    def keep(x):
        out = scans.written(x)
        if scans.RANGE in out.columns:
            layouts.append(Counter(r[0] for r in out.select(scans.RANGE).collect()))
        return out

    placed = scans.ranked(df, ["k"], ["at", "id"], "place", keep)
    want = {r[2]: i for own in by_key(table).values() for i, r in enumerate(own)}
    assert {r.id: r.place for r in placed.collect()} == want and placed.columns == ["k", "at", "id", "v", "place"]
    sizes = layouts[0].values()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) >= 4 and max(sizes) <= 2 * sum(sizes) / len(sizes)
    total = scans.running_sum(df, ["k"], ["at", "id"], F.coalesce("v", F.lit(0)), "total", keep)
    run = {}
    for own in by_key(table).values():
        s = 0
        for r in own:
            s += r[3] or 0
            run[r[2]] = s
    assert {r.id: r.total for r in total.collect()} == run


def test_gap_groups_of_one_key(spark):
    table, df = rows(spark)
    table = [(k, at * at % 9973, i, v) for k, at, i, v in table]
    df = df.withColumn("at", F.col("at") * F.col("at") % 9973)
    want = {}
    for own in by_key(table).values():
        no, last = 0, None
        for r in own:
            no += last is None or r[1] - last > 40
            last = r[1]
            want[r[2]] = no
    assert {r.id: r.group_no for r in scans.gap_groups(df, ["k"], F.col("at"), 40, ["id"]).collect()} == want


def test_asof_downsample_and_even_spacing_of_one_key(spark):
    g = random.Random(3)
    spans = [("c", s := g.randrange(4000), s + g.randrange(60), i) for i in range(900)]
    points = [("c", g.randrange(4200), i) for i in range(900)] + [("d", 5, 1000)]
    got = rel.asof_containment(spark.createDataFrame(points, "k string, t long, i long"), "t", spark.createDataFrame(spans, "k string, s long, e long, id long"), ["k"], "s", "e", "id")
    want = {}
    for k, t, i in points:
        before = [(s, x, e) for kk, s, e, x in spans if kk == k and s <= t]
        want[i] = max(before)[1] if before and max(before)[2] >= t else None
    assert {r.i: r.span_id for r in got.collect()} == want
    _, df = rows(spark, 2000)
    kept = rel.downsample(df.filter("k = 'hot'"), ["k"], "id", F.lit(70)).collect()
    import hashlib

    order = sorted({r.id for r in df.filter("k = 'hot'").collect()}, key=lambda i: (hashlib.md5(f"{i}0".encode()).hexdigest(), i))
    assert {r.id for r in kept} == set(order[:70])
    even = rel.evenly_spaced(spark.range(1001).withColumn("k", F.lit(1)), ["k"], ["id"], 10)
    assert sorted(r.id for r in even.collect()) == [k * 1001 // 10 for k in range(10)]


def test_order_statistics_are_exact(spark):
    g = random.Random(4)
    odd = [0.0, -0.0, 1e-300, -1e300, 5e-324, float("inf"), float("-inf"), 1.5, 1.5, 2.0**60, -7.25]
    values = [("a", x) for x in odd] + [("b", g.gauss(0, 1e6)) for _ in range(501)] + [("b", None), ("c", 4.0), (None, 3.0), (None, 1.0), ("none", None)]
    df = spark.createDataFrame(values, "k string, x double").repartition(3)
    got = {r.k: r for r in quantiles.quantiles(df, ["k"], "x", low=0.0, quarter=0.25, median=0.5, high=1.0).collect()}
    assert set(got) == {"a", "b", "c", None}
    for k, r in got.items():
        own = sorted(x + 0.0 for kk, x in values if kk == k and x is not None)
        assert r.n == len(own) and r.low == own[0] and r.high == own[-1]
        for name, f in (("quarter", 0.25), ("median", 0.5)):
            at = f * (len(own) - 1)
            a, b = own[math.floor(at)], own[math.ceil(at)]
            assert r[name] == a + (b - a) * (at - math.floor(at))
    upper = {r.k: r.m for r in quantiles.upper_median(df, ["k"], "x", "m").collect()}
    assert upper["b"] == sorted(x for k, x in values if k == "b" and x is not None)[250] and upper[None] == 3.0


def test_a_group_needs_a_histogram_only(spark):
    """A million values of one group: no stage hands one task more rows than a histogram has."""
    df = spark.range(1_000_000, numPartitions=4).select(F.lit(1).alias("k"), ((F.col("id") * 7919 + 13) % 1_000_003).cast("double").alias("x"))
    plan = quantiles.upper_median(df, ["k"], "x", "m")
    assert plan.collect()[0].m == sorted((i * 7919 + 13) % 1_000_003 for i in range(1_000_000))[500_000]
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in text and "percentile" not in text


def test_long_intervals_give_few_rows(spark):
    """An interval of 10^8 among short ones gives two rows a level at most, and pairs come once."""
    g = random.Random(5)
    short = [(i, "c", s := g.randrange(-5000, 100_000_000), s + g.choice([0, 3, 90, 4000])) for i in range(3000)]
    long = [(5000, "c", 17, 100_000_017), (5001, "c", -3, 100_000), (5002, "c", 90, 20), (5003, "d", 0, 1 << 40)]
    left = spark.createDataFrame(short + long, "i long, chrom string, s long, e long")
    right = spark.createDataFrame([(i, c, s + 7, e + 7) for i, c, s, e in short[:200] + long], "j long, chrom string, p long, q long")
    got = rel.interval_join(left, right, ["chrom"], ("s", "e"), ("p", "q"))
    a, b = [r for r in short + long if r[2] <= r[3]], [(i, c, s + 7, e + 7) for i, c, s, e in short[:200] + long if s <= e]
    assert sorted((r.i, r.j) for r in got.collect()) == sorted((x[0], y[0]) for x in a for y in b if x[1] == y[1] and x[2] <= y[3] and y[2] <= x[3])
    level = spark.createDataFrame([(0, 0), (0, 127), (0, 128), (5, 100_000_000)], "a long, b long").select(rel.interval_level(F.col("a"), F.col("b"))).collect()
    assert [r[0] for r in level] == [7, 7, 10, 28]


def test_near_texts_equal_brute_force(spark):
    g = random.Random(6)
    texts = ["".join(g.choice("AB") for _ in range(g.choice([0, 1, 3, 9, 12]))) for _ in range(150)] + [None]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, s string")
    nodes = {}
    for i, s in enumerate(texts):
        if s is not None:
            nodes.setdefault(s, []).append(i)
    want = {(min(x), min(y), d, len(nodes[a]), len(nodes[b])) for a, x in nodes.items() for b, y in nodes.items() if len(a) == len(b) and min(x) < min(y) and (d := sum(p != q for p, q in zip(a, b))) <= 2}
    got = rel.within_mismatches(rel.distinct_texts(df, "id", "s"), 2).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_rows_of_near_texts_are_all_paired(spark, monkeypatch):
    """Copies included, in many blocks, with ids that clash and null texts."""
    monkeypatch.setattr(rel, "COPIES", 3)
    g = random.Random(7)
    rows = [(g.randrange(90), g.choice([None, "", "A", "ABABABAB", "ABABABBB", "BBBBBBBB", "ABABBBBA", "AB" * 6])) for _ in range(120)]
    want = sorted((i, j, d) for i, s in rows for j, t in rows if None not in (s, t) and len(s) == len(t) and i < j and (d := sum(p != q for p, q in zip(s, t))) <= 2)
    got = rel.rows_within_mismatches(spark.createDataFrame(rows, "id long, s string"), "id", "s", 2)
    assert sorted(map(tuple, got.collect())) == want


def test_near_duplicates_pair_all_parts(spark):
    parts = spark.read.parquet("/root/testdata/sf0.001/part.parquet").select("p_partkey", "p_name").collect()
    names = dict(parts)
    assert len(names) == len(parts)
    got = {(r.a, r.b) for r in joins.near_duplicates(spark, "/root/testdata/sf0.001").select("a", "b").collect()}
    assert {(a, b) for a in names for b in names if a < b and names[a] == names[b]} <= got


def test_overlaps_are_counted_without_pairs(spark):
    """Totals equal brute force, with negative places, ties, empty intervals, null keys and copies of an id; no pairs are made."""
    g = random.Random(11)
    span = lambda: (s := g.randrange(-300, 60_000), s + g.choice([-1, 0, 3, 90, 20_000]))
    a = [(i % 700, g.choice(["c", "d", "e", None]), *span()) for i in range(900)] + [(999, "f", 0, 100_000)]
    b = [(g.choice(["c", "d", None]), *span()) for _ in range(600)] + [("g", 5, 9)]
    left, right = spark.createDataFrame(a, "i long, chrom string, s long, e long"), spark.createDataFrame(b, "chrom string, p long, q long")
    met = {}
    for i, c, s, e in a:
        met.setdefault(i, []).extend((p, q) for k, p, q in b if c is not None and c == k and p <= q and s <= e and s <= q and p <= e)
    want = sorted((i, len(x), min(p for p, _ in x), max(q for _, q in x)) for i, x in met.items() if x)
    for bits in (4, 14):
        assert sorted(map(tuple, rel.overlap_totals(left, right, ["chrom"], ("s", "e"), ("p", "q"), "i", bits).collect())) == want
    query = joins.interval_levels(spark, "/root/testdata/sf0.001")
    assert "Join" not in query._jdf.queryExecution().executedPlan().toString()
