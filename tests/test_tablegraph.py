"""Chains, tips, cycles and walks of k-mer graphs in tables, against plain Python."""

import math
import random
from collections import defaultdict

from pyspark.sql import functions as F

from strandloom.functions import kmers
from strandloom.operators import tablegraph as tg
from strandloom.operators.scans import written

K = 5
RC = str.maketrans("ACGT", "TGCA")


def rc(s):
    return s[::-1].translate(RC)


def number(s):
    return int("".join(str("ACGT".index(c)) for c in s), 4)


def edges_of(text, k):
    out = set()
    for i in range(len(text) - k):
        w = text[i : i + k + 1]
        for x in (w, rc(w)):
            out.add((x[:k], x[1:]))
    return out


def plain_unitigs(edges):
    """Canonical sequences of the maximal paths without branches, and whether each is a ring."""
    out, into = defaultdict(set), defaultdict(set)
    for u, v in edges:
        out[u].add(v)
        into[v].add(u)
    states = {x for e in edges for x in e}
    link = {u: next(iter(vs)) for u, vs in out.items() if len(vs) == 1 and len(into[next(iter(vs))]) == 1 and next(iter(vs)) not in (u, rc(u))}
    heads, found, seen = states - set(link.values()), set(), set()
    for h in heads:
        path = [h]
        while path[-1] in link:
            path.append(link[path[-1]])
        seen.update(path)
        s = path[0] + "".join(x[-1] for x in path[1:])
        found.add((min(s, rc(s)), False, len(path)))
    rings = set()
    for s in states - seen:
        ring, at = [s], link[s]
        while at != s:
            ring.append(at)
            at = link[at]
        rings.add((frozenset(frozenset((x, rc(x))) for x in ring), len(ring)))
    return found, rings


def texts():
    g = random.Random(9)
    base = "".join(g.choice("ACGT") for _ in range(60))
    out = [base, base[:30] + "T" + base[31:] + base[10:22], "ACACACACACAC", "AAAAAAAA", "ACGT", "", "ACGTACGTTACGTACGT", "ATTCGATTCGATTCG", base[:40] + rc(base[5:40])]
    return out + ["".join(g.choice("ACGT") for _ in range(g.randint(6, 90))) for _ in range(25)] + ["".join(g.choice("AC") for _ in range(40)) for _ in range(5)]


def graph(spark, rows):
    df = spark.createDataFrame(list(enumerate(rows)), "id long, s string").repartition(3)
    return written(tg.oriented_edges(kmers.canonical_words(df, "id", "s", K + 1), "id", K))


def test_edges_and_unitigs_equal_plain_python(spark):
    rows = texts()
    e = graph(spark, rows)
    got = {(r.id, r.u, r.v) for r in e.collect()}
    assert got == {(i, number(u), number(v)) for i, t in enumerate(rows) for u, v in edges_of(t, K)} and e.count() == len(got)
    units, rounds = tg.unitigs(e, "id", K)
    by = defaultdict(set)
    for r in units.filter("own").collect():
        by[r.id].add((min(r.seq, rc(r.seq)), r.ring, r.nodes))
    longest = 0
    for i, t in enumerate(rows):
        want, rings = plain_unitigs(edges_of(t, K))
        assert {x for x in by[i] if not x[1]} == want, t
        own = [x for x in by[i] if x[1]]
        assert {frozenset(frozenset((s[j : j + K], rc(s[j : j + K]))) for j in range(len(s) - K + 1)) for s, _, _ in own} == {r for r, _ in rings}
        longest = max([longest, *(x[2] for x in want), *(n for _, n in rings)])
    assert rounds <= 2 * (math.ceil(math.log2(longest)) + 2)
    assert units.filter("own").count() * 2 == units.count()


def test_a_long_chain_takes_few_rounds(spark):
    g = random.Random(1)
    text = "".join(g.choice("ACGT") for _ in range(3000))
    df = spark.createDataFrame([(1, text)], "id long, s string")
    units, rounds = tg.unitigs(tg.oriented_edges(kmers.canonical_words(df, "id", "s", 22), "id", 21), "id", 21)
    own = units.filter("own").collect()
    assert len(own) == 1 and own[0].seq in (text, rc(text)) and rounds <= 13


def test_graphs_found_beside_their_texts_equal_those_of_tables(spark):
    rows = texts()
    again = [(i, t) for i, t in enumerate(rows)] + [(i, t[:20] + "T" + t[25:]) for i, t in enumerate(rows) if i % 5 == 1]
    for table in (list(enumerate(rows)), again):
        df = spark.createDataFrame([*table, (99, None)], "id long, s string")
        e = written(tg.oriented_edges(kmers.canonical_words(df, "id", "s", K + 1), "id", K))
        units, _ = tg.unitigs(e, "id", K)
        found, edges = tg.text_graphs(df, "id", "s", K)
        rows_of = lambda d, cols: sorted(tuple(r[c] for c in cols) for r in d.collect())
        names = ["id", "head", "rhead", "tail", "rtail", "nodes", "seq", "ring", "own"]
        assert rows_of(found, names) == rows_of(units, names)
        assert rows_of(edges, ["id", "a", "b"]) == rows_of(tg.chain_edges(e, units, "id"), ["id", "a", "b"])


def plain_without_tips(edges, k, anchors):
    rounds = 0
    while True:
        out = defaultdict(set)
        for u, v in edges:
            out[u].add(v)
        units, _ = plain_unitigs(edges)
        gone = set()
        for s, _, n in units:
            words = [s[j : j + k] for j in range(len(s) - k + 1)]
            degree = len(out[words[-1]]) + len(out[rc(words[0])])
            nodes = {min(w, rc(w)) for w in words}
            if n < k and degree <= 1 and not nodes & anchors:
                gone |= nodes
        if not gone:
            return edges, rounds
        rounds += 1
        edges = {(u, v) for u, v in edges if min(u, rc(u)) not in gone and min(v, rc(v)) not in gone}


def test_tips_go_until_none_is_left(spark):
    rows = texts()
    anchors = {i: {min(w, rc(w)) for w in (t[:K], t[-K:])} for i, t in enumerate(rows) if len(t) > K and i % 2}
    a = spark.createDataFrame([(i, number(w)) for i, ws in anchors.items() for w in ws], "id long, node long")
    left, rounds = tg.without_tips(graph(spark, rows), "id", K, a)
    by = defaultdict(set)
    for r in left.collect():
        by[r.id].add((r.u, r.v))
    most = 0
    for i, t in enumerate(rows):
        want, n = plain_without_tips(edges_of(t, K), K, anchors.get(i, set()))
        assert by[i] == {(number(u), number(v)) for u, v in want}, (i, t)
        most = max(most, n)
    assert rounds == most


def test_tips_of_chains_leave_as_many_edges(spark):
    rows = texts()
    rows += [rows[1][:25] + rows[0][40:] + rows[1][12:40], "".join(random.Random(2).choice("ACG") for _ in range(150))]
    df = spark.createDataFrame([*enumerate(rows), (0, rows[1][5:30] + "GATTACA"), (3, "AAAAAAAC")], "id long, s string")
    every = defaultdict(set)
    for i, t in [*enumerate(rows), (0, rows[1][5:30] + "GATTACA"), (3, "AAAAAAAC")]:
        every[i] |= edges_of(t, K)
    anchors = {i: {t[:K], t[-K:]} for i, t in enumerate(rows) if len(t) > K and i % 2}
    units, e = tg.text_graphs(df, "id", "s", K)
    words = spark.createDataFrame([(i, w) for i, ws in anchors.items() for w in ws], "id long, w string")
    held = units.join(words, "id").filter(F.contains("seq", "w")).select("id", "tail")
    got = {r.id: r.edges for r in tg.units_without_tips(units, e, "id", K, held)[0].collect()}
    want = {i: len(plain_without_tips(es, K, {min(w, rc(w)) for w in anchors.get(i, ())})[0]) for i, es in every.items()}
    assert got == {i: n for i, n in want.items() if n}


def test_tips_are_cut_beside_the_texts(spark):
    """As over tables, for small graphs with many tips, rings and branches; a key's two texts are one graph; nothing is shuffled
    but counts of keys."""
    g = random.Random(12)
    rows = [t for t in texts() if len(t) > K] + ["".join(g.choice(a) for _ in range(n)) for a in ("ACGT", "AC", "ACG") for n in (6, 7, 12, 25, 40, 80, 150) for _ in range(6)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "id long, s string")
    want = {}
    for i, t in enumerate(rows):
        n = len(plain_without_tips(edges_of(t, K), K, {min(w, rc(w)) for w in (t[:K], t[-K:])})[0])
        want |= {i: n} if n else {}
    once = tg.texts_without_tips(df, "id", "s", K)
    assert {r.id: r.edges for r in once.collect()} == want and "Exchange" not in once._jdf.queryExecution().executedPlan().toString()
    twice = tg.texts_without_tips(df.union(spark.createDataFrame([(0, rows[5])], "id long, s string")), "id", "s", K)
    both = {min(w, rc(w)) for t in (rows[0], rows[5]) for w in (t[:K], t[-K:])}
    want[0] = len(plain_without_tips(edges_of(rows[0], K) | edges_of(rows[5], K), K, both)[0])
    assert {r.id: r.edges for r in twice.collect()} == want


def test_peeling_beside_the_texts_leaves_the_same(spark):
    df = spark.createDataFrame(list(enumerate(texts())), "id long, s string")
    of = lambda peel: sorted(tuple(r) for r in tg.peeled(tg.text_graphs(df, "id", "s", K, peel=peel)[1], "id")[0].collect())
    assert of(True) == of(False)


def test_cycles_are_what_peeling_leaves(spark):
    g = random.Random(4)
    graphs = {0: [(1, 2), (2, 3), (3, 4)], 1: [(1, 2), (2, 3), (3, 1), (3, 4), (0, 1)], 2: [(5, 5)], 3: []}
    graphs |= {i: [(g.randrange(8), g.randrange(8)) for _ in range(7)] for i in range(4, 40)}
    df = spark.createDataFrame([(i, a, b) for i, es in graphs.items() for a, b in es], "id long, a long, b long")
    left, rounds = tg.peeled(df, "id")
    cyclic = {r.id for r in left.select("id").distinct().collect()}

    def has_cycle(es):
        es = set(es)
        while True:
            stay = {(a, b) for a, b in es if any(y == a for _, y in es)}
            if stay == es:
                return bool(es)
            es = stay

    assert cyclic == {i for i, es in graphs.items() if has_cycle(es)} and rounds <= 9
    seen = {r.a for r in tg.reached(df, spark.createDataFrame([(1, 0)], "id long, a long"), "id").collect()}
    assert seen == {0, 1, 2, 3, 4}


def plain_walks(edges, source, sink, visits):
    out, front, used, limited = [], [[source]], 1, False
    while front:
        step = sorted(p + [b] for p in front if p[-1] != sink for a, b in edges if a == p[-1] and b not in p)
        limited = limited or used + len(step) > visits
        front = step[: visits - used]
        used += len(front)
        out += [p for p in front if p[-1] == sink]
    seen, kept = set(), []
    for i, p in enumerate(sorted(out, key=lambda p: (len(p), p))):
        e = set(zip(p, p[1:]))
        if e - seen:
            kept.append((i + 1, p))
        seen |= e
    return kept, limited


def test_walks_equal_plain_python(spark):
    g = random.Random(6)
    graphs = {0: [(1, 2), (2, 4), (1, 3), (3, 4), (4, 5), (4, 6), (5, 9), (6, 9)], 1: [(1, 9)], 2: [(1, 2)], 3: [(1, 2), (2, 1), (2, 9)]}
    graphs |= {i: sorted({(g.randrange(1, 10), g.randrange(1, 10)) for _ in range(18)}) for i in range(4, 30)}
    df = spark.createDataFrame([(i, a, b) for i, es in graphs.items() for a, b in es], "id long, a long, b long")
    ends = spark.createDataFrame([(i, 1, 9) for i in graphs], "id long, source long, sink long")
    for visits in (1 << 20, 12):
        found, _ = tg.walks(df, ends, "id", visits)
        by = defaultdict(list)
        for r in found.collect():
            by[r.id].append((r.place, r.path, r.limited))
        for i, es in graphs.items():
            want, limited = plain_walks(es, 1, 9, visits)
            assert sorted(by[i]) == [(n, p, limited) for n, p in want], (i, visits)


def test_a_source_that_is_the_sink_is_a_walk(spark):
    df = spark.createDataFrame([(1, 5, 6), (1, 6, 5), (2, 1, 2)], "id long, a long, b long")
    ends = spark.createDataFrame([(1, 5, 5), (2, 1, 2), (3, 7, 7)], "id long, source long, sink long")
    assert sorted((r.id, r.place, r.path) for r in tg.walks(df, ends, "id")[0].collect()) == [(1, 1, [5]), (2, 1, [1, 2]), (3, 1, [7])]


def test_haplotypes_of_a_bubble(spark):
    g = random.Random(12)
    a = "".join(g.choice("ACGT") for _ in range(60))
    b = a[:30] + {"A": "C", "C": "G", "G": "T", "T": "A"}[a[30]] + a[31:]
    k = 11
    df = spark.createDataFrame([(1, a), (1, b)], "id long, s string")
    e = written(tg.oriented_edges(kmers.canonical_words(df, "id", "s", k + 1), "id", k))
    units, _ = tg.unitigs(e, "id", k)
    by_head = units.select("id", "head", F.col("tail").alias("source"))
    source = by_head.filter(F.col("head") == number(a[:k])).select("id", "source")
    ends = source.crossJoin(spark.createDataFrame([(number(a[-k:]),)], "sink long"))
    found, _ = tg.walks(tg.chain_edges(e, units, "id"), ends, "id")
    assert {r.seq for r in tg.haplotypes(found, units, "id", k).collect()} == {a, b}
