import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandloom.llm import ann, neardup, warc


def test_loser_tree_merges():
    g = np.random.default_rng(1)
    for k in range(8):
        runs = [sorted(bytes([int(x)]) for x in g.integers(0, 50, g.integers(0, 20))) for _ in range(k)]
        assert list(warc.LoserTree(runs)) == sorted(x for r in runs for x in r)


def pages(spark):
    big = "<p>x</p>" * 300
    rows = [(1, "http://a.com/x", big), (2, "http://www.a.com/y?b=2&a=1", big), (5, "https://b.org/", big), (3, None, "short"), (4, "http://b.org/é x\r\nz", "short"), (6, "http://c", None), (6, "http://c", None), (None, "http://d", big), (7, "http://e", "ü" * 600)]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


@pytest.mark.parametrize("fan_in", [64, 2])
def test_archives_round_trip(spark, monkeypatch, fan_in):
    monkeypatch.setattr(warc, "FAN_IN", fan_in)
    monkeypatch.setattr(warc, "RUN_RECORDS", 2)
    rows = warc.read_archives(*warc.archive(pages(spark))).collect()
    got = sorted((r.page_id or 0, r.record_type, r.refers_to or 0, r.payload_bytes) for r in rows)
    assert got == [(0, "revisit", 5, 2400), (1, "revisit", 5, 2400), (2, "revisit", 5, 2400), (3, "response", 0, 5), (4, "response", 0, 5), (5, "response", 0, 2400), (6, "response", 0, 0), (6, "response", 0, 0), (7, "response", 0, 1200)]
    keys = [(r.urlkey, r.captured) for r in sorted(rows, key=lambda r: (r.history_part, r.history_place))]
    assert keys == sorted(keys) and keys[-1][0].startswith("org,b)")


def test_archives_of_no_pages(spark):
    assert warc.read_archives(*warc.archive(pages(spark).filter("false"))).count() == 0


def test_merges_open_few_runs_and_cut_every_level(spark, monkeypatch):
    """20 runs, two to a merge: five levels, each cut by keys into ranges of bounded size."""
    monkeypatch.setattr(warc, "FAN_IN", 2)
    monkeypatch.setattr(warc, "PART_RECORDS", 3000)
    g = np.random.default_rng(31)
    folder = warc.shared_dir(spark, "warc")
    want, runs = [], []
    for k in range(20):
        lines = sorted(f"com,h{int(x):03d})/ {int(y):014d} 0 {{}}".encode() for x, y in zip(g.integers(0, 50, 1500), g.integers(0, 1 << 40, 1500)))
        want += lines
        runs.append(warc.write_run(f"{folder}/runs/{k:03d}.cdx", lines))
    plans, old = [], warc.key_ranges
    monkeypatch.setattr(warc, "key_ranges", lambda *a: (plans.append(old(*a).collect()), old(*a))[1])
    with warc.Scratch(spark, "warc-merge") as scratch:
        index = warc.merge_runs(spark.createDataFrame(runs, "path string, n long, low binary"), folder, scratch).orderBy("part").collect()
    assert [len({r.group for r in p}) for p in plans] == [10, 5, 3, 2, 1]
    assert all(len(r.runs) <= 2 for p in plans for r in p) and len(plans[-1]) >= 8
    assert max(len(paths) for r in plans[-1] for paths in r.runs) < 5
    assert [x for r in index for x in warc.read_run(r.path)] == sorted(want)
    assert max(r.n for r in index) <= 6000


def vectors(spark, n=3000, d=32):
    g = np.random.default_rng(4)
    centres = g.normal(0, 1, (12, d))
    x = (centres[g.integers(0, 12, n)] + g.normal(0, 0.7, (n, d))).astype(np.float32)
    x[100:1100] = x[100]  # a third are copies of one
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    rows += [(9000, None, 1), (9050, [0.0] * d, 1), (9100, [float("nan")] * d, 1), (9150, [None] + [1.0] * (d - 1), 1), (9200, [1.0], 1), (None, [1.0] * d, 1), (9250, [], 1)]
    return x, spark.createDataFrame(rows, "vec_id long, embedding array<float>, list int")


def test_neighbours_against_brute_force(spark):
    x, df = vectors(spark)
    got = {}
    for r in ann.search(df, F.col("vec_id") % 50 == 0, 5).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    hits = total = 0
    assert set(got) == set(range(0, 3000, 50))
    for q, rows in got.items():
        rows.sort()
        assert [r[0] for r in rows] == [1, 2, 3, 4, 5] and q not in [r[1] for r in rows]
        c = np.round(u @ u[q], 12)
        c[q] = -2
        want = np.lexsort((np.arange(3000), -c))[:5]
        hits += len(set(want.tolist()) & {r[1] for r in rows})
        total += 5
        assert all(abs(s - u[v] @ u[q]) < 1e-9 for _, v, s in rows)
    assert hits / total >= 0.95
    assert [r[1] for r in sorted(got[150])] == [100, 101, 102, 103, 104]


def test_neighbours_where_lists_are_pruned(spark):
    """No clusters and 141 lists: 48 of them hold too few of the neighbours."""
    n, d = 20_000, 64
    x = np.random.default_rng(5).normal(0, 1, (n, d)).astype(np.float32)
    df = spark.createDataFrame(pa.table({"vec_id": np.arange(n), "embedding": list(x)}))
    got = {}
    for r in ann.search(df, F.col("vec_id") % 50 == 0, 5).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    u = ann.unit(x)
    c = u[::50] @ u.T
    c[np.arange(n // 50), np.arange(0, n, 50)] = -2
    want = np.argpartition(-c, 5, axis=1)[:, :5]
    assert np.mean([len(got[50 * i] & set(w.tolist())) / 5 for i, w in enumerate(want)]) >= 0.93


def test_few_and_no_vectors(spark):
    _, df = vectors(spark, 1101)
    few = ann.search(df.filter("vec_id IN (0, 1, 2) OR vec_id > 9000"), F.col("vec_id") % 50 == 0, 5).collect()
    assert sorted((r.query_id, r["rank"]) for r in few) == [(0, 1), (0, 2)]
    assert ann.search(df.filter("false"), F.lit(True), 5).count() == 0


def plain_nearest(rows: list[tuple], every: int, k: int) -> dict:
    """Of each query (id, vector), the k nearest other rows by (cosine, id), in double precision."""
    rows = sorted({(i, tuple(v)) for i, v in rows})
    x = np.array([v for _, v in rows])
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for i, (q, v) in enumerate(rows):
        if q % every == 0:
            c = np.round(x @ x[i], 9)
            out.setdefault(q, []).append([rows[j][0] for j in sorted((j for j in range(len(rows)) if j != i), key=lambda j: (-c[j], rows[j][0]))[:k]])
    return {q: sorted(v) for q, v in out.items()}


def test_one_id_on_several_vectors(spark):
    """Each vector of the id is a query with neighbours of its own, and a candidate for the others."""
    near = lambda axis, i: [1.0 if axis == 0 else 0.01 * i, 0.01 * i if axis == 0 else 1.0, 0.0, 0.001 * i]
    rows = [(50, [1.0, 0.0, 0.0, 0.0]), (50, [0.0, 1.0, 0.0, 0.0]), (100, [1.0, 0.0, 0.0, 0.0]), (50, [0.0, 1.0, 0.0, 0.0])]
    rows += [(i, near(0, i)) for i in range(1, 7)] + [(10 + i, near(1, i)) for i in range(1, 7)] + [(3, near(1, 9))]
    got = {}
    for r in ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0, 5).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    want = plain_nearest(rows, 50, 5)
    assert {q: len(v) for q, v in got.items()} == {50: 10, 100: 5}
    for q, found in got.items():
        for rank in range(1, 6):
            assert sorted(v for r, v in found if r == rank) == sorted(w[rank - 1] for w in want[q])
    assert [v for _, v in sorted(got[100])] == [50, 1, 2, 3, 4]


def test_a_batch_of_queries_is_expanded_in_slices(spark, monkeypatch):
    """Pairs of query and list go as numbers, so a batch of wide vectors takes little memory beside itself."""
    g = np.random.default_rng(12)
    x = ann.unit(g.normal(0, 1, (1500, 1024)))
    pairs = []
    monkeypatch.setattr(ann, "PLACES", 4096)
    near = ann.probe_lists(x, x[:195], 195)
    assert near.shape == (1500, 195) and (np.sort(near, axis=1) == np.arange(195)).all()
    for b in ann.places(iter([pa.RecordBatch.from_arrays([pa.array(np.arange(1500)), pa.array(x.astype(np.float64).tolist(), pa.list_(pa.float64()))], names=["rid", "embedding"])]), x[:195], np.eye(1024, dtype=np.float32), 195):
        pairs.append(b.num_rows)
        assert b.schema.names == ["list", "rid"]
    assert sum(pairs) == 1500 * 195 and max(pairs) <= 4096


def test_lists_are_copied_for_their_own_queries_only():
    assert ann.cut(10, 3) == (1, 1) and ann.cut(0, 0) == (1, 1)
    # 4,096 lists, 48 probes, 2 % of 10^9 vectors are queries: 234,375 queries a list, not 4,883 chunks but 58.
    assert ann.cut(244_141, 234_375) == (60, 58)


def test_scan_keeps_the_nearest():
    g = np.random.default_rng(6)
    x = ann.unit(g.normal(0, 1, (500, 64)))
    kept = [set(np.argsort(((x - q) ** 2).sum(axis=1))[:6].tolist()) <= set(ann.scan(q, x, 6).tolist()) for q in x[:60]]
    assert np.mean(kept) > 0.95


def test_near_duplicates_against_brute_force(spark):
    g = np.random.default_rng(7)
    vocabulary = [f"v{i}" for i in range(3000)]
    base = [list(g.choice(vocabulary, g.integers(60, 200))) for _ in range(40)]
    passage = list(g.choice(vocabulary, 55))
    texts = [" ".join(b) for b in base]
    for b in base[:15]:
        for _ in range(int(g.integers(1, 12))):
            c = list(b)
            for _ in range(int(g.integers(0, 3))):
                c[int(g.integers(0, len(c)))] = "edited"
            texts.append(" ".join(c))
    texts += [" ".join([*g.choice(vocabulary, 150), *passage]) for _ in range(60)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    idf = neardup.idf_table(rows)
    sets = [neardup.shingles(t, idf) for t in texts]
    parent = list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if neardup.similarity(sets[i], sets[j]) >= 0.8:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    got = {r.doc_id: r.class_id for r in neardup.labelled(rows).collect()}
    assert got == {i: find(i) for i in range(len(texts))}
    left = neardup.distinct_docs(rows)
    assert {r.doc_id for r in left.collect()} == {find(i) for i in range(len(texts))}


def test_near_duplicates_in_a_family_of_one_template(spark):
    """Texts alike at about 0.75 meet in large buckets; the true pairs among them are all found."""
    g = np.random.default_rng(17)
    template = [f"t{i}" for i in range(235)]
    texts = []
    for i in range(400):
        own = [f"o{x}" for x in g.integers(0, 1 << 40, 21)]
        for j in (0, 1):
            tail = list(own)
            tail[-13:] = [f"p{x}" for x in g.integers(0, 1 << 40, 13)]
            texts.append(" ".join([*template, *tail]))
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    idf = neardup.idf_table(rows)
    sets = [neardup.shingles(t, idf) for t in texts]
    assert all(neardup.similarity(sets[i], sets[i + 1]) >= 0.8 for i in range(0, 800, 2))
    assert max(neardup.similarity(sets[i], sets[j]) for i in range(0, 40, 2) for j in range(i + 2, 800)) < 0.8
    got = {r.doc_id: r.class_id for r in neardup.labelled(rows).collect()}
    assert got == {i: i - i % 2 for i in range(800)}


def test_weights_tell_boilerplate_from_copies(spark):
    """A passage that all texts share makes plain Jaccard similarity high and the weighted one low."""
    g = np.random.default_rng(23)
    passage = [f"p{i}" for i in range(110)]
    texts = [" ".join([*passage, *(f"o{x}" for x in g.integers(0, 1 << 40, 11))]) for _ in range(300)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, texts[0] + " more"])], "doc_id long, text string")
    idf = neardup.idf_table(rows)
    a, b = (neardup.shingle_counts(t)[0] for t in texts[:2])
    assert len(np.intersect1d(a, b)) / len(np.union1d(a, b)) >= 0.8
    assert neardup.similarity(neardup.shingles(texts[0], idf), neardup.shingles(texts[1], idf)) < 0.75
    got = {r.doc_id: r.class_id for r in neardup.labelled(rows).collect()}
    assert got == {i: i % 300 for i in range(301)}


def test_document_frequencies_follow_the_sketch(spark):
    texts = ["a b c d e"] * 40 + ["f g h i j"] * 5 + [f"x{i} y z u v" for i in range(55)]
    idf = neardup.idf_table(spark.createDataFrame([(t,) for t in texts], "text string"))
    for text, df in (("a b c d e", 40), ("f g h i j", 5), ("x3 y z u v", 1)):
        code = neardup.codes(neardup.shingle_counts(text)[0], idf)
        assert code.tolist() == [round((neardup.LEVELS - 1) * np.log(101 / (1 + df)) / np.log(102))]


def test_equal_triples_do_not_change_how_often_samples_agree():
    """Texts with many more shingles than there are triples."""
    g = np.random.default_rng(24)
    hits = rounds = 0
    for _ in range(40):
        h = np.sort(g.integers(0, 1 << 63, 150_000, dtype=np.uint64))
        w, rows = neardup.weights(np.ones(150_000, np.int64), np.full(150_000, 128)), np.sort(g.choice(150_000, 135_000, replace=False))
        hits, rounds = hits + (neardup.band_keys(h, w) == neardup.band_keys(h[rows], w[rows])).sum(), rounds + neardup.BANDS
    assert abs(hits / rounds - 0.9**neardup.ROWS) < 0.05  # 640 draws: 0.02 is one standard error


def test_prefixes_of_alike_texts_meet():
    g = np.random.default_rng(18)
    order = g.integers(0, 4, 300)
    for _ in range(200):
        h = np.sort(g.integers(0, 1 << 63, 300, dtype=np.uint64))
        w = (g.integers(1, 4, 300) * g.uniform(1, 2, 300)).astype(np.float32)
        a, b = np.sort(g.choice(300, g.integers(240, 301), replace=False)), np.sort(g.choice(300, g.integers(240, 301), replace=False))
        if neardup.similarity((h[a], None, w[a]), (h[b], None, w[b])) >= 0.8:
            (ka, sa), (kb, sb) = neardup.prefixes(h[a], w[a], order[a], 0.8), neardup.prefixes(h[b], w[b], order[b], 0.8)
            other = {0: 1, 1: 0, 2: 2}
            assert {*zip(ka.tolist(), sa.tolist())} & {(k, other[s]) for k, s in zip(kb.tolist(), sb.tolist())}


def test_near_duplicates_of_odd_rows(docs, no_docs):
    got = neardup.labelled(docs).collect()
    assert len(got) == docs.count()
    by = {}
    for r in got:
        by.setdefault(r.class_id, []).append(r.doc_id)
    assert by[1] == [1, 1] and sorted(by[2]) == [2, 3] and by[4] == [4]
    left = neardup.distinct_docs(docs)
    assert left.columns == docs.columns
    assert all((r["__k1"], r["__row"], r["row"]) == ("key", 9, 8) for r in left.collect())
    assert sorted(r.doc_id or 0 for r in left.collect()) == [0, 1, 2, 4, 5, 6, 7]
    assert neardup.labelled(no_docs).count() == 0 and neardup.distinct_docs(no_docs).count() == 0


def test_samples_collide_as_often_as_sets_are_alike():
    g = np.random.default_rng(8)
    hits = want = 0.0
    rounds = 700
    for _ in range(rounds):
        h = np.sort(g.integers(0, 1 << 63, 400, dtype=np.uint64))
        w, rows = neardup.weights(g.choice([1, 1, 1, 2, 5], 400), g.integers(0, neardup.LEVELS, 400)), np.sort(g.choice(400, 360, replace=False))
        alike = neardup.similarity((h, None, w), (h[rows], None, w[rows]))
        assert abs(alike - float(w[rows].sum() / w.sum())) < 1e-5
        want += alike**neardup.ROWS
        hits += (neardup.band_keys(h, w) == neardup.band_keys(h[rows], w[rows])).mean()
    assert abs(hits - want) / rounds < 0.015  # 0.005 is one standard error


def test_a_repeated_row_is_one_text(spark, monkeypatch):
    """What is compared has one text a node, however often its row is repeated."""
    a = " ".join(f"w{i}" for i in range(80))
    rows = [(1, a)] * 30 + [(2, a + " more")] * 20 + [(3, a + " and more")]
    sizes, old = [], neardup.verified
    monkeypatch.setattr(neardup, "verified", lambda pairs, texts, *x: (sizes.append(texts.count()), old(pairs, texts, *x))[1])
    got = neardup.labelled(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.class_id for r in got} == {1} and len(got) == 51 and set(sizes) == {3}
