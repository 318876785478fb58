"""Source divergence, centroid clustering and decontamination against brute force and SQL, on odd rows too."""

import pickle
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandloom.llm import bytewords, clusters, decontam, divergence

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def by_sql(sql: str, **tables):
    con = duckdb.connect()
    for name, df in tables.items():
        con.register(name, df.toArrow())
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    return names, sorted(map(repr, cursor.fetchall()))


def rows_of(df, names):
    return sorted(repr(tuple(r[n] for n in names)) for r in df.collect())


# Words on bytes


def test_words_end_where_texts_do():
    texts = ["ab", "cd", "", "É x", "y1", "ñ", "z" * 70, "A.b"]
    low, start, end, text = bytewords.spans(*bytewords.texts_of(pa.array(["skipped", *texts]).slice(1)), bytewords.word_table(*divergence.LETTERS))
    got = [(int(t), low[a:b].tobytes().decode()) for a, b, t in zip(start, end, text)]
    assert got == [(0, "ab"), (1, "cd"), (3, "É"), (3, "x"), (4, "y"), (5, "ñ"), (6, "z" * 70), (7, "a"), (7, "b")]
    assert list(bytewords.chunks(np.array([0, 5, 5, 30, 31]), 6)) == [(0, 2), (2, 3), (3, 4)]
    assert bytewords.spans(*bytewords.texts_of(pa.array([], pa.string())), bytewords.word_table())[1].tolist() == []


# Source divergence


def test_equal_hashes_are_told_apart(monkeypatch):
    monkeypatch.setattr(divergence.xxhash, "xxh3_64_intdigest", lambda b: len(b) % 2)
    texts = ["the cat the dog", "a be cab abc the", "dog"]
    who, term, n, df = divergence.counted(*bytewords.texts_of(pa.array(texts)), np.array([0, 1, 0]), bytewords.word_table(*divergence.LETTERS))
    got = {(int(o), t): (int(x), int(y)) for o, t, x, y in zip(who, term.to_pylist(), n, df)}
    assert got == {(0, "the"): (2, 1), (0, "cat"): (1, 1), (0, "dog"): (2, 2), (1, "a"): (1, 1), (1, "be"): (1, 1), (1, "cab"): (1, 1), (1, "abc"): (1, 1), (1, "the"): (1, 1)}


def test_shares_are_exact():
    g = random.Random(3)
    for _ in range(2000):
        total = g.randint(1, 10 ** g.randint(1, 14))
        n = g.randint(0, total)
        assert divergence.share(np.array([n]), np.array([total])).tolist() == [1 + 1_000_000_000 * (n + 1) // total]


def corpus(spark):
    g = random.Random(8)
    words = ["the", "cat", "Dog", "été", "x", "naïve", "日本", "a-b", "1a2"] + [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)]
    rows = []
    for i in range(240):
        lang = g.choice(["en", "en", "fr", None, ""])
        source = "hot" if g.random() < 0.4 else g.choice(["s1", "s2", "é", None])
        rows.append((i, " ".join(g.choices(words, k=g.randint(0, 30))) if g.random() < 0.95 else None, lang, source, 0))
    rows += [(900, "the the " * 5000, "en", "long", 1)] + [(901, "one copy of the", "fr", "s1", 1)] * 3
    rows += [(902, "solo", "de", "only", 1), (903, "rare word", "es", "p", 1), (904, None, "es", "q", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, term long")


@pytest.mark.parametrize("slice_", [1 << 18, 7])
def test_divergences_equal_sql_on_odd_rows(spark, monkeypatch, slice_):
    monkeypatch.setattr(divergence, "SLICE", slice_)
    monkeypatch.setattr(divergence, "HELD", 64)
    monkeypatch.setattr(divergence, "TOP", 20)
    docs = corpus(spark)
    names, want = by_sql(divergence.oracle_sql(), documents=docs)
    got = divergence.audit(docs)
    assert rows_of(got, names) == want
    es = {(r.source, r.item, r.value) for r in got.filter("lang = 'es'").collect()}
    assert es == {("p", "q", 0), ("q", "p", 0)} and not got.filter("lang = 'de'").count()


def test_divergences_of_no_documents_and_odd_columns(spark, docs, no_docs):
    assert divergence.audit(no_docs).collect() == []
    names, want = by_sql(divergence.oracle_sql(), documents=docs.select("text", "lang", "source"))
    assert rows_of(divergence.audit(docs), names) == want


# Centroid clustering


def lloyd(points: list[tuple], centroids: list[tuple], rounds: int):
    """Plain k-means in Python's integers."""
    near = lambda p, cs: min((sum((a - b) ** 2 for a, b in zip(p, c)), j) for j, c in enumerate(cs))
    for _ in range(rounds):
        own = defaultdict(list)
        for p in points:
            own[near(p, centroids)[1]].append(p)
        centroids = [tuple(sum(x) // len(own[j]) for x in zip(*own[j])) if own[j] else c for j, c in enumerate(centroids)]
    return [near(p, centroids) for p in points], centroids


def test_exponion_equals_all_distances():
    g = np.random.default_rng(3)
    computed = whole = 0
    for _ in range(60):
        d, k, n, r = int(g.integers(1, 6)), int(g.integers(1, 12)), int(g.integers(1, 300)), int(g.choice([2, 5, 50, 1 << 22]))
        x = g.integers(-r, r, size=(n, d))
        c = x[g.integers(0, n, size=k)] if g.random() < 0.5 else g.integers(-r, r, size=(k, d))
        cluster, least, two = clusters.nearest_two(clusters.squared(x, c), np.arange(k))
        upper, lower = clusters.up(np.sqrt(least.astype(float))), clusters.down(np.sqrt(two))
        for _ in range(4):
            new = np.array([x[cluster == j].sum(axis=0) // (cluster == j).sum() if (cluster == j).any() else c[j] for j in range(k)])
            clusters.moved(upper, lower, cluster, np.sqrt(((new - c) ** 2).sum(axis=1).astype(float)))
            c = new
            computed, whole = computed + clusters.exponion(x, cluster, upper, lower, clusters.Ball(c)), whole + n * k
            assert (cluster == ((x[:, None] - c[None]) ** 2).sum(axis=2).argmin(axis=1)).all()
    assert computed < 0.7 * whole


@pytest.mark.parametrize("k", [5, 40])
def test_clusters_equal_plain_python(spark, k):
    g = np.random.default_rng(5)
    rows = [(i, (g.integers(0, 6, 4) / 4).tolist(), "x") for i in range(30)]
    rows += [(3, [0.5, 0.5, 0.5, 0.5], "x"), (7, [1.0, 1.0, 1.0, 1.0], None), (7, [1.0, 1.0, 1.0, 1.0], None), (None, [0.1, 0.2, -0.3, 0.4], None)]
    odd = [(100, None, "x"), (101, [], "x"), (102, [1.0, 2.0, 3.0], "x"), (103, [1.0, None, 1.0, 1.0], "x"), (104, [float("nan"), 1.0, 1.0, 1.0], "x"), (105, [float("-inf"), 1.0, 1.0, 1.0], "x"), (106, [1e300, 1.0, 1.0, 1.0], "x")]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, cluster string").repartition(3)
    import hashlib

    points = [tuple(int(np.floor(256 * x)) for x in r[1]) for r in rows]
    order = sorted(range(len(rows)), key=lambda i: (hashlib.sha256(f"2:{rows[i][0]}".encode()).hexdigest() if rows[i][0] is not None else "~", np.array(points[i], "<i4").tobytes()))
    near, last = lloyd(points, [points[i] for i in order[:k]], 5)
    inertia = Counter()
    for far, j in near:
        inertia[j] += far
    want = sorted((r[0] if r[0] is not None else -1, j, far, inertia[j], sum(inertia.values()), hashlib.sha256(",".join(map(str, last[j])).encode()).hexdigest()) for r, (far, j) in zip(rows, near))
    got = clusters.cluster(df, k, d=4)
    assert sorted((r.vec_id if r.vec_id is not None else -1, *r[1:]) for r in got.collect()) == want
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_clusters_of_nothing(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert clusters.cluster(none).collect() == [] and clusters.bits(64) == 27


# Decontamination


def brute_hits(docs: list[str | None], items: list[tuple], window: int):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    phrases, out = defaultdict(set), []
    for item, text in items:
        w = word.findall((text or "").translate(LOWER))
        m = min(len(w), window)
        for i in range(len(w) - m + 1 if w else 0):
            phrases[tuple(w[i : i + m])].add(item)
    for text in docs:
        w, hit, own = word.findall((text or "").translate(LOWER)), set(), set()
        for m in {len(p) for p in phrases}:
            for i in range(len(w) - m + 1):
                if (p := tuple(w[i : i + m])) in phrases:
                    hit |= set(range(i, i + m))
                    own |= phrases[p]
        out.append((len(w), len(hit), sorted(str(x) for x in own if x is not None)))
    return out


def test_index_equals_a_search_of_all_places():
    g = random.Random(1)
    for _ in range(100):
        words = g.choice([1, 2, 3, 9, 40])
        text = [x for _ in range(g.randint(1, 6)) for x in [*(g.randint(1, words) for _ in range(g.randint(1, 30))), 0]]
        index = decontam.FMIndex(np.array(text, np.int32), words)
        for width in (1, 2, 5):
            phrases = np.unique(np.array([[g.randint(1, words) for _ in range(width)] for _ in range(20)], np.int32), axis=0)
            got = {int(k): sorted(index.locate(np.arange(a, b)).tolist()) for k, a, b in zip(*index.search(phrases))}
            want = {k: [i for i in range(len(text) - width + 1) if text[i : i + width] == p.tolist()] for k, p in enumerate(phrases)}
            assert got == {k: v for k, v in want.items() if v}


def test_words_of_one_hash_are_told_apart(monkeypatch):
    g = random.Random(2)
    real = decontam.hashes
    vocab = ["a", "b", "é", "the", "ñx", "x1", "0", "日本", "unknown", "other"]
    for _ in range(100):
        make = lambda n: "".join(g.choice(vocab) + g.choice([" ", "  ", ".", "\n"]) for _ in range(n)).strip()
        items = [(g.choice([None, str(k)]), make(g.randint(0, 9))) for k in range(g.randint(0, 6))]
        texts = [make(g.randint(0, 40)) for _ in range(4)]
        cut = g.randint(0, len(items))
        monkeypatch.setattr(decontam, "hashes", real)
        blocks = [decontam.Windows(pa.array([t for _, t in part], pa.large_string()), [i for i, _ in part], 4) for part in (items[:cut], items[cut:])]
        for w in blocks:  # texts' words meet those of items in few hashes
            w.hash, w.seed = np.sort(w.hash), w.seed
        monkeypatch.setattr(decontam, "hashes", lambda low, start, seed: np.where(real(low, start, seed) % np.uint64(3) > 0, real(low, start, seed), blocks[0].hash[0] if len(blocks[0].hash) else np.uint64(1)))
        n, hit, own, _ = decontam.judged(*bytewords.texts_of(pa.array(texts)), [], bytewords.word_table(*decontam.LETTERS))
        assert n.tolist() == [x[0] for x in brute_hits(texts, items, 4)] and not hit.any()
        found = blocks[0].numbered(*bytewords.spans(*bytewords.texts_of(pa.array(texts)), bytewords.word_table(*decontam.LETTERS))[:3])
        low, start, end, _ = bytewords.spans(*bytewords.texts_of(pa.array(texts)), bytewords.word_table(*decontam.LETTERS))
        for k, a, b in zip(found.tolist(), start, end):
            if k:
                assert low[a:b].tobytes() == blocks[0].bytes[blocks[0].ends[k - 1] : blocks[0].ends[k]].tobytes()
        monkeypatch.setattr(decontam, "hashes", real)
        n, hit, own, _ = decontam.judged(*bytewords.texts_of(pa.array(texts)), [pickle.loads(pickle.dumps(b)) for b in blocks], bytewords.word_table(*decontam.LETTERS))
        assert list(zip(n.tolist(), hit.tolist(), own)) == brute_hits(texts, items, 4)


ITEMS = [(1, "the cat sat on the mat. It was a fine day, and the cat was glad of it"), (10, "The CAT sat on"), (2, "ÉTÉ! été"), (3, None), (4, " .. "), (10, "x"), (None, "no id here"), (5, "was a fine day and the cat was glad of"), (5, "was a fine day and the cat was glad of")]


@pytest.mark.parametrize("block", [1 << 23, 30])
def test_hits_equal_brute_force_on_odd_rows(spark, docs, no_docs, monkeypatch, block):
    monkeypatch.setattr(decontam, "BLOCK_BYTES", block)
    monkeypatch.setattr(decontam, "SHARD_BYTES", 40)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    found = decontam.contaminated(docs.withColumn("items", F.lit(7)), items).collect()
    key = lambda x: (x[0] or 0, x[1] or "")
    rows = sorted(found, key=lambda r: key((r.doc_id, r.text)))
    assert [(r.n_words, r.n_hit, sorted(r["_items"])) for r in rows] == brute_hits([r.text for r in rows], ITEMS, 10)
    assert rows[0]["items"] == 7 and {(r["__row"], r["row"]) for r in rows} == {(9, 8)}
    assert next(r["_items"] for r in rows if r.doc_id == 1) == ["1", "10", "5"] and next(r for r in rows if r.doc_id is None).n_hit == 3
    assert decontam.contaminated(no_docs, items).count() == 0
    assert decontam.contaminated(docs, items.filter("false")).filter("n_hit > 0 OR size(items) > 0").count() == 0


def test_hits_equal_sql(spark, docs):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    names, want = by_sql(decontam.oracle_sql(), documents=docs.select("doc_id", "text"), benchmark=items)
    found = decontam.contaminated(docs, items, carry=["doc_id"])
    ids = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    got = found.select("doc_id", "n_words", "n_hit", F.size("items").alias("n_items"), ids.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
    assert rows_of(got, names) == want


def test_spans_are_cut_out(spark):
    text = "Intro. The cat sat on a mat, Ünd the cat sat on — end; two cats sat on"
    items = spark.createDataFrame([(1, "the CAT sat on"), (2, "sat on a mat")], "item_id int, text string")
    docs = spark.createDataFrame([(text, 1), (None, 2), ("clean é", 3)], "text string, spans int")
    got = {r.spans: r.text for r in decontam.cleaned(docs, items).collect()}
    assert got == {1: "Intro. , Ünd  — end; two cats sat on", 2: None, 3: "clean é"}
