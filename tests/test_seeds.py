"""Minimizers, and the haplotype that each read fits best."""

import random

from strandloom.functions import kmers
from strandloom.operators import seeds


def test_texts_that_share_enough_share_a_minimizer():
    g = random.Random(1)
    for _ in range(100):
        k, w = 7, g.randint(1, 6)
        core = "".join(g.choice("ACGT") for _ in range(w + k - 1))
        a, b = ("".join(g.choice("ACGTN") for _ in range(20)) + core + "".join(g.choice("ACGT") for _ in range(20)) for _ in range(2))
        x, y = kmers.text_minimizers(a, k, w), kmers.text_minimizers(b, k, w)
        assert set(x[1].tolist()) & set(y[1].tolist())
        assert len(x[0]) == len(set(x[0].tolist()))
    assert [len(x) for x in kmers.text_minimizers("ACG", 7, 3)] == [0, 0, 0] and len(kmers.text_minimizers("ACGTACG", 7, 3)[0]) == 1


def test_reads_find_the_haplotype_that_holds_them(spark):
    g = random.Random(4)
    haps, reads, want = [], [], {}
    for window in range(12):
        ref = "".join(g.choice("ACGT") for _ in range(400))
        other = [ref, ref[:200] + "ACGT"["TACG".index(ref[200])] + ref[201:], ref[:120] + ref[133:], ref[:250] + "GATTACAGATTACA" + ref[250:]]
        haps += [(window, i, h) for i, h in enumerate(other)]
        for n in range(40):
            h = other[n % 4]
            at = g.randrange(0, len(h) - 90)
            read = h[at : at + 90]
            want[window, n] = next(i for i, x in enumerate(other) if read in x)
            if n % 3 == 0:
                read = read[::-1].translate(str.maketrans("ACGT", "TGCA"))
            reads.append((window, n, read))
    reads.append((0, 99, None))
    r, h = spark.createDataFrame(reads, "window long, read long, seq string"), spark.createDataFrame(haps, "window long, hap long, seq string")
    got = {(x.window, x.read): (x.hap, x.score) for x in seeds.best_haplotypes(r, h, "window", w=1).collect()}
    assert {k: v[0] for k, v in got.items()} == want and (0, 99) not in got
    assert all(v[1] == 90 for v in got.values())
    few = {(x.window, x.read): x.hap for x in seeds.best_haplotypes(r, h, "window", w=5).collect()}
    assert sum(few[k] == v for k, v in want.items()) >= 0.97 * len(want)


def test_only_sequences_are_shuffled_and_large_groups_are_dealt(spark, monkeypatch):
    g = random.Random(6)
    unit = ["".join(g.choice("ACGT") for _ in range(60)) for _ in range(3)]
    text = "".join(g.choice(unit) for _ in range(60))  # repeats, so many chains
    texts = [(w, h, text[: 900 + 300 * w] if h else text[7:]) for w in range(3) for h in range(3)] + [(None, 0, text)]
    own = [(w, n, text[at : at + 90]) for w in range(3) for n in range(25) for at in [g.randrange(0, len(text) - 90)]] + [(0, 3, text[50:90]), (None, 1, text[:80]), (2, None, text[:60])]
    r, h = spark.createDataFrame(own, "window long, read long, seq string"), spark.createDataFrame(texts, "window long, hap int, seq string")
    want = seeds.chains(seeds.seeds(r, h, "window", 11, 3), "window", 11).collect()
    best = {}
    for x in want:
        key = (x.window, x.read)
        best[key] = max(best.get(key, (-(10**9), 0)), (x.score, -x.hap))
    for part, most in ((1 << 22, 1 << 20), (500, 40)):
        monkeypatch.setattr(seeds, "PART", part)
        monkeypatch.setattr(seeds, "SEEDS", most)
        got = seeds.best_haplotypes(r, h, "window")
        assert "kmer" not in got._jdf.queryExecution().executedPlan().toString()
        rows = got.collect()
        assert len(rows) == len(best) and {(x.window, x.read): (x.score, -x.hap) for x in rows} == best
