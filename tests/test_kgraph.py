"""K-mers of reads, walks and graphs as numbers, against plain Python; and how often their queries shuffle."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from strandloom.functions import kmers
from strandloom.operators import kgraph
from strandloom.plans import catalog

SF = "/root/testdata/sf0.001"
RC = str.maketrans("ACGT", "TGCA")


def canon(w):
    return min(w, w[::-1].translate(RC))


def test_supported_kmers_equal_plain_python(spark):
    g, k, rows = random.Random(3), 7, []
    for n in range(60):
        text = "".join(g.choice("ACGT" * 9 + "N") for _ in range(g.randint(0, 40)))
        quals = None if n % 20 == 5 else [0 if g.random() < 0.05 else 40 for _ in text]
        rows.append((n % 3, f"s{n % 2}", "CTRL", f"r{n // 3 if n < 30 else n}", text, quals))
    rows.append((0, "s0", "CTRL", None, "ACGTACGTTT", [40] * 10))
    seen = {}
    for window, sample, role, name, text, quals in rows:
        for i in range(len(text) - k + 1 if quals else 0):
            if "N" not in text[i : i + k] and sum(10 ** (-q / 10) for q in quals[i : i + k]) < 1:
                key = window, name, role, canon(text[i : i + k])
                seen[key] = min(seen.get(key, sample), sample)
    want = Counter((window, w, sample) for (window, _, _, w), sample in seen.items())
    reads = spark.createDataFrame(rows, "window_id long, sample string, role string, qname string, seq string, quals array<int>")
    assert {(r.window_id, r.kmer, r.sample): r.n for r in kgraph.supported_kmers(reads, k).collect()} == want
    counts = kgraph.supported_codes(reads, k)
    low = F.col("kmer") < 1 << 2 * (k - 2)
    of = lambda anchors: sorted(tuple(r) for r in kgraph.kept_nodes(counts, anchors).collect())
    assert of(low) == of(counts.filter(low).select("window_id", "kmer").distinct())


def test_walks_pass_over_what_is_no_base(spark):
    text = "ACGTNACGTTGCA"
    want = [(i, canon(text[i : i + 4]), text[i : i + 4] == canon(text[i : i + 4])) for i in range(len(text) - 3) if "N" not in text[i : i + 4]]
    df = spark.createDataFrame([(1, text), (2, None), (3, "ACG")], "id long, s string")
    assert sorted((r.step, r.node, r.plus) for r in kgraph.ref_walk(df, "id", "s", 4).collect()) == want
    assert kmers.letter_array(kmers.text_places("GATTACA" * 5, 31)[1], 31).to_pylist() == [("GATTACA" * 5)[i : i + 31] for i in range(5)]


@pytest.mark.parametrize(("name", "exchanges"), [("q_graph_guard", 1), ("q_graph_metrics", 1), ("q_kept_nodes", 2), ("q_supported_kmers", 1), ("q_ref_walk", 0)])
def test_kmers_are_shuffled_no_more_than_needed(spark, name, exchanges):
    df = catalog.QUERIES[name](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == exchanges and "Join" not in plan
