import random

from strandloom.operators import relational
from strandloom.sources.storage import Scratch


def run(spark, pairs):
    """Labels, and how many tables were written."""
    with Scratch(spark, "components") as scratch:
        edges = spark.createDataFrame(pairs, "a long, b long")
        labels = relational.components(edges, lambda df: scratch.stored(df, "x"))
        return {r.node: r.label for r in labels.collect()}, scratch.count


def test_a_long_chain_takes_few_rounds(spark):
    n = 10_000
    labels, written = run(spark, [(i, i + 1) for i in range(n - 1)])
    assert labels == dict.fromkeys(range(n), 0)
    assert written <= 20


def test_chains_in_any_order_and_stars(spark):
    names = list(range(600))
    random.Random(4).shuffle(names)
    pairs = list(zip(names, names[1:]))
    pairs += [(1000, 1000 + k) for k in range(1, 300)] + [(2000 + k, 2400) for k in range(50)]
    labels, _ = run(spark, pairs)
    assert {labels[x] for x in names} == {0}
    assert {labels[1000 + k] for k in range(300)} == {1000}
    assert {labels[2000 + k] for k in range(50)} == {2000} and labels[2400] == 2000
    assert run(spark, [])[0] == {}
