"""Kinds and lengths of alleles against plain Python, and how they are computed."""

import itertools

from pyspark.sql import functions as F

from strandloom.functions import seq


def told(ref: str, alt: str) -> tuple[str, int]:
    size = len(alt) - len(ref)
    while ref and alt and ref[0] == alt[0]:
        ref, alt = ref[1:], alt[1:]
    while ref and alt and ref[-1] == alt[-1]:
        ref, alt = ref[:-1], alt[:-1]
    kind = "REF" if not ref and not alt else "INS" if not ref else "DEL" if not alt else "CPX" if len(ref) != len(alt) else "SNV" if len(ref) == 1 else "MNP"
    return kind, size if size else len(alt)


def test_kinds_and_lengths_equal_plain_python(spark):
    texts = ["".join(t) for n in range(5) for t in itertools.product("AC", repeat=n)]
    df = spark.createDataFrame([(a, b) for a in [*texts, None] for b in [*texts, None]], "ref string, alt string")
    rows = df.select("ref", "alt", seq.classify(F.col("ref"), F.col("alt")).alias("kind"), seq.variant_length(F.col("ref"), F.col("alt")).alias("size")).collect()
    assert len(rows) == (len(texts) + 1) ** 2
    for r in rows:
        if r.ref is not None and r.alt is not None:
            assert (r.kind, r.size) == told(r.ref, r.alt), r
        else:
            assert r.size is None


def test_plain_alleles_are_not_cut(spark):
    """Cores are cut by lambdas, row by row; alleles that are told apart by their ends come before that."""
    for of in (seq.classify, seq.variant_length):
        first = spark.range(1).select(of(F.col("id").cast("string"), F.lit("AC")).alias("x"))._jdf.queryExecution().analyzed().toString().split("lambda")[0]
        assert first.count("WHEN") >= 4, of
