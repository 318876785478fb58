"""Coloured k-mer graphs as tables: counts, edges, metrics, low complexity."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.functions import kmers, seq, stats


def supported_codes(reads: DataFrame, k: int) -> DataFrame:
    """reads(window_id, sample, role, qname, seq, quals) to counts by (window_id, kmer, sample), k-mers as numbers (31 bases at
    most; those with other letters than bases are none).

    A name counts once for a k-mer and role; k-mers whose summed error reaches one do not count. Most names have one read, whose
    k-mers are told apart where they are made; those of names with several are told apart by a shuffle.
    """
    name = ["window_id", "qname", "role"]
    rows = reads.select(*name, "sample", "seq", "quals")
    type_of = dict(rows.dtypes)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [kmers.supported(t, q, k) for t, q in zip(b.column("seq").to_pylist(), b.column("quals").to_pylist())]
            of = pa.array(np.repeat(np.arange(len(own)), [len(x) for x in own]))
            yield pa.RecordBatch.from_arrays([*(c.take(of) for c in b.columns[:4]), pa.array(np.concatenate([np.zeros(0, np.int64), *own]))], names=[*name, "sample", "kmer"])

    def made(df: DataFrame) -> DataFrame:
        return df.mapInArrow(make, ", ".join(f"`{c}` {type_of[c]}" for c in [*name, "sample"]) + ", kmer long")

    several = rows.groupBy(*name).agg(F.count("*").alias("n")).filter("n > 1").drop("n")
    if several.isEmpty():
        each = made(rows)
    else:
        same = lambda how: rows.alias("r").join(several.alias("m"), [F.col(f"r.{c}").eqNullSafe(F.col(f"m.{c}")) for c in name], how)
        mates = made(same("left_semi")).groupBy(*name, "kmer").agg(F.min("sample").alias("sample"))
        each = made(same("left_anti")).select("window_id", "sample", "kmer").unionByName(mates.select("window_id", "sample", "kmer"))
    return each.groupBy("window_id", "kmer", "sample").agg(F.count("*").alias("n"))


def supported_kmers(reads: DataFrame, k: int) -> DataFrame:
    """supported_codes() with k-mers as text."""
    return supported_codes(reads, k).withColumn("kmer", kmers.letters(F.col("kmer"), k))


def kept_nodes(counts: DataFrame, anchors: DataFrame | Column) -> DataFrame:
    """Nodes (window_id, kmer) that are no anchors, a table or what a condition on the node holds for, go if their total is
    below two, or every sample's count is one at most."""
    t = counts.groupBy("window_id", "kmer").agg(F.sum("n").alias("total"), F.max("n").alias("top"))
    weak = ((F.col("top") <= 1) & (F.col("total") > 0)) | (F.col("total") < 2)
    if isinstance(anchors, Column):
        return t.filter(anchors | ~weak).select("window_id", "kmer", "total")
    return t.join(anchors.withColumn("anchor", F.lit(True)), ["window_id", "kmer"], "left").filter(F.col("anchor").isNotNull() | ~weak).select("window_id", "kmer", "total")


def edges(df: DataFrame, key: str, text: str, k: int) -> DataFrame:
    """key, src, dst, src_plus, dst_plus: both directions of each distinct edge of neighbouring k-mers.

    Windows of k + 1 characters are made with their reverse complements, and distinct ones are told apart before
    anything is derived from them.
    """
    w = df.select(key, F.explode(seq.stranded_kmers(F.col(text), k + 1)).alias("w")).select(key, "w.plus", "w.minus").distinct()
    sub = lambda c, at: F.substring(c, at, k)
    a, ra, b, rb = sub("plus", 1), sub("minus", 2), sub("plus", 2), sub("minus", 1)
    e = w.select(key, F.least(a, ra).alias("src"), F.least(b, rb).alias("dst"), (a <= ra).alias("src_plus"), (b <= rb).alias("dst_plus"))
    mirror = e.select(key, F.col("dst").alias("src"), F.col("src").alias("dst"), (~F.col("dst_plus")).alias("src_plus"), (~F.col("src_plus")).alias("dst_plus"))
    return e.union(mirror).distinct()


def coded_edges(oriented: DataFrame, key: str) -> DataFrame:
    """edges() of tablegraph.oriented_edges(), whose k-mers are numbers: there each edge stands once in each direction. k must be
    odd, for a k-mer that is its own reverse complement has no second strand."""
    node = lambda a, b: F.least(a, b)
    return oriented.select(key, node("u", "ru").alias("src"), node("v", "rv").alias("dst"), (F.col("u") <= F.col("ru")).alias("src_plus"), (F.col("v") <= F.col("rv")).alias("dst_plus"))


def word_edges(words: DataFrame, key: str, k: int) -> DataFrame:
    """edges() of kmers.canonical_words(as_read=True) of k + 1 bases, for even k too."""
    a, ra = F.shiftright("word", 2), F.col("back").bitwiseAND((1 << 2 * k) - 1)
    b, rb = F.col("word").bitwiseAND((1 << 2 * k) - 1), F.shiftright("back", 2)
    edge = lambda src, dst, x, y: F.struct(src.alias("src"), dst.alias("dst"), x.alias("src_plus"), y.alias("dst_plus"))
    src, dst = F.least(a, ra), F.least(b, rb)
    return words.select(key, F.inline(F.array(edge(src, dst, a <= ra, b <= rb), edge(dst, src, b > rb, a > ra)))).distinct()


def ref_walk(refs: DataFrame, key: str, text: str, k: int) -> DataFrame:
    """key, step, node, plus: the walk of a sequence through its nodes, and on which strand it takes each; k-mers (31 bases at
    most) with other letters than bases are passed over."""
    rows = refs.select(key, text)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, t in enumerate(b.column(1).to_pylist()):
                step, f, r = kmers.text_places(t or "", k)
                if len(step):
                    own = b.column(0).take(pa.array(np.full(len(step), i)))
                    yield pa.RecordBatch.from_arrays([own, pa.array(step, pa.int32()), kmers.letter_array(np.minimum(f, r), k), pa.array(f <= r)], names=[key, "step", "node", "plus"])

    return rows.mapInArrow(walk, f"`{key}` {rows.dtypes[0][1]}, step int, node string, plus boolean")


def merged_kmer(a: Column, b: Column, a_plus: Column, b_plus: Column, k: int) -> Column:
    """Node a with its neighbour b, which overlaps it by k - 1 bases: b's rest goes behind a where the edge leaves a's own
    strand, else before it, on the strand that fits."""
    fits = F.when(a_plus == b_plus, b).otherwise(seq.reverse_complement(b))
    return F.when(a_plus, F.concat(a, F.substring(fits, F.lit(k), F.length(fits)))).otherwise(F.concat(F.substring(fits, F.lit(1), F.length(fits) - (k - 1)), a))


def merged_count(a: Column, b: Column, a_length: Column, b_length: Column) -> Column:
    """Integer mean of two nodes' counts, by the length that a has with b merged into it and b's own."""
    return F.floor((a * a_length + b * b_length) / (a_length + b_length))


def confidence(counts: DataFrame, keys: list[str], samples: int) -> DataFrame:
    """keys, total, ctrl, case, confidence of counts (keys, sample, role, n, in_ref): support by role, and support times
    the share of samples that show the node, one more for the reference's; 1 where no sample has it twice."""
    role = lambda r: F.coalesce(F.sum(F.when(F.col("role") == r, F.col("n"))), F.lit(0))
    g = counts.groupBy(*keys).agg(F.sum("n").alias("total"), role("CTRL").alias("ctrl"), role("CASE").alias("case"), F.max("n").alias("top"), F.count_if(F.col("n") > 0).alias("seen"), F.bool_or("in_ref").alias("ref"))
    value = F.when((F.col("total") > 0) & (F.col("top") <= 1), 1).when(F.col("total") == 0, 0).otherwise(F.floor(F.col("total") * F.col("seen") / F.lit(samples)) + F.col("ref").cast("int"))
    return g.select(*keys, "total", "ctrl", "case", value.cast("long").alias("confidence"))


def path_stats(depths: Column) -> Column:
    """struct(mean, sd, cv, median, quartile_cv) of an array of depths along a path: the upper median, the sample sd, a cv
    of two values or more, and (Q3 - Q1) / (Q3 + Q1) of four or more."""
    n = F.size(depths)

    def of(a: Column) -> Column:
        mean = F.aggregate(a, F.lit(0.0), lambda t, x: t + x) / n
        sd = F.when(n > 1, F.sqrt(F.aggregate(a, F.lit(0.0), lambda t, x: t + (x - mean) * (x - mean)) / (n - 1))).otherwise(0.0)
        at = lambda part: F.get(a, F.floor(n * part / 4).cast("int"))
        quartile = F.when((n >= 4) & (at(3) + at(1) > 0), (at(3) - at(1)) / (at(3) + at(1)))
        return F.struct(mean.alias("mean"), sd.alias("sd"), F.when((n > 1) & (mean > 0), sd / mean).alias("cv"), at(2).alias("median"), quartile.alias("quartile_cv"))

    return F.when(n > 0, seq.let(F.array_sort(depths), of))


def drop_nodes(edges_: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """Edges without those that touch a node of gone(key, node), at either end."""
    at = lambda end: gone.select(key, F.col("node").alias(end))
    return edges_.join(at("src"), [key, "src"], "left_anti").join(at("dst"), [key, "dst"], "left_anti")


def metrics(edges_: DataFrame, keys: list[str], coverage: DataFrame | Column | None = None) -> DataFrame:
    """Complexity by key: cyclomatic number, branch points, unitig ratio, degrees; with coverage(keys, node,
    cov), or an expression of a node's edges forwards (f) and backwards (r), also its variation and the ratio of tips to paths."""
    n = edges_.groupBy(*keys, F.col("src").alias("node")).agg(F.count_if("src_plus").alias("f"), F.count_if(~F.col("src_plus")).alias("r"))
    if isinstance(coverage, DataFrame):
        n = n.join(coverage, [*keys, "node"], "left")
    else:
        n = n.withColumn("cov", (coverage if coverage is not None else F.lit(None)).cast("double"))
    unitig, tip = (F.col("f") == 1) & (F.col("r") == 1), (F.col("f") == 0) | (F.col("r") == 0)
    e = F.floor(F.sum(F.col("f") + F.col("r")) / 2)
    return n.groupBy(*keys).agg(
        F.count("*").alias("nodes"), e.alias("edges"), F.greatest(e - F.count("*") + 1, F.lit(0)).alias("cc"), F.count_if((F.col("f") >= 2) | (F.col("r") >= 2)).alias("bp"),
        (F.count_if(unitig) / F.count("*")).alias("unitig_ratio"), F.max(F.greatest("f", "r")).alias("max_degree"),
        F.when(F.avg("cov") > 0, F.coalesce(F.stddev_samp("cov"), F.lit(0.0)) / F.avg("cov")).alias("coverage_cv"),
        F.when(F.avg(F.when(unitig, F.col("cov"))) > 0, F.avg(F.when(tip, F.col("cov"))) / F.avg(F.when(unitig, F.col("cov")))).alias("tip_ratio"),
    )


def entanglement(cc: Column, bp: Column, cv: Column, unitig_ratio: Column) -> Column:
    return F.log10(1 + cc * bp * cv / (unitig_ratio + 1e-6))


def too_complex(cc: Column, bp: Column) -> Column:
    return (cc >= 50) & (bp >= 50)


def longdust(df: DataFrame, key: str, text: str, k: int, gc: float = 0.5) -> DataFrame:
    """key, score: max(0, (sum ln c! - what random sequence has) / k-mers) of both strands; k-mers with other
    letters than bases don't count. What random sequence has is computed once for each number of k-mers."""
    counts = kmers.word_counts(df, key, text, k)
    # A reverse complement maps k-mers one to one, so both strands have the same counts and score.
    sums = counts.groupBy(key).agg(F.sum("c").alias("n"), F.sum(seq.log_factorial(F.col("c"))).alias("s"))

    def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("n"), pa.array([stats.expected_score(n, k, gc) for n in b.column("n").to_pylist()], pa.float64())], names=["n", "f"])

    expected = sums.select("n").distinct().mapInArrow(expect, "n long, f double")
    scored = sums.join(expected, "n")
    return scored.select(key, F.when(F.col("n") > 0, F.greatest(F.lit(0.0), (F.col("s") - F.col("f")) / F.col("n"))).otherwise(0.0).alias("score"))
