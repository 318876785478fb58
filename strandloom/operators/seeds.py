"""Reads to haplotypes by minimizers: seeds are joined by k-mer, seeds in line are chained, and the longest chain wins.

A sequence is sketched by its minimizers (functions.kmers), so a join meets few rows of a sequence. Seeds of a read and a
haplotype that go on in both, in order and with about the same distance, are one chain; a chain's score is the read's bases
that its seeds cover, less what the distance changes by from seed to seed (k at most each). Chains are a window over the seeds of one read and haplotype, no more than the read has minimizers
times the copies of a k-mer in the haplotype.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandloom.functions import kmers

#: Bases of a group's reads that meet in one task, and seeds that are chained at a time (those of one read at least).
PART, SEEDS = 1 << 22, 1 << 20


def minimizers(df: DataFrame, keys: list[str], text: str, k: int, w: int) -> DataFrame:
    """keys, place, kmer, plus of every sequence's minimizers; a null has none."""
    rows = df.select(*keys, text)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [kmers.text_minimizers(t or "", k, w) for t in b.column(len(keys)).to_pylist()]
            of = pa.array(np.repeat(np.arange(len(found)), [len(x[0]) for x in found]))
            place, number, plus = (np.concatenate([np.zeros(0, t), *(x[i] for x in found)]) for i, t in enumerate((np.int64, np.int64, bool)))
            yield pa.RecordBatch.from_arrays([*(c.take(of) for c in b.columns[: len(keys)]), pa.array(place), pa.array(number), pa.array(plus)], names=[*keys, "place", "kmer", "plus"])

    schema = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes[: len(keys)])
    return rows.mapInArrow(sketch, f"{schema}, place long, kmer long, plus boolean")


def seeds(reads: DataFrame, haplotypes: DataFrame, group: str, k: int, w: int) -> DataFrame:
    """group, read, hap, same (strand), at, on: places of shared minimizers of reads (group, read, seq) and the haplotypes
    (group, hap, seq) of their group. On the other strand, on counts backwards."""
    r = minimizers(reads, [group, "read"], "seq", k, w).select(group, "read", "kmer", F.col("place").alias("at"), F.col("plus").alias("p"))
    h = minimizers(haplotypes, [group, "hap"], "seq", k, w).select(group, "hap", "kmer", F.col("place").alias("on"), F.col("plus").alias("q"))
    same = F.col("p") == F.col("q")
    return r.join(h, [group, "kmer"]).select(group, "read", "hap", same.alias("same"), "at", F.when(same, F.col("on")).otherwise(-F.col("on")).alias("on"))


def chains(found: DataFrame, group: str, k: int, gap: int = 100) -> DataFrame:
    """group, read, hap, same, score, first, seeds of each chain: seeds in order of their diagonals, then of the read, part
    where the diagonal jumps by more than gap or the haplotype does not go on."""
    w = W.partitionBy(group, "read", "hap", "same").orderBy("at", "on")
    step = lambda c: F.col(c) - F.lag(c).over(w)
    new = (F.lag("at").over(w).isNull() | (step("on") <= 0) | (F.abs(step("on") - step("at")) > gap)).cast("int")
    rows = found.withColumn("new", new).withColumn("covers", F.least(F.lit(k), F.coalesce(step("at"), F.lit(k)))).withColumn("jump", F.abs(step("on") - step("at")))
    rows = rows.withColumn("chain", F.sum("new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    covers = F.when(F.col("new") == 1, F.lit(k)).otherwise(F.col("covers") - F.least(F.lit(k), F.col("jump")))
    return rows.groupBy(group, "read", "hap", "same", "chain").agg(F.sum(covers).alias("score"), F.min("on").alias("first"), F.count("*").alias("seeds")).drop("chain")


def best_haplotypes(reads: DataFrame, haplotypes: DataFrame, group: str, k: int = 11, w: int = 3, gap: int = 100) -> DataFrame:
    """group, read, hap, score: the haplotype with the longest of chains(); the smaller number (the reference being 0) at a tie.
    Reads without a seed have no row.

    Only sequences are shuffled: seeds, of which a repeat has the product of its copies, are found and chained beside the
    group's haplotypes, SEEDS of them at a time. A group whose reads have more than PART bases is dealt to several tasks by
    the reads' numbers, each with the haplotypes.
    """
    r, h = reads.select(group, "read", "seq").filter(F.col(group).isNotNull()), haplotypes.select(group, "hap", "seq").filter(F.col(group).isNotNull())
    large = r.groupBy(group).agg(F.floor(F.sum(F.length("seq")) / PART).cast("int").alias("more")).filter("more > 0")
    part, parts = F.lit(0), F.array(F.lit(0))
    if not large.isEmpty():
        large = F.broadcast(large)  # PART bases a row at least
        r, h = r.join(large, group, "left"), h.join(large, group, "left")
        more = F.coalesce("more", F.lit(0))
        part, parts = F.pmod(F.hash("read"), more + 1), F.sequence(F.lit(0), more)
    r, h = r.select(group, part.alias("part"), "read", "seq"), h.select(group, F.explode(parts).alias("part"), "hap", "seq")
    kinds = [(group, dict(r.dtypes)[group]), ("read", dict(r.dtypes)["read"]), ("hap", dict(h.dtypes)["hap"]), ("score", "bigint")]

    def run(own: pa.Table, haps: pa.Table) -> pa.Table:
        found = [np.zeros((3, 0), np.int64)]
        names, ids = _numbered(haps.column("hap").to_pylist())
        _, who = _numbered(own.column("read").to_pylist())
        if len(names) and len(who):
            order = np.argsort(who, kind="stable")
            found = list(_chained(_sketches(own.column("seq").take(pa.array(order)), who[order], k, w), _sketches(haps.column("seq"), ids, k, w), len(names), k, gap))
        of, hap, score = np.concatenate(found, axis=1)
        first = np.unique(who, return_index=True)[1]
        row = pa.array(first[of]) if len(of) else pa.array([], pa.int64())
        first_hap = np.unique(ids, return_index=True)[1]
        hap_row = pa.array(first_hap[hap]) if len(hap) else pa.array([], pa.int64())
        columns = [own.column(group).take(row), own.column("read").take(row), haps.column("hap").take(hap_row), pa.array(score)]
        return pa.table(columns, names=[n for n, _ in kinds])

    return r.groupBy(group, "part").cogroup(h.groupBy(group, "part")).applyInArrow(run, ", ".join(f"`{n}` {t}" for n, t in kinds))


def _numbered(values: list) -> tuple[list, np.ndarray]:
    """The distinct values in order, null last, and the number of each value."""
    names = sorted(set(values), key=lambda x: (x is None, x if x is not None else 0))
    at = {x: i for i, x in enumerate(names)}
    return names, np.array([at[x] for x in values], np.int64)


def _sketches(texts: pa.ChunkedArray, of: np.ndarray, k: int, w: int) -> tuple[np.ndarray, ...]:
    """Number of the sequence, place, k-mer and strand of all minimizers."""
    found = [kmers.text_minimizers(t or "", k, w) for t in texts.to_pylist()]
    return np.repeat(of, [len(x[0]) for x in found]), *(np.concatenate([x[i] for x in found]) for i in range(3))


def _chained(reads: tuple[np.ndarray, ...], haps: tuple[np.ndarray, ...], n_haps: int, k: int, gap: int) -> Iterator[np.ndarray]:
    """read, hap, score of the best of chains() of sketches, reads in order of their numbers; the smaller haplotype at a tie."""
    by = np.argsort(haps[2], kind="stable")
    hap, on, kmer, plus = (x[by] for x in haps)
    low = np.searchsorted(kmer, reads[2])
    many = np.searchsorted(kmer, reads[2], "right") - low
    starts = np.flatnonzero(np.diff(reads[0], prepend=-1))
    before = np.concatenate([[0], np.cumsum(many)])[np.append(starts, len(many))]  # seeds before each read
    a = 0
    while a < len(starts):
        z = max(a + 1, int(np.searchsorted(before, before[a] + SEEDS, "right")) - 1)
        own = slice(starts[a], starts[z] if z < len(starts) else len(many))
        n, a = many[own], z
        if not n.any():
            continue
        of = np.repeat(np.arange(len(n)), n)
        to = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + low[own][of]
        same = reads[3][own][of] == plus[to]
        at, place = reads[1][own][of], np.where(same, on[to], -on[to])
        line = (reads[0][own][of] * n_haps + hap[to]) * 2 + same
        low_line, far = line[0] // 2 // n_haps * n_haps * 2, int(np.abs(place).max())
        place_bits, at_bits = (2 * far).bit_length(), int(at.max()).bit_length()
        if int(line.max() - low_line).bit_length() + at_bits + place_bits < 64:  # one number a seed sorts faster than three
            key = np.sort((line - low_line << at_bits + place_bits) + (at << place_bits) + (place + far))
            line, at, place = (key >> at_bits + place_bits) + low_line, key >> place_bits & (1 << at_bits) - 1, (key & (1 << place_bits) - 1) - far
        else:
            order = np.lexsort((place, at, line))
            line, at, place = line[order], at[order], place[order]
        step, jump = np.diff(at, prepend=0), np.diff(place, prepend=0)
        new = (np.diff(line, prepend=-1) != 0) | (jump <= 0) | (np.abs(jump - step) > gap)
        points = np.where(new, k, np.minimum(k, step) - np.minimum(k, np.abs(jump - step)))
        first = np.flatnonzero(new)
        score, line = np.add.reduceat(points, first), line[first] >> 1
        read = line // n_haps
        heads = np.flatnonzero(np.diff(read, prepend=-1))
        best = np.maximum.reduceat(score * n_haps + n_haps - 1 - line % n_haps, heads)
        yield np.stack([read[heads], n_haps - 1 - best % n_haps, best // n_haps])
