"""Near-duplicate documents: improved consistent weighted sampling over TF-IDF shingles, in bands.

A document is the set of its five-word shingles (words are runs of word characters, in lower case; a
shorter text is one shingle). A shingle weighs its count times its smoothed inverse document frequency
1 + ln((1 + N) / (1 + df)) / ln(1 + N), in LEVELS levels: 2 where no other document has it, 1 where all have it. The scale is
kept this even on purpose (a choice of this library, made in idf_table()): with an unscaled logarithm a large group of
near copies, whose common shingles have a high df, would fall apart at its few edited words. df counts all documents, in a count-mean-min
sketch of SKETCH_ROWS rows of 2**SKETCH_BITS slots, so what is sent to tasks is bounded whatever the corpus;
its error, about the root of the shingles to a slot, is small in the logarithm.

BANDS * ROWS consistent samples of a document (Ioffe's scheme) give BANDS band keys; a pair of similarity
0.8 shares a band but for 2 in 10,000. The random triples of a sample stand in a table of TRIPLES slots;
shingles of equal slot and weight tie, and the smaller hash wins in every document, so ties do not change how
often two documents agree.

Documents with equal shingles and counts are one node from the start. In each band bucket the nodes are
compared with the bucket's leader, not all with all; similar ones are verified by the exact weighted
Jaccard similarity of whole texts, and components are taken of the verified links. Buckets whose nodes
are still in more than one component go through further rounds with other leaders (another for each
band), until no pair is new or ROUNDS are over. What is open then is resolved exactly by rest(): all pairs
of small buckets, and a weighted prefix-filtered join of the nodes of larger ones, which misses no pair of
the threshold. Nothing is capped, and members of a leader are dealt out in chunks, the leader's text goes to
each chunk.

Defined cases: null texts are empty; texts without words are alike only if equal; class ids are the
smallest doc_id of a class (null if all are null); repeated rows are copies, of which distinct_docs()
keeps one; very long texts count in full, sampled STEP shingles at a time; an empty table gives no rows;
other columns, whatever their names, are carried along by distinct_docs().
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandloom.llm.common import Scratch, free_names, stored
from strandloom.operators.relational import components

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 16, 4
#: Rows and slots of the sketch of document frequencies; slots that travel together.
SKETCH_ROWS, SKETCH_BITS, CHUNK_BITS = 2, 20, 14
ROUNDS = 4
#: Open buckets of at most so many nodes are compared in full; classes of the join grow by this ratio of weight.
SMALL, RATIO = 8, 1.03
#: Members of a leader that one task compares at once.
CHUNK = 512
#: Entries of a worker's cache of word hashes; shingles sampled at once; table of random triples.
CACHE, STEP, TRIPLES = 500_000, 4096, 1 << 16
#: Levels of idf, evenly from 1 to 2.
LEVELS = 256
WORD = re.compile(r"\w+")
PRIME = np.uint64(0x9E3779B97F4A7C15)


class _WordHashes(dict):
    """64-bit hashes of a unit's words, as bytes."""

    def __missing__(self, unit: str) -> bytes:
        out = np.array([xxhash.xxh64_intdigest(w) for w in WORD.findall(unit)], np.uint64).tobytes()
        if len(self) >= CACHE:
            self.clear()
        if len(unit) <= 80:
            self[unit] = out
        return out


@lru_cache(maxsize=1)
def _hashes() -> _WordHashes:
    return _WordHashes()


def words(text: str) -> np.ndarray:
    return np.frombuffer(b"".join(map(_hashes().__getitem__, text.lower().split())), np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return (x ^ (x >> np.uint64(29))) * PRIME


def shingle_hashes(text: str) -> np.ndarray:
    """Hashes of the shingles, in order."""
    h = words(text)
    if not len(h):
        return h
    k = min(SHINGLE, len(h))
    n = len(h) - k + 1
    value = np.zeros(n, np.uint64)
    for j in range(k):
        value = value * PRIME + h[j : j + n]
    return mix(value)


def shingle_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes in ascending order, and their counts."""
    return np.unique(shingle_hashes(text), return_counts=True)


def slots(found: np.ndarray) -> list[np.ndarray]:
    """A slot of each row of the sketch, from bits of the hash that differ."""
    shift = np.uint64(64 - SKETCH_BITS)
    return [((found << np.uint64(r * SKETCH_BITS)) >> shift).astype(np.intp) for r in range(SKETCH_ROWS)]


def codes(found: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Level of idf, from 0 for 1 to LEVELS - 1 for 2: that of the least of the sketch's counts."""
    return np.maximum.reduce([idf[r][at] for r, at in enumerate(slots(found))])


def shingles(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes in ascending order, their counts and their weights."""
    found, count = shingle_counts(text)
    return found, count, weights(count, codes(found, idf))


def weights(count: np.ndarray, code: np.ndarray) -> np.ndarray:
    return (count * (1 + code / np.float32(LEVELS - 1))).astype(np.float32)


@lru_cache(maxsize=1)
def _triples() -> tuple[np.ndarray, ...]:
    """By slot, of random r ~ Gamma(2,1), c ~ Gamma(2,1) and b ~ U(0,1): 1 / r, b, ln c + r (b - 1) and r; and a multiplier
    a sample."""
    g = np.random.default_rng(11)
    r, c, b = g.gamma(2.0, size=TRIPLES), g.gamma(2.0, size=TRIPLES), g.random(TRIPLES)
    odd = g.integers(0, 1 << 63, size=BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return *(x.astype(np.float32) for x in (1 / r, b, np.log(c) + r * (b - 1), r)), odd


def band_keys(found: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Keys of the bands: consistent weighted samples (shingle, level), ROWS to a key.

    A sample is the shingle with the least ln c - r (t - b + 1), t = floor(ln weight / r + b) being its level.
    """
    one_by_r, b_of, c_of, r_of, odd = _triples()
    k = len(odd)
    least, which, level = np.full(k, np.inf, np.float32), np.zeros(k, np.uint64), np.zeros(k, np.int64)
    column, shift = np.arange(k), np.uint64(64 - (TRIPLES - 1).bit_length())
    for at in range(0, len(found), STEP):
        s = found[at : at + STEP]
        slot = odd[:, None] * s
        slot >>= shift
        slot = slot.view(np.int64)
        t = one_by_r.take(slot, mode="clip")
        t *= np.log(weight[at : at + STEP])
        t += b_of.take(slot, mode="clip")
        np.floor(t, out=t)
        value = r_of.take(slot, mode="clip")
        value *= t
        np.subtract(c_of.take(slot, mode="clip"), value, out=value)
        row = value.argmin(axis=1)
        best = value[column, row]
        better = best < least
        least, which, level = np.where(better, best, least), np.where(better, s[row], which), np.where(better, t[column, row].astype(np.int64), level)
    sample = mix(which ^ mix(level.view(np.uint64) * PRIME)).reshape(BANDS, ROWS)
    key = np.zeros(BANDS, np.uint64)
    for j in range(ROWS):
        key = mix(key * PRIME + sample[:, j])
    return key.view(np.int64)


def similarity(a: tuple, b: tuple) -> float:
    """Weighted Jaccard similarity of two shingle sets."""
    (ha, _, wa), (hb, _, wb) = a, b
    if not len(ha) or not len(hb):
        return 0.0
    at = np.minimum(np.searchsorted(ha, hb), len(ha) - 1)
    both = ha[at] == hb
    inner = float(np.minimum(wa[at[both]], wb[both]).sum(dtype=np.float64))
    return inner / (float(wa.sum(dtype=np.float64)) + float(wb.sum(dtype=np.float64)) - inner)


def idf_table(docs: DataFrame) -> np.ndarray:
    """Level of the smoothed idf by slot of the sketch, of all documents: SKETCH_ROWS << SKETCH_BITS bytes."""
    size, piece = 1 << SKETCH_BITS, 1 << CHUNK_BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n, held, waiting = np.zeros((SKETCH_ROWS, size), np.int64), 0, [np.zeros(0, np.uint64)], 0

        def add() -> None:
            for r, at in enumerate(slots(np.concatenate(held))):
                total[r] += np.bincount(at, minlength=size)

        for b in batches:
            n += b.num_rows
            for text in b.column("text").to_pylist():
                held.append(np.unique(shingle_hashes(text or "")))
                waiting += len(held[-1])
                if waiting >= size:
                    add()
                    held, waiting = held[:1], 0
        add()
        parts = total.reshape(-1, piece)
        most = parts.max(axis=1)
        used = np.flatnonzero(most)
        kinds = [np.uint8 if m < 1 << 8 else np.uint16 if m < 1 << 16 else np.int64 for m in most[used].tolist()]
        data = [parts[k].astype(kind).tobytes() for k, kind in zip(used.tolist(), kinds)]
        # The number of documents goes with the first chunk number that is no chunk's.
        yield pa.RecordBatch.from_arrays([pa.array([*used.tolist(), len(parts)], pa.int32()), pa.array([*data, np.array([n], np.int64).tobytes()], pa.binary())], names=["chunk", "counts"])

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for k, data in zip(b.column("chunk").to_pylist(), b.column("counts").to_pylist()):
                kind = {1: np.uint8, 2: np.uint16, 8: np.int64}[len(data) // piece] if len(data) > 8 else np.int64
                total[k] = total.get(k, 0) + np.frombuffer(data, kind).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(total, pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], names=["chunk", "counts"])

    schema = "chunk int, counts binary"
    sums = docs.select("text").mapInArrow(count, schema).repartition(32, "chunk").mapInArrow(add_up, schema).toArrow()
    n, table = 0, np.zeros((SKETCH_ROWS * size // piece, piece))
    for k, data in zip(sums.column("chunk").to_pylist(), sums.column("counts").to_pylist()):
        if k == len(table):
            n = int(np.frombuffer(data, np.int64)[0])
        else:
            table[k] = np.frombuffer(data, np.int64)
    table = table.reshape(SKETCH_ROWS, size)
    table = np.maximum(1, table - table.sum(axis=1, keepdims=True) / size)  # less the other shingles of a slot, on average
    return np.clip(np.round((LEVELS - 1) * np.log((1 + n) / (1 + table)) / np.log(2 + n)), 0, LEVELS - 1).astype(np.uint8)


def keyed(docs: DataFrame, k1: str, k2: str) -> DataFrame:
    """docs with columns k1, k2: hashes of doc_id and text, never null."""
    key = [F.col("doc_id"), F.coalesce("text", F.lit(""))]
    return docs.withColumn(k1, F.xxhash64(*key)).withColumn(k2, F.hash(*key))


def signatures(docs: DataFrame, idf: np.ndarray) -> DataFrame:
    """doc_id, k1, k2, h1, h2 (128-bit digest of the shingles and counts), bands (null without words)."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            digests, bands = [], []
            for text in b.column("text").to_pylist():
                found, count, weight = shingles(text, idf)
                if len(found):
                    digests.append(xxhash.xxh3_128_digest(found.tobytes() + count.tobytes()))
                    bands.append(band_keys(found, weight))
                else:
                    digests.append(xxhash.xxh3_128_digest(b"text" + text.encode("utf-8", "surrogatepass")))
                    bands.append(None)
            h = np.frombuffer(b"".join(digests), ">i8").astype(np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(h[:, 0]), pa.array(h[:, 1]), pa.array(bands, pa.list_(pa.int64()))], names=["doc_id", "k1", "k2", "h1", "h2", "bands"])

    rows = keyed(docs.select("doc_id", "text"), "k1", "k2").select("doc_id", "k1", "k2", F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(sign, "doc_id long, k1 long, k2 int, h1 long, h2 long, bands array<long>")


def verified(pairs: DataFrame, texts: DataFrame, idf: np.ndarray, threshold: float) -> DataFrame:
    """Of the pairs (a, b, n), those whose weighted Jaccard similarity reaches the threshold.

    n bounds the partners of a in one bucket: a's pairs are dealt out in so many chunks of CHUNK.
    """
    once = pairs.groupBy("a", "b").agg(F.max(F.ceil(F.col("n") / CHUNK)).alias("m"))
    dealt = once.select("a", "b", "m", F.pmod(F.xxhash64("b"), F.col("m")).alias("chunk"))
    members = dealt.join(texts.select(F.col("node").alias("b"), "text"), "b").select("a", "m", "chunk", "b", "text")
    leaders = dealt.select("a", "m", "chunk").distinct().join(texts.select(F.col("node").alias("a"), "text"), "a")
    rows = members.unionByName(leaders.select("a", "m", "chunk", F.lit(None).cast("long").alias("b"), "text"))
    rows = rows.repartition("a", "m", "chunk").sortWithinPartitions("a", "m", "chunk", F.asc_nulls_first("b"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leader, own = None, None
        for batch in batches:
            out = []
            for a, b, text in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), batch.column("text").to_pylist()):
                if b is None:
                    if a != leader:
                        leader, own = a, shingles(text, idf)
                elif similarity(own, shingles(text, idf)) >= threshold:
                    out.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return rows.select("a", "b", "text").mapInArrow(compare, "a long, b long")


def prefixes(found: np.ndarray, weight: np.ndarray, order: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Join keys of a text, and the side of each: 0 and 1 for the lighter and heavier class of a pair, 2 within one.

    A pair of similarity t has an overlap of t / (1 + t) of both weights at least, so the first common shingle,
    in an order that all texts share (order, then hash), has so much weight from it on in both. For each class
    of weights that a partner can have, the shingles are keys that leave enough for the class's least weight.
    """
    at = np.lexsort((found, order))
    left = np.cumsum(weight[at][::-1], dtype=np.float64)[::-1]
    total, step = float(left[0]), np.log(RATIO)
    own = int(np.floor(np.log(total) / step))
    low, high = (int(np.floor(np.log(total * x) / step + e)) for x, e in ((threshold, -1e-6), (1 / threshold, 1e-6)))
    keys, sides = [], []
    for c in range(low, high + 1):
        need = threshold / (1 + threshold) * (total + RATIO**c) * (1 - 1e-5)
        mine = found[at[: int((left >= need).sum())]]
        pair = np.array([min(own, c), max(own, c)], np.int64).view(np.uint64)
        keys.append(mix(mix(mine * PRIME + pair[0]) + pair[1]))
        sides.append(np.full(len(mine), 2 if c == own else int(c < own), np.int8))
    return np.concatenate(keys).view(np.int64), np.concatenate(sides)


def prefix_pairs(texts: DataFrame, labels: DataFrame, idf: np.ndarray, threshold: float, scratch: Scratch) -> DataFrame:
    """Pairs a < b of nodes in different components that include all of the threshold."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for node, label, text in zip(*(b.column(c).to_pylist() for c in ("node", "label", "text"))):
                found, _, weight = shingles(text, idf)
                keys, sides = prefixes(found, weight, LEVELS - 1 - codes(found, idf), threshold)  # rare shingles first
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(sides), pa.array(np.full(len(keys), node)), pa.array(np.full(len(keys), label))], names=["key", "side", "node", "label"])

    rows = scratch.stored(texts.join(labels, "node").select("node", "label", "text").mapInArrow(emit, "key long, side byte, node long, label long"), "prefixes")
    open_ = rows.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high").select("key")
    rows = scratch.stored(rows.join(open_, "key"), "open-prefixes")
    x, y = rows.alias("x"), rows.alias("y")
    met = (F.col("x.side") == 0) & (F.col("y.side") == 1) | (F.col("x.side") == 2) & (F.col("y.side") == 2) & (F.col("x.node") < F.col("y.node"))
    found = x.join(y, (F.col("x.key") == F.col("y.key")) & met & (F.col("x.label") != F.col("y.label")))
    return found.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()


def rest(buckets: DataFrame, labels: DataFrame, tested: DataFrame, texts: DataFrame, idf: np.ndarray, threshold: float, scratch: Scratch) -> DataFrame | None:
    """Links between components inside the buckets that the leaders left open."""
    rows = buckets.select("band", "key", "node", "n").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    spread = rows.groupBy("band", "key").agg(F.min("label").alias("low"), F.max("label").alias("high"))
    # Two nodes have been compared by the first leader.
    rows = scratch.stored(rows.filter("n > 2").join(spread.filter("low <> high").select("band", "key"), ["band", "key"]), "open")
    if not rows.head():
        return None
    small, large = rows.filter(F.col("n") <= SMALL), rows.filter(F.col("n") > SMALL).select("node", "label").distinct()
    x, y = small.alias("x"), small.alias("y")
    same = (F.col("x.band") == F.col("y.band")) & (F.col("x.key") == F.col("y.key"))
    new = x.join(y, same & (F.col("x.node") < F.col("y.node")) & (F.col("x.label") != F.col("y.label"))).select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))
    if large.head():
        mine = texts.join(large.select("node"), "node", "left_semi")
        new = new.union(prefix_pairs(mine, large, idf, threshold, scratch))
    new = new.distinct().join(tested.select("a", "b"), ["a", "b"], "left_anti")
    sizes = new.groupBy("a").agg(F.count("*").alias("n"))
    new = scratch.stored(new.join(sizes, "a"), "pairs")
    return scratch.stored(verified(new, texts, idf, threshold), "links") if new.head() else None


def merged(labels: DataFrame, links: DataFrame, keep) -> DataFrame:
    """labels with the components that links join; only the components' names take part in the rounds."""
    of = lambda c: labels.select(F.col("node").alias(c), F.col("label").alias(f"{c}_label"))
    ends = [F.coalesce(f"{c}_label", c).alias(c) for c in ("a", "b")]
    tops = components(keep(links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(*ends)), keep)
    known = labels.join(tops.select(F.col("node").alias("label"), F.col("label").alias("top")), "label", "left")
    alone = tops.join(labels.select("node"), "node", "left_anti")
    return keep(known.select("node", F.coalesce("top", "label").alias("label")).unionByName(alone))


def classes(docs: DataFrame, scratch: Scratch, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """Of all documents: doc_id, k1, k2, h1, h2; and of all digests: h1, h2, class_id, and the keys k1, k2 of
    the one row of the class that is kept."""
    idf = idf_table(docs)
    signed = scratch.stored(signatures(docs, idf), "signatures")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k1", "k2")).alias("first")
    # Numbers are unique, and fixed once the table is written.
    nodes = signed.groupBy("h1", "h2").agg(first, F.first("bands").alias("bands")).withColumn("node", F.monotonically_increasing_id())
    nodes = scratch.stored(nodes, "nodes")
    buckets = nodes.select("node", F.posexplode("bands").alias("band", "key"))
    shared = buckets.groupBy("band", "key").agg(F.count("*").alias("n"), F.min("node").alias("leader")).filter("n > 1")
    buckets = scratch.stored(buckets.join(shared, ["band", "key"]), "buckets")
    pairs = buckets.filter("node <> leader").groupBy(F.col("leader").alias("a"), F.col("node").alias("b")).agg(F.max("n").alias("n"))
    pairs = scratch.stored(pairs, "pairs")
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    wanted = nodes.join(ends, "node").select("node", F.col("first.k1").alias("k1"), F.col("first.k2").alias("k2"))
    texts = keyed(docs.select("doc_id", "text"), "k1", "k2").select("k1", "k2", F.coalesce("text", F.lit("")).alias("text")).join(wanted, ["k1", "k2"])
    texts = scratch.stored(texts.groupBy("k1", "k2").agg(F.first("node").alias("node"), F.first("text").alias("text")).select("node", "text"), "texts")
    links = scratch.stored(verified(pairs, texts, idf, threshold), "links")
    keep = lambda df: scratch.stored(df, "components")
    labels = components(links, keep)
    tested = pairs
    for turn in range(1, ROUNDS):
        rows = buckets.select("band", "key", "node", "n").filter("n > 2").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        lead = F.min(F.struct(F.xxhash64("node", "band", F.lit(turn)).alias("h"), "node", "label")).alias("lead")
        open_ = rows.groupBy("band", "key").agg(lead, F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high")
        found = rows.join(open_.select("band", "key", "lead"), ["band", "key"]).filter("label <> lead.label")
        new = found.groupBy(F.least("node", "lead.node").alias("a"), F.greatest("node", "lead.node").alias("b")).agg(F.max("n").alias("n"))
        new = scratch.stored(new.join(tested.select("a", "b"), ["a", "b"], "left_anti"), "pairs")
        if not new.head():
            break
        more = scratch.stored(verified(new, texts, idf, threshold), "links")
        tested = tested.union(new)
        if more.head():
            labels = merged(labels, more, keep)
    more = rest(buckets, labels, tested, texts, idf, threshold, scratch)
    if more is not None and more.head():
        labels = merged(labels, more, keep)
    named = nodes.select("h1", "h2", "node", "first").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    kept = named.groupBy("label").agg(F.min("first").alias("kept"))
    by_digest = named.join(kept, "label").select("h1", "h2", F.col("kept.doc_id").alias("class_id"), F.col("kept.k1").alias("c1"), F.col("kept.k2").alias("c2"))
    return signed.drop("bands"), by_digest


def labelled(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, class_id, kept of every document."""
    with Scratch(docs.sparkSession, "dup") as scratch:
        rows, by_digest = classes(docs, scratch, threshold)
        kept = (F.col("k1") == F.col("c1")) & (F.col("k2") == F.col("c2"))
        return stored(rows.join(by_digest, ["h1", "h2"]).select("doc_id", "class_id", kept.alias("kept")), "dup-classes")


def distinct_docs(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs with one row of each class, that of the smallest doc_id."""
    k1, k2, row = free_names(docs, "k1", "k2", "row")
    with Scratch(docs.sparkSession, "dup") as scratch:
        _, by_digest = classes(docs, scratch, threshold)
        keep = stored(by_digest.select(F.col("c1").alias(k1), F.col("c2").alias(k2)).distinct(), "dup-kept")
    once = W.partitionBy(k1, k2).orderBy("doc_id")
    rows = keyed(docs, k1, k2).join(keep, [k1, k2], "left_semi").withColumn(row, F.row_number().over(once))
    return rows.filter(F.col(row) == 1).select(*docs.columns)
