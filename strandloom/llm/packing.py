"""Mixture-controlled packing by deficit round-robin over source queues.

Each source is a queue of token ids. Windows of fixed length are filled so that each source gives its
target share; a source's deficit (what it was due and has not given) carries on from window to window,
and from partition to partition.

Partitions (bins) need no state from one another: of a phase's tokens of source s, bin j of P gets those
from floor(t*j/P) to floor(t*(j+1)/P), and the fraction cut off at its start, (t*j mod P)/P, is the
deficit that bin j begins with. Where targets are given, a source that runs dry ends a phase, and the
shares of those left are scaled up; there are at most as many phases as targets, and one for the sources
without a target, which come last, each in proportion to its tokens.

One bin's tokens (BIN_TOKENS and one a source at most) are the most that a task holds. Sources may be as uneven
and as many as they like: a bin takes slices of all, the plan is a table, and only the totals of the sources
that targets name come to the driver.

Defined cases: a null or empty text is the end id alone; a null source is queue ''; a null doc_id is carried along;
repeated rows and ties are separate documents, in input order; very long texts are cut freely; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandloom.llm.common import Scratch, stored
from strandloom.llm.tokens import id_dtype, token_table, vocabulary_size

WINDOW = 1024
BIN_TOKENS = 1 << 20
#: Rows of small tables that may be broadcast; beyond it they are joined by shuffle.
BROADCAST_ROWS = 200_000
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string"


def phases(totals: dict[str, int], targets: dict[str, float] | None, bin_tokens: int) -> list[tuple]:
    """(source, begin in its queue, tokens, first bin, bins) of each phase and source."""
    left, begun, out, base = dict(totals), dict.fromkeys(totals, 0), [], 0
    while active := {s: n for s, n in left.items() if n}:
        weight = {s: (targets or totals).get(s, 0) for s in active}
        if not any(weight.values()):  # sources without a target come last, in proportion
            weight = dict(active)
        due = {s: w for s, w in weight.items() if w > 0}
        scale = min(active[s] / w for s, w in due.items())
        take = {s: min(active[s], round(w * scale)) for s, w in due.items()}
        take = {s: n for s, n in take.items() if n} or {s: active[s] for s in due}
        bins = max(1, -(-sum(take.values()) // bin_tokens))
        for s, n in sorted(take.items()):
            out.append((s, begun[s], n, base, bins))
            begun[s] += n
            left[s] -= n
        base += bins
    return out


def plan_table(totals: DataFrame, targets: dict[str, float] | None, bin_tokens: int) -> DataFrame:
    """source, begin, take, first_bin, bins of each phase and source of totals (source, n)."""
    spark, rows, base = totals.sparkSession, [], 0
    rest = totals
    if targets:
        named = [s for s, w in targets.items() if w > 0]
        own = {r["source"]: r["n"] for r in totals.filter(F.col("source").isin(named)).collect()}
        rows = phases(own, targets, bin_tokens)
        base = max((first + bins for *_, first, bins in rows), default=0)
        rest = totals.filter(~F.col("source").isin(named))
    bins = max(1, -(-(rest.agg(F.sum("n")).head()[0] or 0) // bin_tokens))
    left = rest.select("source", F.lit(0).cast("long").alias("begin"), F.col("n").alias("take"), F.lit(base).cast("long").alias("first_bin"), F.lit(bins).cast("long").alias("bins"))
    return left.unionByName(spark.createDataFrame(rows, "source string, begin long, take long, first_bin long, bins long")) if rows else left


def quotas(counts: np.ndarray, deficits: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows, sources and tokens (never 0) that a source gives to a window, by deficit round-robin."""
    total = int(counts.sum())
    share = counts / max(1, total)
    left, due, out = counts.copy(), deficits.copy(), []
    for w in range(-(-total // window)):
        size = min(window, total - w * window)
        due += share * size
        give = np.minimum(np.maximum(np.floor(due), 0).astype(np.int64), left)
        short = size - int(give.sum())
        while short:  # rounds over the queues that are not empty, the most indebted first
            step = 1 if short > 0 else -1
            able = np.flatnonzero(left - give > 0 if step > 0 else give > 0)
            order = able[np.argsort(-step * (due - give)[able], kind="stable")][: abs(short)]
            give[order] += step
            short -= step * len(order)
        given = np.flatnonzero(give)
        out.append((np.full(len(given), w), given, give[given]))
        left -= give
        due -= give
    return tuple(np.concatenate([np.zeros(0, np.int64), *(o[k] for o in out)]) for k in range(3))


def pack(docs: DataFrame, tokenizer: str, targets: dict[str, float] | None = None, end_id: int = 0, window: int = WINDOW, bin_tokens: int = BIN_TOKENS) -> DataFrame:
    """Pieces of documents: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, source.

    targets: weights by source; None takes each source in proportion to its tokens.
    """
    with Scratch(docs.sparkSession, "packing") as scratch:
        return stored(_packed(docs, tokenizer, targets, end_id, window, bin_tokens, scratch), "packing-pieces")


def _packed(docs: DataFrame, tokenizer: str, targets: dict[str, float] | None, end_id: int, window: int, bin_tokens: int, scratch: Scratch) -> DataFrame:
    dtype = id_dtype(vocabulary_size(tokenizer))
    width = np.dtype(dtype).itemsize
    tokens = scratch.stored(token_table(docs, tokenizer, end_id), "tokens")
    by_task = scratch.stored(tokens.groupBy("source", "task").agg(F.sum("n_tokens").alias("n")), "totals")
    totals = by_task.groupBy("source").agg(F.sum("n").alias("n"))
    parts = scratch.stored(plan_table(totals, targets, bin_tokens), "plan")
    planned = parts.count()
    before = F.sum("n").over(W.partitionBy("source").orderBy("task").rowsBetween(W.unboundedPreceding, -1))
    bases = by_task.select("source", "task", F.coalesce(before, F.lit(0)).alias("base"))
    small = by_task.count() <= BROADCAST_ROWS
    placed = tokens.join(F.broadcast(bases) if small else bases, ["source", "task"])
    placed = placed.withColumn("at", F.col("base") + F.col("pos")).join(F.broadcast(parts) if planned <= BROADCAST_ROWS else parts, "source")
    # Exact integers of up to 38 digits: products of positions and bins pass 64 bits at large sizes.
    bin_of = lambda r: f"int((cast({r} + 1 as decimal(19,0)) * cast(bins as decimal(10,0)) - 1) div take)"
    edge = lambda j: f"((cast(take as decimal(19,0)) * cast({j} as decimal(10,0))) div bins)"
    pieces = (
        placed.withColumn("lo", F.expr("greatest(at, begin) - begin"))
        .withColumn("hi", F.expr("least(at + n_tokens, begin + take) - begin"))
        .filter("lo < hi")
        .withColumn("j", F.explode(F.expr(f"sequence({bin_of('lo')}, {bin_of('(hi - 1)')})")))
        .withColumn("a", F.expr(f"greatest(lo, {edge('j')})"))
        .withColumn("b", F.expr(f"least(hi, {edge('(j + 1)')})"))
        .filter("a < b")
        .select(
            (F.col("first_bin") + F.col("j")).alias("bin"),
            "source",
            F.col("a").alias("queue_pos"),
            # The deficit that the source has at the bin's start, in tokens.
            F.expr("cast(((cast(take as decimal(19,0)) * cast(j as decimal(10,0))) % bins) / bins as double)").alias("carried"),
            "doc_id",
            F.expr("a + begin - at").alias("start"),
            F.col("n_tokens").alias("doc_tokens"),
            F.expr(f"substring(ids, int((a + begin - at) * {width} + 1), int((b - a) * {width}))").alias("ids"),
        )
    )
    # No bin has more windows: a bin has bin_tokens and, for what its slices are rounded up by, one a source.
    stride = (bin_tokens + planned) // window + 2

    def fill(group: pa.Table) -> pa.Table:
        """The bin's queues lie one after the other, and so do the pieces that windows take of them."""
        number = group.column("bin")[0].as_py()
        group = group.sort_by([("source", "ascending"), ("queue_pos", "ascending")])
        source = np.array(group.column("source").to_pylist(), dtype=object)
        starts = np.flatnonzero(np.append(True, source[1:] != source[:-1]))
        ids = [np.frombuffer(x.as_buffer(), dtype) for x in group.column("ids").combine_chunks()]
        sizes = np.array([len(x) for x in ids], dtype=np.int64)
        w, column, n = quotas(np.add.reduceat(sizes, starts), group.column("carried").to_numpy()[starts].copy(), window)
        lead = np.cumsum(n) - n
        lead -= lead[np.searchsorted(w, w)]  # where in its window a piece begins
        order = np.lexsort((w, column))
        w, n, lead = w[order], n[order], lead[order]
        piece_at, doc_at = np.cumsum(n) - n, np.cumsum(sizes) - sizes
        cuts = np.union1d(doc_at, piece_at)
        queue = np.concatenate(ids).astype("<u4")
        ends = np.append(cuts[1:], len(queue))
        d, p = (np.searchsorted(x, cuts, side="right") - 1 for x in (doc_at, piece_at))
        view = memoryview(queue).cast("B")
        crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(cuts.tolist(), ends.tolist())]
        start, doc_tokens = (group.column(c).to_numpy() for c in ("start", "doc_tokens"))
        whole = group.select(["doc_id", "source"]).take(pa.array(d))
        numbers = (start[d] + cuts - doc_at[d], ends - cuts, np.array(crc, np.int64), doc_tokens[d], number * stride + w[p], lead[p] + cuts - piece_at[p])
        return pa.table([whole.column("doc_id"), *(pa.array(x, pa.int64()) for x in numbers), whole.column("source")], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source"])

    return pieces.groupBy("bin").applyInArrow(fill, SCHEMA)
