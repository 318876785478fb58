"""Approximate nearest neighbours by largest cosine: inverted lists with an adaptive dimension scan.

Unit vectors are turned by a random rotation, so that any block of columns is a fair sample of a
distance. Spherical k-means on a bounded sample (SAMPLE vectors) gives the lists; every vector is put
into one. A query scans the lists nearest to it block by block of columns, and after each block a
hypothesis test drops the candidates whose distance, judged from the columns so far, exceeds that of the
nearest found. Survivors are scored exactly, on the original vectors in double precision.

Equal vectors are searched once: a vector is kept with its smallest ids, as many as a query can need, so
that one vector that a third of the rows share is one candidate and one query. How many lists are probed is
measured: TRIALS queries are held against all vectors, and so many lists are probed that HELD of their true
neighbours lie in them. Lists are cut into blocks of BLOCK candidates, and the queries that probe a list, which are
counted first, into chunks of QUERIES, so no task holds a whole list and a list is copied as often as its own queries
need. A query that finds fewer
neighbours than asked for is searched again in all lists and without the test, which is exact.

There are about as many lists as the root of the number of vectors, and LISTS at most, since SAMPLE vectors
train them; a table small enough that PROBES are all its lists is searched whole.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components take no part,
nor do those whose length is not the most common one; rows with a null id take no part; rows that
repeat an id and a vector are one row; an id on several vectors is as many rows, each of which is a query of its own
and a candidate for the others; ties go to the smaller id; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandloom.llm.common import Scratch, stored

SAMPLE, LISTS, ROUNDS = 32_768, 4096, 8
#: Lists probed at least; share of the true neighbours of TRIALS queries that probed lists must hold.
PROBES, HELD, TRIALS = 48, 0.985, 256
BLOCK, QUERIES = 4096, 4096
#: Columns of a block of the scan, and the test's width: larger drops fewer true neighbours.
COLUMNS, WIDTH = 16, 2.1
#: Rows that the trials score at once; (query, list) pairs that a task makes at once.
STEP, PLACES = 1024, 1 << 18


def rotation(d: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(20).standard_normal((d, d)))
    return (q * np.sign(np.diag(r))).astype(np.float32)


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)  # keeps squares in range
    return (x / np.sqrt((x * x).sum(axis=1, keepdims=True))).astype(np.float32)


def kmeans(x: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means; x are unit vectors. Empty lists keep their centre."""
    centres = x[np.random.default_rng(7).choice(len(x), k, replace=False)].copy()
    for _ in range(ROUNDS if k > 1 else 0):
        near = np.concatenate([(x[i : i + 4096] @ centres.T).argmax(axis=1) for i in range(0, len(x), 4096)])
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norm > 0, sums / np.maximum(norm, 1e-30), centres)
    return centres


def cosines(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact cosines of q with the rows of x, the same for a pair wherever it stands."""
    q, x = q.astype(np.float64), x.astype(np.float64)
    return (x * q).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((q * q).sum()))


def scan(q: np.ndarray, block: np.ndarray, k: int, width: float = WIDTH) -> np.ndarray:
    """Rows of block that may be among the k nearest to q: adaptive scan by blocks of columns.

    With an infinite width only whole distances drop a candidate, so none of the k nearest is lost.
    """
    n, d = block.shape
    if n <= k:
        return np.arange(n)
    diff = block[:, :COLUMNS] - q[:COLUMNS]
    part = np.einsum("ij,ij->i", diff, diff)
    seeds = np.argpartition(part, k - 1)[:k]
    bound = float(((block[seeds] - q) ** 2).sum(axis=1).max())
    alive = np.arange(n)
    for at in range(COLUMNS, d, COLUMNS):
        keep = part * (d / at) <= bound * (1 + width / np.sqrt(at)) ** 2 + 1e-6
        alive, part = alive[keep], part[keep]
        diff = block[alive, at : at + COLUMNS] - q[at : at + COLUMNS]
        part = part + np.einsum("ij,ij->i", diff, diff)
    alive, part = alive[part <= bound + 1e-5], part[part <= bound + 1e-5]
    if len(alive) > k:
        last = np.partition(part, k - 1)[k - 1]
        alive = alive[part <= last + 1e-5]
    return alive


def valid(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding (double), h1, h2 of the vectors that take part."""
    v = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).filter("vec_id IS NOT NULL AND size(embedding) > 0")
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    v = v.filter(F.forall("embedding", fine) & F.exists("embedding", lambda x: x != 0))
    sizes = v.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").head()
    v = v.filter(F.size("embedding") == (sizes["d"] if sizes else 0))
    v = v.withColumn("embedding", F.transform("embedding", lambda x: x + F.lit(0.0)))  # one zero only
    return v.withColumn("h1", F.xxhash64("embedding")).withColumn("h2", F.hash("embedding"))


def distinct_vectors(v: DataFrame, keep: int) -> DataFrame:
    """ids (the smallest, at most keep), h1, h2, embedding: one row for each distinct vector.

    Each batch keeps at most keep ids of a vector before rows are shuffled.
    """

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = pa.table([b.column("h1"), b.column("h2"), b.column("vec_id")], names=["h1", "h2", "vec_id"]).to_pandas()
            rank = keys.drop_duplicates().sort_values("vec_id").groupby(["h1", "h2"]).cumcount()
            yield b.take(pa.array(np.sort(rank.index[rank < keep].to_numpy()), pa.int64()))

    few = v.mapInArrow(local, v.schema)
    return few.groupBy("h1", "h2").agg(F.slice(F.array_sort(F.collect_set("vec_id")), 1, keep).alias("ids"), F.first("embedding").alias("embedding"))


def search(vectors: DataFrame, is_query, k: int) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest to each row that is_query (a condition) selects."""
    keep = k + 1  # one of them may be the query itself
    v = valid(vectors)
    own = v.filter(is_query).select(F.col("vec_id").alias("query_id"), "h1", "h2").distinct()
    spark = vectors.sparkSession
    with Scratch(spark, "ann") as scratch:
        return stored(_search(distinct_vectors(v, keep), own, k, scratch), "ann-found")


def _search(vectors: DataFrame, own: DataFrame, k: int, scratch: Scratch) -> DataFrame:
    """The k nearest of own's queries among distinct vectors."""
    keep, spark = k + 1, vectors.sparkSession
    # A number for each distinct vector, fixed once the table is written.
    found = scratch.stored(vectors.withColumn("rid", F.monotonically_increasing_id()), "vectors")
    n = found.count()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    share = SAMPLE / n
    some = found if share >= 1 else found.filter(F.pmod(F.xxhash64("h1", F.lit(3)), F.lit(1 << 30)) < int(share * (1 << 30)))
    sample = np.array([r[0] for r in some.select("embedding").orderBy(F.xxhash64("h1"), "h2").limit(SAMPLE).collect()])
    turn = rotation(sample.shape[1])
    lists = max(1, int(min(LISTS, len(sample) // 8, np.sqrt(n))))
    centres = kmeans(unit(sample) @ turn, lists)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = unit(_matrix(b.column("embedding"))) @ turn
                near = pa.array((x @ centres.T).argmax(axis=1), pa.int32())
                yield pa.RecordBatch.from_arrays([near, b.column("rid"), b.column("ids"), b.column("embedding")], names=["list", "rid", "ids", "embedding"])

    listed = scratch.stored(found.mapInArrow(assign, "list int, rid long, ids array<long>, embedding array<double>"), "lists")
    sizes = {r["list"]: r["count"] for r in listed.groupBy("list").count().collect()}  # at most LISTS rows
    queries = scratch.stored(found.join(own.select("h1", "h2").distinct(), ["h1", "h2"], "left_semi").select("rid", "h1", "h2", "embedding"), "queries")
    probes = enough_probes(listed, queries, centres, turn, keep) if lists > PROBES else lists
    hits = scratch.stored(_probe(listed, queries, centres, turn, sizes, probes, keep, scratch), "hits")
    if lists > probes:
        short = hits.groupBy("qid").agg(F.sum(F.size("ids")).alias("n")).filter(F.col("n") >= keep).select(F.col("qid").alias("rid"))
        rest = scratch.stored(queries.join(short, "rid", "left_anti"), "short")
        if rest.head():
            hits = hits.join(rest, hits.qid == rest.rid, "left_anti").unionByName(_probe(listed, rest, centres, turn, sizes, lists, keep, scratch, np.inf))
    best = W.partitionBy("qid").orderBy(F.desc("score"), F.col("ids")[0])
    near = hits.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= keep).select("qid", "score", "rid", F.explode("ids").alias("vec_id"))
    near = near.withColumn("r", F.row_number().over(W.partitionBy("qid").orderBy(F.desc("score"), "vec_id", "rid"))).filter(F.col("r") <= keep)
    by_vector = near.join(queries.select(F.col("rid").alias("qid"), "h1", "h2"), "qid")
    # All rows of one vector share its neighbours, a list of at most keep entries.
    shared = by_vector.groupBy("h1", "h2", "qid").agg(F.sort_array(F.collect_list(F.struct("r", "vec_id", "score", "rid"))).alias("near"))
    others = F.filter("near", lambda x: (x["vec_id"] != F.col("query_id")) | (x["rid"] != F.col("qid")))
    out = own.join(shared, ["h1", "h2"]).select("query_id", F.slice(others, 1, k).alias("near"))
    return out.select("query_id", F.posexplode("near").alias("p", "x")).select(
        "query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score")
    )


def enough_probes(listed: DataFrame, queries: DataFrame, centres: np.ndarray, turn: np.ndarray, keep: int) -> int:
    """Lists to probe, so that those of TRIALS queries hold HELD of the neighbours that all vectors give."""
    trials = np.array([r[0] for r in queries.select("embedding").orderBy(F.xxhash64("h1", F.lit(9)), "h2").limit(TRIALS).collect()])
    if not len(trials):
        return min(PROBES, len(centres))
    q = unit(trials) @ turn

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, at = np.full((len(q), keep), -np.inf, np.float32), np.full((len(q), keep), -1, np.int32)
        for b in batches:
            x, own = unit(_matrix(b.column("embedding"))) @ turn if b.num_rows else np.zeros((0, q.shape[1]), np.float32), b.column("list").to_numpy()
            for i in range(0, len(x), STEP):
                score = np.concatenate([best, q @ x[i : i + STEP].T], axis=1)
                lists = np.concatenate([at, np.broadcast_to(own[i : i + STEP], (len(q), len(own[i : i + STEP])))], axis=1)
                top = np.argpartition(-score, keep - 1, axis=1)[:, :keep]
                best, at = np.take_along_axis(score, top, axis=1), np.take_along_axis(lists, top, axis=1)
        row, col = np.nonzero(at >= 0)
        yield pa.RecordBatch.from_arrays([pa.array(row, pa.int32()), pa.array(at[row, col], pa.int32()), pa.array(best[row, col], pa.float32())], names=["q", "list", "score"])

    found = listed.select("list", "embedding").mapInArrow(nearest, "q int, list int, score float")
    best = W.partitionBy("q").orderBy(F.desc("score"), "list")
    true = found.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= keep).select("q", "list").toArrow()  # at most TRIALS * keep rows
    rank = np.argsort(np.argsort(-(q @ centres.T), axis=1), axis=1)
    needed = np.sort(rank[true.column("q").to_numpy(), true.column("list").to_numpy()]) + 1
    return int(min(len(centres), max(PROBES, needed[int(np.ceil(HELD * len(needed))) - 1])))


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _probe(listed: DataFrame, queries: DataFrame, centres: np.ndarray, turn: np.ndarray, sizes: dict[int, int], probes: int, keep: int, scratch: Scratch, width: float = WIDTH) -> DataFrame:
    """qid, rid, ids, score: of each block of a probed list the best of each query."""
    lists, spark = len(centres), listed.sparkSession

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return places(batches, centres, turn, probes)

    def find(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if mine.num_rows and theirs.num_rows:
            x, q = _matrix(mine.column("embedding")), _matrix(theirs.column("embedding"))
            turned, ids = unit(x) @ turn, mine.column("ids").combine_chunks()
            least = ids.flatten().to_numpy()[ids.offsets.to_numpy()[:-1] - ids.offsets[0].as_py()]
            for a, t, qid in zip(q, unit(q) @ turn, theirs.column("rid").to_pylist()):
                rows = scan(t, turned, keep, width)
                score = cosines(a, x[rows])
                order = np.lexsort((least[rows], -score))[:keep]
                out += zip([qid] * len(order), rows[order].tolist(), score[order].tolist())
        rows = pa.array([o[1] for o in out], pa.int64())
        got = mine.select(["rid", "ids"]).take(rows)
        return pa.table({"qid": pa.array([o[0] for o in out], pa.int64()), "rid": got.column("rid"), "ids": got.column("ids"), "score": pa.array([o[2] for o in out], pa.float64())})

    probed = scratch.stored(queries.select("rid", "embedding").mapInArrow(probe, "list int, rid long"), "places")
    asked = probed.groupBy("list").count().collect()  # at most LISTS rows
    cuts = spark.createDataFrame([(r["list"], *cut(sizes.get(r["list"], 0), r["count"])) for r in asked if sizes.get(r["list"])], "list int, blocks long, chunks long")
    cuts = F.broadcast(cuts)  # at most LISTS rows
    part = lambda of, n: F.pmod(F.xxhash64(of), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    cells = listed.join(cuts, "list").select("list", part("rid", "blocks").alias("block"), every("chunks").alias("chunk"), "rid", "ids", "embedding")
    asks = probed.join(cuts, "list").select("list", every("blocks").alias("block"), part("rid", "chunks").alias("chunk"), "rid")
    asks = asks.join(queries.select("rid", "embedding"), "rid")
    return cells.groupBy("list", "block", "chunk").cogroup(asks.groupBy("list", "block", "chunk")).applyInArrow(find, "qid long, rid long, ids array<long>, score double")


def probe_lists(q: np.ndarray, centres: np.ndarray, probes: int) -> np.ndarray:
    """The lists nearest to each row of q, in any order."""
    if probes >= len(centres):
        return np.tile(np.arange(len(centres)), (len(q), 1))
    return np.argpartition(-(q @ centres.T), probes - 1, axis=1)[:, :probes]


def places(batches: Iterator[pa.RecordBatch], centres: np.ndarray, turn: np.ndarray, probes: int) -> Iterator[pa.RecordBatch]:
    """list, rid of queries (rid, embedding): at most PLACES pairs at once, or those of one query."""
    step = max(1, PLACES // len(centres))
    for whole in batches:
        for i in range(0, whole.num_rows, step):
            b = whole.slice(i, step)
            to = probe_lists(unit(_matrix(b.column("embedding"))) @ turn, centres, probes)
            yield pa.RecordBatch.from_arrays([pa.array(to.ravel(), pa.int32()), pa.array(np.repeat(b.column("rid").to_numpy(), to.shape[1]))], names=["list", "rid"])


def cut(size: int, queries: int) -> tuple[int, int]:
    """Blocks of a list of so many vectors, and chunks of the queries that probe it: the list is sent once a chunk."""
    return max(1, -(-size // BLOCK)), max(1, -(-queries // QUERIES))
