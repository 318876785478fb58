"""Centroid clustering: exact k-means of integer vectors by Exponion search.

Every vector keeps its centroid, an upper bound of the distance to it and a lower bound of the distance to the second
nearest. While the upper bound stays below both the lower bound and half the distance from its centroid to the next one,
nothing is computed. Otherwise the bound is made exact, and if that does not settle it, only centroids in a ball around
the current one are scanned: its radius is twice the upper bound plus the distance to the next centroid, and the sorted
list of distances from each centroid tells how many centroids lie in it. The ball holds the nearest and the second
nearest. Its radius is inclusive and no test passes at equality, so ties are seen and go to the smaller number; bounds
are rounded outwards, so rounding can't hide a centroid.

Vectors with their bounds are a written table, read and written again each round, while the table before goes. Tasks
send the sums of their vectors by cluster; only centroids and these sums (k rows of d columns) come to the driver.
Distances and sums are exact 64-bit integers (floats where they are exact too).

Defined cases: vectors that are null, of another length than asked for, or hold null or non-finite components take no
part, nor do those with a component that, scaled, leaves the bits() for which a long holds all distances (27 bits with 64
components). Rows with a null id take part, but as first centroids only if other vectors are too few. Equal hashes (repeated ids) go by components. Fewer vectors than centroids
make fewer clusters, an empty table gives no rows; empty clusters keep their centroid; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm.common import Scratch, remove, stored

#: Bounds are moved outwards by this share.
SLACK = 1e-9
#: Vectors that a task handles at once.
STEP = 8192
STATE = "vec_id long, point binary, cluster int, upper double, lower double"


def bits(d: int) -> int:
    """Bits of a component, so that d squared differences add up to less than 2**63."""
    return (61 - (d - 1).bit_length()) // 2


def quantized(vectors: DataFrame, d: int, scale: float) -> DataFrame:
    """vec_id, point (little-endian 32-bit floor(scale * x)) of the vectors of d components that take part."""
    x = F.col("embedding").cast("array<double>")
    fine = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    small = lambda c: F.abs(c * scale) < float(1 << bits(d))
    rows = vectors.select("vec_id", x.alias("x")).filter((F.size("x") == d) & F.forall("x", fine)).filter(F.forall("x", small))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = np.floor(b.column("x").flatten().to_numpy(zero_copy_only=False) * scale).astype("<i4").reshape(b.num_rows, d)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), _binary(m)], names=["vec_id", "point"])

    return rows.mapInArrow(pack, "vec_id long, point binary")


def _binary(m: np.ndarray) -> pa.Array:
    width = m.shape[1] * 4
    return pa.Array.from_buffers(pa.binary(), len(m), [None, pa.py_buffer((np.arange(len(m) + 1) * width).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(m))])


def _points(column: pa.Array, d: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i4").astype(np.int64).reshape(len(column), d)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of x from those of c; by floats where all terms stay below 2**53."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(c).max(initial=0)))
    if x.shape[1] * most * most < 1 << 50:
        xf, cf = x.astype(np.float64), c.astype(np.float64)
        return ((xf * xf).sum(axis=1)[:, None] - 2 * (xf @ cf.T) + (cf * cf).sum(axis=1)).astype(np.int64)
    out = np.empty((len(x), len(c)), np.int64)
    for j, row in enumerate(c):
        out[:, j] = ((x - row) ** 2).sum(axis=1)
    return out


def up(x: np.ndarray) -> np.ndarray:
    return x * (1 + SLACK)


def down(x: np.ndarray) -> np.ndarray:
    return x * (1 - SLACK)


class Ball:
    """Centroids, for each the others in order of distance, and the distance to the next one."""

    def __init__(self, centroids: np.ndarray):
        self.c, k = centroids, len(centroids)
        away = np.sqrt(squared(centroids, centroids).astype(np.float64))
        away[np.arange(k), np.arange(k)] = -1  # stands first in its own list
        self.order = np.argsort(away, axis=1, kind="stable")
        self.away = np.take_along_axis(away, self.order, axis=1)
        self.next = self.away[:, 1] if k > 1 else np.full(k, np.inf)


def nearest_two(d: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of the nearest (ties: the smaller number), its squared distance and that of the second nearest."""
    least = d.min(axis=1)
    who = np.where(d == least[:, None], number, np.iinfo(np.int64).max).min(axis=1)
    if d.shape[1] == 1:
        return who, least, np.full(len(d), np.inf)
    two = np.partition(d, 1, axis=1)[:, 1].astype(np.float64)
    return who, least, two


def exponion(x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, ball: Ball) -> int:
    """Moves each row to its nearest centroid, in place; upper and lower must be bounds. Returns distances computed."""
    done, limit = 0, np.maximum(lower, down(ball.next / 2)[cluster])
    open_ = np.flatnonzero(~(upper < limit))
    for i in range(0, len(open_), STEP):
        own = open_[i : i + STEP]
        exact = np.zeros(len(own), np.int64)
        for a in np.unique(cluster[own]).tolist():
            mine = cluster[own] == a
            exact[mine] = squared(x[own[mine]], ball.c[a : a + 1])[:, 0]
        done += len(own)
        upper[own] = up(np.sqrt(exact.astype(np.float64)))
        own = own[~(upper[own] < limit[own])]
        radius = up(2 * upper[own] + ball.next[cluster[own]])
        held, inside = cluster[own].copy(), np.empty(len(own), np.int64)
        for a in np.unique(held).tolist():
            mine = held == a
            inside[mine] = np.searchsorted(ball.away[a], radius[mine], side="right")
        # Rows of a cluster whose balls hold about as many centroids are scanned together.
        rung = np.ceil(np.log2(np.maximum(inside, 1))).astype(np.int64)
        for a, r in np.unique(np.stack([held, rung], axis=1), axis=0).tolist():
            mine = np.flatnonzero((held == a) & (rung == r))
            number = ball.order[a, : int(inside[mine].max())]
            d = squared(x[own[mine]], ball.c[number])
            done += d.size
            cluster[own[mine]], least, two = nearest_two(d, number)
            upper[own[mine]] = up(np.sqrt(least.astype(np.float64)))
            lower[own[mine]] = down(np.sqrt(two))
    return done


def moved(upper: np.ndarray, lower: np.ndarray, cluster: np.ndarray, drift: np.ndarray) -> None:
    """Bounds after the centroids moved by drift, in place."""
    first = int(drift.argmax())
    rest = np.delete(drift, first).max(initial=0)
    upper += up(drift)[cluster]
    upper *= 1 + SLACK
    lower -= up(np.where(cluster == first, rest, drift[first]))
    lower *= 1 - SLACK
    np.maximum(lower, 0, out=lower)


def clusters(points: DataFrame, centroids: np.ndarray, rounds: int) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of points after so many rounds of k-means."""
    spark, d = points.sparkSession, centroids.shape[1]
    with Scratch(spark, "clusters") as scratch:
        state, path = None, None
        for turn in range(rounds + 1):
            ball, before = Ball(centroids), None if turn == 0 else last

            def assign(batches: Iterator[pa.RecordBatch], ball=ball, before=before) -> Iterator[pa.RecordBatch]:
                drift = None if before is None else np.sqrt(((ball.c - before) ** 2).sum(axis=1).astype(np.float64))
                for b in batches:
                    if not b.num_rows:
                        continue
                    x = _points(b.column("point"), d)
                    if drift is None:
                        cluster, upper, lower = np.zeros(len(x), np.int64), np.full(len(x), np.inf), np.zeros(len(x))
                        for i in range(0, len(x), STEP):
                            own = slice(i, i + STEP)
                            cluster[own], least, two = nearest_two(squared(x[own], ball.c), np.arange(len(ball.c)))
                            upper[own], lower[own] = up(np.sqrt(least.astype(np.float64))), down(np.sqrt(two))
                    else:
                        cluster, upper, lower = (b.column(c).to_numpy(zero_copy_only=False).copy() for c in ("cluster", "upper", "lower"))
                        cluster = cluster.astype(np.int64)
                        moved(upper, lower, cluster, drift)
                        exponion(x, cluster, upper, lower, ball)
                    yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("point"), pa.array(cluster, pa.int32()), pa.array(upper), pa.array(lower)], names=["vec_id", "point", "cluster", "upper", "lower"])

            rows = scratch.stored((points if state is None else state).mapInArrow(assign, STATE), f"round-{turn}")
            if path:
                remove(spark, path)
            state, path = rows, f"{scratch.path}/{scratch.count:04d}-round-{turn}"
            if turn < rounds:
                last, centroids = centroids, means(state, centroids)
        ball = Ball(centroids)

        def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x, cluster = _points(b.column("point"), d), b.column("cluster").to_numpy()
                far = ((x - ball.c[cluster]) ** 2).sum(axis=1)
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("cluster"), pa.array(far, pa.int64())], names=["vec_id", "cluster", "distance"])

        found = scratch.stored(state.mapInArrow(measure, "vec_id long, cluster int, distance long"), "measured")
        own = found.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia")).collect()  # a row a centroid at most
        names = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
        facts = [(r["cluster"], r["cluster_inertia"], sum(x["cluster_inertia"] for x in own), names[r["cluster"]]) for r in own]
        facts = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
        return stored(found.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"), "clusters-found")


def means(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Floors of the means of the vectors of every cluster; empty ones stay."""
    k, d = centroids.shape

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((k, d), np.int64), np.zeros(k, np.int64)
        for b in batches:
            cluster = b.column("cluster").to_numpy()
            x = _points(b.column("point"), d)[np.argsort(cluster, kind="stable")]
            count = np.bincount(cluster, minlength=k)
            used = np.flatnonzero(count)
            if len(used):
                total[used] += np.add.reduceat(x, (np.cumsum(count) - count)[used])
            n += count
        row = np.repeat(np.flatnonzero(n), d + 1)
        # The count goes as one more column.
        value = np.concatenate([total, n[:, None]], axis=1)[np.flatnonzero(n)].ravel()
        yield pa.RecordBatch.from_arrays([pa.array(row, pa.int32()), pa.array(np.tile(np.arange(d + 1), len(row) // (d + 1)), pa.int32()), pa.array(value, pa.int64())], names=["cluster", "part", "value"])

    sums = state.select("point", "cluster").mapInArrow(add, "cluster int, part int, value long")
    out, total = centroids.copy(), {}
    for cluster, part, value in sums.groupBy("cluster", "part").agg(F.sum("value").alias("value")).collect():  # k * (d + 1) rows at most
        total.setdefault(cluster, {})[part] = value
    for cluster, of in total.items():
        out[cluster] = [of[j] // of[d] for j in range(d)]
    return out


def first_centroids(points: DataFrame, k: int, seed: str, d: int) -> np.ndarray:
    """The k vectors whose id has the smallest hash behind the seed, in order of the hash."""
    name = F.coalesce(F.sha2(F.concat(F.lit(seed), F.col("vec_id").cast("string")).cast("binary"), 256), F.lit("~"))
    rows = points.select(name.alias("name"), "point").orderBy("name", "point").limit(k).collect()  # k vectors
    return np.array([np.frombuffer(r["point"], "<i4") for r in rows], np.int64).reshape(-1, d)


def cluster(vectors: DataFrame, k: int = 40, rounds: int = 5, d: int = 64, scale: float = 256.0, seed: str = "2:") -> DataFrame:
    """Exact k-means of vectors(vec_id, embedding): see clusters()."""
    spark = vectors.sparkSession
    with Scratch(spark, "points") as scratch:
        points = scratch.stored(quantized(vectors, d, scale), "points")
        centroids = first_centroids(points, k, seed, d)
        if not len(centroids):
            return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
        return clusters(points, centroids, rounds)


def oracle_sql(k: int = 40, rounds: int = 5, d: int = 64, scale: int = 256) -> str:
    """DuckDB SQL of the query: every round is a step of its own."""
    far = "list_sum([(x[1] - x[2]) * (x[1] - x[2]) for x in list_zip(p, c)])::BIGINT"
    steps = []
    for turn in range(rounds + 1):
        steps.append(f"""
    a{turn} AS MATERIALIZED (
        SELECT row, any_value(vec_id) AS vec_id, any_value(p) AS p, min(struct_pack(far := {far}, j := j)) AS best
        FROM v CROSS JOIN c{turn} GROUP BY row)""")
        if turn < rounds:
            steps.append(f"""
    c{turn + 1} AS MATERIALIZED (
        SELECT j, coalesce(m.c, c{turn}.c) AS c FROM c{turn} LEFT JOIN (
            SELECT j, list(x ORDER BY i) AS c FROM (
                SELECT best.j AS j, i, floor(sum(p[i])::DOUBLE / count(*))::BIGINT AS x FROM a{turn} CROSS JOIN range(1, {d + 1}) AS r(i) GROUP BY ALL)
            GROUP BY j) m USING (j))""")
    return f"""
    WITH v AS MATERIALIZED (
        SELECT row_number() OVER () AS row, vec_id, [floor({scale} * x::DOUBLE)::BIGINT for x in embedding] AS p FROM embeddings
        WHERE len(embedding) = {d} AND len([x for x in embedding if x IS NOT NULL AND isfinite(x)]) = {d}),
    c0 AS MATERIALIZED (
        SELECT (row_number() OVER (ORDER BY sha256('2:' || vec_id), row) - 1)::INT AS j, p AS c FROM v QUALIFY j < {k}),{",".join(steps)},
    f AS (SELECT vec_id, best.j AS cluster, best.far AS distance FROM a{rounds})
    SELECT vec_id, cluster, distance, sum(distance) OVER (PARTITION BY cluster)::BIGINT AS cluster_inertia, sum(distance) OVER ()::BIGINT AS inertia,
        sha256(array_to_string(c, ',')) AS centroid_sha256
    FROM f JOIN c{rounds} ON j = cluster"""
