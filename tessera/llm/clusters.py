"""Clustering around centroids, with Elkan's bounds.

Each vector carries an upper bound of the distance to its centroid and a lower bound to every centroid. A distance is calculated only if neither the bounds nor half the
distance between two centroids rule the other centroid out; bounds are rounded outwards and must differ strictly, so that ties are always calculated. What decides
is the squared distance in whole numbers. A round is one pass without a shuffle: bounds move by as much as centroids moved, then vectors are assigned and written; sums by
centroid are partial sums, of which the driver gets one row a centroid.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.folders import work_folder, written
from tessera.llm.common import long_array, released

#: By which part bounds are rounded outwards; far more than the error of the few operations that make one.
WIDER = 1e-12
#: Vectors that a task works on at once.
ROWS = 1 << 14
STATE = "vec_id long, v array<long>, cluster int, distance long, upper double, lower array<double>, calculated int"


def _squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances, row by row or to one vector, in whole numbers: longs where they can't overflow, else Python's."""
    if not x.size:
        return np.zeros(len(x), np.int64)
    most = max(int(x.max()), -int(x.min())) + max(int(c.max()), -int(c.min()))
    d = x - c if most < 1 << 62 else x.astype(object) - c.astype(object)
    if x.shape[-1] * most * most >= 1 << 63:
        d = d.astype(object)
    return (d * d).sum(axis=-1)


def _root(squared: np.ndarray, side: float) -> np.ndarray:
    """Distances rounded down (side < 0) or up (side > 0)."""
    return np.sqrt(squared.astype(np.float64)) * (1 + side * WIDER)


def assign(x: np.ndarray, centroids: np.ndarray, at: np.ndarray | None, upper: np.ndarray, lower: np.ndarray, moved: np.ndarray, exact: bool) -> tuple[np.ndarray, ...]:
    """Nearest centroid (the smaller number on ties), squared distance, bounds and number of distances calculated of each vector.

    at is None in the first round; moved tells how far centroids went at most since the bounds were made. Squared distances that were not needed are -1, unless exact.
    """
    n, k = len(x), len(centroids)
    best, calculated = np.full(n, -1, object if x.dtype == object else np.int64), np.zeros(n, np.int32)

    def measured(rows: np.ndarray, c: np.ndarray) -> np.ndarray:
        d = _squared(x[rows], centroids[c])
        nonlocal best
        best = best.astype(object) if d.dtype == object else best
        lower[rows, c], calculated[rows] = _root(d, -1), calculated[rows] + 1
        return d

    def tighten(rows: np.ndarray) -> None:
        d = measured(rows, at[rows])
        best[rows], upper[rows], tight[rows] = d, _root(d, 1), True

    tight = np.zeros(n, bool)
    if at is None:
        at, lower = np.zeros(n, np.int32), np.zeros((n, k))
        tighten(np.arange(n))
    else:
        lower = np.maximum(lower * (1 - WIDER) - moved * (1 + WIDER), 0)
        upper = (upper + moved[at]) * (1 + WIDER)
    half = np.stack([_root(_squared(centroids, c), -1) for c in centroids]) / 2 * (1 - WIDER)
    for c in range(k):
        possible = lambda rows: rows[(at[rows] != c) & (upper[rows] >= lower[rows, c]) & (upper[rows] >= half[at[rows], c])]  # noqa: E731, B023
        rows = possible(np.arange(n))
        tighten(rows[~tight[rows]])
        rows = possible(rows)
        if len(rows):
            d = measured(rows, np.full(len(rows), c))
            better = (d < best[rows]) | (d == best[rows]) & (c < at[rows])
            rows, d = rows[better], d[better]
            at[rows], best[rows], upper[rows] = c, d, _root(d, 1)
    if exact:
        tighten(np.flatnonzero(~tight))
    return at, best, upper, lower, calculated


def _pass(centroids: list[list[int]], moved: list[float], first: bool, exact: bool):
    """One round over the vectors; first tells that there are no bounds yet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wide = max((abs(x) for c in centroids for x in c), default=0) >= 1 << 62
        k, centres = len(centroids), np.array(centroids, object if wide else np.int64)
        for whole in batches:
            for begin in range(0, whole.num_rows, ROWS):
                batch = whole.slice(begin, ROWS)
                n = batch.num_rows
                x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
                if first:
                    state = (None, np.zeros(n), np.zeros((n, k)))
                else:
                    state = (long_array(batch.column(2)).astype(np.int32), batch.column(4).to_numpy(zero_copy_only=False).copy(), batch.column(5).flatten().to_numpy(zero_copy_only=False).reshape(n, k).copy())
                at, best, upper, lower, calculated = assign(x, centres, *state, np.array(moved), exact)
                before = 0 if first else batch.column(6).to_numpy()
                if best.dtype == object and max(best) >= 1 << 63:
                    raise ValueError("a squared distance is beyond a long")
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * k), pa.array(lower.ravel()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(at, pa.int32()), pa.array(best.astype(np.int64)), pa.array(upper), lists, pa.array((before + calculated).astype(np.int32))], names=[f.split()[0] for f in STATE.split(", ")]
                )

    return lambda batches: released(run(batches))


def digest(centroid: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()


def clustered(vectors: DataFrame, k: int = 16, rounds: int = 3, dim: int = 64, scale: float = 64, seed: str = "1", vec_id: str = "vec_id", embedding: str = "embedding") -> tuple[DataFrame, list[list[int]]]:
    """The written state of all vectors (vec_id, v, cluster, distance, bounds, calculated: distances calculated in all rounds) and the final centroids; see centroid_clusters."""
    spark, folder = vectors.sparkSession, work_folder(vectors.sparkSession, "clusters")
    x = F.col(embedding).cast("array<double>")
    sound = F.col(embedding).isNotNull() & (F.size(x) == dim) & ~F.coalesce(F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))), F.lit(True))
    whole = F.transform(x, lambda v: F.when(F.abs(v * scale) < float(1 << 62), F.floor(v * scale).cast("long")).otherwise(F.raise_error(F.lit("a component is beyond a long")).cast("long")))
    base = written(vectors.where(sound).select(F.col(vec_id).cast("long").alias("vec_id"), whole.alias("v")), f"{folder}/vectors")
    starts = base.orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256).asc_nulls_last(), "v").limit(k).collect()  # k rows
    centroids, moved, state = [list(r.v) for r in starts], [0.0] * len(starts), base
    for i in range(rounds + 1):
        if i:
            sums = [F.sum(F.col("v")[j].cast("decimal(38,0)")).alias(f"s{j}") for j in range(dim)]
            old = centroids
            centroids = [*old]
            for row in state.groupBy("cluster").agg(F.count("*").alias("n"), *sums).collect():  # a row for each centroid
                centroids[row.cluster] = [int(row[f"s{j}"]) // row.n for j in range(dim)]
            moved = [float(_root(np.array([sum((p - q) ** 2 for p, q in zip(a, b, strict=True))], object), 1)[0]) for a, b in zip(old, centroids, strict=True)]
        state = written(state.mapInArrow(_pass(centroids, moved, first=not i, exact=i == rounds), STATE), f"{folder}/round-{i}")
    return state, centroids


def centroid_clusters(vectors: DataFrame, k: int = 16, rounds: int = 3, dim: int = 64, scale: float = 64, seed: str = "1", vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of each vector of dim components.

    Components count as floor(scale * x). Vectors that are null, of another size, or with null or non-finite components take no part. Centroids start as the k vectors with the smallest
    SHA-256 of `seed:vec_id` (rows that share an id by their components, those without an id last); with fewer vectors there are fewer. Each round assigns every vector to the nearest centroid by
    squared distance, the smaller number on ties, and moves centroids to the floor of their vectors' mean; empty ones stay. Vectors are assigned once more at the end. Repeated rows are
    vectors of their own. No vector left gives no rows. Components of 2^62 or more and distances beyond a long are errors. Other columns are not looked at.
    """
    state, centroids = clustered(vectors, k, rounds, dim, scale, seed, vec_id, embedding)
    spark = state.sparkSession
    sums = {r.cluster: int(r.s) for r in state.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # a row for each centroid
    if max([0, sum(sums.values())]) >= 1 << 63:
        raise ValueError("the inertia is beyond a long")
    known = spark.createDataFrame([(i, sums.get(i, 0), sum(sums.values()), digest(c)) for i, c in enumerate(centroids)], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return state.select("vec_id", "cluster", "distance").join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
