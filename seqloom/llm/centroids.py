"""k-means on integer vectors with Hamerly's bounds: the same result as exact assignment in each round.

A vector keeps one upper bound of the distance to its own centroid and one lower bound of that to
its second nearest. When centroids move, the bounds are loosened by how far they moved; only
vectors whose bounds meet are compared with all centroids again, in exact integers. Bounds are
rounded outwards, so they never decide a tie.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, column, small_batches, task

#: Components are multiplied by this and rounded down.
SCALE = 256
#: Each step of a bound is widened by this relative error, far above that of double precision.
SLACK = 1e-9
#: Squared lengths and products below this are exact in double precision.
_EXACT = float(1 << 51)


def largest(dimension: int) -> int:
    """The largest component, of either sign, with which squared distances fit a long."""
    return math.isqrt((1 << 62) // dimension) // 2


def integers(vector: Column, dimension: int) -> Column:
    """floor(SCALE * x) of each component, null for vectors of another length or with a null, NaN or
    infinite component. Numbers beyond largest() become that."""
    x = vector.cast("array<double>")
    usable = (F.size(x) == dimension) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    most = F.lit(float(largest(dimension)))
    return F.when(F.coalesce(usable, F.lit(False)), F.transform(x, lambda v: F.floor(F.greatest(F.least(v * SCALE, most), -most)).cast("int")))


def squared(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of each vector to each centroid.

    Where every product is exact in double precision that is a matrix product; otherwise integers."""
    most = max(np.abs(x).max(initial=0), np.abs(centroids).max(initial=0))
    if float(most) ** 2 * 4 * x.shape[1] < _EXACT:
        a, b = x.astype(np.float64), centroids.astype(np.float64)
        return ((a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * (a @ b.T)).astype(np.int64)
    return np.stack([((x - c) ** 2).sum(1) for c in centroids], axis=1)


def own_distance(x: np.ndarray, centroids: np.ndarray, cluster: np.ndarray) -> np.ndarray:
    return ((x - centroids[cluster]) ** 2).sum(1)


def step(x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, centroids: np.ndarray, moved: np.ndarray, half: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The nearest centroids (ties: the smaller number), new bounds, and which vectors were scanned.

    moved: how far each centroid has moved since the bounds held; half: half the distance of each
    to its nearest other, rounded down. A cluster of -1 hasn't been assigned.
    """
    cluster, upper, lower = cluster.copy(), (upper + moved[cluster]) * (1 + SLACK), (lower - moved.max(initial=0)) * (1 - SLACK)
    apart = np.maximum(lower, half[cluster])
    open_ = np.flatnonzero((cluster < 0) | (upper >= apart))
    known = open_[cluster[open_] >= 0]
    if len(known):  # the exact distance to the own centroid settles many
        upper[known] = np.sqrt(own_distance(x[known], centroids, cluster[known])) * (1 + SLACK)
        open_ = np.flatnonzero((cluster < 0) | (upper >= apart))
    if len(open_):
        found = squared(x[open_], centroids)
        best = found.argmin(1)
        cluster[open_] = best
        rows = np.arange(len(open_))
        upper[open_] = np.sqrt(found[rows, best]) * (1 + SLACK)
        found[rows, best] = np.iinfo(np.int64).max
        lower[open_] = np.sqrt(found.min(1)) * (1 - SLACK) if found.shape[1] > 1 else np.inf
    scanned = np.zeros(len(x), dtype=bool)
    scanned[open_] = True
    return cluster, upper, lower, scanned


def halves(centroids: np.ndarray) -> np.ndarray:
    """Half of each centroid's distance to its nearest other, rounded down."""
    if len(centroids) < 2:
        return np.full(len(centroids), np.inf)
    apart = np.sqrt(squared(centroids, centroids).astype(np.float64))
    np.fill_diagonal(apart, np.inf)
    return apart.min(1) / 2 * (1 - SLACK)


def _matrix(values: pa.Array, dimension: int) -> np.ndarray:
    return values.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dimension)


def digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()


def cluster(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", dimension: int = 64, k: int = 40, rounds: int = 5, seed: str = "2:") -> tuple[DataFrame, DataFrame]:
    """Assignments (id, cluster, distance, scanned) and centroids (cluster, centroid) after rounds of k-means.

    Takes part what integers() accepts; other rows have no result. The centroids start as the k
    vectors with the smallest hexadecimal SHA-256 of seed and id, in that order; equal hashes
    (repeated ids) go by the vector, null ids come last. With fewer vectors there are as many
    centroids; without any, both results are empty. A round assigns every vector to the nearest
    centroid (ties: the smaller number) and replaces each centroid that has vectors by the floor
    of their mean, by component; then vectors are assigned once more. Repeated rows are vectors of
    their own. scanned tells whether the last assignment compared all centroids.

    The state, a row per vector with its cluster and two bounds, is written each round, and the
    one before removed: a lost executor repeats its tasks of one round. Only k centroids and their
    sums, k x dimension numbers, come to the driver and go to the tasks.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "centroids")
    shape = "id long, x array<int>, cluster int, upper double, lower double, distance long, scanned boolean"
    named = vectors.select(column(id_col).cast("long").alias("id"), integers(column(vector_col), dimension).alias("x")).where(F.col("x").isNotNull())
    state = scratch.keep(named.select("id", "x", F.lit(-1).alias("cluster"), F.lit(0.0).alias("upper"), F.lit(0.0).alias("lower"), F.lit(0).cast("long").alias("distance"), F.lit(False).alias("scanned")), "state-0")
    hashed = F.sha2(F.concat(F.lit(seed), F.col("id").cast("string")).cast("binary"), 256)
    first = state.select(hashed.alias("h"), "x").orderBy(F.col("h").asc_nulls_last(), "x").limit(k).collect()  # k rows
    centroids = np.array([r["x"] for r in first], dtype=np.int64).reshape(-1, dimension)
    moved = np.zeros(len(centroids))
    for turn in range(rounds + 1):
        half, last = halves(centroids), turn == rounds

        def assign(batches: Iterator[pa.RecordBatch], centroids=centroids, moved=moved, half=half, last=last) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = _matrix(batch.column("x"), dimension)
                found, upper, lower, scanned = step(x, *[batch.column(c).to_numpy() for c in ("cluster", "upper", "lower")], centroids, moved, half)
                distance = own_distance(x, centroids, found) if last else np.zeros(len(x), dtype=np.int64)
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("x"), pa.array(found, pa.int32()), pa.array(upper), pa.array(lower), pa.array(distance), pa.array(scanned)], names=["id", "x", "cluster", "upper", "lower", "distance", "scanned"])

        state = scratch.keep(state.mapInArrow(task(assign), shape), f"state-{turn + 1}")
        scratch.drop(f"state-{turn}")
        if not last:
            sums = state.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.array(*[F.sum(F.get("x", F.lit(j))) for j in range(dimension)]).alias("sums")).collect()  # a row for each centroid
            after = centroids.copy()
            for row in sums:
                after[row["cluster"]] = [s // row["n"] for s in row["sums"]]
            moved = np.sqrt(own_distance(after, centroids, np.arange(len(centroids))).astype(np.float64)) * (1 + SLACK)
            centroids = after
    listed = spark.createDataFrame([(c, x.tolist()) for c, x in enumerate(centroids)], "cluster int, centroid array<long>")
    return state.select("id", "cluster", "distance", "scanned"), listed
