"""Centroid clustering: Lloyd's rounds with heap-ordered bounds."""

from __future__ import annotations

import hashlib
import heapq
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partloom.llm.storage import written

#: Up to this size of components, squared distances of 64 components fit 64 bits; beyond it Python integers are used.
_SAFE = 1 << 27
_LARGEST = (1 << 63) - 1


def sound(vector: str, dim: int) -> Column:
    """Whether a vector has ``dim`` components, none of them null or non-finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.col(vector).isNotNull() & (F.size(vector) == dim) & finite


def quantized(vector: str, scale: int) -> Column:
    """floor(scale * x) of every component; a component that does not fit 64 bits is an error."""
    whole = F.transform(vector, lambda x: F.floor(x.cast("double") * scale))
    fits = F.forall(vector, lambda x: F.abs(x.cast("double") * scale) < 2.0**63)
    return F.when(fits, whole).otherwise(F.raise_error("a component does not fit 64 bits"))


def squared(points: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Exact squared distances of every point to every center, as Python integers if they might not fit 64 bits."""
    if max(abs(points).max(initial=0), abs(centers).max(initial=0)) < _SAFE:
        return np.stack([((points - c) ** 2).sum(axis=1) for c in centers], axis=1)
    return np.array([[sum((int(x) - int(y)) ** 2 for x, y in zip(p, c)) for c in centers] for p in points], object).reshape(len(points), len(centers))


def drifts(before: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How far each centroid moved, and how much the gap of its vectors can have shrunk: by that and the furthest move of another."""
    moved = np.array([math.sqrt(sum((int(x) - int(y)) ** 2 for x, y in zip(a, b))) for a, b in zip(before, after)])
    others = [max(np.delete(moved, i), default=0.0) for i in range(len(moved))]
    return moved, moved + others


def rescan(points: np.ndarray, cluster: np.ndarray, key: np.ndarray, centers: np.ndarray, drift: np.ndarray) -> int:
    """Bring the clusters and keys of a block of vectors up to date; returns how many vectors were compared with the centroids.

    A vector's gap is the distance to its second nearest centroid less that to its own.  Its key is the gap when it was last
    scanned plus the drift that its cluster had by then, so all keys of a cluster stand while its drift grows, and the heap of
    keys is popped as long as its least is not above the drift: only these gaps may have closed.  Popped vectors are compared
    with all centroids and pushed onto the heap of their new cluster.  ``cluster`` is -1 for vectors never scanned.
    """
    heaps: list[list[tuple[float, int]]] = [[] for _ in centers]
    for i in np.flatnonzero(cluster >= 0):
        heaps[cluster[i]].append((key[i], int(i)))
    expired = np.flatnonzero(cluster < 0).tolist()
    for c, heap in enumerate(heaps):
        heapq.heapify(heap)
        slack = 1e-9 * (1 + drift[c])  # distances are rounded; a tie belongs to the smaller number
        while heap and heap[0][0] - slack - 1e-9 * abs(heap[0][0]) <= drift[c]:
            expired.append(heapq.heappop(heap)[1])
    if expired:
        exact = squared(points[expired], centers)
        nearest = exact.argmin(axis=1)  # the first of equal ones
        roots = np.sqrt(exact.astype(np.float64))
        own = roots[np.arange(len(expired)), nearest]
        roots[np.arange(len(expired)), nearest] = np.inf
        cluster[expired] = nearest
        key[expired] = roots.min(axis=1) - own + drift[nearest]
    return len(expired)


_STATE = "vec_id long, v array<long>, cluster int, key double"


def _block(batch: pa.RecordBatch, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    points = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, dim)
    return points, batch.column(2).to_numpy(zero_copy_only=False).copy(), batch.column(3).to_numpy(zero_copy_only=False).copy()


def _assigned(centers: np.ndarray, drift: np.ndarray, dim: int) -> Callable:
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points, cluster, key = _block(batch, dim)
            rescan(points, cluster, key, centers, drift)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(cluster, pa.int32()), pa.array(key, pa.float64())], ["vec_id", "v", "cluster", "key"]
            )

    return assign


def _measured(centers: np.ndarray, dim: int) -> Callable:
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points, cluster, _ = _block(batch, dim)
            apart = np.zeros(len(points), np.int64)
            for c in np.unique(cluster):
                own = squared(points[cluster == c], centers[c : c + 1])[:, 0]
                if own.max() > _LARGEST:
                    raise OverflowError("a squared distance does not fit 64 bits")
                apart[cluster == c] = own
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cluster, pa.int32()), pa.array(apart, pa.int64())], ["vec_id", "cluster", "distance"])

    return measure


def _totals(dim: int) -> Callable:
    """Sums of a task by cluster, as decimals: they may need more than 64 bits."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, tuple[int, list[int]]] = {}
        for batch in batches:
            points, cluster, _ = _block(batch, dim)
            for c in np.unique(cluster).tolist():
                own = points[cluster == c]
                few = abs(own).max(initial=0) < (1 << 40)  # a batch has fewer than 2^22 rows
                total = own.sum(axis=0).tolist() if few else [sum(map(int, x)) for x in own.T]
                n, before = sums.get(c, (0, [0] * dim))
                sums[c] = (n + len(own), [x + y for x, y in zip(before, total)])
        rows = [(c, i, x, n) for c, (n, total) in sums.items() for i, x in enumerate(total)]
        kinds = [pa.int32(), pa.int32(), pa.decimal128(38), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], ["cluster", "i", "x", "n"])

    return add


def cluster_vectors(
    vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", dim: int = 64, scale: int = 64, k: int = 16, rounds: int = 3, seed: int = 1
) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256): Lloyd's rounds in exact integer arithmetic.

    Components are quantised to floor(scale * x).  Centroids start as the ``k`` vectors with the smallest SHA-256 of
    ``seed:vec_id``; equal hashes come in the order of components, a null identifier after all others.  Each of
    ``rounds`` assigns every vector to the nearest centroid (ties: the smaller number) and moves every non-empty centroid to the floor
    of its mean; then vectors are assigned once more.

    Vectors carry their cluster and the key of their heap from round to round in a written table, so a round reads
    and writes each vector once, shuffles only the sums of each task, and compares with all centroids only the vectors
    whose gap has expired (``rescan``).  The driver holds the centroids.

    Rows with a null vector, another number of components, or a null or non-finite component take no part.  Repeated rows are rows of
    their own.  Fewer than ``k`` vectors make as many centroids.  Components, distances or inertias beyond 64 bits
    are an error.  An empty table gives an empty result.  Further columns are not read.
    """
    rows = vectors.where(sound(vector, dim)).select(F.col(vec_id).cast("long").alias("vec_id"), quantized(vector, scale).alias("v"))
    state = written(rows.select("vec_id", "v", F.lit(-1).alias("cluster"), F.lit(0.0).alias("key")), "vectors")
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = state.select("v", name.alias("h")).orderBy(F.col("h").asc_nulls_last(), "v").limit(k).collect()
    centers = np.array([r["v"] for r in first], np.int64).reshape(len(first), dim)
    drift = np.zeros(len(first))
    if not len(first):
        return vectors.sparkSession.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    for _ in range(rounds):
        state = written(state.mapInArrow(_assigned(centers, drift, dim), _STATE), "state")
        sums = state.mapInArrow(_totals(dim), "cluster int, i int, x decimal(38,0), n long")
        moved = centers.copy()
        for r in sums.groupBy("cluster", "i").agg(F.sum("x").alias("x"), F.sum("n").alias("n")).collect():
            moved[r["cluster"], r["i"]] = int(r["x"]) // r["n"]
        drift = drift + drifts(centers, moved)[1]
        centers = moved
    state = state.mapInArrow(_assigned(centers, drift, dim), _STATE)
    out = written(state.mapInArrow(_measured(centers, dim), "vec_id long, cluster int, distance long"), "clustered")
    inertia = {r["cluster"]: int(r["s"]) for r in out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    if sum(inertia.values()) > _LARGEST:
        raise OverflowError("the inertia does not fit 64 bits")
    digest = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centers]
    by_cluster = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), F.col("cluster") + 1)
    return out.select(
        "vec_id", "cluster", "distance", by_cluster([inertia.get(c, 0) for c in range(len(centers))]).cast("long").alias("cluster_inertia"),
        F.lit(sum(inertia.values())).cast("long").alias("inertia"), by_cluster(digest).alias("centroid_sha256"),
    )
