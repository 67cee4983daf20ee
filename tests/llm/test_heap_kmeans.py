import hashlib
import math
import random

import numpy as np
import pytest

from partloom.llm import heap_kmeans
from partloom.llm.heap_kmeans import cluster_vectors, drifts, rescan, squared


def brute(rows, dim=64, scale=64, k=16, rounds=3, seed=1):
    kept = [(i, [math.floor(scale * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    name = lambda i: hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()
    centers = [v for _, _, v in sorted((i is None, name(i), v) for i, v in kept)[:k]]
    apart = lambda v, c: sum((x - y) ** 2 for x, y in zip(v, c))
    nearest = lambda v: min((apart(v, c), n) for n, c in enumerate(centers))
    for _ in range(rounds):
        own = [nearest(v)[1] for _, v in kept]
        for c in range(len(centers)):
            members = [v for (_, v), n in zip(kept, own) if n == c]
            if members:
                centers[c] = [sum(x) // len(members) for x in zip(*members)]
    last = [nearest(v) for _, v in kept]
    total = sum(a for a, _ in last)
    by = {c: sum(a for a, n in last if n == c) for c in range(len(centers))}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centers]
    return sorted(((i, c, a, by[c], total, digest[c]) for (i, _), (a, c) in zip(kept, last)), key=str)


def run(spark, rows, **settings):
    frame = spark.createDataFrame([(*r, 1, 2.0) for r in rows], "vec_id long, embedding array<double>, cluster int, key double")
    return sorted((tuple(r) for r in cluster_vectors(frame.repartition(3), **settings).collect()), key=str)


def test_table(spark, sf):
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    want = brute([(r["vec_id"], r["embedding"]) for r in table.collect()])
    assert sorted((tuple(r) for r in cluster_vectors(table).collect()), key=str) == want


@pytest.mark.parametrize("rounds", [0, 1, 6])
def test_ties_and_common_vectors(spark, rounds):
    draw = random.Random(rounds)
    rows = [(i, [draw.randrange(-2, 3) / 8 for _ in range(3)]) for i in range(400)] + [(1000 + i, [0.25, 0.0, -0.25]) for i in range(300)]
    assert run(spark, rows, dim=3, k=9, rounds=rounds) == brute(rows, 3, k=9, rounds=rounds)


def test_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [0.5, -0.001]), (2, None), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [None, 1.0]), (6, [1.0]), (7, [1.0, 2.0, 3.0]), (None, [4.0, 4.0]),
        (8, [1e7, -3e7]), (8, [1e7, -3e7]), (9, [1e7, 3e7]), (10, []),
    ]
    for k in (2, 16):
        assert run(spark, rows, dim=2, k=k) == brute(rows, 2, k=k)
    assert run(spark, rows[1:5], dim=2) == [] and run(spark, [], dim=2) == []
    with pytest.raises(Exception, match="64 bits"):
        run(spark, [(1, [1e30, 1.0])], dim=2)
    with pytest.raises(Exception, match="64 bits"):
        run(spark, [(1, [1e16, 1.0]), (2, [-1e16, 1.0])], dim=2, k=1)


def test_only_expired_gaps_are_scanned():
    draw = np.random.default_rng(1)
    middles = draw.integers(-4000, 4000, (8, 16))
    points = (middles[draw.integers(0, 8, 3000)] + draw.integers(-300, 300, (3000, 16))).astype(np.int64)
    centers, drift = points[:8].copy(), np.zeros(8)
    cluster, key = np.full(3000, -1, np.int32), np.zeros(3000)
    scanned = []
    for _ in range(8):
        scanned.append(rescan(points, cluster, key, centers, drift))
        assert (cluster == squared(points, centers).argmin(axis=1)).all()
        moved = np.array([points[cluster == c].sum(axis=0) // max(1, (cluster == c).sum()) if (cluster == c).any() else centers[c] for c in range(8)])
        drift = drift + drifts(centers, moved)[1]
        centers = moved
    assert scanned[0] == 3000 and min(scanned) < 600


def test_wide_components_are_exact():
    points = np.array([[1 << 30, 5], [-(1 << 30), 7]], np.int64)
    assert squared(points, points).tolist() == [[0, (1 << 31) ** 2 + 4], [(1 << 31) ** 2 + 4, 0]]
    assert heap_kmeans.squared(np.zeros((0, 2), np.int64), points).shape == (0, 2)
