import math
import random

import pytest

from partloom.llm.topk import Tree, top_k


def brute(rows, every=50, k=5):
    sound = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, (i, q) in enumerate(sound):
        if i % every == 0:
            scores = [(-sum(a * b for a, b in zip(q, v)), j) for m, (j, v) in enumerate(sound) if m != n and len(v) == len(q)]
            out += [(i, r, j, -s) for r, (s, j) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


def run(spark, rows, **settings):
    frame = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<double>, rank int, score int")
    return sorted(tuple(r) for r in top_k(frame, **settings).collect())


@pytest.mark.parametrize("dim,values", [(3, 4), (16, 1000)])
def test_shards_and_ties(spark, dim, values):
    random.seed(dim)
    rows = [(i, [random.randint(-values, values) / 256 for _ in range(dim)]) for i in range(900)]
    rows += [(1000 + i, rows[0][1]) for i in range(400)]  # one very common vector
    assert run(spark, rows, shard_rows=300, block_queries=7) == brute(rows)


def test_table(spark, sf):
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    want = brute([(r["vec_id"], r["embedding"]) for r in table.collect()])
    assert sorted(tuple(r) for r in top_k(table).collect()) == want


def test_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [0.5, -0.25]), (1, [1.0, 1.0]), (2, [nan, 1.0]), (3, [inf, 1.0]), (4, None), (5, [None, 1.0]), (None, [1.0, 1.0]),
        (6, [1.0, 1.0, 1.0]), (1, [1.0, 1.0]), (50, []), (51, []), (100, [1e5, -1e5]), (-50, [-0.001, 0.0]),
    ]
    rows += [(200, [2.0, 3.0])] * 3  # repeated rows are queries and candidates of their own
    rows += [(300, [3e6, 0.0]), (301, [5e6, 1.0]), (302, [-4e6, 2.0]), (350, [1e7, -1e6]), (351, [2e6, 3e6])]
    got = run(spark, rows)
    assert got == brute(rows) and sum(r[0] == 200 for r in got) == 15
    assert run(spark, rows[:1]) == []
    assert run(spark, []) == []


def test_scores_beyond_64_bits(spark):
    rows = [(0, [2.0**30, 2.0**30]), (1, [2.0**30, -(2.0**30)]), (2, [2.0**10, 1.0]), (3, [-1.0, 2.0])]  # partly beyond, summed up below
    assert run(spark, rows, k=3) == brute(rows, k=3)
    for wide in ([(0, [2.0**30]), (1, [2.0**30])], [(0, [1e30]), (1, [1.0])]):
        with pytest.raises(Exception, match="64 bits"):
            run(spark, wide)


def test_bounds_hold():
    import numpy as np

    draw = np.random.default_rng(3)
    points, ids = draw.integers(-50, 50, (500, 6)), draw.permutation(500)
    tree = Tree(ids, np.arange(500), points)
    for query, bound in zip(*(lambda q: (q, tree.bounds(q)))(draw.integers(-50, 50, (20, 6)))):
        for (a, b), top, least in zip(tree.spans, bound, tree.least):
            assert (tree.points[a:b] @ query).max() <= top and tree.ids[a:b].min() == least
