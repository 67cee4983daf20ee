import heapq
import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from partloom.llm import fp_tree
from partloom.llm.fp_tree import Tree, parts, rank_documents

TERM = re.compile("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+")
LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def brute(docs, items, k=10):
    split = [(i, Counter(TERM.findall((t or "").translate(LOWER)))) for i, t in docs]
    n_docs, n_terms = sum(1 for _, t in split if t), sum(sum(t.values()) for _, t in split)
    df = Counter(t for _, own in split for t in own)
    out = []
    for item, text in items:
        wanted = {*TERM.findall((text or "").translate(LOWER))}
        scores = []
        for doc, own in split:
            m = 10 + 90 * sum(own.values()) * n_docs // max(1, n_terms)
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * own[t] // (1000 * own[t] + 8 * m)) for t in wanted & own.keys()
            )
            if score > 0:
                scores.append((-score, doc is None, doc or 0))
        out += [(item, n, None if late else doc, -s) for n, (s, late, doc) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def run(spark, docs, items, **settings):
    d = spark.createDataFrame([(*r, 1, 2) for r in docs], "doc_id long, text string, terms int, n int").repartition(3)
    i = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, rank int")
    return sorted((tuple(r) for r in rank_documents(d, i, **settings).collect()), key=str)


def test_table(spark, sf):
    docs, items = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    want = brute([(r["doc_id"], r["text"]) for r in docs.collect()], [(r["item_id"], r["text"]) for r in items.collect()])
    assert len(want) >= 100 and sorted((tuple(r) for r in rank_documents(docs, items).collect()), key=str) == want


@pytest.mark.parametrize("block_chars", [10**6, 2000])
def test_random_texts_in_many_trees(spark, monkeypatch, block_chars):
    monkeypatch.setattr(fp_tree, "TREE_DOCS", 64)
    draw = random.Random(1)
    words = [f"w{i}" for i in range(40)] + ["Über", "über", "ß", "naïve", "x1"]
    text = lambda n: " ".join(draw.choice(words[: draw.randrange(3, len(words))]) for _ in range(n))
    docs = [(i, text(draw.randrange(60))) for i in range(700)] + [(1000 + i, "w1 w2 w3") for i in range(150)]
    items = [(i, text(draw.randrange(1, 12))) for i in range(40)]
    assert run(spark, docs, items, block_chars=block_chars) == brute(docs, items)


def test_edge_cases(spark):
    long = "apple " * 50000 + "pear"
    docs = [(1, None), (2, ""), (3, "..."), (4, long), (5, "Apple pie"), (5, "Apple pie"), (None, "apple pie"), (6, "APPLE_pie"), (7, "quince")]
    items = [(1, "apple"), (1, "apple"), (None, "pear!"), (2, None), (3, "?!"), (4, "nothing here"), (5, "É é")]
    want = brute(docs, items)
    assert run(spark, docs, items) == want and len([r for r in want if r[0] == 1]) == 10
    assert run(spark, docs, []) == [] and run(spark, [], items) == [] and run(spark, docs[:3], items) == []
    assert run(spark, docs, items, k=2) == brute(docs, items, 2)


def test_tree_shares_paths_and_bounds_hold():
    draw = np.random.default_rng(2)
    vectors = []
    for i in range(300):
        own = np.flatnonzero(draw.random(12) < 0.9 ** np.arange(1, 13))
        vectors.append((tuple(own.tolist()), tuple(draw.integers(1, 9, len(own)).tolist()), int(draw.integers(10, 200)), (True, -i)))
    tree = Tree([v for v in vectors if v[0]])
    assert any(len({d[0][:3] for d in tree.docs[slice(*s)]}) == 1 for s in tree.spans[1:] if s[1] - s[0] > fp_tree.LEAF_DOCS)
    weights = draw.integers(0, 5000, (12, 7))
    for node, (a, b) in enumerate(tree.spans):
        names, counts = tree.most[node]
        bound = parts(counts, tree.least_m[node]) @ weights[names]
        for own, tf, m, _ in tree.docs[a:b]:
            assert (parts(np.array(tf), m) @ weights[list(own)] <= bound).all()
    best = [[] for _ in range(7)]
    tree.search(weights, best, 5)
    for i in range(7):
        scores = [(int(parts(np.array(tf), m) @ weights[list(own), i]), key) for own, tf, m, key in tree.docs]
        assert sorted(best[i]) == sorted(heapq.nlargest(5, [s for s in scores if s[0] > 0]))


def test_search_skips_most_documents(monkeypatch):
    draw = random.Random(5)
    vectors = [(tuple(sorted(draw.sample(range(50), 6))), (1,) * 6, draw.randrange(10, 400), (True, -i)) for i in range(4000)]
    tree, calls = Tree(vectors), [0]
    weights = np.zeros((50, 1), np.int64)
    weights[[3, 7, 11], 0] = 1000
    whole = fp_tree.parts

    def counted(tf, m):
        calls[0] += 1
        return whole(tf, m)

    monkeypatch.setattr(fp_tree, "parts", counted)
    tree.search(weights, [[]], 10)
    assert calls[0] < 1500
