import hashlib
import math
from collections import Counter

import pytest

from partloom.llm.mixing import mix


def brute_count(seed, identity, rate):
    u = int(hashlib.md5(f"{seed}|{identity}".encode()).hexdigest()[:13], 16) / 2**52
    n, p, total = 0, math.exp(-rate), math.exp(-rate)
    while total <= u:
        n += 1
        p *= rate / n
        total += p
    return n


def test_counts_are_poisson_quantiles(make_docs):
    rows = [(i, "x" * (1 + i % 7), "en", "a" if i % 3 == 0 else "b") for i in range(400)]
    out = mix(make_docs(rows), {"a": 3.0, "b": 1.0}, epochs=2.0, seed=3)
    size = Counter()
    for _, text, _, source in rows:
        size[source] += len(text)
    want = Counter()
    for i, _, _, source in rows:
        rate = {"a": 0.75, "b": 0.25}[source] * sum(size.values()) * 2.0 / size[source]
        want[i] = brute_count(3, i, rate)
    got = Counter(r["doc_id"] for r in out.collect())
    assert got == +want


def test_large_rates_do_not_underflow(make_docs):
    out = mix(make_docs([(1, "abcd", None, "s"), (2, "abcd", None, "s")]), {"s": 1.0}, epochs=2000.0)
    copies = Counter(r["doc_id"] for r in out.collect())
    assert all(1700 < n < 2300 for n in copies.values()) and len(copies) == 2


def test_edge_cases(make_docs):
    rows = [
        (1, "one", "en", "w"), (1, "one", "en", "w"), (None, None, None, "w"), (3, "", "en", None), (4, "four", "en", "other"),
        (5, "zero", "en", "z"), (6, "long " * 20000, "en", "w"),
    ]
    docs = make_docs(rows, ["1 AS copy", "2 AS shuffle_key", "3 AS _n", "4 AS _cdf"])
    out = mix(docs, {"w": 1.0, "z": 0.0, "missing": 2.0}, epochs=3.0)
    assert out.columns == [*docs.columns, "copy_", "shuffle_key_"]
    copies = Counter(r["doc_id"] for r in out.collect())
    assert copies[4] == 1 and copies[3] == 1 and copies[5] == 0 and copies[1] % 2 == 0
    assert all(r["copy"] == 1 and r["_cdf"] == 4 for r in out.collect())
    assert mix(docs.limit(0), {"w": 1.0}).count() == 0
    assert mix(docs, {}).count() == len(rows)
    with pytest.raises(ValueError):
        mix(docs, {"w": -1.0})


def test_empty_weighted_sources(make_docs):
    assert mix(make_docs([(1, "", None, "w"), (2, None, None, "w")]), {"w": 1.0}).count() == 2


def test_order_is_shuffled(make_docs):
    out = mix(make_docs([(i, "t", None, f"s{i % 4}") for i in range(400)]), {}, partitions=2)
    keys = out.rdd.glom().map(lambda part: [r["shuffle_key"] for r in part]).collect()
    assert all(k == sorted(k) for k in keys) and all(len(k) > 100 for k in keys)
