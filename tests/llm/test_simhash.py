import random
from collections import defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from partloom.llm.components import components
from partloom.llm.simhash import drop_near_duplicates, fingerprint, near_duplicates, near_pairs, segment_radii


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, distance=4):
    """doc_id -> least reachable doc_id."""
    label = {i: i for i in prints}
    changed = True
    while changed:
        changed = False
        for a in prints:
            for b in prints:
                if (prints[a] ^ prints[b]).bit_count() <= distance and label[b] < label[a]:
                    label[a], changed = label[b], True
    return label


@pytest.mark.parametrize("text", ["", None, " \t", "one", "A b\x0bC", "a b c d", "a a a a a a a a", "É é x y z w", "w " * 70000])
def test_fingerprint(text):
    assert fingerprint(text) % 2**64 == brute_fingerprint(text)


def test_fingerprint_is_spark_hash(spark):
    value = spark.range(1).select(F.xxhash64(F.lit("a b c d"))).first()[0]
    assert fingerprint("A  b\nc D") == value


def test_components_of_documents(documents):
    prints = {r["doc_id"]: brute_fingerprint(r["text"]) for r in documents.collect()}
    want = brute_components(prints)
    got = {r["doc_id"]: (int(r["fingerprint"], 16), r["component_id"]) for r in near_duplicates(documents).collect()}
    assert got == {i: (prints[i], want[i]) for i in prints}


@pytest.mark.parametrize("segments,distance", [(3, 4), (2, 4), (4, 3), (5, 2), (3, 1)])
def test_no_pair_is_missed(spark, segments, distance):
    random.seed(segments * 10 + distance)
    base = [random.getrandbits(64) for _ in range(6)] + [0, 2**64 - 1]
    values = set(base)
    for b in base:
        for _ in range(12):
            for bit in random.sample(range(64), random.randint(1, 5)):
                b ^= 1 << bit
            values.add(b)
    signed = sorted(v - (1 << 64) if v >> 63 else v for v in values)
    frame = spark.createDataFrame([(v,) for v in signed], "fp long")
    got = {(r["a"], r["b"]) for r in near_pairs(frame, "fp", distance, segments).collect()}
    want = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) % 2**64).bit_count() <= distance}
    assert got == want and want


def test_radii():
    assert segment_radii(3, 4) == [1, 1, 0] and segment_radii(2, 4) == [2, 1] and segment_radii(5, 2) == [0, 0, 0, -1, -1]


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 200 + i) for i in range(50)] + [(7, 7), (500, 501), (501, 500)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    want = defaultdict(int, {i: 0 for i in range(41)}) | {100: 100} | {200 + i: 100 for i in range(50)} | {500: 500, 501: 500}
    assert got == dict(want)
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_edge_cases(make_docs):
    long = " ".join(f"w{i}" for i in range(30000))
    rows = [(4, None), (3, ""), (9, long), (8, long + " tail"), (None, long), (2, "other words here now"), (2, "other words here now")]
    docs = make_docs(rows, ["1 AS fp", "2 AS node", "3 AS first", "4 AS _file", "5 AS _row"])
    found = near_duplicates(docs)
    got = sorted((r["doc_id"] or 0, r["component_id"]) for r in found.collect())
    assert got == [(0, 8), (2, 2), (2, 2), (3, 3), (4, 3), (8, 8), (9, 8)]
    assert found.where("is_first").count() == 3
    kept = drop_near_duplicates(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [2, 3, 8]
    assert near_duplicates(docs.limit(0)).count() == 0 and drop_near_duplicates(docs.limit(0)).count() == 0
