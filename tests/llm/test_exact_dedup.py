import hashlib
import re
from collections import defaultdict

from pyspark.sql import functions as F

from partloom.llm.exact_dedup import drop_copies, find_copies


def brute(rows):
    groups = defaultdict(list)
    for i, text in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", text or "")].append(i)
    return sorted(
        (i, min(ids), len(ids), hashlib.sha256(t.encode()).hexdigest()) for t, ids in groups.items() for i in ids
    )


ROWS = [
    (5, "a  b"), (3, "a\tb"), (9, "a\n\r\x0b b"), (4, "a b"), (7, ""), (2, None), (8, " "), (1, "A b"), (6, "é" * 50000), (10, "é" * 50000),
    (11, " a b"), (12, "a b "),
]


def result(found):
    cols = ["doc_id", "keep_id", "group_size", F.lower(F.hex("digest"))]
    return sorted(tuple(r) for r in found.select(*cols).collect())


def test_equal_texts(make_docs):
    found = find_copies(make_docs(ROWS))
    assert result(found) == brute(ROWS)
    assert {r["doc_id"] for r in found.where("kept").collect()} == {r[1] for r in brute(ROWS)}


def test_collisions_are_told_apart_by_their_bytes(make_docs):
    found = find_copies(make_docs(ROWS), digest=lambda t: F.unhex(F.lit("00")))
    assert [r[:3] for r in result(found)] == [r[:3] for r in brute(ROWS)]


def test_several_batches_share_the_state(spark, make_docs, tmp_path):
    path = str(tmp_path / "docs")
    make_docs([(i, f"text {i % 40}") for i in range(200)]).repartition(6).write.parquet(path)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    try:
        found = find_copies(spark.read.parquet(path), files_per_batch=1)
        assert result(found) == brute([(i, f"text {i % 40}") for i in range(200)])
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_edge_cases(make_docs):
    rows = [(1, "x"), (1, "x"), (None, "x"), (None, "y"), (None, "y")]
    docs = make_docs(rows, ["1 AS digest", "2 AS key", "3 AS _file", "true AS kept"])
    found = find_copies(docs).collect()
    assert sorted((r["doc_id"] or 0, r["keep_id"] or 0, r["group_size"]) for r in found) == [
        (0, 0, 2), (0, 0, 2), (0, 1, 3), (1, 1, 3), (1, 1, 3),
    ]
    assert sum(r["kept"] for r in found) == 2
    kept = drop_copies(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] or 0, r["text"]) for r in kept.collect()) == [(0, "y"), (1, "x")]
    assert find_copies(docs.limit(0)).count() == 0
    assert drop_copies(docs.limit(0)).count() == 0
