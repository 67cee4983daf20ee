"""Fingerprints of files and persisted tables."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from partloom.sources import hashtree, tables


def tree_root(data: bytes, leaf: int, fan_out: int) -> str:
    """The tree of one file, from its definition."""
    digest = lambda text: hashlib.sha256(text.encode()).hexdigest()
    groups, at = {}, 0
    for line in data.removesuffix(b"\n").split(b"\n"):
        groups.setdefault(at // leaf, []).append(f"{at}:{hashlib.sha256(line).hexdigest()}")
        at += len(line) + 1
    nodes, reach = {n: digest(",".join(g)) for n, g in groups.items()}, leaf
    while reach < len(data):
        up = {}
        for n in sorted(nodes):
            up.setdefault(n // fan_out, []).append(f"{n}:{nodes[n]}")
        nodes, reach = {n: digest(",".join(g)) for n, g in up.items()}, reach * fan_out
    (top,) = nodes.values()
    return digest(f"{len(data)}:{top}")


@pytest.fixture
def splits(spark):
    yield lambda size: spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_roots_do_not_depend_on_splits(spark, tmp_path, splits):
    some = random.Random(1)
    data = {
        "text": b"".join(b"line %d %s\n" % (i, b"x" * some.randrange(90)) for i in range(900)),
        "bytes": bytes(some.randrange(256) for _ in range(30_000)),
        "long": b"a" * 20_000 + b"\nb\n" + b"c" * 9_000, "small": b"one", "ended": b"one\n", "breaks": b"\n" * 5000 + b"\r\n\r",
    }
    for name, content in data.items():
        (tmp_path / name).write_bytes(content)
    (tmp_path / "empty").write_bytes(b"")
    for size in ("3k", "10k", "100m"):
        splits(size)
        found = {r["file"].rsplit("/", 1)[1]: r for r in hashtree.file_trees(spark, str(tmp_path), 256, 4).collect()}
        assert {n: r["root"] for n, r in found.items()} == {n: tree_root(v, 256, 4) for n, v in data.items()}
        assert all(found[n]["bytes"] == len(v) for n, v in data.items())
    sums = {r["file"].rsplit("/", 1)[1]: r["sha256"] for r in hashtree.file_sums(spark, str(tmp_path)).collect()}
    assert sums == {n: hashlib.sha256(v).hexdigest() for n, v in data.items()}


def test_one_changed_byte(spark, tmp_path):
    data = bytearray(b"0123456789abcde\n" * 1000)
    roots, leaves = [], []
    for folder in ("old", "new"):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "f").write_bytes(data)
        data[8000] ^= 1
        roots.append(hashtree.file_trees(spark, str(tmp_path / folder), 512, 4).first()["root"])
        leaves.append(hashtree.file_leaves(spark, str(tmp_path / folder), 512).withColumn("file", F.lit("f")))
    assert roots[0] != roots[1]
    assert [tuple(r) for r in hashtree.changed_ranges(*leaves, 512).collect()] == [("f", 8000 // 512 * 512)]
    assert hashtree.changed_ranges(leaves[0], leaves[0], 512).count() == 0


def bucket_files(path):
    return {p.relative_to(path): p.stat().st_mtime_ns for p in path.rglob("*.parquet")}


def test_merge_writes_only_changed_buckets(spark, tmp_path):
    path = tmp_path / "table"
    some = random.Random(2)
    schema = "id string, n long, note string, seen long"
    expected, seen = {}, 0
    for step in range(4):
        rows = []
        for _ in range(60 if step else 300):
            seen += 1
            rows.append((f"k{some.randrange(500)}", some.randrange(3), some.choice([None, "", "a"]), seen))
        before = bucket_files(path) if step else {}
        written = tables.merge(spark, str(path), spark.createDataFrame(rows, schema), "id", [F.col("seen")], buckets=16)
        touched = {r["id"] for r in spark.createDataFrame(rows, schema).collect()}
        expected |= {r[0]: r for r in rows}
        found = {r["id"]: tuple(r) for r in tables.read(spark, str(path)).collect()}
        assert found == expected and tables.read(spark, str(path)).count() == len(expected) and touched <= set(found)
        after = bucket_files(path)
        assert all(after[p] == t for p, t in before.items() if int(str(p.parts[0]).split("=")[1]) not in written)
        before = after
        assert tables.merge(spark, str(path), spark.createDataFrame(rows, schema), "id", [F.col("seen")], buckets=16) == []
        assert bucket_files(path) == before
    one = spark.createDataFrame([("k1", 9, "z", seen + 1)], schema)
    assert len(tables.merge(spark, str(path), one, "id", [F.col("seen")], buckets=16)) == 1
    assert tables.merge(spark, str(path), one.where("false"), "id", buckets=16) == []
    assert tables.merge(spark, str(tmp_path / "none"), one.where("false"), "id") == []


def test_identifiers_and_references(spark):
    parts = spark.createDataFrame([("a", "bc"), ("ab", "c"), ("", None), (None, ""), ("1:a", "")], "x string, y string")
    ids = [r[0] for r in parts.select(tables.row_id(F.col("x"), F.col("y"))).collect()]
    assert len(set(ids)) == 5 and all(len(i) == 32 for i in ids)
    parents = spark.createDataFrame([("p",)], "pid string")
    children = spark.createDataFrame([(1, "p"), (2, "q"), (3, None)], "n long, ref string")
    assert [r["n"] for r in tables.unresolved(children, "ref", parents, "pid").collect()] == [2]
