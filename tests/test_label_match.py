"""Label matching inside a record: the first slot of a label, each label brought to its form once for the record."""

import time

import pytest
from pyspark.sql import functions as F

from partloom import vocab as V
from partloom.operators import evaluate as E

SLOTS = "array<struct<label:string,value:string>>"
ODD = ["", " ", None, "N/A", "none", "Width", "width ", " Width", "WIDTH®", "Wid-th", "wid th", "®", "™ Depth", "Depth", "-", "étage", " Étage"]


def form(x):
    if x is None or x.strip().lower() in V.EMPTY_WORDS:
        return ""
    return x.strip().replace("®", "").replace("™", "").strip().lower().replace("-", " ")


def brute(expected, predicted):
    out = []
    for s in expected:
        if s[0] and s[1]:
            value = next((p[1] for p in predicted if form(p[0]) == form(s[0])), None) or ""
            out.append((s[0], s[1], value, value != "" and form(s[1]) == form(value)))
    return out


def test_first_slot_of_each_label(spark):
    expected = [(a, b) for a in ODD for b in ODD]
    rows = [(i, expected, [(ODD[(i + j) % len(ODD)], ODD[(i * 5 + j * 3) % len(ODD)]) for j in range(i % 23)]) for i in range(60)]
    df = spark.createDataFrame(rows, f"i int, expected {SLOTS}, predicted {SLOTS}")
    got = {r["i"]: [tuple(x) for x in r["m"]] for r in df.select("i", E.match_labels(df, "expected", "predicted").alias("m")).collect()}
    assert got == {i: brute(e, p) for i, e, p in rows}


def test_records_without_slots(spark):
    df = spark.createDataFrame([(1, None, []), (2, [("a", "b")], None), (3, [], [("a", "b")])], f"i int, expected {SLOTS}, predicted {SLOTS}")
    got = [r["m"] for r in df.select("i", E.match_labels(df, "expected", "predicted").alias("m")).orderBy("i").collect()]
    assert got[0] is None and [tuple(x) for x in got[1]] == [("a", "b", "", False)] and got[2] == []


@pytest.mark.parametrize("a,b", [(a, b) for a in ODD[:8] for b in ODD[4:12]])
def test_equal_as_before(spark, a, b):
    row = spark.createDataFrame([(a, b)], "a string, b string").select(E.loosely_equal(F.col("a"), F.col("b")).alias("x")).first()
    assert row["x"] == (form(a) == form(b))


def test_work_does_not_grow_with_pairs_of_slots(spark):
    slots = lambda n: F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.struct(F.concat(F.lit("Label "), (i + F.col("id")).cast("string")).alias("label"), F.lit("v").alias("value")))

    def seconds(n):
        df = spark.range(2000).select(slots(n).alias("e"), slots(50).alias("p"))
        best = 1e9
        for _ in range(2):
            start = time.perf_counter()
            assert df.select(F.size(F.filter(E.match_labels(df, "e", "p"), lambda m: m["matched"])).alias("n")).agg(F.sum("n")).first()[0] == 2000 * n
            best = min(best, time.perf_counter() - start)
        return best

    few, many = seconds(1), seconds(50)
    assert many < 8 * few, (few, many)
