"""Joins of tables that grow: shuffled whatever their files look like, with the same rows as before."""

from pyspark.sql import functions as F

from partloom import queries as Q
from partloom.operators import evaluate as E
from partloom.operators.common import materialize
from partloom.operators.master import lookup_join, prefix_join


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def wide(spark, name, start):
    """Repetitive rows: thousands of cells in a file of some kilobytes."""
    cells = F.array(*[F.lit("the same long cell")] * len(E.V.COMPARISON_FIELDS))
    rows = spark.range(start, start + 2000).select(F.col("id").alias("_ordinal"), F.concat(F.lit("P"), F.col("id").cast("string")).alias("Mfg_Part_Num"), cells.alias("cells"))
    return materialize(rows, name)


def test_wide_records_are_not_broadcast(spark):
    compared = E.compare_records(wide(spark, "golden", 0), wide(spark, "output", 500), "Mfg_Part_Num", "_ordinal")
    assert "Broadcast" not in plan(compared) and compared.count() == 1500
    assert E.record_accuracy(E.record_counts(compared)).first()["exact_record_matches"] == 1500


def test_cells_of_records_are_not_broadcast(spark, sf):
    for name in ("attribute_label_match", "compliance_flags"):
        assert "Broadcast" not in plan(Q.QUERIES[name](spark, sf)), name


def test_master_tables_are_not_broadcast(spark):
    """Small files of many rows; the same tables as Spark would broadcast them."""
    table = materialize(spark.range(3000).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"), F.lit("v").alias("value")), "dimension")
    rows = materialize(spark.range(3000).select("id", F.concat(F.lit("k"), F.col("id").cast("string")).alias("k")), "rows")
    assert "Broadcast" in plan(rows.join(table, F.col("k") == F.col("key"), "left"))
    for found in (lookup_join(rows, F.col("k"), table, "v"), prefix_join(rows, "id", F.col("k"), table, "v")):
        assert "Broadcast" not in plan(found) and found.where("v = 'v'").count() == 3000


def test_cleaned_cells_compare_as_whole_cells_do(spark):
    values = ["", " ", None, "n/a", "A\u00ae", " a ", "1.0", "1", "x", "None"]
    n = len(E.V.COMPARISON_FIELDS)
    pairs = [(a, b) for a in values for b in values]
    rows = [(i, f"P{i}", [a] * n, [b] * n) for i, (a, b) in enumerate(pairs)]
    df = spark.createDataFrame(rows, "_ordinal long, k string, cells array<string>, other array<string>")
    got = E.compare_records(df.select("_ordinal", "k", "cells"), df.select("_ordinal", "k", F.col("other").alias("cells")), "k", "_ordinal")
    first = got.select("mfg_part_num", F.explode(F.arrays_zip("comparisons", F.array(*[F.lit(E.numeric_field(f)) for f in E.V.COMPARISON_FIELDS]).alias("n"))).alias("z"))
    want = df.select("k", F.explode(F.array(F.lit(True), F.lit(False))).alias("n"), F.get("cells", F.lit(0)).alias("e"), F.get("other", F.lit(0)).alias("a"))
    want = want.select("k", "n", E.compare_cell(F.col("e"), F.col("a"), F.col("n")).alias("c"))
    assert {(r[0], r[1][1], r[1][0]) for r in first.collect()} == {(r["k"], r["n"], r["c"]) for r in want.collect()}
