"""Work of the enrichment that is done once for a row, and in many tasks."""

from pyspark.sql import functions as F

from partloom import queries as Q
from partloom.operators import attributes as A
from partloom.operators import delivery as D
from partloom.plans import feeds, store


def test_evidence_is_read_in_many_tasks(spark, sf):
    assert feeds.evidence(spark, sf).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_texts_are_guarded_in_many_tasks(spark, sf):
    assert Q.QUERIES["guardrails"](spark, sf).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_lines_are_cut_once(spark):
    text = spark.createDataFrame([("Rated voltage 120 V. Wall mount unit",), (None,), ("",)], "text string")
    found = text.select(A.snippets(F.col("text")).alias("s"))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("split(") == 2  # at line ends, or at full stops
    assert [sorted(r["s"]) for r in found.collect()] == [["mounting", "voltage"], [], []]


def test_lookup_of_slots_is_made_once(spark):
    specs = spark.range(5).select(
        F.array(*[F.struct(F.lit(k).alias("k"), F.concat(F.lit(v), F.col("id").cast("string")).alias("v")) for k, v in (("Color", "Red "), ("Series", "S"), ("Own", "x"))]).alias("specs"),
        F.struct(F.lit("Dishwasher").alias("item_type")).alias("final"),
    )
    plan = D.align_slots(specs)._jdf.queryExecution().optimizedPlan().toString()
    held = [line for line in plan.split("\n") if "map_from_entries(" in line]
    assert held and all("transform(array(map_from_entries(" in line for line in held)


def test_rows_are_enriched_without_an_exchange(spark, sf, monkeypatch):
    """Joined before, so that the long plan is optimized once, not again after every stage of the joins."""
    written, held = store.materialize, {}
    monkeypatch.setattr(store, "_WRITTEN", {})
    monkeypatch.setattr(store, "materialize", lambda df, name: held.setdefault(name, df) if name == "enriched" else written(df, name))
    store.enriched(spark, sf)
    assert "Exchange" not in held["enriched"]._jdf.queryExecution().executedPlan().toString()
