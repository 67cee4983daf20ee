"""Aliases inside texts: a spelling and a text are looked up once, whatever the number of their copies."""

import re

from pyspark.sql import functions as F

from partloom.operators.entity import embedded_alias_join


def most_rows(df):
    """Rows collected, and the most that any step of the plan gave."""
    rows, most, open_ = df.collect(), 0, [df._jdf.queryExecution().executedPlan()]
    while open_:
        p = open_.pop()
        name = p.nodeName()
        if name.startswith("AdaptiveSparkPlan"):
            open_.append(p.executedPlan())
        elif "QueryStage" in name:
            open_.append(p.plan())
        metrics, children = p.metrics(), p.children()
        if metrics.contains("numOutputRows"):
            most = max(most, metrics.apply("numOutputRows").value())
        open_ += [children.apply(i) for i in range(children.size())]
    return rows, most


def test_copies_do_not_multiply(spark):
    aliases = spark.range(1000).select(F.col("id").cast("int").alias("ord"), F.lit("chrome ring supplier").alias("alias"), F.concat(F.lit("b"), 999 - F.col("id")).alias("brand"))
    texts = spark.range(1000).select("id", F.when(F.col("id") % 2 == 0, "A Chrome ring supplier of old").otherwise("chrome ring suppliers").alias("t"))
    rows, most = most_rows(embedded_alias_join(texts, "id", "t", aliases).select("id", "embedded_brand"))
    assert {(r["id"], r["embedded_brand"]) for r in rows} == {(i, None if i % 2 else "b999") for i in range(1000)}
    assert most < 10_000, most


def test_first_alias_of_odd_texts(spark):
    names = ["a b", "b", "b c", "u.s. tape", "black & decker", "étage", "x-y", "(c)", "C", "&", "b"]
    aliases = [((i * 7) % 11, a, f"{a}/{i}") for i, a in enumerate(names)]
    texts = [None, "", " ", "a b c", "A  B", "ab b", "us tape", "U.S. Tape!", "Black & Decker co", "black and decker", "x-y x", "x y", "(c) c", "étage", "bc", "a b"]
    texts += texts
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {r["id"]: r["embedded_brand"] for r in embedded_alias_join(df, "id", "text", spark.createDataFrame(aliases, "ord int, alias string, brand string")).collect()}

    def brute(t):
        held = lambda a: re.search(r"\b" + re.escape(a) + r"\b", t) and re.search(r"\w", a, re.ASCII)
        t = (t or "").strip().lower()
        return min(((o, b) for o, a, b in aliases if held(a)), default=(0, None))[1]

    want = {i: brute(t) for i, t in enumerate(texts)}
    assert got == want
