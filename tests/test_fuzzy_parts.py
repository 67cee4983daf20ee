"""Brands found by their parts: none that could win is missed, and few pairs are scored where nothing is near."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from partloom.operators import fuzzy
from partloom.operators.entity import similarity


def best(spark, frame, brands, names, cutoff):
    t, b = fuzzy._forms(frame.distinct().where("text IS NOT NULL"), "text", F.col("text")), fuzzy._forms(brands, "ord", F.col("brand"))
    pairs = t.crossJoin(b.select("ord", F.struct("norm", "tokens", "sorted").alias("b")))
    score = similarity(F.col("norm"), F.col("tokens"), F.col("sorted"), F.col("b"))
    rated = pairs.select("text", "ord", score.alias("score")).where(F.col("score") >= cutoff)
    want = rated.groupBy("text").agg(F.max_by(F.struct("ord", "score"), F.struct("score", -F.col("ord"))).alias("r"))
    return {r["text"]: (names[r["r"]["ord"]], round(r["r"]["score"], 9)) for r in want.collect()}


@pytest.mark.parametrize("seed,cutoff,long", [(1, 0.7, 48), (2, 0.8, 12), (3, 0.92, 48)])
def test_none_is_missed(spark, monkeypatch, seed, cutoff, long):
    monkeypatch.setattr(fuzzy, "LONG", long)
    draw = random.Random(seed)
    word = lambda: "".join(draw.choice("ab") for _ in range(draw.randrange(1, 12)))
    names = [" ".join(word() for _ in range(draw.choice([1, 2, 4, 9]))) for _ in range(250)] + ["A B", "a  b", "a-b", "ab"]
    texts = []
    for name in draw.sample(names, 150):
        for most in (1, 3, 8):
            t = list(name)
            for _ in range(draw.randrange(most) + 1):
                at = draw.randrange(len(t) + 1)
                t[at : at + draw.randrange(2)] = draw.choice(["", "a", "b", "x", " "])
            texts.append("".join(t))
        texts += [f"x {name} y", " ".join(reversed(name.split())), name[: len(name) // 2]]
    brands = spark.createDataFrame(list(enumerate(names)), "ord int, brand string")
    frame = spark.createDataFrame([(t,) for t in texts], "text string")
    want = best(spark, frame, brands, names, cutoff)
    got = {r["text"]: (r["brand"], round(r["score"], 9)) for r in fuzzy.best_brands(frame, brands, cutoff).collect()}
    assert got == want and len(want) > 200


def test_long_texts_meet_few_short_brands(spark, monkeypatch):
    names = [f"{c} ring {hashlib.md5(f'{c}{i}'.encode()).hexdigest()[:5]}" for c in ("large", "small") for i in range(400)]
    brands = spark.createDataFrame(list(enumerate(names)), "ord int, brand string")
    texts = {f"sanding belt {i}in x {j}in {names[i * 20]} {j}.25in": names[i * 20] for i in range(20) for j in range(10)}
    real, scored = fuzzy.candidates, []

    def counted(*args):
        pairs = real(*args)
        scored.append(pairs.count())
        return pairs

    monkeypatch.setattr(fuzzy, "candidates", counted)
    frame = spark.createDataFrame([(t,) for t in texts], "text string")
    assert {r["text"]: r["brand"] for r in fuzzy.best_brands(frame, brands, 0.8).collect()} == texts
    assert sum(scored) < 3 * len(texts), scored
