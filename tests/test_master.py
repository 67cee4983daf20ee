from pyspark.sql import functions as F

from partloom.operators.entity import embedded_alias_join
from partloom.operators.master import dimension, lookup_join, prefix_join


def test_lookup_in_a_table_of_any_size(spark):
    table = spark.range(5000).select(F.concat(F.lit("k"), "id").alias("key"), F.col("id").cast("string").alias("value"))
    rows = spark.createDataFrame([(1, "k4999"), (2, "none"), (3, ""), (4, None), (5, "k0"), (6, "k0")], "id long, k string")
    got = {r["id"]: r["v"] for r in lookup_join(rows, F.col("k"), table, "v").collect()}
    assert got == {1: "4999", 2: None, 3: None, 4: None, 5: "0", 6: "0"}


def test_longest_prefix_wins(spark):
    table = dimension(spark, [("ab", "two"), ("abcd", "four"), ("a", "one"), ("", "none")])
    rows = spark.createDataFrame([(1, " ABCDE"), (2, "abc"), (3, "x"), (4, None), (5, "a"), (6, "")], "id long, t string")
    got = {r["id"]: r["b"] for r in prefix_join(rows, "id", F.col("t"), table, "b").collect()}
    assert got == {1: "four", 2: "two", 3: None, 4: None, 5: "one", 6: None}
    assert prefix_join(rows, "id", F.col("t"), table.limit(0), "b").where("b is not null").count() == 0


def test_aliases_of_many_words(spark):
    aliases = spark.createDataFrame(
        [(0, "one two three four five six", "Six", 6), (1, "one two", "Two", 2), (2, "a.b & co", "Dotted", 3)],
        "ord int, alias string, brand string, words int",
    )
    rows = spark.createDataFrame(
        [(1, "x One two three four five six y"), (2, "one two three"), (3, "by A.B & Co."), (4, "someone two")], "id long, t string"
    )
    got = {r["id"]: r["embedded_brand"] for r in embedded_alias_join(rows, "id", "t", aliases).collect()}
    assert got == {1: "Six", 2: "Two", 3: "Dotted", 4: None}


def test_index_finds_what_all_pairs_find(spark):
    import random

    from pyspark.sql import functions as F

    from partloom.operators import fuzzy
    from partloom.operators.entity import similarity

    draw = random.Random(8)
    word = lambda: "".join(draw.choice("abcde") for _ in range(draw.randrange(1, 8)))
    names = [" ".join(word() for _ in range(draw.choice([1, 1, 2, 3]))) for _ in range(400)] + ["A", "ab", "Äö ü", "x-y", "aaaa"]
    texts = {*draw.sample(names, 120)}
    for name in draw.sample(names, 250):
        at = draw.randrange(len(name))
        texts |= {name[:at] + draw.choice("abcxé ") + name[at + 1 :], name[:at] + name[at + 1 :], name + " " + word(), word() + name, " ".join(reversed(name.split()))}
    brands = spark.createDataFrame(list(enumerate(names)), "ord int, brand string")
    frame = spark.createDataFrame([(t,) for t in [*texts, None, "--", ""]], "text string")
    for cutoff in (0.8, 0.85, 0.9):
        t, b = fuzzy._forms(frame.distinct().where("text IS NOT NULL"), "text", F.col("text")), fuzzy._forms(brands, "ord", F.col("brand"))
        pairs = t.crossJoin(b.select("ord", F.struct("norm", "tokens", "sorted").alias("b")))
        score = similarity(F.col("norm"), F.col("tokens"), F.col("sorted"), F.col("b"))
        rated = pairs.select("text", "ord", score.alias("score")).where(F.col("score") >= cutoff)
        want = rated.groupBy("text").agg(F.max_by(F.struct("ord", "score"), F.struct("score", -F.col("ord"))).alias("r"))
        want = {r["text"]: (names[r["r"]["ord"]], round(r["r"]["score"], 9)) for r in want.collect()}
        got = {r["text"]: (r["brand"], round(r["score"], 9)) for r in fuzzy.best_brands(frame, brands, cutoff).collect()}
        assert got == want and len(want) > 100
    assert fuzzy.best_brands(frame.limit(0), brands, 0.8).count() == 0 == fuzzy.best_brands(frame, brands.limit(0), 0.8).count()



def test_few_pairs_are_scored_where_brands_share_most_of_their_text(spark, monkeypatch):
    import hashlib

    from partloom.operators import fuzzy

    names = [f"{c} ring {hashlib.md5(f'{c}{i}'.encode()).hexdigest()[:5]}" for c in ("large", "small") for i in range(400)]
    brands = spark.createDataFrame(list(enumerate(names)), "ord int, brand string")
    wrong = {n[:2] + "x" + n[3:]: n for n in names} | {f"{n} tools": n for n in names}
    real, scored = fuzzy.candidates, []

    def counted(*args):
        pairs = real(*args)
        scored.append(pairs.count())
        return pairs

    monkeypatch.setattr(fuzzy, "candidates", counted)
    frame = spark.createDataFrame([(t,) for t in wrong], "text string")
    assert {r["text"]: r["brand"] for r in fuzzy.best_brands(frame, brands, 0.8).collect()} == wrong
    assert sum(scored) < 3 * len(wrong)


def test_anchors_are_the_rarest_words(spark):
    import random
    import re

    draw = random.Random(4)
    words = [f"w{i}" for i in range(12)]
    aliases = [(i, " ".join(draw.choice(words) for _ in range(draw.randrange(1, 5))), f"B{i}") for i in range(60)] + [(60, "a&b", "AB"), (61, "***", "None")]
    texts = [(i, draw.choice([" ", "-", ", "]).join(draw.choice(words) for _ in range(draw.randrange(0, 9)))) for i in range(150)] + [(150, "x A&B."), (151, None)]
    frame = spark.createDataFrame(aliases, "ord int, alias string, brand string")
    got = {r["id"]: r["embedded_brand"] for r in embedded_alias_join(spark.createDataFrame(texts, "id int, t string"), "id", "t", frame).collect()}
    want = {i: next((b for _, a, b in aliases[:-1] if re.search(rf"\b{re.escape(a)}\b", (t or "").lower())), None) for i, t in texts}
    assert got == want and len(set(want.values())) > 8
