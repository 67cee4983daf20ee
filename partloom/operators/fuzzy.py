"""Best brand by similarity for brand tables of any size: an inverted index in front of the exact score."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from partloom import vocab as V
from partloom.functions.text import strip
from partloom.operators.common import growing, materialize, same_key
from partloom.operators.entity import (
    NEAR_LENGTHS,
    TOKEN_WEIGHT,
    comparable,
    decided,
    embedded_alias_join,
    is_distributor,
    similarity,
    with_supplier,
    without_marks,
)
from partloom.operators.master import lookup_join, prefix_join

#: Scores a text can have without being near a brand: it holds the brand, or a word of it, at up to FAR times the length.
FAR, HELD_SCORE = 8, 0.9
#: Texts with a brand of this score or more are matched first: at most an edit in 12 characters, so brands are cut into few, long parts.
STRICT = 0.92
#: Brands up to this length are cut into parts; the places a text is asked at grow with the third power of the length.
LONG = 48
_SLACK = 1e-9


def _forms(df: DataFrame, key: str, text: Column) -> DataFrame:
    """(key, norm, tokens, sorted, size, width): what the score looks at, and the lengths of ``norm`` and ``sorted``; texts without a
    letter or digit are left out."""
    norm = df.select(key, comparable(text).alias("norm")).where("norm <> ''")
    norm = norm.withColumn("tokens", F.array_sort(F.filter(F.split("norm", " +"), lambda t: t != "")))
    norm = norm.withColumn("sorted", F.array_join("tokens", " "))
    return norm.withColumns({"size": F.length("norm"), "width": F.length("sorted")})


def _grams(text: Column, n: Column) -> Column:
    """The distinct runs of ``n`` characters; a shorter text is its own."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(text) - (n - 1), F.lit(1)))
    return F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, n)))


def _sizes(df: DataFrame, column: str) -> list[int]:
    return sorted(r[0] for r in df.select(column).distinct().collect())


def _edits(size: int, least: float) -> int:
    """The most edits between a brand of this length and a text with a similarity of ``least`` or more, which is at most 1 / least times as long."""
    return math.floor(size * ((1 - least) / least) + _SLACK)


def _segments(size: int, least: float) -> list[tuple[int, int, int]]:
    """(number, start, width) of the parts a brand is cut into, one more than there may be edits, so one of them is left whole."""
    k = _edits(size, least) + 1
    edges = [i * size // k for i in range(k + 1)]
    return [(i, edges[i], edges[i + 1] - edges[i]) for i in range(k)]


def _probes(t_sizes: list[int], b_sizes: list[int], least: float) -> list[tuple[int, int, int, int, int]]:
    """(text size, brand size, number, start, width): where in a text a whole part of a brand may stand.

    Of the parts that are left whole take the first before which there are as many edits as parts: then at most that many edits stand
    before it and at most the rest after it, and they bound how far it is shifted.
    """
    out = []
    for b in b_sizes:
        most, parts = _edits(b, least), _segments(b, least)
        for t in t_sizes:
            if min(t, b) < least * max(t, b) - _SLACK:
                continue
            shift, edits = t - b, math.floor((1 - least) * max(t, b) + _SLACK)
            for i, start, width in parts:
                low = max(-i, shift - (most - i), -((edits - shift) // 2))
                high = min(i, shift + most - i, (edits + shift) // 2)
                out += [(t, b, i, at + 1, width) for at in range(max(0, start + low), min(t - width, start + high) + 1)]
    return out


def _close(texts: DataFrame, brands: DataFrame, form: str, size: str, least: float) -> list[DataFrame]:
    """Pairs (text, ord) whose ``form`` has a similarity by edit distance of ``least`` or more, and others.

    Brands up to ``LONG`` are cut into parts, and texts are asked for the parts of every length of brand there is, near their place.  Of
    longer ones the rarest grams are compared: so many first ones that one is common.
    """
    spark = texts.sparkSession
    t_sizes, b_sizes = _sizes(texts, size), _sizes(brands, size)
    short = [b for b in b_sizes if b <= LONG]
    cuts = [(b, s[0], s[1] + 1, s[2]) for b in short for s in _segments(b, least)]
    cut = F.broadcast(spark.createDataFrame(cuts, f"{size} int, number int, start int, n int"))
    ask = F.broadcast(spark.createDataFrame(_probes(t_sizes, short, least), f"{size} int, b_size int, number int, start int, n int"))
    part = F.substring(F.col(form), F.col("start"), F.col("n")).alias("part")
    b = brands.join(cut, size).select("ord", F.col(size).alias("b_size"), "number", part)
    t = texts.join(ask, size).select("text", "b_size", "number", part)
    found = [t.join(growing(b), ["b_size", "number", "part"]).select("text", "ord")]
    if short != b_sizes:
        n = 4 if least >= STRICT else 2
        grams = lambda df, key: df.select(key, F.col(size).alias("size"), F.explode(_grams(F.col(form), F.lit(n))).alias("part"))
        own = grams(brands.where(F.col(size) > LONG), "ord")
        counts = own.groupBy("part").agg(F.count("*").alias("n"))

        def first(keys: DataFrame, key: str) -> DataFrame:
            order = Window.partitionBy(key).orderBy(F.coalesce("n", F.lit(0)), "part")
            placed = keys.join(growing(counts), "part", "left").withColumn("place", F.row_number().over(order))
            # an edit touches n grams
            return placed.where(F.col("place") <= F.floor(F.col("size") * ((1 - least) / least) + _SLACK) * n + 1).select(key, "part")

        asking = grams(texts.where(F.col(size) >= F.lit(LONG * least - _SLACK)), "text")
        found.append(first(asking, "text").join(growing(first(own, "ord")), "part").select("text", "ord"))
    return found


def _held_grams(short: list[int], long: list[int]) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """(size, n): length of the grams by which a text is found in one that is 1.5 to ``FAR`` times as long, for either."""
    length = lambda size: next(n for n in (8, 4, 2, 1) if n <= size)
    met = [(s, x) for s in short for x in long if s * NEAR_LENGTHS <= x <= s * FAR]
    return sorted({(s, length(s)) for s, _ in met}), sorted({(x, length(s)) for s, x in met})


def candidates(texts: DataFrame, brands: DataFrame, cutoff: float) -> DataFrame:
    """(text, ord): at least all pairs whose score is ``cutoff`` or more and could be the best of the text.

    Both are ``_forms`` by that name.  Near texts share a part that edits left whole, as written or with sorted words, or one has all
    words of the other, so also its rarest one.  A text that holds a brand has the brand's rarest gram, and the other way
    round; a gram has up to eight characters, as the shorter one allows.  Texts that only share a word all get the same score, so of
    those with the same word and length the first brand stands for all.

    Each rule has a join of its own, over the keys it looks at; what lengths there are is all the driver sees.
    """
    spark = texts.sparkSession
    near = F.greatest("size", "b_size") < F.least("size", "b_size") * NEAR_LENGTHS
    far = ~near & (F.greatest("size", "b_size") <= F.least("size", "b_size") * FAR)
    named = lambda df: df.withColumnRenamed("size", "b_size")
    paired = lambda t, b, lengths: t.join(growing(named(b)), "part").where(lengths).select("text", "ord")

    def rarest(keys: DataFrame, key: str, counts: DataFrame) -> DataFrame:
        known = keys.join(growing(counts), "part", "left")
        least = known.groupBy(key, "size").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "part")).alias("r"))
        return least.where("r.n > 0").select(key, "size", "r.part")

    counted = lambda keys: keys.groupBy("part").agg(F.count("*").alias("n"))
    found = _close(texts, brands, "norm", "size", cutoff)
    if cutoff <= TOKEN_WEIGHT:
        found += _close(texts, brands, "sorted", "width", cutoff / TOKEN_WEIGHT)
        words = lambda df, key: df.select(key, "size", F.explode(F.array_distinct("tokens")).alias("part"))
        t, b = words(texts, "text"), materialize(words(brands, "ord"), "brand_words")
        n = counted(b)
        found += [paired(t, rarest(b, "ord", n), near), paired(rarest(t, "text", n), b, near)]
    if cutoff <= HELD_SCORE:
        grams = lambda df, key, by: df.join(F.broadcast(spark.createDataFrame(by, "size int, n int")), "size").select(
            key, "size", F.explode(_grams(F.col("norm"), F.col("n"))).alias("part")
        )
        t_sizes, b_sizes = _sizes(texts, "size"), _sizes(brands, "size")
        b_short, t_long = _held_grams(b_sizes, t_sizes)
        own = grams(brands, "ord", b_short)
        found.append(paired(grams(texts, "text", t_long), rarest(own, "ord", counted(own)), far))
        t_short, b_long = _held_grams(t_sizes, b_sizes)
        asking, holding = grams(texts, "text", t_short), grams(brands, "ord", b_long)
        found.append(paired(rarest(asking, "text", counted(holding)), holding, far))
    if cutoff <= TOKEN_WEIGHT * HELD_SCORE:
        shortest = b.groupBy("part", F.col("size").alias("b_size")).agg(F.min("ord").alias("ord"))
        found.append(t.join(shortest, "part").where(far).groupBy("text").agg(F.min("ord").alias("ord")))
    return reduce(DataFrame.unionByName, found).distinct()


def best_brands(texts: DataFrame, brands: DataFrame, cutoff: float) -> DataFrame:
    """(text, brand, score): the brand of (ord, brand) most similar to each distinct ``text``, where the score is ``cutoff`` or more.

    The score is that of ``entity.similarity``; of equal scores the least ``ord`` wins.  Only candidates from an inverted index are
    scored, and none is missed, for cutoffs above 0.6.  Where the candidates of ``STRICT`` or more have a best one it is the best
    of all, so only the other texts are looked up with the lower ``cutoff``.  Null texts and texts without letters or digits have no
    brand.
    """
    if cutoff <= FAR_SCORE:
        raise ValueError(f"cutoff must be above {FAR_SCORE}")
    wanted = texts.select("text").where("text IS NOT NULL").distinct()
    t = materialize(_forms(wanted, "text", F.col("text")), "texts")
    # brands that compare alike have the same score with every text, and the first of them wins
    firsts = brands.where("brand IS NOT NULL").groupBy(comparable(F.col("brand")).alias("norm")).agg(F.min_by(F.struct("ord", "brand"), "ord").alias("b"))
    firsts = firsts.select("b.ord", "b.brand")
    b = materialize(_forms(firsts, "ord", F.col("brand")).join(growing(firsts), "ord"), "brands")

    def best(of: DataFrame, least: float) -> DataFrame:
        pairs = candidates(of, b.drop("brand"), least)
        entry = F.struct("norm", "tokens", "sorted")
        scored = pairs.join(growing(b.select("ord", "brand", entry.alias("b"))), "ord").join(growing(of), "text")
        score = similarity(F.col("norm"), F.col("tokens"), F.col("sorted"), F.col("b"))
        rated = scored.select("text", "ord", "brand", score.alias("score")).where(F.col("score") >= least)
        top = rated.groupBy("text").agg(F.max_by(F.struct("brand", "score"), F.struct("score", -F.col("ord"))).alias("r"))
        return top.select("text", "r.brand", "r.score")

    if cutoff >= STRICT:
        return best(t, cutoff)
    near = materialize(best(t, STRICT), "near")
    rest = materialize(t.join(growing(near.select("text")), "text", "left_anti"), "rest")
    return near if rest.isEmpty() else near.unionByName(best(rest, cutoff))


#: The score of a text that holds a brand but is more than FAR times as long.
FAR_SCORE = 0.6


def match_brands(texts: DataFrame, brands: DataFrame, aliases: DataFrame, cutoff: float) -> DataFrame:
    """(text, brand, score) of each distinct non-blank ``text``: exact alias (1), alias inside it as whole words (0.95), most similar brand.

    ``brands`` is (ord, brand), ``aliases`` is (ord, alias, brand) with the aliases in lower case; only those of four or more characters are
    looked for inside texts.  A text that matches nothing is its own brand, with a score of 0.
    """
    key = F.lower(strip(F.col("text")))
    wanted = texts.select("text").where((strip(F.col("text")) != "")).distinct()
    first = aliases.groupBy(F.col("alias").alias("key")).agg(F.min_by("brand", "ord").alias("value"))
    exact = materialize(lookup_join(wanted, key, first, "exact"), "exact")
    inside = aliases.where(F.length("alias") >= 4).select("ord", "alias", "brand")
    held = materialize(embedded_alias_join(exact.where("exact IS NULL").select("text"), "text", "text", inside), "held")
    near = best_brands(held.where("embedded_brand IS NULL"), brands, cutoff)
    entry = lambda brand, score: F.struct(brand.alias("brand"), score.cast("double").alias("score"))
    found = exact.where("exact IS NOT NULL").select("text", entry(F.col("exact"), F.lit(1.0)).alias("m"))
    found = found.unionByName(held.where("embedded_brand IS NOT NULL").select("text", entry(F.col("embedded_brand"), F.lit(0.95)).alias("m")))
    rest = held.where("embedded_brand IS NULL").select("text").join(growing(near), "text", "left")
    matched = F.when(F.col("score").isNotNull(), entry(F.col("brand"), F.col("score"))).otherwise(entry(strip(F.col("text")), F.lit(0.0)))
    return found.unionByName(rest.select("text", matched.alias("m"))).select("text", "m.brand", "m.score")


@dataclass(frozen=True)
class Masters:
    """Master tables of any size: ``brands`` (ord, brand), ``aliases`` (ord, alias, brand), and ``prefixes`` of part numbers and
    ``makers`` of brands, both (key, value) with unique keys in lower case."""

    brands: DataFrame
    aliases: DataFrame
    prefixes: DataFrame
    makers: DataFrame


def resolve_entity_join(df: DataFrame, desc: str, mpn: str, raw_brand: str, raw_manuf: str, masters: Masters) -> DataFrame:
    """``entity.resolve_entity`` with master tables of any size.

    Part numbers and texts are looked up once for each distinct one: the texts of all three columns that may be needed go through
    one pass of ``match_brands`` and are joined back.  A text that many rows have is an ordinary skewed left side of these joins.
    """
    numbers = df.select(F.col(mpn).alias("_n")).where("_n <> ''").distinct()
    known = prefix_join(numbers, "_n", F.col("_n"), masters.prefixes, "_prefix").select("_n", "_prefix")
    rows = materialize(df.join(growing(known), same_key(mpn, "_n"), "left").drop("_n"), "numbered")
    open_ = rows.where("_prefix IS NULL")
    named = F.when(~strip(F.col(raw_brand)).isin(V.BRAND_PLACEHOLDERS), F.col(raw_brand))
    maker = F.when(~is_distributor(F.col(raw_manuf)), F.col(raw_manuf))
    texts = open_.select(F.explode(F.array(F.col(desc), named, maker)).alias("text"))
    found = materialize(match_brands(texts, masters.brands, masters.aliases, 0.80), "matched")
    keyed = rows.withColumns({"_t_desc": F.col(desc), "_t_named": named, "_t_maker": maker})
    for name in ("desc", "named", "maker"):
        own = found.select(F.col("text").alias(f"_m_{name}"), F.struct("brand", "score").alias(f"_{name}"))
        keyed = keyed.join(growing(own), same_key(f"_t_{name}", f"_m_{name}"), "left").drop(f"_m_{name}", f"_t_{name}")
    out = materialize(decided(keyed, raw_brand, raw_manuf, "_prefix", "_desc", "_named", "_maker").drop("_prefix", "_desc", "_named", "_maker"), "decided")
    out = with_supplier(lookup_join(out, F.lower(strip(F.col("brand"))), masters.makers, "_legal"), raw_manuf)
    legal = F.coalesce("_legal", without_marks(F.col("brand")), F.lit(""))
    return out.withColumn("manufacturer", legal).select(*df.columns, "brand", "manufacturer", "supplier", "brand_score", "brand_source")
