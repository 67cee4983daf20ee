"""Brand and manufacturer resolution.

The tables that come with the package are inlined as literals, so resolving a feed of any length needs no shuffle.  For
tables that grow there are join forms: ``embedded_alias_join`` here, and those of ``operators.master``.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partloom import vocab as V
from partloom.functions.text import blank_to_null, literal_table, lookup, strip, text_or
from partloom.operators.common import growing, materialize, same_key
from partloom.vocab import DEFAULT, Vocabulary

BRAND_STRUCT = "struct<brand:string,score:double>"
NEAR_LENGTHS = 1.5
TOKEN_WEIGHT = 0.95


def brand_by_prefix(mpn: Column, vocab: Vocabulary = DEFAULT) -> Column:
    """Brand whose part-number prefix starts ``mpn``; the longest prefix wins."""
    longest_first = sorted(vocab.prefixes, key=len, reverse=True)
    pattern = "^(" + "|".join(re.escape(p) for p in longest_first) + ")"
    key = F.lower(strip(mpn))
    return F.when(key.rlike(pattern), lookup(vocab.prefixes, F.regexp_extract(key, pattern, 1)))


def brand_by_alias(text: Column, vocab: Vocabulary = DEFAULT) -> Column:
    """Brand when the whole text is one of its spellings."""
    return lookup(vocab.aliases, F.lower(strip(text)))


def brand_by_embedded_alias(text: Column, vocab: Vocabulary = DEFAULT) -> Column:
    """Brand with a spelling of four or more characters inside the text as whole words.

    Of several, the spelling registered first wins.  One pass: a zero-width alternation is tried at
    every position, so overlapping spellings are all seen.
    """
    pattern = r"(?=\b(" + "|".join(re.escape(a) for a, _ in vocab.embedded_aliases) + r")\b)"
    order = {alias: {"ord": i, "brand": b} for i, (alias, b) in enumerate(vocab.embedded_aliases)}
    table = literal_table(order, "map<string,struct<ord:int,brand:string>>")
    lowered = F.lower(strip(text))
    hits = F.regexp_extract_all(lowered, F.lit(pattern), F.lit(1))
    first = F.array_min(F.transform(hits, lambda h: F.try_element_at(table, h)))
    return F.when(lowered.rlike(pattern), first["brand"])


def comparable(text: Column) -> Column:
    """Lower case, everything but letters and digits as blank."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]", " "))


def _comparable_literal(text: str) -> str:
    return re.sub(r"[\W_]", " ", text.lower()).strip()


def _tokens(c: Column) -> Column:
    return F.array_sort(F.filter(F.split(c, " +"), lambda t: t != ""))


def similarity(text: Column, tokens: Column, ordered: Column, brand: Column) -> Column:
    """0..1 similarity of a normalized text to one brand entry.

    Texts of like length compare by edit distance, in given and in sorted word order, and by one
    word set containing the other.  A much longer text can only score by holding the brand, or a
    word of it, at a discount that grows with the length ratio.
    """

    def ratio(a: Column, b: Column) -> Column:
        return 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1))

    longer = F.greatest(F.length(text), F.length(brand["norm"]))
    shorter = F.least(F.length(text), F.length(brand["norm"]))
    within = (F.size(F.array_except(brand["tokens"], tokens)) == 0) | (
        F.size(F.array_except(tokens, brand["tokens"])) == 0
    )
    near = F.greatest(
        ratio(text, brand["norm"]),
        TOKEN_WEIGHT * F.when(within, F.lit(1.0)).otherwise(ratio(ordered, brand["sorted"])),
    )
    scale = F.when(longer <= shorter * 8, F.lit(0.9)).otherwise(F.lit(0.6))
    held = F.contains(text, brand["norm"]) | F.contains(brand["norm"], text)
    far = F.when(held, scale).when(
        F.arrays_overlap(tokens, brand["tokens"]), TOKEN_WEIGHT * scale
    ).otherwise(F.lit(0.0))
    return F.when(longer < shorter * NEAR_LENGTHS, near).otherwise(far)


def _brand_entries(vocab: Vocabulary) -> Column:
    entries = []
    for i, name in enumerate(vocab.canonical):
        norm = _comparable_literal(name)
        tokens = sorted(norm.split())
        entries.append(
            {"norm": norm, "tokens": tokens, "sorted": " ".join(tokens), "rank": -i, "brand": name}
        )
    return literal_table(
        entries,
        "array<struct<norm:string,tokens:array<string>,sorted:string,rank:int,brand:string>>",
    )


def add_brand_match(
    df: DataFrame,
    text: str,
    out: str,
    cutoff: float,
    vocab: Vocabulary = DEFAULT,
    when: Column | None = None,
) -> DataFrame:
    """Add ``out`` = (brand, score): exact spelling, embedded spelling, then best similarity.

    Below ``cutoff`` the brand is the text itself with score 0.  Rows where ``when`` is false get
    null and cost nothing.  Only the similarity step is a row-by-brand product; it runs inside the
    row, against the inlined brands, for rows nothing else resolved.
    """
    wanted = (F.col(text) != "") & (strip(F.col(text)) != "")
    if when is not None:
        wanted = wanted & when
    known, query, words, line = (f"{out}_{s}" for s in ("known", "query", "words", "line"))

    def entry(brand: Column, score: Column) -> Column:
        return F.struct(brand.alias("brand"), score.cast("double").alias("score"))

    exact, embedded = brand_by_alias(F.col(text), vocab), brand_by_embedded_alias(F.col(text), vocab)
    df = df.withColumn(
        known,
        F.when(
            wanted,
            F.coalesce(
                F.when(exact.isNotNull(), entry(exact, F.lit(1.0))),
                F.when(embedded.isNotNull(), entry(embedded, F.lit(0.95))),
                entry(strip(F.col(text)), F.lit(0.0)),
            ),
        ),
    )
    df = df.withColumn(
        query, F.when(F.col(known)["score"] == 0, blank_to_null(comparable(F.col(text))))
    )
    tokens = _tokens(F.col(query))
    df = df.withColumns({words: tokens, line: F.array_join(tokens, " ")})
    scored = F.transform(
        _brand_entries(vocab),
        lambda b: F.struct(
            similarity(F.col(query), F.col(words), F.col(line), b).alias("score"),
            b["rank"].alias("rank"),
            b["brand"].alias("brand"),
        ),
    )
    df = df.withColumn(f"{out}_best", F.when(F.col(query).isNotNull(), F.array_max(scored)))
    best = F.col(f"{out}_best")
    df = df.withColumn(
        out,
        F.when(best["score"] >= cutoff, entry(best["brand"], F.round(best["score"], 3))).otherwise(
            F.col(known)
        ),
    )
    return df.drop(known, query, words, line, f"{out}_best")


def is_distributor(name: Column, vocab: Vocabulary = DEFAULT) -> Column:
    pattern = "|".join(re.escape(t) for t in vocab.distributors)
    return F.coalesce(F.lower(strip(name)).rlike(pattern), F.lit(False))


def without_marks(c: Column) -> Column:
    return strip(F.translate(c, "®™", ""))


def manufacturer_of(brand: Column, vocab: Vocabulary = DEFAULT) -> Column:
    """Legal manufacturer of a brand; an unknown brand stands for itself, without marks."""
    return F.coalesce(
        lookup(vocab.manufacturers, F.lower(strip(brand))), without_marks(brand), F.lit("")
    )


def resolve_entity(
    df: DataFrame,
    desc: str,
    mpn: str,
    raw_brand: str,
    raw_manuf: str,
    vocab: Vocabulary = DEFAULT,
) -> DataFrame:
    """Add ``brand``, ``manufacturer``, ``supplier``, ``brand_score`` and ``brand_source``.

    Sources in order: part-number prefix, description, brand column, manufacturer column unless
    that names a distributor.  Each step looks only at rows the earlier ones left open.
    """
    df = df.withColumn("_prefix", brand_by_prefix(F.col(mpn), vocab))
    df = add_brand_match(df, desc, "_desc", 0.85, vocab, F.col("_prefix").isNull())
    desc_hit = F.coalesce(F.col("_desc")["score"] >= 0.85, F.lit(False))
    open_1 = F.col("_prefix").isNull() & ~desc_hit
    usable = ~strip(F.col(raw_brand)).isin(V.BRAND_PLACEHOLDERS)
    df = add_brand_match(df, raw_brand, "_named", 0.80, vocab, open_1 & usable)
    named_hit = F.coalesce(F.col("_named")["score"] >= 0.80, F.lit(False))
    open_2 = open_1 & ~named_hit & ~is_distributor(F.col(raw_manuf), vocab)
    df = add_brand_match(df, raw_manuf, "_maker", 0.80, vocab, open_2)
    df = decided(df, raw_brand, raw_manuf, "_prefix", "_desc", "_named", "_maker").drop("_prefix", "_desc", "_named", "_maker")
    return with_supplier(df, raw_manuf).withColumn("manufacturer", manufacturer_of(F.col("brand"), vocab)).select(
        *[c for c in df.columns if c not in ("brand", "brand_score", "brand_source")], "brand", "manufacturer", "supplier", "brand_score", "brand_source"
    )


def decided(df: DataFrame, raw_brand: str, raw_manuf: str, prefix: str, desc: str, named: str, maker: str) -> DataFrame:
    """Add ``brand``, ``brand_score`` and ``brand_source``: the first source that says something.

    ``prefix`` is a brand; the others are (brand, score), null where the source is not to be used.
    """
    good = lambda m, least: F.coalesce(F.col(m)["score"] >= least, F.lit(False))
    fallback = F.when(
        (F.col(raw_brand) != "") & ~F.startswith(F.col(raw_brand), F.lit("--")), F.col(raw_brand)
    ).otherwise(text_or(F.col(raw_manuf), F.lit("")))

    def result(brand: Column, score: Column, source: str) -> Column:
        return F.struct(brand.alias("brand"), F.round(score, 3).alias("score"), F.lit(source).alias("source"))

    def matched(m: str, source: str) -> Column:
        return result(F.col(m)["brand"], F.col(m)["score"], source)

    chosen = (
        F.when(F.col(prefix).isNotNull(), result(F.col(prefix), F.lit(1.0), "prefix"))
        .when(good(desc, 0.85), matched(desc, "description"))
        .when(good(named, 0.80), matched(named, "brand_column"))
        .when(good(maker, 0.80), matched(maker, "manufacturer"))
        .otherwise(result(fallback, F.when(fallback != "", F.lit(0.5)).otherwise(F.lit(0.0)), "fallback"))
    )
    df = df.withColumn("_hit", chosen)
    return df.withColumns({"brand": F.col("_hit.brand"), "brand_score": F.col("_hit.score"), "brand_source": F.col("_hit.source")}).drop("_hit")


def with_supplier(df: DataFrame, raw_manuf: str) -> DataFrame:
    return df.withColumn("supplier", F.coalesce(strip(F.col(raw_manuf)), F.lit("")))


def alias_table(spark, vocab: Vocabulary = DEFAULT) -> DataFrame:
    rows = [(i, a, b, len(a.split())) for i, (a, b) in enumerate(vocab.embedded_aliases)]
    return spark.createDataFrame(rows, "ord int, alias string, brand string, words int")


def embedded_alias_join(df: DataFrame, row_key: str, text: str, aliases: DataFrame) -> DataFrame:
    """``brand_by_embedded_alias`` for alias tables of any size.

    An alias is entered under its anchor, the word of it that fewest aliases have; a text that holds the alias has that word.  So a
    distinct text sends its distinct words, one row each, whatever lengths aliases have, and meets only aliases that may be in it.
    Of aliases that are spelled alike only the first can win, so one stands for all.  The exact whole-word test runs where text and alias
    meet; what passes it is reduced to the first alias for each text, so neither pairs nor groups that grow with the data are
    exchanged.  An alias without a letter or digit is in no text.
    """
    words_of = lambda c: F.filter(F.array_distinct(F.split(F.regexp_replace(F.lower(c), r"\W+", " "), " ")), lambda w: w != "")
    spelled = aliases.groupBy("alias").agg(F.min_by("brand", "ord").alias("brand"), F.min("ord").alias("ord"))
    entered = spelled.select("ord", "alias", "brand", F.explode(words_of(F.col("alias"))).alias("word"))
    common = entered.groupBy("word").agg(F.count("*").alias("n"))
    anchored = entered.join(growing(common), "word").groupBy("ord", "alias", "brand").agg(F.min_by("word", F.struct("n", "word")).alias("word"))
    anchored = materialize(anchored, "anchored")
    keyed = df.withColumn("_text", F.lower(strip(F.col(text))))
    texts = keyed.select(F.col("_text").alias("_held")).where("_held IS NOT NULL").distinct()
    words = texts.select("_held", F.explode(words_of(F.col("_held"))).alias("word"))
    whole_word = F.concat(
        F.lit(r"\b"), F.regexp_replace("alias", r"([^\w\s])", r"\\$1"), F.lit(r"\b")
    )
    hits = (
        words.join(anchored, "word")
        .where(F.contains(F.col("_held"), F.col("alias")))
        .where(F.regexp_like(F.col("_held"), whole_word))
        .groupBy("_held")
        .agg(F.min_by("brand", "ord").alias("embedded_brand"))
    )
    return keyed.join(growing(hits), same_key("_text", "_held"), "left").drop("_text", "_held")
