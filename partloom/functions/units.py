"""Measurements: unit spacing, decimal inches as fractions, value/unit splitting, sanity limits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from partloom.functions.text import WS, let, lookup, rewrite, squish, strip, text_or
from partloom.vocab import DEFAULT, SLOT_UOMS, Vocabulary

UNIT_AFTER_DIGIT = (
    rf"(?i)(?<=\d){WS}*(?:in(?:ches|ch)?|\"|ft|feet|foot|'|v(?:olts?|olt)?|a(?:mps?|mperage)?"
    rf"|w(?:atts?|att)?|hz|rpm|dba?|mm|cm|m|lbs?|oz|pk|pc|ea)(?=\b|{WS}|$)"
)
MEASURED_DECIMAL = rf"(?i)(?:\d+)?\.\d+(?={WS}*(?:in|inch|inches|\"|ft|mm|cm|x|\b))"
VALUE_WITH_UNIT = rf"^([\d\-/.\s]+)\s*([A-Za-z]+)$"
GLUED_UNIT = r"(?i)\b\d+(\.\d+)?(in|v|a|w|hz|dba|lbs?|mm|cm)\b"
GLUED_UNIT_ONLY = r"(?i)^\d+(\.\d+)?(in|v|a|w|hz|dba|lbs?|mm|cm)$"
DECIMAL_INCH = r"(?i)\b\d+\.(25|5|75|125|375|625|875|0625|1875)\s*in\b"
FRACTION_TOLERANCE = 0.005


def space_units(c: Column, vocab: Vocabulary = DEFAULT) -> Column:
    """``24in`` to ``24 in``, ``120v`` to ``120 V``: one blank and the standard spelling."""

    def standard(match: Column) -> Column:
        unit = F.lower(strip(match))
        return F.concat(F.lit(" "), F.coalesce(lookup(vocab.units, unit), unit))

    return F.coalesce(squish(rewrite(c, UNIT_AFTER_DIGIT, standard)), F.lit(""))


def decimals_to_fractions(c: Column, vocab: Vocabulary = DEFAULT) -> Column:
    """``50.25 in`` to ``50-1/4 in`` where the decimals lie close to a standard fraction."""

    def fraction(part: Column) -> Column:
        exact = [(part == F.lit(v), text) for v, text in vocab.fractions.items()]
        near = [
            (F.abs(F.lit(v) - part) < F.lit(FRACTION_TOLERANCE), text)
            for v, text in vocab.fractions.items()
        ]
        (first, text), *rest = exact + near
        chain = F.when(first, text)
        for condition, text in rest:
            chain = chain.when(condition, text)
        return chain

    def convert(match: Column) -> Column:
        whole = F.regexp_replace(F.substring_index(match, ".", 1), "^0+", "")
        part = F.round(
            F.concat(F.lit("0."), F.substring_index(match, ".", -1)).try_cast("double"), 5
        )
        return let(
            fraction(part),
            lambda f: F.when(f.isNull(), match)
            .when(whole != "", F.concat(whole, F.lit("-"), f))
            .otherwise(f),
        )

    return F.coalesce(squish(rewrite(c, MEASURED_DECIMAL, convert)), F.lit(""))


def standard_unit(c: Column, vocab: Vocabulary = DEFAULT) -> Column:
    """Standard spelling of one unit, or the trimmed input when the unit is not known."""
    return F.coalesce(lookup(vocab.units, F.lower(strip(c))), strip(c), F.lit(""))


def split_value_unit(c: Column) -> Column:
    """``120 V`` to (120, V) for the units delivery slots keep apart; else (value, '')."""


    def split(value: Column) -> Column:
        unit = F.regexp_extract(value, VALUE_WITH_UNIT, 2)
        number = strip(F.regexp_extract(value, VALUE_WITH_UNIT, 1))
        return F.when(
            value.rlike(VALUE_WITH_UNIT) & unit.isin(SLOT_UOMS),
            F.struct(number.alias("value"), unit.alias("uom")),
        ).otherwise(F.struct(value.alias("value"), F.lit("").alias("uom")))

    return let(strip(c), split)


def numeric_sanity(field: Column, value: Column) -> Column:
    """Is the first number in ``value`` physically plausible for the field?"""
    number = F.regexp_extract(value, r"[-+]?(?:\d*\.\d+|\d+)", 0).try_cast("double")
    name = F.lower(field)

    def has(*words: str) -> Column:
        return name.rlike("|".join(words))

    return (
        F.when(number.isNull(), F.lit(True))
        .when(has("voltage"), (number > 0) & (number <= 1000))
        .when(has("amp"), (number > 0) & (number <= 2000))
        .when(has("dimension", "width", "depth", "height"), (number > 0) & (number <= 1000))
        .when(has("sound", "dba"), (number >= 0) & (number <= 150))
        .otherwise(number >= 0)
    )


def with_unit(value: Column, unit: str, *strippable: str) -> Column:
    """Append `` unit`` unless the value ends with it; the glued spelling is removed first."""
    bare = value
    for spelling in strippable or (unit,):
        bare = F.replace(bare, F.lit(spelling), F.lit(""))
    return F.when(F.endswith(value, F.lit(f" {unit}")), value).otherwise(
        F.concat(strip(bare), F.lit(f" {unit}"))
    )


__all__ = [
    "DECIMAL_INCH", "GLUED_UNIT", "GLUED_UNIT_ONLY", "decimals_to_fractions", "numeric_sanity",
    "space_units", "split_value_unit", "standard_unit", "text_or", "with_unit",
]
