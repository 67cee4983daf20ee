"""String expressions: trimming, placeholder removal, null words, regex rewriting."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from partloom import vocab

# Java's \s is ASCII; catalog exports carry no-break and typographic blanks as well.
WS = r"[\s\x{1c}-\x{1f}\x{85}\p{Z}]"

SUPPLIER_CODE = rf"(?i){WS}*\({WS}*(?:\d{{3,6}}|[A-Z]{{3,6}}){WS}*\)"
PLACEHOLDER = (
    rf"(?i)--{WS}*(?:Unbranded|No{WS}+Unilog{WS}+Brand|No{WS}+DIB{WS}+Brand|Unassigned"
    rf"|Not{WS}+Applicable|N/A|TBD|Unknown|None|Null){WS}*--"
    r"|\[(?:placeholder|tbd|unknown|n/a)\]|\b(?:TBD|N/A|None|Null|Unknown|\?\?\?)\b"
)
COMPANY_NOISE = (
    rf"(?i){WS}*(?:\(\w+\)|LLC|Inc\.?|Corp\.?|Co\.?|Supply|Accessory|Tools?|Company|Products?)\b"
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{WS}+|{WS}+$", "")


def squish(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, f"{WS}+", " "))


def one_of(c: Column, words: Iterable[str]) -> Column:
    return c.isin(list(words))


def blank_to_null(c: Column) -> Column:
    return F.when(c != "", c)


def present(c: Column) -> Column:
    return F.coalesce(strip(c) != "", F.lit(False))


def text_or(c: Column, default: str | Column = "") -> Column:
    """``c`` unless it is null or the empty string."""
    other = F.lit(default) if isinstance(default, str) else default
    return F.when(c != "", c).otherwise(other)


def clean_placeholders(c: Column) -> Column:
    """Drop supplier codes and placeholder noise; null when nothing is left."""
    without_codes = F.regexp_replace(c, SUPPLIER_CODE, " ")
    cleaned = squish(F.regexp_replace(without_codes, PLACEHOLDER, " "))
    return let(cleaned, lambda t: F.when(~one_of(F.lower(t), vocab.NULL_WORDS), t))


def sanitize_field(c: Column) -> Column:
    """Null for a cell that holds nothing but a placeholder."""
    return let(strip(c), lambda t: F.when(~one_of(F.lower(t), vocab.FIELD_PLACEHOLDERS), t))


def clean_cell(c: Column) -> Column:
    """Trimmed cell; empty for null and the words that stand for null in exports."""
    return let(
        strip(F.coalesce(c, F.lit(""))),
        lambda t: F.when(one_of(F.lower(t), vocab.EMPTY_WORDS), F.lit("")).otherwise(t),
    )


def company_query(c: Column) -> Column:
    """Company name without parenthesised codes and legal-form words, for brand lookup."""
    return let(
        clean_placeholders(c),
        lambda t: text_or(strip(F.regexp_replace(t, COMPANY_NOISE, "")), t),
    )


def rewrite(c: Column, pattern: str, replace: Callable[[Column], Column]) -> Column:
    """Replace every match of ``pattern`` by a function of the matched text."""

    def splice(t: Column) -> Column:
        gaps = F.split(t, pattern, -1)
        matches = F.regexp_extract_all(t, F.lit(pattern), F.lit(0))
        pieces = F.zip_with(
            gaps,
            matches,
            lambda gap, hit: F.concat(gap, F.coalesce(replace(hit), F.lit(""))),
        )
        return F.array_join(pieces, "")

    return let(c, lambda t: F.when(t.rlike(pattern), splice(t)).otherwise(t))


def literal_table(value, ddl: str) -> Column:
    """A small table as one constant: a single literal, folded before the job starts."""
    return F.from_json(F.lit(json.dumps(value, ensure_ascii=False)), ddl)


def lookup(table: dict[str, str], key: Column) -> Column:
    """Value of a literal table, null when the key is absent."""
    if not table:
        return F.lit(None).cast("string")
    return F.try_element_at(literal_table(table, "map<string,string>"), key)


def title_each(c: Column) -> Column:
    """Upper-case the first letter of every run of letters (``push-to-connect`` included)."""
    return F.array_join(
        F.transform(F.split(c, "(?<=[^A-Za-z])"), lambda w: F.initcap(w)), ""
    )
