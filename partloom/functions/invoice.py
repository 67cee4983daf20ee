"""Length-limited descriptions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from partloom import vocab
from partloom.functions.text import clean_placeholders, let, literal_table, squish, strip, text_or


def _shorten(text: Column) -> Column:
    """Apply one abbreviation after the other, only as long as the text is over the limit."""
    steps = literal_table(
        [{"term": term, "short": short} for term, short in vocab.INVOICE_WHILE_LONG],
        "array<struct<term:string,short:string>>",
    )
    return F.aggregate(
        steps,
        text,
        lambda acc, s: F.when(F.length(acc) <= vocab.INVOICE_LIMIT, acc).otherwise(
            F.trim(F.replace(acc, s["term"], s["short"]))
        ),
    )


def cut_at_word(c: Column, limit: int) -> Column:
    return F.when(F.length(c) <= limit, c).otherwise(
        F.rtrim(F.regexp_replace(F.substring(c, 1, limit), " [^ ]*$", ""))
    )


def compress_invoice(c: Column) -> Column:
    """Upper case, at most 40 characters, shortened by abbreviation before anything is cut off."""
    base = F.upper(squish(F.coalesce(clean_placeholders(c), c)))
    for term, short in vocab.INVOICE_ALWAYS:
        base = F.replace(base, F.lit(term), F.lit(short))
    limit = vocab.INVOICE_LIMIT
    short_enough = let(
        base, lambda t: F.when(F.length(t) <= limit, t).otherwise(cut_at_word(_shorten(t), limit))
    )
    return F.coalesce(short_enough, F.lit(""))


def mobile_60_80(
    brand: Column, item_type: Column, series: Column, mpn: Column, summary: Column
) -> Column:
    """Brand, type, series, part number and a summary, padded or cut to 60-80 characters."""
    kind = F.coalesce(strip(text_or(item_type, F.lit(None))), F.lit("Product"))
    base = F.concat_ws(
        ", ",
        F.coalesce(strip(text_or(brand, F.lit(None))), F.lit("UNASSIGNED")),
        kind,
        F.when(series != "", strip(series)),
        strip(mpn),
    )
    full = let(
        base,
        lambda b: F.when(
            (summary != "") & (F.length(b) + F.length(summary) + 2 <= 78),
            F.concat(b, F.lit(", "), summary),
        ).otherwise(b),
    )
    return let(
        full,
        lambda t: F.when(
            F.length(t) < 60,
            F.substring(F.concat(t, F.lit(" - Industrial Grade "), kind), 1, 78),
        )
        .when(F.length(t) > 80, F.regexp_replace(F.substring(t, 1, 80), " [^ ]*$", ""))
        .otherwise(t),
    )
