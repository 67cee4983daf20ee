"""Confidence arithmetic and compliance rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from partloom import vocab as V
from partloom.functions.text import WS, present, strip
from partloom.functions.units import DECIMAL_INCH, GLUED_UNIT
from partloom.vocab import DEFAULT, Vocabulary

# FIXED VALUES: weights and tier limits.
W_PROVENANCE, W_LOV, W_RULES = 0.40, 0.35, 0.25
AUTO_APPROVE, REVIEW = 0.90, 0.75

SCORED_LOV_FIELDS = ["item_type", "mounting", "material", "voltage"]
SCORED_FIELDS = ["brand", "item_type", "voltage", "dimensions", "mounting", "material"]

# FIXED VALUES: reward patterns.
REWARD_GLUED = (
    r"(?i)(?<![A-Za-z0-9_])\d+(?:\.\d+)?(?:in|inch|ft|v|volt|a|amp|w|watt|hz|rpm|dba|db|psi|oz|lb|mm|cm|m)\b"
)
REWARD_DECIMAL_INCH = r"(?i)(?<![A-Za-z0-9_])\d*\.\d+\s*(?:in|inch(?:es)?|\"|in\.)\b"
REWARD_PLACEHOLDER = (
    rf"(?i)--{WS}*(?:Unbranded|No{WS}+Unilog{WS}+Brand|No{WS}+DIB{WS}+Brand|Unassigned"
    rf"|Not{WS}+Applicable|N/A){WS}*--"
)


def provenance(source_type: Column, http_status: Column | None = None) -> Column:
    kind = F.lower(strip(source_type))
    ok = F.coalesce(http_status == 200, F.lit(False)) if http_status is not None else F.lit(False)
    return (
        F.when(source_type.isNull() | (source_type == ""), F.lit(0.70))
        .when(F.contains(kind, F.lit("official")), F.when(ok, F.lit(1.0)).otherwise(F.lit(0.95)))
        .when(F.contains(kind, F.lit("nim")), F.lit(0.85))
        .when(kind.rlike("distributor|supplier"), F.lit(0.70))
        .when(kind.rlike("unverifiable|heuristic"), F.lit(0.40))
        .otherwise(F.lit(0.70))
    )


def valid_lov(name: str, value: Column, vocab: Vocabulary = DEFAULT) -> Column:
    words = [v.lower() for v in vocab.lovs.get(name, [])]
    return F.coalesce(F.lower(strip(value)).isin(words), F.lit(False))


def lov_counts(values: dict[str, Column], vocab: Vocabulary = DEFAULT) -> Column:
    """(checked, valid) over the vocabulary-bound fields of a record."""
    checked, valid = F.lit(0), F.lit(0)
    for name in SCORED_LOV_FIELDS:
        checked = checked + present(values[name]).cast("int")
        valid = valid + valid_lov(name, values[name], vocab).cast("int")
    return F.struct(checked.alias("checked"), valid.alias("valid"))


def lov_score(checked: Column, valid: Column) -> Column:
    return F.when(checked > 0, valid / checked).otherwise(F.lit(1.0))


def has_glued_unit(*values: Column) -> Column:
    return F.concat_ws("|", *values).rlike(GLUED_UNIT)


def has_decimal_inch(*values: Column) -> Column:
    return F.concat_ws("|", *values).rlike(DECIMAL_INCH)


def rule_score(invoice: Column, glued: Column, decimal_inch: Column) -> Column:
    filled = F.coalesce(invoice != "", F.lit(False))
    points = [
        filled & (F.length(invoice) <= V.INVOICE_LIMIT),
        filled & (invoice == F.upper(invoice)),
        ~glued,
        ~decimal_inch,
    ]
    total = F.lit(0.0)
    for point in points:
        total = total + F.when(point, F.lit(0.25)).otherwise(F.lit(0.0))
    return total


def confidence(p: Column, lov: Column, rules: Column) -> Column:
    total = F.lit(W_PROVENANCE) * p + F.lit(W_LOV) * lov + F.lit(W_RULES) * rules
    return F.round(F.least(F.greatest(total, F.lit(0.0)), F.lit(1.0)), 3)


def tier(score: Column) -> Column:
    return (
        F.when(score >= AUTO_APPROVE, "AUTO_APPROVED")
        .when(score >= REVIEW, "REVIEW")
        .otherwise("HITL_REQUIRED")
    )


def field_confidences(
    values: dict[str, Column], p: Column, glued: Column, decimal_inch: Column,
    vocab: Vocabulary = DEFAULT,
) -> Column:
    """Map of field to confidence for the fields the record fills."""
    entries = []
    for name in SCORED_FIELDS:
        lov = F.lit(1.0)
        if name in SCORED_LOV_FIELDS:
            lov = F.when(valid_lov(name, values[name], vocab), F.lit(1.0)).otherwise(F.lit(0.0))
        rule = F.lit(1.0)
        if name in ("dimensions", "voltage"):
            broken = decimal_inch if name == "dimensions" else glued
            rule = F.when(broken, F.lit(0.5)).otherwise(F.lit(1.0))
        score = F.round(F.lit(W_PROVENANCE) * p + F.lit(W_LOV) * lov + F.lit(W_RULES) * rule, 3)
        entries.append(
            F.struct(F.lit(name).alias("key"), F.when(present(values[name]), score).alias("value"))
        )
    return F.map_from_entries(F.filter(F.array(*entries), lambda e: e["value"].isNotNull()))


def explanation(
    total: Column, p: Column, lov: Column, valid: Column, checked: Column, rules: Column, label: Column
) -> Column:
    return F.format_string(
        "Confidence %.3f mathematically derived from: Provenance=%.3f (weight 40%%), "
        "LOV Match=%.3f (%d/%d attributes valid, weight 35%%), "
        "Rule Compliance=%.3f (weight 25%%). Tier: %s.",
        total, p, lov, valid, F.greatest(checked, F.lit(1)), rules, label,
    )


REWARDS = ["invoice_length", "invoice_case", "uom_spacing", "fraction_format", "no_placeholders"]


def rewards(invoice: Column, attribute_text: Column, full_text: Column) -> Column:
    """Five 0/1 compliance rewards of one predicted record."""
    inv = strip(F.coalesce(invoice, F.lit("")))
    checked = F.when(attribute_text != "", attribute_text).otherwise(full_text)

    def score(ok: Column) -> Column:
        return F.when(ok, F.lit(1.0)).otherwise(F.lit(0.0))

    tests = [
        (inv != "") & (F.length(inv) <= V.INVOICE_LIMIT),
        (inv == F.upper(inv)) & inv.rlike(r"\p{L}"),
        ~checked.rlike(REWARD_GLUED),
        ~full_text.rlike(REWARD_DECIMAL_INCH),
        ~full_text.rlike(REWARD_PLACEHOLDER),
    ]
    return F.struct(*[score(t).alias(f"{name}_reward") for name, t in zip(REWARDS, tests)])
