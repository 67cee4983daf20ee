"""Vocabulary and rule validation of extracted attributes, and checks of delivery records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partloom import vocab as V
from partloom.functions import scoring as S
from partloom.functions.text import (
    WS, blank_to_null, clean_placeholders, lookup, present, sanitize_field, strip,
)
from partloom.functions.units import GLUED_UNIT_ONLY, decimals_to_fractions, space_units
from partloom.operators.attributes import ATTRIBUTES, attribute_columns
from partloom.operators.common import any_of
from partloom.vocab import DEFAULT, Vocabulary

VIOLATION = "struct<field:string,raw_value:string,reason:string,action:string,suggestion:string>"
PLACEHOLDER_LEAK = (
    rf"(?i)--{WS}*(?:Unbranded|No{WS}+Unilog{WS}+Brand|No{WS}+DIB{WS}+Brand){WS}*--|\[placeholder\]"
)
LOV_FIELDS = ["item_type", "material", "mounting", "voltage"]
CONFLICT_FIELDS = ["dimensions", "material", "mounting", "voltage"]


def _violation(field: str, raw: Column, reason: Column, action: str, suggestion: Column) -> Column:
    return F.struct(
        F.lit(field).alias("field"),
        raw.cast("string").alias("raw_value"),
        reason.alias("reason"),
        F.lit(action).alias("action"),
        suggestion.cast("string").alias("suggestion"),
    )


def _keep(items: list[Column]) -> Column:
    return F.filter(F.array(*items), lambda v: v.isNotNull())




def required_violations(category: Column, attrs: dict[str, Column], vocab: Vocabulary = DEFAULT) -> Column:
    """One violation per required attribute the record leaves empty, by attribute name."""
    fields = sorted({f for names in vocab.category_required.values() for f in names})
    checks = []
    for name in fields:
        categories = [c for c, names in vocab.category_required.items() if name in names]
        # an attribute the record type does not have can never be filled
        empty = ~present(attrs[name]) if name in attrs else F.lit(True)
        reason = F.concat(
            F.lit(f"Required attribute '{name}' is missing for category '"), category, F.lit("'")
        )
        checks.append(
            F.when(
                category.isin(categories) & empty,
                _violation(name, F.lit(None), reason, "missing_required", F.lit(None)),
            )
        )
    return _keep(checks)


def _category_table(tables: dict[str, dict], field: str, expand) -> dict[str, str]:
    return {
        f"{category}|{key}": value
        for category, fields in tables.items()
        if field in fields
        for key, value in expand(fields[field])
    }


def add_lov_checks(
    df: DataFrame, category: str, values: dict[str, Column], vocab: Vocabulary = DEFAULT
) -> DataFrame:
    """Add ``lov_<field>`` = (value, action, raw) per field: canonical spelling, synonym, or rejection.

    ``action`` is null for a value in the vocabulary (and for categories without one).
    """
    applies, cleaned, keys, hits, outcomes = {}, {}, {}, {}, {}
    for field, value in values.items():
        allowed = _category_table(vocab.category_lovs, field, lambda vs: [(v.lower(), v) for v in vs])
        synonyms = _category_table(vocab.category_synonyms, field, lambda d: d.items())
        bound = [c for c, fields in vocab.category_lovs.items() if field in fields]
        applies[field] = F.coalesce(F.col(category).isin(bound) & (value != ""), F.lit(False))
        cleaned[f"_{field}_clean"] = F.when(applies[field], clean_placeholders(value))
        raw = F.col(f"_{field}_clean")
        keys[f"_{field}_key"] = F.concat(F.col(category), F.lit("|"), F.lower(raw))
        key = F.col(f"_{field}_key")
        hits[f"_{field}_hit"] = F.struct(
            lookup(allowed, key).alias("exact"), lookup(synonyms, key).alias("synonym")
        )
        outcomes[f"lov_{field}"] = _lov_outcome(field, value, applies[field], raw)
    df = df.withColumns(cleaned).withColumns(keys).withColumns(hits).withColumns(outcomes)
    return df.drop(*cleaned, *keys, *hits)


def _lov_outcome(field: str, value: Column, applies: Column, raw: Column) -> Column:
    exact, synonym = F.col(f"_{field}_hit.exact"), F.col(f"_{field}_hit.synonym")

    def outcome(v: Column, action: str | None) -> Column:
        return F.struct(
            v.alias("value"), F.lit(action).cast("string").alias("action"), raw.alias("raw")
        )

    return (
        F.when(~applies, outcome(value, None))
        .when(raw.isNull(), outcome(F.lit(None), None))
        .when(exact.isNotNull(), outcome(exact, None))
        .when(synonym.isNotNull(), outcome(synonym, "normalized"))
        .otherwise(outcome(value, "rejected"))
    )


def _lov_violation(field: str, category: Column) -> Column:
    hit = F.col(f"lov_{field}")
    normalized = F.concat(
        F.lit("Value '"), hit["raw"],
        F.lit("' normalized via deterministic synonym rule to '"), hit["value"], F.lit("'"),
    )
    rejected = F.concat(
        F.lit("Value '"), hit["raw"], F.lit("' is outside allowed vocabulary for "), category,
        F.lit(" and has no synonym mapping"),
    )
    return F.when(
        hit["action"] == "normalized",
        _violation(field, hit["raw"], normalized, "normalized", hit["value"]),
    ).when(
        hit["action"] == "rejected",
        _violation(field, hit["raw"], rejected, "rejected", F.lit(None)),
    )


def conflict_violations(attrs: dict[str, Column], snippets: Column) -> Column:
    """Evidence that says 120 against a value that says 240."""
    checks = []
    for name in CONFLICT_FIELDS:
        seen = F.try_element_at(snippets, F.lit(name))["value"]
        value = attrs[name]
        clash = (
            F.contains(seen, F.lit("120"))
            & F.contains(value, F.lit("240"))
            & ~F.contains(value, F.lit("120/240"))
        )
        reason = F.concat(
            F.lit("Extracted value '"), value,
            F.lit("' conflicts with official manufacturer datasheet evidence '"), seen, F.lit("'"),
        )
        checks.append(F.when(clash, _violation(name, value, reason, "evidence_conflict", seen)))
    return _keep(checks)


def validate_attributes(
    df: DataFrame, category: str = "category", vocab: Vocabulary = DEFAULT
) -> DataFrame:
    """Normalize ``attrs`` into ``final`` and add ``violations`` with the flags derived from them.

    Expects ``attrs`` and ``ev`` (null without evidence).
    """
    attrs = attribute_columns()
    df = add_lov_checks(df, category, {n: attrs[n] for n in LOV_FIELDS}, vocab)
    normalized = {n: F.col(f"lov_{n}.value") if n in LOV_FIELDS else attrs[n] for n in ATTRIBUTES}
    normalized["voltage"] = F.when(
        normalized["voltage"] != "", space_units(normalized["voltage"], vocab)
    ).otherwise(normalized["voltage"])
    normalized["dimensions"] = F.when(
        normalized["dimensions"] != "",
        decimals_to_fractions(space_units(normalized["dimensions"], vocab), vocab),
    ).otherwise(normalized["dimensions"])
    df = df.withColumn("final", F.struct(*[normalized[n].alias(n) for n in ATTRIBUTES]))
    df = df.withColumn(
        "violations",
        F.concat(
            required_violations(F.col(category), attrs, vocab),
            _keep([_lov_violation(n, F.col(category)) for n in LOV_FIELDS]),
            conflict_violations(attribute_columns("final"), F.col("ev.snippets")),
        ),
    ).drop(*[f"lov_{n}" for n in LOV_FIELDS])
    return add_validation_flags(df)


def add_validation_flags(df: DataFrame) -> DataFrame:
    actions = F.transform("violations", lambda v: v["action"])

    def reason(v: Column) -> Column:
        return (
            F.when(
                v["action"] == "missing_required",
                F.concat(F.lit("Missing required field: "), v["field"]),
            )
            .when(
                v["action"] == "rejected",
                F.concat(
                    F.lit("Invalid LOV for "), v["field"], F.lit(": '"), v["raw_value"], F.lit("'")
                ),
            )
            .when(
                v["action"] == "evidence_conflict",
                F.concat(
                    F.lit("Evidence conflict on "), v["field"], F.lit(": LLM="), v["raw_value"],
                    F.lit(" vs Sourced="), v["suggestion"],
                ),
            )
        )

    df = df.withColumns(
        {
            "passed_lov": ~F.array_contains(actions, "rejected"),
            "passed_rules": ~F.arrays_overlap(
                actions, F.array(F.lit("missing_required"), F.lit("evidence_conflict"))
            ),
            "review_reasons": F.filter(F.transform("violations", reason), lambda r: r.isNotNull()),
        }
    )
    valid = F.col("passed_lov") & F.col("passed_rules")
    return df.withColumns({"is_valid": valid, "validator_review": ~valid})


def add_confidence(
    df: DataFrame, invoice: Column, source_type: Column, vocab: Vocabulary = DEFAULT
) -> DataFrame:
    """Add the confidence breakdown of ``final`` as columns."""
    values = attribute_columns("final")
    texts = [values[n] for n in ATTRIBUTES]
    df = df.withColumns(
        {
            "provenance_score": S.provenance(source_type),
            "_lov": S.lov_counts(values, vocab),
            "has_glued_uom": S.has_glued_unit(*texts),
            "has_decimal_inch": S.has_decimal_inch(*texts),
        }
    )
    df = df.withColumns(
        {
            "lov_score": S.lov_score(F.col("_lov.checked"), F.col("_lov.valid")),
            "rule_score": S.rule_score(invoice, F.col("has_glued_uom"), F.col("has_decimal_inch")),
        }
    )
    df = df.withColumn(
        "confidence",
        S.confidence(F.col("provenance_score"), F.col("lov_score"), F.col("rule_score")),
    )
    return df.withColumns(
        {
            "review_tier": S.tier(F.col("confidence")),
            "lov_checked": F.col("_lov.checked"),
            "lov_valid": F.col("_lov.valid"),
            "field_confidences": S.field_confidences(
                values, F.col("provenance_score"), F.col("has_glued_uom"), F.col("has_decimal_inch"), vocab
            ),
        }
    ).drop("_lov")


def add_explanation(df: DataFrame) -> DataFrame:
    return df.withColumn(
        "explanation",
        S.explanation(
            F.col("confidence"), F.col("provenance_score"), F.col("lov_score"),
            F.col("lov_valid"), F.col("lov_checked"), F.col("rule_score"), F.col("review_tier"),
        ),
    )


# ------------------------------------------------------------------ raw rows


def sanitize_rows(df: DataFrame, columns: Sequence[str] = tuple(V.FEED_COLUMNS)) -> DataFrame:
    """Placeholder-only cells to null; ``row_valid`` and the first ``row_error``."""
    cleaned = df.select(
        *[c for c in df.columns if c not in columns], *[sanitize_field(F.col(c)).alias(c) for c in columns]
    )
    missing_part = F.coalesce(F.col("Mfg_Part_Num") == "", F.lit(True))
    missing_desc = F.coalesce(F.col("Part_Desc") == "", F.lit(True))
    return cleaned.withColumn(
        "row_error",
        F.when(missing_part, "Missing or invalid Mfg_Part_Num").when(
            missing_desc, "Missing or invalid Part_Desc"
        ),
    ).withColumn("row_valid", F.col("row_error").isNull())


# ------------------------------------------------------------------ delivery records


def structure_check(df: DataFrame, headers: str, expected: Sequence[str]) -> DataFrame:
    """Compare an array column of header names with the expected headers."""
    want = F.array(*[F.lit(h) for h in expected])
    found = F.col(headers)
    df = (
        df.withColumn("column_count", F.size(found))
        .withColumn("missing_headers", F.array_except(want, found))
        .withColumn("unexpected_headers", F.array_except(found, want))
    )
    complete = (
        (F.size(found) == len(expected))
        & (F.size("missing_headers") == 0)
        & (F.size("unexpected_headers") == 0)
    )
    swapped = F.filter(
        F.zip_with(
            F.zip_with(found, want, lambda f, w: F.struct(f.alias("f"), w.alias("w"))),
            F.sequence(F.lit(0), F.lit(len(expected) - 1)),
            lambda p, i: F.when(
                p["f"] != p["w"],
                F.concat(
                    F.lit("Position "), i.cast("string"), F.lit(": expected '"), p["w"],
                    F.lit("', found '"), p["f"], F.lit("'"),
                ),
            ),
        ),
        lambda m: m.isNotNull(),
    )
    return df.withColumn(
        "misordered_headers", F.when(complete, swapped).otherwise(F.array().cast("array<string>"))
    ).withColumn("structure_valid", complete & (F.size("misordered_headers") == 0))


def _issue(column: str | Column, kind: str, message: Column, value: Column) -> Column:
    name = F.lit(column) if isinstance(column, str) else column
    return F.struct(
        name.alias("column_name"), F.lit(kind).alias("issue_type"), message.alias("message"),
        value.alias("actual_value"),
    )


def record_issues(columns: Sequence[str]) -> Column:
    """All rule violations of one delivery record, none cut off."""
    have = set(columns)

    def cell(name: str) -> Column:
        return F.coalesce(F.col(f"`{name}`"), F.lit(""))

    checks = [
        F.when(
            strip(cell(n)) == "",
            _issue(n, "MISSING_REQUIRED", F.lit(f"Required column '{n}' is empty"), F.lit("")),
        )
        for n in V.REQUIRED_HEADERS
        if n in have
    ]
    if "INVOICE_DESC" in have:
        inv = cell("INVOICE_DESC")
        checks += [
            F.when(
                F.length(inv) > V.INVOICE_LIMIT,
                _issue(
                    "INVOICE_DESC", "LENGTH_EXCEEDED",
                    F.concat(
                        F.lit("INVOICE_DESC exceeds 40 characters (length: "),
                        F.length(inv).cast("string"), F.lit(")"),
                    ),
                    inv,
                ),
            ),
            F.when(
                inv != F.upper(inv),
                _issue(
                    "INVOICE_DESC", "INVALID_CASING",
                    F.lit("INVOICE_DESC must be strictly UPPERCASE"), inv,
                ),
            ),
        ]
    checked = [c for c in columns if c in V.DELIVERY_HEADERS and c not in V.LEAK_EXEMPT_HEADERS]
    # one test over the joined record decides whether the cells are looked at one by one
    cells = F.array(*[F.struct(F.lit(c).alias("n"), cell(c).alias("v")) for c in checked])
    any_leak = F.concat_ws("\n", *[F.col(f"`{c}`") for c in checked]).rlike(PLACEHOLDER_LEAK)
    leaks = F.when(
        any_leak,
        F.transform(
            F.filter(cells, lambda c: c["v"].rlike(PLACEHOLDER_LEAK)),
            lambda c: _issue(
                c["n"], "PLACEHOLDER_LEAK",
                F.concat(F.lit("Uncleaned placeholder token detected in column '"), c["n"], F.lit("'")),
                c["v"],
            ),
        ),
    )
    glued = []
    for i in range(1, 16):
        name = f"ATTRIBUTE_VALUE {i}"
        if name in have:
            value = strip(cell(name))
            glued.append(
                F.when(
                    value.rlike(GLUED_UNIT_ONLY),
                    _issue(
                        name, "INVALID_UOM",
                        F.concat(F.lit(f"Glued UOM detected in {name}: '"), value, F.lit("'")), value,
                    ),
                )
            )
    empty = F.array().cast(
        "array<struct<column_name:string,issue_type:string,message:string,actual_value:string>>"
    )
    return F.concat(_keep(checks), F.coalesce(leaks, empty), _keep(glued) if glued else empty)


def add_record_issues(df: DataFrame) -> DataFrame:
    return df.withColumn("issues", record_issues(df.columns))


def summarize_issues(df: DataFrame) -> DataFrame:
    """``issues`` to the per-row validation result."""
    return (
        df.withColumn("issue_count", F.size("issues"))
        .withColumn("is_schema_valid", F.col("issue_count") == 0)
        .withColumn(
            "issue_types",
            F.array_join(
                F.array_sort(F.array_distinct(F.transform("issues", lambda i: i["issue_type"]))), "; "
            ),
        )
        .withColumn(
            "issue_messages",
            F.array_join(
                F.transform(
                    "issues",
                    lambda i: F.concat(F.lit("["), i["column_name"], F.lit("] "), i["message"]),
                ),
                " | ",
            ),
        )
        .drop("issues")
    )


def split_valid(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, quarantined) delivery records: an export never mixes the two."""
    flagged = add_record_issues(df)
    good = F.size("issues") == 0
    return flagged.where(good).drop("issues"), flagged.where(~good)


# ------------------------------------------------------------------ leakage


def supplier_leakage(df: DataFrame, brand: str, manufacturer: str, vocab: Vocabulary = DEFAULT) -> DataFrame:
    """Count records whose resolved brand or manufacturer still names a distributor."""
    from partloom.operators.entity import is_distributor

    b, m = is_distributor(F.col(brand), vocab), is_distributor(F.col(manufacturer), vocab)
    return df.agg(
        F.count("*").alias("records"),
        F.count_if(b).alias("brand_leaks"),
        F.count_if(m).alias("manufacturer_leaks"),
        F.count_if(any_of([b, m])).alias("leaking_records"),
    )


