"""Comparison with golden records and the quality metrics derived from it."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from partloom import vocab as V
from partloom.functions.text import let, strip
from partloom.operators.common import first_by, growing, long_form, same_key, share

EXACT, NORMALIZED, MISMATCH, EMPTY = "EXACT_MATCH", "NORMALIZED_MATCH", "MISMATCH", "EXPECTED_EMPTY"
CASE_RULE, NUMBER_RULE = "case_insensitive_trademark_stripped", "numeric_representation_equivalence"
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def is_empty(c: Column) -> Column:
    return c.isNull() | F.lower(strip(c)).isin(V.EMPTY_WORDS)


def normalized(c: Column) -> Column:
    return F.translate(F.lower(strip(c)), "®™", "")


def trimmed(c: Column) -> Column:
    """``strip`` for cells: one that begins and ends with a visible ASCII character is taken as it is, without a regular expression."""
    visible = lambda x: (x >= "!") & (x <= "~")
    return F.when((c == "") | (visible(F.substring(c, 1, 1)) & visible(F.substring(c, -1, 1))), c).otherwise(strip(c))


def loose(c: Column) -> Column:
    """Comparison form without marks and case; empty for null words."""

    def form(s: Column) -> Column:
        bare = F.when(F.contains(s, F.lit("®")) | F.contains(s, F.lit("™")), strip(F.translate(s, "®™", ""))).otherwise(s)
        return F.when(s.isNull() | F.lower(s).isin(V.EMPTY_WORDS), F.lit("")).otherwise(F.lower(bare))

    return let(trimmed(c), form)


def dashless(c: Column) -> Column:
    return F.translate(loose(c), "-", " ")


def loosely_equal(a: Column, b: Column) -> Column:
    """Equal without marks and case, a dash counting as a blank."""
    return F.coalesce(a == b, F.lit(False)) | (dashless(a) == dashless(b))


def numeric_field(name: str) -> bool:
    return not (
        name in V.NON_NUMERIC_FIELDS
        or name.startswith("ATTRIBUTE_LABEL")
        or name.startswith("ITEM_FEATURES")
    )


def numeric_equivalent(a: Column, b: Column) -> Column:
    both = a.rlike(NUMBER) & b.rlike(NUMBER)
    return both & (a.try_cast("double") == b.try_cast("double"))


def bare_cell(c: Column) -> Column:
    return F.when(is_empty(c), F.lit("")).otherwise(strip(c))


def compare_cell(expected: Column, actual: Column, numeric: Column) -> Column:
    """(expected, actual, comparison_type, normalization_rule) of one pair of cells."""
    return compare_bare(bare_cell(expected), bare_cell(actual), numeric)


def compare_bare(e: Column, a: Column, numeric: Column) -> Column:
    """``compare_cell`` of cells that went through ``bare_cell``."""
    same_text = normalized(e) == normalized(a)
    same_number = numeric & F.coalesce(numeric_equivalent(e, a), F.lit(False))
    kind = (
        F.when(e == "", EMPTY)
        .when(e == a, EXACT)
        .when(same_text | same_number, NORMALIZED)
        .otherwise(MISMATCH)
    )
    rule = (
        F.when((e == "") | (e == a), F.lit(""))
        .when(same_text, CASE_RULE)
        .when(same_number, NUMBER_RULE)
        .otherwise(F.lit(""))
    )
    return F.struct(
        e.alias("expected_value"), a.alias("actual_value"), kind.alias("comparison_type"),
        rule.alias("normalization_rule"),
    )


def comparison_cells(df: DataFrame, keys: Sequence[str], cells: Mapping[str, Column] | None = None) -> DataFrame:
    """``keys`` and the compared fields as one array, in field order."""
    get = (lambda n: cells[n]) if cells else (lambda n: F.col(f"`{n}`"))
    return df.select(*keys, F.array(*[get(n) for n in V.COMPARISON_FIELDS]).alias("cells"))


def match_key(c: Column) -> Column:
    return F.upper(strip(F.coalesce(c, F.lit(""))))


def compare_records(
    golden: DataFrame, output: DataFrame, key: str, ordinal: str
) -> DataFrame:
    """One row per matched part with the array of field comparisons.

    Both sides are (key, ordinal, cells).  The output is cut down to golden keys before its wide
    rows are shuffled, and both sides to their first row per key, so nothing multiplies.
    """
    keyed = lambda df: df.withColumn("mfg_part_num", match_key(F.col(key))).where(
        F.col("mfg_part_num") != ""
    ).select("mfg_part_num", ordinal, "cells")
    expected = first_by(keyed(golden), ["mfg_part_num"], [F.col(ordinal)])
    wanted = expected.select(F.col("mfg_part_num").alias("_gk"))
    candidates = keyed(output).join(growing(wanted), same_key("mfg_part_num", "_gk"), "left_semi")
    actual = first_by(candidates, ["mfg_part_num"], [F.col(ordinal)]).select(
        F.col("mfg_part_num").alias("_ak"), F.col("cells").alias("actual")
    )
    joined = expected.join(growing(actual), same_key("mfg_part_num", "_ak"))
    numeric = F.array(*[F.lit(numeric_field(n)) for n in V.COMPARISON_FIELDS])
    pairs = F.zip_with(
        # a function of an array element is evaluated wherever it is named, so cells are cleaned once, before they are compared
        F.zip_with("cells", "actual", lambda e, a: F.struct(bare_cell(e).alias("e"), bare_cell(a).alias("a"))),
        numeric,
        lambda p, n: compare_bare(p["e"], p["a"], n),
    )
    return joined.select("mfg_part_num", pairs.alias("comparisons"))


def field_comparisons(compared: DataFrame) -> DataFrame:
    """One row per part and compared field."""
    names = F.array(*[F.lit(n) for n in V.COMPARISON_FIELDS])
    return compared.select(
        "mfg_part_num", F.posexplode("comparisons").alias("_i", "_c")
    ).select("mfg_part_num", F.get(names, F.col("_i")).alias("field_name"), "_c.*")


def record_counts(compared: DataFrame) -> DataFrame:
    """Counts per record, taken inside the row."""
    n = lambda kind: F.size(F.filter("comparisons", lambda c: c["comparison_type"] == kind))
    df = compared.select(
        "mfg_part_num",
        F.size("comparisons").alias("total_compared_fields"),
        n(EXACT).alias("exact_matches"),
        n(NORMALIZED).alias("normalized_matches"),
        n(MISMATCH).alias("mismatches"),
        n(EMPTY).alias("expected_empty"),
        F.size(F.filter("comparisons", lambda c: c["actual_value"] != "")).alias("actual_filled"),
    )
    comparable = F.col("exact_matches") + F.col("normalized_matches") + F.col("mismatches")
    return (
        df.withColumn("exact_record_match", (F.col("normalized_matches") == 0) & (F.col("mismatches") == 0))
        .withColumn("normalized_record_match", F.col("mismatches") == 0)
        .withColumn("strict_accuracy_pct", share(F.col("exact_matches"), comparable))
        .withColumn(
            "normalized_accuracy_pct", share(F.col("exact_matches") + F.col("normalized_matches"), comparable)
        )
    )


def field_accuracy(fields: DataFrame) -> DataFrame:
    """Accuracy per field, fields without a comparable value left out."""
    n = lambda kind: F.count_if(F.col("comparison_type") == kind)
    comparable = F.col("exact_matches") + F.col("normalized_matches") + F.col("mismatches")
    return (
        fields.groupBy("field_name")
        .agg(
            n(EXACT).alias("exact_matches"), n(NORMALIZED).alias("normalized_matches"),
            n(MISMATCH).alias("mismatches"), n(EMPTY).alias("expected_empty"),
        )
        .withColumn("comparable_values", comparable)
        .where(F.col("comparable_values") > 0)
        .withColumn("strict_accuracy_pct", share(F.col("exact_matches"), F.col("comparable_values")))
        .withColumn(
            "normalized_accuracy_pct",
            share(F.col("exact_matches") + F.col("normalized_matches"), F.col("comparable_values")),
        )
    )


def record_accuracy(records: DataFrame) -> DataFrame:
    """Totals over records, one row."""
    total = F.count("*")
    exact, norm, miss = (F.sum(c) for c in ("exact_matches", "normalized_matches", "mismatches"))
    exact_rec, norm_rec = F.count_if("exact_record_match"), F.count_if("normalized_record_match")
    return records.agg(
        total.alias("golden_records_evaluated"),
        F.sum("total_compared_fields").alias("total_fields_compared"),
        exact.alias("exact_matches"), norm.alias("normalized_matches"), miss.alias("mismatches"),
        F.sum("expected_empty").alias("expected_empty"),
        share(exact, exact + norm + miss).alias("strict_field_accuracy_pct"),
        share(exact + norm, exact + norm + miss).alias("normalized_field_accuracy_pct"),
        exact_rec.alias("exact_record_matches"), norm_rec.alias("normalized_record_matches"),
        share(exact_rec, total).alias("exact_record_match_rate_pct"),
        share(norm_rec, total).alias("normalized_record_match_rate_pct"),
        F.count_if(~F.col("exact_record_match") & (F.col("normalized_accuracy_pct") > 0)).alias("partial_matches"),
        F.count_if(F.col("normalized_accuracy_pct") == 0).alias("complete_mismatches"),
    )


def worst_fields(accuracy: DataFrame, limit: int) -> DataFrame:
    """The least accurate fields that are not perfect."""
    scored = accuracy.select(
        F.col("field_name").alias("field"),
        F.round(
            (F.col("exact_matches") + F.col("normalized_matches")) / F.col("comparable_values"), 4
        ).alias("accuracy"),
        F.col("comparable_values").alias("total"),
    )
    return scored.orderBy("accuracy", "field").limit(limit).where(F.col("accuracy") < 1.0)


def attribute_prf(records: DataFrame) -> DataFrame:
    """Precision, recall and F1 per record."""
    correct = F.col("exact_matches") + F.col("normalized_matches")
    expected = correct + F.col("mismatches")
    df = records.select(
        "mfg_part_num",
        expected.alias("expected_attributes"),
        F.col("actual_filled").alias("actual_attributes"),
        correct.alias("correct_attributes"),
        F.greatest(expected - correct, F.lit(0)).alias("missing_attributes"),
        F.greatest(F.col("actual_filled") - expected, F.lit(0)).alias("extra_attributes"),
        F.col("mismatches").alias("incorrect_attributes"),
        share(correct, F.col("actual_filled")).alias("precision_pct"),
        share(correct, expected).alias("recall_completeness_pct"),
    )
    p, r = F.col("precision_pct"), F.col("recall_completeness_pct")
    return df.withColumn("f1_score_pct", F.round(2 * p * r / F.greatest(p + r, F.lit(1e-6)), 2))


# ------------------------------------------------------------------ keys


def distinct_keys(df: DataFrame, key: str) -> DataFrame:
    return df.select(match_key(F.col(f"`{key}`")).alias("match_key")).where(F.col("match_key") != "").distinct()


def match_keys(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Every key once with matched, input_only or golden_only."""
    a = distinct_keys(left, left_key).withColumn("_a", F.lit(True))
    b = distinct_keys(right, right_key).withColumn("_b", F.lit(True))
    status = (
        F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), "matched")
        .when(F.col("_a").isNotNull(), "input_only")
        .otherwise("golden_only")
    )
    return a.join(b, "match_key", "full_outer").select("match_key", status.alias("status"))


def lookup_record(golden: DataFrame, keys: DataFrame, key: str, ordinal: str) -> DataFrame:
    """First golden record of each requested key."""
    keyed = golden.withColumn("match_key", match_key(F.col(f"`{key}`")))
    return first_by(keyed.join(growing(keys), "match_key", "left_semi"), ["match_key"], [F.col(ordinal)])


def with_truth(rows: DataFrame, golden: DataFrame, key: str) -> DataFrame:
    keyed = rows.withColumn("match_key", match_key(F.col(key)))
    return keyed.join(growing(distinct_keys(golden, key)), "match_key", "left_semi")


def without_truth(rows: DataFrame, golden: DataFrame, key: str) -> DataFrame:
    keyed = rows.withColumn("match_key", match_key(F.col(key)))
    return keyed.join(growing(distinct_keys(golden, key)), "match_key", "left_anti")


def filled_slots(slots: str | Column) -> Column:
    """(label, value) of the slots that have both."""
    return F.transform(
        F.filter(slots, lambda s: (s["label"] != "") & (s["value"] != "")), lambda s: F.struct(s["label"].alias("label"), s["value"].alias("value"))
    )


def offered_slots(slots: str | Column) -> Column:
    """(form, value) of the first slot of each label, the labels in their comparison form."""

    def firsts(forms: Column) -> Column:
        pairs = F.zip_with(forms, slots, lambda form, s: F.struct(form.alias("form"), s["value"].alias("value")))
        return F.filter(pairs, lambda p, i: F.array_position(forms, p["form"]) == i + 1)

    return let(F.transform(slots, lambda s: dashless(s["label"])), firsts)


def match_offered(filled: Column, offered: Column) -> Column:
    """``match_labels`` of ``filled_slots`` and ``offered_slots``, which are a fraction of the 50 slots of a record."""

    def paired(found: Column, s: Column) -> Column:
        at = F.array_position(found["form"], dashless(s["label"]))  # 0 without one
        value = F.coalesce(F.get(found["value"], (at - 1).cast("int")), F.lit(""))
        return F.struct(s["label"].alias("label"), s["value"].alias("expected"), value.alias("predicted"))

    def judged(s: Column) -> Column:
        matched = (s["predicted"] != "") & loosely_equal(s["expected"], s["predicted"])
        return F.struct(s["label"].alias("label"), s["expected"].alias("expected"), s["predicted"].alias("predicted"), matched.alias("matched"))

    return let(offered, lambda found: F.transform(F.transform(filled, lambda s: paired(found, s)), judged))


def match_labels(df: DataFrame, expected: str, predicted: str) -> Column:
    """For each expected (label, value) slot: the first predicted slot of that label, and equality.

    Both are slot arrays of one record (50 entries at most), so the match stays inside the row.  The predicted labels are brought to
    their comparison form once for the record, not once for each expected slot.
    """
    return match_offered(filled_slots(expected), offered_slots(predicted))


# ------------------------------------------------------------------ profiles, errors, scorecards


def density(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Populated cells per record."""
    filled = F.size(F.filter(F.array(*[F.col(f"`{c}`") for c in columns]), lambda v: strip(v) != ""))
    return df.select(
        F.col(f"`{key}`").alias("mfg_part_num"), filled.alias("populated_fields"),
        F.lit(len(columns)).alias("total_fields"),
        F.round(filled / F.lit(len(columns)) * 100, 2).alias("density_pct"),
    )


def coverage(statuses: DataFrame) -> DataFrame:
    n = lambda s: F.count_if(F.col("status") == s)
    inputs = n("matched") + n("input_only")
    return statuses.agg(
        n("matched").alias("matched"), n("input_only").alias("records_without_ground_truth"),
        n("golden_only").alias("golden_only"), share(n("matched"), inputs).alias("coverage_pct"),
    )


def error_category(field: Column) -> Column:
    name = F.upper(field)
    return (
        F.when(name.rlike("BRAND|MANUF"), "BRAND")
        .when(name.rlike("DESC|MARKETING"), "DESCRIPTION")
        .when(name.rlike("UOM"), "UOM")
        .when(name.rlike("URL|IMAGE|SPEC"), "SOURCE")
        .when(name.rlike("CLASSPATH|DEPT|CLASS"), "TAXONOMY")
        .otherwise("ATTRIBUTE")
    )


ERROR_COLUMNS = ["mfg_part_num", "error_category", "field", "expected", "actual", "message"]


def _errors(df: DataFrame, part: Column, category: Column, field: Column, expected, actual, message) -> DataFrame:
    values = [part, category, field, expected, actual, message]
    return df.select(*[v.alias(n) for n, v in zip(ERROR_COLUMNS, values)])


def error_taxonomy(
    schema_results: DataFrame | None, tracking: DataFrame, fields: DataFrame | None
) -> DataFrame:
    """Schema, sourcing, model and comparison errors under one set of categories."""
    parts = []
    if schema_results is not None:
        bad = schema_results.where(~F.col("is_schema_valid"))
        parts.append(
            _errors(
                bad, F.col("mfg_part_num"), F.lit("SCHEMA"), F.lit("252_COLUMN_SCHEMA"),
                F.lit("Valid 252-column schema"), F.col("issue_messages"),
                F.concat(F.lit("Schema failure in row "), F.col("row_number").cast("string"), F.lit(": "), F.col("issue_types")),
            )
        )
    reason = F.col("sourcing_failure_reason")
    parts.append(
        _errors(
            tracking.where(reason != ""), F.col("mfg_part_num"), F.lit("SOURCE"), F.lit("MANUFACTURER_SOURCING"),
            F.lit("Official source specs"), reason, F.concat(F.lit("Source failure: "), reason),
        )
    )
    parts.append(
        _errors(
            tracking.where("llm_failed"), F.col("mfg_part_num"), F.lit("LLM"), F.lit("NEMOTRON_EXTRACTION"),
            F.lit("Successful structured extraction"), F.coalesce("llm_error", F.lit("Extraction failed")),
            F.lit("NIM rate limit or extraction failure"),
        )
    )
    if fields is not None:
        parts.append(
            _errors(
                fields.where(F.col("comparison_type") == MISMATCH), F.col("mfg_part_num"),
                error_category(F.col("field_name")), F.col("field_name"), F.col("expected_value"),
                F.col("actual_value"), F.concat(F.lit("Ground truth mismatch on "), F.col("field_name")),
            )
        )
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def category_shares(errors: DataFrame) -> DataFrame:
    """Every category with its share of all errors; the total comes from the counted categories."""
    counts = errors.groupBy("error_category").agg(F.count("*").alias("errors"))
    # one row for each category that the rules name
    total = F.sum("errors").over(Window.partitionBy(F.lit(1)))
    return counts.select("error_category", "errors", F.round(F.col("errors") / total * 100, 1).alias("share_pct"))


NOISE_IN_INVOICE = r"-- unbranded --|-- no unilog brand --|n/a|tbd"
GLUED_SAMPLES = r"120v|24in|15a"
RAW_FRACTIONS = r"\.25 in|\.5 in|\.75 in|\.125 in"


def compliance_flags(df: DataFrame, texts: Sequence[Column], dimensions: Column) -> DataFrame:
    """Add invoice, unit and fraction compliance of enriched rows."""
    inv = strip(F.col("invoice_desc"))
    return (
        df.withColumn(
            "invoice_ok",
            (F.length(inv) <= V.INVOICE_LIMIT) & (inv == F.upper(inv)) & ~F.lower(inv).rlike(NOISE_IN_INVOICE),
        )
        .withColumn("uom_ok", ~F.lower(F.concat_ws("|", *texts)).rlike(GLUED_SAMPLES))
        .withColumn("fraction_ok", ~F.coalesce(dimensions.rlike(RAW_FRACTIONS), F.lit(False)))
    )


def scorecard(df: DataFrame) -> DataFrame:
    """Accuracy and compliance rates over flagged rows, one row.

    Expects per row: ``has_truth``, ``brand_ok``, ``mpn_ok``, ``category_ok`` (null without truth),
    ``field_matches``, ``field_total``, ``attribute_matches``, ``attribute_total``, the three
    compliance flags, ``schema_ok`` and ``confidence``.  Rates without a basis are null.
    """
    total, truth = F.count("*"), F.count_if("has_truth")
    core = F.col("brand_ok") & F.col("mpn_ok") & F.col("category_ok") & F.col("invoice_ok") & F.col("uom_ok")
    alone = F.col("invoice_ok") & F.col("uom_ok") & (F.col("confidence") >= 0.90)
    exact_truth = F.count_if(F.col("has_truth") & core)
    exact_rules = F.count_if(~F.col("has_truth") & alone)
    rate = lambda a, b: F.when(b > 0, F.round(a / b, 4))
    return df.agg(
        total.alias("total_rows"), truth.alias("ground_truth_records"),
        exact_truth.alias("exact_with_truth"), exact_rules.alias("exact_by_rules"),
        rate(exact_truth + exact_rules, total).alias("exact_match_rate"),
        rate(F.sum("field_matches"), F.sum("field_total")).alias("field_accuracy"),
        rate(F.count_if("category_ok"), truth).alias("category_accuracy"),
        rate(F.count_if("brand_ok"), truth).alias("brand_accuracy"),
        rate(F.count_if("mpn_ok"), truth).alias("mpn_accuracy"),
        rate(F.sum("attribute_matches"), F.sum("attribute_total")).alias("attribute_accuracy"),
        rate(F.count_if("schema_ok"), total).alias("schema_compliance"),
        rate(F.count_if("uom_ok"), total).alias("uom_compliance"),
        rate(F.count_if("fraction_ok"), total).alias("fraction_compliance"),
        rate(F.count_if("invoice_ok"), total).alias("invoice_compliance"),
        F.count_if(F.col("confidence") >= 0.90).alias("high_confidence"),
        F.count_if((F.col("confidence") >= 0.75) & (F.col("confidence") < 0.90)).alias("moderate_confidence"),
        F.count_if(F.col("confidence") < 0.75).alias("low_confidence"),
        F.round(F.avg("confidence"), 3).alias("average_confidence"),
    )


def readiness(metrics: DataFrame) -> DataFrame:
    """Measured criteria of one metrics row and the verdict they add up to.

    Expects ``processing_success_rate``, ``schema_pass_rate``, ``live_model_count``,
    ``strict_field_accuracy``, ``normalized_field_accuracy``, ``exact_record_rate``,
    ``normalized_record_rate`` (percentages).
    """
    c = F.col
    graded = lambda ok, partly: F.when(ok, "PASS").when(partly, "CONDITIONALLY_PASS").otherwise("FAIL")
    inputs, schema = c("processing_success_rate") >= 99, c("schema_pass_rate") >= 99
    live = c("live_model_count") > 0
    field_ok = c("strict_field_accuracy") >= 85
    field_partly = (c("strict_field_accuracy") >= 50) | (c("normalized_field_accuracy") >= 50)
    record_ok = (c("exact_record_rate") >= 50) | (c("normalized_record_rate") >= 50)
    record_partly = (c("exact_record_rate") > 0) | (c("normalized_record_rate") > 0)
    overall = (
        F.when(inputs & schema & field_ok & record_ok & live, "PRODUCTION_READY")
        .when(inputs & schema & field_partly, "CONDITIONALLY_READY")
        .otherwise("NOT_READY")
    )
    rows = {
        "INPUT_PROCESSING": graded(inputs, F.lit(False)),
        "SCHEMA_COMPLIANCE": graded(schema, F.lit(False)),
        "NEMOTRON_LLM": F.when(live, "PASS").otherwise("CONDITIONALLY_PASS"),
        "GROUND_TRUTH_FIELD_ACCURACY": graded(field_ok, field_partly),
        "GROUND_TRUTH_RECORD_ACCURACY": graded(record_ok, record_partly),
        "OVERALL": overall,
    }
    wide = metrics.select(*[v.alias(n) for n, v in rows.items()])
    return long_form(wide, [], list(rows), "criterion", "status")


def run_over_run(history: DataFrame, metric: str, value: str, run: str) -> DataFrame:
    """Each metric of each run against the run before it.

    The history has one row per run and metric, so a metric's window is as long as the run list.
    """
    w = Window.partitionBy(metric).orderBy(run)
    before = F.lag(value).over(w)
    delta = F.round(F.col(value) - before, 4)
    return history.withColumn("previous", before).withColumn("difference", delta).withColumn(
        "trend",
        F.when(before.isNull(), "first").when(delta > 0, "up").when(delta < 0, "down").otherwise("same"),
    )
