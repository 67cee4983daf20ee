"""Batch, confidence, source and latency metrics over processing records."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from partloom.operators.common import share

# percentile_approx guarantees rank error below n/ACCURACY; brackets are widened by that much
ACCURACY = 100_000
_SLACK = 2.0 / ACCURACY


def index_percentiles(
    df: DataFrame, keys: Sequence[str], value: str, fractions: Mapping[str, float], stats: Sequence[Column] = ()
) -> DataFrame:
    """Exact order statistics ``sorted[min(int(n * p), n - 1)]`` per key, without sorting a key.

    Pass one sketches a narrow bracket around each rank (a mergeable summary per key).  Pass two
    keeps the exact values inside the brackets and only counts outside of them, with a partial
    aggregate before the shuffle.  What is finally ordered per key is the bracket content, about
    ``n / 10000`` distinct values, so a key holding most of the rows is no longer special.
    """
    names = list(fractions)
    rows = df.where(F.col(value).isNotNull())
    asked = [max(fractions[n] - _SLACK, 0.0) for n in names] + [min(fractions[n] + _SLACK, 1.0) for n in names]
    keyed = list(keys) or [F.lit(1).alias("_all")]
    key_names = list(keys) or ["_all"]
    brackets = rows.groupBy(*keyed).agg(
        F.percentile_approx(value, F.array(*[F.lit(a) for a in asked]), ACCURACY).alias("_q"),
        F.count("*").alias("_n"),
        *stats,
    )
    stat_names = [c for c in brackets.columns if c not in (*key_names, "_q", "_n")]
    side = brackets.select(*[F.col(k).alias(f"_k_{k}") for k in key_names], "_q", "_n")
    if keys:
        on = None
        for k in key_names:
            test = F.col(k).eqNullSafe(F.col(f"_k_{k}"))
            on = test if on is None else on & test
        tagged = rows.join(side, on)
    else:
        tagged = rows.join(side).withColumn("_all", F.lit(1))
    low = [F.get("_q", F.lit(i)) for i in range(len(names))]
    high = [F.get("_q", F.lit(i + len(names))) for i in range(len(names))]
    inside, zone = F.lit(False), F.lit(0)
    for lo, hi in zip(low, high):
        inside = inside | ((F.col(value) >= lo) & (F.col(value) <= hi))
        zone = zone + (F.col(value) > hi).cast("int")
    counted = (
        tagged.groupBy(
            *key_names, zone.alias("_zone"), F.when(inside, F.col(value)).alias("_probe")
        )
        .agg(F.count("*").alias("_c"), F.max(value).alias("_v"), F.max("_n").alias("_n"))
    )
    upto = Window.partitionBy(*key_names).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counted.withColumn("_upto", F.sum("_c").over(upto))
    picks = []
    for n in names:
        rank = F.least(F.floor(F.col("_n") * F.lit(fractions[n])), F.col("_n") - 1) + 1
        hit = (F.col("_upto") >= rank) & (F.col("_upto") - F.col("_c") < rank)
        picks.append(F.max(F.when(hit, F.col("_v"))).alias(n))
    result = ranked.groupBy(*key_names).agg(*picks)
    if stat_names:
        facts = brackets.select(*[F.col(k).alias(f"_k_{k}") for k in key_names], *stat_names)
        on = None
        for k in key_names:
            test = F.col(k).eqNullSafe(F.col(f"_k_{k}"))
            on = test if on is None else on & test
        result = result.join(facts, on).drop(*[f"_k_{k}" for k in key_names])
    return result if keys else result.drop("_all")


LATENCY_FRACTIONS = {"p50_ms": 0.50, "p95_ms": 0.95, "p99_ms": 0.99}


def latency_stats(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    stats = [
        F.count("*").alias("count"), F.round(F.avg(value), 2).alias("avg_ms"),
        F.min(value).alias("min_ms"), F.max(value).alias("max_ms"),
    ]
    return index_percentiles(df.where(F.col(value) != 0), keys, value, LATENCY_FRACTIONS, stats)


def batch_summary(df: DataFrame, batch: str) -> DataFrame:
    """Both readings of "high confidence", kept apart by name."""
    return df.groupBy(batch).agg(
        F.count("*").alias("total_items"),
        F.count_if(~F.col("needs_review")).alias("approved_count"),
        F.count_if("needs_review").alias("review_needed_count"),
        F.count_if(F.col("confidence") >= 0.90).alias("confidence_ge_90_count"),
        F.count_if(F.col("confidence") < 0.90).alias("confidence_lt_90_count"),
        F.round(F.avg("confidence"), 3).alias("average_confidence"),
    )


def confidence_metrics(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Distribution of confidence with index median, bands and approval rates.

    Expects ``confidence`` and ``review_required``.
    """
    n = F.count("*")
    ge90 = F.count_if(F.col("confidence") >= 0.90)
    mid = F.count_if((F.col("confidence") >= 0.75) & (F.col("confidence") < 0.90))
    low = F.count_if(F.col("confidence") < 0.75)
    auto = F.count_if(~F.col("review_required") & (F.col("confidence") >= 0.90))
    stats = [
        n.alias("records"), F.round(F.avg("confidence"), 4).alias("average_confidence"),
        F.min("confidence").alias("minimum_confidence"), F.max("confidence").alias("maximum_confidence"),
        ge90.alias("ge_90_count"), share(ge90, n).alias("ge_90_pct"),
        mid.alias("between_75_89_count"), share(mid, n).alias("between_75_89_pct"),
        low.alias("lt_75_count"), share(low, n).alias("lt_75_pct"),
        auto.alias("auto_approved_count"), share(auto, n).alias("auto_approval_rate_pct"),
        (n - auto).alias("review_required_count"), share(n - auto, n).alias("hitl_rate_pct"),
    ]
    return index_percentiles(df, keys, "confidence", {"median_confidence": 0.5}, stats)


def source_mode_metrics(df: DataFrame) -> DataFrame:
    """Mutually exclusive source modes and the rates built on them."""
    mode = F.upper("source_mode")
    is_mode = lambda *m: F.count_if(mode.isin(list(m)))
    total, asked = F.count("*"), F.count_if("llm_attempted")
    live = is_mode("LIVE_NIM", "MANUFACTURER_SOURCE")
    fallback = is_mode("OFFLINE_HEURISTIC", "FALLBACK")
    return df.agg(
        total.alias("total_records"), asked.alias("llm_requests"),
        live.alias("successful_llm_requests"),
        F.count_if(F.col("status") == "ERROR").alias("failed_llm_requests"),
        F.count_if("llm_timeout").alias("timeouts"), F.sum("retry_count").alias("retry_count"),
        is_mode("LIVE_NIM").alias("live_nim"), fallback.alias("offline_heuristic"),
        is_mode("MANUFACTURER_SOURCE").alias("manufacturer_source"), is_mode("CACHE").alias("cache"),
        F.count_if((F.col("status") == "ERROR") | (mode == "ERROR")).alias("error"),
        share(live, total).alias("live_nim_rate"), share(fallback, total).alias("fallback_rate"),
        share(live, asked).alias("llm_success_rate"),
    )


def run_metrics(df: DataFrame) -> DataFrame:
    """Status, validity, mode and review counts of a run."""
    mode = F.lower("source_mode")
    n = F.count("*")
    nim, fallback, cache = (
        F.count_if(mode.isin("nim", "nvidia")), F.count_if(mode == "fallback"), F.count_if(mode == "cache")
    )
    return df.agg(
        n.alias("total_input_records"), F.count_if(F.col("status") == "SUCCESS").alias("total_processed"),
        F.count_if(F.col("status") != "SUCCESS").alias("total_failed"),
        F.count_if("schema_valid").alias("total_schema_valid"),
        F.count_if(~F.col("schema_valid")).alias("total_schema_invalid"),
        nim.alias("nim_count"), fallback.alias("fallback_count"), cache.alias("cache_hit_count"),
        (n - nim - fallback - cache).alias("heuristic_count"),
        F.count_if("review_required").alias("hitl_required_count"),
        F.round(F.count_if("review_required") / F.greatest(n, F.lit(1)), 6).alias("hitl_rate"),
    )


# FIXED VALUES: failure reasons with a counter of their own.
FAILURE_REASONS = [
    "DOMAIN_NOT_ALLOWED", "NOT_FOUND", "TIMEOUT", "HTTP_ERROR", "PARSE_ERROR", "NO_EVIDENCE", "NO_SOURCE",
]


def sourcing_metrics(df: DataFrame) -> DataFrame:
    """Attempts, success, cache, source types and failure reasons, one row."""
    domain = F.col("source_domain")
    attempted = F.coalesce("sourcing_attempted", F.lit(False)) | F.coalesce(domain != "", F.lit(False))
    attempts, ok, hits = F.count_if(attempted), F.count_if("sourcing_success"), F.count_if("cache_hit")
    kind = F.upper("source_type")
    html, pdf = F.contains(kind, F.lit("HTML")), F.contains(kind, F.lit("PDF"))
    reason = F.col("sourcing_failure_reason")
    other = F.coalesce((reason != "") & ~reason.isin(FAILURE_REASONS), F.lit(False))
    return df.agg(
        attempts.alias("attempts"), ok.alias("success"), (attempts - ok).alias("failure"),
        hits.alias("cache_hits"), (attempts - hits).alias("cache_misses"),
        share(ok, attempts).alias("success_rate"), share(hits, attempts).alias("cache_hit_rate"),
        F.count_if(html).alias("type_html"), F.count_if(pdf & ~html).alias("type_pdf"),
        F.count_if((kind != "") & ~html & ~pdf).alias("type_other"),
        *[F.count_if(reason == r).alias(f"reason_{r.lower()}") for r in FAILURE_REASONS],
        F.count_if(other).alias("reason_other"),
    )


def source_domains(df: DataFrame) -> DataFrame:
    """Distinct domains in use, as rows: the list may be long."""
    return df.where(F.col("source_domain") != "").groupBy("source_domain").agg(F.count("*").alias("records"))


def schema_metrics(results: DataFrame) -> DataFrame:
    ok = F.count_if("is_schema_valid")
    n = F.count("*")
    return results.agg(
        n.alias("total_records_checked"), ok.alias("schema_pass_count"), (n - ok).alias("schema_fail_count"),
        share(ok, n).alias("schema_pass_rate_pct"),
    )


def schema_report(delivered: DataFrame, results: DataFrame, headers: Sequence[str]) -> DataFrame:
    """One row on a delivery: whether its columns are the standard ones in order, and how many rows have issues of what number.

    ``delivered`` is the table itself, whose columns are checked; ``results`` has a row per record.
    """
    columns, expected = delivered.columns, set(headers)
    found = [c for c in columns if c in expected]
    missing, unexpected = [h for h in headers if h not in set(columns)], [c for c in columns if c not in expected]
    in_order = found == [h for h in headers if h in set(found)]
    structure = {
        "total_columns_found": F.lit(len(columns)), "expected_column_count": F.lit(len(headers)), "column_count_valid": F.lit(len(columns) == len(headers)),
        "headers_valid": F.lit(not missing and not unexpected), "order_valid": F.lit(in_order),
        "missing_headers": F.lit(",".join(missing)), "unexpected_headers": F.lit(",".join(unexpected)),
    }
    sound = len(columns) == len(headers) and not missing and not unexpected and in_order
    said = "252-Column Structural Schema: 100% COMPLIANT" if sound else f"252-Column Structural Schema: INVALID ({len(columns)}/{len(headers)} columns)"
    totals = results.agg(
        F.count("*").alias("total_rows_checked"), F.count_if("is_schema_valid").alias("valid_rows_count"), F.coalesce(F.sum("issue_count"), F.lit(0)).cast("long").alias("issues"),
    )
    invalid = F.col("total_rows_checked") - F.col("valid_rows_count")
    verdict = F.concat(F.lit(f"{said} | Row Verification: "), F.col("valid_rows_count").cast("string"), F.lit("/"), F.col("total_rows_checked").cast("string"), F.lit(" rows valid"))
    return totals.select(
        *[c.alias(n) for n, c in structure.items()], "total_rows_checked", "valid_rows_count", invalid.alias("invalid_rows_count"), "issues",
        (F.lit(sound) & (invalid == 0)).alias("is_valid"), verdict.alias("summary"),
    )


def schema_failures(results: DataFrame) -> DataFrame:
    """The failing records of the report."""
    return results.where(~F.col("is_schema_valid"))


def telemetry_snapshot(df: DataFrame, stage: str, value: str) -> DataFrame:
    """Latency per stage with cache, fallback, review and schema-failure rates."""
    rate = lambda c: F.round(F.count_if(c) / F.greatest(F.count("*"), F.lit(1)), 4)
    stats = [
        F.count("*").alias("count"), F.round(F.avg(value), 2).alias("avg_ms"),
        F.round(F.min(value), 2).alias("min_ms"), F.round(F.max(value), 2).alias("max_ms"),
        rate("cache_hit").alias("cache_hit_rate"),
        rate(F.col("source_mode").isin("OFFLINE_HEURISTIC", "FALLBACK")).alias("fallback_rate"),
        rate("review_required").alias("hitl_rate"),
        rate(~F.col("schema_valid")).alias("schema_failure_rate"),
    ]
    return index_percentiles(df, [stage], value, {"p95_ms": 0.95}, stats)


def failure_log(df: DataFrame, batch: str) -> DataFrame:
    return (
        df.where(F.col("status") == "ERROR")
        .groupBy(batch, F.coalesce("llm_error", F.lit("Max retries exceeded")).alias("error"))
        .agg(F.count("*").alias("failures"), F.sum("retry_count").alias("retries"), F.min("mfg_part_num").alias("first_part"))
    )
