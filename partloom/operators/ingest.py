"""From an uploaded table to feed rows: header spellings, cell cleaning, duplicates, profiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partloom import vocab as V
from partloom.functions.text import clean_cell, strip
from partloom.operators.common import flag_repeats, last_by, share


def alias_columns(df: DataFrame, keep: Sequence[str] = ("_ordinal",)) -> DataFrame:
    """The part number, description and manufacturer under whichever header spelling is present."""

    def pick(names: Sequence[str]) -> Column:
        found = [F.when(F.col(n) != "", F.col(n)) for n in names if n in df.columns]
        return F.coalesce(*found, F.lit("")) if found else F.lit("")

    return df.select(
        *[c for c in keep if c in df.columns],
        pick(V.PART_ALIASES).alias("mpn"),
        pick(V.DESC_ALIASES).alias("description"),
        pick(V.MANUF_ALIASES).alias("manufacturer"),
    )


def dense_ordinal(df: DataFrame, out: str = "_ordinal") -> DataFrame:
    """Number rows 0..n-1 in file order.

    Two passes: rows per partition, then an offset per partition.  Only the partition counts, one
    small row per task, leave the executors.
    """
    from pyspark.sql import Window

    tagged = df.withColumn("_pid", F.spark_partition_id()).withColumn("_mid", F.monotonically_increasing_id())
    low_bits = F.col("_mid").bitwiseAND((1 << 33) - 1)
    counts = tagged.groupBy("_pid").agg(F.count("*").alias("_n"))
    offsets = counts.select(
        F.col("_pid").alias("_opid"),
        (F.sum("_n").over(Window.orderBy("_pid")) - F.col("_n")).alias("_offset"),
    )
    return (
        tagged.join(offsets, F.col("_pid") == F.col("_opid"))
        .withColumn(out, F.col("_offset") + low_bits)
        .drop("_pid", "_opid", "_mid", "_offset")
    )


def ingest(df: DataFrame) -> DataFrame:
    """Clean feed rows with ``malformed`` and ``duplicate`` flags; nothing is dropped.

    Expects ``_ordinal`` counting from 0 in file order.
    """
    rows = alias_columns(df)
    rows = rows.select("_ordinal", *[clean_cell(F.col(c)).alias(c) for c in rows.columns if c != "_ordinal"])
    rows = rows.withColumn("malformed", (F.col("mpn") == "") & (F.col("description") == ""))
    rows = rows.withColumn(
        "mpn",
        F.when(F.col("malformed") | (F.col("mpn") != ""), F.col("mpn")).otherwise(
            F.concat(F.lit("AUTO-GEN-"), (F.col("_ordinal") + 1).cast("string"))
        ),
    ).withColumn("description", F.when(F.col("description") != "", F.col("description")).otherwise(F.col("mpn")))
    rows = rows.withColumn("mpn_key", F.when(~F.col("malformed"), F.upper("mpn")))
    rows = flag_repeats(rows, "mpn_key", "_ordinal", "_again")
    return rows.withColumn("duplicate", ~F.col("malformed") & F.coalesce("_again", F.lit(False))).drop("_again")


def ingest_summary(ingested: DataFrame) -> DataFrame:
    return ingested.agg(
        F.count_if(~F.col("malformed")).alias("total_records_queued"),
        (F.count_if(~F.col("malformed")) - F.count_if("duplicate")).alias("unique_mpns"),
        F.count_if("duplicate").alias("duplicates_detected"),
        F.count_if("malformed").alias("malformed_rows_skipped"),
    )


def _cell(name: str) -> Column:
    return strip(F.coalesce(F.col(name), F.lit("")))


def input_errors(df: DataFrame, ordinal: str = "_ordinal") -> DataFrame:
    """One row per problem: missing key, repeated key, missing description."""
    rows = df.select(
        F.col(ordinal).alias("row_index"),
        _cell("Mfg_Part_Num").alias("mfg_part_num"),
        (_cell("Part_Desc") == "").alias("_no_desc"),
    )
    rows = flag_repeats(rows, "mfg_part_num", "row_index", "_again")

    def error(field: str, kind: str, message: Column) -> Column:
        return F.struct(
            F.lit(field).alias("field"), F.lit(kind).alias("error_type"), message.alias("message")
        )

    empty = F.col("mfg_part_num") == ""
    found = F.filter(
        F.array(
            F.when(empty, error("Mfg_Part_Num", "MISSING_KEY", F.lit("Mfg_Part_Num is empty or null"))),
            F.when(
                ~empty & F.col("_again"),
                error(
                    "Mfg_Part_Num", "DUPLICATE_KEY",
                    F.concat(F.lit("Duplicate Mfg_Part_Num: "), F.col("mfg_part_num")),
                ),
            ),
            F.when(
                F.col("_no_desc"),
                error("Part_Desc", "MISSING_DESCRIPTION", F.lit("Part_Desc is empty or null")),
            ),
        ),
        lambda e: e.isNotNull(),
    )
    return rows.select("row_index", "mfg_part_num", F.inline(found))


def repeat_facts(df: DataFrame, key: Column) -> DataFrame:
    """(keys, repeated keys, later copies): keys are counted before anything is compared."""
    counts = df.select(key.alias("_k")).where(F.col("_k") != "").groupBy("_k").count()
    return counts.agg(
        F.count("*").alias("distinct_keys"),
        F.count_if(F.col("count") > 1).alias("repeated_keys"),
        F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("later_copies"),
    )


def input_profile(df: DataFrame) -> DataFrame:
    """Completeness, duplicates and placeholder counts of a feed, one row."""
    total = F.count("*")
    has = lambda c: F.count_if(_cell(c) != "")
    noise = lambda c: F.count_if(_cell(c).rlike(r"(?i)--.*--|unbranded"))
    facts = df.agg(
        total.alias("total_records"),
        *[
            x
            for c, n in (("Mfg_Part_Num", "mpn"), ("Part_Desc", "desc"), ("Part_Manuf", "manuf"))
            for x in (
                has(c).alias(f"{n}_present"),
                (total - has(c)).alias(f"{n}_missing"),
                share(has(c), total).alias(f"{n}_completeness_pct"),
            )
        ],
        *[noise(c).alias(f"{c.lower()}_placeholders") for c in V.BRAND_DEFAULTS],
    )
    copies = repeat_facts(df, _cell("Mfg_Part_Num")).select(
        F.col("later_copies").alias("mpn_duplicates"), F.col("repeated_keys").alias("mpn_repeated_values")
    )
    return facts.join(copies)


def index_by_key(df: DataFrame, key: str, ordinal: str) -> DataFrame:
    """Reference records by upper-case key without marks; the last record of a key wins."""
    raw = F.col(f"`{key}`")
    bare = strip(F.translate(strip(raw), "®™", ""))
    keyed = df.withColumn(
        "match_key", F.when(~F.lower(strip(raw)).isin(V.EMPTY_WORDS), F.upper(bare))
    ).where(F.col("match_key") != "")
    return last_by(keyed, ["match_key"], [F.col(ordinal)])


def row_text(columns: Sequence[str]) -> Column:
    return F.concat_ws("|", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in columns])


def fingerprint(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Row count and the sums of both halves of every row's MD5 sum; the order of rows does not matter.

    Sums are decimals, which hold more rows than a table can have, so nothing overflows.  ``by`` gives one fingerprint
    for each group, such as the file that a row comes from.
    """
    digest = F.md5(row_text(columns))
    half = lambda start: F.sum(F.conv(F.substring(digest, start, 16), 16, 10).cast("decimal(20,0)")).cast("string")
    return df.groupBy(*by).agg(F.count("*").alias("row_count"), half(1).alias("digest_high"), half(17).alias("digest_low"))


def merge_dimension(defaults: DataFrame, overrides: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Defaults with overrides merged in by key: the later row of a key wins."""
    ranked = defaults.withColumn("_rank", F.lit(0)).unionByName(overrides.withColumn("_rank", F.lit(1)))
    tie = [F.col(c) for c in defaults.columns if c not in keys]
    return last_by(ranked, list(keys), [F.col("_rank"), *tie]).drop("_rank")


def sync_dimension(stored: DataFrame, current: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Upsert by natural key: stored rows not touched, updated rows, new rows, with what happened."""
    values = [c for c in stored.columns if c not in keys]
    renamed = current.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in values], F.lit(True).alias("_in"))
    held = stored.withColumn("_held", F.lit(True))
    both = held.join(renamed, list(keys), "full_outer")
    action = (
        F.when(F.col("_held").isNull(), "insert").when(F.col("_in").isNull(), "keep").otherwise("update")
    )
    return both.select(
        *keys,
        *[F.when(F.col("_in"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) for c in values],
        action.alias("action"),
    )
