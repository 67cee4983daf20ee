"""Rolling measures over event logs.

A plain window puts all rows of a key in one task.  These sort the whole log by key and time over all tasks, number the
rows by distributed running sums (``prefix``), and take differences between two places in that order, so a key with any
share of the rows, and any number of rows within one frame, is spread like the rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partloom.operators.common import same_key
from partloom.operators.prefix import prefix_sums

RATE_LIMIT, RATE_SECONDS = 120, 60
BREAKER_ROWS, BREAKER_THRESHOLD = 10, 0.5
_MICROS = 1_000_000


def micros(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def trailing_count(df: DataFrame, key: str, ts: str, seconds: int, out: str) -> DataFrame:
    """Rows of the same key in the trailing ``seconds``, the row itself and its ties included.

    Rows are first counted by key and time.  Two marks for each such pair, its own place and the place where its frame starts,
    are merged into one order; the count is the difference of the running sums at its two marks.  Rows with a null
    time take no part; null keys are one key.
    """
    moments = df.where(F.col(ts).isNotNull()).groupBy(F.col(key).alias("_k"), micros(ts).alias("_t")).agg(F.count("*").alias("_n"))
    own = F.struct(F.col("_t").alias("at"), F.lit(1).alias("own"), F.col("_n").alias("n"))
    start = F.struct((F.col("_t") - seconds * _MICROS).alias("at"), F.lit(0).alias("own"), F.lit(0).cast("long").alias("n"))
    marks = moments.select("_k", "_t", F.explode(F.array(own, start)).alias("m")).select("_k", "_t", "m.*")
    placed = prefix_sums(marks, ["_k", "at", "own", "_t"], {"_sum": F.col("n")})
    at = lambda own: F.max(F.when(F.col("own") == own, F.col("_sum")))
    counts = placed.groupBy("_k", "_t").agg((at(1) - at(0)).alias(out))
    return df.join(counts, same_key(key, "_k") & (micros(ts) == F.col("_t"))).drop("_k", "_t")


def over_rate(df: DataFrame, client: str, ts: str) -> DataFrame:
    counted = trailing_count(df, client, ts, RATE_SECONDS, "requests_in_window")
    return counted.withColumn("over_limit", F.col("requests_in_window") > RATE_LIMIT)


def rolling_failures(df: DataFrame, key: str, ts: str, tie: str, failed: Column, rows: int = BREAKER_ROWS) -> DataFrame:
    """Failure share of the last ``rows`` outcomes of a key, and whether that trips the breaker.

    Rows are numbered over the whole log in the order of key, time and ``tie``, with the failures up to each.  A row is
    joined by number to the one ``rows`` before it; if that belongs to another key, the frame starts with the key.  Null keys are one
    key, null times come first.
    """
    numbered = prefix_sums(df.withColumn("_f", failed.cast("long")), [key, ts, tie], {"_at": F.lit(1), "_failures": F.col("_f")})
    first = numbered.groupBy(F.col(key).alias("_k")).agg(
        (F.min("_at") - 1).alias("_from"), F.min_by(F.col("_failures") - F.coalesce("_f", F.lit(0)), "_at").alias("_before")
    )
    earlier = numbered.select((F.col("_at") + rows).alias("_to"), F.col("_failures").alias("_past"))
    joined = numbered.join(first, same_key(key, "_k")).join(earlier, F.col("_at") == F.col("_to"), "left")
    whole = F.col("_at") - F.col("_from") >= rows
    past = F.when(whole, F.coalesce("_past", F.lit(0))).otherwise(F.col("_before"))
    rated = joined.withColumn("outcomes", F.least(F.col("_at") - F.col("_from"), F.lit(rows).cast("long")))
    rated = rated.withColumn("failure_rate", (F.col("_failures") - past) / F.col("outcomes"))
    tripped = (F.col("outcomes") == rows) & (F.col("failure_rate") >= BREAKER_THRESHOLD)
    return rated.select(*df.columns, "outcomes", "failure_rate", tripped.alias("tripped"))


def progress(df: DataFrame, batch: str) -> DataFrame:
    """Processed share and counters per batch."""
    done = F.col("status") == "SUCCESS"
    return df.groupBy(batch).agg(
        F.count("*").alias("total_items"), F.count_if(done).alias("processed_items"),
        F.round(F.count_if(done) / F.greatest(F.count("*"), F.lit(1)) * 100, 1).alias("progress_pct"),
        F.count_if(F.col("confidence") >= 0.90).alias("high_confidence_count"),
        F.count_if(F.col("confidence") < 0.90).alias("review_needed_count"),
    )
