"""Persisted tables that refer to each other: upserts by hash bucket, identifiers from natural keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from partloom.operators.common import growing, last_by, materialize

BUCKETS = 64
_BUCKET, _STATE = "_bucket", "_state"


def row_id(*natural: Column) -> Column:
    """An identifier made from the natural key, so the same row has it in every run and in every table that refers to it.

    128 bits of SHA-256 over the key with the length of every part before it; a null part differs from an empty one.
    """
    parts = [F.coalesce(F.concat(F.length(p.cast("string")).cast("string"), F.lit(":"), p.cast("string")), F.lit("-")) for p in natural]
    return F.substring(F.sha2(F.concat(*parts), 256), 1, 32)


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    jvm = spark._jvm.org.apache.hadoop.fs
    where = jvm.Path(path)
    return spark.read.parquet(path) if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where) else None


def merge(spark: SparkSession, path: str, rows: DataFrame, key: str, order: Sequence[Column] = (), buckets: int = BUCKETS) -> list[int]:
    """Insert or update ``rows`` by ``key`` in the table at ``path``; the buckets that were written anew.

    The table is partitioned by a hash of the key.  Keys and row sums, not rows, of both sides meet first and tell which buckets
    have a new or a changed row; only these are read whole, merged and overwritten, all others keep their files.  Of rows with an equal
    key the last in ``order`` counts, of ties the greatest row.  Rows that are stored and not given stay.  ``buckets`` is fixed
    for a table and bounds what the driver learns; raise it with the size of the table.

    Merged buckets are written to the shared folder and moved from there, so a task may be repeated, and a merge that was
    interrupted is mended by running it again on the same rows: a bucket is then either as before, as after, or lacks
    rows that the copy in the shared folder has.  One writer at a time.
    """
    values = [c for c in rows.columns if c != key]
    state = F.xxhash64(*[F.coalesce(F.to_json(F.struct(F.col(f"`{c}`"))), F.lit("")) for c in values]) if values else F.lit(0).cast("long")
    given = last_by(rows, [key], [*order, *[F.col(f"`{c}`") for c in values]])
    given = given.withColumn(_STATE, state).withColumn(_BUCKET, F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
    given = materialize(given, "merge-rows")
    held = _stored(spark, path)
    if held is None:
        touched = given.select(_BUCKET).distinct()
        new = given
    else:
        known = held.select(F.col(key).alias("_k"), F.col(_STATE).alias("_s"))
        marked = given.select(key, _STATE, _BUCKET).join(growing(known), F.col(key) == F.col("_k"), "left")
        touched = marked.where(F.col("_s").isNull() | (F.col("_s") != F.col(_STATE))).select(_BUCKET).distinct()
    numbers = sorted(r[0] for r in touched.collect())
    if not numbers:
        return []
    if held is not None:
        here = F.col(_BUCKET).isin(numbers)
        kept = held.where(here).join(growing(given.where(here).select(key)), key, "left_anti")
        new = materialize(kept.select(*given.columns).unionByName(given.where(here)), "merge-buckets")
    # one task for each bucket, and only the buckets at hand are replaced
    new.repartition(_BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(_BUCKET).parquet(path)
    return numbers


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop(_BUCKET, _STATE)


def unresolved(child: DataFrame, reference: str, parent: DataFrame, key: str) -> DataFrame:
    """The rows of ``child`` that refer to no row of ``parent``; a null refers to nothing and is fine."""
    return child.where(F.col(reference).isNotNull()).join(growing(parent.select(F.col(key).alias(reference))), reference, "left_anti")
