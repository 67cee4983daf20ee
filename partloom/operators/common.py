"""Relational helpers that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_DIR = "spark.checkpoint.dir"


_LOCAL_ROOTS: dict[str, str] = {}


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared folder the cluster names.

    Session settings are never changed.  Without the setting a local session gets a temporary folder, which is removed
    when Python ends; a cluster gets an error, since a folder of one machine is not seen by the others.
    """
    root = spark.conf.get(CHECKPOINT_DIR, None)
    if not root:
        context = spark.sparkContext
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError(f"set {CHECKPOINT_DIR} to a folder that driver and executors share")
        if context.applicationId not in _LOCAL_ROOTS:
            _LOCAL_ROOTS[context.applicationId] = tempfile.mkdtemp(prefix="spark-")
            atexit.register(shutil.rmtree, _LOCAL_ROOTS[context.applicationId], ignore_errors=True)
        root = _LOCAL_ROOTS[context.applicationId]
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a result used by several jobs to the shared folder and read it back.

    Executors may be lost at any time: a written table survives that, a cached one is recomputed.
    """
    spark = df.sparkSession
    path = work_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def growing(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that is shuffled, never broadcast.

    Spark decides by the bytes of the files, scaled by column types in which an array counts as one element.  Written tables are
    compressed, and a row of cells may be a hundred times what it is taken for, so a table of gigabytes would go through the driver.
    """
    return df.hint("merge")


def same_key(left: str, right: str) -> Column:
    """Null-safe key equality.

    Join keys here are often the last of a long chain of projections.  For a plain ``=`` Catalyst
    traces both keys down to a scan in search of prunable partitions and unfolds that whole chain;
    there is nothing to prune, and the null-safe form is joined just the same.
    """
    return F.col(left).eqNullSafe(F.col(right))


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One whole row per key, the first in ``order``.

    An aggregate, not a window: rows are reduced before the shuffle, so a key with any share of
    the rows sends one row per input partition.
    """
    rank = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), rank).alias("_row"))
    return picked.select(*keys, *[F.col("_row")[c].alias(c) for c in rest]).select(*df.columns)


def last_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    rank = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), rank).alias("_row"))
    return picked.select(*keys, *[F.col("_row")[c].alias(c) for c in rest]).select(*df.columns)


def flag_repeats(df: DataFrame, key: str, order: str, out: str, all_copies: str | None = None) -> DataFrame:
    """Flag rows whose key was seen before (``out``), and those whose key occurs more than once (``all_copies``).

    The per-key facts are aggregated and joined back.  That join has at most one row per key on the
    right, so a hot key on the left is split by the skew-join rule.
    """
    facts = df.groupBy(key).agg(F.min(order).alias("_first"), F.count("*").alias("_copies"))
    joined = df.join(growing(facts.withColumnRenamed(key, "_key")), same_key(key, "_key"), "left").withColumn(out, F.col(order) > F.col("_first"))
    if all_copies:
        joined = joined.withColumn(all_copies, F.col("_copies") > 1)
    return joined.drop("_key", "_first", "_copies")


def share(part: Column, whole: Column, digits: int = 2) -> Column:
    """Percentage with a guarded denominator."""
    return F.round(part / F.greatest(whole, F.lit(1)) * 100, digits)


def long_form(df: DataFrame, keys: Sequence[str], names: Sequence[str], name: str, value: str) -> DataFrame:
    """Columns to rows within one projection."""
    pairs = F.array(*[F.struct(F.lit(n).alias(name), F.col(f"`{n}`").alias(value)) for n in names])
    return df.select(*keys, F.explode(pairs).alias("_p")).select(*keys, f"_p.{name}", f"_p.{value}")


def any_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))
