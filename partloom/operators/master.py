"""Lookups in master tables of any size: equi-joins, whatever the size of either side.

The expression forms in ``entity`` and ``units`` put a table in the plan as a literal, which suits the closed tables that come
with the package.  Tables that grow (brands, aliases, prefixes, units of a real catalog) are DataFrames and
are joined here.  Keys of a table are unique, so a lookup never multiplies rows, and a hot key on
the left is an ordinary skewed side for the skew-join rule.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from partloom.functions.text import strip
from partloom.operators.common import growing

DIMENSION = "key string, value string"


def dimension(spark: SparkSession, rows: Iterable[tuple[str, str]]) -> DataFrame:
    """A table of (key, value) from rows that come with the package."""
    return spark.createDataFrame(list(rows), DIMENSION)


def lookup_join(df: DataFrame, key: Column, table: DataFrame, out: str) -> DataFrame:
    """``df`` with the value of ``key`` in ``table``, null without one.  Rows whose key is empty meet nothing."""
    right = table.select(F.col("key").alias("_lookup_key"), F.col("value").alias(out)).where("_lookup_key <> ''")
    left = df.withColumn("_key", F.when(key != "", key))
    return left.join(growing(right), F.col("_key") == F.col("_lookup_key"), "left").drop("_key", "_lookup_key")


def prefix_join(df: DataFrame, row_key: str, text: Column, prefixes: DataFrame, out: str) -> DataFrame:
    """``df`` with the value of the longest prefix of ``text`` in ``prefixes``.

    Every text meets the table once for each length that prefixes have; those lengths are the only thing the driver sees.
    """
    table = prefixes.where("key <> ''")
    lengths = sorted(r[0] for r in table.select(F.length("key")).distinct().collect())
    whole = df.select(F.col(row_key).alias("_row"), F.lower(strip(text)).alias("_text")).where("_text <> ''")
    cuts = F.array(*[F.struct(F.lit(n).alias("n"), F.substring("_text", 1, n).alias("cut")) for n in lengths or [1]])
    tried = whole.select("_row", "_text", F.explode(cuts).alias("c")).where(F.length("_text") >= F.col("c.n"))
    hits = tried.join(growing(table), F.col("c.cut") == F.col("key")).groupBy("_row").agg(F.max_by("value", "c.n").alias(out))
    return df.join(growing(hits), F.col(row_key) == F.col("_row"), "left").drop("_row")
