"""Fingerprints of files: a tree of SHA-256 sums over byte ranges, and plain SHA-256 sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LEAF_BYTES = 1 << 16
FAN_OUT = 1024


def _listing(numbered: list[Column], order: str) -> Column:
    """``number:digest`` of the rows of a group in order of ``order``, joined by commas."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("n"), F.concat_ws(":", *numbered).alias("t"))))
    return F.array_join(F.transform(rows, lambda r: r["t"]), ",")


def file_sums(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, bytes, sha256) of whole files, as command-line tools give them.  A file is one cell here, so 2 GB are the most.

    Spark lists no empty files, so they have no row, here and below.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return found.select(F.col("path").alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def file_leaves(spark: SparkSession, path: str | list[str], leaf_bytes: int = LEAF_BYTES) -> DataFrame:
    """(file, bytes, leaf, digest): the sum over every range of ``leaf_bytes`` bytes of a file.

    Files are read as lines (ended by a line feed), so they are split among tasks; any bytes will do.  A line belongs to the range
    it begins in, and is known there by its place in the file and its own SHA-256 sum.  Where a split begins is the sum
    of the splits before it, one row for each; inside a split it is a running sum over lengths and sums alone, never texts.  The
    result is the same however the files are split.  A leaf has at most ``leaf_bytes`` lines.  An empty file has no leaf; of
    a compressed file, which has one split, the content counts and ``bytes`` is the compressed size.
    """
    reader = spark.read.option("recursiveFileLookup", True).option("lineSep", "\n")
    lines = reader.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("bytes"), F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_id"), (F.octet_length("value") + F.lit(1).cast("long")).alias("_size"),
        F.sha2(F.col("value").cast("binary"), 256).alias("_sum"),
    )
    splits = lines.groupBy("file", "_block").agg(F.sum("_size").alias("_held"))
    before = Window.partitionBy("file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select(F.col("file").alias("_f"), F.col("_block").alias("_b"), F.coalesce(F.sum("_held").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("file", "_block").orderBy("_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = lines.withColumn("_in", F.coalesce(F.sum("_size").over(inside), F.lit(0)))
    placed = placed.join(splits, (F.col("file") == F.col("_f")) & (F.col("_block") == F.col("_b"))).withColumn("_at", F.col("_base") + F.col("_in"))
    leaf = F.floor(F.col("_at") / leaf_bytes).alias("leaf")
    listed = placed.groupBy("file", "bytes", leaf).agg(_listing([F.col("_at"), F.col("_sum")], "_at").alias("_l"))
    return listed.select("file", "bytes", "leaf", F.sha2("_l", 256).alias("digest"))


def file_roots(leaves: DataFrame, largest: int, leaf_bytes: int = LEAF_BYTES, fan_out: int = FAN_OUT) -> DataFrame:
    """(file, bytes, leaves, root) of the leaves of ``file_leaves``; ``largest`` is the size of the largest file or more.

    A node is the sum over at most ``fan_out`` nodes below it.  The height of a tree follows from its file's size alone, and the size
    goes into the root, which tells a last line without its end from one with it.
    """
    nodes = leaves.withColumns({"_node": F.col("leaf"), "_leaves": F.lit(1).cast("long")}).drop("leaf")
    reach = leaf_bytes
    while reach < largest:
        tall = F.col("bytes") > reach
        up = F.when(tall, F.floor(F.col("_node") / fan_out)).otherwise(F.col("_node"))
        met = nodes.withColumns({"_up": up, "_tall": tall}).groupBy("file", "bytes", "_up", "_tall").agg(
            _listing([F.col("_node"), F.col("digest")], "_node").alias("_l"), F.min("digest").alias("_same"), F.sum("_leaves").alias("_leaves")
        )
        nodes = met.select("file", "bytes", F.col("_up").alias("_node"), "_leaves", F.when(F.col("_tall"), F.sha2("_l", 256)).otherwise(F.col("_same")).alias("digest"))
        reach *= fan_out
    return nodes.select("file", "bytes", F.col("_leaves").alias("leaves"), F.sha2(F.concat_ws(":", "bytes", "digest"), 256).alias("root"))


def file_trees(spark: SparkSession, path: str | list[str], leaf_bytes: int = LEAF_BYTES, fan_out: int = FAN_OUT) -> DataFrame:
    """(file, bytes, leaves, root) of files of any size; one row for each file that is not empty."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    largest = listed.agg(F.max("length")).first()[0] or 0
    return file_roots(file_leaves(spark, path, leaf_bytes), largest, leaf_bytes, fan_out)


def changed_ranges(old: DataFrame, new: DataFrame, leaf_bytes: int = LEAF_BYTES) -> DataFrame:
    """(file, start): the ranges in which two versions of ``file_leaves`` differ; ``file`` must name them alike."""
    was = old.select("file", "leaf", F.col("digest").alias("_was"))
    both = was.join(new.select("file", "leaf", F.col("digest").alias("_is")), ["file", "leaf"], "full_outer")
    return both.where(~F.col("_was").eqNullSafe(F.col("_is"))).select("file", (F.col("leaf") * leaf_bytes).alias("start"))
