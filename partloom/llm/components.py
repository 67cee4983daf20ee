"""Connected components of a link table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partloom.llm.storage import written


def _signature(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _star(links: DataFrame, larger: bool) -> DataFrame:
    """Hang the larger (or the not larger) neighbours of every node on its least neighbour.

    The least neighbour is an aggregate, combined before the shuffle, and is joined back; a node with
    very many links is an ordinary skewed left side of that join.
    """
    both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    near = both if larger else both.where("v < u")
    least = near.groupBy("u").agg(F.min("v").alias("m")).select(
        F.col("u").alias("c"), F.least("m", "u").alias("m")
    )
    joined = near.join(least, near.u == least.c)
    if larger:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select(F.col("c").alias("u"), F.col("m").alias("v"))
        )
    return out.where("u <> v").distinct()


def components(links: DataFrame, left: str, right: str) -> DataFrame:
    """(node, component) of every linked node; a component is named by its least node.

    ``links`` holds pairs in any order, repeated or not.  A round hangs neighbours on least neighbours
    in two steps, so the rounds grow with the logarithm of the nodes.  Every round is written to the
    shared folder, which also cuts the lineage.
    """
    links = links.select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v")).where("u <> v").distinct()
    links = written(links, "links")
    before = None
    while (now := _signature(links)) != before:
        before = now
        links = written(_star(_star(links, True), False), "links")
    stars = links.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
