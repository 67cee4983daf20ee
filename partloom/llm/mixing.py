"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partloom.llm.storage import free_name

#: Rows of the weight table up to which it is sent to every executor.
SMALL_TABLE = 10_000


def hashed_uniform(seed: int, *parts: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of an MD5 sum."""
    digits = F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), *parts)), 1, 13)
    return F.conv(digits, 16, 10).cast("long") / F.lit(float(1 << 52))


def poisson_cdf(rate: Column) -> Column:
    """The cumulative probabilities of a Poisson distribution, up to twelve deviations past its mean.

    Terms are summed as exp(log p), so that a large mean does not underflow.
    """
    last = F.ceil(rate + 12 * F.sqrt(rate) + 30).cast("int")
    zero = F.struct((-rate).alias("log"), F.exp(-rate).alias("sum"), F.array(F.exp(-rate)).alias("cdf"))

    def step(state: Column, k: Column) -> Column:
        log = state["log"] + F.log(rate) - F.log(k.cast("double"))
        total = state["sum"] + F.exp(log)
        return F.struct(log.alias("log"), total.alias("sum"), F.concat(state["cdf"], F.array(total)).alias("cdf"))

    return F.aggregate(F.sequence(F.lit(1), last), zero, step, lambda s: s["cdf"])


def rates(docs: DataFrame, weights: Mapping[str, float], source: str, size: Column, epochs: float) -> DataFrame:
    """(name, rate, cdf): the mean repetitions of each weighted source.

    A source of size S with weight w gets w / sum(w) of ``epochs`` times the size of all weighted sources.
    """
    total = math.fsum(weights.values())
    pairs = [F.struct(F.lit(k).alias("name"), F.lit(float(v) / total).alias("share")) for k, v in weights.items()]
    given = docs.sparkSession.range(1).select(F.explode(F.array(*pairs)).alias("w")).select("w.*")
    sizes = docs.groupBy(F.col(source).alias("name")).agg(F.sum(size).cast("double").alias("size"))
    found = given.join(sizes, "name").where("size > 0")
    # one row per weighted source: a window over a table no longer than ``weights``
    whole = found.agg(F.sum("size").alias("whole"), F.collect_list(F.struct("name", "share", "size")).alias("each"))
    each = whole.select("whole", F.explode("each").alias("e")).select("whole", "e.*")
    rate = F.col("share") * (F.col("whole") * F.lit(float(epochs))) / F.col("size")
    return each.select("name", rate.alias("rate")).select("name", "rate", poisson_cdf(F.col("rate")).alias("cdf"))


def mix(
    docs: DataFrame, weights: Mapping[str, float], doc_id: str = "doc_id", text: str = "text", source: str = "source",
    size: Column | None = None, epochs: float = 1.0, seed: int = 7, partitions: int | None = None,
    copy: str = "copy", order: str = "shuffle_key",
) -> DataFrame:
    """``docs`` repeated to the target weights and shuffled globally, with the columns ``copy`` (from 1) and ``shuffle_key``.

    Every document draws its number of copies from the Poisson distribution whose mean is its source's rate, by
    inverting the distribution at a hash of the seed and the document; the expected size of a source is its
    share of the weights, and no source is sampled without the chance of every document to appear.  Every copy goes
    to a partition and a place in it that a second hash chooses, so sources do not matter for the balance, and
    a task that is run again makes the same rows.

    A source without a weight, and a null source, stays as it is (one copy each); a weight of zero removes its
    source.  Size is the number of characters unless given; null and empty texts have none and do not change
    a rate.  A null identifier is replaced by a digest of the text in the hash.  Repeated rows draw the same count.
    An empty table gives an empty result.
    """
    if any(v < 0 or not math.isfinite(v) for v in weights.values()):
        raise ValueError("weights are finite and not negative")
    weights = {k: v for k, v in weights.items()}
    copy, order = free_name(docs, copy), free_name(docs, order)
    identity = F.coalesce(F.col(doc_id).cast("string"), F.md5(F.coalesce(F.col(text), F.lit(""))))
    size = F.length(text).cast("long") if size is None else size
    positive = {k: v for k, v in weights.items() if v > 0}
    count = F.lit(1)
    rows = docs
    name, cdf, n = free_name(docs, "_name"), free_name(docs, "_cdf"), free_name(docs, "_n")
    if positive:
        table = rates(docs, positive, source, size, epochs).select(F.col("name").alias(name), F.col("cdf").alias(cdf))
        if len(weights) <= SMALL_TABLE:  # one row for each weight at most
            table = F.broadcast(table)
        rows = docs.join(table, docs[f"`{source}`"] == F.col(name), "left")
        u = hashed_uniform(seed, identity)
        count = F.when(F.col(cdf).isNotNull(), F.size(F.filter(cdf, lambda p: p <= u))).otherwise(1)
    zero = [k for k, v in weights.items() if v == 0]
    if zero:
        count = F.when(F.col(source).isin(zero), 0).otherwise(count)
    place_of = free_name(docs, "_copy0")
    each = F.posexplode(F.array_repeat(F.lit(True), count)).alias(place_of, n)
    rows = rows.select(*[docs[f"`{c}`"] for c in docs.columns], each).withColumn(copy, F.col(place_of) + 1)
    place = hashed_uniform(seed + 1, identity, F.col(copy).cast("string"))
    out = rows.select(*[docs[f"`{c}`"] for c in docs.columns], copy, place.alias(order))
    out = out.repartition(order) if partitions is None else out.repartition(partitions, order)
    return out.sortWithinPartitions(order)
