"""Near copies by MinHash bands, with odd sketches in front of the comparison of whole sets."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from fractions import Fraction
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from partloom.llm.components import components
from partloom.llm.storage import free_name, located, written

#: Words of 64 bits in a sketch.
SKETCH = 8
_BITS = 64 * SKETCH
_CHUNK = 1 << 12
_ALL = (1 << 64) - 1


@cache
def _odd_numbers(seed: int, count: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 63, count, np.uint64) * np.uint64(2) + np.uint64(1)


_MIX = _odd_numbers(1, 4)


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """The distinct runs of ``width`` words as sorted 64-bit hashes; a shorter text is one run, one without words has none."""
    words = (text or "").encode("utf-8", "replace").lower().split()  # bytes: A-Z only, ASCII blanks only
    if not words:
        return np.zeros(0, np.uint64)
    own = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    factors, run = _odd_numbers(2, width), min(width, len(words))
    total = np.full(len(words) - run + 1, run, np.uint64)
    for i in range(run):
        total += own[i : i + len(total)] * factors[i]
    total ^= total >> np.uint64(29)
    total *= _MIX[0]
    return np.unique(total ^ (total >> np.uint64(32)))


@dataclass(frozen=True)
class Plan:
    """How many MinHash samples there are, and what is asked of a pair.

    Pairs at the bound share none of the ``bands`` with a probability of (1 - similarity ** rows) ** bands, and are refused by
    their sketches with one of at most ``miss``.
    """

    similarity: Fraction
    bands: int
    rows: int
    width: int

    @property
    def samples(self) -> int:
        return self.bands * self.rows

    @property
    def miss(self) -> float:
        return (1 - float(self.similarity) ** self.rows) ** self.bands

    def most_apart(self, miss: float = 1e-9) -> int:
        """The most bits in which sketches of a similar pair differ, but for a probability of ``miss``.

        Each sample agrees with a probability of the similarity, so the samples that differ are binomial; each puts at most
        two bits apart.
        """
        p, n, tail = float(self.similarity), self.samples, 0.0
        for agree in range(n + 1):
            tail += math.exp(math.lgamma(n + 1) - math.lgamma(agree + 1) - math.lgamma(n - agree + 1) + agree * math.log(p) + (n - agree) * math.log1p(-p))
            if tail > miss:
                return 2 * (n - agree)
        return 2 * n


def plan(similarity: float, width: int = 5, rows: int = 4, miss: float = 1e-10) -> Plan:
    """Bands of ``rows`` samples, so many that a pair at the bound shares none with a probability of ``miss`` at most."""
    bands = math.ceil(math.log(miss) / math.log1p(-(similarity**rows)))
    return Plan(Fraction(similarity).limit_denominator(10_000), bands, rows, width)


def min_hashes(hashes: np.ndarray, samples: int) -> np.ndarray:
    """The least value of each of ``samples`` hash functions over a set."""
    factors, offsets = _odd_numbers(3, samples), _odd_numbers(4, samples)
    least = np.full(samples, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), _CHUNK):
        block = hashes[at : at + _CHUNK, None] * factors
        block += offsets
        np.minimum(least, block.min(axis=0), out=least)
    return least


def fold(samples: np.ndarray) -> np.ndarray:
    """The odd sketch: each (number, sample) turns one bit over, so equal samples of two sets cancel in the XOR of their sketches."""
    numbers = _odd_numbers(5, len(samples))
    spread = (samples ^ numbers) * _MIX[1]
    at = ((spread ^ (spread >> np.uint64(31))) * _MIX[2]) >> np.uint64(64 - (_BITS - 1).bit_length())
    odd = (np.bincount(at.astype(np.int64), minlength=_BITS) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view(np.int64)


def band_keys(samples: np.ndarray, bands: int) -> np.ndarray:
    rows = samples.reshape(bands, -1)
    key = (rows * _odd_numbers(6, rows.shape[1])).sum(axis=1, dtype=np.uint64) + _odd_numbers(7, bands)
    key ^= key >> np.uint64(31)
    return (key * _MIX[3]).view(np.int64)


def estimate(apart: Column, samples: int) -> Column:
    """The similarity that two sketches which differ in ``apart`` bits stand for."""
    left = F.greatest(F.lit(1) - F.lit(2.0 / _BITS) * apart, F.lit(1e-3))
    return F.greatest(F.lit(1.0) + F.lit(_BITS / (4.0 * samples)) * F.log(left), F.lit(0.0))


def _described(settings: Plan) -> Callable:
    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        longs = pa.list_(pa.int64())
        for batch in batches:
            nodes, sizes, keys, sketches = [], [], [], []
            for text in batch.column(batch.schema.get_field_index("text")):
                own = shingle_hashes(text.as_py(), settings.width)
                sizes.append(len(own))
                nodes.append(int(np.uint64(xxhash.xxh3_64_intdigest(own.tobytes())).view(np.int64)) if len(own) else None)
                samples = min_hashes(own, settings.samples)
                keys.append(band_keys(samples, settings.bands) if len(own) else None)
                sketches.append(fold(samples) if len(own) else None)
            kept = [c for c in range(batch.num_columns) if batch.schema.names[c] != "text"]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in kept], pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(keys, longs), pa.array(sketches, longs)],
                [*[batch.schema.names[c] for c in kept], "node", "size", "keys", "sketch"],
            )

    return describe


def _apart(a: str, b: str) -> Column:
    bits = [F.bit_count(F.col(f"{a}.sketch")[i].bitwiseXOR(F.col(f"{b}.sketch")[i])) for i in range(SKETCH)]
    return sum(bits[1:], bits[0])


def _possible(a: str, b: str, settings: Plan) -> Column:
    """False only for pairs that are less similar by their sizes, or, but for the stated probability, by their sketches."""
    s, least, most = settings.similarity, F.least(f"{a}.size", f"{b}.size"), F.greatest(f"{a}.size", f"{b}.size")
    return (least * s.denominator >= most * s.numerator) & (_apart(a, b) <= settings.most_apart())


def _compared(pairs: DataFrame, texts: DataFrame, settings: Plan) -> DataFrame:
    """(a, b, similar, size, apart, other) of the pairs (a, b), by their whole sets: ``size`` is that of b, ``other`` that of a,
    and ``apart`` are the elements that one of them holds alone, mixed with a.  ``texts`` has one row (node, text) per node."""
    num, den = settings.similarity.numerator, settings.similarity.denominator
    kinds = [pa.bool_(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
    names = ["a", "b", "similar", "size", "other", "apart"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[int | None, np.ndarray | None] = (None, None)
        for batch in batches:
            rows = []
            for i, node in enumerate(batch.column(0).to_pylist()):
                if node != last[0]:
                    last = (node, shingle_hashes(batch.column(2)[i].as_py(), settings.width))
                hub, own = last[1], shingle_hashes(batch.column(3)[i].as_py(), settings.width)
                apart = np.setxor1d(hub, own, assume_unique=True)
                similar = len(apart) * (den + num) <= (den - num) * (len(own) + len(hub))
                rows.append((similar, len(own), len(hub), ((apart ^ np.uint64(node & _ALL)) * _MIX[2]).view(np.int64)))
            columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names)

    left = texts.select(F.col("node").alias("a"), F.col("text").alias("left"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("right"))
    both = written(pairs.join(right, "b"), "sent").join(left, "a").select("a", "b", "left", "right")
    return both.mapInArrow(compare, "a long, b long, similar boolean, size long, other long, apart array<long>")


def _stars(groups: DataFrame) -> DataFrame:
    """(a, b): every node b of a group (key, node) with the group's middle a: the node that meets most others in all groups."""
    # what is joined to a group is written first: with an aggregate on its other side, a join can't split a large group
    sizes = written(groups.groupBy("key").agg(F.count("*").alias("n")), "sizes")
    shared = written(groups.join(sizes, "key"), "shared")
    met = shared.groupBy("node").agg(F.sum("n").alias("met"))
    middle = written(shared.join(met, "node").groupBy("key").agg(F.max_by("node", F.struct("met", "node")).alias("a")), "middles")
    return shared.select("key", F.col("node").alias("b")).join(middle, "key").where("a <> b").select("a", "b").distinct()


def _labelled(nodes: DataFrame, name: str, known: DataFrame) -> DataFrame:
    own = nodes.join(known.withColumnRenamed("node", "member"), F.col(name) == F.col("member"), "left")
    return own.withColumn("component", F.coalesce("component", name)).drop("member")


def _unlike(star: DataFrame, known: DataFrame, sketches: DataFrame, settings: Plan) -> DataFrame:
    """(a, b): pairs that may be similar although one of them is unlike the middle to which both have been compared.

    With s the similarity, t = (1 - s) / (1 + s), m the middle and D(x) the elements in which x differs from it: x and y are similar
    if and only if they differ in at most t (|x| + |y|) elements, that is, if D(x) and D(y) share at least
    (|D(x)| + |D(y)| - t (|x| + |y|)) / 2 of them.  Seen from one side:

    * x is unlike m: at least |D(x)| - |x| (1 - s) / s, whatever y is;
    * y is like m: more than (|D(y)| + t (|m| - |y|)) / 2, since x must be unlike m.

    Elements that no other node of the middle has are shared with none.  Of c others, the first c - n + 1 in a common order, the rarest
    ones first, hold one of every n that are shared.  If x and y need not share any, they are similar by their distances
    from m, and so are x and the node with the least |D(y)| - t |y|, which is like m.
    """
    num, den = settings.similarity.numerator, settings.similarity.denominator
    more, less = F.lit(den + num), F.lit(den - num)
    star = star.withColumn("d", F.size("apart").cast("long"))
    shared = F.when(F.col("similar"), F.floor((F.col("d") * more + less * (F.col("other") - F.col("size"))) / (more * 2)) + 1).otherwise(
        F.col("d") - F.floor(F.col("size") * less / num)
    )
    nodes = star.select("a", "b", "similar", "d", F.greatest(shared, F.lit(1)).alias("least"), F.explode("apart").alias("key"))
    counts = nodes.groupBy("key").agg(F.count("*").alias("n"), F.bool_and("similar").alias("like")).where("n > 1 AND NOT like")
    held = nodes.join(written(counts.select("key", "n"), "counts"), "key")
    of_pair = Window.partitionBy("a", "b")
    held = held.withColumn("c", F.count("*").over(of_pair)).withColumn("i", F.row_number().over(of_pair.orderBy("n", "key")))
    held = held.where(F.col("i") <= F.col("c") - F.col("least") + 1).select("key", F.col("b").alias("node"), "similar", "d", "c")
    own = written(_labelled(held, "node", known).join(sketches, "node"), "held")
    required = (F.col("x.d") + F.col("y.d")) * more - less * (F.col("x.size") + F.col("y.size"))
    on = (F.col("x.key") == F.col("y.key")) & ~F.col("x.similar") & (F.col("x.component") != F.col("y.component"))
    on &= (F.col("y.similar") | (F.col("x.node") < F.col("y.node"))) & (required <= more * 2 * F.least("x.c", "y.c"))
    on &= _possible("x", "y", settings)
    pairs = own.alias("x").join(own.alias("y"), on).select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))
    weight = F.col("d") * more - F.col("size") * less
    second = star.groupBy("a").agg(F.min_by(F.struct("b", weight.alias("w")), F.struct(weight, "b")).alias("s"))
    close = star.where("NOT similar").join(second, "a").where(weight + F.col("s.w") <= 0)
    return pairs.unionByName(close.select(F.col("s.b").alias("a"), "b")).distinct()


def _links(groups: DataFrame, sketches: DataFrame, texts: DataFrame, settings: Plan) -> DataFrame:
    """(a, b): links with the same components as all similar pairs of nodes that share a group (key, node).

    Every node is compared with the middle of each of its groups; then the pairs that may be similar all the same.
    """
    star = written(_compared(_stars(groups), texts, settings), "star")
    near = star.where("similar").select("a", "b")
    rest = _unlike(star, components(near, "a", "b"), sketches, settings)
    return near.unionByName(written(_compared(rest, texts, settings).where("similar").select("a", "b"), "rest"))


def _rows(rows: DataFrame, settings: Plan) -> tuple[DataFrame, DataFrame]:
    """One row per document with its node, and (node, component) of the linked nodes.  ``rows`` has text, file and row."""
    longs = T.ArrayType(T.LongType())
    kinds = {"node": T.LongType(), "size": T.LongType(), "keys": longs, "sketch": longs}
    fields = [*[f for f in rows.schema.fields if f.name != "text"], *[T.StructField(n, k) for n, k in kinds.items()]]
    sets = written(rows.mapInArrow(_described(settings), T.StructType(fields)), "sets")
    first = F.min_by(F.struct("size", "keys", "sketch", "file", "row"), F.struct("file", "row"))
    nodes = written(sets.where("node IS NOT NULL").groupBy("node").agg(first.alias("s")).select("node", "s.*"), "nodes")
    groups = nodes.select("node", F.explode("keys").alias("key"))
    shared = written(groups.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "bands")
    groups = written(groups.join(shared, "key"), "groups")
    where = nodes.join(groups.select("node").distinct(), "node", "left_semi").select("node", F.col("file").alias("f"), F.col("row").alias("r"))
    held = rows.select("text", "file", "row").join(where, (F.col("row") == F.col("r")) & (F.col("file") == F.col("f")))
    texts = written(held.select("node", "text"), "texts")
    return sets.drop("keys", "sketch"), components(_links(groups, nodes.select("node", "size", "sketch"), texts, settings), "a", "b")


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5, similarity: float = 0.85, blanks_linked: bool = False
) -> DataFrame:
    """One row per document: ``doc_id``, ``n_shingles``, ``component_id``, ``kept``, and the ``file`` and ``row`` that hold it.

    Documents are linked when the Jaccard similarity of their sets of ``width``-word shingles (a text as bytes, A-Z in lower
    case, words between ASCII blanks) is ``similarity`` or more; a component is named by its least identifier, and ``kept``
    marks the one row that bears it.  MinHash samples are folded into odd sketches and cut into bands.  Documents that
    share a band are candidates: first each with the middle of its bands, then the other pairs that their differences from
    it, their sizes and their sketches allow; whole sets decide.  A linked pair is missed with a probability of
    2e-9 at most; sets are told apart by 64-bit hashes of their shingles.

    Null and empty texts, and texts of blanks only, have the empty set and are linked with nothing, or with each other if
    ``blanks_linked``.  Equal sets are one node and are never paired.  A null identifier comes after all others.  Rows with equal
    identifiers, repeated rows as well, are rows of their own and come in the order of file and row.  An empty table
    gives an empty result.  Further columns are not read.
    """
    rows, file, row = located(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")))
    return _components(rows.withColumnsRenamed({file: "file", row: "row"}), plan(similarity, width), blanks_linked)


def _components(rows: DataFrame, settings: Plan, blanks_linked: bool) -> DataFrame:
    sets, members = _rows(rows, settings)
    rank = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("file"), F.col("row"))
    if blanks_linked:
        sets = sets.withColumn("node", F.coalesce("node", F.lit(0)))
    nodes = sets.where("node IS NOT NULL").groupBy("node").agg(F.min(rank).alias("first"))
    named = nodes.join(members.withColumnRenamed("node", "m"), F.col("node") == F.col("m"), "left")
    named = written(named.select("node", "first", F.coalesce("component", "node").alias("component")), "named")
    least = named.groupBy("component").agg(F.min("first").alias("first"))
    first = named.drop("first").join(least, "component").select(F.col("node").alias("n"), "first")
    out = sets.join(first, F.col("node") == F.col("n"), "left").withColumn("first", F.coalesce("first", rank))
    return out.select(
        "doc_id", F.col("size").alias("n_shingles"), F.col("first")["doc_id"].alias("component_id"),
        ((F.col("file") == F.col("first")["file"]) & (F.col("row") == F.col("first")["row"])).alias("kept"), "file", "row",
    )


def drop_near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5, similarity: float = 0.8, blanks_linked: bool = True
) -> DataFrame:
    """``docs`` with one document of each component: that with the least identifier, then file and row.  Edge cases as above."""
    whole, file, row = located(docs)
    rows = whole.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(file).alias("file"), F.col(row).alias("row"))
    f, r = free_name(whole, "_f"), free_name(whole, "_r")
    kept = _components(rows, plan(similarity, width), blanks_linked).where("kept").select(F.col("file").alias(f), F.col("row").alias(r))
    out = whole.join(kept, (F.col(row) == F.col(r)) & (F.col(file) == F.col(f)), "left_semi")
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
