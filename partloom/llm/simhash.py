"""SimHash near-duplicates found by multi-index hashing."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from partloom.llm.components import components
from partloom.llm.storage import free_name, located, written

BITS = 64
SEED = 42
#: For each byte value, its eight bits as eight bytes of one integer, so that one addition counts eight bits.
_SPREAD = (
    np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").copy().view(np.uint64).ravel()
)
_PIECE = 1 << 16


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    lanes = _SPREAD[hashes.view(np.uint8)].reshape(-1, 8)
    sums = np.add.reduceat(lanes, np.arange(0, len(lanes), 255), axis=0)  # a byte lane holds up to 255
    return sums.view(np.uint8).reshape(len(sums), BITS).sum(axis=0, dtype=np.int64)


def fingerprint(text: str | None, width: int = 4) -> int:
    """The fingerprint of one whole text as a signed integer; without words it is zero."""
    words = (text or "").encode("utf-8", "replace").lower().split()  # bytes: A-Z only, ASCII blanks only
    if not words:
        return 0
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    joined = b" ".join(words)
    first, last = starts[: max(1, len(words) - width + 1)], ends[min(width, len(words)) - 1 :]
    digest, counts = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64)
    for at in range(0, len(first), _PIECE):
        spans = zip(first[at : at + _PIECE].tolist(), last[at : at + _PIECE].tolist())
        counts += _bit_counts(np.array([digest(joined[a:b], SEED) for a, b in spans], np.uint64))
    return int(np.packbits(2 * counts > len(first), bitorder="little").view(np.int64)[0])


def with_fingerprints(docs: DataFrame, out: str, text: str = "text", width: int = 4) -> DataFrame:
    """``docs`` and the column ``out``: the 64-bit fingerprint over whole texts."""
    schema = T.StructType([*docs.schema.fields, T.StructField(out, T.LongType())])
    at = docs.columns.index(text)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint(v.as_py(), width) for v in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(prints, pa.int64())], [*batch.schema.names, out])

    return docs.mapInArrow(add, schema)


def _segments(count: int) -> list[tuple[int, int]]:
    """(shift, width) of the segments, as even as possible."""
    edges = [BITS * i // count for i in range(count + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def segment_radii(count: int, distance: int) -> list[int]:
    """The radius to search in each segment so that no pair within ``distance`` is missed (-1: none).

    With distance = count * a + b, two fingerprints that differ by more than ``a`` bits in each of the
    first b + 1 segments and by more than ``a - 1`` in each other one differ by more than ``distance`` bits.
    """
    a, b = divmod(distance, count)
    return [a if i <= b else a - 1 for i in range(count)]


def _ball(width: int, radius: int) -> list[int]:
    return [sum(1 << i for i in bits) for r in range(radius + 1) for bits in combinations(range(width), r)]


def near_pairs(prints: DataFrame, name: str, distance: int = 4, segments: int = 3) -> DataFrame:
    """(a, b), a < b: all pairs of distinct fingerprints that differ in at most ``distance`` bits.

    The table holds every fingerprint once for each segment, by the segment's value.  Every fingerprint
    looks up the values in a small ball around its own; a match counts if the complete distance fits, which is
    a condition of the join.  Longer segments make fewer false matches and larger balls: about log2 of the
    number of fingerprints is a good length (3 segments up to some 10^8 of them, 2 beyond).
    """

    def value(shift: int, width: int) -> Column:
        return F.shiftrightunsigned(name, shift).bitwiseAND(F.lit((1 << width) - 1))

    def entry(number: int, key: Column) -> Column:
        return F.struct(F.lit(number).alias("segment"), key.alias("value"))

    def ball(number: int, own: Column, masks: Column) -> Column:
        return F.transform(masks, lambda m: entry(number, own.bitwiseXOR(m)))

    entries, lookups = [], []
    for number, ((shift, width), radius) in enumerate(zip(_segments(segments), segment_radii(segments, distance))):
        if radius >= 0:
            entries.append(entry(number, value(shift, width)))
            masks = F.array(*[F.lit(m).cast("long") for m in _ball(width, radius)])
            lookups.append(ball(number, value(shift, width), masks))
    table = prints.select(F.col(name).alias("b"), F.explode(F.array(*entries)).alias("e")).select("b", "e.*")
    asked = prints.select(F.col(name).alias("a"), F.explode(F.flatten(F.array(*lookups))).alias("e")).select("a", "e.*")
    verified = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance)
    on = (asked.segment == table.segment) & (asked.value == table.value) & verified
    return asked.join(table, on).select("a", "b").distinct()


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 4, distance: int = 4, segments: int = 3
) -> DataFrame:
    """One row per document: its identifier, ``fingerprint`` (16 hex digits), ``component_id``, ``is_first``, and the
    file and row that hold it.

    Documents are linked when their fingerprints differ in at most ``distance`` bits; the component is named by
    the least identifier reachable.  Equal fingerprints are one node, so copies of a text cost one row each and
    are never paired.  ``is_first`` marks one row of each component: the least identifier, then file and row.

    Null and empty texts, and texts of blanks only, have fingerprint zero and are linked like others.  A null
    identifier comes after all others and names a component only if nothing else can.  Repeated rows are rows
    of their own.  An empty table gives an empty result.  Further columns are not read.
    """
    rows, file, row = located(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")))
    return _components(rows, file, row, width, distance, segments)


def _components(rows: DataFrame, file: str, row: str, width: int, distance: int, segments: int) -> DataFrame:
    prints = written(with_fingerprints(rows, "fp", "text", width).drop("text"), "prints")
    rank = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col(file), F.col(row))
    nodes = written(prints.groupBy("fp").agg(F.min(rank).alias("first")), "nodes")
    members = components(near_pairs(nodes, "fp", distance, segments), "a", "b")
    nodes = nodes.join(members, nodes.fp == members.node, "left").select(
        "fp", "first", F.coalesce("component", "fp").alias("component")
    )
    named = nodes.groupBy("component").agg(F.min("first").alias("first"))
    where = nodes.drop("first").join(named, "component").select(F.col("fp").alias("node"), "first")
    first = F.col("first")
    return prints.join(where, prints.fp == where.node).select(
        "doc_id",
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        first["doc_id"].alias("component_id"),
        ((F.col(file) == first[file]) & (F.col(row) == first[row])).alias("is_first"),
        F.col(file).alias("file"),
        F.col(row).alias("row"),
    )


def drop_near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 4, distance: int = 4, segments: int = 3
) -> DataFrame:
    """``docs`` with one document of each component: that with the least identifier.  Edge cases as above."""
    rows, file, row = located(docs)
    narrow = rows.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), file, row)
    first, f, r = _components(narrow, file, row, width, distance, segments), free_name(rows, "_f"), free_name(rows, "_r")
    first = first.where("is_first").select(F.col("file").alias(f), F.col("row").alias(r))
    kept = rows.join(first, (F.col(row) == F.col(r)) & (F.col(file) == F.col(f)), "left_semi")
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])
