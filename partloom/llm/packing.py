"""Packing documents into sequences by online sum-of-squares placement."""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from partloom.llm.pretokens import piece_starts, symbol_table
from partloom.llm.token_counts import in_batches

#: A bound of memory, not of the data: beyond it the pieces that were not met since the last time are dropped, and encoded again
#: if they come back.  A Python worker serves many tasks and keeps what it once took, and a piece takes some 300 bytes.
MOST_PIECES = 250_000
_AT_ONCE = 8192


def _bytes(ids: list[int]) -> bytes:
    """Little-endian 32-bit; packing a few numbers takes a third of what an array of numpy does."""
    return struct.pack(f"<{len(ids)}I", *ids)


class Encoder:
    """Token ids of whole texts as little-endian 32-bit integers.

    The tokenizers library encodes every distinct piece once; a text's ids are those of its pieces in a row.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has a core; a pool of threads in each only costs time
        self.tokenizer = Tokenizer.from_file(path)
        self.symbols = symbol_table(self.tokenizer.pre_tokenizer)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.added = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}

    def _learn(self, pieces: list[str]) -> None:
        new = set(pieces).difference(self.known)
        if len(self.known) + len(new) > MOST_PIECES:
            self.older, self.known = self.known, {}
            new = set(pieces)
        again = {p: self.older[p] for p in new if p in self.older}  # as long as what is new, not as what is remembered
        self.known.update(again)
        rest = list(new.difference(again))
        for at in range(0, len(rest), _AT_ONCE):
            part = rest[at : at + _AT_ONCE]
            for piece, found in zip(part, self.tokenizer.encode_batch(part, add_special_tokens=False)):
                self.known[piece] = _bytes(found.ids)

    def encode(self, texts: list[str]) -> list[bytes]:
        plain = [t if not any(a in t for a in self.added) else "" for t in texts]
        flat, starts = piece_starts(plain, self.symbols)
        ends = np.append(starts[1:], len(flat)).tolist() if len(starts) else []
        pieces = [flat[a:b] for a, b in zip(starts.tolist(), ends)]
        self._learn(pieces)
        ids = list(map(self.known.__getitem__, pieces))
        cuts = np.searchsorted(starts, np.cumsum([0, *map(len, plain)])).tolist()
        out = [b"".join(ids[a:b]) for a, b in zip(cuts, cuts[1:])]
        for i, (text, kept) in enumerate(zip(texts, plain)):
            if text and not kept:  # holds an added token
                out[i] = _bytes(self.tokenizer.encode(text, add_special_tokens=False).ids)
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


class Packer:
    """Open windows by fill level.

    ``levels[h]`` counts the open windows that hold ``h`` tokens.  An item goes to the level, or to a new window, for
    which the sum of the squared counts of partly filled windows becomes least; of equals the fullest.  Windows that
    become full leave at once, so nothing is padded while items arrive.
    """

    def __init__(self, capacity: int, number: int = 0):
        self.capacity, self.number = capacity, number
        self.levels = np.zeros(capacity + 1, np.int64)
        self.open: dict[int, list[list]] = {}

    def _window(self) -> list:
        self.number += 1
        return [self.number - 1]

    def level_for(self, size: int) -> int:
        """The level at which an item of ``size`` is placed; 0 is a new window."""
        most = self.capacity - size
        if most <= 0:
            return 0
        own, then = self.levels[: most + 1], self.levels[size : self.capacity + 1]
        cost = 2 * (then - own) + 2  # one window less at its level, one more at the next
        cost[0] = 2 * then[0] + 1  # a new window leaves no level
        cost[most] = 1 - 2 * own[most]  # a full window enters none
        usable = own > 0
        usable[0] = True
        cost[~usable] = np.iinfo(np.int64).max
        return most - int(np.argmin(cost[::-1]))

    def place(self, piece: tuple, size: int) -> list | None:
        """Put a piece in its window, and return the window if that filled it."""
        level = self.level_for(size)
        if level == 0:
            window = self._window()
        else:
            stack = self.open[level]
            window = stack.pop()
            self.levels[level] -= 1
        window.append((*piece, level))
        if level + size == self.capacity:
            return window
        self.open.setdefault(level + size, []).append(window)
        self.levels[level + size] += 1
        return None

    def close(self) -> Iterator[list]:
        """The windows still open, with their gaps filled by cutting up the emptiest ones.

        At most one window is then partly filled; it is cut into sequences whose lengths are powers of two.
        """
        rest = [(level, w) for level in sorted(self.open, reverse=True) for w in self.open[level]]
        self.open, self.levels[:] = {}, 0
        supply: list[tuple] = []
        low = len(rest)
        for at in range(len(rest)):
            if at >= low:
                break
            level, window = rest[at]
            while level < self.capacity:
                if not supply:
                    if low - 1 <= at:
                        break
                    low -= 1
                    supply = [p[:-1] for p in rest[low][1][1:]]
                head, supply = self._cut(supply, self.capacity - level)
                for piece in head:
                    window.append((*piece, level))
                    level += len(piece[2]) // 4
            if level == self.capacity:
                yield window
            else:
                supply = [p[:-1] for p in window[1:]] + supply
        left = sum(len(p[2]) // 4 for p in supply)
        while left:
            size = min(self.capacity, 1 << (left.bit_length() - 1))
            head, supply = self._cut(supply, size)
            window, level = self._window(), 0
            for piece in head:
                window.append((*piece, level))
                level += len(piece[2]) // 4
            left -= size
            yield window

    @staticmethod
    def _cut(supply: list[tuple], size: int) -> tuple[list[tuple], list[tuple]]:
        """The first ``size`` tokens of the pieces, and the rest."""
        head: list[tuple] = []
        while size and supply:
            key, start, ids, total = supply[0]
            n = len(ids) // 4
            if n <= size:
                head.append(supply[0])
                supply = supply[1:]
                size -= n
            else:
                head.append((key, start, ids[: size * 4], total))
                supply = [(key, start + size, ids[size * 4 :], total), *supply[1:]]
                size = 0
        return head, supply


def pack(
    docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 1, doc_id: str = "doc_id", text: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece: ``doc_id``, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``, ``sequence_id``, ``offset``
    (and ``ids`` if asked for).

    A document is its ids by the tokenizer and ``end_id``.  Every task packs the documents of its partition as they
    come, without a shuffle: full windows are cut from long documents, and the rest is placed by the
    sum-of-squares rule.  At the end of the partition the windows still open are merged by cutting, and
    the last one becomes sequences with lengths that are powers of two; so no sequence needs padding.  A task
    numbers its sequences from its partition, and one that is run again on the same rows makes the same.

    A null or empty text is the end token alone.  Identifiers may be null or repeated: every row is a document of its
    own.  Texts of any length are encoded whole.  An empty table gives an empty result.  Further columns are not read.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    names = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    schema = T.StructType([T.StructField("doc_id", rows.schema["doc_id"].dataType), *[T.StructField(n, T.LongType()) for n in names]])
    if with_ids:
        schema.add("ids", T.ArrayType(T.LongType()))
    last = np.array([end_id], "<u4").tobytes()

    def batch_of(windows: list[list], kind: pa.DataType) -> pa.RecordBatch:
        rows = [
            (key, start, len(ids) // 4, zlib.crc32(ids), total, window[0], offset, ids)
            for window in windows for key, start, ids, total, offset in window[1:]
        ]
        columns = [pa.array([r[0] for r in rows], kind), *[pa.array([r[i] for r in rows], pa.int64()) for i in range(1, 7)]]
        if with_ids:
            columns.append(pa.array([np.frombuffer(r[7], "<u4").astype(np.int64) for r in rows], pa.list_(pa.int64())))
        return pa.RecordBatch.from_arrays(columns, schema.fieldNames())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).encode
        packer = Packer(capacity, TaskContext.get().partitionId() << 40)
        kind, full = None, []
        for batch in batches:
            kind = batch.schema.field(0).type
            keys, at = batch.column(0).to_pylist(), 0
            for part in in_batches(batch.column(1).to_pylist()):
                for ids in encode(part):
                    key, ids, at = keys[at], ids + last, at + 1
                    total = len(ids) // 4
                    for start in range(0, total, capacity):
                        piece = ids[start * 4 : (start + capacity) * 4]
                        done = packer.place((key, start, piece, total), len(piece) // 4)
                        if done:
                            full.append(done)
                if len(full) >= 1000:
                    yield batch_of(full, kind)
                    full = []
        if kind is not None:
            full.extend(packer.close())
            yield batch_of(full, kind)

    return rows.mapInArrow(run, schema)
