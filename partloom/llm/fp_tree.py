"""Ranked lexical search: documents share paths of an FP-tree, which is searched by branch and bound."""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from partloom.llm.storage import written

#: Maximal runs of ASCII letters and digits and of all characters beyond ASCII, here on UTF-8 bytes.
_TERM = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
#: Documents of a tree, documents that a leaf holds at most, and characters of items that are searched for in one pass.
TREE_DOCS, LEAF_DOCS, BLOCK_CHARS = 8192, 4, 250_000


def terms(text: str | None) -> list[bytes]:
    """The terms of a whole text in order, with repeats; only A-Z are put in lower case."""
    return _TERM.findall((text or "").encode("utf-8", "replace").lower())


def parts(tf: np.ndarray, m: np.ndarray | int) -> np.ndarray:
    """The part of a score that a term of weight 1 has; it grows with ``tf`` and falls with ``m``."""
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


class Tree:
    """An FP-tree over vectors of (term numbers in ascending order, counts): documents with the same first terms share a path.

    A node holds the most occurrences of every term below it, and the least m.  Paths are cut off where few documents are left.
    """

    def __init__(self, vectors: list[tuple]):
        #: (terms, counts, m, key) of documents, in the order of the paths; a subtree is a run of them.
        self.docs = sorted(vectors)
        self.spans: list[tuple[int, int]] = []
        self.children: list[list[int]] = []
        self.most: list[tuple[np.ndarray, np.ndarray]] = []
        self.least_m: list[int] = []
        self.weights: tuple | None = None
        if self.docs:
            self._grow(0, len(self.docs), 0)

    def _grow(self, a: int, b: int, depth: int) -> None:
        todo = [(a, b, depth, None)]
        while todo:
            a, b, depth, parent = todo.pop()
            first, last = self.docs[a][0], self.docs[b - 1][0]
            while depth < min(len(first), len(last)) and first[depth] == last[depth]:
                depth += 1  # one path for all
            node = len(self.spans)
            self.spans.append((a, b))
            self.children.append([])
            if parent is not None:
                self.children[parent].append(node)
            if b - a <= LEAF_DOCS or first == last:
                continue
            start = a
            while start < b:
                vector = self.docs[start][0]
                head = vector[depth] if depth < len(vector) else -1
                end = self._past(start, b, depth, head)
                todo.append((start, end, depth, node))
                start = end
        for a, b in self.spans:
            self.least_m.append(min(d[2] for d in self.docs[a:b]))
        self.most = [None] * len(self.spans)  # type: ignore[list-item]
        for node in reversed(range(len(self.spans))):  # children come after their parents
            below = [self.most[c] for c in self.children[node]] or [(np.array(d[0], np.int64), np.array(d[1], np.int64)) for d in self.docs[slice(*self.spans[node])]]
            names, at = np.unique(np.concatenate([n for n, _ in below]), return_inverse=True)
            counts = np.zeros(len(names), np.int64)
            np.maximum.at(counts, at, np.concatenate([c for _, c in below]))
            self.most[node] = (names, counts)

    def _past(self, low: int, high: int, depth: int, head: int) -> int:
        """The end of the run of documents that have ``head`` at ``depth``."""
        while low < high:
            mid = (low + high) // 2
            vector = self.docs[mid][0]
            if (vector[depth] if depth < len(vector) else -1) <= head:
                low = mid + 1
            else:
                high = mid
        return low

    def search(self, weights: np.ndarray, best: list[list[tuple]], k: int) -> None:
        """Add the best (score, key) of every item to its heap ``best``; ``weights`` has a row for each term, a column for each item.

        Depth first.  An item goes on to a subtree only if the bound of the subtree, from its largest counts and least m, can still
        enter the item's heap; most promising subtrees come first.
        """
        if not self.docs:
            return
        least = np.array([h[0][0] if len(h) == k else 0 for h in best], np.float64)

        def bounds(node: int, items: np.ndarray) -> np.ndarray:
            names, counts = self.most[node]
            return parts(counts, self.least_m[node]) @ weights[names][:, items]

        root = np.arange(len(best))
        todo = [(0, root, bounds(0, root))]
        while todo:
            node, items, bound = todo.pop()
            open_ = (bound >= least[items]) & (bound > 0)
            items, bound = items[open_], bound[open_]
            if not len(items):
                continue
            if self.children[node]:
                below = [(c, items, bounds(c, items)) for c in self.children[node]]
                todo += sorted(below, key=lambda x: x[2].max())
                continue
            for names, counts, m, key in self.docs[slice(*self.spans[node])]:
                scores = parts(np.array(counts, np.int64), m) @ weights[list(names)][:, items]
                for i in np.flatnonzero((scores >= least[items]) & (scores > 0)):
                    heap, entry = best[items[i]], (int(scores[i]), key)
                    if len(heap) < k:
                        heapq.heappush(heap, entry)
                    elif entry > heap[0]:
                        heapq.heapreplace(heap, entry)
                    if len(heap) == k:
                        least[items[i]] = heap[0][0]


def _counted(number: dict[bytes, int]) -> Callable:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, own, counts = [], [], []
            for text in batch.column(1):
                found = terms(text.as_py())
                held = Counter(number[t] for t in found if t in number)
                lengths.append(len(found))
                own.append(list(held))
                counts.append(list(held.values()))
            longs = pa.list_(pa.int64())
            more = [pa.array(lengths, pa.int64()), pa.array(own, longs), pa.array(counts, longs)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *more], ["doc_id", "n", "terms", "tf"])

    return count


def _searched(wanted: list[list[int]], df: dict[int, int], n_docs: int, n_terms: int, k: int) -> Callable:
    """Search for items, given as lists of term numbers, in the trees of a task.  Best scores go on from tree to tree."""
    order = sorted(df, key=lambda t: (-df[t], t))  # frequent terms first, so that paths are shared
    number = {t: i for i, t in enumerate(order)}
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) for t in order], np.int64)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = np.zeros((len(order), len(wanted)), np.int64)
        for i, item in enumerate(wanted):
            at = [number[t] for t in item if t in number]
            weights[at, i] = weight[at]
        best: list[list[tuple]] = [[] for _ in wanted]
        waiting: list[tuple] = []
        for batch in batches:
            doc_id, n, own, counts = (c.to_pylist() for c in batch.columns)
            for i in range(batch.num_rows):
                if own[i]:
                    vector = sorted(zip((number[t] for t in own[i]), counts[i]))
                    key = (doc_id[i] is not None, -(doc_id[i] or 0))  # the larger, the earlier among equal scores
                    waiting.append((*map(tuple, zip(*vector)), 10 + 90 * n[i] * n_docs // n_terms, key))
                if len(waiting) == TREE_DOCS:
                    Tree(waiting).search(weights, best, k)
                    waiting = []
        Tree(waiting).search(weights, best, k)
        rows = [(i, score, -key[1] if key[0] else None) for i, heap in enumerate(best) for score, key in heap]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.int64()) for c in range(3)], ["item", "score", "doc_id"])

    return search


def _ranked(docs: DataFrame, items: list[tuple[object, set[bytes]]], k: int) -> DataFrame | None:
    number = {t: i for i, t in enumerate(sorted(set().union(*(wanted for _, wanted in items))))}
    vectors = written(docs.mapInArrow(_counted(number), "doc_id long, n long, terms array<long>, tf array<long>"), "vectors")
    n_docs, n_terms = vectors.agg(F.count_if(F.col("n") > 0), F.sum("n")).first()
    if not n_docs:
        return None
    df = {r["t"]: r["count"] for r in vectors.select(F.explode("terms").alias("t")).groupBy("t").count().collect()}
    wanted = [sorted(number[t] for t in own) for _, own in items]
    found = vectors.where("size(terms) > 0").mapInArrow(_searched(wanted, df, n_docs, n_terms, k), "item long, score long, doc_id long")
    names = docs.sparkSession.createDataFrame([(i, item) for i, (item, _) in enumerate(items)], "item long, item_id long")
    order = F.row_number().over(Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last()))
    best = found.withColumn("rank", order).where(F.col("rank") <= k)
    return best.join(names, "item").select("item_id", "rank", "doc_id", "score")


def rank_documents(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
    item_text: str = "text", k: int = 10, block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """(item_id, rank, doc_id, score): for every item its ``k`` documents with the highest scores above 0, whole texts throughout.

    Documents are cut down to the terms of the items, with counts, and sorted by how many documents hold a term.  Every task grows
    FP-trees over its documents and searches each by branch and bound; its best scores so far bound the next tree.  Only the
    best of a task are shuffled.  Items are read in blocks of about ``block_chars`` characters, each of which takes a
    pass over the documents; the driver holds one block and the document frequencies of its terms.

    The score is the sum over an item's distinct terms of w * ((1000000000 tf) div (1000 tf + 8 m)), with w =
    floor(1000 ln((2 N + 2) / (2 df + 1))) and m = 10 + (90 n N) div L; equal scores come by ascending ``doc_id``, null last.

    A null or empty text has no terms: such a document is not counted, such an item finds nothing.  Repeated rows of documents are
    documents of their own; so are repeated rows of items, each with ranks from 1.  Without documents or items the result is
    empty.  Further columns are not read.
    """
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    asked = written(items.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).alias("text")), "items")
    size = asked.agg(F.sum(F.length("text") + 100)).first()[0] or 0
    blocks = max(1, -(-size // block_chars))
    results = []
    for block in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()
        listed = [(r["item_id"], set(terms(r["text"]))) for r in sorted(rows, key=lambda r: (r["item_id"] is None, r["item_id"], r["text"] or ""))]
        found = _ranked(own, [(i, t) for i, t in listed if t], k)
        if found is not None:
            results.append(written(found, "ranked") if blocks > 1 else found)
    if not results:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return reduce(DataFrame.unionByName, results)
