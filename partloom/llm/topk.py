"""Exact top-k search by inner product with a KD-tree per shard."""

from __future__ import annotations

import heapq


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from partloom.llm.heap_kmeans import quantized
from partloom.llm.storage import written

SHARD_ROWS, BLOCK_QUERIES, LEAF = 8192, 4096, 64
_LARGEST = (1 << 63) - 1


class Tree:
    """A KD-tree over integer vectors: median splits of the widest axis, a tight box and the least id for each node."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, points: np.ndarray):
        self.order = np.arange(len(ids))
        self.spans: list[tuple[int, int]] = []
        self.children: list[tuple[int, int] | None] = []
        lows, highs, least = [], [], []
        todo = [(0, len(ids), None)]
        while todo:
            a, b, parent = todo.pop()
            node = len(self.spans)
            own = points[self.order[a:b]]
            low, high = own.min(axis=0), own.max(axis=0)
            self.spans.append((a, b))
            self.children.append(None)
            lows.append(low)
            highs.append(high)
            least.append(ids[self.order[a:b]].min())
            if parent is not None:
                self.children[parent] = (*(self.children[parent] or ()), node)
            if b - a > LEAF and points.shape[1]:
                axis, mid = int(np.argmax(high - low)), (b - a) // 2
                self.order[a:b] = self.order[a:b][np.argpartition(own[:, axis], mid)]
                todo += [(a, a + mid, node), (a + mid, b, node)]
        self.low, self.high, self.least = np.array(lows), np.array(highs), np.array(least)
        self.ids, self.rows, self.points = ids[self.order], rows[self.order], points[self.order]

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """The largest inner product that each query can have with a point of each box."""
        return np.maximum(queries, 0) @ self.high.T + np.minimum(queries, 0) @ self.low.T

    def search(self, query: np.ndarray, bound: np.ndarray, own: int, k: int, kth: float) -> list[tuple]:
        """The k best (score, -id) of the shard but for the row ``own``, none of them below ``kth``.

        Boxes are opened best first.  A box is left out if even its bound is below the k-th score so far or below the
        one handed over from another shard, or equals it and holds no smaller id.
        """
        best: list[tuple] = []
        heap = [(-bound[0], 0)]
        while heap:
            top, node = heapq.heappop(heap)
            if -top < kth or len(best) == k and (-top, -self.least[node]) <= best[0]:
                if -top < kth or -top < best[0][0]:
                    break  # so are all boxes that are left
                continue
            if (children := self.children[node]) is not None:
                for child in children:
                    heapq.heappush(heap, (-bound[child], child))
                continue
            a, b = self.spans[node]
            scores, ids, rows = self.points[a:b] @ query, self.ids[a:b], self.rows[a:b]
            least = max(kth, best[0][0]) if len(best) == k else kth
            for i in np.flatnonzero(scores >= least):
                if rows[i] != own:
                    found = (scores[i], -ids[i])
                    if len(best) < k:
                        heapq.heappush(best, found)
                    elif found > best[0]:
                        heapq.heapreplace(best, found)
        return best


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    flat = [c.flatten().to_numpy(zero_copy_only=False) for c in column.chunks]
    return np.concatenate([np.zeros(0, np.int64), *flat]).reshape(len(column), dim)


def _searcher(k: int):
    schema = pa.schema([(n, pa.int64()) for n in ("query_id", "query_row", "vec_id", "score")])

    def search(key: tuple, vectors: pa.Table, queries: pa.Table) -> pa.Table:
        dim, rows = key[0].as_py(), []
        if vectors.num_rows and queries.num_rows:
            points, asked = _matrix(vectors["v"], dim), _matrix(queries["v"], dim)
            most = int(max(points.max(initial=0), -int(points.min(initial=0)))) * int(max(asked.max(initial=0), -int(asked.min(initial=0)))) * dim
            # sums of products below 2^53 are exact in floating point; beyond 64 bits Python's integers are used
            kind = np.float64 if most < 1 << 53 else np.int64 if most <= _LARGEST else object
            points, asked = points.astype(kind), asked.astype(kind)
            tree = Tree(vectors["vec_id"].to_numpy(), vectors["row"].to_numpy(), points)
            ids, own, kth = (queries[n].to_pylist() for n in ("vec_id", "row", "kth"))
            for at in range(0, len(asked), 512):
                for i, bound in enumerate(tree.bounds(asked[at : at + 512]), at):
                    least = -np.inf if kth[i] is None else kth[i]
                    rows += [(ids[i], own[i], -j, score) for score, j in tree.search(asked[i], bound, own[i], k, least)]
        if any(abs(r[3]) > _LARGEST for r in rows):
            raise OverflowError("a score does not fit 64 bits")
        columns = [pa.array([int(r[i]) for r in rows], pa.int64()) for i in range(4)]
        return pa.Table.from_arrays(columns, schema=schema)

    return search


def top_k(
    vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", every: int = 50, k: int = 5,
    shard_rows: int = SHARD_ROWS, block_queries: int = BLOCK_QUERIES,
) -> DataFrame:
    """(query_id, rank, vec_id, score): for every row whose id is divisible by ``every``, its ``k`` best other rows.

    Components are quantised to floor(256 * x); the score is the integer inner product, ties go to the smaller id.
    Rows are dealt to shards of about ``shard_rows``, each with a KD-tree.  A query first meets one shard; its k-th
    score there goes with it to all others, in blocks of about ``block_queries`` queries.  So a task
    holds one shard and one block, however large the table.

    Rows with a null id or vector, or with a null or non-finite component, take no part.  Vectors meet only vectors of
    the same length.  Repeated rows are rows of their own: as queries each has its ranks, as candidates each counts, and only the
    query's own row is none.  A component or a score of a result that does not fit 64 bits is an error.  With fewer than ``k`` candidates all are returned.  An empty table gives
    an empty result.  Further columns are not read.
    """
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.where(F.col(vec_id).isNotNull() & F.col(vector).isNotNull() & sound)
    rows = rows.select(F.col(vec_id).cast("long").alias("vec_id"), quantized(vector, 256).alias("v"))
    rows = written(rows.select("vec_id", "v", F.size("v").alias("dim"), F.monotonically_increasing_id().alias("row")), "vectors")
    count, asked = rows.agg(F.count("*"), F.count_if(F.col("vec_id") % every == 0)).first()
    shards, blocks = max(1, -(-count // shard_rows)), max(1, -(-asked // block_queries))
    home = F.pmod(F.xxhash64("vec_id", "row"), F.lit(shards)).cast("int")
    points = rows.select("vec_id", "v", "dim", "row", home.alias("shard"))
    again = rows.select(*[F.col(c).alias(c) for c in rows.columns])  # columns of their own: both sides come from one table
    queries = again.where(F.col("vec_id") % every == 0)
    queries = queries.withColumn("block", F.pmod(F.xxhash64("row", "vec_id"), F.lit(blocks)).cast("int"))
    queries = queries.withColumn("home", home)
    schema = "query_id long, query_row long, vec_id long, score long"
    names = ["dim", "shard", "block"]

    def searched(questions: DataFrame, data: DataFrame) -> DataFrame:
        return data.groupBy(*names).cogroup(questions.groupBy(*names)).applyInArrow(_searcher(k), schema)

    alone = F.lit(0).alias("block")
    first = written(
        searched(
            queries.select("vec_id", "v", "dim", "row", F.col("home").alias("shard"), alone, F.lit(None).cast("long").alias("kth")),
            points.select("vec_id", "v", "dim", "row", "shard", alone),
        ),
        "first",
    )
    found = first
    if shards > 1:
        kth = first.groupBy("query_id", "query_row").agg(F.min("score").alias("least"), F.count("*").alias("n"))
        known = queries.join(kth, (F.col("vec_id") == F.col("query_id")) & (F.col("row") == F.col("query_row")), "left")
        others = known.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).where("shard <> home")
        others = others.select("vec_id", "v", "dim", "row", "shard", "block", F.when(F.col("n") >= k, F.col("least")).alias("kth"))
        everywhere = points.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        found = first.unionByName(searched(others, everywhere))
    order = F.row_number().over(
        Window.partitionBy("query_id", "query_row").orderBy(F.col("score").desc(), F.col("vec_id"))
    )
    return found.select("*", order.alias("rank")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
