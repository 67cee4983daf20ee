"""Running sums over a total order of a whole table, spread over all tasks."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from partloom.operators.common import materialize


def prefix_sums(df: DataFrame, order: Sequence[str], values: dict[str, Column]) -> DataFrame:
    """``df`` with a running sum (long) for each of ``values``, over all rows in ``order``, the row itself included.

    Rows are range-partitioned by ``order``, so a key that leads the order is cut wherever a partition ends, whatever its
    share of the rows.  Each task sums its own sorted rows, the totals of the tasks (one row each) are summed up in
    turn, and the sum of all tasks before is added.  A difference of two running sums counts what lies between, so keys need
    no sums of their own.  ``order`` should tell rows apart: equal ones stay in one task.  A null value counts as 0.
    """
    names = list(values)
    narrow = df.select("*", *[F.coalesce(v.cast("long"), F.lit(0)).alias(f"_v{i}") for i, v in enumerate(values.values())])
    sums = [T.StructField(f"_s{i}", T.LongType()) for i in range(len(names))]
    schema = T.StructType([*df.schema.fields, *sums, T.StructField("_i", T.LongType()), T.StructField("_task", T.IntegerType())])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, so_far, seen = TaskContext.get().partitionId(), [0] * len(names), 0
        for batch in batches:
            out = batch.columns[: -len(names)]
            for i, column in enumerate(batch.columns[-len(names) :]):
                running = np.cumsum(column.to_numpy()) + so_far[i]
                so_far[i] = int(running[-1]) if len(running) else so_far[i]
                out.append(pa.array(running, pa.int64()))
            place = np.arange(seen, seen + batch.num_rows)
            seen += batch.num_rows
            yield pa.RecordBatch.from_arrays([*out, pa.array(place, pa.int64()), pa.array(np.full(batch.num_rows, task, np.int32))], schema.names)

    local = materialize(narrow.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(add, schema), "prefix")
    last = local.groupBy("_task").agg(F.max_by(F.struct(*[f"_s{i}" for i in range(len(names))]), "_i").alias("_total"))
    before = Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)  # one row for each task of the sort
    offsets = last.select("_task", *[F.coalesce(F.sum(f"_total._s{i}").over(before), F.lit(0)).alias(f"_o{i}") for i in range(len(names))])
    both = local.join(offsets, "_task")
    return both.select(*df.columns, *[(F.col(f"_s{i}") + F.col(f"_o{i}")).alias(n) for i, n in enumerate(names)])
