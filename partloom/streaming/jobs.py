"""Structured Streaming forms of the batch job, its progress, telemetry, rate limit and reviews.

Every job reads an unbounded table, keeps its progress in a checkpoint folder and can be stopped and
started at any point.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from partloom.operators.review import DEFAULT_REVIEWER, STATUS_OF

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def read_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def _run(writer, checkpoint: str) -> StreamingQuery:
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def enrich_stream(
    stream: DataFrame, transform: Callable[[DataFrame], DataFrame], out: str, checkpoint: str
) -> StreamingQuery:
    """Run a row-wise transformation over arriving files.

    The file sink records finished batches, so a restart neither repeats nor loses rows; a row that
    cannot be processed comes out as its fallback record instead of stopping the job.
    """
    writer = transform(stream).writeStream.format("parquet").option("path", out).outputMode("append")
    return _run(writer, checkpoint)


def lookup_join_stream(feed: DataFrame, lookups: DataFrame, key: Column, ts: str, within: str) -> DataFrame:
    """``feed`` with the columns of ``lookups`` (``_key``, ``_ts`` and others) of the same key and at most ``within`` apart in time.

    Both are streams.  Whichever side comes first waits for the other in the state store; a row whose lookup has not come when the
    watermark passes goes on without it, and is then dropped from the state.
    """
    left = feed.withColumn("_m", key).withWatermark(ts, within)
    right = lookups.withWatermark("_ts", within)
    span = F.expr(f"INTERVAL {within}")
    near = (F.col("_ts") >= F.col(ts) - span) & (F.col("_ts") <= F.col(ts) + span)
    return left.join(right, (F.col("_m") == F.col("_key")) & near, "leftOuter").drop("_m", "_key", "_ts")


def progress_stream(stream: DataFrame, batch: str, out: str, checkpoint: str) -> StreamingQuery:
    """Live counters per batch; each micro-batch replaces the rows it changed under its own id."""
    counts = stream.groupBy(batch).agg(
        F.count("*").alias("total_items"),
        F.count_if(F.col("status") == "SUCCESS").alias("processed_items"),
        F.count_if(F.col("confidence") >= 0.90).alias("high_confidence_count"),
    )

    def store(rows: DataFrame, batch_id: int) -> None:
        rows.withColumn("epoch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{out}/epoch={batch_id}")

    return _run(counts.writeStream.outputMode("update").foreachBatch(store), checkpoint)


def latest_progress(spark: SparkSession, out: str, batch: str) -> DataFrame:
    """Newest counters per batch from the stored epochs."""
    rows = spark.read.parquet(f"{out}/epoch=*")
    values = [c for c in rows.columns if c not in (batch, "epoch")]
    newest = rows.groupBy(batch).agg(F.max_by(F.struct(*values), "epoch").alias("_r"))
    return newest.select(batch, "_r.*")


def telemetry_windows(
    stream: DataFrame, ts: str, stage: str, value: str, width: str = "1 hour", slide: str | None = None,
    lateness: str = "10 minutes", accuracy: int = 1000,
) -> DataFrame:
    """Latency and failures per stage and time window, tumbling or, with ``slide``, sliding; rows later than the watermark
    are left out.

    ``p50_ms`` and ``p95_ms`` come from a mergeable quantile summary, which is the state of a window however many rows it has; the rank
    of the value is off by at most 1 / ``accuracy`` of the window's rows.
    """
    span = F.window(ts, width, slide) if slide else F.window(ts, width)
    return (
        stream.withWatermark(ts, lateness)
        .groupBy(span, stage)
        .agg(
            F.count("*").alias("records"), F.sum(value).alias("total_ms"), F.max(value).alias("max_ms"),
            F.count_if(F.col("status") == "ERROR").alias("failures"), F.percentile_approx(value, [0.5, 0.95], accuracy).alias("_p"),
        )
        .select(
            F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), stage,
            "records", "total_ms", "max_ms", "failures", F.col("_p")[0].alias("p50_ms"), F.col("_p")[1].alias("p95_ms"),
        )
    )


def windows_to(df: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    return _run(df.writeStream.format("parquet").option("path", out).outputMode("append"), checkpoint)


def deduplicate_stream(stream: DataFrame, key: str, ts: str, lateness: str) -> DataFrame:
    """First arrival of each key within the watermark; state older than that is dropped."""
    return stream.withWatermark(ts, lateness).dropDuplicatesWithinWatermark([key])


# ------------------------------------------------------------------ stateful processors

ADMISSION_SCHEMA = "client bigint, event_id bigint, ts timestamp, admitted boolean, in_window int"


class AdmissionLimiter(StatefulProcessor):
    """Exact sliding log: a request is admitted while fewer than ``limit`` admitted requests lie in
    the trailing window.  State per client is at most ``limit`` timestamps."""

    limit = 120
    seconds = 60

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.log = handle.getListState("log", T.StructType([T.StructField("t", T.LongType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        log = deque(t for (t,) in self.log.get())
        batch = pd.concat(list(rows)).sort_values(["ts", "event_id"], kind="stable")
        admitted, depth = [], []
        # datetime columns may carry any resolution; the log is kept in microseconds
        for t in batch["ts"].astype("datetime64[us]").astype("int64").tolist():
            while log and log[0] < t - self.seconds * 1_000_000:
                log.popleft()
            ok = len(log) < self.limit
            if ok:
                log.append(t)
            admitted.append(ok)
            depth.append(len(log))
        self.log.put([(t,) for t in log])
        yield pd.DataFrame(
            {
                "client": batch["client"].to_numpy(), "event_id": batch["event_id"].to_numpy(),
                "ts": batch["ts"].to_numpy(), "admitted": admitted, "in_window": depth,
            }
        )

    def close(self) -> None:
        pass


class TightLimiter(AdmissionLimiter):
    """The same log with limits that sparse traffic can reach."""

    limit = 2
    seconds = 6 * 3600


def admit(stream: DataFrame, limiter: type[AdmissionLimiter] = AdmissionLimiter) -> DataFrame:
    """Admission decision for every request of (client, event_id, ts)."""
    return stream.groupBy("client").transformWithStateInPandas(
        statefulProcessor=limiter(), outputStructType=ADMISSION_SCHEMA, outputMode="Append",
        timeMode="None",
    )


REVIEW_SCHEMA = (
    "review_id bigint, action_id bigint, ts timestamp, event_type string, status string, "
    "current_value string, reviewer string, sequence bigint"
)


class ReviewState(StatefulProcessor):
    """Review life cycle: every action moves the state on and emits one audit row."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        fields = [T.StructField("value", T.StringType()), T.StructField("n", T.LongType())]
        self.state = handle.getValueState("review", T.StructType(fields))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        value, n = self.state.get() if self.state.exists() else (None, 0)
        batch = pd.concat(list(rows)).sort_values(["ts", "action_id"], kind="stable")
        status = batch["action_type"].map(STATUS_OF)
        values = batch["new_value"].where(batch["action_type"] == "EDIT").astype(object)
        edited = (batch["action_type"] == "EDIT").cumsum()
        # the value of the last edit up to each action, also where that value is null
        by_edit = dict(zip(edited[batch["action_type"] == "EDIT"], values[batch["action_type"] == "EDIT"]))
        current = [by_edit.get(e, value) for e in edited]
        out = pd.DataFrame(
            {
                "review_id": key[0], "action_id": batch["action_id"].to_numpy(), "ts": batch["ts"].to_numpy(),
                "event_type": ("HITL_REVIEW_" + status).to_numpy(), "status": status.to_numpy(), "current_value": current,
                "reviewer": batch["reviewer"].replace("", None).fillna(DEFAULT_REVIEWER).to_numpy(),
                "sequence": range(n + 1, n + len(batch) + 1),
            }
        )
        self.state.update((current[-1], n + len(batch)))
        yield out

    def close(self) -> None:
        pass


def review_stream(actions: DataFrame) -> DataFrame:
    return actions.groupBy("review_id").transformWithStateInPandas(
        statefulProcessor=ReviewState(), outputStructType=REVIEW_SCHEMA, outputMode="Append", timeMode="None"
    )


def state_session(spark: SparkSession) -> SparkSession:
    """A session of its own for stateful jobs on the RocksDB state store, which keeps large state off the heap; the caller's
    settings stay as they are.  Streams for such a job are read in it."""
    own = spark.newSession()
    own.conf.set(STATE_PROVIDER, ROCKSDB)
    for name in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        own.conf.set(name, spark.conf.get(name))
    return own
