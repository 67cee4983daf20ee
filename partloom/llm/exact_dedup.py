"""Exact deduplication as a stream with disk-backed keyed state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from partloom.llm.storage import free_name, located, written
from partloom.operators.common import work_dir

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def normalized(text: str = "text") -> Column:
    """Runs of ASCII blanks become one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+", " ")


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _state_session(spark: SparkSession) -> SparkSession:
    """A session of its own for the stream, so that the caller's settings stay as they are."""
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    own.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")
    # many small stores: without this each of them reserves megabytes of disk for its logs
    own.conf.set("spark.sql.streaming.stateStore.rocksdb.allowFAllocate", "false")
    # and of memory: a write buffer takes an eighth of its size at once
    own.conf.set("spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB", "8")
    own.conf.set("spark.sql.streaming.stateStore.rocksdb.blockCacheSizeMB", "4")
    own.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    return own


def stream_state(spark: SparkSession, source: str, schema: T.StructType, work: str, files_per_batch: int) -> DataFrame:
    """(digest, first, n): run the stream over the digests in ``source`` and return the state it ends with.

    The state of a digest is its first row (stable identifier and content locator) and its number of rows, kept in
    RocksDB and never expired.  Rows of a batch are combined before the shuffle, so a digest that holds a third
    of the rows sends one row for each task.  A batch replaces its own output when it is repeated, and a run
    that is started again on ``work`` goes on after the last complete batch.
    """
    own = _state_session(spark)
    rows = own.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    state = rows.groupBy("digest").agg(F.min("key").alias("first"), F.count("*").alias("n"))
    changed = f"{work}/changed"

    def put(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{changed}/batch={number}")

    stream = state.writeStream.outputMode("update").option("checkpointLocation", f"{work}/state")
    stream.foreachBatch(put).trigger(availableNow=True).start().awaitTermination()
    kind = T.StructType([T.StructField("digest", T.BinaryType()), T.StructField("first", schema["key"].dataType),
                         T.StructField("n", T.LongType()), T.StructField("batch", T.IntegerType())])
    if not _any_batch(spark, changed):
        return spark.createDataFrame([], kind).drop("batch")
    latest = spark.read.schema(kind).parquet(changed).groupBy("digest").agg(F.max_by(F.struct("first", "n"), "batch").alias("s"))
    return latest.select("digest", "s.*")


def _any_batch(spark: SparkSession, path: str) -> bool:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path)


def find_copies(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", digest: Callable[[Column], Column] = sha256,
    files_per_batch: int = 1000,
) -> DataFrame:
    """One row per document: ``doc_id``, ``keep_id``, ``group_size``, ``kept``, ``digest``, and its ``file`` and ``row``.

    Texts are equal when identical after every run of ASCII blanks has become one space.  Of equal texts the
    row with the least identifier stays.  Digests go through the stream; a digest seen more than once is a hit,
    and the whole normalized texts of its rows, found by their locators, are compared.  Rows of one
    digest with different texts are regrouped by text, so a collision changes nothing.

    A null text counts as empty.  A null identifier comes after all others.  Rows with equal identifiers, repeated
    rows as well, come in the order of file and row; one row of each group is kept.  An empty table gives
    an empty result.  Further columns are not read.
    """
    rows, file, row = located(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")))
    return _find(rows, file, row, digest, files_per_batch)


def _find(rows: DataFrame, file: str, row: str, digest: Callable[[Column], Column], files_per_batch: int) -> DataFrame:
    spark, norm = rows.sparkSession, normalized()
    key = F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", F.col(row).alias("row"), F.col(file).alias("file"))
    source = work_dir(spark, "digests")
    rows.select(digest(norm).alias("digest"), key.alias("key")).write.parquet(source)
    digests = spark.read.parquet(source)
    work = work_dir(spark, "dedup")
    state = written(stream_state(spark, source, digests.schema, work, files_per_batch), "copies")

    hits = state.where("n > 1").select("digest")
    members = digests.join(hits, "digest").select("digest", "key", F.col("key.row").alias("r"), F.col("key.file").alias("f"))
    found = rows.join(members, (F.col(row) == F.col("r")) & (F.col(file) == F.col("f")))
    by_text = found.select("digest", "key", norm.alias("norm"))
    classes = by_text.groupBy("digest", "norm").agg(F.min("key").alias("first"), F.count("*").alias("n"))
    checked = written(classes.select("digest", F.sha2("norm", 512).alias("check"), "first", "n"), "checked")
    mixed = checked.groupBy("digest").agg(F.count("*").alias("texts")).where("texts > 1").select("digest")
    assigned = digests.join(state, "digest")
    if mixed.limit(1).count():
        mixed = written(mixed, "mixed")
        own = by_text.join(mixed, "digest").join(
            classes.withColumnsRenamed({"digest": "d", "norm": "m"}), (F.col("norm") == F.col("m")) & (F.col("digest") == F.col("d"))
        )
        assigned = assigned.join(mixed, "digest", "left_anti").unionByName(own.select(*assigned.columns))
    first, key = F.col("first"), F.col("key")
    return assigned.select(
        key["doc_id"].alias("doc_id"), first["doc_id"].alias("keep_id"), F.col("n").alias("group_size"),
        (first == key).alias("kept"), "digest", key["file"].alias("file"), key["row"].alias("row"),
    )


def drop_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", files_per_batch: int = 1000) -> DataFrame:
    """``docs`` with one row of each group of equal texts: that with the least identifier.  Edge cases as above."""
    rows, file, row = located(docs)
    narrow = rows.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), file, row)
    f, r = free_name(rows, "_f"), free_name(rows, "_r")
    kept = _find(narrow, file, row, sha256, files_per_batch).where("kept").select(F.col("file").alias(f), F.col("row").alias(r))
    out = rows.join(kept, (F.col(row) == F.col(r)) & (F.col(file) == F.col(f)), "left_semi")
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
