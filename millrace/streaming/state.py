"""Keyed state over streams of files: windows of events and counters of jobs. What comes twice counts once, what comes
after its watermark counts not at all, and a stream that stops goes on from its checkpoint."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: How late an event may come, and the type of the event that closes a feed's windows.
LATE, SIZE, END = "10 minutes", "1 hour", "end of feed"
#: State lies on the executors' disks behind a cache of a fixed size; by default all ids of a batch lie in memory. Counting its rows
#: costs a read for each write; a store that is not closed after its batch keeps its memory and files until the executor looks for idle ones.
ON_DISK = {"providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "rocksdb.boundedMemoryUsage": "true", "rocksdb.trackTotalNumberOfRows": "false", "unloadOnCommit": "true"}


def _files(spark: SparkSession, source: str, schema: StructType) -> DataFrame:
    """All files that have come since the last run, as one batch. Files that are written together are in no order of
    time, so a batch of one of them would move the watermark past the rows of the next."""
    return spark.readStream.schema(schema).parquet(source)


@contextmanager
def _state_on_disk(spark: SparkSession) -> Iterator[None]:
    """Streams that start within keep their state on disk; the session's settings are as before afterwards. A stream that began
    with another store goes on with it."""
    keys = {f"spark.sql.streaming.stateStore.{k}": v for k, v in ON_DISK.items()}
    before = {k: spark.conf.get(k, None) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def event_windows(events: DataFrame, late: str = LATE, size: str = SIZE) -> DataFrame:
    """start, event_type, n, total: counts and sums of a stream of events (event_id, ts, event_type, value) by time window
    and type. State: the ids and the windows that the watermark has not passed."""
    once = events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
    w = once.groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return w.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def run_windows(spark: SparkSession, source: str, schema: StructType, out: str, checkpoint: str) -> None:
    """Reads the files that have come since the last run and appends the windows that are closed by then."""
    windows = event_windows(_files(spark, source, schema))
    with _state_on_disk(spark):
        windows.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def close_windows(events: DataFrame, source: str) -> None:
    """Ends a feed: one event two days behind its last, so that the watermark passes every window."""
    end = events.agg((F.max("ts") + F.expr("interval 2 days")).alias("ts")).where("ts is not null")
    blank = [F.lit(END if f.name == "event_type" else None).cast(f.dataType).alias(f.name) if f.name != "ts" else F.col("ts") for f in events.schema.fields]
    end.select(*blank).write.mode("append").parquet(source)


def run_counters(spark: SparkSession, source: str, schema: StructType, out: str, checkpoint: str, late: str = LATE) -> None:
    """Counts finished rows (job_id, seq, failed, at) for each job in keyed state, a row once however often it comes
    within the watermark. After each batch the jobs that it touched are written under the batch's number, which a
    batch that is run again replaces."""
    rows = _files(spark, source, schema).withWatermark("at", late).dropDuplicatesWithinWatermark(["job_id", "seq"])
    counts = rows.groupBy("job_id").agg(F.count("*").alias("processed"), F.count_if("failed").alias("failed"), F.max("at").alias("last_at"))

    def write(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={n}")

    with _state_on_disk(spark):
        counts.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def counters(spark: SparkSession, out: str) -> DataFrame:
    """job_id, processed, failed, last_at of each job: what the last batch that touched it says."""
    rows = spark.read.option("basePath", out).parquet(f"{out}/batch=*")
    return rows.groupBy("job_id").agg(F.max_by(F.struct("processed", "failed", "last_at"), "batch").alias("c")).select("job_id", "c.*")
