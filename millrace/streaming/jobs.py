"""Incremental jobs: files of a feed arrive, rows are enriched batch by batch, progress is counted."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from millrace.operators import faults
from millrace.sources.staging import kept


def run_job(spark: SparkSession, source: str, schema: StructType, enrich: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, fmt: str = "parquet", files: int = 1) -> None:
    """Reads what is in source and not yet done, enriches each batch and writes it under its batch
    number, so a batch that is run again replaces its own rows."""

    def write(batch: DataFrame, n: int) -> None:
        enrich(batch).write.mode("overwrite").parquet(f"{out}/batch={n}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).format(fmt).load(source)
    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def progress(spark: SparkSession, out: str, total: int) -> DataFrame:
    """batch, processed (up to and with it), status."""
    from pyspark.sql import Window

    done = spark.read.option("basePath", out).parquet(f"{out}/batch=*").groupBy("batch").agg(F.count("*").alias("rows"))
    done = done.withColumn("processed", F.sum("rows").over(Window.orderBy("batch")))
    return done.select("batch", "rows", "processed", F.when(F.col("processed") >= total, "DONE").otherwise("RUNNING").alias("status"))


def safe(enrich: Callable[[DataFrame], DataFrame], key: str = "seq") -> Callable[[DataFrame], DataFrame]:
    """enrich with its faults kept to the rows that cause them. A batch is enriched as a whole; where that
    raises, its halves (by a hash of the key) are, and theirs, until a row that raises is alone: it comes
    through with row_error "Type: message", confidence 0 and band LOW. Rows that share a key stand together. A batch
    with few bad rows costs a few smaller batches for each of them: what operators.faults finds in one pass
    should not get here."""

    def told(e: Exception) -> str:
        kind = re.search(r"(\w+(?:Error|Exception)): (.*?)(?: SQLSTATE: \w+)?(?:\n|$)", str(e))
        return (f"{kind[1]}: {kind[2]}" if kind else f"{type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}")[:500]

    def parts(batch: DataFrame, level: int) -> tuple[list[DataFrame], list[DataFrame]]:
        if level and batch.isEmpty():
            return [], []
        try:
            return [kept(enrich(batch).withColumn("row_error", F.lit(None).cast("string")), "enriched")], []
        except Exception as e:  # noqa: BLE001  whatever a row's data do
            if level >= 62 or batch.agg(F.min(F.xxhash64(key)) == F.max(F.xxhash64(key))).first()[0] is not False:
                return [], [kept(faults.error_rows(batch.withColumn("row_error", F.lit(told(e)))), "failed")]
        out: tuple[list[DataFrame], list[DataFrame]] = ([], [])
        for bit in (0, 1):
            half = parts(batch.where(F.shiftright(F.xxhash64(key), level).bitwiseAND(F.lit(1)) == bit), level + 1)
            out[0].extend(half[0])
            out[1].extend(half[1])
        return out

    def run(batch: DataFrame) -> DataFrame:
        good, bad = parts(kept(batch, "batch"), 0)
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), good + bad)

    return run

