"""Tables written once for several plans: lookups and steps that later steps read more than once."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_KEPT: list = []
#: Rows of a table that one task makes wide or long rows of, and rows of a file that is kept.
ROWS = 20_000
#: Rows of a table of attributes that one task joins or gathers by product.
SLOTS = 100_000


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a fresh local one only where it is unset in local mode (tests)."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="millrace-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is written there goes when the driver ends."""
    path = f"{shared_dir(spark)}/millrace/{uuid.uuid4().hex}-{name}"
    _KEPT.append((spark, path))
    return path


def kept(df: DataFrame, name: str = "table", **options: str) -> DataFrame:
    """df written once as Parquet to the shared folder and read back. It is not computed again, outlives
    lost executors, and Spark knows its true size: it broadcasts it in joins below its threshold only.
    The folder goes when the driver ends. A task reads whole files, by their compressed size: files of few rows bound the
    rows that it is given. options: the writer's."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.options(**{"maxRecordsPerFile": str(ROWS), **options}).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._millrace_kept = True
    return out


def spread(table: DataFrame, *keys: str, rows: int = ROWS) -> DataFrame:
    """table, as read from files, in parts of so many rows: a file of short rows is a task or two to Spark, whatever is made of each row."""
    n = table.count()  # from the files' footers
    return table.repartition(-(-n // rows), *keys) if n > rows else table


def dealt(table: DataFrame, n: int, *keys: str, rows: int = ROWS) -> DataFrame:
    """table in tasks of so many of n rows, by keys: what a task sorts, joins and gathers is bounded by a number of rows, where tasks
    cut by Spark hold as much as a size or a fixed number of them lets them."""
    parts = -(-n // rows)
    return table.repartition(parts, *keys) if parts > 1 else table


def rowwise(df: DataFrame) -> DataFrame:
    """df, a table of rows for each input row, as the right side of a join: it is never broadcast. Compressed files and
    exploded arrays let Spark take such a table for a small one, and a broadcast passes whole through the driver."""
    return df.hint("merge")


def is_kept(df: DataFrame) -> bool:
    return getattr(df, "_millrace_kept", False)


@atexit.register
def _clean() -> None:
    for spark, path in _KEPT:
        try:
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # noqa: BLE001  the session has ended
            return
