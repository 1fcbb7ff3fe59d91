"""What the operators share: tables, the shared staging folder, words and hashes."""

from __future__ import annotations

import io
import os
import uuid
import zipfile
from pathlib import Path

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.sources.staging import kept, shared_dir

#: A word: a run of anything but space, tab, line feed, vertical tab, form feed, carriage return.
WORD = "[^\\x20\\x09-\\x0D]+"
GAP = "[\\x20\\x09-\\x0D]+"


def staged(df: DataFrame, name: str = "table", **options: str) -> DataFrame:
    """kept() with files of any number of rows: the operators' tables have many short ones."""
    return kept(df, name, **{"maxRecordsPerFile": "0", **options})


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a batch between Spark and Python: texts can be long, and a batch is held several times.
BATCH_ROWS = 1000


def _importable(spark: SparkSession) -> None:
    """Sends this package to Python workers that would not find it: those of a driver that runs
    neither in its folder nor with it in PYTHONPATH. Goes through the shared folder."""
    root = Path(__file__).resolve().parents[2]
    context = spark.sparkContext
    if str(root) in os.environ.get("PYTHONPATH", "").split(":") or Path.cwd() == root or getattr(context, "_millrace_sent", False):
        return
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for f in sorted((root / "millrace").rglob("*.py")):
            z.write(f, f.relative_to(root))
    path = f"{shared_dir(spark)}/millrace/{uuid.uuid4().hex}/millrace.zip"
    p = context._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(context._jsc.hadoopConfiguration()).create(p)
    out.write(data.getvalue())
    out.close()
    context.addPyFile(path)
    context._millrace_sent = True


def in_batches(df: DataFrame, run, schema: str) -> DataFrame:
    """mapInArrow in batches of at most BATCH_ROWS rows. Spark has this as a session setting only and
    reads it when the plan runs, so it stays lowered where the session has more."""
    _importable(df.sparkSession)
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= BATCH_ROWS:
        conf.set(key, str(BATCH_ROWS))
    return df.mapInArrow(run, schema)


#: Keys that are dealt over several tasks in join_hot, at most.
HOT_KEYS = 10_000


def join_hot(rows: DataFrame, unique: DataFrame, on: str, counts: DataFrame, how: str = "inner") -> DataFrame:
    """rows joined with unique (one row for each key), a key that holds many rows dealt over many tasks.

    counts is a staged table of keys and the number n of their rows. A key with more than a HOT_KEYS-th
    of all these rows (and more than 200) is hot: at most HOT_KEYS keys are, whatever the table's size,
    so they are broadcast; their rows are salted by a hash of the row, and their row of unique stands
    once for each salt.
    """
    total = F.broadcast(counts.agg(F.sum("n").alias("__total")))  # one row
    bound = F.greatest(F.lit(200), F.expr(f"__total div {HOT_KEYS}"))
    hot = F.broadcast(counts.crossJoin(total).where(F.col("n") > bound).select(on, F.ceil(F.col("n") / bound).cast("int").alias("__salts")))
    salts = F.coalesce("__salts", F.lit(1))
    left = rows.join(hot, on, "left").withColumn("__salt", F.pmod(F.xxhash64(*rows.columns), salts).cast("int")).drop("__salts")
    right = unique.join(hot, on, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("__salts")
    return left.join(right, [on, "__salt"], how).drop("__salt")


def word_count(text: str):
    """Column: number of words of a text column (null: 0), JVM-side."""
    t = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), f"^{GAP}|{GAP}$", "")
    return F.when(t == "", F.lit(0)).otherwise(F.size(F.split(t, GAP))).cast("long")


def texts_of(column) -> list[bytes]:
    """An Arrow string column as UTF-8 bytes, null as empty."""
    import pyarrow as pa

    return [b if b is not None else b"" for b in column.cast(pa.binary()).to_pylist()]


class WordHashes(dict):
    """word -> 64-bit hash; bounded, emptied when full."""

    limit = 400_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def hashes(words: list[bytes], cache: WordHashes) -> np.ndarray:
    return np.fromiter(map(cache.__getitem__, words), dtype=np.uint64, count=len(words))


#: Odd multipliers, one for each place in a shingle.
PLACES = np.array([xxhash.xxh3_64_intdigest(f"place{i}") | 1 for i in range(64)], dtype=np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift-multiply)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k words; needs at least k."""
    n = len(h) - k + 1
    out = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        out += h[j : j + n] * PLACES[j]
    return mix(out + np.uint64(k))


def shingle_set(h: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of all runs of k words; a shorter text is one shingle, an empty one none."""
    if not len(h):
        return h
    return np.unique(grams(h, min(k, len(h))))
