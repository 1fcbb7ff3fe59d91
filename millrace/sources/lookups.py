"""Lookup tables kept as JSON, scans of the first rows, and the slice of a feed that holds no answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.sources.feed import RAW


def read_map(spark: SparkSession, path: str, value: str = "string", lines: bool = False) -> DataFrame:
    """key, value of files with one JSON object each, or with one object to a line. value is the SQL type
    of the values: string, array<string>, map<string,double>, struct<...>. Raises ValueError where there is
    something else."""
    texts = spark.read.text(path, wholetext=not lines).where(F.trim("value") != "")
    maps = texts.select(F.from_json("value", f"map<string,{value}>").alias("m"))
    if not maps.where("m is null").isEmpty():
        raise ValueError(f"not a JSON object: {path}")
    return maps.select(F.explode("m").alias("key", "value"))


def write_map(table: DataFrame, key: str, value: str, path: str) -> None:
    """One object with one entry to a line: parts of any number, read back by read_map(lines=True)."""
    table.select(F.to_json(F.create_map(F.col(key), F.col(value))).alias("value")).write.mode("overwrite").text(path)


def first_rows(rows: DataFrame, order: str, n: int | None) -> DataFrame:
    """The first n rows in order of a unique column; all of them for 0 or None."""
    return rows.orderBy(order).limit(n) if n else rows


def input_slice(rows: DataFrame, *more: str) -> DataFrame:
    """The raw columns alone (and `more`): nothing that a labelled row knows beyond its input."""
    return rows.select(*more, *RAW)


def overlap(mined: DataFrame, labelled: DataFrame, key: str) -> DataFrame:
    """Keys of mined that the labelled table holds too."""
    return mined.select(key).distinct().join(labelled.select(key), key, "left_semi")


def require_disjoint(mined: DataFrame, labelled: DataFrame, key: str) -> DataFrame:
    """mined, unless it shares keys with the labelled table: then ValueError with some of them."""
    both = [r[0] for r in overlap(mined, labelled, key).orderBy(key).limit(5).collect()]
    if both:
        raise ValueError(f"keys of labelled rows: {both}")
    return mined
