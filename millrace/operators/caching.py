"""Read-through result cache: keys by content, hits by join, an external call for misses only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.sources.staging import is_kept, kept, rowwise

#: The hash is first, as sorts compare the first column's leading bytes, and namespaces and models are few.
KEY = ["prompt_hash", "namespace", "model"]


def prompt_hash(model: Column, system: Column, user: Column, temperature: str) -> Column:
    return F.sha2(F.concat(model, F.lit("|"), system, F.lit("\x00"), user, F.lit("\x00"), F.lit(temperature)), 256)


def latest(cache: DataFrame, order: str = "seq") -> DataFrame:
    """One row for each key, the last written: what insert-or-replace leaves."""
    w = Window.partitionBy(*KEY).orderBy(F.desc(order))
    return cache.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def stored(requests: DataFrame) -> DataFrame:
    """requests, prompts and all, written once."""
    return requests if is_kept(requests) else kept(requests, "requests", compression="zstd")


def read_through(requests: DataFrame, cache: DataFrame, call: Callable[[DataFrame], DataFrame], legacy: str | None = None) -> tuple[DataFrame, DataFrame]:
    """requests, without their prompts, with response and hit, and the rows to append to the cache.

    call gets the distinct missing keys with their prompts and adds response; it runs once for each
    key. legacy names a column with an older key that is tried before calling. Requests are written once, and so
    is what the cache holds for them; prompts are long, so only those of missing keys leave their rows.
    """
    requests = stored(requests)
    out = requests.drop("prompt")
    if legacy:
        old = latest(cache).select("namespace", F.col("prompt_hash").alias(legacy), "model", F.col("response").alias("__old"))
        out = out.join(old, [legacy, "namespace", "model"], "left")
    else:
        out = out.withColumn("__old", F.lit(None).cast("string"))
    known = latest(cache).select(*KEY, F.col("response").alias("__new"))
    columns = [c for c in requests.columns if c != "prompt"]
    out = kept(out.join(known, KEY, "left").select(*columns, F.coalesce("__new", "__old").alias("__hit")), "hits")
    missing = out.where("__hit is null").select(*KEY).distinct()
    called = call(requests.select(*KEY, "prompt").join(rowwise(missing), KEY, "left_semi").dropDuplicates(KEY))
    fresh = called.select(*KEY, F.col("response").alias("__called"))
    answered = out.join(fresh, KEY, "left").select(*columns, F.coalesce("__hit", "__called").alias("response"), F.col("__hit").isNotNull().alias("hit"))
    return answered, called.where("response is not null").select(*KEY, "response")


def by_substring(cache: DataFrame, part: str) -> DataFrame:
    """Entries whose key holds a text."""
    return latest(cache).where(F.col("prompt_hash").contains(part))


def stats(cache: DataFrame, answered: DataFrame) -> DataFrame:
    """namespace, entries, hits, misses."""
    a = latest(cache).groupBy("namespace").agg(F.count("*").alias("entries"))
    b = answered.groupBy("namespace").agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return a.join(b, "namespace", "full").select("namespace", zero("entries"), zero("hits"), zero("misses"))


def parsed(completion: Column) -> Column:
    """A completion's JSON object as a map of strings; empty where it is none."""
    return F.coalesce(F.from_json(completion, "map<string,string>"), F.expr("cast(map() as map<string,string>)"))



def quota_exhausted(message: Column) -> Column:
    return message.contains("per day") | message.contains("TPD")
