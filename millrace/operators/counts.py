"""Mining as counts that add up: labelled rows are counted once, stored by batch, and every lookup is made of the sums.

A count is a row (kind, a, b, c, n, first): how often a combination of up to three values stands in the
labelled rows, and the smallest seq with it. One pass over the rows gives all kinds, summed before they are
shuffled. Counts of batches add up, so new labelled rows cost a pass over themselves alone, and a batch that is
stored again replaces its own counts."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions import text as X

from . import mining

KEY = ["kind", "a", "b", "c"]


def _entry(kind: str, *values: Column, where: Column | None = None) -> Column:
    """A count's key, null where it does not apply."""
    cells = [*values, *[F.lit(None)] * (3 - len(values))]
    key = F.struct(F.lit(kind).alias("kind"), *[c.cast("string").alias(n) for c, n in zip(cells, "abc")])
    return key if where is None else F.when(where, key)


def counted(rows: DataFrame, attributes: DataFrame) -> DataFrame:
    """kind, a, b, c, n, first. rows: seq, Mfg_Part_Num, Part_Desc, Part_Manuf and brand cells, brand, classpath,
    manufacturer, mfr_url; attributes: seq, classpath, slot, label, value, uom."""
    full = lambda *c: reduce(and_, [F.coalesce(F.col(x).cast("string"), F.lit("")) != "" for x in c])
    r = mining.trimmed(rows).withColumn("domain", mining.url_domain(F.col("mfr_url")))
    col = F.col
    at = F.instr(F.lower("mfr_url"), F.lower("Mfg_Part_Num"))
    made = F.concat(F.substring(col("mfr_url"), F.lit(1), at - 1), F.lit("{mpn}"), F.substring(col("mfr_url"), at + F.length("Mfg_Part_Num"), F.length("mfr_url")))
    numbered = full("mfr_url", "Mfg_Part_Num")
    worded = full("classpath", "Part_Desc")
    one = [
        _entry("raw", col("Part_Manuf"), col("manufacturer"), where=full("Part_Manuf", "manufacturer")), _entry("source", col("Part_Manuf"), where=full("Part_Manuf")),
        _entry("url", col("domain"), made, where=numbered & (at > 0)), _entry("urls", col("domain"), where=numbered), _entry("domain", col("manufacturer"), col("domain"), where=full("domain")),
        _entry("host", col("domain"), where=full("mfr_url")), _entry("odd", col("domain"), col("Mfg_Part_Num"), where=full("mfr_url") & (at == 0)),
        _entry("brand", col("brand"), col("manufacturer"), where=full("brand", "manufacturer")), _entry("class", col("classpath"), where=worded),
        _entry("prior", col("manufacturer"), col("classpath"), where=full("manufacturer", "classpath")), _entry("empty", col("classpath"), F.when(full("brand"), "filled").otherwise("empty")),
    ]
    many = F.when(worded, F.transform(X.tokens(col("Part_Desc")), lambda t: _entry("token", col("classpath"), t)))
    cells = F.transform(F.array(*[X.strip(F.coalesce(col(c), F.lit(""))) for c in mining.BRAND_CELLS]), lambda b: _entry("cell", X.strip(col("Part_Manuf")), b, where=full("Part_Manuf") & (b != "") & ~F.lower(b).isin(mining.NO_BRAND)))
    none = F.array().cast("array<struct<kind:string,a:string,b:string,c:string>>")
    of_rows = r.select("seq", F.explode(F.concat(F.array(*one), F.coalesce(many, none), cells)).alias("k"))
    slots = [_entry("label", col("classpath"), col("slot"), col("label"), where=col("label").isNotNull()), _entry("uom", col("classpath"), col("slot"), col("uom"), where=full("uom")), _entry("value", col("classpath"), col("label"), col("value"), where=full("classpath", "label", "value"))]
    of_slots = attributes.select("seq", F.explode(F.array(*slots)).alias("k"))
    return of_rows.unionByName(of_slots).where("k is not null").select("seq", "k.*").groupBy(*KEY).agg(F.count("*").alias("n"), F.min("seq").alias("first"))


def summed(counts: DataFrame) -> DataFrame:
    return counts.groupBy(*KEY).agg(F.sum("n").alias("n"), F.min("first").alias("first"))


class Store:
    """Counts of batches of labelled rows, a partition each."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def add(self, batch: str, counts: DataFrame) -> None:
        counts.withColumn("batch", F.lit(batch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(self.path)

    def counts(self) -> DataFrame:
        return summed(self.spark.read.parquet(self.path))


def _top(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """Each group's most frequent value, the one seen first among equals."""
    w = Window.partitionBy(*by).orderBy(F.desc("n"), "first", value)
    return rows.withColumn("__rank", F.row_number().over(w)).where("__rank = 1").drop("__rank", "first")


def lookups(counts: DataFrame, top: int = 15, least: int = 2, share: float = 0.8) -> dict[str, DataFrame]:
    """All mined tables, as the functions of operators.mining make them from the rows themselves. counts: a staged table."""

    def kind(k: str, *names: str) -> DataFrame:
        return counts.where(F.col("kind") == k).select(*[F.col(x).alias(n) for x, n in zip("abc", names)], "n", "first")

    labels = kind("label", "classpath", "slot", "label").withColumn("slot", F.col("slot").cast("int"))
    hints = _top(kind("uom", "classpath", "slot", "uom_hint").withColumn("slot", F.col("slot").cast("int")), ["classpath", "slot"], "uom_hint").drop("n")
    named = labels.where("label <> ''").groupBy("classpath", "slot").agg(F.min_by("label", "first").alias("label"))
    urls = _top(kind("url", "domain", "template"), ["domain"], "template").withColumnRenamed("n", "confirmed_on").join(kind("urls", "domain").select("domain", F.col("n").alias("of_total")), "domain")
    token = kind("token", "classpath", "token")
    df = token.groupBy("token").agg(F.sum("n").alias("df"))
    classes = kind("class", "classpath").agg(F.count("*").alias("classes"))
    weighed = token.join(df, "token").crossJoin(F.broadcast(classes)).withColumn("weight", F.round(F.col("n") * (F.col("classes") / F.col("df")), 4))  # classes: one row
    rank = F.row_number().over(Window.partitionBy("classpath").orderBy(F.desc("weight"), "token"))
    rates = kind("empty", "classpath", "b").groupBy("classpath").agg(F.sum("n").alias("total"), F.coalesce(F.sum(F.when(F.col("b") == "empty", F.col("n"))), F.lit(0)).alias("empty"))
    return {
        "templates": named.join(hints, ["classpath", "slot"], "left").select("classpath", "slot", "label", F.coalesce("uom_hint", F.lit("")).alias("uom_hint")),
        "raw_manufacturers": kind("raw", "raw", "m").groupBy("raw").agg(F.array_sort(F.collect_set("m")).alias("names")),
        "url_patterns": urls.where((F.col("confirmed_on") >= least) & (F.col("confirmed_on") >= share * F.col("of_total"))),
        "domains": _top(kind("domain", "manufacturer", "domain"), ["manufacturer"], "domain").drop("n"),
        "keywords": weighed.withColumn("rank", rank).where(F.col("rank") <= top).select("classpath", "token", "weight"),
        "class_prior": kind("prior", "manufacturer", "classpath").drop("first"),
        "allowed_values": mining.allowed_values(kind("value", "classpath", "label", "value")),
        "brand_pairs": _top(kind("brand", "brand", "manufacturer"), ["brand"], "manufacturer").drop("n"),
        "empty_rates": rates,
        "tainted_sources": kind("cell", "source", "brand").groupBy("source").agg(F.countDistinct("brand").alias("brands")).where("brands > 1"),
        "slot_conflicts": labels.groupBy("classpath", "slot").agg(F.countDistinct("label").alias("labels")).where("labels > 1"),
        "shape_mismatches": kind("odd", "domain", "odd").select("domain", "odd").join(kind("host", "domain").select("domain", F.col("n").alias("rows")), "domain"),
        "self_names": kind("source", "raw").select("raw", X.code_suffix_removed(F.col("raw")).alias("manufacturer"), F.col("n").alias("affected")),
    }
