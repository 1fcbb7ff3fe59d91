"""Wide delivery rows, tolerant parsing of stored products, sinks and comparison of exports."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.sources.feed import RAW
from millrace.sources.staging import kept, rowwise

#: Repeated groups of the delivery format: counts are fixed values.
FEATURES, SLOTS = 20, 50
TEXTS = ["MOBILE_DESC", "INVOICE_DESC", "SHORT_DESC", "LONG_DESC1", "RETAIL_DESC", "MARKETING_DESCRIPTION"]


def delivery_columns() -> list[str]:
    """The columns that are ever filled, in delivery order, from the format's rule."""
    ids = ["MFR URL", *[f"Ref URL {i}" for i in range(1, 6)], *RAW, "MANUFACTURER_NAME", "BRAND_NAME", "MANUFACTURER_PART_NUMBER", "Classpath"]
    slots = [f"ATTRIBUTE_{kind} {i}" for i in range(1, SLOTS + 1) for kind in ("LABEL", "VALUE", "UOM")]
    return [*ids, *TEXTS, *[f"ITEM_FEATURES_{i}" for i in range(1, FEATURES + 1)], *slots]


def template_columns(spark, path: str) -> list[str]:
    """The header of a delivery template; RuntimeError where it is missing."""
    try:
        return spark.read.option("header", True).option("encoding", "UTF-8").csv(path).columns
    except Exception as e:
        raise RuntimeError(f"delivery template not readable: {path}") from e


def delivery(products: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One string column for each of columns, empty where nothing is known: a projection without shuffle.

    products: seq, raw (map of the raw cells as read), Mfg_Part_Num, Part_Desc, Part_Manuf (cleaned),
    manufacturer_name, brand, classpath, mfr_url, ref_urls, the texts, features (array), slots (map
    of slot to struct label, value, uom).
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    raw = lambda c: F.coalesce(F.try_element_at("raw", F.lit(c)), F.lit(""))
    at = lambda c, i: F.coalesce(F.try_element_at(c, F.lit(i)), F.lit(""))
    out: dict[str, Column] = {
        "MFR URL": text("mfr_url"), "MANUFACTURER_NAME": text("manufacturer_name"), "BRAND_NAME": text("brand"),
        "MANUFACTURER_PART_NUMBER": text("Mfg_Part_Num"), "Classpath": text("classpath"), **{t: text(t) for t in TEXTS},
    }
    out |= {c: F.coalesce(F.nullif(F.col(c), F.lit("")), raw(c)) for c in ("Mfg_Part_Num", "Part_Desc", "Part_Manuf")}
    out |= {c: raw(c) for c in ("E1_Brand", "Unilog_Brand", "DIB_Brand")}
    out |= {f"Ref URL {i}": at("ref_urls", i) for i in range(1, 6)}
    out |= {f"ITEM_FEATURES_{i}": at("features", i) for i in range(1, FEATURES + 1)}
    for i in range(1, SLOTS + 1):
        s = F.try_element_at("slots", F.lit(i))
        out |= {f"ATTRIBUTE_{k.upper()} {i}": F.coalesce(s[k], F.lit("")) for k in ("label", "value", "uom")}
    return products.select("seq", *[out.get(c, F.lit("")).alias(c) for c in columns or delivery_columns()])


def slot_maps(attributes: DataFrame) -> DataFrame:
    """seq, slots: map of slot to (label, value, uom) of the slots that the format has."""
    one = attributes.where(f"slot between 1 and {SLOTS}").groupBy("seq", "slot").agg(F.max(F.struct("label", "value", "uom")).alias("s"))
    return one.groupBy("seq").agg(F.map_from_entries(F.collect_list(F.struct(F.col("slot").alias("key"), F.col("s").alias("value")))).alias("slots"))


def with_stubs(delivered: DataFrame, inputs: DataFrame) -> DataFrame:
    """delivered and, for inputs (seq, raw) that are missing from it, rows with the raw cells only."""
    missing = inputs.join(rowwise(delivered.select("seq")), "seq", "left_anti")
    blank = [F.coalesce(F.try_element_at("raw", F.lit(c)), F.lit("")).alias(c) if c in RAW else F.lit("").alias(c) for c in delivered.columns if c != "seq"]
    return delivered.unionByName(missing.select("seq", *blank))


def write_csv(delivered: DataFrame, path: str, order: str = "seq") -> None:
    """Parts in input order, CRLF, minimal quoting, empty cells empty, white space around cells as it is."""
    rows = delivered.repartitionByRange(order).sortWithinPartitions(order).drop(order)
    rows.write.mode("overwrite").options(header=True, lineSep="\r\n", emptyValue="", escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)


def occurrences(rows: DataFrame, key: str, order: str) -> DataFrame:
    """rows with nth: the how manieth row of its key it is."""
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy(key).orderBy(order)))


def matched(left: DataFrame, right: DataFrame, key: str, order: str) -> DataFrame:
    """The nth row of a key on the left with the nth on the right; right columns behind `r_`."""
    r = occurrences(right, key, order)
    r = r.select(F.col(key).alias(f"r_{key}"), F.col("nth").alias("r_nth"), *[F.col(c).alias(f"r_{c}") for c in right.columns if c != key])
    on = (F.col(key) == F.col(f"r_{key}")) & (F.col("nth") == F.col("r_nth"))
    return occurrences(left, key, order).join(rowwise(r), on, "left").drop(f"r_{key}", "r_nth")


def last_by_key(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row for each non-empty key: the last."""
    rest = [c for c in rows.columns if c != key]
    return rows.where(F.coalesce(F.col(key), F.lit("")) != "").groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("r")).select(key, *[f"r.{c}" for c in rest])


#: Ranges of keys that exports are compared by, and ranges that share a branch of the tree.
LEAVES, BRANCH = 1 << 16, 1 << 8


def leaf(key: str, leaves: int = LEAVES) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(leaves)).cast("int")


def digests(rows: DataFrame, key: str, leaves: int = LEAVES) -> DataFrame:
    """leaf, n, a, b: of each range of keys (by hash) its rows and two sums of hashes of whole rows, added up before the shuffle."""
    whole = [F.col(f"`{c}`") for c in sorted(rows.columns)]
    total = lambda salt: F.sum(F.xxhash64(F.lit(salt), *whole).cast("decimal(20,0)"))
    return rows.groupBy(leaf(key, leaves).alias("leaf")).agg(F.count("*").alias("n"), total("a").alias("a"), total("b").alias("b"))


def differing(old: DataFrame, new: DataFrame, key: str, leaves: int = LEAVES) -> DataFrame:
    """leaf: ranges of keys whose rows are not the same in two exports. A tree of two levels: branches meet first, then
    the leaves of those that differ. Digests alone are shuffled, at most as many as there are leaves."""
    a, b = (kept(digests(rows, key, leaves), "digests") for rows in (old, new))
    branch = F.expr(f"leaf div {BRANCH}").alias("branch")
    up = lambda d: d.groupBy(branch).agg(*[F.sum(c).alias(c) for c in ("n", "a", "b")])
    same = reduce(and_, [F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")) for c in ("n", "a", "b")])

    def unlike(x: DataFrame, y: DataFrame, on: str) -> DataFrame:
        return x.alias("x").join(y.alias("y"), on, "full").where(~same).select(on)

    branches = F.broadcast(unlike(up(a), up(b), "branch"))  # LEAVES / BRANCH rows at most
    inner = lambda d: d.withColumn("branch", branch).join(branches, "branch", "left_semi").drop("branch")
    return unlike(inner(a), inner(b), "leaf")


def differences(old: DataFrame, new: DataFrame, key: str, order: str, leaves: int = LEAVES) -> DataFrame:
    """key, nth, column, old, new: cells that are not the same in two exports; rows of one side only have nulls.
    Digests of key ranges meet first, then whole rows of the ranges that differ; only rows that differ are laid
    out cell by cell. Equal exports shuffle digests only."""
    unlike = kept(differing(old, new, key, leaves), "unlike")  # leaves rows at most
    narrowed = lambda rows: rows.withColumn("__leaf", leaf(key, leaves)).join(F.broadcast(unlike.withColumnRenamed("leaf", "__leaf")), "__leaf", "left_semi").drop("__leaf")
    old, new = narrowed(old), narrowed(new)
    columns = [c for c in old.columns if c not in (key, order)]
    side = lambda rows, name: occurrences(rows, key, order).select(key, "nth", F.struct(*columns).alias(name))
    both = side(old, "a").join(rowwise(side(new, "b")), [key, "nth"], "full").where(~F.col("a").eqNullSafe(F.col("b")))
    cell = lambda c: F.struct(F.lit(c).alias("column"), F.col(f"a.`{c}`").alias("old"), F.col(f"b.`{c}`").alias("new"))
    one_side = F.col("a").isNull() | F.col("b").isNull()
    laid = both.select(key, "nth", one_side.alias("alone"), F.explode(F.array(*[cell(c) for c in columns])).alias("c"))
    return laid.select(key, "nth", "c.column", "c.old", "c.new", "alone").where(~F.col("old").eqNullSafe(F.col("new")) | F.col("alone")).drop("alone")


def key_differences(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """key, side: keys that stand in one of two exports only."""
    a, b = (rows.select(key).distinct() for rows in (old, new))
    return a.exceptAll(b).withColumn("side", F.lit("old")).unionByName(b.exceptAll(a).withColumn("side", F.lit("new")))


def unpivot_wide(rows: DataFrame, key: str = "seq") -> DataFrame:
    """key, slot, label, value, uom from the repeated columns of delivery rows, trimmed; only slots with a label and a value."""
    have = set(rows.columns)
    cell = lambda kind, i: F.trim(F.coalesce(F.col(f"`ATTRIBUTE_{kind} {i}`"), F.lit(""))).alias(kind.lower()) if f"ATTRIBUTE_{kind} {i}" in have else F.lit("").alias(kind.lower())
    slots = [F.struct(F.lit(i).alias("slot"), *[cell(k, i) for k in ("LABEL", "VALUE", "UOM")]) for i in range(1, SLOTS + 1) if f"ATTRIBUTE_LABEL {i}" in have]
    return rows.select(key, F.explode(F.array(*slots)).alias("s")).select(key, "s.*").where("label <> '' and value <> ''")
