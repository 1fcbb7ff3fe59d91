"""Lookup tables mined from labelled rows by grouping. Ties are settled by the smallest seq, then by value."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import text as X
from millrace.sources.staging import kept

#: Abbreviations in attribute values and what they stand for: fixed values.
SYNONYMS = {
    "med": "Medium", "med base": "Medium", "cand": "Candelabra", "cand base": "Candelabra", "int": "Intermediate", "int base": "Intermediate",
    "std": "Standard", "std base": "Standard", "mog": "Mogul", "mog base": "Mogul", "gu24": "GU24", "gu10": "GU10", "e26": "E26", "e27": "E27",
    "e12": "E12", "e17": "E17", "led": "LED", "cfl": "CFL", "hal": "Halogen", "halogen": "Halogen", "inc": "Incandescent",
    "incandescent": "Incandescent", "ss": "Stainless Steel", "stain": "Stainless Steel", "stainless": "Stainless Steel", "brass": "Brass",
    "brs": "Brass", "plastic": "Plastic", "plst": "Plastic", "alum": "Aluminum", "aluminum": "Aluminum", "wht": "White", "blk": "Black",
    "blkfinish": "Black", "brz": "Bronze", "chr": "Chrome", "nickel": "Nickel", "nat": "Natural", "oilrubbedbronze": "Oil Rubbed Bronze",
}


def most_frequent(rows: DataFrame, by: list[str], value: str, order: str = "seq") -> DataFrame:
    """by, value, n: each group's most frequent non-empty value, the one seen first among equals."""
    counts = rows.where(F.col(value).isNotNull() & (F.col(value) != "")).groupBy(*by, value).agg(F.count("*").alias("n"), F.min(order).alias("__first"))
    w = Window.partitionBy(*by).orderBy(F.desc("n"), "__first", value)
    return counts.withColumn("__rank", F.row_number().over(w)).where("__rank = 1").select(*by, value, "n")


def templates(attributes: DataFrame) -> DataFrame:
    """classpath, slot, label (seen first), uom_hint (most frequent, empty if none)."""
    label = attributes.where("label <> ''").groupBy("classpath", "slot", "label").agg(F.min("seq").alias("seq"))  # numbers add up without a sort of all rows
    label = label.groupBy("classpath", "slot").agg(F.min_by("label", "seq").alias("label"))
    hint = most_frequent(attributes, ["classpath", "slot"], "uom").select("classpath", "slot", F.col("uom").alias("uom_hint"))
    return label.join(hint, ["classpath", "slot"], "left").select("classpath", "slot", "label", F.coalesce("uom_hint", F.lit("")).alias("uom_hint"))


def raw_manufacturers(rows: DataFrame) -> DataFrame:
    """raw, names (sorted distinct manufacturers): one name is a mapping, more are candidates."""
    named = rows.where("Part_Manuf <> '' and manufacturer <> ''")
    return named.groupBy(F.col("Part_Manuf").alias("raw")).agg(F.array_sort(F.collect_set("manufacturer")).alias("names"))


def url_domain(url):
    host = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)
    return F.replace(host, F.lit("www."), F.lit(""))


def trimmed(rows: DataFrame) -> DataFrame:
    """rows with their part number and URL without white space around."""
    return rows.withColumns({c: X.strip(F.col(c)) for c in ("mfr_url", "Mfg_Part_Num")})


def url_patterns(rows: DataFrame, least: int = 2, share: float = 0.8) -> DataFrame:
    """domain, template, confirmed_on, of_total: the most frequent URL template of a domain, with the
    part number's first occurrence replaced, where it holds for enough of the domain's rows."""
    r = trimmed(rows).where("mfr_url <> '' and Mfg_Part_Num <> ''").withColumn("domain", url_domain(F.col("mfr_url")))
    at = F.instr(F.lower("mfr_url"), F.lower("Mfg_Part_Num"))
    made = F.concat(F.substring(F.col("mfr_url"), F.lit(1), at - 1), F.lit("{mpn}"), F.substring(F.col("mfr_url"), at + F.length("Mfg_Part_Num"), F.length("mfr_url")))
    r = r.withColumn("template", F.when(at > 0, made))
    total = r.groupBy("domain").agg(F.count("*").alias("of_total"))
    best = most_frequent(r, ["domain"], "template").withColumnRenamed("n", "confirmed_on")
    return best.join(total, "domain").where((F.col("confirmed_on") >= least) & (F.col("confirmed_on") >= share * F.col("of_total")))


def shape_mismatches(rows: DataFrame) -> DataFrame:
    """domain, rows, odd: each part number whose URL does not hold it, a row each, with the domain's rows."""
    r = trimmed(rows).where("mfr_url <> ''").withColumn("domain", url_domain(F.col("mfr_url")))
    odd = r.where(F.instr(F.lower("mfr_url"), F.lower("Mfg_Part_Num")) == 0).select("domain", F.col("Mfg_Part_Num").alias("odd")).distinct()
    return odd.join(r.groupBy("domain").agg(F.count("*").alias("rows")), "domain")


def manual_patterns(rows: DataFrame, manual: DataFrame) -> DataFrame:
    """manual (domain, template, mpn_transform, shape: what a part number must look like) with the domain's
    rows as confirmed_on and of_total, and mismatches: its rows of another shape."""
    r = trimmed(rows).where("mfr_url <> ''").select(url_domain(F.col("mfr_url")).alias("domain"), "Mfg_Part_Num")
    r = r.join(manual.select("domain", "shape"), "domain")
    counts = r.groupBy("domain").agg(F.count("*").alias("n"), F.count_if(~F.expr("Mfg_Part_Num rlike shape")).alias("bad"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    out = manual.join(counts, "domain", "left")
    return out.select("domain", "template", "mpn_transform", zero("n").alias("confirmed_on"), zero("n").alias("of_total"), zero("bad").alias("mismatches"), F.lit(True).alias("manual"))


def merged_patterns(mined: DataFrame, manual: DataFrame) -> DataFrame:
    """domain, template, confirmed_on, of_total, mpn_transform, manual: mined patterns, manual ones instead where there are."""
    own = mined.join(manual.select("domain"), "domain", "left_anti").select("domain", "template", "confirmed_on", "of_total", F.lit(None).cast("string").alias("mpn_transform"), F.lit(False).alias("manual"))
    return own.unionByName(manual.select(*own.columns))


def domains(rows: DataFrame) -> DataFrame:
    """manufacturer, domain: the most frequent."""
    return most_frequent(rows.withColumn("domain", url_domain(F.col("mfr_url"))), ["manufacturer"], "domain").drop("n")


def brand_pairs(rows: DataFrame, brand: str = "brand") -> DataFrame:
    """brand, manufacturer: the most frequent."""
    return most_frequent(rows.where(F.col(brand) != ""), [brand], "manufacturer").drop("n")


def row_tokens(rows: DataFrame) -> DataFrame:
    return rows.select("seq", "classpath", F.explode(X.tokens(F.col("Part_Desc"))).alias("token"))


def keywords(rows: DataFrame, top: int = 15) -> DataFrame:
    """classpath, token, weight: freq x (classes / rows with the token), rounded to four digits; the top of each
    class. Rows without class or description count nowhere."""
    rows = rows.where("classpath <> '' and Part_Desc <> ''")
    tok = row_tokens(rows)
    freq = tok.groupBy("classpath", "token").agg(F.count("*").alias("freq"))
    df = freq.groupBy("token").agg(F.sum("freq").alias("df"))  # rows, not classes, hold the token
    classes = rows.agg(F.countDistinct("classpath").alias("classes"))
    w = freq.join(df, "token").join(F.broadcast(classes)).withColumn("weight", F.round(F.col("freq") * (F.col("classes") / F.col("df")), 4))
    rank = Window.partitionBy("classpath").orderBy(F.desc("weight"), "token")
    return w.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= top).select("classpath", "token", "weight")


def class_prior(rows: DataFrame) -> DataFrame:
    """manufacturer, classpath, n."""
    return rows.where("manufacturer <> '' and classpath <> ''").groupBy("manufacturer", "classpath").agg(F.count("*").alias("n"))


def allowed_values(attributes: DataFrame) -> DataFrame:
    """classpath, label, values: sorted distinct values with what abbreviations stand for and single-spaced forms."""
    names = F.create_map(*[F.lit(x) for kv in SYNONYMS.items() for x in kv])
    v = F.col("value")
    clean = X.strip(F.regexp_replace(F.replace(F.lower(v), F.lit("."), F.lit(" ")), r"\s+", " "))
    forms = F.array(v, F.try_element_at(names, clean), F.try_element_at(names, F.replace(clean, F.lit(" "), F.lit(""))), F.regexp_replace(X.strip(v), r"\s+", " "))
    distinct = attributes.where("classpath <> '' and label <> '' and value <> ''").select("classpath", "label", "value").distinct()
    rows = distinct.select("classpath", "label", F.explode(F.array_distinct(F.array_compact(forms))).alias("v"))
    return rows.where("v <> ''").groupBy("classpath", "label").agg(F.array_sort(F.collect_set("v")).alias("values"))


def empty_rates(rows: DataFrame, column: str) -> DataFrame:
    """classpath, total, empty."""
    return rows.groupBy("classpath").agg(F.count("*").alias("total"), F.count_if(F.coalesce(F.col(column), F.lit("")) == "").alias("empty"))


def mostly_empty(rates: DataFrame, least: int = 2, share: float = 0.75) -> DataFrame:
    return rates.where((F.col("total") >= least) & (F.col("empty") >= share * F.col("total")))


#: Brand cells that name nobody, in lower case; brands that are a maker's though no name says so, and brands that are
#: not what they seem: fixed values.
NO_BRAND = ["-- unbranded --", "-- no dib brand --", "-- no unilog brand --", "commodity - unbranded"]
ALLOWED_BRANDS, DENIED_BRANDS = ["BRK"], ["JAMESHARDIE", "LP SMARTSIDE", "Wiz"]
BRAND_CELLS = ("E1_Brand", "DIB_Brand", "Unilog_Brand")


def row_brands(rows: DataFrame, *more: str) -> DataFrame:
    """seq, source (Part_Manuf, empty without), place (1 to 3) and brand as written, of every raw brand cell that is no placeholder."""
    cells = F.posexplode(F.array(*[X.strip(F.coalesce(F.col(c), F.lit(""))) for c in BRAND_CELLS])).alias("place", "brand")
    out = rows.select("seq", X.strip(F.coalesce(F.col("Part_Manuf"), F.lit(""))).alias("source"), *more, cells)
    return out.where(F.col("brand") != "").where(~F.lower("brand").isin(NO_BRAND))


def tainted_sources(rows: DataFrame) -> DataFrame:
    """source, brands: sources with more than one brand, as written."""
    return row_brands(rows).where("source <> ''").groupBy("source").agg(F.countDistinct("brand").alias("brands")).where("brands > 1")


def clean_brands(rows: DataFrame, resolved: DataFrame, known: DataFrame, allowed: list[str] | None = None, denied: list[str] | None = None) -> DataFrame:
    """brand, manufacturer, n: brands to add to the known ones (known: brand).

    rows: seq, Part_Manuf and the brand cells, raw. resolved: seq, status, manufacturer_name. Among the rows that are
    RESOLVED, a brand of one manufacturer alone counts, unless it is denied or its key is a known brand's. Where all its
    sources are tainted, a word of four letters or more of it must be in the manufacturer's name, or it must be
    allowed. Of brands that share a key the one seen first is added."""
    allowed, denied = ALLOWED_BRANDS if allowed is None else allowed, DENIED_BRANDS if denied is None else denied
    made = resolved.where("status = 'RESOLVED' and manufacturer_name <> ''").select("seq", "manufacturer_name")
    cells = kept(row_brands(rows).join(made, "seq"), "cells")
    per = cells.groupBy("brand").agg(F.countDistinct("manufacturer_name").alias("m"), F.min("manufacturer_name").alias("manufacturer"), F.count("*").alias("n"), F.min(F.struct("seq", "place")).alias("first"))
    per = per.where("m = 1").where(~F.col("brand").isin(list(denied))).withColumn("key", X.brand_key(F.col("brand")))
    per = per.join(known.select(X.brand_key(F.col("brand")).alias("key")).distinct(), "key", "left_anti")
    sound = cells.select("brand", "source").distinct().join(tainted_sources(rows), "source", "left_anti").select("brand").distinct()
    out = per.join(sound.withColumn("sound", F.lit(True)), "brand", "left")
    words = F.filter(F.regexp_extract_all(F.col("brand"), F.lit("([A-Za-z]+)"), F.lit(1)), lambda w: F.length(w) >= 4)
    named = F.exists(words, lambda w: F.lower("manufacturer").contains(F.lower(w)))
    out = out.where(F.coalesce("sound", F.lit(False)) | named | F.col("brand").isin(list(allowed)))
    first = F.row_number().over(Window.partitionBy("key").orderBy("first"))
    return out.withColumn("rank", first).where("rank = 1").select("brand", "manufacturer", "n")


def self_names(rows: DataFrame, reviewed: DataFrame) -> DataFrame:
    """raw, manufacturer, affected: reviewed raw names that stand for themselves once their code is off."""
    counts = rows.groupBy(F.col("Part_Manuf").alias("raw")).agg(F.count("*").alias("affected"))
    names = reviewed.select("raw", X.code_suffix_removed(F.col("raw")).alias("manufacturer"))
    return names.join(counts, "raw", "left").select("raw", "manufacturer", F.coalesce("affected", F.lit(0)).alias("affected"))


def slot_conflicts(attributes: DataFrame) -> DataFrame:
    """classpath, slot, labels: slots with more than one label."""
    return attributes.groupBy("classpath", "slot").agg(F.countDistinct("label").alias("labels")).where("labels > 1")


def mine_all(rows: DataFrame, attributes: DataFrame) -> dict[str, DataFrame]:
    """Every lookup from the rows themselves; operators.counts makes the same from stored counts."""
    named = rows.where("Part_Manuf <> ''")
    return {
        "templates": templates(attributes), "raw_manufacturers": raw_manufacturers(rows), "url_patterns": url_patterns(rows), "domains": domains(rows),
        "keywords": keywords(rows), "class_prior": class_prior(rows), "allowed_values": allowed_values(attributes),
        "brand_pairs": brand_pairs(rows), "empty_rates": empty_rates(rows, "brand"), "tainted_sources": tainted_sources(rows), "slot_conflicts": slot_conflicts(attributes), "shape_mismatches": shape_mismatches(rows),
        "self_names": self_names(named, named.select(F.col("Part_Manuf").alias("raw")).distinct()),
    }


def write_all(mined: dict[str, DataFrame], path: str) -> None:
    """Each mined table under its name, as Parquet: what a later session reads its lookups from."""
    for name, table in mined.items():
        table.write.mode("overwrite").parquet(f"{path}/{name}")


def largest_class(rows: DataFrame) -> DataFrame:
    """classpath, n: the most frequent class, the first in order among equals."""
    return rows.where("classpath <> ''").groupBy("classpath").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "classpath").limit(1)
