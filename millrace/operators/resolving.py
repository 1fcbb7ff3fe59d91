"""Manufacturer resolution: exact names, rules, candidates, brands, names in text, similarity; product URLs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import text as X
from millrace.sources.staging import dealt, is_kept, kept, rowwise

from . import similar

#: Name parts that identify nobody: fixed values.
GENERIC = ["corporation", "company", "inc", "incorporated", "llc", "corp", "manufacturing", "industries", "holding", "holdings", "products", "systems", "group", "co", "ltd", "limited", "international", "usa"]
#: Ordered rules for one cooperative's code: pattern in the description, then prefix of the part number. Fixed values.
COOP_CODE = "Appliance Dealers Cooperative (APPDE)"
COOP_WORDS = [
    (r"(?U)\bSQ\b", "Alliance Laundry Systems LLC"), (r"(?iU)\bSpeed Queen\b", "Alliance Laundry Systems LLC"), (r"(?iU)\bGE\b", "Haier"),
    (r"(?U)\bCaf", "Haier"), (r"(?iU)\bBeko\b", "Beko"), (r"(?iU)\bLG\b", "LG Electronics"),
]
COOP_PREFIXES = [("XOU", "XO Ventilation"), ("MVWP", "Whirlpool Corporation"), ("WDTS", "Whirlpool Corporation"), ("PDSH", "Rheem Manufacturing")]
ACCEPT, REVIEW = 85.0, 70.0


def lookup(dim: DataFrame) -> DataFrame:
    """A mined lookup table, computed once: Spark sees its size and broadcasts it only where it is small."""
    return dim if is_kept(dim) else kept(dim, "lookup")


def quoted(c: Column) -> Column:
    """A text between single quotes; between double ones where it holds single quotes alone."""
    c = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    plain = ~c.contains("'") | c.contains('"')
    return F.when(plain, F.concat(F.lit("'"), F.replace(c, F.lit("'"), F.lit("\\'")), F.lit("'"))).otherwise(F.concat(F.lit('"'), c, F.lit('"')))


def coop_rule(desc: Column, mpn: Column) -> Column:
    """The manufacturer that the cooperative's rules give, first match first; null if none does."""
    out = F.lit(None).cast("string")
    for prefix, name in reversed(COOP_PREFIXES):
        out = F.when(F.upper(X.strip(mpn)).startswith(prefix), name).otherwise(out)
    for pattern, name in reversed(COOP_WORDS):
        out = F.when(desc.rlike(pattern), name).otherwise(out)
    return out


def by_description(rows: DataFrame, manufacturers: DataFrame) -> DataFrame:
    """seq, manufacturer: the only known manufacturer of whose telling name parts one stands in the description."""
    part = F.explode(F.regexp_extract_all(F.col("manufacturer"), F.lit(r"([A-Za-z]+)"), F.lit(1))).alias("part")
    parts = manufacturers.select("manufacturer", part).select("manufacturer", F.lower("part").alias("word"))
    parts = parts.where(F.length("word") >= 4).where(~F.col("word").isin(GENERIC)).distinct()
    words = rows.select("seq", F.explode(F.array_distinct(F.split(F.lower("Part_Desc"), r"(?U)\W+"))).alias("word"))
    hits = words.join(lookup(parts), "word").groupBy("seq").agg(F.collect_set("manufacturer").alias("m"))
    return hits.where("size(m) = 1").select("seq", F.col("m")[0].alias("manufacturer"))


def by_similarity(names: DataFrame, known: DataFrame, least: float = REVIEW) -> DataFrame:
    """name, raw, manufacturer, score: the most similar known name of each distinct unknown one, codes off, words
    sorted. Of known names that are alike without code the first decides ties and the last is the match."""
    a = kept(names.select("name").distinct().withColumn("x", X.token_sorted(X.code_suffix_removed(F.col("name")))), "names")
    bare = X.token_sorted(X.code_suffix_removed(F.col("raw"))).alias("y")
    b = kept(known.groupBy(bare).agg(F.min("raw").alias("order"), F.max(F.struct("raw", "manufacturer")).alias("k")), "known")
    found = similar.best_matches(a, b, [], least)
    return a.join(found, "x").join(b, "y").select("name", "k.raw", "k.manufacturer", "score")


def resolve(rows: DataFrame, raw_names: DataFrame, brands: DataFrame, domains: DataFrame) -> DataFrame:
    """rows with status, manufacturer_name, domain, matched_raw, match_score, candidates.

    rows: seq, Part_Manuf, brand, Part_Desc, Mfg_Part_Num, cleaned. Order of trial without Part_Manuf: brand,
    a name of the domain table in the description; with it: exact name, candidates (one cooperative's by rule),
    similarity. matched_raw says how; without a match it and match_score are null. Only what the
    equi-joins leave reaches the similarity step.
    """
    raw_names = lookup(raw_names)
    known = raw_names.where("size(names) = 1").select("raw", F.col("names")[0].alias("exact"))
    several = raw_names.where("size(names) > 1").select("raw", F.col("names").alias("candidates"))
    out = rows.join(known.withColumnRenamed("raw", "Part_Manuf"), "Part_Manuf", "left").join(several.withColumnRenamed("raw", "Part_Manuf"), "Part_Manuf", "left")
    key = brands.groupBy(F.col("key").alias("__key")).agg(F.min("manufacturer").alias("by_brand"))
    out = kept(out.withColumn("__key", F.when(F.col("Part_Manuf").isNull(), X.brand_key(F.col("brand")))).join(lookup(key), "__key", "left"), "named")
    nameless = out.where("Part_Manuf is null and by_brand is null")
    told = by_description(nameless.select("seq", "Part_Desc"), domains.select("manufacturer").distinct())
    out = dealt(out, out.count(), "seq").join(rowwise(told.withColumnRenamed("manufacturer", "by_text")), "seq", "left")
    out = out.withColumn("by_rule", F.when(F.col("Part_Manuf") == COOP_CODE, coop_rule(F.col("Part_Desc"), F.col("Mfg_Part_Num"))))
    left = out.where("Part_Manuf is not null and exact is null and candidates is null").select(F.col("Part_Manuf").alias("name"))
    near = by_similarity(left, known.withColumnRenamed("exact", "manufacturer"))
    near = near.select(F.col("name").alias("Part_Manuf"), F.col("raw").alias("near_raw"), F.col("manufacturer").alias("near_name"), "score")
    out = out.join(lookup(near), "Part_Manuf", "left")
    ruled = F.col("exact").isNull() & F.col("candidates").isNotNull()
    status = (
        F.when(F.col("exact").isNotNull() | (ruled & F.col("by_rule").isNotNull()), "RESOLVED").when(ruled, "NEEDS_DISAMBIGUATION")
        .when(F.col("score") >= ACCEPT, "RESOLVED").when(F.col("score") >= REVIEW, "NEEDS_REVIEW")
        .when(F.col("Part_Manuf").isNull() & F.coalesce("by_brand", "by_text").isNotNull(), "RESOLVED").otherwise("UNRESOLVED")
    )
    name = F.coalesce("exact", F.when(ruled, F.col("by_rule")), "near_name", "by_brand", "by_text")
    how = F.when(F.col("exact").isNotNull(), F.col("Part_Manuf")).when(F.col("by_rule").isNotNull() & ruled, F.concat("Part_Manuf", F.lit(" [ADC secondary-signal match]"))).when(F.col("near_raw").isNotNull(), F.col("near_raw"))
    how = how.when(F.col("by_brand").isNotNull(), F.concat(F.lit("[brand fallback: "), quoted(F.col("brand")), F.lit("]"))).when(F.col("by_text").isNotNull(), F.lit("[description fallback]"))
    score = F.when(F.col("score").isNotNull() & F.col("exact").isNull() & ~ruled, F.col("score")).when(status == "RESOLVED", 100.0)
    out = out.select(*rows.columns, status.alias("status"), name.alias("manufacturer_name"), how.alias("matched_raw"), score.alias("match_score"), F.when(status == "NEEDS_DISAMBIGUATION", F.col("candidates")).alias("candidates"))
    return out.join(lookup(domains.withColumnRenamed("manufacturer", "manufacturer_name")), "manufacturer_name", "left")


def short_sku(mpn: Column) -> Column:
    """The model part of a three-part number in lower case, "-w" behind it where the last part ends in W; else null."""
    model, tail = F.regexp_extract(mpn, r"^R\d{2}-([A-Z0-9]+)-([0-9A-Z]+)$", 1), F.regexp_extract(mpn, r"^R\d{2}-([A-Z0-9]+)-([0-9A-Z]+)$", 2)
    return F.when(model != "", F.concat(F.lower(model), F.when(tail.endswith("W"), "-w").otherwise("")))


#: Ways to write a part number into a URL, by name; more can be registered.
TRANSFORMS = {"as_is": lambda c: c, "short_sku": short_sku}


def product_urls(rows: DataFrame, domains: DataFrame, patterns: DataFrame, transform: str = "as_is") -> DataFrame:
    """rows with url: the manufacturer's domain's template filled with the part number; null without either."""
    out = rows.join(lookup(domains), "manufacturer", "left").join(lookup(patterns.select("domain", "template")), "domain", "left")
    return out.withColumn("url", F.replace(F.col("template"), F.lit("{mpn}"), TRANSFORMS[transform](F.col("Mfg_Part_Num"))))


def filled_url(template: str, mpn: Column) -> Column:
    """A URL template with the part number in it, as for a product's chart."""
    return F.replace(F.lit(template), F.lit("{mpn}"), mpn)


#: Sites that are never fetched: a parameter of blocked().
def blocked(url: Column, sites: list[str]) -> Column:
    return F.exists(F.array(*[F.lit(s) for s in sites]), lambda s: F.lower(url).contains(s))
