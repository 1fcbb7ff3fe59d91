"""Validation of products against rules and allowed values, and the confidence score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import text as X
from millrace.sources.staging import SLOTS, dealt, kept, rowwise

from . import similar
from .resolving import lookup

REPAIR = 90.0
#: Weights of the score and its bands: fixed values.
WEIGHTS = {"source_strength": 0.35, "extraction_conf": 0.30, "lov_match": 0.20, "rule_validation": 0.10, "multi_source_bonus": 0.05}
VERIFIED, REVIEW = 90, 70


def repaired(attributes: DataFrame, allowed: DataFrame) -> DataFrame:
    """attributes with value repaired to the most similar allowed one (90 or more, lower-cased; the first
    in order among equals), was (the value before), lov_valid: null on rows with any repair but for
    the repaired values themselves, else whether the value is allowed (or its label has no list); lov_miss: not
    allowed and not repaired; and lov_score, how similar the nearest allowed value of a repaired or missed one is.
    What a list says of a value goes on with it, not the list; a product's rows meet in tasks of SLOTS rows."""
    a = attributes.join(lookup(allowed.select("classpath", "label", "values")), ["classpath", "label"], "left")
    a = kept(a.withColumns({"__listed": F.col("values").isNotNull(), "__in": F.array_contains("values", F.col("value"))}).drop("values"), "checked")
    checked = (F.col("value") != "") & F.col("__listed")
    ok = F.col("__in")
    miss = kept(a.where(checked & ~ok).select("classpath", "label", "value").distinct().withColumn("x", F.lower("value")), "misses")
    of = ["classpath", "label"]
    lists = lookup(allowed.select(*of, "values")).join(miss.select(*of).distinct(), of, "left_semi")
    known = kept(lists.select(*of, F.explode("values").alias("order")).withColumn("y", F.lower("order")), "allowed")
    # the nearest value of all, as a warning tells how near it is
    best = similar.best_matches(miss.select(*of, "x"), known, of, 0.0, (95.0, REPAIR, 75.0, 50.0))
    first = known.groupBy(*of, "y").agg(F.min("order").alias("v"))
    best = miss.join(best, [*of, "x"]).join(first, [*of, "y"])
    n = a.count()
    fixed = F.when(F.col("score") >= REPAIR, F.col("v")).alias("fixed")
    a = a.join(lookup(best.select(*of, "value", fixed, F.col("score").alias("best"))), [*of, "value"], "left")
    a = dealt(a, n, "seq", rows=SLOTS)
    a = a.withColumn("any_fixed", F.max(F.col("fixed").isNotNull()).over(Window.partitionBy("seq")))
    valid = F.when(F.col("fixed").isNotNull(), True).when(F.col("any_fixed"), F.lit(None)).when(F.col("value") == "", F.lit(None)).otherwise(~F.col("__listed") | ok)
    fixed = F.coalesce("fixed", "value")
    return a.select(*[fixed.alias("value") if c == "value" else F.col(c) for c in attributes.columns], F.col("value").alias("was"), valid.alias("lov_valid"), (checked & ~ok & F.col("fixed").isNull()).alias("lov_miss"), F.when(checked & ~ok, F.coalesce("best", F.lit(0.0))).alias("lov_score"))


#: Texts of the warnings: fixed values of the format.
MISSING = {"Mfg_Part_Num": "V1: Mfg_Part_Num is required but missing", "Part_Desc": "V1: Part_Desc is required but missing", "classpath": "V1: could not classify to a leaf Classpath"}
REPAIRED = "V2: repaired '%s' value '%s' -> '%s' (fuzzy match %.1f)"
NOT_ALLOWED = "V2: '%s' value '%s' not found in known LOV for %s (best match %.1f)"
NO_UNIT = "V3: '%s' value '%s' does not carry expected UOM '%s'"
CASING = "V4: '%s' casing does not match field-aware contract"
OTHER_MAKER = "V5: brand '%s' expected manufacturer '%s', got '%s'"
TEXT_ONLY = "V6: '%s' value '%s' provenance is text-only (rule_prior or LOV-fallback), no source_url"
UNSOURCED = "V6: '%s' value '%s' has no source_url AND no evidence_text"
#: Fields whose casing is part of the format.
CASED = ("INVOICE_DESC", "MOBILE_DESC")


def empty(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit("")) == ""


def _warned() -> list[Column]:
    """What V2, V3 and V6 say of a product's attributes (arrays in order of slot), and whether any fails: miss, unit, bare.
    Only the attributes that are warned of are gathered, at most a product's slots."""
    filled = ~empty("value")
    digits = F.bround("lov_score", 1)  # a score is a double: half goes to even
    fixed = F.col("lov_score").isNotNull() & ~F.col("lov_miss")
    unit = filled & ~empty("uom") & ~F.replace(F.lower("value"), F.lit(" "), F.lit("")).contains(F.lower("uom"))
    unsourced = filled & empty("source_url")
    bare = unsourced & empty("evidence_text")
    said = {
        "2": F.when(fixed, F.format_string(REPAIRED, "label", "was", "value", digits)).when(F.col("lov_miss"), F.format_string(NOT_ALLOWED, "label", "value", "classpath", digits)),
        "3": F.when(unit, F.format_string(NO_UNIT, "label", "value", "uom")),
        "6": F.when(bare, F.format_string(UNSOURCED, "label", "value")).when(unsourced, F.format_string(TEXT_ONLY, "label", "value")),
    }
    told = lambda w: F.transform(F.array_sort(F.collect_list(F.when(w.isNotNull(), F.struct("slot", w.alias("w"))))), lambda x: x["w"])
    return [*[told(w).alias(f"__w{v}") for v, w in said.items()], F.coalesce(F.max("lov_miss"), F.lit(False)).alias("__miss"), F.max(unit).alias("__unit"), F.max(bare).alias("__bare")]


def attribute_warnings(attributes: DataFrame) -> DataFrame:
    """seq and what is said of its attributes (what repaired() returns, with source_url and evidence_text)."""
    return attributes.groupBy("seq").agg(*_warned())


def _tallied() -> list[Column]:
    """What the score reads of a product's attributes: counts."""
    filled = F.col("value") != ""
    return [
        F.count("*").alias("__n"), F.count_if(filled).alias("__filled"), F.count_if(filled & ~empty("source_url")).alias("__sourced"),
        F.count_if(filled & F.col("lov_valid").isNotNull()).alias("__flagged"), F.count_if(filled & F.coalesce("lov_valid", F.lit(False))).alias("__valid"),
    ]


def validate(rows: DataFrame, attributes: DataFrame, brand_makers: DataFrame) -> DataFrame:
    """rows with v1_required .. v6_source_url, warnings, needs_review.

    rows: seq, Mfg_Part_Num, Part_Desc, classpath, manufacturer_name, brand and the description fields
    (INVOICE_DESC, MOBILE_DESC); attributes: what repaired() returns, with source_url and evidence_text.
    Warnings come by validator, those on attributes by slot. A product without attributes passes V2, V3 and V6.
    """
    return _validated(rows.join(rowwise(attribute_warnings(attributes)), "seq", "left"), brand_makers)


def _validated(told: DataFrame, brand_makers: DataFrame) -> DataFrame:
    """validate() of rows that have what is said of their attributes."""
    maker = brand_makers.select(F.col("brand"), F.col("manufacturer").alias("__maker"))
    out = told.join(lookup(maker), "brand", "left")
    no = lambda c: ~F.coalesce(F.col(c), F.lit(False))
    missing = {c: empty(c) for c in MISSING}
    cased = {f: F.coalesce(X.cased(F.col(f), f) == F.col(f), F.lit(True)) for f in CASED}
    other = ~empty("brand") & ~empty("manufacturer_name") & F.col("__maker").isNotNull() & (F.col("__maker") != F.col("manufacturer_name"))
    flags = {
        "v1_required": ~(missing["Mfg_Part_Num"] | missing["Part_Desc"] | missing["classpath"]), "v2_lov": no("__miss"), "v3_uom_inline": no("__unit"),
        "v4_casing_inline": cased["INVOICE_DESC"] & cased["MOBILE_DESC"], "v5_brand_mfr": ~F.coalesce(other, F.lit(False)), "v6_source_url": no("__bare"),
    }
    first = [F.when(missing[c], F.lit(w)) for c, w in MISSING.items()]
    last = [F.when(~cased[f], F.lit(CASING % f)) for f in CASED] + [F.when(other, F.format_string(OTHER_MAKER, "brand", "__maker", "manufacturer_name"))]
    none = F.array().cast("array<string>")
    of = lambda v: F.coalesce(f"__w{v}", none)
    warnings = F.concat(F.array_compact(F.array(*first)), of(2), of(3), F.array_compact(F.array(*last)), of(6))
    out = out.withColumns({**flags, "warnings": warnings})
    return out.withColumn("needs_review", ~(F.col("v1_required") & F.col("v5_brand_mfr"))).drop("__miss", "__unit", "__bare", "__w2", "__w3", "__w6", "__maker")


def band(score: Column) -> Column:
    return F.when(score >= VERIFIED, "VERIFIED").when(score >= REVIEW, "REVIEW").otherwise("LOW")


def confidence(validated: DataFrame, attributes: DataFrame) -> DataFrame:
    """validated with the five inputs, confidence (0 to 100, two digits) and band."""
    return _graded(validated.join(rowwise(attributes.groupBy("seq").agg(*_tallied())), "seq", "left"))


def scored(rows: DataFrame, attributes: DataFrame, brand_makers: DataFrame) -> DataFrame:
    """confidence(validate(..)) of the same tables: a product's attributes are read, and meet it, once for both."""
    facts = attributes.groupBy("seq").agg(*_warned(), *_tallied())
    return _graded(_validated(rows.join(rowwise(facts), "seq", "left"), brand_makers))


def _graded(out: DataFrame) -> DataFrame:
    """confidence() of validated rows that have their attributes' counts."""
    known = F.coalesce("classpath", F.lit("")) != ""
    strength = F.when(F.col("__sourced") > 0, 1.0).when(known & F.coalesce("manufacturer_name", "brand").isNotNull(), 0.5).otherwise(0.0)
    match = F.when(F.coalesce("__filled", F.lit(0)) == 0, 0.0).when(F.col("__flagged") > 0, F.col("__valid") / F.col("__filled")).otherwise(F.col("v2_lov").cast("double"))
    inputs = {
        "source_strength": strength, "extraction_conf": F.coalesce(F.when(F.col("__n") > 0, F.col("__filled") / F.col("__n")), F.lit(0.0)), "lov_match": match,
        "rule_validation": (F.col("v1_required") & F.col("v5_brand_mfr")).cast("double"), "multi_source_bonus": F.lit(0.0),
    }
    out = out.withColumns(inputs)
    score = F.lit(0.0)
    for name, weight in WEIGHTS.items():
        score = score + weight * F.col(name)
    out = out.withColumn("confidence", F.round(100 * score, 2))
    return out.withColumn("band", band(F.col("confidence"))).drop("__n", "__filled", "__sourced", "__flagged", "__valid")
