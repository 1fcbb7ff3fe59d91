"""Attributes into slots: template expansion, ordered claim of priors, provenance, overrides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import text as X
from millrace.sources.staging import ROWS, rowwise

from .resolving import lookup

#: Values that mean "not known": fixed values.
UNKNOWN = ["", "null", "none", "n/a", "na", "unknown", "unspecified", "-", "not found"]


def telling(value: Column) -> Column:
    """Whether a value says something."""
    return ~F.coalesce(F.lower(X.strip(value)), F.lit("")).isin(UNKNOWN)


def usable(extracted: DataFrame, rows: DataFrame, templates: DataFrame) -> DataFrame:
    """seq, label, value of extracted pairs whose label is in the row's template and whose value says something."""
    known = extracted.where(telling(F.col("value")))
    labels = lookup(templates.groupBy("classpath").agg(F.collect_set("label").alias("__labels")))  # a class's labels
    at = rows.select(F.col("seq").alias("__seq"), "classpath").join(labels, "classpath")
    return known.join(rowwise(at), (F.col("seq") == F.col("__seq")) & F.array_contains("__labels", F.col("label")), "left_semi")


def reconcile(rows: DataFrame, templates: DataFrame, extracted: DataFrame, priors: DataFrame) -> DataFrame:
    """seq, slot, label, value, uom, origin: every slot of every row's template.

    An extracted value stands, its unit taken off; its unit is that of the last prior with the same
    value, or the hint. Priors of a unit go in text order to the empty slots with that hint, in
    slot order. A prior that equals an extracted value is not used up by it. A row's slots, extracted pairs and priors, which
    its template and description bound, meet as arrays, so rows are shuffled and not their slots. Arrays are short when
    shuffled and long when filled, so tasks are dealt by a number of rows and not by size.
    """
    parts = -(-rows.count() // ROWS)
    dealt = lambda t: t.repartition(parts, "seq") if parts > 1 else t
    slots = lookup(templates.groupBy("classpath").agg(F.array_sort(F.collect_list(F.struct("slot", "label", "uom_hint"))).alias("slots")))
    told = dealt(extracted).groupBy("seq").agg(F.collect_list(F.struct("label", F.col("value").alias("x"))).alias("told"))
    read = dealt(priors).groupBy("seq").agg(F.array_sort(F.collect_list(F.struct("pos", "uom", "value"))).alias("read"))
    out = dealt(rows.select("seq", "classpath").join(slots, "classpath")).join(rowwise(told), "seq", "left").join(rowwise(read), "seq", "left")

    def filled(s: Column, x: Column) -> Column:
        return F.struct(s["slot"].alias("slot"), s["label"].alias("label"), s["uom_hint"].alias("hint"), F.coalesce(X.unit_removed(x, s["uom_hint"]), F.lit("")).alias("v"))

    def pairs(s: Column) -> Column:
        own = F.filter("told", lambda t: t["label"] == s["label"])
        return F.when(F.coalesce(F.size(own), F.lit(0)) > 0, F.transform(own, lambda t: filled(s, t["x"]))).otherwise(F.array(filled(s, F.lit(None).cast("string"))))

    out = out.withColumn("slots", F.flatten(F.transform("slots", pairs)))

    def claimed(s: Column, i: Column) -> Column:
        before = F.size(F.filter(F.slice("slots", F.lit(1), i), lambda o: (o["v"] == "") & (o["hint"] == s["hint"])))
        return F.when((s["v"] == "") & (s["hint"] != ""), F.get(F.filter("read", lambda p: p["uom"] == s["hint"]), before)["value"])

    def said(s: Column) -> Column:
        return F.when(s["v"] != "", F.try_element_at(F.filter("read", lambda p: p["value"] == s["v"]), F.lit(-1))["uom"])

    each = F.transform("slots", lambda s, i: F.struct(s["slot"].alias("slot"), s["label"].alias("label"), s["hint"].alias("hint"), s["v"].alias("v"), claimed(s, i).alias("claimed"), said(s).alias("said")))
    out = out.select("seq", "classpath", F.explode(each).alias("s")).select("seq", "classpath", "s.*")
    value = F.when(F.col("v") != "", F.col("v")).otherwise(F.coalesce("claimed", F.lit("")))
    uom = F.when(F.col("v") != "", F.coalesce("said", "hint")).when(F.col("claimed").isNotNull(), F.col("hint")).otherwise("")
    origin = F.when(F.col("v") != "", "llm_extract").when(F.col("claimed").isNotNull(), "rule_prior")
    return out.select("seq", "classpath", "slot", "label", value.alias("value"), uom.alias("uom"), origin.alias("origin"))


def backfill(attributes: DataFrame, label: str, found: DataFrame) -> DataFrame:
    """Empty slots of a label filled from found (seq, value), as rule priors without unit."""
    out = attributes.join(rowwise(found.select("seq", F.col("value").alias("__found"))), "seq", "left")
    fill = (F.col("label") == label) & (F.col("value") == "") & F.col("__found").isNotNull()
    return out.withColumns({"value": F.when(fill, F.col("__found")).otherwise(F.col("value")), "origin": F.when(fill, "rule_prior").otherwise(F.col("origin"))}).drop("__found")


def code_in_text(rows: DataFrame, codes: DataFrame) -> DataFrame:
    """seq, value: the longest known code that stands as a word in the description (code as listed)."""
    words = rows.select("seq", F.explode(F.array_distinct(F.split(F.lower("Part_Desc"), r"(?U)[^\w-]+"))).alias("w"))
    hits = words.join(lookup(codes.select(F.col("code"), F.lower("code").alias("w"))), "w")
    return hits.groupBy("seq").agg(F.min(F.struct((-F.length("code")).alias("n"), "code")).alias("b")).select("seq", F.col("b.code").alias("value"))


def provenance(attributes: DataFrame, rows: DataFrame) -> DataFrame:
    """attributes with source_url and evidence_text. rows: seq, Part_Desc, path (web, desc_fallback, none),
    page_url, page_text, chart_url, chart_labels (array)."""
    out = attributes.join(rowwise(rows.select("seq", "Part_Desc", "path", "page_url", "page_text", "chart_url", "chart_labels")), "seq", "left")
    filled = F.col("value") != ""
    chart = filled & F.coalesce(F.array_contains("chart_labels", F.col("label")), F.lit(False))
    web = filled & (F.col("origin") == "llm_extract") & (F.col("path") == "web")
    url = F.when(chart, F.col("chart_url")).when(web, F.col("page_url"))
    evidence = F.when(chart, F.lit("spec chart")).when(web, X.snippet(F.col("page_text"), F.col("value"))).when(filled, F.col("Part_Desc"))
    return out.select(*attributes.columns, url.alias("source_url"), evidence.alias("evidence_text"))


def extraction_path(chart: Column, page: Column, described: Column) -> Column:
    """Which candidate map of label to value is used: the first that is not empty."""
    full = lambda m: F.coalesce(F.size(F.map_keys(m)) > 0, F.lit(False))
    none = F.expr("cast(map() as map<string,string>)")
    return F.struct(
        F.when(full(chart), "pdf").when(full(page), "web").when(full(described), "desc_fallback").otherwise("none").alias("path"),
        F.when(full(chart), chart).when(full(page), page).when(full(described), described).otherwise(none).alias("values"),
    )


def overridden(values: Column, over: Column) -> Column:
    """Two maps in one; the second one's entries win."""
    return F.map_concat(F.map_filter(values, lambda k, _: ~F.coalesce(F.array_contains(F.map_keys(over), k), F.lit(False))), F.coalesce(over, F.expr("cast(map() as map<string,string>)")))
