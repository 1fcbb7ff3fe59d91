"""The texts that a language model is asked, as columns. The wording is part of the cache's keys: fixed values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Allowed values that a request lists for a slot; characters of a page that a request carries.
LISTED, PAGE = 12, 6000
FREE = "(free-form, extract from description if present)"


def slot_lines(templates: DataFrame, allowed: DataFrame) -> DataFrame:
    """classpath, labels (array) and lines: for each slot, in order, its label, and a line with up to LISTED allowed
    values and how many more there are."""
    t = templates.join(allowed.select("classpath", "label", "values"), ["classpath", "label"], "left")
    values = F.coalesce("values", F.array().cast("array<string>"))
    more = F.when(F.size(values) > LISTED, F.format_string(" (and %d more)", F.size(values) - LISTED)).otherwise("")
    told = F.when(F.size(values) > 0, F.concat(F.lit("ALLOWED VALUES: "), F.array_join(F.slice(values, 1, LISTED), ", "), more)).otherwise(FREE)
    slots = F.array_sort(F.collect_list(F.struct("slot", F.col("label").alias("label"), F.concat(F.lit("- "), "label", F.lit(": "), told).alias("line"))))
    out = t.groupBy("classpath").agg(slots.alias("s"))
    return out.select("classpath", F.col("s.label").alias("labels"), F.array_join("s.line", "\n").alias("lines"))


def page_prompt(labels: Column, text: Column) -> Column:
    """Slots to fill from a page's text, its first PAGE characters."""
    return F.concat(F.lit("Slots to fill (use these exact labels as JSON keys):\n"), F.array_join(labels, "\n"), F.lit("\n\nSource text:\n"), F.substring(text, 1, PAGE), F.lit("\n\nJSON:"))


def fallback_prompt(desc: Column, classpath: Column, manufacturer: Column, lines: Column) -> Column:
    """Slots to fill from a row's own description."""
    return F.concat(
        F.lit("Product category: "), classpath, F.lit("\nManufacturer: "), _known(manufacturer), F.lit("\nRaw description: "), desc,
        F.lit("\n\nAttribute slots and their allowed values:\n"), lines, F.lit("\n\nJSON:"),
    )


def class_prompt(candidates: Column, desc: Column, manufacturer: Column) -> Column:
    """The choice of a class from a shortlist."""
    return F.concat(F.lit("Allowed Classpaths (choose exactly one):\n"), F.array_join(candidates, "\n"), F.lit("\n\nProduct description: "), desc, F.lit("\nManufacturer: "), _known(manufacturer), F.lit("\n\nClasspath:"))


def _known(manufacturer: Column) -> Column:
    return F.coalesce(F.nullif(manufacturer, F.lit("")), F.lit("unknown"))
