"""The whole way of a feed: clean, resolve, classify, read units, reconcile, describe, repair, validate, score, deliver."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions import text as X
from millrace.operators import classifying, describing, exporting, mining, reconciling, resolving, validating
from millrace.sources.feed import RAW
from millrace.sources.staging import SLOTS, dealt, kept, rowwise


@dataclass
class Lookups:
    """Mined tables; see millrace.operators.mining for their columns."""

    raw_names: DataFrame
    brands: DataFrame
    domains: DataFrame
    patterns: DataFrame
    keywords: DataFrame
    prior: DataFrame
    templates: DataFrame
    allowed: DataFrame
    brand_makers: DataFrame

    def kept(self) -> Lookups:
        """The same tables, each computed once: every plan reads them several times."""
        return Lookups(*[kept(getattr(self, f.name), f.name) for f in fields(self)])


def mined(labelled: DataFrame, attributes: DataFrame, reviewed: str = "true") -> Lookups:
    """All lookups from labelled rows with cleaned raw columns and a brand. reviewed: condition on the
    rows whose raw names may be learnt."""
    labelled = kept(labelled, "labelled")
    brands = mining.brand_pairs(labelled)
    keys = brands.groupBy(X.brand_key(F.col("brand")).alias("key")).agg(F.max_by("manufacturer", "brand").alias("manufacturer"))  # of brands that share a key the last
    return Lookups(
        mining.raw_manufacturers(labelled.where(reviewed)), keys, mining.domains(labelled), mining.url_patterns(labelled), mining.keywords(labelled),
        mining.class_prior(labelled), mining.templates(attributes), mining.allowed_values(attributes), brands,
    ).kept()


def clean(raw: DataFrame) -> DataFrame:
    """raw (seq and the raw columns) with the cells as read in the map `raw`, cleaned columns and brand. A column that
    the feed lacks has no entry; a null cell is the text "None"."""
    cells = F.create_map(*[x for c in RAW if c in raw.columns for x in (F.lit(c), F.coalesce(F.col(c).cast("string"), F.lit("None")))])
    raw = raw.withColumns({c: F.lit(None).cast("string") for c in RAW if c not in raw.columns})
    rows = raw.withColumn("raw", cells).withColumns({c: X.clean_value(F.col(c)) for c in RAW})
    return rows.withColumn("brand", F.coalesce("E1_Brand", "Unilog_Brand", "DIB_Brand"))


def enrich(raw: DataFrame, look: Lookups, extracted: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """products (one row for each raw row, scored) and their attributes. extracted: seq, label, value from
    pages, sheets or a cached model; without it only what the descriptions say is filled. What several
    later steps read is written once, so the plan grows by its steps and not by their product. Rows and
    their attributes meet in tasks of a number of rows."""
    rows = kept(clean(raw), "cleaned")
    n = rows.count()  # from the files' footers
    by_seq = lambda t: dealt(t, n, "seq")
    resolved = resolving.resolve(rows.select("seq", "Part_Manuf", "brand", "Part_Desc", "Mfg_Part_Num"), look.raw_names, look.brands, look.domains)
    named = kept(by_seq(rows).join(rowwise(resolved.select("seq", "status", "manufacturer_name", "match_score", "domain")), "seq", "left"), "resolved")
    classes = classifying.classify(named.select("seq", "Part_Desc", F.col("manufacturer_name").alias("manufacturer")), look.keywords, look.prior)
    rows = by_seq(named).join(rowwise(classes.select("seq", "classpath", F.col("confidence").alias("class_confidence"), "runner_up")), "seq", "left")
    rows = rows.join(look.patterns.select("domain", "template"), "domain", "left")
    rows = kept(rows.withColumn("mfr_url", F.replace(F.col("template"), F.lit("{mpn}"), F.col("Mfg_Part_Num"))).drop("template"), "classified")
    priors = rows.select("seq", F.posexplode(X.unit_priors(F.col("Part_Desc"))).alias("pos", "p")).select("seq", "pos", "p.value", "p.uom")
    if extracted is None:
        extracted = rows.select("seq", F.lit(None).cast("string").alias("label"), F.lit(None).cast("string").alias("value")).limit(0)
    slots = reconciling.reconcile(rows, look.templates, reconciling.usable(extracted, rows, look.templates), priors)
    none = lambda t: F.lit(None).cast(t)
    where = rows.select("seq", "Part_Desc", F.lit("desc_fallback").alias("path"), F.col("mfr_url").alias("page_url"), none("string").alias("page_text"), none("string").alias("chart_url"), none("array<string>").alias("chart_labels"))
    slots = kept(reconciling.provenance(slots, where), "slots")
    # texts are made before values are repaired
    described = describing.describe(by_seq(rows).join(rowwise(describing.attribute_maps(by_seq(slots))), "seq", "left").withColumn("attrs", F.coalesce("attrs", F.expr("cast(map() as map<string,string>)"))))
    slots = kept(validating.repaired(slots, look.allowed), "repaired")
    return validating.scored(described.drop("attrs", "ordered"), by_seq(slots), look.brand_makers), slots


def deliver(products: DataFrame, attributes: DataFrame, columns: list[str] | None = None) -> DataFrame:
    none = F.expr("cast(array() as array<string>)")
    attributes = dealt(attributes, attributes.count(), "seq", rows=SLOTS)
    rows = products.join(rowwise(exporting.slot_maps(attributes)), "seq", "left").withColumns({"ref_urls": none, "features": none, "MARKETING_DESCRIPTION": F.lit(None).cast("string")})
    return exporting.delivery(rows, columns)
