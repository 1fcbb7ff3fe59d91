"""Registered queries of the composed plan, with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.more_queries import FUZZY, LCS_SQL, NEAREST, RESOLVED
from millrace.plans import enrich as plan
from millrace.plans import submission as export_job
from millrace.plans.service import Service
from millrace.queries import CLEAN, PRIORS, SCORED, TEMPLATES, TOKENS, URLS, cleaned, fed, query
from millrace.sources import feed as sources
from millrace.sources.staging import kept, scratch

MAKERS = """makers AS (SELECT brand, manufacturer AS maker FROM (SELECT brand, manufacturer, row_number() OVER (PARTITION BY brand ORDER BY count(*) DESC, min(seq), manufacturer) AS r FROM branded WHERE brand IS NOT NULL GROUP BY 1, 2) WHERE r = 1)"""
BY_BRAND = RESOLVED.replace("SELECT lower(brand) AS key, min(manufacturer) AS manufacturer FROM branded WHERE brand IS NOT NULL GROUP BY 1", "SELECT lower(brand) AS key, arg_max(maker, brand) AS manufacturer FROM makers GROUP BY 1")
ENRICHED = """classed AS (SELECT seq, max(classpath) FILTER (r = 1) AS classpath, round(max(score) FILTER (r = 1) / max(total), 3) AS class_confidence FROM placed GROUP BY 1),
rows_ AS (SELECT b.seq, Mfg_Part_Num, Part_Desc, brand, status, manufacturer_name, match_score, k.classpath, coalesce(class_confidence, 0.0) AS class_confidence, replace(template, '{mpn}', Mfg_Part_Num) AS mfr_url
  FROM branded b JOIN cascade USING (seq) LEFT JOIN classed k USING (seq) LEFT JOIN domains d ON d.manufacturer = manufacturer_name LEFT JOIN patterns USING (domain)),
queue AS (SELECT seq, uom, value, row_number() OVER (PARTITION BY seq, uom ORDER BY pos) AS k FROM priors),
allowed AS (SELECT classpath, label, list(DISTINCT value) AS vs FROM attributes WHERE value <> '' GROUP BY 1, 2),
slots AS (SELECT r.seq, classpath, slot, t.label, uom_hint, row_number() OVER (PARTITION BY r.seq, uom_hint ORDER BY slot) AS k FROM rows_ r JOIN templates t USING (classpath)),
filled AS (SELECT s.seq, s.slot, s.label, coalesce(q.value, '') AS value, CASE WHEN q.value IS NOT NULL THEN uom_hint ELSE '' END AS uom, vs IS NULL OR list_contains(vs, q.value) AS ok
  FROM slots s LEFT JOIN queue q ON q.seq = s.seq AND q.uom = uom_hint AND q.k = s.k AND uom_hint <> '' LEFT JOIN allowed a ON a.classpath = s.classpath AND a.label = s.label),
per AS (SELECT seq, count(*) AS n, count_if(value <> '') AS f, count_if(value <> '' AND ok) AS v, max(value <> '' AND uom <> '' AND NOT contains(lower(value), lower(uom))) AS unit FROM filled GROUP BY 1),
judged AS (SELECT r.*, p.n, p.f, p.v, coalesce(Mfg_Part_Num, '') <> '' AND coalesce(Part_Desc, '') <> '' AND coalesce(classpath, '') <> '' AS v1_required, coalesce(f = v, true) AS v2_lov, NOT coalesce(unit, false) AS v3_uom_inline,
    manufacturer_name IS NULL OR maker IS NULL OR maker = manufacturer_name AS v5_brand_mfr
  FROM rows_ r LEFT JOIN per p USING (seq) LEFT JOIN makers USING (brand)),
marked AS (SELECT *, round(100 * (0.35 * CAST(CASE WHEN coalesce(classpath, '') <> '' AND coalesce(manufacturer_name, brand) IS NOT NULL THEN 0.5 ELSE 0.0 END AS DOUBLE) + 0.30 * coalesce(f / n, 0.0)
    + 0.20 * CASE WHEN coalesce(f, 0) = 0 THEN CAST(0.0 AS DOUBLE) ELSE v / f END + 0.10 * CAST(CASE WHEN v1_required AND v5_brand_mfr THEN 1.0 ELSE 0.0 END AS DOUBLE)), 2) AS confidence FROM judged)"""
CTES = ", ".join([CLEAN, URLS, MAKERS, FUZZY, LCS_SQL, NEAREST, BY_BRAND, TOKENS, SCORED.replace("FROM feed JOIN prior p USING (manufacturer)", "FROM (SELECT seq, manufacturer_name AS manufacturer FROM cascade) JOIN prior p USING (manufacturer)"), TEMPLATES, PRIORS, ENRICHED])
COLUMNS = ["seq", "status", "manufacturer_name", "match_score", "classpath", "class_confidence", "mfr_url", "v1_required", "v2_lov", "v3_uom_inline", "v5_brand_mfr", "confidence", "band"]


def enriched_of(spark, sf_dir):
    raw, rows = fed(spark, sf_dir), cleaned(spark, sf_dir)
    look = plan.mined(rows, sources.attributes(rows), "Part_Manuf is null or not Part_Manuf like 'Suplier%'")
    return plan.enrich(raw.select("seq", *sources.RAW), look)


@query(f"SELECT {', '.join(COLUMNS[:-1])}, CASE WHEN confidence >= 90 THEN 'VERIFIED' WHEN confidence >= 70 THEN 'REVIEW' ELSE 'LOW' END AS band FROM marked", CTES)
def enrich_products(spark, sf_dir):
    """The whole way of the feed, from raw cells to scored products."""
    return enriched_of(spark, sf_dir)[0].select(*COLUMNS)


@query("SELECT seq, slot, label, value, uom, value <> '' AND NOT ok AS lov_miss FROM filled", CTES)
def enrich_slots(spark, sf_dir):
    """The attributes that the composed plan fills."""
    return enriched_of(spark, sf_dir)[1].select("seq", "slot", "label", "value", "uom", F.coalesce("lov_miss", F.lit(False)).alias("lov_miss"))


@query(
    """SELECT seq, CASE WHEN coalesce(Mfg_Part_Num, '') = '' THEN '' ELSE Mfg_Part_Num END AS Mfg_Part_Num, coalesce(manufacturer_name, '') AS MANUFACTURER_NAME, coalesce(brand, '') AS BRAND_NAME, coalesce(classpath, '') AS "Classpath", coalesce(mfr_url, '') AS "MFR URL",
  coalesce(v1, '') AS "ATTRIBUTE_VALUE 1", coalesce(v2, '') AS "ATTRIBUTE_VALUE 2", coalesce(v3, '') AS "ATTRIBUTE_VALUE 3" FROM rows_ LEFT JOIN (SELECT seq, """
    + ", ".join(f"max(value) FILTER (slot = {i}) AS v{i}" for i in (1, 2, 3))
    + " FROM filled GROUP BY 1) USING (seq)",
    CTES,
)
def enrich_delivery(spark, sf_dir):
    """Delivery rows of the composed plan."""
    wide = ["Mfg_Part_Num", "MANUFACTURER_NAME", "BRAND_NAME", "Classpath", "MFR URL", *[f"ATTRIBUTE_VALUE {i}" for i in (1, 2, 3)]]
    return plan.deliver(*enriched_of(spark, sf_dir), wide)


STORED_SQL = """SELECT seq, coalesce(Mfg_Part_Num, '') AS Mfg_Part_Num, coalesce(manufacturer_name, '') AS MANUFACTURER_NAME, coalesce(brand, '') AS BRAND_NAME, coalesce(classpath, '') AS "Classpath", coalesce(mfr_url, '') AS "MFR URL",
  coalesce(mfr_url, '') AS "Ref URL 1", coalesce(v1, '') AS "ATTRIBUTE_VALUE 1", coalesce(v2, '') AS "ATTRIBUTE_VALUE 2", coalesce(v3, '') AS "ATTRIBUTE_VALUE 3" FROM rows_ LEFT JOIN (SELECT seq, """
STORED_SQL += ", ".join(f"max(value) FILTER (slot = {i}) AS v{i}" for i in (1, 2, 3)) + " FROM filled GROUP BY 1) USING (seq)"
STORED = ["Mfg_Part_Num", "MANUFACTURER_NAME", "BRAND_NAME", "Classpath", "MFR URL", "Ref URL 1", *[f"ATTRIBUTE_VALUE {i}" for i in (1, 2, 3)]]


@query(STORED_SQL, CTES)
def stored_delivery(spark, sf_dir):
    """Delivery rows from the job store alone, after the job has been stored twice."""
    service = Service(spark, scratch(spark, "store"))
    products, attributes = enriched_of(spark, sf_dir)
    products = kept(products, "products")  # every run of the job reads them
    for _ in range(2):
        service.process("j", products, attributes)
    return service.delivery("j", STORED)


def spaced(rows):
    """Every 23rd part number with a space before it."""
    return rows.withColumn("Mfg_Part_Num", F.when(F.col("seq") % 23 == 0, F.concat(F.lit(" "), "Mfg_Part_Num")).otherwise(F.col("Mfg_Part_Num")))


@query(
    """SELECT CASE WHEN p.seq IS NULL THEN ' ' || i.m ELSE p.Mfg_Part_Num END AS "Mfg_Part_Num", coalesce(p.manufacturer_name, '') AS "MANUFACTURER_NAME", coalesce(p.classpath, '') AS "Classpath", coalesce(p.mfr_url, '') AS "MFR URL", i.E1_Brand AS "E1_Brand"
  FROM (SELECT f.seq, f.m, f.spaced, coalesce(g.E1_Brand, f.E1_Brand) AS E1_Brand, g.seq AS r_seq FROM
    (SELECT seq, Mfg_Part_Num AS m, E1_Brand, seq % 23 = 0 AS spaced, row_number() OVER (PARTITION BY Mfg_Part_Num, seq % 23 = 0 ORDER BY seq) AS n FROM feed) f
    LEFT JOIN (SELECT seq, Mfg_Part_Num AS m, E1_Brand, row_number() OVER (PARTITION BY Mfg_Part_Num ORDER BY seq) AS n FROM feed) g ON NOT f.spaced AND f.m = g.m AND f.n = g.n) i LEFT JOIN rows_ p ON p.seq = i.r_seq""",
    CTES,
)
def submission(spark, sf_dir):
    """The export job, read back from its CSV: a part number that is not as written in its product's gives a row of raw cells."""
    raw, rows = fed(spark, sf_dir), cleaned(spark, sf_dir)
    look = plan.mined(rows, sources.attributes(rows), "Part_Manuf is null or not Part_Manuf like 'Suplier%'")
    columns, path = ["Mfg_Part_Num", "MANUFACTURER_NAME", "Classpath", "MFR URL", "E1_Brand"], scratch(spark, "submission")
    export_job.run(spaced(raw.select("seq", *sources.RAW)), look, path, columns)
    back = spark.read.option("header", True).option("escape", '"').csv(path)
    return back.select(*[F.coalesce(c, F.lit("")).alias(c) for c in columns])
