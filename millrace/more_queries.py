"""Registered queries of reconciliation, validation, descriptions, export, evaluation, layout, cache and jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions import text as X
from millrace.operators import caching, describing, evaluating, exporting, layout, mining, reconciling, records, resolving, validating
from millrace.queries import CLEAN, PRIORS, TEMPLATES, URLS, cleaned, fed, priors_of, query
from millrace.sources import feed as sources
from millrace.sources import pages
from millrace.sources.staging import SLOTS, dealt, kept, rowwise, scratch

# ---------------------------------------------------------------- similarity

#: Similarity of every pair (a, b) of a CTE `pairs`: rows of the usual table as running maxima.
LCS_SQL = """lcs AS (
  SELECT a, b, 0 AS i, list_transform(range(length(b) + 1), lambda x: 0) AS r FROM pairs
  UNION ALL SELECT a, b, i + 1, list_concat([0], list_transform(range(1, length(b) + 1), lambda j: list_max(list_transform(range(1, j + 1),
    lambda k: CASE WHEN substr(b, CAST(k AS BIGINT), 1) = substr(a, i + 1, 1) THEN r[k] + 1 ELSE r[k + 1] END)))) FROM lcs WHERE i < length(a)),
sim AS (SELECT a, b, CASE WHEN length(a) + length(b) = 0 THEN 100.0 ELSE 200.0 * r[-1] / (length(a) + length(b)) END AS score FROM lcs WHERE i = length(a))"""


FUZZY = """misses AS (SELECT DISTINCT Part_Manuf AS name FROM branded WHERE Part_Manuf LIKE 'Suplier%'),
known AS (SELECT raw, manufacturer FROM (SELECT Part_Manuf AS raw, min(manufacturer) AS manufacturer, count(DISTINCT manufacturer) AS n FROM branded
  WHERE Part_Manuf LIKE 'Supplier%' GROUP BY 1) WHERE n = 1),
na AS (SELECT name, trim(regexp_replace(name, '\\s*\\([^)]*\\)\\s*$', '')) AS a FROM misses),
kb AS (SELECT trim(regexp_replace(raw, '\\s*\\([^)]*\\)\\s*$', '')) AS b, max(raw) AS raw, arg_max(manufacturer, raw) AS manufacturer FROM known GROUP BY 1),
pairs AS (SELECT DISTINCT a, b FROM na, kb WHERE abs(length(a) - length(b)) <= 0.3 * (length(a) + length(b)))"""
NEAREST = """nearest AS (SELECT name, raw, manufacturer, score FROM (SELECT name, raw, manufacturer, score, row_number() OVER (PARTITION BY name ORDER BY score DESC, raw) AS r
  FROM na JOIN sim USING (a) JOIN kb USING (b) WHERE score >= 70) WHERE r = 1)"""


@query("SELECT * FROM nearest", CLEAN + ", " + FUZZY + ", " + LCS_SQL + ", " + NEAREST)
def resolve_similar(spark, sf_dir):
    rows = cleaned(spark, sf_dir)
    misses = rows.where("Part_Manuf like 'Suplier%'").select(F.col("Part_Manuf").alias("name")).distinct()
    known = mining.raw_manufacturers(rows.where("Part_Manuf like 'Supplier%'")).where("size(names) = 1").select("raw", F.col("names")[0].alias("manufacturer"))
    return resolving.by_similarity(misses, known)


@query(
    """SELECT seq, CASE WHEN Part_Desc LIKE '%small%' AND Part_Desc NOT LIKE '%red%' THEN 'Small Holding Inc' WHEN Part_Desc LIKE '%red%' AND Part_Desc NOT LIKE '%small%' THEN 'Redder red Company' END AS manufacturer
  FROM (SELECT seq, ' ' || lower(Part_Desc) || ' ' AS Part_Desc FROM feed) WHERE (Part_Desc LIKE '% small %') <> (Part_Desc LIKE '% ring %')""".replace(
        """CASE WHEN Part_Desc LIKE '%small%' AND Part_Desc NOT LIKE '%red%' THEN 'Small Holding Inc' WHEN Part_Desc LIKE '%red%' AND Part_Desc NOT LIKE '%small%' THEN 'Redder red Company' END""",
        "CASE WHEN Part_Desc LIKE '% small %' THEN 'Small Holding Inc' ELSE 'Ring Company' END",
    )
)
def resolve_by_description(spark, sf_dir):
    makers = spark.createDataFrame([("Small Holding Inc",), ("Ring Company",), ("A Co",)], "manufacturer string")
    return resolving.by_description(sources.feed(spark, sf_dir), makers)


RESOLVED = """named AS (SELECT Part_Manuf AS raw, count(DISTINCT manufacturer) AS n, min(manufacturer) AS manufacturer, array_to_string(list_sort(list_distinct(list(manufacturer))), '|') AS names
  FROM branded WHERE Part_Manuf IS NOT NULL AND Part_Manuf NOT LIKE 'Suplier%' GROUP BY 1),
pairs_b AS (SELECT lower(brand) AS key, min(manufacturer) AS manufacturer FROM branded WHERE brand IS NOT NULL GROUP BY 1),
cascade AS (SELECT seq, CASE WHEN Part_Manuf IS NULL THEN CASE WHEN p.manufacturer IS NULL THEN 'UNRESOLVED' ELSE 'RESOLVED' END
    WHEN n = 1 THEN 'RESOLVED' WHEN n > 1 THEN 'NEEDS_DISAMBIGUATION' WHEN s.score >= 85 THEN 'RESOLVED' WHEN s.score >= 70 THEN 'NEEDS_REVIEW' ELSE 'UNRESOLVED' END AS status,
    CASE WHEN n = 1 THEN named.manufacturer WHEN n IS NULL AND Part_Manuf IS NOT NULL THEN s.manufacturer WHEN Part_Manuf IS NULL THEN p.manufacturer END AS manufacturer_name,
    CASE WHEN n = 1 THEN Part_Manuf WHEN s.raw IS NOT NULL THEN s.raw WHEN Part_Manuf IS NULL AND p.manufacturer IS NOT NULL THEN '[brand fallback: ''' || brand || ''']' END AS matched_raw,
    CASE WHEN n = 1 OR Part_Manuf IS NULL AND p.manufacturer IS NOT NULL THEN 100.0 WHEN n IS NULL THEN s.score END AS match_score, CASE WHEN n > 1 THEN names END AS candidates
  FROM branded LEFT JOIN named ON raw = Part_Manuf LEFT JOIN pairs_b p ON p.key = lower(brand) LEFT JOIN nearest s ON s.name = Part_Manuf)"""
CASCADE = ", ".join([CLEAN, FUZZY, LCS_SQL, NEAREST, RESOLVED])


@query("SELECT c.seq, status, manufacturer_name, domain, matched_raw, match_score, candidates FROM cascade c LEFT JOIN domains d ON d.manufacturer = manufacturer_name", URLS + ", " + CASCADE)
def resolve_cascade(spark, sf_dir):
    return cascade_of(cleaned(spark, sf_dir)).select("seq", "status", "manufacturer_name", "domain", "matched_raw", "match_score", F.array_join("candidates", "|").alias("candidates"))


def cascade_of(rows: DataFrame) -> DataFrame:
    names = mining.raw_manufacturers(rows.where("not Part_Manuf like 'Suplier%'"))
    brands = rows.where("brand is not null").groupBy(X.brand_key(F.col("brand")).alias("key")).agg(F.min("manufacturer").alias("manufacturer"))
    return resolving.resolve(rows.select("seq", "Part_Manuf", "brand", "Part_Desc", "Mfg_Part_Num"), names, brands, mining.domains(rows))


# ---------------------------------------------------------------- reconciliation

EXTRACTED = """extracted AS (SELECT seq, label, value || CASE WHEN uom <> '' THEN ' ' || uom ELSE '' END AS value FROM attributes
  WHERE value <> '' AND (slot IN (4, 5) OR slot = 1 AND seq % 3 = 0 OR slot = 3 AND seq % 5 = 0))"""
RECONCILED = """slots AS (SELECT f.seq, f.classpath, t.slot, t.label, t.uom_hint, coalesce(CASE WHEN uom_hint <> '' AND length(e.value) > length(uom_hint) AND lower(right(e.value, length(uom_hint))) = lower(uom_hint)
    AND regexp_matches(replace(trim(substr(e.value, 1, length(e.value) - length(uom_hint))), ' to ', '/'), '^[\\d.\\-/,\\s]+$') THEN trim(substr(e.value, 1, length(e.value) - length(uom_hint))) ELSE e.value END, '') AS v
  FROM feed f JOIN templates t USING (classpath) LEFT JOIN extracted e ON e.seq = f.seq AND e.label = t.label),
ranked AS (SELECT *, v = '' AND uom_hint <> '' AS claims, row_number() OVER (PARTITION BY seq, v = '' AND uom_hint <> '', uom_hint ORDER BY slot) AS k FROM slots),
queue AS (SELECT seq, uom, value, row_number() OVER (PARTITION BY seq, uom ORDER BY pos) AS k FROM priors),
same AS (SELECT seq, value, arg_max(uom, pos) AS said FROM priors GROUP BY 1, 2),
reconciled AS (SELECT r.seq, r.classpath, r.slot, r.label, CASE WHEN v <> '' THEN v ELSE coalesce(q.value, '') END AS value,
    CASE WHEN v <> '' THEN coalesce(said, uom_hint) WHEN q.value IS NOT NULL THEN uom_hint ELSE '' END AS uom,
    CASE WHEN v <> '' THEN 'llm_extract' WHEN q.value IS NOT NULL THEN 'rule_prior' END AS origin
  FROM ranked r LEFT JOIN queue q ON q.seq = r.seq AND q.uom = r.uom_hint AND q.k = r.k AND r.claims LEFT JOIN same s ON s.seq = r.seq AND s.value = r.v)"""
REC = ", ".join([TEMPLATES, PRIORS, EXTRACTED, RECONCILED])


def extracted_of(rows: DataFrame) -> DataFrame:
    a = sources.attributes(rows).where("value <> '' and (slot in (4, 5) or slot = 1 and seq % 3 = 0 or slot = 3 and seq % 5 = 0)")
    return a.select("seq", "label", F.concat("value", F.when(F.col("uom") != "", F.concat(F.lit(" "), "uom")).otherwise("")).alias("value"))


def reconciled_of(rows: DataFrame) -> DataFrame:
    templates = mining.templates(sources.attributes(rows))
    return reconciling.reconcile(rows, templates, reconciling.usable(extracted_of(rows), rows, templates), priors_of(rows))


@query("SELECT seq, classpath, slot, label, value, uom, origin FROM reconciled", REC)
def reconcile_slots(spark, sf_dir):
    return reconciled_of(fed(spark, sf_dir))


PROV = """sourced AS (SELECT r.*, CASE WHEN value <> '' AND origin = 'llm_extract' AND r.seq % 2 = 0 THEN mfr_url END AS source_url,
  CASE WHEN value <> '' THEN CASE WHEN origin = 'llm_extract' AND r.seq % 2 = 0 THEN
    CASE WHEN instr(lower(Part_Desc), lower(value)) > 0 THEN CASE WHEN instr(lower(Part_Desc), lower(value)) > 81 THEN '...' ELSE '' END
      || trim(substr(Part_Desc, greatest(instr(lower(Part_Desc), lower(value)) - 81, 0) + 1, least(instr(lower(Part_Desc), lower(value)) - 1 + length(value) + 80, length(Part_Desc)) - greatest(instr(lower(Part_Desc), lower(value)) - 81, 0))) || '...'
    ELSE trim(substr(Part_Desc, 1, 160)) END ELSE Part_Desc END END AS evidence_text
  FROM reconciled r JOIN feed f USING (seq)))"""
PROV = PROV.rsplit(")", 1)[0]


def sourced_of(rows: DataFrame) -> DataFrame:
    path = F.when(F.col("seq") % 2 == 0, "web").otherwise("desc_fallback")
    where = rows.select("seq", "Part_Desc", path.alias("path"), F.col("mfr_url").alias("page_url"), F.col("Part_Desc").alias("page_text"), F.lit(None).cast("string").alias("chart_url"), F.lit(None).cast("array<string>").alias("chart_labels"))
    return reconciling.provenance(reconciled_of(rows), where)


@query("SELECT seq, slot, label, value, source_url, evidence_text FROM sourced".replace("FROM sourced", "FROM (SELECT seq, slot, label, value, source_url, evidence_text FROM sourced)"), REC + ", " + PROV.replace("SELECT r.*, ", "SELECT r.seq, r.classpath, r.slot, r.label, r.value, r.uom, r.origin, "))
def provenance(spark, sf_dir):
    return sourced_of(fed(spark, sf_dir)).select("seq", "slot", "label", "value", "source_url", "evidence_text")


# ---------------------------------------------------------------- validation and score

ALLOWED = """allowed AS (SELECT classpath, label, list(DISTINCT value) AS vs FROM attributes WHERE value <> '' AND label <> 'Length' GROUP BY 1, 2),
typed AS (SELECT seq, classpath, slot, label, CASE WHEN label = 'Finish' AND seq % 10 = 3 THEN value || 's' WHEN label = 'Line' AND seq % 10 = 4 THEN 'zzz' ELSE value END AS value, uom, origin, source_url, evidence_text FROM sourced),
misses AS (SELECT DISTINCT t.classpath, t.label, t.value, unnest(vs) AS v FROM typed t JOIN allowed USING (classpath, label) WHERE t.value <> '' AND NOT list_contains(vs, t.value)),
pairs AS (SELECT DISTINCT lower(value) AS a, lower(v) AS b FROM misses)"""
CHECKED = """fix AS (SELECT classpath, label, value, CASE WHEN score >= 90 THEN v END AS fixed, score FROM (SELECT m.*, score, row_number() OVER (PARTITION BY classpath, label, value ORDER BY score DESC, v) AS r FROM misses m JOIN sim ON a = lower(value) AND b = lower(v)) WHERE r = 1),
lov AS (SELECT t.* REPLACE (coalesce(fixed, t.value) AS value), t.value AS was, CASE WHEN fixed IS NOT NULL THEN true WHEN max(fixed IS NOT NULL) OVER (PARTITION BY seq) THEN NULL WHEN t.value = '' THEN NULL ELSE vs IS NULL OR list_contains(vs, t.value) END AS lov_valid,
  t.value <> '' AND vs IS NOT NULL AND NOT list_contains(vs, t.value) AND fixed IS NULL AS lov_miss, CASE WHEN t.value <> '' AND vs IS NOT NULL AND NOT list_contains(vs, t.value) THEN score END AS lov_score
  FROM typed t LEFT JOIN allowed USING (classpath, label) LEFT JOIN fix ON fix.classpath = t.classpath AND fix.label = t.label AND fix.value = t.value)"""
PROVS = PROV.replace("SELECT r.*, ", "SELECT r.seq, r.classpath, r.slot, r.label, r.value, r.uom, r.origin, ")
LOV = ", ".join([REC, PROVS, ALLOWED, LCS_SQL, CHECKED])


def checked_of(rows: DataFrame) -> DataFrame:
    allowed = sources.attributes(rows).where("value <> '' and label <> 'Length'").groupBy("classpath", "label").agg(F.array_sort(F.collect_set("value")).alias("values"))
    v, seq = F.col("value"), F.col("seq")
    typed = F.when((F.col("label") == "Finish") & (seq % 10 == 3), F.concat(v, F.lit("s"))).when((F.col("label") == "Line") & (seq % 10 == 4), "zzz").otherwise(v)
    return validating.repaired(sourced_of(rows).withColumn("value", typed), allowed)


@query("SELECT seq, slot, value, was, lov_valid, lov_miss, round(lov_score, 6) AS lov_score FROM lov", LOV)
def repair_values(spark, sf_dir):
    return checked_of(fed(spark, sf_dir)).select("seq", "slot", "value", "was", "lov_valid", "lov_miss", F.round("lov_score", 6).alias("lov_score"))


VALIDATED = """makers AS (SELECT brand, manufacturer AS maker FROM (SELECT brand, manufacturer, row_number() OVER (PARTITION BY brand ORDER BY count(*) DESC, min(seq), manufacturer) AS r FROM branded WHERE brand IS NOT NULL GROUP BY 1, 2) WHERE r = 1),
per AS (SELECT seq, coalesce(max(lov_miss), false) AS miss, coalesce(max(value <> '' AND uom <> '' AND NOT contains(replace(lower(value), ' ', ''), lower(uom))), false) AS unit,
  max(value <> '' AND source_url IS NULL AND evidence_text IS NULL) AS bare,
  list(CASE WHEN lov_score IS NULL THEN NULL WHEN lov_miss THEN printf('V2: ''%s'' value ''%s'' not found in known LOV for %s (best match %.1f)', label, value, classpath, lov_score) ELSE printf('V2: repaired ''%s'' value ''%s'' -> ''%s'' (fuzzy match %.1f)', label, was, value, lov_score) END ORDER BY slot) AS w2,
  list(CASE WHEN value <> '' AND uom <> '' AND NOT contains(replace(lower(value), ' ', ''), lower(uom)) THEN printf('V3: ''%s'' value ''%s'' does not carry expected UOM ''%s''', label, value, uom) END ORDER BY slot) AS w3,
  list(CASE WHEN value = '' OR source_url IS NOT NULL THEN NULL WHEN evidence_text IS NULL THEN printf('V6: ''%s'' value ''%s'' has no source_url AND no evidence_text', label, value) ELSE printf('V6: ''%s'' value ''%s'' provenance is text-only (rule_prior or LOV-fallback), no source_url', label, value) END ORDER BY slot) AS w6,
  count(*) AS n, count_if(value <> '') AS filled, count_if(value <> '' AND source_url IS NOT NULL) AS found, count_if(value <> '' AND lov_valid IS NOT NULL) AS flagged, count_if(value <> '' AND coalesce(lov_valid, false)) AS valid FROM lov GROUP BY 1),
validated AS (SELECT b.seq, b.classpath, b.manufacturer, brand, coalesce(Mfg_Part_Num, '') <> '' AND coalesce(desc_, '') <> '' AND coalesce(b.classpath, '') <> '' AS v1_required, NOT miss AS v2_lov, NOT unit AS v3_uom_inline,
  INVOICE_DESC = upper(INVOICE_DESC) AS v4_casing_inline, coalesce(maker = b.manufacturer, true) AS v5_brand_mfr, NOT bare AS v6_source_url, n, filled, found, flagged, valid,
  list_filter(list_concat([CASE WHEN coalesce(Mfg_Part_Num, '') = '' THEN 'V1: Mfg_Part_Num is required but missing' END, CASE WHEN coalesce(desc_, '') = '' THEN 'V1: Part_Desc is required but missing' END,
    CASE WHEN coalesce(b.classpath, '') = '' THEN 'V1: could not classify to a leaf Classpath' END], w2, w3, [CASE WHEN INVOICE_DESC <> upper(INVOICE_DESC) THEN 'V4: ''INVOICE_DESC'' casing does not match field-aware contract' END,
    CASE WHEN maker <> b.manufacturer THEN printf('V5: brand ''%s'' expected manufacturer ''%s'', got ''%s''', brand, maker, b.manufacturer) END], w6), lambda x: x IS NOT NULL) AS warnings
  FROM (SELECT * REPLACE (CASE WHEN seq % 17 = 0 THEN NULL ELSE manufacturer END AS manufacturer, CASE WHEN seq % 19 = 0 THEN '' ELSE classpath END AS classpath), CASE WHEN seq % 13 <> 0 THEN Part_Desc END AS desc_,
    CASE WHEN seq % 2 = 0 THEN upper(Part_Desc) ELSE Part_Desc END AS INVOICE_DESC FROM branded) b JOIN per USING (seq) LEFT JOIN makers USING (brand))"""


def validated_of(rows: DataFrame, checked: DataFrame, how=validating.validate) -> DataFrame:
    makers = mining.brand_pairs(rows)
    seq = F.col("seq")
    gaps = [F.when(seq % 13 != 0, F.col("Part_Desc")).alias("Part_Desc"), F.when(seq % 19 == 0, "").otherwise(F.col("classpath")).alias("classpath"), F.when(seq % 17 != 0, F.col("manufacturer")).alias("manufacturer_name")]
    products = rows.select("seq", "Mfg_Part_Num", *gaps, "brand", F.when(F.col("seq") % 2 == 0, F.upper("Part_Desc")).otherwise(F.col("Part_Desc")).alias("INVOICE_DESC"), F.lit(None).cast("string").alias("MOBILE_DESC"))
    return how(products, checked, makers)


FLAGS = ["v1_required", "v2_lov", "v3_uom_inline", "v4_casing_inline", "v5_brand_mfr", "v6_source_url"]


@query(
    f"""SELECT seq, {", ".join(FLAGS)}, NOT (v1_required AND v5_brand_mfr) AS needs_review, array_to_string(warnings, '|') AS warnings FROM validated""",
    ", ".join([CLEAN, LOV, VALIDATED]),
)
def validate_products(spark, sf_dir):
    rows = cleaned(spark, sf_dir)
    return validated_of(rows, checked_of(rows)).select("seq", *FLAGS, "needs_review", F.array_join("warnings", "|").alias("warnings"))


SCORE = """graded AS (SELECT validated.*, CASE WHEN found > 0 THEN 1.0 WHEN classpath <> '' AND coalesce(manufacturer, brand) IS NOT NULL THEN 0.5 ELSE 0.0 END AS s, filled / n AS e, CASE WHEN filled = 0 THEN 0.0 WHEN flagged > 0 THEN valid / filled ELSE CASE WHEN v2_lov THEN 1.0 ELSE 0.0 END END AS l,
  CASE WHEN v1_required AND v5_brand_mfr THEN 1.0 ELSE 0.0 END AS r FROM validated),
marked AS (SELECT *, round(100 * (0.35 * CAST(s AS DOUBLE) + 0.30 * e + 0.20 * CAST(l AS DOUBLE) + 0.10 * CAST(r AS DOUBLE)), 2) AS confidence FROM graded)"""


@query("SELECT seq, confidence, CASE WHEN confidence >= 90 THEN 'VERIFIED' WHEN confidence >= 70 THEN 'REVIEW' ELSE 'LOW' END AS band FROM marked", ", ".join([CLEAN, LOV, VALIDATED, SCORE]))
def score_products(spark, sf_dir):
    rows = cleaned(spark, sf_dir)
    return validated_of(rows, checked_of(rows), validating.scored).select("seq", "confidence", "band")


@query("SELECT flag, CAST(count_if(ok) AS BIGINT) AS passed, CAST(count_if(NOT ok) AS BIGINT) AS failed FROM (" + " UNION ALL ".join(f"SELECT '{f}' AS flag, {f} AS ok FROM validated" for f in FLAGS) + ") GROUP BY 1", ", ".join([CLEAN, LOV, VALIDATED]))
def replay_flags(spark, sf_dir):
    rows = cleaned(spark, sf_dir)
    return evaluating.replay(validated_of(rows, checked_of(rows)), FLAGS)


INPUTS = ["source_strength", "extraction_conf", "lov_match", "rule_validation"]
REPORT = """said AS (SELECT *, NOT (v1_required AND v5_brand_mfr) AS needs_review, CASE WHEN confidence >= 90 THEN 'VERIFIED' WHEN confidence >= 70 THEN 'REVIEW' ELSE 'LOW' END AS band FROM marked),
truth AS (SELECT seq, a.label, a.value AS want, l.value AS got FROM attributes a LEFT JOIN (SELECT seq, label, value FROM lov WHERE value <> '') l USING (seq, label) WHERE a.value <> ''),
hits AS (SELECT seq, count_if(coalesce(got = want, false)) AS hit, count_if(NOT coalesce(got = want, false)) AS off FROM truth GROUP BY 1),
told AS (SELECT said.*, CASE WHEN classpath <> '' THEN coalesce(hit, 0) ELSE 0 END AS hit, CASE WHEN classpath <> '' THEN coalesce(off, 0) ELSE 0 END AS off FROM said LEFT JOIN hits USING (seq))"""
SECTIONS = [*((f, f"CAST({f} AS VARCHAR)") for f in [*FLAGS, "needs_review"]), ("band", "band"), ("all", "''")]


@query(
    " UNION ALL ".join(
        f"SELECT '{name}' AS section, {value} AS value, count(*) AS products, CAST(sum(hit) AS BIGINT) AS \"right\", CAST(sum(off) AS BIGINT) AS wrong, round(avg(s), 6) AS mean_source_strength, round(avg(e), 6) AS mean_extraction_conf, round(avg(l), 6) AS mean_lov_match, round(avg(r), 6) AS mean_rule_validation FROM told GROUP BY 2"
        for name, value in SECTIONS
    ),
    ", ".join([CLEAN, LOV, VALIDATED, SCORE, REPORT]),
)
def replay_report(spark, sf_dir):
    """Validators, bands, bands against labelled attributes and mean inputs of the score, in one pass."""
    rows = cleaned(spark, sf_dir)
    checked = kept(checked_of(rows), "checked")
    scored = validated_of(rows, dealt(checked, checked.count(), "seq", rows=SLOTS), validating.scored)
    return evaluating.replay_report(scored, checked, sources.attributes(rows), [*FLAGS, "needs_review"], INPUTS)


# ---------------------------------------------------------------- descriptions

LED_ROWS = f"""led AS (SELECT seq, Mfg_Part_Num AS mpn, CASE WHEN seq % 3 = 0 THEN classpath ELSE '{describing.LED}' END AS classpath, manufacturer,
  CAST(p_size AS VARCHAR) AS w, CASE WHEN seq % 5 = 1 THEN '' ELSE CAST(p_size * 100 AS VARCHAR) END AS lm, ['A19', 'T9', 'BR30', 'B11', 'ST19'][seq % 5 + 1] AS code,
  CASE WHEN seq % 4 = 1 THEN '2200 to 2700' WHEN seq % 4 = 2 THEN '' ELSE '2700' END AS ct, CASE WHEN seq % 2 = 0 THEN 'Medium' ELSE 'Candelabra' END AS base, CASE WHEN seq % 7 = 0 THEN '' ELSE 'E26' END AS bc,
  CASE WHEN seq % 6 = 0 THEN 'Amber' ELSE 'Warm White' END AS look, CASE WHEN seq % 8 = 0 THEN 'Glass Housing' WHEN seq % 8 = 1 THEN 'Plastic Housing' ELSE '' END AS info, CASE WHEN seq % 3 = 1 THEN '120' ELSE '' END AS beam FROM feed),
nouns AS (SELECT *, contains(info, 'Glass') OR (NOT contains(info, 'Plastic') AND (starts_with(code, 'T') OR starts_with(code, 'ST'))) AS fil, starts_with(code, 'B') AND NOT starts_with(code, 'BR') AS candle,
  classpath = '{describing.LED}' AS is_led, CASE WHEN ends_with(split_part(classpath, '>', 2), 's') AND NOT ends_with(split_part(classpath, '>', 2), 'ss') THEN left(split_part(classpath, '>', 2), -1) ELSE split_part(classpath, '>', 2) END AS leaf FROM led),
named AS (SELECT *, CASE WHEN is_led THEN 'LED' || CASE WHEN fil THEN ' Filament' ELSE '' END || CASE WHEN candle THEN ' Candle' ELSE ' Bulb' END ELSE leaf END AS noun FROM nouns)"""


def led_rows(spark, sf_dir) -> DataFrame:
    seq = F.col("seq")
    pick = lambda *v: F.element_at(F.array(*[F.lit(x) for x in v]), (seq % len(v) + 1).cast("int"))
    labels = [
        ("Wattage", F.col("p_size").cast("string"), "W"), ("Lumens", F.when(seq % 5 == 1, "").otherwise((F.col("p_size") * 100).cast("string")), "Lumens"), ("Bulb Shape Code", pick("A19", "T9", "BR30", "B11", "ST19"), ""),
        ("Color Temperature", F.when(seq % 4 == 1, "2200 to 2700").when(seq % 4 == 2, "").otherwise("2700"), "K"), ("Bulb Base", F.when(seq % 2 == 0, "Medium").otherwise("Candelabra"), ""),
        ("Bulb Base Code", F.when(seq % 7 == 0, "").otherwise("E26"), ""), ("Light Appearance", F.when(seq % 6 == 0, "Amber").otherwise("Warm White"), ""),
        ("Additional Information", F.when(seq % 8 == 0, "Glass Housing").when(seq % 8 == 1, "Plastic Housing").otherwise(""), ""), ("Beam Angle", F.when(seq % 3 == 1, "120").otherwise(""), "deg"),
    ]
    rows = sources.feed(spark, sf_dir)
    slots = F.explode(F.array(*[F.struct(F.lit(i).alias("slot"), F.lit(n).alias("label"), v.alias("value"), F.lit(u).alias("uom")) for i, (n, v, u) in enumerate(labels, 1)])).alias("s")
    maps = describing.attribute_maps(rows.select("seq", slots).select("seq", "s.*"))
    led = F.when(seq % 3 == 0, F.col("classpath")).otherwise(describing.LED)
    return rows.select("seq", "Mfg_Part_Num", F.col("manufacturer").alias("manufacturer_name"), led.alias("classpath")).join(maps, "seq")


def opt(c: str, pre: str = "", post: str = "") -> str:
    return f"CASE WHEN {c} <> '' THEN '{pre}' || {c} || '{post}' ELSE '' END"


def pack(base: str, tokens: str) -> str:
    return f"list_reduce(list_concat([{base}], list_filter({tokens}, lambda x: x IS NOT NULL)), lambda a, t: CASE WHEN length(a) + length(t) + 1 <= 40 THEN a || ' ' || t ELSE a END)"


INVOICE = pack(
    f"CASE WHEN candle THEN 'CANDLE' ELSE 'BULB' END || CASE WHEN fil THEN ' FIL' ELSE '' END || ' LED' || {opt('lm', ' ', 'LUMENS')} || {opt('w', ' ', 'W')} || {opt('code', ' ')}",
    "[CASE WHEN ct <> '' AND NOT contains(ct, ' to ') THEN ct || 'K' END, CASE WHEN base = 'Medium' THEN 'MDM' END, CASE WHEN bc <> '' THEN bc END, CASE WHEN lower(look) = 'amber' THEN 'AMB' END]",
)
GENERIC = pack("upper(leaf)", "list_transform(list_filter([w, lm, code, ct, base, bc, look, info, beam], lambda x: x <> '' AND NOT contains(x, ' to ')), lambda x: upper(x))")
JOINED = lambda parts, sep: f"array_to_string(list_filter([{parts}], lambda x: x <> ''), '{sep}')"
RETAIL = f"regexp_replace(trim({JOINED("noun || ',', " + opt('w', '', ' W,') + ", base || ',', " + opt('ct', '', ' K,') + ', ' + opt('lm', '', ' Lumens,') + ', ' + opt('beam', '', ' deg Beam'), ' ')}), ',$', '')"
LONG = JOINED(
    "manufacturer || ' ' || noun, " + ", ".join([opt("w", "", " W Wattage"), opt("lm", "", " Lumens Lumens"), opt("code", "", " Bulb Shape Code"), opt("ct", "", " K"), opt("base", "", " Bulb Base"), opt("bc", "", " Bulb Base Code"), opt("look", "Light Appearance: "), opt("info", "Additional Information: "), opt("beam", "", " deg Beam Angle")]),
    ", ",
)


@query(
    f"""SELECT seq, CASE WHEN is_led THEN {INVOICE} ELSE {GENERIC} END AS INVOICE_DESC,
  {JOINED("manufacturer, noun, mpn, w || 'W', base, CASE WHEN ct <> '' AND NOT contains(ct, ' to ') THEN ct || 'K' ELSE '' END", ", ")} AS MOBILE_DESC,
  manufacturer || ' ' || mpn || ' ' || {RETAIL} AS SHORT_DESC, {RETAIL} AS RETAIL_DESC, CASE WHEN is_led THEN {LONG} END AS LONG_DESC1 FROM named""",
    LED_ROWS,
)
def describe_products(spark, sf_dir):
    out = describing.describe(led_rows(spark, sf_dir))
    return out.select("seq", "INVOICE_DESC", "MOBILE_DESC", "SHORT_DESC", "RETAIL_DESC", "LONG_DESC1")


@query(
    """SELECT seq, CASE WHEN manufacturer = 'NATION_7' AND CASE WHEN code = 'ST19' THEN 'T19' ELSE code END || ct IN ('A192700', 'T192700', 'A192200 to 2700', 'T192200 to 2700') THEN 'copy ' || CASE WHEN code = 'ST19' THEN 'T19' ELSE code END END AS marketing FROM led""",
    LED_ROWS,
)
def template_copy(spark, sf_dir):
    table = spark.createDataFrame([("A19", 2700, "copy A19"), ("T19", 2700, "copy T19")], "shape string, ct int, marketing string")
    out = describing.template_copy(led_rows(spark, sf_dir), table, "NATION_7", {"ST19": "T19"})
    # a range is keyed by its last number
    return out.select("seq", "marketing")


@query(
    """SELECT seq, whole || '.' || part AS value, CASE WHEN n IS NULL THEN whole || '.' || part WHEN whole = '0' THEN n ELSE whole || '-' || n END AS fraction FROM (
  SELECT seq, CAST(seq % 3 AS VARCHAR) AS whole, part, CASE part WHEN '25' THEN '1/4' WHEN '5' THEN '1/2' WHEN '1875' THEN '3/16' WHEN '015625' THEN '1/64' END AS n
  FROM (SELECT seq, ['25', '18', '5', '1875', '015625', '0'][seq % 6 + 1] AS part FROM feed))"""
)
def fractions(spark, sf_dir):
    rows = sources.feed(spark, sf_dir).select("seq", F.concat((F.col("seq") % 3).cast("string"), F.lit("."), F.element_at(F.array(*[F.lit(x) for x in ("25", "18", "5", "1875", "015625", "0")]), (F.col("seq") % 6 + 1).cast("int"))).alias("value"))
    return rows.withColumn("fraction", X.fraction(F.col("value")))


@query("SELECT seq, array_to_string(list_transform(regexp_extract_all(lower(Part_Desc), '[a-z]+|[^a-z]+'), lambda x: upper(x[1]) || x[2:]), '') AS titled FROM feed")
def title_casing(spark, sf_dir):
    return sources.feed(spark, sf_dir).select("seq", X.title_case(F.col("Part_Desc")).alias("titled"))


# ---------------------------------------------------------------- export

WIDE = [*sources.RAW, "Classpath", "MFR URL", *[f"ATTRIBUTE_{k} {i}" for i in (1, 2, 3, 4, 5, 6) for k in ("LABEL", "VALUE", "UOM")]]


def products_of(spark, sf_dir) -> DataFrame:
    rows = fed(spark, sf_dir)
    raw = F.create_map(*[x for c in sources.RAW for x in (F.lit(c), F.col(c))]).alias("raw")
    base = rows.select("seq", raw, *[X.clean_value(F.col(c)).alias(c) for c in ("Mfg_Part_Num", "Part_Desc", "Part_Manuf")], F.col("manufacturer").alias("manufacturer_name"), F.lit(None).cast("string").alias("brand"), "classpath", "mfr_url")
    base = base.withColumns({"ref_urls": F.expr("cast(array() as array<string>)"), "features": F.expr("cast(array() as array<string>)"), **{t: F.lit(None).cast("string") for t in exporting.TEXTS}})
    return base.join(rowwise(exporting.slot_maps(reconciled_of(rows))), "seq", "left")


@query(
    "SELECT f.seq, Mfg_Part_Num, Part_Desc, E1_Brand, Unilog_Brand, DIB_Brand, Part_Manuf, classpath AS \"Classpath\", mfr_url AS \"MFR URL\", "
    + ", ".join(f"coalesce(p.{k.lower()}{i}, '') AS \"ATTRIBUTE_{k} {i}\"" for i in range(1, 7) for k in ("LABEL", "VALUE", "UOM"))
    + " FROM feed f LEFT JOIN (SELECT seq, "
    + ", ".join(f"max({k}) FILTER (slot = {i}) AS {k}{i}" for i in range(1, 7) for k in ("label", "value", "uom"))
    + " FROM reconciled GROUP BY 1) p USING (seq)",
    REC,
)
def delivery_rows(spark, sf_dir):
    return exporting.delivery(products_of(spark, sf_dir), WIDE)


@query(
    """SELECT key, nth, "column", old, new FROM (SELECT Mfg_Part_Num AS key, row_number() OVER (PARTITION BY Mfg_Part_Num ORDER BY seq) AS nth, Part_Desc AS a, CASE WHEN seq % 10 = 0 THEN Part_Desc || '!' ELSE Part_Desc END AS b, classpath AS c FROM feed),
  LATERAL (SELECT 'Part_Desc' AS "column", a AS old, b AS new) WHERE old <> new""".replace("nth,", "CAST(nth AS INTEGER) AS nth,", 1)
)
def export_differences(spark, sf_dir):
    old = sources.feed(spark, sf_dir).select("seq", F.col("Mfg_Part_Num").alias("key"), "Part_Desc", "classpath")
    new = old.withColumn("Part_Desc", F.when(F.col("seq") % 10 == 0, F.concat("Part_Desc", F.lit("!"))).otherwise(F.col("Part_Desc")))
    return exporting.differences(old, new, "key", "seq")


@query(
    """SELECT seq, CASE WHEN k = 0 THEN sha256('j|' || Mfg_Part_Num || '|{not valid json') ELSE 'p' || CAST(seq AS VARCHAR) END AS product_id, Mfg_Part_Num AS mfg_part_num, CASE WHEN k <= 2 OR seq % 3 = 0 THEN '' ELSE Part_Desc END AS part_desc,
  CASE k WHEN 1 THEN 'EXPORT_VALIDATION_FAILED: confidence_band' WHEN 2 THEN 'EXPORT_VALIDATION_FAILED: confidence' END AS row_error, CASE WHEN k < 3 THEN 0 ELSE 1 END AS slots, CASE WHEN k > 2 THEN classpath END AS label
  FROM (SELECT *, seq % 7 AS k FROM feed)"""
)
def stored_products(spark, sf_dir):
    """Stored JSON read back: no JSON, values that no product has, absent fields."""
    rows = sources.feed(spark, sf_dir).withColumn("k", F.col("seq") % 7)
    slot = F.array(F.struct(F.lit(1).alias("slot"), F.col("classpath").alias("label")))
    band, score = F.when(F.col("k") == 1, "HIGH").otherwise("LOW"), F.when(F.col("k") == 2, 500.0).otherwise(50.0)
    good = F.to_json(F.struct(F.concat(F.lit("p"), F.col("seq").cast("string")).alias("product_id"), F.when(F.col("seq") % 3 != 0, F.col("Part_Desc")).alias("part_desc"), band.alias("confidence_band"), score.alias("confidence"), slot.alias("attributes")))
    stored = rows.select("seq", F.lit("j").alias("job_id"), F.col("Mfg_Part_Num").alias("mfg_part_num"), F.when(F.col("k") == 0, "{not valid json").otherwise(good).alias("data_json"))
    r = records.parsed(stored).select("seq", "record.*")
    return r.select("seq", "product_id", "mfg_part_num", "part_desc", "row_error", F.size("attributes").alias("slots"), F.try_element_at("attributes", F.lit(1))["label"].alias("label"))


@query(
    """SELECT a.seq, CAST(a.n AS INTEGER) AS nth, b.seq AS r_seq FROM (SELECT seq, Mfg_Part_Num AS m, row_number() OVER (PARTITION BY Mfg_Part_Num ORDER BY seq) AS n FROM feed) a
  LEFT JOIN (SELECT seq, Mfg_Part_Num AS m, row_number() OVER (PARTITION BY Mfg_Part_Num ORDER BY seq) AS n FROM feed WHERE seq % 3 <> 0) b USING (m, n)"""
)
def nth_matches(spark, sf_dir):
    rows = sources.feed(spark, sf_dir).select("seq", "Mfg_Part_Num")
    return exporting.matched(rows, rows.where("seq % 3 <> 0"), "Mfg_Part_Num", "seq").select("seq", "nth", "r_seq")


@query("SELECT Mfg_Part_Num, max(seq) AS seq, arg_max(Part_Desc, seq) AS Part_Desc FROM feed GROUP BY 1")
def last_duplicates(spark, sf_dir):
    return exporting.last_by_key(sources.feed(spark, sf_dir).select("Mfg_Part_Num", "seq", "Part_Desc"), "Mfg_Part_Num", "seq")


# ---------------------------------------------------------------- evaluation

EVAL = """want AS (SELECT seq, label, value FROM attributes WHERE value <> ''),
got AS (SELECT seq, label, arg_max(value, slot) AS got FROM reconciled WHERE value <> '' GROUP BY 1, 2),
pairs AS (SELECT DISTINCT got AS a, value AS b FROM want JOIN got USING (seq, label) WHERE got <> value AND abs(length(got) - length(value)) <= 0.15 * (length(got) + length(value)))"""
TALLY = """status AS (SELECT seq, CASE WHEN got IS NULL THEN 'MISS' WHEN got = value THEN 'EXACT' WHEN score >= 85 THEN 'CLOSE' ELSE 'MISS' END AS s FROM want LEFT JOIN got USING (seq, label) LEFT JOIN sim ON a = got AND b = value),
tally AS (SELECT seq, count(*) AS expected, CAST(count_if(s = 'EXACT') AS BIGINT) AS exact, CAST(count_if(s = 'CLOSE') AS BIGINT) AS close, CAST(count_if(s = 'MISS') AS BIGINT) AS missed FROM status GROUP BY 1)"""
EVALS = ", ".join([REC, EVAL, LCS_SQL, TALLY])


def evaluated_of(spark, sf_dir) -> DataFrame:
    rows = fed(spark, sf_dir)
    seq, w1, brand, sp = F.col("seq"), F.col("w1"), F.col("p_brand"), F.lit(" ")
    texts = [F.upper("Part_Desc").alias("INVOICE_DESC"), F.concat(w1, sp, brand).alias("MOBILE_DESC"), F.concat(w1, F.lit("x")).alias("SHORT_DESC"), F.when(seq % 3 == 0, "#").otherwise(F.when(seq % 3 == 1, w1)).alias("RETAIL_DESC")]
    products = rows.select("seq", F.when(seq % 10 == 0, "other").otherwise(F.col("classpath")).alias("classpath"), F.col("manufacturer").alias("manufacturer_name"), *texts)
    wanted = {"INVOICE_DESC": F.concat(sp, F.upper("Part_Desc"), F.when(seq % 6 == 0, "!").otherwise(" ")), "MOBILE_DESC": F.concat(brand, sp, w1), "SHORT_DESC": F.when(seq % 5 == 0, " ").otherwise(w1), "RETAIL_DESC": w1}
    return evaluating.evaluate(products, rows.where("seq % 4 <> 3").withColumns(wanted), reconciled_of(rows), sources.attributes(rows))


#: The descriptions' statuses: long texts that differ in a mark are close, and so are words in another order.
TEXT_STATUS = """texts AS (SELECT seq, seq % 4 <> 3 AS scored, CASE WHEN seq % 4 = 3 THEN 'NO_GT' WHEN seq % 6 = 0 THEN 'CLOSE' ELSE 'EXACT' END AS INVOICE_DESC_status, CASE WHEN seq % 4 = 3 THEN 'NO_GT' ELSE 'CLOSE' END AS MOBILE_DESC_status,
  CASE WHEN seq % 4 = 3 OR seq % 5 = 0 THEN 'NO_GT' WHEN 200.0 * length(w1) / (2 * length(w1) + 1) >= 85 THEN 'CLOSE' ELSE 'MISS' END AS SHORT_DESC_status, CASE WHEN seq % 4 = 3 THEN 'NO_GT' WHEN seq % 3 = 1 THEN 'EXACT' ELSE 'MISS' END AS RETAIL_DESC_status FROM feed)"""
EVALS += ", " + TEXT_STATUS


@query(
    f"SELECT seq, scored, scored AND seq % 10 <> 0 AS classpath_ok, scored AS manufacturer_ok, expected, exact, close, missed, {', '.join(f'{d}_status' for d in evaluating.DESCRIPTIONS)} FROM texts JOIN tally USING (seq)", EVALS
)
def evaluate_products(spark, sf_dir):
    return evaluated_of(spark, sf_dir)


@query(
    """SELECT count(*) AS rows_scored, CAST(count_if(seq % 10 <> 0) AS BIGINT) AS classpath_correct, round(100 * count_if(seq % 10 <> 0) / count(*), 1) AS classpath_pct, count(*) AS manufacturer_correct, 100.0::DOUBLE AS manufacturer_pct,
  CAST(sum(expected) AS BIGINT) AS attributes, CAST(sum(exact) AS BIGINT) AS exact_correct, round(100 * sum(exact) / sum(expected), 1) AS exact_pct, round(100 * sum(close) / sum(expected), 1) AS close_pct, """
    + ", ".join(f"CAST(count_if({d}_status = 'EXACT') AS BIGINT) AS {d}_correct, CAST(count_if({d}_status <> 'NO_GT') AS BIGINT) AS {d}_total, round(100 * count_if({d}_status = 'EXACT') / count_if({d}_status <> 'NO_GT'), 1) AS {d}_pct" for d in evaluating.DESCRIPTIONS)
    + " FROM tally JOIN texts USING (seq) WHERE scored",
    EVALS,
)
def evaluation_summary(spark, sf_dir):
    return evaluating.summarize(evaluated_of(spark, sf_dir))


@query("SELECT count(*) AS rows, CAST(round(100 * avg(CASE WHEN a THEN 1.0 ELSE 0.0 END)) AS BIGINT) AS any_pct, CAST(round(100 * avg(CASE WHEN p THEN 1.0 ELSE 0.0 END)) AS BIGINT) AS prior_pct FROM (SELECT seq, max(value <> '') AS a, max(value <> '' AND coalesce(origin = 'rule_prior', false)) AS p FROM reconciled GROUP BY 1)", REC)
def attribute_coverage(spark, sf_dir):
    return evaluating.coverage(reconciled_of(fed(spark, sf_dir)))


STATUSES = ["FETCHED", "BLOCKED_SOURCE", "FETCH_FAILED"]


@query(
    """SELECT host, CAST(count_if(s = 'FETCHED') AS BIGINT) AS FETCHED, CAST(count_if(s = 'BLOCKED_SOURCE') AS BIGINT) AS BLOCKED_SOURCE, CAST(count_if(s = 'FETCH_FAILED') AS BIGINT) AS FETCH_FAILED, count(*) AS total,
  round(100 * count_if(s = 'FETCHED') / count(*), 1) AS pct FROM (SELECT lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]*)', 1)) AS host,
    CASE WHEN contains(lower(url), '.net') THEN 'BLOCKED_SOURCE' WHEN page_id % 5 = 0 THEN 'FETCH_FAILED' ELSE 'FETCHED' END AS s FROM pages) GROUP BY 1"""
)
def fetch_crosstab(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/pages.parquet")
    status = pages.fetch_status(F.col("url"), resolving.blocked(F.col("url"), [".net"]), F.when(F.col("page_id") % 5 == 0, 500).otherwise(200), F.col("html"))
    return evaluating.crosstab(p.select(pages.host(F.col("url")).alias("host"), status.alias("s")), "host", "s", STATUSES)


@query(
    r"""SELECT page_id, regexp_extract(html, '(?is)<title>(.*?)</title>', 1) AS title, trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html,
  '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<nav\b.*?</nav\s*>|<footer\b.*?</footer\s*>|<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&nbsp;', ' '), '&amp;', '&'), '[ \t\n\r]+', ' ', 'g')) AS text FROM pages"""
)
def page_texts(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return p.select("page_id", F.coalesce(pages.page_title(F.col("html")), F.lit("")).alias("title"), pages.page_text(F.col("html")).alias("text"))


@query("SELECT page_id, lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]*)', 1)) AS host, url FROM pages WHERE lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]*)', 1)) IN (SELECT lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]*)', 1)) FROM pages WHERE page_id <= 5)")
def page_mirror(spark, sf_dir):
    """Pages of a few hosts from a mirror that is laid out by host."""
    p, path = spark.read.parquet(f"{sf_dir}/pages.parquet"), scratch(spark, "mirror")
    pages.write_mirror(p, path)
    hosts = [r[0] for r in p.where("page_id <= 5").select(pages.host(F.col("url"))).distinct().collect()]  # of six pages
    return pages.scan_mirror(spark, path, hosts, ["page_id", "host", "url"])


@query("SELECT seq, classpath FROM (SELECT seq, classpath, row_number() OVER (PARTITION BY p_size > 45 ORDER BY seq) - 1 AS n, p_size > 45 AS k FROM feed) WHERE k OR n % 7 = 0")
def stride_sample(spark, sf_dir):
    """A sampling operator: all rows of one kind and every seventh of the others."""
    return evaluating.stride_sample(sources.feed(spark, sf_dir), "seq", F.col("p_size") > 45, 7).select("seq", "classpath")


# ---------------------------------------------------------------- layout

#: A sheet of words from each part: label words at 310, value words at 410, on lines 12 apart.
SHEETS = """words AS (SELECT CAST(p_partkey AS VARCHAR) AS doc, l AS line, w FROM part, (SELECT unnest(range(3)) AS l) t, LATERAL (SELECT CASE l WHEN 0 THEN 'Wattage ' || CAST(p_size AS VARCHAR) || 'W' WHEN 1 THEN 'Line ' || p_brand ELSE 'Type ' || p_type END AS w) u)"""


def sheet_words(spark, sf_dir) -> DataFrame:
    p = sources.spread(spark.read.parquet(f"{sf_dir}/part.parquet"), "p_partkey")
    word = lambda text, x0, line: F.struct(text.alias("text"), F.lit(float(x0)).alias("x0"), F.lit(float(x0) + 30).alias("x1"), (F.lit(100.0 + 12 * line) + (F.col("p_partkey") % 3) * (0.5 if x0 > 400 else 0.0)).alias("top"))
    values = [F.concat(F.col("p_size").cast("string"), F.lit("W")), F.col("p_brand"), F.col("p_type")]
    all_words = [w for i, (n, v) in enumerate(zip(("Wattage", "Line", "Type"), values)) for w in (word(F.lit(n), 310, i), word(v, 410, i))]
    return p.select(F.col("p_partkey").cast("string").alias("doc"), F.lit(1).alias("page"), F.explode(F.array(*all_words)).alias("w")).select("doc", "page", "w.*")


@query("SELECT doc, 1 AS page, CAST(line AS INTEGER) AS line, w AS text FROM words".replace("SELECT doc, 1 AS page", "SELECT doc, CAST(1 AS INTEGER) AS page"), SHEETS)
def sheet_lines(spark, sf_dir):
    return layout.lines(sheet_words(spark, sf_dir))


@query("SELECT CAST(p_partkey AS VARCHAR) AS doc, s.slot_label, CASE s.slot_label WHEN 'Wattage' THEN CAST(p_size AS VARCHAR) ELSE p_brand END AS value FROM part, (SELECT unnest(['Wattage', 'Series']) AS slot_label) s")
def sheet_labels(spark, sf_dir):
    labels = spark.createDataFrame([("Wattage", "Wattage"), ("Line", "Series"), ("Type", None)], "label string, slot_label string")
    out = layout.label_values(sheet_words(spark, sf_dir), labels)
    return out.withColumn("value", F.when(F.col("slot_label") == "Wattage", layout.plain_number(F.col("value"))).otherwise(F.col("value")))


# ---------------------------------------------------------------- cache

CACHE = """req AS (SELECT seq, sha256('m|sys' || chr(0) || classpath || chr(0) || '0.0') AS h, classpath FROM feed),
cache AS (SELECT DISTINCT h, upper(classpath) AS response FROM req WHERE length(classpath) % 2 = 0)"""


@query("SELECT seq, h AS prompt_hash, coalesce(c.response, lower(classpath)) AS response, c.response IS NOT NULL AS hit FROM req LEFT JOIN cache c USING (h)", CACHE)
def cache_flow(spark, sf_dir):
    rows = sources.feed(spark, sf_dir)
    h = caching.prompt_hash(F.lit("m"), F.lit("sys"), F.col("classpath"), "0.0")
    requests = rows.select("seq", F.lit("classify").alias("namespace"), h.alias("prompt_hash"), F.lit("m").alias("model"), F.col("classpath").alias("prompt"))
    old = requests.where("length(prompt) % 2 = 0")
    cache = old.select("namespace", "prompt_hash", "model", F.lower("prompt").alias("response"), F.lit(0).alias("seq")).union(old.select("namespace", "prompt_hash", "model", F.upper("prompt"), F.lit(1)))
    answered, _ = caching.read_through(requests, cache, lambda d: d.withColumn("response", F.lower("prompt")))
    return answered.select("seq", "prompt_hash", "response", "hit")
