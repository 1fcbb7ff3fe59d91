"""Registered queries of lookups, rules, extraction, sheets and whole-run reports, with their DuckDB SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions import text as X
from millrace.more_queries import PROVS, REC, reconciled_of, sourced_of
from millrace.operators import caching, classifying, counts, describing, evaluating, exporting, extracting, layout, mining, prompts, reconciling, resolving
from millrace.queries import CLEAN, RAWMAP, SCORED, TEMPLATES, TOKENS, URLS, cleaned, fed, query
from millrace.sources import feed as sources
from millrace.sources import lookups, pages
from millrace.sources.staging import kept, scratch


def picked(values: list[str], n: str = "seq"):
    return F.element_at(F.array(*[F.lit(x) for x in values]), (F.col(n) % len(values) + 1).cast("int"))


def sql_picked(values: list[str], n: str = "seq") -> str:
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in values) + f"][{n} % {len(values)} + 1]"


# ---------------------------------------------------------------- lookups and scans


@query("SELECT raw AS key, names FROM named", CLEAN + ", " + RAWMAP)
def load_lookups(spark, sf_dir):
    """A mined table written as JSON objects and loaded as a lookup."""
    path = scratch(spark, "lookup")
    lookups.write_map(mining.raw_manufacturers(cleaned(spark, sf_dir)), "raw", "names", path)
    return lookups.read_map(spark, path, "array<string>", lines=True).select("key", F.array_join("value", "|").alias("names"))


@query("SELECT seq, Mfg_Part_Num FROM feed ORDER BY seq LIMIT 25")
def first_rows(spark, sf_dir):
    """The limit is the feature."""
    return lookups.first_rows(sources.feed(spark, sf_dir), "seq", 25).select("seq", "Mfg_Part_Num")


@query("SELECT seq, Mfg_Part_Num, Part_Desc, E1_Brand, Unilog_Brand, DIB_Brand, Part_Manuf FROM feed")
def input_slice(spark, sf_dir):
    return lookups.input_slice(sources.feed(spark, sf_dir), "seq")


@query("SELECT DISTINCT Part_Manuf FROM branded WHERE Part_Manuf LIKE 'Suplier%' AND Part_Manuf IN (SELECT Part_Manuf FROM branded WHERE seq % 2 = 0)", CLEAN)
def overlapping_names(spark, sf_dir):
    rows = cleaned(spark, sf_dir)
    return lookups.overlap(rows.where("Part_Manuf like 'Suplier%'"), rows.where("seq % 2 = 0"), "Part_Manuf")


MANUAL = [("nation7.com", "https://nation7.com/products/{mpn}", "short_sku", "^R[0-9]{2}-[A-Z0-9]+-[0-9]+K$"), ("nowhere.com", "https://nowhere.com/{mpn}", None, "^x$")]


@query(
    """SELECT domain, template, confirmed_on, of_total, CAST(NULL AS VARCHAR) AS mpn_transform, false AS manual, CAST(0 AS BIGINT) AS mismatches FROM patterns WHERE domain <> 'nation7.com'
  UNION ALL SELECT 'nation7.com', 'https://nation7.com/products/{mpn}', count(*), count(*), 'short_sku', true, CAST(coalesce(count_if(NOT regexp_matches(Mfg_Part_Num, '^R[0-9]{2}-[A-Z0-9]+-[0-9]+K$')), 0) AS BIGINT) FROM hosts WHERE domain = 'nation7.com'
  UNION ALL SELECT 'nowhere.com', 'https://nowhere.com/{mpn}', 0, 0, NULL, true, 0""",
    URLS,
)
def manual_url_patterns(spark, sf_dir):
    rows = sources.feed(spark, sf_dir)
    manual = mining.manual_patterns(rows, spark.createDataFrame(MANUAL, "domain string, template string, mpn_transform string, shape string"))
    merged = mining.merged_patterns(mining.url_patterns(rows), manual)
    return merged.join(manual.select("domain", "mismatches"), "domain", "left").withColumn("mismatches", F.coalesce("mismatches", F.lit(0)))


@query("SELECT seq, 'https://charts.example/' || Mfg_Part_Num || '_Spec_Chart.pdf' AS url FROM feed")
def chart_urls(spark, sf_dir):
    return sources.feed(spark, sf_dir).select("seq", resolving.filled_url("https://charts.example/{mpn}_Spec_Chart.pdf", F.col("Mfg_Part_Num")).alias("url"))


@query(
    """SELECT 'raw_manufacturers' AS lookup, raw AS key, names AS value FROM named
  UNION ALL SELECT 'templates', classpath || '|' || slot, label || '|' || uom_hint FROM templates
  UNION ALL SELECT 'url_patterns', domain, template || '|' || confirmed_on || '|' || of_total FROM patterns
  UNION ALL SELECT 'domains', manufacturer, domain FROM domains
  UNION ALL SELECT 'keywords', classpath || '|' || token, CAST(CAST(round(weight * 10000) AS BIGINT) AS VARCHAR) FROM keywords
  UNION ALL SELECT 'class_prior', manufacturer || '|' || classpath, CAST(n AS VARCHAR) FROM prior
  UNION ALL SELECT 'brand_pairs', brand, manufacturer FROM (SELECT brand, manufacturer, row_number() OVER (PARTITION BY brand ORDER BY count(*) DESC, min(seq), manufacturer) AS r FROM branded WHERE brand IS NOT NULL GROUP BY 1, 2) WHERE r = 1
  UNION ALL SELECT 'empty_rates', classpath, count(*) || '|' || count_if(brand IS NULL) FROM branded GROUP BY classpath
  UNION ALL SELECT 'allowed_values', classpath || '|' || label, array_to_string(list_sort(list(DISTINCT value)), '|') FROM attributes WHERE value <> '' GROUP BY classpath, label
  UNION ALL SELECT 'self_names', raw, trim(regexp_replace(raw, '\\s*\\([^)]*\\)\\s*$', '')) || '|' || count(*) FROM (SELECT Part_Manuf AS raw FROM branded WHERE Part_Manuf IS NOT NULL) GROUP BY raw""",
    ", ".join([CLEAN, RAWMAP, TEMPLATES, URLS, TOKENS]),
)
def mine_all(spark, sf_dir):
    """All lookups from counts that were stored in two batches, the second of them twice."""
    rows, store = cleaned(spark, sf_dir), counts.Store(spark, scratch(spark, "counts"))
    for batch, where in (("first", "seq % 3 <> 0"), ("second", "seq % 3 = 0"), ("second", "seq % 3 = 0")):
        part = rows.where(where)
        store.add(batch, counts.counted(part, sources.attributes(part)))
    t = counts.lookups(kept(store.counts(), "counts"))
    told = {
        "raw_manufacturers": ("raw", F.array_join("names", "|")), "templates": (("classpath", "slot"), ("label", "uom_hint")), "url_patterns": ("domain", ("template", "confirmed_on", "of_total")), "domains": ("manufacturer", "domain"),
        "keywords": (("classpath", "token"), F.round(F.col("weight") * 10000).cast("long").cast("string")), "class_prior": (("manufacturer", "classpath"), F.col("n").cast("string")), "brand_pairs": ("brand", "manufacturer"),
        "empty_rates": ("classpath", ("total", "empty")), "allowed_values": (("classpath", "label"), F.array_join("values", "|")), "self_names": ("raw", ("manufacturer", "affected")),
    }
    cell = lambda c: F.concat_ws("|", *c) if isinstance(c, tuple) else F.col(c) if isinstance(c, str) else c
    parts = [t[name].select(F.lit(name).alias("lookup"), cell(k).alias("key"), cell(v).alias("value")) for name, (k, v) in told.items()]
    return reduce(DataFrame.unionByName, parts)


# ---------------------------------------------------------------- rules

COOP_TEXTS = ["Washer SQ top", "speed queen dryer", "Ge Dishwasher SS", "Café Range", "BEKO oven", "lg fridge", "HUGE", "BISQUE", "SQUARE Large", "Beko and LG"]
COOP_NUMBERS = ["WDTS7024RZ", " pdsh4816af", "XOUx", "mvwp1", "ABC"]


@query(
    f"""SELECT seq, CASE WHEN regexp_matches(d, '\\bSQ\\b') OR regexp_matches(d, '(?i)\\bspeed queen\\b') THEN 'Alliance Laundry Systems LLC' WHEN regexp_matches(d, '(?i)\\bGE\\b') OR contains(d, 'Caf') THEN 'Haier' WHEN regexp_matches(d, '(?i)\\bbeko\\b') THEN 'Beko'
    WHEN regexp_matches(d, '(?i)\\blg\\b') THEN 'LG Electronics' WHEN starts_with(upper(trim(m)), 'XOU') THEN 'XO Ventilation' WHEN starts_with(upper(trim(m)), 'MVWP') OR starts_with(upper(trim(m)), 'WDTS') THEN 'Whirlpool Corporation'
    WHEN starts_with(upper(trim(m)), 'PDSH') THEN 'Rheem Manufacturing' END AS maker FROM (SELECT seq, {sql_picked(COOP_TEXTS)} AS d, {sql_picked(COOP_NUMBERS, '(seq // 10)')} AS m FROM feed)"""
)
def coop_rules(spark, sf_dir):
    rows = sources.feed(spark, sf_dir).select("seq", picked(COOP_TEXTS).alias("d"), F.expr("seq div 10").alias("n"))
    return rows.select("seq", resolving.coop_rule(F.col("d"), picked(COOP_NUMBERS, "n")).alias("maker"))


KEYWORD_TEXTS = ["T9 Tube lamp", "Stainless Steel sink", "brass and plastic", "A19 round SS", "br30", "tubes", "steel T9 A19"]
last_of = lambda words: "coalesce(" + ", ".join(f"CASE WHEN regexp_matches(d, '\\b{w}\\b') THEN '{w}' END" for w in reversed(words)) + ")"


@query(
    "SELECT seq, " + ", ".join(f"{last_of([w for w, at in X.KEYWORDS.items() if at == label])} AS {name}" for label, name in (("Material", "material"), ("Bulb Shape Code", "shape_code"), ("Bulb Shape", "shape")))
    + f" FROM (SELECT seq, lower(Part_Desc || ' ' || {sql_picked(KEYWORD_TEXTS)}) AS d FROM feed)"
)
def keyword_priors(spark, sf_dir):
    found = X.keyword_priors(F.concat("Part_Desc", F.lit(" "), picked(KEYWORD_TEXTS)))
    return sources.feed(spark, sf_dir).select("seq", found.alias("k")).select("seq", *[F.try_element_at("k", F.lit(x)).alias(n) for x, n in (("Material", "material"), ("Bulb Shape Code", "shape_code"), ("Bulb Shape", "shape"))])


CODES = ["A19", "T9", "BR30", "R30"]
CODED = ["lamp a19 x", "T9 R30", "XBR30", "br30-br30", "R30, BR30!", "nothing"]


@query(f"SELECT seq, {sql_picked(['A19', 'R30', '', '', 'BR30', ''])} AS code FROM feed")
def codes_in_text(spark, sf_dir):
    rows = sources.feed(spark, sf_dir).select("seq", F.concat(F.lit("w "), picked(CODED)).alias("Part_Desc"))
    found = reconciling.code_in_text(rows, spark.createDataFrame([(c,) for c in CODES], "code string"))
    return rows.select("seq").join(found, "seq", "left").select("seq", F.coalesce("value", F.lit("")).alias("code"))


@query(
    """SELECT seq, slot, label, CASE WHEN label = 'Finish' AND value = '' AND seq % 2 = 0 THEN 'found' ELSE value END AS value,
  CASE WHEN label = 'Finish' AND value = '' AND seq % 2 = 0 THEN 'rule_prior' ELSE origin END AS origin FROM reconciled""",
    REC,
)
def backfilled_slots(spark, sf_dir):
    rows = sources.feed(spark, sf_dir)
    found = rows.where("seq % 2 = 0").select("seq", F.lit("found").alias("value"))
    return reconciling.backfill(reconciled_of(rows), "Finish", found).select("seq", "slot", "label", "value", "origin")


@query(
    """SELECT seq, CASE WHEN seq % 2 = 0 THEN 'pdf' WHEN seq % 3 = 0 THEN 'web' WHEN seq % 5 = 0 THEN 'desc_fallback' ELSE 'none' END AS path,
  CASE WHEN seq % 7 = 0 THEN 'over' WHEN seq % 2 = 0 THEN 'c' WHEN seq % 3 = 0 THEN 'p' WHEN seq % 5 = 0 THEN 'd' ELSE '' END AS a, CASE WHEN seq % 7 = 0 THEN 'new' ELSE '' END AS b FROM feed"""
)
def extraction_paths(spark, sf_dir):
    """Which source's values count, and what a chart overrides."""
    some = lambda by, v: F.when(F.col("seq") % by == 0, F.create_map(F.lit("a"), F.lit(v))).otherwise(F.expr("cast(map() as map<string,string>)"))
    path = reconciling.extraction_path(some(2, "c"), some(3, "p"), some(5, "d"))
    over = F.when(F.col("seq") % 7 == 0, F.create_map(F.lit("a"), F.lit("over"), F.lit("b"), F.lit("new")))
    rows = sources.feed(spark, sf_dir).select("seq", path.alias("x"), over.alias("o")).withColumn("v", reconciling.overridden(F.col("x.values"), F.col("o")))
    return rows.select("seq", "x.path", *[F.coalesce(F.try_element_at("v", F.lit(k)), F.lit("")).alias(k) for k in "ab"])


# ---------------------------------------------------------------- answers of a model

EXTRACT = """asked AS (SELECT seq, Part_Desc, classpath, manufacturer FROM feed WHERE seq % 9 <> 0),
now AS (SELECT DISTINCT Part_Desc, classpath, manufacturer FROM asked WHERE seq % 2 = 0), old AS (SELECT DISTINCT Part_Desc, classpath FROM asked WHERE seq % 3 = 0)"""


@query(
    """SELECT seq, 'Line' AS label, CASE WHEN n.classpath IS NOT NULL THEN 'cached' WHEN o.classpath IS NOT NULL THEN 'legacy' ELSE 'called' END AS value
  FROM asked a LEFT JOIN now n USING (Part_Desc, classpath, manufacturer) LEFT JOIN old o ON o.Part_Desc = a.Part_Desc AND o.classpath = a.classpath""",
    EXTRACT,
)
def extracted_attributes(spark, sf_dir):
    """Answers from the cache, from its older keys, and from a call; off-template labels and empty words go."""
    rows = kept(sources.feed(spark, sf_dir).select("seq", "classpath", "manufacturer", "Part_Desc", "p_size", "p_brand", "w1"), "feed")
    a = sources.attributes(rows)
    lines = resolving.lookup(prompts.slot_lines(mining.templates(a), mining.allowed_values(a)))
    asking = rows.select("seq", "classpath", "manufacturer", F.when(F.col("seq") % 9 != 0, F.col("Part_Desc")).otherwise("").alias("text"))
    requests = extracting.asked(asking, lines)
    answer = lambda v: F.lit(f'{{"Line": "{v}", "Finish": "N/A", "Nope": "x"}}')
    entries = lambda which, key, v: requests.where(which).select("namespace", F.col(key).alias("prompt_hash"), "model", answer(v).alias("response"), F.lit(0).alias("seq"))
    cache = entries("seq % 2 = 0", "prompt_hash", "cached").unionByName(entries("seq % 3 = 0", "old_hash", "legacy"))
    got, _ = extracting.answers(requests, lines, cache, lambda m: m.withColumn("response", answer("called")))
    return got.select("seq", "label", "value")


@query(
    """SELECT seq, md5('Slots to fill (use these exact labels as JSON keys):' || chr(10) || labels || chr(10) || chr(10) || 'Source text:' || chr(10) || substr(repeat(Part_Desc || ' ', 300), 1, 6000) || chr(10) || chr(10) || 'JSON:') AS page,
  md5('Product category: ' || classpath || chr(10) || 'Manufacturer: ' || CASE WHEN seq % 2 = 0 THEN manufacturer ELSE 'unknown' END || chr(10) || 'Raw description: ' || Part_Desc || chr(10) || chr(10) || 'Attribute slots and their allowed values:' || chr(10) || lines || chr(10) || chr(10) || 'JSON:') AS fallback,
  md5('Allowed Classpaths (choose exactly one):' || chr(10) || array_to_string([classpath, 'other'], chr(10)) || chr(10) || chr(10) || 'Product description: ' || Part_Desc || chr(10) || 'Manufacturer: ' || CASE WHEN seq % 2 = 0 THEN manufacturer ELSE 'unknown' END || chr(10) || chr(10) || 'Classpath:') AS class
  FROM feed JOIN (SELECT classpath, string_agg(label, chr(10) ORDER BY slot) AS labels, string_agg('- ' || label || ': ' || CASE WHEN vs IS NULL THEN '(free-form, extract from description if present)'
    ELSE 'ALLOWED VALUES: ' || array_to_string(vs[1:12], ', ') || CASE WHEN len(vs) > 12 THEN ' (and ' || (len(vs) - 12) || ' more)' ELSE '' END END, chr(10) ORDER BY slot) AS lines
    FROM templates LEFT JOIN (SELECT classpath, label, list_sort(list(DISTINCT value)) AS vs FROM attributes WHERE value <> '' AND label <> 'Line' GROUP BY 1, 2) USING (classpath, label) GROUP BY 1) USING (classpath)""",
    TEMPLATES,
)
def prompt_texts(spark, sf_dir):
    """Digests of what a model is asked for each row: from a long page, from its description, for its class."""
    rows = fed(spark, sf_dir)
    a = sources.attributes(rows)
    lines = prompts.slot_lines(mining.templates(a), mining.allowed_values(a.where("label <> 'Line'")))
    maker = F.when(F.col("seq") % 2 == 0, F.col("manufacturer"))
    asked = {
        "page": prompts.page_prompt(F.col("labels"), F.repeat(F.concat("Part_Desc", F.lit(" ")), 300)), "fallback": prompts.fallback_prompt(F.col("Part_Desc"), F.col("classpath"), maker, F.col("lines")),
        "class": prompts.class_prompt(F.array("classpath", F.lit("other")), F.col("Part_Desc"), maker),
    }
    return rows.join(lines, "classpath").select("seq", *[F.md5(p).alias(n) for n, p in asked.items()])


ANSWERS = TOKENS + ", " + SCORED + """, short AS (SELECT seq, list_concat(c, list_filter((SELECT list(DISTINCT classpath ORDER BY classpath) FROM feed), lambda x: NOT list_contains(c, x)))[1:8] AS cands
  FROM (SELECT seq, list(classpath ORDER BY r) AS c FROM placed WHERE r <= 2 GROUP BY 1)),
ruled AS (SELECT seq, max(classpath) FILTER (r = 1) AS classpath, coalesce(round(max(score) FILTER (r = 1) / max(total), 3), 0.0) AS confidence FROM placed GROUP BY seq),
said AS (SELECT seq, CASE length(Part_Desc) % 3 WHEN 0 THEN cands[8] WHEN 1 THEN 'made up' END AS answer FROM feed JOIN short USING (seq))"""


@query(
    """SELECT seq, CASE WHEN answer IS NOT NULL AND answer <> 'made up' THEN answer ELSE classpath END AS classpath, CASE WHEN answer IS NOT NULL AND answer <> 'made up' THEN 1.0 ELSE confidence END AS confidence,
  CASE WHEN answer IS NULL THEN 'RULE_BASED' WHEN answer = 'made up' THEN 'RULE_BASED_LLM_UNKNOWN_FALLBACK' ELSE 'LLM' END AS method FROM ruled JOIN said USING (seq)""",
    ANSWERS,
)
def classify_answers(spark, sf_dir):
    rows = sources.feed(spark, sf_dir)
    none = spark.createDataFrame([], "namespace string, prompt_hash string, model string, response string, seq int")
    size = F.length(F.regexp_extract("prompt", r"Product description: (.*)\n", 1)) % 3
    call = lambda m: m.withColumn("response", F.when(size == 0, F.element_at(F.split("prompt", "\n"), 9)).when(size == 1, "made up"))
    ruled = classifying.classify(rows, mining.keywords(rows), mining.class_prior(rows))
    return extracting.classify_by_answer(rows, ruled, rows.select("classpath"), none, call)


@query(
    f"""SELECT seq, CASE WHEN led THEN 'rule' WHEN told THEN 'long ' || Mfg_Part_Num END AS LONG_DESC1, CASE WHEN led THEN CASE WHEN seq % 4 = 0 THEN 'table' END WHEN told AND seq % 2 = 1 AND size_ % 2 = 1 THEN 'sell' END AS MARKETING_DESCRIPTION,
  CASE WHEN led AND seq % 4 = 0 THEN 'f1|f2' ELSE '' END AS features FROM (SELECT seq, Mfg_Part_Num, seq % 3 = 0 AS led, seq % 5 <> 0 AS told, p_size AS size_ FROM feed)"""
)
def prose_texts(spark, sf_dir):
    """Prose for rows with facts, routed by class; the answer lacks marketing for even rows, classes of even size are silent."""
    rows = sources.feed(spark, sf_dir)
    led = F.col("seq") % 3 == 0
    none = F.expr("cast(map() as map<string,string>)")
    base = rows.select("seq", "Mfg_Part_Num", F.col("manufacturer").alias("manufacturer_name"), F.when(led, describing.LED).otherwise(F.concat(F.lit("A>"), F.col("p_size").cast("string"))).alias("classpath"), F.when(F.col("seq") % 5 != 0, F.create_map(F.lit("odd"), (F.col("seq") % 2).cast("string"), F.lit("seq"), F.col("seq").cast("string"))).otherwise(none).alias("attrs"), F.lit("rule").alias("LONG_DESC1"))
    cache = spark.createDataFrame([], "namespace string, prompt_hash string, model string, response string, seq int")
    number = F.regexp_extract("prompt", r"Part number: (.*)\n", 1)
    call = lambda m: m.withColumn("response", F.to_json(F.create_map(F.lit("long_desc1"), F.concat(F.lit("long "), number), F.lit("marketing_description"), F.when(F.regexp_extract("prompt", '"odd":"(.)"', 1) == "1", "sell").otherwise(""), F.lit("other"), F.lit("x"))))
    said = extracting.prose(base, cache, call)
    silent = base.where("not classpath like 'Elec%' and cast(substring(classpath, 3) as int) % 2 = 0").select("classpath")
    copy = rows.where("seq % 4 = 0").select("seq", F.lit("table").alias("marketing"), F.array(F.lit("f1"), F.lit("f2")).alias("features"))
    return extracting.routed(base, said, silent, copy).select("seq", "LONG_DESC1", "MARKETING_DESCRIPTION", F.array_join("features", "|").alias("features"))


@query("SELECT seq, sha256('m|sys' || chr(1) || Part_Desc || chr(1) || '0') AS h FROM feed WHERE contains(sha256('m|sys' || chr(1) || Part_Desc || chr(1) || '0'), 'ab')".replace("chr(1)", "chr(2)"))
def keys_by_substring(spark, sf_dir):
    h = F.sha2(F.concat(F.lit("m|sys\x02"), "Part_Desc", F.lit("\x020")), 256)
    entries = sources.feed(spark, sf_dir).select("seq", F.col("seq").cast("string").alias("namespace"), h.alias("prompt_hash"), F.lit("m").alias("model"), F.lit("r").alias("response"))
    return caching.by_substring(entries, "ab").select("seq", F.col("prompt_hash").alias("h"))


@query("SELECT 'n' || CAST(seq % 4 AS VARCHAR) AS namespace, CAST(count(DISTINCT CASE WHEN seq % 4 <> 3 THEN classpath END) AS BIGINT) AS entries, CAST(count_if(seq % 8 >= 4 AND seq % 4 <> 2) AS BIGINT) AS hits, CAST(count_if(seq % 8 < 4 AND seq % 4 <> 2) AS BIGINT) AS misses FROM feed GROUP BY 1")
def cache_stats(spark, sf_dir):
    rows = sources.feed(spark, sf_dir).withColumn("namespace", F.concat(F.lit("n"), (F.col("seq") % 4).cast("string")))
    entries = rows.where("seq % 4 <> 3").select("namespace", F.col("classpath").alias("prompt_hash"), F.lit("m").alias("model"), "seq")
    return caching.stats(entries, rows.where("seq % 4 <> 2").select("namespace", (F.col("seq") % 8 >= 4).alias("hit")))


@query(f"SELECT seq, {sql_picked(['true', 'true', 'false', 'false'])} = 'true' AS quota FROM feed")
def quota_messages(spark, sf_dir):
    return sources.feed(spark, sf_dir).select("seq", caching.quota_exhausted(picked(["limit per day reached", "TPD: 100000", "per minute", "other"])).alias("quota"))


# ---------------------------------------------------------------- reports


@query(
    """SELECT CAST(count_if(b = 0) AS BIGINT) AS strict_pass, CAST(count_if(h = 0) AS BIGINT) AS gated_pass, CAST(sum(b) AS BIGINT) AS strict_fails, CAST(sum(h) AS BIGINT) AS hard, CAST(sum(b) - sum(h) AS BIGINT) AS soft FROM (
  SELECT seq, count_if(value <> '' AND source_url IS NULL) AS b, count_if(value <> '' AND source_url IS NULL AND evidence_text IS NULL) AS h FROM sourced GROUP BY 1)""",
    REC + ", " + PROVS,
)
def source_rule_counts(spark, sf_dir):
    return evaluating.source_counts(sourced_of(sources.feed(spark, sf_dir)))


@query(
    """SELECT 'arm' || CAST(seq % 2 AS VARCHAR) AS arm, CAST(count_if(seq % 7 > 1) AS BIGINT) AS ok, CAST(count_if(seq % 7 = 0) AS BIGINT) AS skipped, CAST(count_if(seq % 7 = 1) AS BIGINT) AS errors, CAST(sum(5) AS BIGINT) AS expected, CAST(sum(seq % 6) AS BIGINT) AS right,
  round(100 * sum(seq % 6) / sum(5), 1) AS pct FROM feed GROUP BY 1""".replace("AS right", 'AS "right"')
)
def model_arms(spark, sf_dir):
    call = F.when(F.col("seq") % 7 == 0, "skipped").when(F.col("seq") % 7 == 1, "error: ValueError: x").otherwise("ok")
    return evaluating.compare_arms(sources.feed(spark, sf_dir).select(F.concat(F.lit("arm"), (F.col("seq") % 2).cast("string")).alias("arm"), call.alias("call"), F.lit(5).alias("expected"), (F.col("seq") % 6).alias("right")))


@query(
    """SELECT count(*) AS rows, CAST(count_if(seq % 2 = 0) AS BIGINT) AS exact_invoice_desc, count(*) AS exact_retail_desc, CAST(count_if(length(Part_Desc) > 40) AS BIGINT) AS over_limit,
  CAST(count_if(seq % 5 = 0 OR contains(lower(Part_Desc), 'bulb') OR contains(lower(Part_Desc), ' led') OR starts_with(lower(Part_Desc), 'led')) AS BIGINT) AS wrong_noun FROM feed"""
)
def description_report(spark, sf_dir):
    rows = sources.feed(spark, sf_dir)
    made = rows.select("seq", "classpath", F.col("Part_Desc").alias("INVOICE_DESC"), F.when(F.col("seq") % 5 == 0, "A Bulb").otherwise("A thing").alias("RETAIL_DESC"))
    truth = made.withColumn("INVOICE_DESC", F.when(F.col("seq") % 2 == 0, F.col("INVOICE_DESC")).otherwise("?"))
    return evaluating.description_scores(made, truth, describing.LED, ["INVOICE_DESC", "RETAIL_DESC"])


@query(
    """SELECT (SELECT count(*) FROM feed) AS rows, (SELECT CAST(count_if(seq % 3 = 0 OR seq % 11 = 0) AS BIGINT) FROM feed) AS errors, (SELECT CAST(count_if(seq % 3 <> 0 AND seq % 10 <> 0) AS BIGINT) FROM feed) AS classpath_right,
  (SELECT CAST(count_if(seq % 3 <> 0) AS BIGINT) FROM feed) AS manufacturer_right, count(*) AS fields, CAST(count_if(got = value) AS BIGINT) AS fields_right
  FROM (SELECT seq, label, value FROM attributes WHERE value <> '' AND seq % 3 <> 0) LEFT JOIN (SELECT seq, label, arg_max(value, slot) AS got FROM reconciled WHERE value <> '' GROUP BY 1, 2) USING (seq, label)""",
    REC,
)
def whole_run_report(spark, sf_dir):
    rows = sources.feed(spark, sf_dir)
    made = rows.where("seq % 3 <> 0").select(F.col("seq").alias("made"), F.col("seq").alias("s"), F.when(F.col("seq") % 11 == 0, "ValueError: x").alias("row_error"), F.when(F.col("seq") % 10 == 0, "other").otherwise(F.col("classpath")).alias("classpath"), F.col("manufacturer").alias("manufacturer_name"))
    matched = rows.select("seq", F.col("classpath").alias("t_class"), F.col("manufacturer").alias("t_maker")).join(made, F.col("seq") == F.col("s"), "left").drop("s")
    return evaluating.whole_run(matched, reconciled_of(rows), sources.attributes(rows))


@query("SELECT count(*) AS rows, CAST(count_if(seq % 4 > 0) AS BIGINT) AS \"right\", CAST(count_if(ends_with(classpath, 'g')) AS BIGINT) AS subset_rows, CAST(count_if(ends_with(classpath, 'g') AND seq % 4 > 0) AS BIGINT) AS subset_right, round(100 * count_if(seq % 4 > 0) / count(*), 1) AS pct, CASE WHEN count_if(ends_with(classpath, 'g')) = 0 THEN 0.0 ELSE round(100 * count_if(ends_with(classpath, 'g') AND seq % 4 > 0) / count_if(ends_with(classpath, 'g')), 1) END AS subset_pct FROM feed")
def answer_accuracy(spark, sf_dir):
    answer = F.when(F.col("seq") % 4 > 0, F.col("classpath")).when(F.col("seq") % 8 == 0, "other")
    return evaluating.accuracy(sources.feed(spark, sf_dir).select("classpath", answer.alias("answer")), "g")


@query("SELECT seq, CASE WHEN seq % 2 = 0 THEN true ELSE false END AS equal, CAST(CASE seq % 2 WHEN 0 THEN 3 ELSE 2 END AS BIGINT) AS agree FROM feed")
def feature_lists(spark, sf_dir):
    want = F.array(F.lit("a"), F.col("w1"), F.lit("c"))
    got = F.when(F.col("seq") % 2 == 0, want).otherwise(F.array(F.lit("a"), F.col("w1"), F.lit("x"), F.lit("c")))
    return evaluating.same_lists(sources.feed(spark, sf_dir).select("seq", got.alias("got"), want.alias("want")), "got", "want").select("seq", "equal", "agree")


@query(
    """SELECT seq, Mfg_Part_Num, Part_Desc, CASE WHEN seq % 3 = 0 THEN '' ELSE classpath END AS "Classpath", CASE WHEN seq % 3 = 0 THEN '' ELSE manufacturer END AS MANUFACTURER_NAME FROM feed"""
)
def delivery_with_stubs(spark, sf_dir):
    """Delivery rows, and rows of the raw cells alone for inputs without a product."""
    rows = sources.feed(spark, sf_dir)
    raw = F.create_map(*[x for c in sources.RAW for x in (F.lit(c), F.col(c))])
    columns = ["Mfg_Part_Num", "Part_Desc", "Classpath", "MANUFACTURER_NAME"]
    none = F.expr("cast(array() as array<string>)")
    made = rows.where("seq % 3 <> 0").withColumns({"raw": raw, "manufacturer_name": F.col("manufacturer"), "brand": F.lit(None).cast("string"), "ref_urls": none, "features": none, "slots": F.expr("cast(map() as map<int,struct<label:string,value:string,uom:string>>)"), **{t: F.lit(None).cast("string") for t in exporting.TEXTS}})
    return exporting.with_stubs(exporting.delivery(made, columns), rows.select("seq", raw.alias("raw")))


@query(
    """SELECT count(*) AS rows_scored, CAST(count_if(f.seq % 10 <> 0 AND f.classpath = t.classpath) AS BIGINT) AS classpath_correct, CAST(count_if(f.manufacturer = t.manufacturer) AS BIGINT) AS manufacturer_correct,
  CAST(sum(a.n) AS BIGINT) AS attributes, CAST(sum(a.same) AS BIGINT) AS exact_correct, CAST(count_if(f.Part_Desc = t.Part_Desc) AS BIGINT) AS INVOICE_DESC_correct, count(*) AS INVOICE_DESC_total
  FROM feed f JOIN (SELECT * FROM feed WHERE seq IN (SELECT max(seq) FROM feed WHERE seq % 4 <> 3 GROUP BY Mfg_Part_Num)) t USING (Mfg_Part_Num)
  JOIN (SELECT x.seq, y.seq AS t_seq, count(*) AS n, count_if(coalesce(x.value = y.value, false)) AS same FROM attributes y JOIN feed USING (seq) JOIN feed g ON g.Mfg_Part_Num = feed.Mfg_Part_Num LEFT JOIN attributes x ON x.seq = g.seq AND x.label = y.label AND x.value <> '' WHERE y.value <> '' GROUP BY 1, 2) a
    ON a.seq = f.seq AND a.t_seq = t.seq""".replace("SELECT x.seq, y.seq", "SELECT g.seq, y.seq")
)
def job_evaluation(spark, sf_dir):
    """The evaluation of one job from the job store alone, by the last labelled row of each part number."""
    from millrace.plans.service import Service

    rows = fed(spark, sf_dir)
    products = rows.select("seq", "Mfg_Part_Num", "Part_Desc", F.when(F.col("seq") % 10 == 0, "other").otherwise(F.col("classpath")).alias("classpath"), F.col("manufacturer").alias("manufacturer_name"), F.lit(50.0).alias("confidence"), F.lit("LOW").alias("band"), F.col("Part_Desc").alias("INVOICE_DESC"))
    service = Service(spark, scratch(spark, "jobs"))
    slots = sources.attributes(rows)
    service.process("j", products, slots)
    done = evaluating.summarize(service.scored("j", rows.where("seq % 4 <> 3").withColumn("INVOICE_DESC", F.col("Part_Desc")), slots))
    return done.select("rows_scored", "classpath_correct", "manufacturer_correct", "attributes", "exact_correct", "INVOICE_DESC_correct", "INVOICE_DESC_total")


# ---------------------------------------------------------------- sheets

#: A family sheet from each part: headers about line 100, three rows of products, a row without one, one more.
FAMILY = ["GENERAL SPECIFICATIONS", "CRI: 80 Ra", "Functional Life: 25,000 Hours"]


def family_words(spark, sf_dir):
    p = sources.spread(spark.read.parquet(f"{sf_dir}/part.parquet"), "p_partkey")
    size = F.col("p_size").cast("string")
    w = lambda text, x0, x1, top: F.struct((F.lit(text) if isinstance(text, str) else text).alias("text"), F.lit(float(x0)).alias("x0"), F.lit(float(x1)).alias("x1"), F.lit(float(top)).alias("top"))
    words = [w("GENERAL", 10, 40, 20), w("SPECIFICATIONS", 42, 90, 20), w("CRI:", 10, 30, 40), w("80", 32, 40, 40), w("Functional", 10, 40, 60), w("Life:", 42, 60, 60), w("25,000", 62, 80, 60), w("Hours", 82, 95, 60)]
    words += [w("Sku", 10, 30, 100), w("Replacement", 60, 90, 95), w("Wattage", 65, 88, 104), w("Lumens", 120, 150, 100), w("Beam", 180, 200, 95), w("Angle", 180, 201, 104)]
    for k in range(3):
        top = 130 + 15 * k
        words += [w(F.concat(F.lit(f"S{k}/"), size), 8, 33, top), w(F.concat((F.col("p_size") + k).cast("string"), F.lit("W")), 66, 80, top), w(F.concat(size, F.lit("0L")), 122, 140, top + 1), w("120", 185, 195, top)]
    words += [w("note", 64, 80, 180), w("S9", 10, 20, 200), w("77W", 66, 80, 200)]
    return p.select(F.col("p_partkey").cast("string").alias("doc"), F.lit(1).alias("page"), F.explode(F.array(*words)).alias("w")).select("doc", "page", "w.*"), p


@query("SELECT CAST(p_partkey AS VARCHAR) AS doc, label, CASE label WHEN 'Equivalent' THEN CAST(p_size + 1 AS VARCHAR) || 'W' WHEN 'Lumens' THEN CAST(p_size AS VARCHAR) || '0L' WHEN 'Angle' THEN '120' WHEN 'CRI' THEN '80' ELSE '25,000 Hours' END AS value FROM part, (SELECT unnest(['Equivalent', 'Lumens', 'Angle', 'CRI', 'Life']) AS label)")
def family_sheets(spark, sf_dir):
    words, p = family_words(spark, sf_dir)
    labels = spark.createDataFrame([("Replacement Wattage", "Equivalent"), ("Lumens", "Lumens"), ("Beam Angle", "Angle"), ("CRI", "CRI"), ("Functional Life", "Life"), ("Sku", None)], "label string, slot_label string")
    return layout.sheet(words, labels, p.select(F.col("p_partkey").cast("string").alias("doc"), F.concat(F.lit("s1-"), F.col("p_size").cast("string")).alias("sku")))


@query("SELECT CAST(p_partkey AS VARCHAR) AS doc, unnest(range(3)) AS n, 4 AS cells FROM part".replace("4 AS cells", "CAST(4 AS BIGINT) AS cells").replace("unnest(range(3)) AS n", "CAST(unnest(range(3)) AS INTEGER) AS n"))
def sheet_table_rows(spark, sf_dir):
    """Rows of a table until the first one without a part number."""
    words, _ = family_words(spark, sf_dir)
    return layout.sku_table(words).groupBy("doc", F.col("line").alias("n")).agg(F.count("*").alias("cells"))


#: A page from each part: a heading, two tables side by side, one below them.
REGIONS = "FROM part, (SELECT unnest([0, 1, 2]) AS k) a, (SELECT unnest([0, 1, 2]) AS r) b"


def region_words(spark, sf_dir):
    p = sources.spread(spark.read.parquet(f"{sf_dir}/part.parquet"), "p_partkey")
    w = lambda text, x0, top: F.struct((F.lit(text) if isinstance(text, str) else text).alias("text"), F.lit(float(x0)).alias("x0"), F.lit(float(x0) + 30).alias("x1"), F.lit(float(top)).alias("top"))
    words = [w("ITEM", 10, 20), w("SPECIFICATIONS", 45, 20)]
    for k, (x, y) in enumerate(((10, 100), (400, 104), (10, 300))):
        words += [w("Sku", x, y), w("Wattage", x + 60, y), w("Lumens", x + 120, y)]
        for r in range(3):
            top = y + 20 + 15 * r
            words += [w(f"S{k}/{r}", x, top), w(F.concat((F.col("p_size") + 10 * k + r).cast("string"), F.lit("W")), x + 60, top), w(F.concat(F.col("p_size").cast("string"), F.lit(f"0{k}{r}L")), x + 120, top + 1)]
    return p.select(F.col("p_partkey").cast("string").alias("doc"), F.lit(1).alias("page"), F.explode(F.array(*words)).alias("w")).select("doc", "page", "w.*"), p


@query(f"SELECT CAST(p_partkey AS VARCHAR) AS doc, CAST(k + 1 AS INTEGER) AS region, CAST(r AS INTEGER) AS line, 'S' || k || '/' || r AS sku, CAST(p_size + 10 * k + r AS VARCHAR) || 'W' AS watts {REGIONS}")
def page_regions(spark, sf_dir):
    """Rows of several tables on one page, each by its own headers."""
    cells = layout.sku_tables(region_words(spark, sf_dir)[0])
    of = lambda label: F.max(F.when(F.col("label") == label, F.col("text")))
    return cells.groupBy("doc", "region", "line").agg(of("Sku").alias("sku"), of("Replacement Wattage").alias("watts"))


@query("SELECT CAST(p_partkey AS VARCHAR) AS doc, label, CASE label WHEN 'Equivalent' THEN CAST(p_size + 10 * (p_partkey % 3) + 1 AS VARCHAR) || 'W' ELSE CAST(p_size AS VARCHAR) || '0' || (p_partkey % 3) || '1L' END AS value FROM part, (SELECT unnest(['Equivalent', 'Lumens']) AS label)")
def region_sheets(spark, sf_dir):
    """The row of a document's part number, whichever of a page's tables holds it."""
    words, p = region_words(spark, sf_dir)
    labels = spark.createDataFrame([("Replacement Wattage", "Equivalent"), ("Lumens", "Lumens"), ("Sku", None)], "label string, slot_label string")
    skus = p.select(F.col("p_partkey").cast("string").alias("doc"), F.concat(F.lit("s"), (F.col("p_partkey") % 3).cast("string"), F.lit("-1")).alias("sku"))
    return layout.sheet(words, labels, skus)


# ---------------------------------------------------------------- streams


def _arrivals(spark, at: str, rows, time: str, parts: int = 4):
    """Writes rows as files that arrive one after another in order of a time column, first those without a time; yields after
    each what came, and its last time in microseconds (None: the last arrival)."""
    edges = [r.t for r in rows.select(F.expr(f"explode(approx_percentile(unix_micros({time}), array({', '.join(str((i + 1) / parts) for i in range(parts - 1))})))").alias("t")).collect()]  # parts - 1 rows
    part = F.aggregate(F.array(*[F.lit(e) for e in edges]), F.lit(0), lambda n, e: n + F.coalesce(F.unix_micros(time) > e, F.lit(False)).cast("int"))
    for k in range(parts):
        came = rows.where(part == k)
        came.write.mode("append").parquet(at)
        yield came, edges[k] if k < len(edges) else None


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def event_windows(spark, sf_dir):
    """Events that arrive in files: some come twice, some far too late, and the stream stops and goes on after each arrival."""
    from millrace.streaming import state

    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    at = scratch(spark, "events")
    run = lambda: state.run_windows(spark, f"{at}/in", events.schema, f"{at}/out", f"{at}/checkpoint")
    first = None
    for k, (part, until) in enumerate(_arrivals(spark, f"{at}/in", events, "ts")):
        first = part if first is None else first
        if k == 2:
            part.write.mode("append").parquet(f"{at}/in")  # again
            reached = until
        if k == 3 and reached is not None:  # new, but far too late
            late = first.where(F.unix_micros("ts") < reached - 11 * 60 * 10**6)
            late.withColumn("event_id", -1 - F.col("event_id")).write.mode("append").parquet(f"{at}/in")
        if k == 3:
            state.close_windows(events, f"{at}/in")
        run()  # ends here, and the next run goes on from the checkpoint
    out = spark.read.schema("start timestamp, event_type string, n long, total double").parquet(f"{at}/out")
    return out.where(~F.col("event_type").eqNullSafe(state.END)).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("SELECT 'job' || (user_id % 7) AS job_id, count(*) AS processed, CAST(count_if(event_type = 'error') AS BIGINT) AS failed, max(ts) AS last_at, CASE WHEN count(*) >= 100 THEN 'DONE' ELSE 'RUNNING' END AS status FROM events GROUP BY 1")
def job_counters(spark, sf_dir):
    """Progress of jobs by their finished rows, which arrive in files and partly twice; the stream goes on after each arrival."""
    from millrace.streaming import state

    events, at = spark.read.parquet(f"{sf_dir}/events.parquet"), scratch(spark, "counters")
    rows = events.select(F.concat(F.lit("job"), (F.col("user_id") % 7).cast("string")).alias("job_id"), F.col("event_id").alias("seq"), (F.col("event_type") == "error").alias("failed"), F.col("ts").cast("timestamp").alias("at"))
    for part, _ in _arrivals(spark, f"{at}/in", rows, "at"):
        part.where("seq % 5 = 0").write.mode("append").parquet(f"{at}/in")  # again
        state.run_counters(spark, f"{at}/in", rows.schema, f"{at}/out", f"{at}/checkpoint")
    out = state.counters(spark, f"{at}/out")
    return out.withColumns({"last_at": F.col("last_at").cast("timestamp_ntz"), "status": F.when(F.col("processed") >= 100, "DONE").otherwise("RUNNING")})


@query("SELECT CAST(p_partkey AS VARCHAR) AS doc, '3000 K, 4000 K' AS temperatures, CASE WHEN p_size < 90 THEN CAST(p_size AS VARCHAR) || '/' || CAST(p_size + 100 AS VARCHAR) || '/' || CAST(p_size + 200 AS VARCHAR) END AS watts FROM part")
def chart_watts(spark, sf_dir):
    """A chart's wattages: a product's row and the nameless rows beside it."""
    p = sources.spread(spark.read.parquet(f"{sf_dir}/part.parquet"), "p_partkey")
    size = lambda n: (F.col("p_size") + n).cast("string")
    text = [F.lit("Sku Wattage/CCT 4000K 3000K"), F.concat(size(200), F.lit("W 100L 120L")), F.concat(F.lit("65-7/R3 "), size(100), F.lit("W 90L")), F.concat(size(0), F.lit("W 10L 20L")), F.concat(size(50), F.lit("W 11L")), F.concat(F.lit("66-8 "), size(7), F.lit("W 10L"))]
    rows = p.select(F.col("p_partkey").cast("string").alias("doc"), F.lit(1).alias("page"), F.posexplode(F.array(*text)).alias("line", "text"))
    return layout.chart(rows, "65-7-R3")


BULLETS = [("T9", "one"), ("A19", "many"), ("", "one")]


@query(
    """SELECT seq, CASE seq % 3 WHEN 0 THEN p || ' Watt T9 LED Filament|Clear|Medium base|90 CRI|2700K|120 Volt' WHEN 1 THEN p || ' Watt A19 LED|White|2700K|800 Lumens|120 Volt|PIR Sensor' ELSE 'Clear|Medium base|90 CRI|2700K|120 Volt' END AS bullets,
  CASE seq % 3 WHEN 0 THEN 'Tube' WHEN 1 THEN 'Type A' END AS shape FROM (SELECT seq, CAST(p_size AS VARCHAR) AS p FROM feed)"""
)
def sheet_bullets(spark, sf_dir):
    rows = sources.feed(spark, sf_dir)
    code = picked([c for c, _ in BULLETS])
    attrs = F.create_map(*[x for k, v in {"Wattage": F.col("p_size").cast("string"), "Bulb Shape Code": code, "Bulb Finish": F.lit("Clear"), "Bulb Base": F.lit("Medium"), "Color Rendering Index (CRI)": F.lit("90+"), "Color Temperature": F.lit("2700"), "Voltage Rating": F.lit("120"), "Lumens": F.lit("800")}.items() for x in (F.lit(k), v)])
    out = layout.sheet_features(attrs, F.col("seq") % 3 == 1, F.lit("Led pir sensor lamps\nColor: White"))
    return rows.select("seq", F.array_join(out, "|").alias("bullets"), layout.shape_name(code).alias("shape"))


# ---------------------------------------------------------------- wide rows, keys and files


@query("SELECT seq, slot, label, value, uom FROM reconciled WHERE value <> ''", REC)
def unpivot_delivery(spark, sf_dir):
    """The repeated columns of wide delivery rows as a long table."""
    from millrace.more_queries import products_of

    return exporting.unpivot_wide(exporting.delivery(products_of(spark, sf_dir)))


@query("SELECT Mfg_Part_Num, CASE WHEN new_ THEN 'new' ELSE 'old' END AS side FROM (SELECT Mfg_Part_Num, bool_and(seq % 3 = 0) AS old_, bool_and(seq % 3 = 1) AS new_ FROM feed WHERE seq % 3 <> 2 OR true GROUP BY 1) WHERE old_ OR new_")
def export_keys(spark, sf_dir):
    """Part numbers in one of two exports only: one lacks every third row, the other the next ones."""
    rows = sources.feed(spark, sf_dir)
    return exporting.key_differences(rows.where("seq % 3 <> 1"), rows.where("seq % 3 <> 0"), "Mfg_Part_Num")


SYNONYM_VALUES = ["Med.", "cand base", "Stain", "E26", "plain  text", "alum", "oil rubbed bronze", "BRS."]


@query(
    """SELECT classpath, 'Base' AS label, array_to_string(list_sort(list_distinct(list(x))), '|') AS allowed FROM (SELECT classpath, unnest(list_distinct(list_filter([v, """
    + "CASE v WHEN 'Med.' THEN 'Medium' WHEN 'cand base' THEN 'Candelabra' WHEN 'Stain' THEN 'Stainless Steel' WHEN 'alum' THEN 'Aluminum' WHEN 'oil rubbed bronze' THEN 'Oil Rubbed Bronze' WHEN 'BRS.' THEN 'Brass' WHEN 'plain  text' THEN 'plain text' END"
    + f"], lambda y: y IS NOT NULL))) AS x FROM (SELECT classpath, {sql_picked(SYNONYM_VALUES)} AS v FROM feed)) GROUP BY 1"
)
def mine_synonyms(spark, sf_dir):
    """Allowed values with what abbreviations stand for."""
    rows = sources.feed(spark, sf_dir).select("classpath", F.lit("Base").alias("label"), picked(SYNONYM_VALUES).alias("value"))
    return mining.allowed_values(rows).select("classpath", "label", F.array_join("values", "|").alias("allowed"))


@query("SELECT page_id, page_id % 4 = 0 AND page_id % 3 <> 0 AS usable FROM pages")
def chart_guard(spark, sf_dir):
    """A fetched chart counts with status 200 and a PDF's first bytes."""
    p = spark.read.parquet(f"{sf_dir}/pages.parquet")
    body = F.when(F.col("page_id") % 4 == 0, F.encode(F.lit("%PDF-1.7 x"), "UTF-8")).otherwise(F.encode(F.col("html"), "UTF-8"))
    return p.select("page_id", pages.usable_chart(F.when(F.col("page_id") % 3 != 0, 200).otherwise(404), body).alias("usable"))


#: Slot, what a sheet prints, what the slot holds.
PRINTED = [
    ("Wattage", "8.5 W", "8.5"), ("Wattage", "W", "W"), ("Voltage Rating", "120V/60Hz", "120"), ("Voltage Rating", "n", "n"), ("Color Temperature", "2700 K", "2700"), ("Lumens", "1,050L", "1050"), ("Beam Angle", "1,10 Degrees", "110"),
    ("Beam Angle", "36°", "36"), ("Average Life", "25,000 Hrs.", "25000"), ("Length", "7.20 in", "7.2"), ("Length", '3.5"', "3.5"), ("Dimmable", "Yes, most", "Dimmable"), ("Dimmable", "No", ""), ("Energy Star Certified", " YES ", "Energy Star Certified"),
    ("Energy Star Certified", "no", ""), ("Title 20 Compliant", "No", ""), ("Title 20 Compliant", "CEC listed", "Title 20 Compliant"), ("Color Rendering Index (CRI)", "90", "90+"), ("Color Rendering Index (CRI)", "82", "82"), ("Bulb Finish", " Frost, White", "Frost White"), ("Other", "", ""),
]


@query(f"SELECT seq, {sql_picked([a for a, _, _ in PRINTED])} AS slot, {sql_picked([c for _, _, c in PRINTED])} AS value FROM feed")
def slot_values(spark, sf_dir):
    """Printed values in the form of their slots."""
    slot = picked([a for a, _, _ in PRINTED])
    return sources.feed(spark, sf_dir).select("seq", slot.alias("slot"), layout.slot_value(picked([b for _, b, _ in PRINTED]), slot).alias("value"))


@query(
    """SELECT seq, CASE seq % 4 WHEN 0 THEN 'Medium' WHEN 1 THEN 'Candelabra' WHEN 2 THEN 'Mogul' ELSE '' END AS base, CASE seq % 4 WHEN 0 THEN 'E26' WHEN 1 THEN 'E12' ELSE '' END AS code, CASE seq % 4 WHEN 0 THEN 'Type ST' WHEN 3 THEN 'own' ELSE '' END AS shape FROM feed"""
)
def derived_names(spark, sf_dir):
    """Names for codes on a sheet."""
    kinds = [{"Bulb Base": " e26 ", "Bulb Shape Code": "ST19"}, {"Bulb Base Code": "E12", "Bulb Shape Code": "x"}, {"Bulb Base": "Mogul"}, {"Bulb Shape": "own", "Bulb Shape Code": "T9"}]
    maps = F.array(*[F.create_map(*[F.lit(x) for kv in k.items() for x in kv]) for k in kinds])
    rows = sources.feed(spark, sf_dir).select("seq", layout.derived(F.element_at(maps, (F.col("seq") % 4 + 1).cast("int"))).alias("m"))
    return rows.select("seq", *[F.coalesce(F.try_element_at("m", F.lit(k)), F.lit("")).alias(n) for k, n in (("Bulb Base", "base"), ("Bulb Base Code", "code"), ("Bulb Shape", "shape"))])


@query("SELECT classpath, count(*) AS n FROM feed GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1")
def largest_class(spark, sf_dir):
    return mining.largest_class(sources.feed(spark, sf_dir))


@query("SELECT 'DONE' AS status, CAST(count(*) AS INTEGER) AS processed, CAST(count(*) AS INTEGER) AS total, count(*) AS stored, CAST(2 AS BIGINT) AS corrections, (SELECT CAST(sum(seq) AS BIGINT) FROM (SELECT seq FROM feed ORDER BY seq LIMIT 10)) AS first_ten FROM feed")
def job_store(spark, sf_dir):
    """State, products, corrections and replay of a stored job."""
    from millrace.plans.service import Service

    rows = sources.feed(spark, sf_dir)
    service = Service(spark, scratch(spark, "jobs"))
    service.process("j", rows.select("seq", "Mfg_Part_Num", "Part_Desc", "classpath", F.col("manufacturer").alias("manufacturer_name"), F.lit(50.0).alias("confidence"), F.lit("LOW").alias("band")))
    for field in ("classpath", "brand"):
        service.review("p", field, "x")
    job = service.job("j")
    state = spark.createDataFrame([(job["status"], job["processed"], job["total"])], "status string, processed int, total int")
    counts = service.results("j").agg(F.count("*").alias("stored")).crossJoin(service._read("corrections").agg(F.count("*").alias("corrections"))).crossJoin(service.replay("j", 10).agg(F.sum("seq").alias("first_ten")))
    return state.crossJoin(counts)  # one row each


@query(
    """SELECT seq, Mfg_Part_Num, CASE WHEN seq % 100 = 7 OR seq % 100 = 8 THEN NULL ELSE upper(Part_Desc) END AS up, CASE seq % 100 WHEN 7 THEN 'ValueError: bad row ' || seq WHEN 8 THEN 'part number of another shape' END AS row_error,
  CASE WHEN seq % 100 IN (7, 8) THEN 0.0 ELSE 50.0 END::DOUBLE AS confidence, CASE WHEN seq % 100 IN (7, 8) THEN 'LOW' ELSE 'REVIEW' END AS band FROM feed"""
)
def rows_with_errors(spark, sf_dir):
    """Two rows in a hundred that cannot be enriched, one kind found by a rule and one by a function that raises: a single pass."""
    from millrace.operators import faults

    def shout(text, seq):
        if seq % 100 == 7:
            raise ValueError(f"bad row {seq}")
        return text.upper()

    rows = sources.feed(spark, sf_dir).select("seq", "Mfg_Part_Num", "Part_Desc")
    tried = faults.attempt(shout, "string")(F.col("Part_Desc"), F.col("seq"))
    made = lambda d: faults.settled(d.withColumn("t", tried), {"up": "t"}).withColumns({"confidence": F.lit(50.0), "band": F.lit("REVIEW")})
    return faults.guarded(made, {"part number of another shape": F.col("seq") % 100 == 8})(rows).select("seq", "Mfg_Part_Num", "up", "row_error", "confidence", "band")


@query("SELECT seq, upper(Part_Desc) AS up, CAST(NULL AS VARCHAR) AS row_error FROM feed WHERE seq <> 7 UNION ALL SELECT seq, NULL, 'ValueError: bad row' FROM feed WHERE seq = 7")
def incremental_job(spark, sf_dir):
    """A feed that arrives in files, enriched batch by batch as a stream; one row raises and comes through with its error."""
    from millrace.streaming import jobs

    at = scratch(spark, "stream")
    sources.feed(spark, sf_dir).select("seq", "Part_Desc").repartition(2).write.parquet(f"{at}/in")
    up = F.when(F.col("seq") == 7, F.raise_error("ValueError: bad row")).otherwise(F.upper("Part_Desc"))
    schema = spark.read.parquet(f"{at}/in").schema
    jobs.run_job(spark, f"{at}/in", schema, jobs.safe(lambda d: d.select("seq", up.alias("up"))), f"{at}/out", f"{at}/cp")
    return spark.read.option("mergeSchema", True).parquet(f"{at}/out").select("seq", "up", "row_error")
