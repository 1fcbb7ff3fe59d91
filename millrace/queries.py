"""Registered queries of the catalog operators and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import text as X
from millrace.operators import classifying, mining, resolving
from millrace.sources import feed as sources
from millrace.sources.staging import kept

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

WITH = "WITH RECURSIVE " + sources.FEED_SQL


def query(sql: str | None = None, ctes: str = ""):
    """Registers a query; sql is what DuckDB runs after the feed's and the given CTEs."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = WITH + (", " + ctes if ctes else "") + "\n" + sql
        return f

    return add


PLACE = "('-- unbranded --', '-- no unilog brand --', '-- no dib brand --', '-', '', 'n/a', 'na', 'none')"


def cell(c: str) -> str:
    return f"CASE WHEN lower(trim({c})) IN {PLACE} THEN NULL ELSE trim({c}) END"


CLEAN = f"""clean AS (SELECT seq, {", ".join(f"{cell(c)} AS {c}" for c in sources.RAW)}, classpath, manufacturer, mfr_url FROM feed),
branded AS (SELECT *, coalesce(E1_Brand, Unilog_Brand, DIB_Brand) AS brand FROM clean)"""


def cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sources.feed(spark, sf_dir).withColumns({c: X.clean_value(F.col(c)) for c in sources.RAW})
    return kept(rows.withColumn("brand", F.coalesce("E1_Brand", "Unilog_Brand", "DIB_Brand")), "cleaned")


def fed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feed written once, for queries that read it several times."""
    return kept(sources.feed(spark, sf_dir), "feed")


@query("SELECT seq, Mfg_Part_Num, Part_Desc, E1_Brand, Unilog_Brand, DIB_Brand, Part_Manuf, brand FROM branded", CLEAN)
def clean_rows(spark, sf_dir):
    return cleaned(spark, sf_dir).select("seq", *sources.RAW, "brand")


RAWMAP = """named AS (SELECT Part_Manuf AS raw, count(DISTINCT manufacturer) AS n, min(manufacturer) AS manufacturer,
  array_to_string(list_sort(list_distinct(list(manufacturer))), '|') AS names FROM branded WHERE Part_Manuf IS NOT NULL GROUP BY 1)"""


@query("SELECT raw, n, names FROM named", CLEAN + ", " + RAWMAP)
def mine_raw_manufacturers(spark, sf_dir):
    m = mining.raw_manufacturers(cleaned(spark, sf_dir))
    return m.select("raw", F.size("names").cast("long").alias("n"), F.array_join("names", "|").alias("names"))


STATUS = """CASE WHEN Part_Manuf IS NULL THEN 'NO_NAME' WHEN n = 1 THEN 'RESOLVED' WHEN n > 1 THEN 'NEEDS_DISAMBIGUATION' ELSE 'UNRESOLVED' END"""


@query(
    f"""SELECT status, coalesce(manufacturer_name, '') AS manufacturer_name, count(*) AS n_rows, sum(priors) AS n_priors FROM (
  SELECT {STATUS} AS status, CASE WHEN n = 1 THEN named.manufacturer END AS manufacturer_name,
    len(regexp_extract_all(Part_Desc, '(?i)(\\d+(?:\\.\\d+)?)\\s*(W|V|K|A|hr|deg|lm|in\\b|mm|cm|ft)\\b', 1)) AS priors
  FROM branded LEFT JOIN named ON raw = Part_Manuf) GROUP BY 1, 2""".replace("sum(priors)", "CAST(sum(priors) AS BIGINT)"),
    CLEAN + ", " + RAWMAP,
)
def resolve_summary(spark, sf_dir):
    rows = cleaned(spark, sf_dir)
    m = mining.raw_manufacturers(rows).select(F.col("raw").alias("Part_Manuf"), F.size("names").alias("n"), F.col("names")[0].alias("one"))
    out = rows.join(resolving.lookup(m), "Part_Manuf", "left")
    status = F.when(F.col("Part_Manuf").isNull(), "NO_NAME").when(F.col("n") == 1, "RESOLVED").when(F.col("n") > 1, "NEEDS_DISAMBIGUATION").otherwise("UNRESOLVED")
    out = out.select(status.alias("status"), F.coalesce(F.when(F.col("n") == 1, F.col("one")), F.lit("")).alias("manufacturer_name"), F.size(X.unit_priors(F.col("Part_Desc"))).alias("p"))
    return out.groupBy("status", "manufacturer_name").agg(F.count("*").alias("n_rows"), F.sum("p").cast("long").alias("n_priors"))


PRIORS = """found AS (SELECT seq, unnest(regexp_extract_all(Part_Desc, '(?i)(\\d+(?:\\.\\d+)?)\\s*(W|V|K|A|hr|deg|lm|in\\b|mm|cm|ft)\\b', 1)) AS v,
  unnest(regexp_extract_all(Part_Desc, '(?i)(\\d+(?:\\.\\d+)?)\\s*(W|V|K|A|hr|deg|lm|in\\b|mm|cm|ft)\\b', 2)) AS u,
  generate_subscripts(regexp_extract_all(Part_Desc, '(?i)(\\d+(?:\\.\\d+)?)\\s*(W|V|K|A|hr|deg|lm|in\\b|mm|cm|ft)\\b', 1), 1) AS pos FROM feed),
priors AS (SELECT seq, CAST(pos - 1 AS INTEGER) AS pos, CASE WHEN lower(u) = 'k' AND NOT contains(v, '.') AND TRY_CAST(v AS BIGINT) < 100 THEN CAST(CAST(v AS BIGINT) * 100 AS VARCHAR) ELSE v END AS value,
  CASE lower(u) WHEN 'w' THEN 'W' WHEN 'v' THEN 'V' WHEN 'k' THEN 'K' WHEN 'a' THEN 'A' WHEN 'lm' THEN 'Lumens' ELSE lower(u) END AS uom FROM found)"""


def priors_of(rows: DataFrame) -> DataFrame:
    return rows.select("seq", F.posexplode(X.unit_priors(F.col("Part_Desc"))).alias("pos", "p")).select("seq", "pos", "p.value", "p.uom")


@query("SELECT seq, pos, value, uom FROM priors", PRIORS)
def unit_priors(spark, sf_dir):
    return priors_of(sources.feed(spark, sf_dir))


@query("""SELECT seq, classpath, slot, label, value, uom FROM attributes WHERE value <> ''""")
def unpivot_attributes(spark, sf_dir):
    return sources.attributes(sources.feed(spark, sf_dir)).where("value <> ''").select("seq", "classpath", "slot", "label", "value", "uom")


TEMPLATES = """lab AS (SELECT classpath, slot, arg_min(label, seq) AS label FROM attributes GROUP BY 1, 2),
hint AS (SELECT classpath, slot, uom AS uom_hint FROM (SELECT classpath, slot, uom, row_number() OVER (PARTITION BY classpath, slot ORDER BY count(*) DESC, min(seq), uom) AS r
  FROM attributes WHERE uom <> '' GROUP BY 1, 2, 3) WHERE r = 1),
templates AS (SELECT classpath, slot, label, coalesce(uom_hint, '') AS uom_hint FROM lab LEFT JOIN hint USING (classpath, slot))"""


@query("SELECT * FROM templates", TEMPLATES)
def mine_templates(spark, sf_dir):
    return mining.templates(sources.attributes(sources.feed(spark, sf_dir)))


URLS = """hosts AS (SELECT *, replace(regexp_extract(mfr_url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1), 'www.', '') AS domain,
  instr(lower(mfr_url), lower(Mfg_Part_Num)) AS found_at FROM feed),
shaped AS (SELECT *, CASE WHEN found_at > 0 THEN substr(mfr_url, 1, found_at - 1) || '{mpn}' || substr(mfr_url, found_at + length(Mfg_Part_Num)) END AS template FROM hosts),
best AS (SELECT domain, template, n FROM (SELECT domain, template, count(*) AS n, row_number() OVER (PARTITION BY domain ORDER BY count(*) DESC, min(seq), template) AS r
  FROM shaped WHERE template IS NOT NULL GROUP BY 1, 2) WHERE r = 1),
patterns AS (SELECT domain, template, n AS confirmed_on, of_total FROM best JOIN (SELECT domain, count(*) AS of_total FROM shaped GROUP BY 1) USING (domain) WHERE n >= 2 AND n >= 0.8 * of_total),
domains AS (SELECT manufacturer, domain FROM (SELECT manufacturer, domain, row_number() OVER (PARTITION BY manufacturer ORDER BY count(*) DESC, min(seq), domain) AS r FROM hosts GROUP BY 1, 2) WHERE r = 1)"""


@query("SELECT * FROM patterns", URLS)
def mine_url_patterns(spark, sf_dir):
    return mining.url_patterns(sources.feed(spark, sf_dir)).select("domain", "template", "confirmed_on", "of_total")


@query("SELECT * FROM domains", URLS)
def mine_domains(spark, sf_dir):
    return mining.domains(sources.feed(spark, sf_dir))


@query("SELECT DISTINCT domain, rows, Mfg_Part_Num AS odd FROM hosts JOIN (SELECT domain, count(*) AS rows FROM hosts GROUP BY 1) USING (domain) WHERE found_at = 0", URLS)
def url_mismatches(spark, sf_dir):
    return mining.shape_mismatches(sources.feed(spark, sf_dir)).select("domain", "rows", "odd")


@query(
    """SELECT seq, manufacturer, domain, replace(template, '{mpn}', Mfg_Part_Num) AS url, CASE WHEN regexp_matches(Mfg_Part_Num, '^R\\d{2}-([A-Z0-9]+)-([0-9A-Z]+)$')
  THEN lower(regexp_extract(Mfg_Part_Num, '^R\\d{2}-([A-Z0-9]+)-', 1)) || CASE WHEN ends_with(Mfg_Part_Num, 'W') THEN '-w' ELSE '' END END AS sku
  FROM feed LEFT JOIN domains USING (manufacturer) LEFT JOIN patterns USING (domain)""",
    URLS,
)
def product_urls(spark, sf_dir):
    rows = sources.feed(spark, sf_dir)
    out = resolving.product_urls(rows, mining.domains(rows), mining.url_patterns(rows))
    return out.select("seq", "manufacturer", "domain", "url", resolving.short_sku(F.col("Mfg_Part_Num")).alias("sku"))


@query(
    """SELECT brand, manufacturer FROM (SELECT brand, manufacturer, row_number() OVER (PARTITION BY brand ORDER BY count(*) DESC, min(seq), manufacturer) AS r
  FROM branded WHERE brand IS NOT NULL GROUP BY 1, 2) WHERE r = 1""",
    CLEAN,
)
def mine_brand_pairs(spark, sf_dir):
    return mining.brand_pairs(cleaned(spark, sf_dir))


TOKENS = """tok AS (SELECT DISTINCT seq, classpath, manufacturer, t AS token FROM (SELECT seq, classpath, manufacturer, unnest(regexp_extract_all(lower(Part_Desc), '[a-z]+')) AS t FROM feed)
  WHERE length(t) > 1 AND t NOT IN ('the', 'a', 'an', 'with', 'for', 'and', 'or', 'in', 'on', 'of', 'to')),
freq AS (SELECT classpath, token, count(*) AS freq FROM tok GROUP BY 1, 2),
df AS (SELECT token, CAST(sum(freq) AS BIGINT) AS df FROM freq GROUP BY 1),
keywords AS (SELECT classpath, token, weight FROM (SELECT classpath, token, weight, row_number() OVER (PARTITION BY classpath ORDER BY weight DESC, token) AS r
  FROM (SELECT classpath, token, round(freq * ((SELECT count(DISTINCT classpath) FROM feed) / df), 4) AS weight FROM freq JOIN df USING (token))) WHERE r <= 15),
prior AS (SELECT manufacturer, classpath, count(*) AS n FROM feed GROUP BY 1, 2)"""


@query("SELECT * FROM keywords", TOKENS)
def mine_keywords(spark, sf_dir):
    return mining.keywords(sources.feed(spark, sf_dir))


@query("SELECT * FROM prior", TOKENS)
def mine_class_prior(spark, sf_dir):
    return mining.class_prior(sources.feed(spark, sf_dir))


SCORED = """scored AS (SELECT seq, classpath, sum(s) AS score, max(kw) AS has_kw FROM (
  SELECT seq, k.classpath, sum(weight) AS s, 1 AS kw FROM tok JOIN keywords k USING (token) GROUP BY 1, 2
  UNION ALL SELECT seq, p.classpath, 0.5 * n / total, 0 FROM feed JOIN prior p USING (manufacturer) JOIN (SELECT manufacturer, sum(n) AS total FROM prior GROUP BY 1) USING (manufacturer)) GROUP BY 1, 2),
placed AS (SELECT seq, classpath, score, row_number() OVER (PARTITION BY seq ORDER BY round(score, 9) DESC, has_kw DESC, classpath) AS r, sum(score) OVER (PARTITION BY seq) AS total FROM scored)"""


@query(
    """SELECT seq, max(classpath) FILTER (r = 1) AS classpath, coalesce(round(max(score) FILTER (r = 1) / max(total), 3), 0.0) AS confidence, 'RULE_BASED' AS method,
  max(classpath) FILTER (r = 2) AS runner_up FROM placed GROUP BY seq""",
    TOKENS + ", " + SCORED,
)
def classify_rules(spark, sf_dir):
    rows = fed(spark, sf_dir)
    return classifying.classify(rows, mining.keywords(rows), mining.class_prior(rows))


@query(
    """SELECT seq, array_to_string(list_concat(c, list_filter((SELECT list(DISTINCT classpath ORDER BY classpath) FROM feed), lambda x: NOT list_contains(c, x)))[1:8], '|') AS candidates
  FROM (SELECT seq, list(classpath ORDER BY r) AS c FROM placed WHERE r <= 2 GROUP BY 1)""",
    TOKENS + ", " + SCORED,
)
def class_shortlist(spark, sf_dir):
    rows = fed(spark, sf_dir)
    found = classifying.shortlist(classifying.classify(rows, mining.keywords(rows), mining.class_prior(rows)), rows)
    return found.select("seq", F.array_join("candidates", "|").alias("candidates"))


LOO = """sizes AS (SELECT classpath, count(*) AS size FROM feed GROUP BY 1),
held AS (SELECT seq, classpath AS own, manufacturer FROM feed JOIN sizes USING (classpath) WHERE size > 1),
seen AS (SELECT DISTINCT h.seq, h.own, f.classpath FROM held h JOIN tok t USING (seq) JOIN freq f ON f.token = t.token),
gone AS (SELECT h.seq, h.own, f.classpath, f.token, coalesce(t.m, 0) AS m, f.freq - CASE WHEN f.classpath = h.own THEN coalesce(t.m, 0) ELSE 0 END AS freq, d.df - coalesce(t.m, 0) AS df
  FROM seen h JOIN freq f USING (classpath) JOIN df d USING (token) LEFT JOIN (SELECT seq, token, 1 AS m FROM tok) t ON t.seq = h.seq AND t.token = f.token),
top AS (SELECT * FROM (SELECT *, round(freq * ((SELECT count(DISTINCT classpath) FROM feed) / df), 4) AS weight,
  row_number() OVER (PARTITION BY seq, classpath ORDER BY round(freq * ((SELECT count(DISTINCT classpath) FROM feed) / df), 4) DESC, token) AS r FROM gone WHERE freq > 0) WHERE r <= 15 AND m = 1),
own AS (SELECT h.seq, p.classpath, p.n - CASE WHEN p.classpath = h.own THEN 1 ELSE 0 END AS n FROM held h JOIN prior p USING (manufacturer)),
both_ AS (SELECT seq, classpath, sum(s) AS score, max(kw) AS kw FROM (SELECT seq, classpath, sum(weight) AS s, 1 AS kw FROM top GROUP BY 1, 2
  UNION ALL SELECT seq, classpath, 0.5 * n / sum(n) OVER (PARTITION BY seq), 0 FROM own WHERE n > 0) GROUP BY 1, 2),
won AS (SELECT seq, classpath AS predicted FROM (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY round(score, 9) DESC, kw DESC, classpath) AS r FROM both_) WHERE r = 1)"""


@query("SELECT seq, own AS classpath, predicted FROM held LEFT JOIN won USING (seq)", TOKENS + ", " + LOO)
def leave_one_out(spark, sf_dir):
    return classifying.leave_one_out(fed(spark, sf_dir))


@query("SELECT classpath, label, array_to_string(list_sort(list_distinct(list(value))), '|') AS allowed FROM attributes WHERE value <> '' GROUP BY 1, 2")
def mine_allowed_values(spark, sf_dir):
    a = mining.allowed_values(sources.attributes(sources.feed(spark, sf_dir)))
    return a.select("classpath", "label", F.array_join("values", "|").alias("allowed"))


@query("SELECT classpath, count(*) AS total, count_if(coalesce(E1_Brand, '') = '') AS empty, count_if(coalesce(E1_Brand, '') = '') >= 0.75 * count(*) AND count(*) >= 2 AS skip FROM branded GROUP BY 1".replace("count_if(coalesce(E1_Brand, '') = '') AS empty", "CAST(count_if(coalesce(E1_Brand, '') = '') AS BIGINT) AS empty"), CLEAN)
def mine_empty_rates(spark, sf_dir):
    rates = mining.empty_rates(cleaned(spark, sf_dir), "E1_Brand")
    skip = mining.mostly_empty(rates).select("classpath", F.lit(True).alias("s"))
    return rates.join(skip, "classpath", "left").select("classpath", "total", "empty", F.coalesce("s", F.lit(False)).alias("skip"))


#: A feed to mine brands from. What a row's brand cells say goes by the source's number: a house brand alone, the same beside
#: another, the maker's name beside another, and a denied one; every ninth row has the known brand.
BRANDS = r"""scale AS (SELECT seq, trim(Part_Manuf) AS source, manufacturer, CAST(regexp_extract(Part_Manuf, '\d+') AS BIGINT) % 4 AS kind FROM feed WHERE Part_Manuf <> '-'),
cells AS (SELECT seq, source, place, brand FROM (
  SELECT seq, source, p AS place, CASE WHEN p = 0 AND seq % 9 = 0 THEN 'Known' WHEN p = 0 AND kind = 3 THEN 'Wiz' WHEN p = 0 AND kind = 2 THEN upper(manufacturer) || ' Works ®' WHEN p = 0 THEN 'House ' || source
    WHEN p = 1 AND kind IN (1, 2) THEN 'Other' ELSE '' END AS brand FROM scale, (SELECT unnest([0, 1, 2]) AS p)) WHERE brand <> ''),
tainted AS (SELECT source, count(DISTINCT brand) AS brands FROM cells GROUP BY 1 HAVING count(DISTINCT brand) > 1),
maps AS (SELECT source, min(manufacturer) AS name FROM scale GROUP BY 1 HAVING count(DISTINCT manufacturer) = 1),
single AS (SELECT brand, min(name) AS manufacturer, count(*) AS n, min({'s': seq, 'p': place}) AS first, count_if(source NOT IN (SELECT source FROM tainted)) > 0 AS sound, rtrim(lower(brand), ' ®') AS key
  FROM cells JOIN maps USING (source) WHERE brand NOT IN ('Wiz', 'Known') GROUP BY 1 HAVING count(DISTINCT name) = 1)"""


def scale_feed(spark, sf_dir):
    """Rows to mine brands from (raw), and their resolution by names of one manufacturer."""
    rows = sources.feed(spark, sf_dir).where("Part_Manuf <> '-'")
    kind = F.regexp_extract("Part_Manuf", r"(\d+)", 1).cast("long") % 4
    first = F.when(F.col("seq") % 9 == 0, "Known").when(kind == 3, "Wiz").when(kind == 2, F.concat(F.upper("manufacturer"), F.lit(" Works ®"))).otherwise(F.concat(F.lit("House "), "Part_Manuf"))
    cells = {"E1_Brand": first, "DIB_Brand": F.when(kind.isin(1, 2), "Other").otherwise(" Commodity - Unbranded "), "Unilog_Brand": F.lit(" ")}
    rows = kept(rows.withColumns(cells), "scale")
    one = mining.raw_manufacturers(rows).where("size(names) = 1").select(F.col("raw").alias("Part_Manuf"), F.col("names")[0].alias("manufacturer_name"))
    return rows, rows.select("seq", "Part_Manuf").join(one, "Part_Manuf").withColumn("status", F.lit("RESOLVED"))


@query("SELECT * FROM tainted", BRANDS)
def tainted_sources(spark, sf_dir):
    return mining.tainted_sources(scale_feed(spark, sf_dir)[0])


@query(
    """SELECT brand, manufacturer, n FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY first) AS r FROM single
  WHERE sound OR brand LIKE '%Works%' AND contains(lower(manufacturer), 'nation')) WHERE r = 1""",
    BRANDS,
)
def mine_clean_brands(spark, sf_dir):
    rows, resolved = scale_feed(spark, sf_dir)
    return mining.clean_brands(rows, resolved, spark.createDataFrame([("KNOWN™",)], "brand string"))


@query("SELECT raw, trim(regexp_replace(raw, '\\s*\\([^)]*\\)\\s*$', '')) AS manufacturer, count(*) AS affected FROM (SELECT Part_Manuf AS raw FROM branded WHERE Part_Manuf IS NOT NULL) GROUP BY 1", CLEAN)
def mine_self_names(spark, sf_dir):
    rows = cleaned(spark, sf_dir)
    return mining.self_names(rows, rows.select(F.col("Part_Manuf").alias("raw")).where("raw is not null").distinct())


@query("SELECT classpath, slot, count(DISTINCT label) AS labels FROM (SELECT p_type AS classpath, p_size AS slot, p_brand AS label FROM part) GROUP BY 1, 2 HAVING count(DISTINCT label) > 1")
def slot_conflicts(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    return mining.slot_conflicts(part.select(F.col("p_type").alias("classpath"), F.col("p_size").alias("slot"), F.col("p_brand").alias("label")))
