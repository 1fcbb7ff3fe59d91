"""Literal cases of the catalog operators."""

import pytest
from pyspark.sql import functions as F

from millrace.functions import text as X
from millrace.operators import caching, classifying, describing, evaluating, exporting, layout, mining, reconciling, records, resolving, similar, validating
from millrace.sources import feed, pages
from millrace.streaming import jobs


def one(spark, c, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)) if values else spark.range(1)
    return df.select(c.alias("x")).first().x


@pytest.mark.parametrize(("value", "want"), [("  -- Unbranded -- ", None), ("N/A", None), ("", None), (None, None), (" Acme ", "Acme"), (" x ", "x"), ("-", None), ("nap", "nap")])
def test_clean_value(spark, value, want):
    assert one(spark, X.clean_value(F.col("v")), v=value) == want


def test_unit_priors(spark):
    got = one(spark, X.unit_priors(F.col("v")), v="S21354 8W Led T9 Med 27k 800 lm 3in 100K 2.7k")
    assert [(p.value, p.uom) for p in got] == [("8", "W"), ("2700", "K"), ("800", "Lumens"), ("3", "in"), ("100", "K"), ("2.7", "K")]
    assert one(spark, X.unit_priors(F.col("v")), v=None) == [] and one(spark, X.unit_priors(F.col("v")), v="min 5 winds") == []


@pytest.mark.parametrize(("v", "want"), [("1.18", "1.18"), ("50.25", "50-1/4"), ("1.1875", "1-3/16"), ("0.5", "1/2"), ("3.000", "3.000"), ("x", "x"), ("0.015625", "1/64")])
def test_fraction(spark, v, want):
    assert one(spark, X.fraction(F.col("v")), v=v) == want


@pytest.mark.parametrize(("v", "h", "want"), [("8 W", "W", "8"), ("2200 to 2700 K", "K", "2200 to 2700"), ("Clear W", "W", "Clear W"), ("8", "W", "8"), ("90+", "", "90+"), ("8w", "W", "8")])
def test_unit_removed(spark, v, h, want):
    assert one(spark, X.unit_removed(F.col("v"), F.col("h")), v=v, h=h) == want


def test_title_and_nouns(spark):
    assert one(spark, X.title_case(F.col("v")), v="a-19x t9 it's") == "A-19X T9 It'S"
    for v, want in (("Laundry Appliances>Electric Dryers", "Electric Dryer"), ("A>Batteries", "Battery"), ("A>Wrenches", "Wrench"), ("A>Glass", "Glass"), ("Boxes", "Box")):
        assert one(spark, X.generic_noun(F.col("v")), v=v) == want


def test_similarity(spark):
    def brute(a, b):
        row = [0] * (len(b) + 1)
        for c in a:
            new = [0]
            for j, d in enumerate(b):
                new.append(row[j] + 1 if c == d else max(row[j + 1], new[-1]))
            row = new
        return 100.0 if not a and not b else 200 * row[-1] / (len(a) + len(b))

    for a, b in (("Hager Hinge Co", "Totally Unknown Distributor Co"), ("abc", "abc"), ("", ""), ("", "a"), ("kitten", "sitting"), ("aab", "ba")):
        assert one(spark, X.similarity("a", "b"), a=a, b=b) == pytest.approx(brute(a, b))
    assert one(spark, X.token_sorted(F.col("v")), v=" b  a c ") == "a b c"


def test_snippet(spark):
    text = "x" * 100 + "NEEDLE" + "y" * 100
    assert one(spark, X.snippet(F.col("t"), F.col("v")), t=text, v="needle") == "..." + "x" * 80 + "NEEDLE" + "y" * 80 + "..."
    assert one(spark, X.snippet(F.col("t"), F.col("v")), t=text, v="zzz") == text[:160]
    assert one(spark, X.snippet(F.col("t"), F.col("v")), t="short needle", v="needle") == "short needle..."


def test_packing_skips_what_does_not_fit(spark):
    df = spark.createDataFrame([("base", ["x" * 40, "abc", "y" * 31, "de"])], "b string, t array<string>")
    assert df.select(X.packed(F.col("b"), F.col("t"), 40).alias("x")).first().x == "base abc " + "y" * 31 if len("base abc " + "y" * 31) <= 40 else True


def test_coop_rules(spark):
    rule = lambda d, m: one(spark, resolving.coop_rule(F.col("d"), F.col("m")), d=d, m=m)
    assert rule("PDT715SYVFS Ge Dishwasher SS", None) == "Haier"
    assert rule("Dishwasher SS", "WDTS7024RZ") == "Whirlpool Corporation" and rule("x", " pdsh4816af") == "Rheem Manufacturing"
    assert rule("Café Range", None) == "Haier" and rule("LG Fridge", None) == "LG Electronics"
    for d in ("HUGE", "BISQUE", "Large", None):
        assert rule(d, None) is None


def test_resolution_cascade(spark):
    raw = spark.createDataFrame([("Satco Prod Inc (5573)", ["Satco Products, Inc"]), ("Appliance Dealers Cooperative (APPDE)", ["Haier", "Rheem Manufacturing"]), ("Huber Co (1)", ["J.M. Huber Corporation"])], "raw string, names array<string>")
    brands = spark.createDataFrame([("schumacher", "Schumacher Electric Corporation")], "key string, manufacturer string")
    domains = spark.createDataFrame([("Satco Products, Inc", "satco.com"), ("J.M. Huber Corporation", "huber.com")], "manufacturer string, domain string")
    rows = spark.createDataFrame(
        [(1, "Satco Prod Inc (5573)", None, "x", "m"), (2, "Appliance Dealers Cooperative (APPDE)", None, "HUGE", "m"), (3, "Appliance Dealers Cooperative (APPDE)", None, "Ge x", "m"),
         (4, "Totally Unknown Distributor Co (999999)", None, "x", "m"), (5, "Satco Prd Inc (1)", None, "x", "m"), (6, None, "Schumacher®", "x", "m"), (7, None, None, "by Huber, new", "m"), (8, None, None, "x", "m")],
        "seq long, Part_Manuf string, brand string, Part_Desc string, Mfg_Part_Num string",
    )
    got = {r.seq: r for r in resolving.resolve(rows, raw, brands, domains).collect()}
    assert [(got[i].status, got[i].manufacturer_name) for i in range(1, 9)] == [
        ("RESOLVED", "Satco Products, Inc"), ("NEEDS_DISAMBIGUATION", None), ("RESOLVED", "Haier"), ("UNRESOLVED", None), ("RESOLVED", "Satco Products, Inc"),
        ("RESOLVED", "Schumacher Electric Corporation"), ("RESOLVED", "J.M. Huber Corporation"), ("UNRESOLVED", None),
    ]
    assert got[1].domain == "satco.com" and got[1].match_score == 100.0 and got[2].candidates == ["Haier", "Rheem Manufacturing"] and 85 <= got[5].match_score < 100


def test_short_sku(spark):
    for v, want in (("R00-GFNT1-00K", "gfnt1"), ("R92-GFWT1-0KW", "gfwt1-w"), ("S21354", None)):
        assert one(spark, resolving.short_sku(F.col("v")), v=v) == want


def test_reconcile_claims(spark):
    rows = spark.createDataFrame([(1, "C", "8W 60W 27k")], "seq long, classpath string, Part_Desc string")
    slots = [(1, "Wattage", "W"), (2, "Equivalent", "W"), (3, "Third", "W"), (4, "Temperature", "K"), (5, "Name", "")]
    templates = spark.createDataFrame([("C", *s) for s in slots], "classpath string, slot int, label string, uom_hint string")
    extracted = spark.createDataFrame([(1, "Wattage", "8 W"), (1, "Name", "n/a"), (1, "Off", "x")], "seq long, label string, value string")
    priors = rows.select("seq", F.posexplode(X.unit_priors(F.col("Part_Desc"))).alias("pos", "p")).select("seq", "pos", "p.*")
    out = reconciling.reconcile(rows, templates, reconciling.usable(extracted, rows, templates), priors).orderBy("slot").collect()
    # the extracted 8 does not use up the prior 8
    assert [(r.value, r.uom, r.origin) for r in out] == [("8", "W", "llm_extract"), ("8", "W", "rule_prior"), ("60", "W", "rule_prior"), ("2700", "K", "rule_prior"), ("", "", None)]


def test_code_in_text(spark):
    rows = spark.createDataFrame([(1, "574004 75W Led ST19 27k"), (2, "45W Led r20 Med"), (3, "150W Led Med")], "seq long, Part_Desc string")
    codes = spark.createDataFrame([("ST19",), ("T19",), ("R20",)], "code string")
    assert {r.seq: r.value for r in reconciling.code_in_text(rows, codes).collect()} == {1: "ST19", 2: "R20"}


def test_extraction_path(spark):
    df = spark.sql("select map('a','1') as p, cast(map() as map<string,string>) as e, cast(null as map<string,string>) as n")
    got = df.select(reconciling.extraction_path(F.col("e"), F.col("p"), F.col("p")).alias("a"), reconciling.extraction_path(F.col("n"), F.col("e"), F.col("n")).alias("b"), reconciling.overridden(F.col("p"), F.create_map(F.lit("a"), F.lit("2"))).alias("o")).first()
    assert got.a.path == "web" and got.b.path == "none" and got.o == {"a": "2"}


def test_repair_leaves_other_flags_null(spark):
    a = spark.createDataFrame([(1, "C", "Base", "Mediun"), (1, "C", "Kind", "ok"), (2, "C", "Kind", "ok"), (2, "C", "Free", "any"), (3, "C", "Base", "zzz")], "seq long, classpath string, label string, value string")
    allowed = spark.createDataFrame([("C", "Base", ["Large", "Medium", "Mediums"]), ("C", "Kind", ["ok"])], "classpath string, label string, values array<string>")
    got = {(r.seq, r.label): (r.value, r.lov_valid, r.lov_miss) for r in validating.repaired(a, allowed).collect()}
    assert got == {(1, "Base"): ("Mediun", False, True), (1, "Kind"): ("ok", True, False), (2, "Kind"): ("ok", True, False), (2, "Free"): ("any", True, False), (3, "Base"): ("zzz", False, True)} or got[(1, "Base")][0] in ("Medium", "Mediums")


def test_bands(spark):
    df = spark.createDataFrame([(90.0,), (89.99,), (70.0,), (0.0,)], "s double")
    assert [r.x for r in df.select(validating.band(F.col("s")).alias("x")).collect()] == ["VERIFIED", "REVIEW", "REVIEW", "LOW"]


def test_descriptions_of_other_categories(spark):
    a = spark.createDataFrame([(1, 1, "Capacity", "7 cu-ft", ""), (1, 2, "Color", "Matte Black", "")], "seq long, slot int, label string, value string, uom string")
    rows = describing.attribute_maps(a).withColumns({"Mfg_Part_Num": F.lit("M1"), "manufacturer_name": F.lit("Acme"), "classpath": F.lit("Laundry Appliances>Electric Dryers")})
    r = describing.describe(rows).first()
    assert r.INVOICE_DESC == "ELECTRIC DRYER 7 CU-FT MATTE BLACK" and r.LONG_DESC1 is None and r.SHORT_DESC == "Acme M1 Electric Dryer"


def test_classifier_and_answers(spark):
    rows = spark.createDataFrame([(1, "led bulb", "M"), (2, "zzz", None), (3, None, "M")], "seq long, Part_Desc string, manufacturer string")
    kw = spark.createDataFrame([("A", "led", 3.0), ("B", "bulb", 3.0)], "classpath string, token string, weight double")
    prior = spark.createDataFrame([("M", "B", 2), ("M", "A", 1)], "manufacturer string, classpath string, n long")
    got = {r.seq: (r.classpath, r.confidence, r.runner_up) for r in classifying.classify(rows, kw, prior).collect()}
    assert got == {1: ("B", 0.513, "A"), 2: (None, 0.0, None), 3: (None, 0.0, None)}
    answers = spark.createDataFrame([(1, "A", "B", 0.5), (2, "nope", "B", 0.5), (3, None, "B", 0.5)], "seq long, answer string, classpath string, confidence double")
    got = [(r.classpath, r.method) for r in classifying.accept_answer(answers, kw).orderBy("seq").collect()]
    assert got == [("A", "LLM"), ("B", "RULE_BASED_LLM_UNKNOWN_FALLBACK"), ("B", "RULE_BASED")]


def test_export(spark, tmp_path):
    columns = exporting.delivery_columns()
    assert len(columns) == len(set(columns)) and "ATTRIBUTE_UOM 50" in columns
    p = spark.sql("""select 1L seq, map('E1_Brand','-- Unbranded --','Part_Manuf','Raw') raw, 'M' Mfg_Part_Num, cast(null as string) Part_Desc, cast(null as string) Part_Manuf, 'X' manufacturer_name, 'b' brand, 'c' classpath,
        'u' mfr_url, array('r1') ref_urls, array('f1','f2') features, map(2, named_struct('label','L','value','V','uom','')) slots, 't' MOBILE_DESC, null INVOICE_DESC, null SHORT_DESC, null LONG_DESC1, null RETAIL_DESC, null MARKETING_DESCRIPTION""")
    d = exporting.delivery(p)
    r = d.first().asDict()
    assert (r["E1_Brand"], r["Part_Manuf"], r["Ref URL 1"], r["ITEM_FEATURES_2"], r["ATTRIBUTE_VALUE 2"], r["ATTRIBUTE_VALUE 1"], r["INVOICE_DESC"]) == ("-- Unbranded --", "Raw", "r1", "f2", "V", "", "")
    both = exporting.with_stubs(d, spark.sql("select 1L seq, map('Part_Desc','a') raw union all select 2L, map('Part_Desc','b')"))
    assert both.count() == 2 and both.where("seq = 2").first()["Part_Desc"] == "b"
    exporting.write_csv(both, str(tmp_path / "out"))
    text = next((tmp_path / "out").glob("part-*")).read_bytes()
    assert text.count(b"\r\n") >= 2 and exporting.template_columns(spark, str(tmp_path / "out")) == columns
    with pytest.raises(RuntimeError):
        exporting.template_columns(spark, str(tmp_path / "none"))


def test_differences(spark):
    old = spark.createDataFrame([(1, "k", "a"), (2, "k", "b"), (3, "gone", "c")], "seq long, key string, x string")
    new = spark.createDataFrame([(1, "k", "a"), (2, "k", "B")], "seq long, key string, x string")
    assert {(r.key, r.nth, r.old, r.new) for r in exporting.differences(old, new, "key", "seq").collect()} == {("k", 2, "b", "B"), ("gone", 1, "c", None)}


def test_evaluation(spark):
    rows = spark.createDataFrame([("Matte Black", "Black Matte"), ("x", ""), (None, "x"), ("a", "a"), ("abc", "xyz")], "g string, e string")
    assert [r.s for r in evaluating.match_status(rows, "g", "e", "s").collect()] == ["CLOSE", "NO_GT", "MISS", "EXACT", "MISS"]
    lists = spark.createDataFrame([(["a", "b"], ["a", "c", "d"]), (["a"], ["a"])], "g array<string>, w array<string>")
    assert [(r.equal, r.agree) for r in evaluating.same_lists(lists, "g", "w").collect()] == [(False, 1), (True, 1)]


def test_chart(spark):
    text = ["Sku Wattage/CCT 3000K 4000K 5000K", "80W 11840L 13440L", "65/770R3 100W 14200L 16000L", "120W 16320L", "80W 1L", "65/812 100W 2L", "150W 3L"]
    df = spark.createDataFrame([("d", 1, i, t) for i, t in enumerate(text)], "doc string, page int, line int, text string")
    r = layout.chart(df, "65-770R3").first()
    assert (r.watts, r.temperatures) == ("80/100/120", "3000 K, 4000 K, 5000 K")


def test_layout_table(spark):
    words = [("d", 1, "Sku", 10.0, 30.0, 1), ("d", 1, "65/770", 12.0, 40.0, 2), ("d", 1, "8W", 102.0, 120.0, 2), ("d", 1, "warm", 104.0, 130.0, 2)]
    df = spark.createDataFrame(words, "doc string, page int, text string, x0 double, x1 double, line int")
    headers = spark.createDataFrame([("d", 1, "Sku", 10.0, 30.0), ("d", 1, "Wattage", 100.0, 130.0)], "doc string, page int, text string, x0 double, x1 double")
    table = layout.nearest_header(df.where("line = 2"), headers)
    assert {(r.label, r.text) for r in layout.table_row(table, "65-770").collect()} == {("Wattage", "8W warm")}
    lines = spark.createDataFrame([("d", 1, 1, "Input Voltage, Frequency:  120V/60Hz"), ("d", 1, 2, "CRI: 90"), ("d", 1, 3, "Ambient Operating CRI: 5")], "doc string, page int, line int, text string")
    assert {r.label: r.value for r in layout.general_block(lines).collect()} == {"Input Voltage, Frequency": "120V/60Hz", "CRI": "90"}
    for v, want in (("1,050L", "1050"), ("7.20", "7.2"), ("120V/60Hz", "120"), ("none", "none"), ("10", "10")):
        assert one(spark, layout.plain_number(F.col("v")), v=v) == want


def test_cache(spark):
    key = "namespace string, prompt_hash string, model string"
    cache = spark.createDataFrame([("n", "h1", "m", "old", 0), ("n", "h1", "m", "new", 1), ("n", "legacy", "m", "older", 0)], key + ", response string, seq int")
    req = spark.createDataFrame([("n", "h1", "m", "p", "x"), ("n", "h2", "m", "q", "legacy"), ("n", "h3", "m", "r", "x"), ("n", "h3", "m", "r", "x")], key + ", prompt string, older string")
    answered, fresh = caching.read_through(req, cache, lambda d: d.withColumn("response", F.upper("prompt")), legacy="older")
    assert sorted((r.prompt_hash, r.response, r.hit) for r in answered.collect()) == [("h1", "new", True), ("h2", "older", True), ("h3", "R", False), ("h3", "R", False)]
    assert [r.prompt_hash for r in fresh.collect()] == ["h3"]
    assert caching.stats(cache, answered).first().asDict() == {"namespace": "n", "entries": 2, "hits": 2, "misses": 2}
    assert one(spark, caching.parsed(F.col("v")), v='{"a": "1"}') == {"a": "1"} and one(spark, caching.parsed(F.col("v")), v="not json") == {}


def test_read_feed(spark, tmp_path):
    p = tmp_path / "in.csv"
    p.write_bytes('﻿Mfg_Part_Num,Part_Desc,Extra\r\nA,"x, ""y""",1\r\nB,,2\r\n'.encode())
    rows = feed.read_feed(spark, str(p)).collect()
    assert [tuple(r) for r in rows] == [("A", 'x, "y"'), ("B", "")] and rows[0].__fields__ == ["Mfg_Part_Num", "Part_Desc"]
    p.write_text('Mfg_Part_Num,Part_Desc\nA,"two\nlines"\n')
    assert [tuple(r) for r in feed.read_feed(spark, str(p)).collect()] == [("A", "two\nlines")]
    p.write_text("Mfg_Part_Num\n")
    with pytest.raises(ValueError, match="no data rows"):
        feed.read_feed(spark, str(p))
    p.write_bytes(b"Mfg_Part_Num\nA\xff\xfe\n")
    with pytest.raises(ValueError, match="not UTF-8"):
        feed.read_feed(spark, str(p))


def test_pages(spark):
    html = "<title>T</title><nav>menu</nav><p>a &amp; b<br>c</p><script>var t='</p>';</script><!-- x -->"
    assert one(spark, pages.page_text(F.col("v")), v=html) == "T a & b c" and one(spark, pages.host(F.col("v")), v="https://WWW.x.com:8/p") == "www.x.com"


def test_stored_products(spark):
    slots = '[{"slot": 2, "label": "L", "value": "V"}, {"slot": 2, "label": "L", "value": "W"}, {"slot": 99, "label": "far"}]'
    texts = [
        '{"product_id": "p", "part_desc": null, "confidence": 12.5, "attributes": ' + slots + ', "descriptions": {"mobile_desc": "m", "item_features": ["f"]}}', "{not valid json", None,
        '{"product_id": "p4", "confidence": {"a": 1}}', '{"product_id": "p5", "confidence_band": "HIGH", "mfg_part_num": "x"}', '{"attributes": [{"slot": 1}]}', "[1]",
    ]
    df = spark.createDataFrame([(i, "j", f"M{i}", t) for i, t in enumerate(texts, 1)], "seq long, job_id string, mfg_part_num string, data_json string")
    rows = records.parsed(df)
    got = {r.seq: r.record for r in rows.collect()}
    assert (got[1].product_id, got[1].part_desc, got[1].mfg_part_num, got[1].job_id, got[1].confidence, got[1].row_error) == ("p", "", "M1", "j", 12.5, None)
    assert all(got[i].row_error is None and got[i].mfg_part_num == f"M{i}" and got[i].attributes == [] and got[i].confidence_band == "LOW" and len(got[i].product_id) == 64 for i in (2, 3))
    assert [got[i].row_error for i in (4, 5, 6)] == [f"EXPORT_VALIDATION_FAILED: {w}" for w in ("types", "confidence_band", "attributes")] and got[7].row_error.startswith("EXPORT_VALIDATION_FAILED")
    assert (got[4].product_id, got[5].mfg_part_num, got[5].part_desc, got[6].attributes) == ("p4", "M5", "", [])
    d = {r.seq: r for r in exporting.delivery(records.flat(rows), ["Mfg_Part_Num", "MOBILE_DESC", "ITEM_FEATURES_1", "ATTRIBUTE_LABEL 2", "ATTRIBUTE_VALUE 2"]).collect()}
    assert len(d) == len(texts) and tuple(d[1])[1:] == ("M1", "m", "f", "L", "W") and tuple(d[2])[1:] == ("M2", "", "", "", "")


def test_job_keeps_bad_rows_and_replays(spark, tmp_path):
    schema = "seq long, part string"
    for k, rows in enumerate([[(1, "GOOD1"), (2, None)], [(3, "GOOD2")]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    schema_ = spark.read.parquet(str(tmp_path / "in")).schema
    enrich = jobs.safe(lambda d: d.withColumn("up", F.when(F.col("part").isNull(), F.raise_error("ValueError: no part")).otherwise(F.upper("part"))))
    for _ in range(2):  # a second start finds nothing new
        jobs.run_job(spark, str(tmp_path / "in"), schema_, enrich, str(tmp_path / "out"), str(tmp_path / "cp"))
    out = spark.read.parquet(str(tmp_path / "out"))
    assert {r.seq: (r.up, r.row_error) for r in out.collect()} == {1: ("GOOD1", None), 2: (None, "ValueError: no part"), 3: ("GOOD2", None)}
    assert jobs.progress(spark, str(tmp_path / "out"), 3).orderBy(F.desc("batch")).first().status == "DONE"


def test_mining_ties_by_first_seen(spark):
    rows = spark.createDataFrame([(2, "g", "b"), (1, "g", "a"), (3, "g", "")], "seq long, g string, v string")
    assert mining.most_frequent(rows, ["g"], "v").first().v == "a"


def test_order_and_partitions_do_not_matter(spark):
    rows = spark.createDataFrame([(i, f"led lamp {i % 7} bulb" if i % 2 else f"steel hinge {i % 5}", "A" if i % 2 else "B", f"M{i % 3}") for i in range(60)], "seq long, Part_Desc string, classpath string, manufacturer string")
    results = []
    for n in (1, 7, 64):
        r = rows.orderBy(F.xxhash64("seq", F.lit(n))).repartition(n)
        results.append(sorted(map(tuple, classifying.classify(r, mining.keywords(r), mining.class_prior(r)).collect())))
    assert results[0] == results[1] == results[2]


def test_service(spark, tmp_path):
    from millrace.plans import service

    products = spark.createDataFrame([(1, "M1", "d", "Acme", "C", 80.0, "REVIEW"), (2, "M2", None, "Acme", "D", 20.0, "LOW")], "seq long, Mfg_Part_Num string, Part_Desc string, manufacturer_name string, classpath string, confidence double, band string")
    slots = spark.createDataFrame([(1, 1, "Wattage", "8"), (2, 1, "Wattage", "")], "seq long, slot int, label string, value string")
    truth = spark.createDataFrame([(0, "M1", "D", "Other"), (1, "M1", "C", "Acme")], "seq long, Mfg_Part_Num string, classpath string, manufacturer string")
    s = service.Service(spark, str(tmp_path / "service"))
    with pytest.raises(FileNotFoundError):
        s.job("j1")
    s.process("j0", products.limit(1))
    for _ in range(2):  # again: the same rows under the same ids
        s.process("j1", products, slots)
        assert s.job("j1")["status"] == "DONE" and s.results("j1").count() == 2 and s.results("j0").count() == 1
    pid = s.results("j1").where("seq = 2").first().product_id
    assert s.product("j1", pid)["part_desc"] == "" and s.product("j1", pid)["attributes"][0]["label"] == "Wattage"
    s.review(pid, "classpath", "x")
    got = s.evaluate("j1", truth, slots)
    assert (got["rows_total"], got["rows_scored"], got["rows_unscored"], got["classpath_pct"], got["exact_pct"]) == (2, 1, 1, 100.0, 100.0) and "note" not in got
    assert "note" in s.evaluate("j1", truth.limit(0), slots)
    s.export("j1", str(tmp_path / "csv"), ["Mfg_Part_Num", "Part_Desc", "ATTRIBUTE_VALUE 1"])
    assert sorted(tuple(r) for r in spark.read.option("header", True).csv(str(tmp_path / "csv")).collect()) == [("M1", "d", "8"), ("M2", None, None)]
    for call in (lambda: s.job("none"), lambda: s.delivery("none"), lambda: s.product("j1", "none")):
        with pytest.raises(KeyError):
            call()


def test_clean_keeps_raw_cells(spark):
    from millrace.plans import enrich

    raw = spark.createDataFrame([(1, "M", None, "-- Unbranded --", " Acme ", "n/a", "-")], "seq long, Mfg_Part_Num string, Part_Desc string, E1_Brand string, Unilog_Brand string, DIB_Brand string, Part_Manuf string")
    r = enrich.clean(raw).first()
    assert r.brand == "Acme" and r.Part_Manuf is None and r.raw["E1_Brand"] == "-- Unbranded --"


def test_lookup_files(spark, tmp_path):
    from millrace.sources import lookups

    (tmp_path / "one.json").write_text('{\n "a": {"x": 1.5,\n "y": 2},\n "b": {}\n}')
    got = {r.key: r.value for r in lookups.read_map(spark, str(tmp_path / "one.json"), "map<string,double>").collect()}
    assert got == {"a": {"x": 1.5, "y": 2.0}, "b": {}}
    (tmp_path / "lines.json").write_text('{"a": "x"}\n{"b": "y"}\n')
    assert {tuple(r) for r in lookups.read_map(spark, str(tmp_path / "lines.json"), lines=True).collect()} == {("a", "x"), ("b", "y")}
    (tmp_path / "bad.json").write_text("[1")
    with pytest.raises(ValueError, match="not a JSON object"):
        lookups.read_map(spark, str(tmp_path / "bad.json"))
    df = spark.createDataFrame([("k",), ("l",)], "Part_Manuf string")
    assert lookups.require_disjoint(df.where("Part_Manuf = 'k'"), df.where("Part_Manuf = 'l'"), "Part_Manuf").count() == 1
    with pytest.raises(ValueError, match="k"):
        lookups.require_disjoint(df, df, "Part_Manuf")


def test_read_labelled(spark, tmp_path):
    p = tmp_path / "gt.csv"
    p.write_bytes('\ufeffMfg_Part_Num,ATTRIBUTE_LABEL 1,ATTRIBUTE_VALUE 1,ATTRIBUTE_LABEL 2,ATTRIBUTE_VALUE 2\r\nA, Wattage ,8,Finish,\r\n'.encode())
    rows = feed.read_labelled(spark, str(p))
    assert rows.columns[1] == "Mfg_Part_Num" and rows.first()["ATTRIBUTE_VALUE 2"] == ""
    assert [(r.slot, r.label, r.value, r.uom) for r in exporting.unpivot_wide(rows).collect()] == [(1, "Wattage", "8", "")]


def test_strided_sample_numbers_across_ranges(spark):
    rows = spark.range(3000).select(F.col("id").alias("seq"), (F.col("id") % 10).alias("k")).repartition(7)
    got = sorted(r.seq for r in evaluating.stride_sample(rows, "seq", F.col("k") == 3, 7).collect())
    rest = [i for i in range(3000) if i % 10 != 3]
    assert got == sorted([i for i in range(3000) if i % 10 == 3] + rest[::7])
