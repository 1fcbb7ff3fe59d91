"""Each branch of validation, resolution, brand mining, description scores and the similarity join, by hand or brute force."""

import random


from millrace.operators import evaluating, mining, resolving, similar, validating


def validated(spark, rows, attributes, allowed):
    p = spark.createDataFrame(rows, "seq long, Mfg_Part_Num string, Part_Desc string, classpath string, manufacturer_name string, brand string, INVOICE_DESC string, MOBILE_DESC string")
    a = spark.createDataFrame(attributes, "seq long, classpath string, slot int, label string, value string, uom string, source_url string, evidence_text string")
    lists = spark.createDataFrame(allowed, "classpath string, label string, values array<string>")
    makers = spark.createDataFrame([("Acme", "Acme Inc")], "brand string, manufacturer string")
    checked = validating.repaired(a, lists)
    return {r.seq: r for r in validating.confidence(validating.validate(p, checked, makers), checked).collect()}


def test_required_fields(spark):
    rows = [(1, "M", "d", "C", None, None, None, None), (2, "M", None, "C", "Acme Inc", "Acme", None, None), (3, "", "", None, "X", "Acme", None, None), (4, "M", "d", "C", "X", "Acme", None, None)]
    got = validated(spark, rows, [(9, "C", 1, "L", "", "", None, None)], [("C", "L", ["v"])])
    assert got[1].v1_required and not got[1].needs_review and got[1].rule_validation == 1.0 and got[1].warnings == []
    assert not got[2].v1_required and got[2].needs_review and got[2].rule_validation == 0.0 and got[2].warnings == ["V1: Part_Desc is required but missing"]
    assert got[3].warnings == [
        "V1: Mfg_Part_Num is required but missing", "V1: Part_Desc is required but missing", "V1: could not classify to a leaf Classpath", "V5: brand 'Acme' expected manufacturer 'Acme Inc', got 'X'",
    ]
    assert got[4].v1_required and not got[4].v5_brand_mfr and got[4].needs_review


def test_a_warning_for_each_attribute(spark):
    attributes = [
        (1, "C", 3, "Base", "mediun", "", "u", None), (1, "C", 1, "Base2", "zzz", "", None, None), (1, "C", 2, "Watt", "8", "W", None, "8W x"), (1, "C", 4, "Len", "8 W", "W", "u", ""), (1, "C", 5, "None", "", "W", None, None),
        (2, "C", 1, "Half", "abcdefgh", "", "u", None),
    ]
    allowed = [("C", "Base", ["Large", "Medium"]), ("C", "Base2", ["Zz", "q"]), ("C", "Half", ["abcdeXYZ", "q"])]
    got = validated(spark, [(1, "M", "d", "C", None, None, "Bulb", "led bulb"), (2, "M", "d", "C", None, None, "BULB", "Led Bulb")], attributes, allowed)
    assert got[1].warnings == [
        "V2: 'Base2' value 'zzz' not found in known LOV for C (best match 80.0)", "V2: 'Base' value 'mediun' not found in known LOV for C (best match 83.3)",
        "V3: 'Watt' value '8' does not carry expected UOM 'W'", "V4: 'INVOICE_DESC' casing does not match field-aware contract", "V4: 'MOBILE_DESC' casing does not match field-aware contract",
        "V6: 'Base2' value 'zzz' has no source_url AND no evidence_text", "V6: 'Watt' value '8' provenance is text-only (rule_prior or LOV-fallback), no source_url",
    ]
    assert (got[1].v2_lov, got[1].v3_uom_inline, got[1].v4_casing_inline, got[1].v6_source_url) == (False, False, False, False)
    assert got[2].warnings == ["V2: 'Half' value 'abcdefgh' not found in known LOV for C (best match 62.5)"] and got[2].v4_casing_inline and got[2].v6_source_url


def test_repair_warns(spark):
    got = validated(spark, [(1, "M", "d", "C", None, None, None, None)], [(1, "C", 1, "Base", "candelabr", "", "u", None)], [("C", "Base", ["Candelabra", "Medium"])])
    assert got[1].warnings == ["V2: repaired 'Base' value 'candelabr' -> 'Candelabra' (fuzzy match 94.7)"] and got[1].v2_lov and got[1].lov_match == 1.0


def test_how_a_name_was_found(spark):
    raw = spark.createDataFrame([("Known (1)", ["Known Inc"]), (resolving.COOP_CODE, ["Haier", "Beko"]), ("Raw (2)", ["Rawname Corp"])], "raw string, names array<string>")
    brands = spark.createDataFrame([("o'neil", "O'Neil Tools"), ("acme", "Acme Inc")], "key string, manufacturer string")
    domains = spark.createDataFrame([("Huber Corporation", "huber.com"), ("Known Inc", "known.com")], "manufacturer string, domain string")
    rows = [(1, "Known (1)", None, "x"), (2, resolving.COOP_CODE, None, "GE oven"), (3, resolving.COOP_CODE, None, "oven"), (4, None, "O'Neil", "x"), (5, None, "Acme", "x"), (6, None, None, "by Huber"), (7, None, None, "a Rawname"), (8, "Nothing like it", None, "x"), (9, None, "?", "corporation")]
    df = spark.createDataFrame([(*r, "m") for r in rows], "seq long, Part_Manuf string, brand string, Part_Desc string, Mfg_Part_Num string")
    got = {r.seq: (r.status, r.matched_raw, r.match_score, r.domain) for r in resolving.resolve(df, raw, brands, domains).collect()}
    assert got == {
        1: ("RESOLVED", "Known (1)", 100.0, "known.com"), 2: ("RESOLVED", f"{resolving.COOP_CODE} [ADC secondary-signal match]", 100.0, None), 3: ("NEEDS_DISAMBIGUATION", None, None, None),
        4: ("RESOLVED", '[brand fallback: "O\'Neil"]', 100.0, None), 5: ("RESOLVED", "[brand fallback: 'Acme']", 100.0, None), 6: ("RESOLVED", "[description fallback]", 100.0, "huber.com"),
        7: ("UNRESOLVED", None, None, None), 8: ("UNRESOLVED", None, None, None), 9: ("UNRESOLVED", None, None, None),
    }


def test_brand_mining(spark):
    rows = spark.createDataFrame(
        [(1, "S1", "Solo", "", ""), (2, "S2", "Trane®", "x", ""), (3, "S2", "", "Trane", ""), (4, "S3", "Two", "", ""), (5, "S4", "Two", "", ""), (6, "S2", "BRK", "", ""), (7, "S1", " -- Unbranded -- ", "Commodity - Unbranded", ""),
         (8, "S5", "Wiz", "", ""), (9, "S6", "old", "", ""), (10, "S2", "Odd", "", ""), (11, "", "Free", "", ""), (12, "S7", "Lost", "", ""), (13, "S1", "", "solo", "")],
        "seq long, Part_Manuf string, E1_Brand string, DIB_Brand string, Unilog_Brand string",
    )
    makers = {"S1": "Solo Inc", "S2": "Trane Company", "S3": "A", "S4": "B", "S5": "W", "S6": "Old Co", "": "F", "S7": None}
    resolved = spark.createDataFrame([(r.seq, "RESOLVED" if makers[r.Part_Manuf] else "UNRESOLVED", makers[r.Part_Manuf]) for r in rows.collect()], "seq long, status string, manufacturer_name string")
    assert {(r.source, r.brands) for r in mining.tainted_sources(rows).collect()} == {("S1", 2), ("S2", 5)}
    got = {(r.brand, r.manufacturer, r.n) for r in mining.clean_brands(rows, resolved, spark.createDataFrame([("Old®",)], "brand string")).collect()}
    # the maker's name clears a tainted source, and an allowed brand; of brands with one key the first stays
    assert got == {("Solo", "Solo Inc", 1), ("Trane®", "Trane Company", 1), ("BRK", "Trane Company", 1), ("Free", "F", 1)}


def test_description_scores(spark):
    made = spark.createDataFrame([(1, "C", "M", "A B", "b a", None, " x"), (2, "C", "M", "q", "q", "q", "q")], "seq long, classpath string, manufacturer_name string, INVOICE_DESC string, MOBILE_DESC string, SHORT_DESC string, RETAIL_DESC string")
    truth = spark.createDataFrame([(1, "C", "M", " A B ", "a b", "s", "x")], "seq long, classpath string, manufacturer string, INVOICE_DESC string, MOBILE_DESC string, SHORT_DESC string, RETAIL_DESC string")
    none = spark.createDataFrame([], "seq long, slot int, label string, value string")
    done = evaluating.evaluate(made, truth, none, none)
    assert {r.seq: (r.INVOICE_DESC_status, r.MOBILE_DESC_status, r.SHORT_DESC_status, r.RETAIL_DESC_status) for r in done.collect()} == {1: ("EXACT", "CLOSE", "MISS", "CLOSE"), 2: ("NO_GT",) * 4}
    s = evaluating.summarize(done).first()
    assert (s.rows_scored, s.classpath_correct, s.INVOICE_DESC_correct, s.INVOICE_DESC_total, s.INVOICE_DESC_pct, s.MOBILE_DESC_pct) == (1, 1, 1, 1, 100.0, 0.0)


def score(a, b):
    row = [0] * (len(b) + 1)
    for c in a:
        new = [0]
        for j, d in enumerate(b):
            new.append(row[j] + 1 if c == d else max(row[j + 1], new[-1]))
        row = new
    return 100.0 if not a and not b else 200.0 * row[-1] / (len(a) + len(b))


def test_similarity_join_makes_few_pairs(spark):
    r = random.Random(5)
    letters = "abcdefghijklmnopqrstuvwxyz"
    names = ["".join(r.choice(letters) for _ in range(18)) for _ in range(200)]
    typed = ["".join(r.choice(letters) if r.random() < 0.12 else c for c in n) for n in names] + ["", "ü𝒳a"]
    left, right = spark.createDataFrame([(x,) for x in typed], "x string"), spark.createDataFrame([(y, y) for y in [*names, ""]], "y string, order string")
    got = {q.x: (q.y, round(q.score, 6)) for q in similar.best_matches(left, right, [], 70.0).collect()}
    scores = {x: sorted((-score(x, y), y) for y in [*names, ""]) for x in typed}
    assert got == {x: (s[0][1], round(-s[0][0], 6)) for x, s in scores.items() if s[0][0] <= -70}
    near = sum(1 for s in scores.values() for v, _ in s if v <= -70)
    assert similar.candidates(*similar.indexed(left, right, []), [], 70.0).count() <= 3 * near  # of 40,000 pairs


def test_similarity_join_in_groups(spark):
    left = spark.createDataFrame([("g", "abc"), ("h", "abc"), ("g", "zz")], "g string, x string")
    right = spark.createDataFrame([("g", "abd", "2"), ("g", "abe", "1"), ("h", "xyc", "1")], "g string, y string, order string")
    got = {(r.g, r.x): (r.y, round(r.score, 1)) for r in similar.best_matches(left, right, ["g"], 0.0).collect()}
    assert got == {("g", "abc"): ("abe", 66.7), ("h", "abc"): ("xyc", 33.3)}


def test_replay_report_sections(spark):
    scored = spark.createDataFrame([(1, "C", "LOW", True, 0.5), (2, "", "LOW", False, 1.0), (3, "C", "REVIEW", True, 0.0)], "seq long, classpath string, band string, v1 boolean, s double")
    made = spark.createDataFrame([(1, 1, "L", "a"), (3, 1, "L", "x")], "seq long, slot int, label string, value string")
    want = spark.createDataFrame([(1, 1, "L", "a"), (1, 2, "K", "k"), (2, 1, "L", "a"), (3, 1, "L", "b")], "seq long, slot int, label string, value string")
    got = {(r.section, r.value): (r.products, r.right, r.wrong, r.mean_s) for r in evaluating.replay_report(scored, made, want, ["v1"], ["s"]).collect()}
    assert got == {("v1", "true"): (2, 1, 2, 0.25), ("v1", "false"): (1, 0, 0, 1.0), ("band", "LOW"): (2, 1, 1, 0.75), ("band", "REVIEW"): (1, 0, 1, 0.0), ("all", ""): (3, 1, 2, 0.5)}
