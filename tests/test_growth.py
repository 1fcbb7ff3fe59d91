"""Steps that must not grow faster than their input."""

import random
import re

from pyspark.sql import functions as F
from tests.test_rules import score

from millrace.functions import text as X
from millrace.operators import classifying, evaluating, layout, mining, reconciling, records, similar, validating
from millrace.sources.staging import kept


def test_numbered_names_meet_by_what_they_leave(spark):
    r = random.Random(7)
    known = [f"Supplier#{n:09d}" for n in r.sample(range(4000), 300)]
    names = [f"Suplier#{n:09d}" for n in r.sample(range(4000), 300)] + ["", "a", "Other name"]
    left, right = spark.createDataFrame([(x,) for x in names], "x string"), spark.createDataFrame([(y, y[::-1]) for y in [*known, "b"]], "y string, order string")
    got = {q.x: (q.y, round(q.score, 6)) for q in similar.best_matches(left, right, [], 70.0).collect()}
    best = {x: min((-score(x, y), y[::-1], y) for y in [*known, "b"]) for x in names}
    assert got == {x: (y, round(-s, 6)) for x, (s, _, y) in best.items() if s <= -70}
    near = similar.near_matches(left, right, [], 70.0).collect()
    assert all((q.y, round(q.score, 6)) == got[q.x] for q in near) and len(near) >= 0.9 * len(got)  # the rest alone meets pair by pair


def test_rows_read_alike_are_scored_once(spark):
    rows = spark.createDataFrame([(i, ("red bolt", "small ring")[i % 2], "M") for i in range(200)], "seq long, Part_Desc string, manufacturer string")
    kw = spark.createDataFrame([("A", "bolt", 2.0), ("B", "ring", 1.0), ("B", "red", 0.5)], "classpath string, token string, weight double")
    prior = spark.createDataFrame([("M", "A", 1), ("M", "B", 1)], "manufacturer string, classpath string, n long")
    kinds = classifying.read(rows).dropDuplicates(["kind"])
    assert classifying.scores(kinds, kw, prior).count() == 4  # 400 rows of rows and classes before
    got = {(r.seq % 2, r.classpath, r.confidence, r.runner_up) for r in classifying.classify(rows, kw, prior).collect()}
    assert got == {(0, "A", 0.75, "B"), (1, "B", 0.833, "A")}


def test_tables_of_rows_are_not_broadcast(spark):
    rows = spark.createDataFrame([(1, "m")], "seq long, Mfg_Part_Num string")
    slots = spark.createDataFrame([(1, 1, "L", "v", "")], "seq long, slot int, label string, value string, uom string")
    plan = records.records(rows, slots, "j")._jdf.queryExecution().toString()  # two small tables, as compressed files look
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_table_of_a_page_is_read_without_broadcast(spark):
    w = lambda text, x, top: ("d", 1, text, float(x), float(x) + 20, float(top))
    words = [w("Sku", 10, 100), w("Lumens", 100, 100), w("S1", 10, 120), w("80L", 100, 121), w("note", 100, 140), w("S2", 10, 160)]
    table = layout.sku_table(spark.createDataFrame(words, "doc string, page int, text string, x0 double, x1 double, top double"))
    assert {(r.line, r.label, r.text) for r in table.collect()} == {(0, "Sku", "S1"), (0, "Lumens", "80L")}
    assert "BroadcastHashJoin" not in table._jdf.queryExecution().toString()


def test_slots_are_filled_where_their_row_lies(spark):
    rows = spark.createDataFrame([(1, "C")], "seq long, classpath string")
    templates = spark.createDataFrame([("C", 1, "A", "W"), ("C", 2, "B", "W"), ("C", 3, "D", "W")], "classpath string, slot int, label string, uom_hint string")
    told = spark.createDataFrame([(1, "B", "9 W")], "seq long, label string, value string")
    priors = spark.createDataFrame([(1, 0, "9", "V"), (1, 1, "8", "W"), (1, 2, "7", "W")], "seq long, pos int, value string, uom string")
    out = reconciling.reconcile(rows, templates, told, priors)
    assert [tuple(r)[2:] for r in out.orderBy("slot").collect()] == [(1, "A", "8", "W", "rule_prior"), (2, "B", "9", "V", "llm_extract"), (3, "D", "7", "W", "rule_prior")]
    assert "Window" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_files_that_are_kept_have_few_rows(spark):
    table = kept(spark.range(50_000).coalesce(1))  # one file before, whatever its rows
    assert table.count() == 50_000 and len(table.inputFiles()) == 3


def test_rests_are_made_in_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(similar, "TEXTS", 10)
    left, right = (kept(spark.createDataFrame([(f"{c}ame {i:05d}",) * (1 + (v == "y")) for i in range(100)], f"{v} string" + ", order string" * (v == "y"))) for c, v in (("N", "x"), ("n", "y")))
    near = similar.near_matches(left, right, [], 70.0)
    assert near._jdf.queryExecution().optimizedPlan().toString().count("RepartitionByExpression") == 2  # one task a side before
    assert {(r.x, r.y) for r in near.collect()} == {(f"Name {i:05d}", f"name {i:05d}") for i in range(100)}


def test_ends_are_stripped_as_the_pattern_does(spark):
    c = F.expr("decode(unhex(lpad(hex(id), 8, '0')), 'UTF-32')")
    every = spark.range(0x110000).where("id not between 55296 and 57343").select(F.explode(F.array(F.concat(c, F.lit("a"), c, F.lit("b"), c, c), F.concat(F.lit(" "), c), c)).alias("t"))
    assert every.where(~X.strip(F.col("t")).eqNullSafe(F.regexp_replace("t", r"(?U)^\s+|\s+$", ""))).count() == 0


def test_tokens_are_as_before(spark):
    texts = spark.createDataFrame([("The a LED bolt-x2 of Bolt  ab1cd \u00c9b led",), ("",), ("a b c",), (None,)], "t string")
    assert [r.k for r in texts.select(X.tokens(F.col("t")).alias("k")).collect()] == [["led", "bolt", "ab", "cd"], [], [], None]


def test_rows_are_dealt_to_tasks_by_number(spark, monkeypatch):
    monkeypatch.setattr(reconciling, "ROWS", 10)
    rows = spark.range(100).selectExpr("id as seq", "'C' as classpath")
    templates = spark.createDataFrame([("C", 1, "A", "W")], "classpath string, slot int, label string, uom_hint string")
    told, priors = rows.limit(0).selectExpr("seq", "'' as label", "'' as value"), rows.selectExpr("seq", "0 as pos", "string(seq) as value", "'W' as uom")
    out = reconciling.reconcile(rows, templates, told, priors)
    assert {(r.seq, r.value) for r in out.collect()} == {(i, str(i)) for i in range(100)}
    assert out.rdd.getNumPartitions() == 10  # one before: these rows are few bytes


SLOT = "seq long, classpath string, slot int, label string, value string, uom string, origin string, source_url string, evidence_text string"


def slots_and_lists(spark, n):
    rows = [(i, "C", s, "L", v, "", None, None, "e") for i in range(n) for s, v in ((1, "Alpha Beta Gammas" if i % 2 else "Alpha Beta Gamma"), (2, "zzz" if i % 3 else "red"))]
    return spark.createDataFrame(rows, SLOT), spark.createDataFrame([("C", "L", ["Alpha Beta Gamma", "red"])], "classpath string, label string, values array<string>")


def test_repaired_rows_meet_in_tasks_of_a_number_of_rows(spark, monkeypatch):
    monkeypatch.setattr(validating, "SLOTS", 20)
    out = validating.repaired(*slots_and_lists(spark, 100))
    assert out.rdd.getNumPartitions() == 10  # those of the session before, whatever their rows
    assert out._jdf.queryExecution().optimizedPlan().toString().count("values#") == 0  # lists went along with every row before
    got = {(r.seq, r.slot): (r.value, r.lov_valid, r.lov_miss) for r in out.collect()}
    assert got == {
        (i, s): ("Alpha Beta Gamma", True, False) if s == 1 else ("zzz" if i % 3 else "red", None if i % 2 else not i % 3, bool(i % 3)) for i in range(100) for s in (1, 2)
    }


def test_attributes_are_gathered_once_for_warnings_and_score(spark):
    rows = spark.createDataFrame([(i, "P", "D", "C", "M", "B" if i else None, "X", None) for i in range(9)], "seq long, Mfg_Part_Num string, Part_Desc string, classpath string, manufacturer_name string, brand string, INVOICE_DESC string, MOBILE_DESC string")
    slots, makers = validating.repaired(*slots_and_lists(spark, 8)), spark.createDataFrame([("B", "N")], "brand string, manufacturer string")
    one, two = validating.scored(rows, slots, makers), validating.confidence(validating.validate(rows, slots, makers), slots)
    assert sorted(map(str, one.collect())) == sorted(map(str, two.select(*one.columns).collect()))
    joins = lambda d: d._jdf.queryExecution().optimizedPlan().toString().count("Aggregate [seq")
    assert (joins(one), joins(two)) == (1, 2)


def test_templates_are_mined_without_a_sort_of_all_rows(spark):
    rows = spark.createDataFrame([(3, "C", 1, "B", "W"), (2, "C", 1, "A", "W"), (4, "C", 1, "A", "V"), (None, "C", 1, "D", ""), (1, "C", 2, "", "")], "seq long, classpath string, slot int, label string, uom string")
    out = mining.templates(rows)
    assert [tuple(r) for r in out.collect()] == [("C", 1, "A", "W")]
    assert re.search(r"Aggregate \[classpath#\d+, slot#\d+, label#\d+\]", out._jdf.queryExecution().optimizedPlan().toString())  # numbers are added up first


def test_report_joins_no_attributes(spark):
    scored = spark.createDataFrame([(1, "C", "LOW", True, 0.5), (2, "", "LOW", False, 1.0), (3, "C", "REVIEW", True, 0.0)], "seq long, classpath string, band string, f boolean, i double")
    kind = "seq long, slot int, label string, value string"
    made = spark.createDataFrame([(1, 1, "A", "x"), (1, 2, "A", "y"), (1, 3, "B", ""), (2, 1, "A", "x"), (3, 1, "Z", "q")], kind)
    true = spark.createDataFrame([(1, 1, "A", "y"), (1, 3, "B", "b"), (2, 1, "A", "x"), (3, 1, "A", "x"), (3, 2, "", "x")], kind)
    out = evaluating.replay_report(scored, made, true, ["f"], ["i"])
    got = {(r.section, r.value): (r.products, r.right, r.wrong, r.mean_i) for r in out.collect()}
    assert got == {("f", "true"): (2, 1, 2, 0.25), ("f", "false"): (1, 0, 0, 1.0), ("band", "LOW"): (2, 1, 1, 0.75), ("band", "REVIEW"): (1, 0, 1, 0.0), ("all", ""): (3, 1, 2, 0.5)}
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1  # two before
