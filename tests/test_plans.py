"""Regions of pages, keyed state, errors as data, counts that add up, digests of exports, mirrors, prompts."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from millrace import extra_queries
from millrace.operators import counts, exporting, extracting, faults, layout, mining, prompts
from millrace.queries import ORACLE, cleaned
from millrace.sources import feed as sources
from millrace.sources import pages
from millrace.streaming import jobs, state

WORDS = "doc string, page int, text string, x0 double, x1 double, top double"


def cut(words, wide=60, tall=40):
    """Regions by recursive cuts, in reading order."""

    def bands(ws, lo, hi, gap):
        parts, reach = [], None
        for w in sorted(ws, key=lo):
            if reach is None or lo(w) - reach >= gap:
                parts.append([])
            parts[-1].append(w)
            reach = hi(w) if reach is None else max(reach, hi(w))
        return parts

    rows = bands(words, lambda w: w[5], lambda w: w[5], tall)
    both = [c for r in rows for c in bands(r, lambda w: w[3], lambda w: w[4], wide)]
    return [words] if len(both) == 1 else [x for part in both for x in cut(part, wide, tall)]


def test_regions_equal_recursive_cuts(spark):
    r, words = random.Random(4), []
    for doc in range(30):
        for _ in range(r.randrange(1, 25)):
            x, y = r.randrange(0, 600, 20), r.randrange(0, 400, 10)
            words.append((f"d{doc}", 1, f"w{len(words)}", float(x), float(x + r.randrange(10, 60)), float(y)))
    got = {(w.doc, w.text): w.region for w in layout.regions(spark.createDataFrame(words, WORDS)).collect()}
    want = {}
    for doc in {w[0] for w in words}:
        for n, part in enumerate(cut([w for w in words if w[0] == doc])):
            want |= {(doc, w[2]): n for w in part}
    assert got == want and max(want.values()) > 3
    assert layout.regions(spark.createDataFrame([], WORDS)).count() == 0


EVENTS = "event_id long, ts timestamp, event_type string, value double"


def test_windows_ignore_late_and_repeated_events(spark, tmp_path):
    at = str(tmp_path)
    put = lambda *rows: spark.sql("select * from values " + ", ".join(f"({i}L, timestamp'2024-01-01 {t}:00', '{k}', {v}d)" for i, t, k, v in rows) + " t(event_id, ts, event_type, value)").coalesce(1).write.mode("append").parquet(f"{at}/in")
    run = lambda: state.run_windows(spark, f"{at}/in", spark.createDataFrame([], EVENTS).schema, f"{at}/out", f"{at}/cp")
    put((1, "00:10", "a", 1.0), (2, "00:50", "a", 2.0))
    run()
    put((2, "00:50", "a", 2.0), (3, "00:45", "a", 4.0), (4, "02:00", "b", 1.0))  # one again, one late but in time
    run()
    put((5, "00:20", "a", 9.0))  # far too late
    state.close_windows(spark.read.parquet(f"{at}/in"), f"{at}/in")
    run()
    run()  # nothing new
    got = spark.read.parquet(f"{at}/out").where(F.col("event_type") != state.END)
    assert sorted((r.start.hour, r.event_type, r.n, r.total) for r in got.collect()) == [(0, "a", 3, 7.0), (2, "b", 1, 1.0)]


def test_counters_go_on_after_a_restart(spark, tmp_path):
    at = str(tmp_path)
    put = lambda *rows: spark.sql("select * from values " + ", ".join(f"('{j}', {s}L, {f}, timestamp'2024-01-01 00:{m:02}:00')" for j, s, f, m in rows) + " t(job_id, seq, failed, at)").coalesce(1).write.mode("append").parquet(f"{at}/in")
    run = lambda: state.run_counters(spark, f"{at}/in", spark.read.parquet(f"{at}/in").schema, f"{at}/out", f"{at}/cp")
    told = lambda: {r.job_id: (r.processed, r.failed, r.last_at.minute) for r in state.counters(spark, f"{at}/out").collect()}
    put(("a", 1, "false", 1), ("b", 1, "true", 1))
    run()
    assert told() == {"a": (1, 0, 1), "b": (1, 1, 1)}
    put(("a", 1, "false", 1), ("a", 2, "true", 3))
    put(("a", 2, "true", 3))
    run()
    run()
    assert told() == {"a": (2, 1, 3), "b": (1, 1, 1)}


def test_files_that_come_together_are_one_batch_of_windows(spark, tmp_path):
    at = str(tmp_path)
    events = spark.range(600).selectExpr("id as event_id", "timestamp'2024-01-01' + make_interval(0, 0, 0, 0, 0, id, 0) as ts", "'a' as event_type", "1d as value")
    events.repartition(4).write.parquet(f"{at}/in")  # each file spans all the time: the first one made the others late before
    run = lambda: state.run_windows(spark, f"{at}/in", events.schema, f"{at}/out", f"{at}/cp")
    run()
    state.close_windows(events, f"{at}/in")
    run()
    got = spark.read.parquet(f"{at}/out").where(F.col("event_type") != state.END)
    assert sorted((r.start.hour, r.n, r.total) for r in got.collect()) == [(h, 60, 60.0) for h in range(10)]


def test_counters_read_events_of_many_files(spark, tmp_path):
    events = spark.range(500).selectExpr("id as event_id", "if(id = 7, null, timestamp_ntz'2024-01-01' + make_interval(0, 0, 0, 0, 0, id, 0)) as ts", "id % 9 as user_id", "if(id % 4 = 0, 'error', 'view') as event_type")
    events.repartition(4).write.parquet(f"{tmp_path}/events.parquet")  # rows of later files were late before, and rows without a time were lost
    got = extra_queries.job_counters(spark, str(tmp_path)).collect()
    con = duckdb.connect()
    con.sql(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    assert {tuple(r) for r in got} == set(con.sql(ORACLE["job_counters"]).fetchall())


def test_events_of_one_moment_are_not_late(spark, tmp_path):
    events = spark.range(90).selectExpr("id as event_id", "timestamp_ntz'2024-01-01 00:10:00' + make_interval(0, 0, 0, 0, 0, id % 3, 0) as ts", "id as user_id", "if(id % 5 = 0, null, 'view') as event_type", "1d as value")
    events.repartition(4).write.parquet(f"{tmp_path}/events.parquet")  # what the query sent as late was in time, and events without a type were lost
    got = extra_queries.event_windows(spark, str(tmp_path)).collect()
    con = duckdb.connect()
    con.sql(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    assert {tuple(r) for r in got} == set(con.sql(ORACLE["event_windows"]).fetchall())
    assert extra_queries.event_windows(spark, _empty(events, f"{tmp_path}/empty")).count() == 0


def _empty(events, at):
    events.limit(0).write.parquet(f"{at}/events.parquet")
    return at


def test_batches_do_not_grow_with_files(spark, tmp_path):
    at, key = str(tmp_path), "spark.sql.streaming.stateStore.providerClass"
    events = spark.range(40).selectExpr("id as event_id", "timestamp'2024-01-01' + make_interval(0, 0, 0, 0, 0, id, 0) as ts", "'a' as event_type", "1d as value")
    events.repartition(8).write.parquet(f"{at}/in")
    before = spark.conf.get(key)
    state.run_windows(spark, f"{at}/in", events.schema, f"{at}/out", f"{at}/cp")
    begun = [p for p in (tmp_path / "cp" / "offsets").iterdir() if not p.name.startswith(".")]
    assert len(begun) <= 2  # the files and what they close; 8 before
    assert "RocksDB" in begun[0].read_text() and spark.conf.get(key) == before  # memory before


def test_counts_are_written_once_an_arrival(spark, tmp_path):
    at = str(tmp_path)
    rows = spark.range(40).selectExpr("'j' as job_id", "id as seq", "false as failed", "timestamp'2024-01-01' + make_interval(0, 0, 0, 0, 0, id, 0) as at")
    rows.repartition(8).write.parquet(f"{at}/in")
    state.run_counters(spark, f"{at}/in", rows.schema, f"{at}/out", f"{at}/cp")
    assert len(list((tmp_path / "out").glob("batch=*"))) <= 2  # 8 before
    offsets = [p for p in (tmp_path / "cp" / "offsets").iterdir() if not p.name.startswith(".")]
    assert "RocksDB" in offsets[0].read_text()
    none = spark.range(0).selectExpr("id as event_id", "timestamp_ntz'2024-01-01' as ts", "id as user_id", "'a' as event_type")
    assert extra_queries.job_counters(spark, _empty(none, f"{at}/empty")).count() == 0


def test_errors_come_as_data_in_one_pass(spark):
    calls = spark.sparkContext.accumulator(0)

    def parse(text):
        calls.add(1)
        return int(text)

    rows = spark.createDataFrame([(i, "x" if i % 50 == 3 else None if i == 5 else str(i), "y") for i in range(200)], "seq long, text string, confidence string").drop("confidence")
    made = lambda d: faults.settled(d.withColumn("t", faults.attempt(parse, "long")(F.col("text"))), {"number": "t"}).withColumns({"confidence": F.lit(80.0), "band": F.lit("REVIEW")})
    got = {r.seq: r for r in faults.guarded(made, {"no text": F.col("text").isNull(), "never": F.lit(None).cast("boolean")})(rows).collect()}
    assert calls.value == 199 and len(got) == 200
    assert (got[5].row_error, got[5].number, got[5].confidence, got[5].band) == ("no text", None, 0.0, "LOW")
    assert (got[53].row_error, got[53].number, got[53].confidence, got[53].band) == ("ValueError: invalid literal for int() with base 10: 'x'", None, 0.0, "LOW")
    assert (got[7].row_error, got[7].number, got[7].confidence) == (None, 7, 80.0)
    assert faults.guarded(made, {"no text": F.col("text").isNull()})(rows.limit(0)).count() == 0


def test_rows_that_raise_are_stubs(spark):
    df = spark.createDataFrame([(1, "1"), (2, "x")], "seq long, v string")
    got = {r.seq: (r.n, r.confidence, r.band, r.row_error is None) for r in jobs.safe(lambda d: d.select("seq", F.col("v").cast("int").alias("n")))(df).collect()}
    assert got == {1: (1, None, None, True), 2: (None, 0.0, "LOW", False)}


def test_counts_of_batches_make_the_lookups_of_all_rows(spark, tmp_path):
    rows = cleaned(spark, "/root/testdata/sf0.001").limit(120).cache()
    odd = rows.limit(3).withColumns({"seq": F.col("seq") + 1000, "Part_Desc": F.lit(""), "mfr_url": F.lit(" https://www.x.com/ "), "Mfg_Part_Num": F.lit(None).cast("string"), "brand": F.lit(None).cast("string")})
    rows = rows.unionByName(odd)
    slots = sources.attributes(rows).withColumn("label", F.when(F.col("seq") % 40 == 0, F.concat("label", F.lit("2"))).otherwise(F.col("label")))
    store = counts.Store(spark, str(tmp_path / "counts"))
    for batch, where in (("a", "seq % 2 = 0"), ("b", "seq % 2 = 1"), ("a", "seq % 2 = 0")):
        store.add(batch, counts.counted(rows.where(where), slots.where(where)))
    got, want = counts.lookups(store.counts()), mining.mine_all(rows, slots)
    assert got.keys() == want.keys()
    for name in want:
        a, b = (sorted(str(tuple(r)) for r in t.select(*sorted(want[name].columns)).collect()) for t in (got[name], want[name]))
        assert a == b and (a or name == "url_patterns"), name


def test_equal_exports_meet_by_digests_alone(spark):
    old = spark.range(500).select(F.col("id").alias("seq"), (F.col("id") % 90).cast("string").alias("key"), F.lit("v").alias("a"), F.when(F.col("id") % 2 == 0, F.col("id")).alias("b"))
    assert exporting.differing(old, old.repartition(5), "key").count() == 0 and exporting.differences(old, old, "key", "seq").count() == 0
    new = old.withColumn("a", F.when(F.col("seq") == 91, "w").otherwise(F.col("a"))).where("seq <> 7").unionByName(old.where("seq = 3").withColumn("seq", F.lit(900).cast("long")))
    assert exporting.differing(old, new, "key").count() == 3
    got = sorted((r.key, r.nth, r.column, r.old, r.new) for r in exporting.differences(old.withColumn("b", F.col("b").cast("string")), new.withColumn("b", F.col("b").cast("string")), "key", "seq").where("`column` = 'a'").collect())
    assert got == [("1", 2, "a", "v", "w"), ("3", 7, "a", None, "v"), ("7", 6, "a", "v", None)]
    twice = old.where("seq in (4, 94)").withColumn("seq", F.lit(4).cast("long")).drop("b")  # a row twice, and another twice
    assert exporting.differing(twice, twice.withColumn("a", F.lit("x")), "key").count() == 1


def test_a_mirror_is_read_in_part(spark, tmp_path):
    df = spark.createDataFrame([(i, f"https://Host{i % 40}.com/p/{i}", "<p>x</p>") for i in range(400)], "page_id long, url string, html string")
    pages.write_mirror(df, str(tmp_path / "m"))
    some = pages.scan_mirror(spark, str(tmp_path / "m"), ["HOST3.com", "host7.com"], ["page_id"])
    assert sorted(r.page_id for r in some.collect()) == sorted(i for i in range(400) if i % 40 in (3, 7))
    plan = some._jdf.queryExecution().toString()
    scan = next(x for x in plan.split("\n") if "FileScan" in x)
    assert "PartitionFilters: [isnotnull(part" in scan or "part#" in scan.split("PartitionFilters:")[1].split("]")[0]
    assert "html" not in scan.split("ReadSchema")[1] and "In(host" in scan.split("PushedFilters")[1]
    assert pages.scan_mirror(spark, str(tmp_path / "m")).count() == 400 and pages.scan_mirror(spark, str(tmp_path / "m"), []).count() == 0


def test_prompts_and_the_gate(spark):
    t = spark.createDataFrame([("C", 1, "Base"), ("C", 2, "Free")], "classpath string, slot int, label string")
    allowed = spark.createDataFrame([("C", "Base", [f"v{i:02}" for i in range(14)])], "classpath string, label string, values array<string>")
    r = prompts.slot_lines(t, allowed).first()
    assert r.labels == ["Base", "Free"] and r.lines == "- Base: ALLOWED VALUES: " + ", ".join(f"v{i:02}" for i in range(12)) + " (and 2 more)\n- Free: (free-form, extract from description if present)"
    page = spark.range(1).select(prompts.page_prompt(F.array(F.lit("A"), F.lit("B")), F.repeat(F.lit("é"), 7000)).alias("p")).first().p
    assert page == "Slots to fill (use these exact labels as JSON keys):\nA\nB\n\nSource text:\n" + "é" * 6000 + "\n\nJSON:"
    ask = spark.range(1).select(prompts.class_prompt(F.array(F.lit("X"), F.lit("Y")), F.lit("d"), F.lit("")).alias("p")).first().p
    assert ask == "Allowed Classpaths (choose exactly one):\nX\nY\n\nProduct description: d\nManufacturer: unknown\n\nClasspath:"
    call = lambda m: m
    assert extracting.configured(call, "") is extracting.nothing and extracting.configured(call, None) is extracting.nothing and extracting.configured(call, "k") is call


@pytest.mark.parametrize("text", ["A,B\n1,2\n", 'Mfg_Part_Num\n"a\nb"\n'])
def test_feeds_that_lack_columns(spark, tmp_path, text):
    from millrace.plans import enrich

    (tmp_path / "in.csv").write_text(text)
    df = sources.read_feed(spark, str(tmp_path / "in.csv")) if "Mfg" in text else spark.createDataFrame([(None,)], "Mfg_Part_Num string")
    r = enrich.clean(df.withColumn("seq", F.lit(1))).first()
    assert r.raw == {"Mfg_Part_Num": "a\nb" if "Mfg" in text else "None"} and r.Part_Manuf is None
