"""Requests to a model: made once, answered by key."""

import json

from pyspark.sql import functions as F

from millrace.operators import caching, extracting, prompts


def test_requests_are_made_once(spark):
    rows = spark.createDataFrame([(i, "CD"[i % 7 == 6], "M" if i % 2 else None, f"t{i % 5}" if i != 9 else "") for i in range(20)], "seq long, classpath string, manufacturer string, text string")
    templates = spark.createDataFrame([("C", 1, "A"), ("C", 2, "B")], "classpath string, slot int, label string")
    allowed = spark.createDataFrame([("C", "B", ["x", "y"])], "classpath string, label string, values array<string>")
    none = spark.createDataFrame([], "namespace string, prompt_hash string, model string, response string, seq int")
    said = []

    def call(m):
        told = F.regexp_extract("prompt", r"Raw description: (.*)\n", 1)
        out = m.withColumn("response", F.to_json(F.create_map(F.lit("A"), F.concat(told, F.lit(" "), F.regexp_extract("prompt", r"Manufacturer: (.*)\n", 1)), F.lit("B"), F.lit(" N/A "), F.lit("Z"), F.lit("z"))))
        said.append(out)
        return out

    old = extracting.asked(rows.where("seq = 4").withColumn("manufacturer", F.lit(None).cast("string")), prompts.slot_lines(templates, allowed))
    cache = old.select("namespace", "prompt_hash", "model", F.lit('{"B": "kept"}').alias("response"), F.lit(0).alias("seq"))
    got, fresh = extracting.extract(rows, templates, allowed, cache, call)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "sha2" not in plan  # cache and prompts were read and made again for the rows and for the misses before
    asking = [i for i in range(20) if i % 7 != 6 and i != 9]
    assert sorted(map(tuple, got.collect())) == sorted((i, "B", "kept") if i % 5 == 4 else (i, "A", f"t{i % 5} {'M' if i % 2 else 'unknown'}") for i in asking)
    assert fresh.count() == said[0].count() == len({(i % 5, i % 2) for i in asking if i % 5 != 4})
    paged, _ = extracting.extract(rows, templates, allowed, none, lambda m: m.withColumn("response", F.lit(json.dumps({"A": "p"}))), namespace="extract_page")
    assert sorted(map(tuple, paged.collect())) == [(i, "A", "p") for i in asking]


def test_answers_come_without_prompts_and_hits_with_the_older_key(spark):
    key = "namespace string, prompt_hash string, model string"
    cache = spark.createDataFrame([("n", "new", "m", "1", 0), ("n", "old", "m", "2", 0), ("n", "void", "m", None, 0), ("other", "h", "m", "3", 0)], key + ", response string, seq int")
    req = spark.createDataFrame([(1, "n", "new", "m", "p", "old"), (2, "n", "x", "m", "q", "old"), (3, "n", "void", "m", "r", "void"), (4, "n", "h", "m", "s", None)], "seq int, " + key + ", prompt string, older string")
    answered, _ = caching.read_through(req, cache, lambda m: m.withColumn("response", F.upper("prompt")), legacy="older")
    assert answered.columns == ["seq", "namespace", "prompt_hash", "model", "older", "response", "hit"]
    assert [(r.seq, r.response, r.hit) for r in answered.orderBy("seq").collect()] == [(1, "1", True), (2, "2", True), (3, "R", False), (4, "S", False)]
