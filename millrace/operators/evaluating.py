"""Comparison with labelled rows, and the counts made of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import text as X
from millrace.sources.staging import SLOTS, dealt, kept, rowwise

CLOSE = 85.0
#: Ranges into which stride_sample cuts its order.
RANGES = 256


def percent(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, 0.0).otherwise(F.round(100 * part / whole, 1))


def match_status(rows: DataFrame, got: str, expected: str, out: str) -> DataFrame:
    """rows with out: NO_GT, MISS, EXACT (the value as it is), or CLOSE (words sorted, similarity 85 or more). Labelled
    cells are trimmed where they are read."""
    rows = rows.withColumns({"__a": X.token_sorted(F.coalesce(F.col(got), F.lit(""))), "__b": X.token_sorted(F.coalesce(F.col(expected), F.lit("")))})
    open_ = (F.col("__a") != F.col("__b")) & (F.col("__a") != "") & X.could_be_near("__a", "__b", CLOSE)
    close = (F.col("__a") == F.col("__b")) | F.coalesce(X.similarity("__a", "__b", open_) >= CLOSE, F.lit(False))
    e, g = F.coalesce(F.col(expected), F.lit("")), F.coalesce(F.col(got), F.lit(""))
    status = F.when(e == "", "NO_GT").when(g == "", "MISS").when(e == g, "EXACT").when(close, "CLOSE").otherwise("MISS")
    return rows.withColumn(out, status).drop("__a", "__b")


def attribute_tally(truth: DataFrame, produced: DataFrame) -> DataFrame:
    """seq, expected, exact, close, missed: labelled attributes against the last non-empty produced value of a label."""
    made = produced.where("value <> ''").groupBy("seq", "label").agg(F.max_by("value", "slot").alias("got"))
    both = match_status(truth.where("value <> ''").select("seq", "label", F.col("value").alias("want")).join(rowwise(made), ["seq", "label"], "left"), "got", "want", "status")
    return both.groupBy("seq").agg(F.count("*").alias("expected"), *[F.count_if(F.col("status") == s).alias(n) for s, n in (("EXACT", "exact"), ("CLOSE", "close"), ("MISS", "missed"))])


#: The descriptions that are scored.
DESCRIPTIONS = ("INVOICE_DESC", "MOBILE_DESC", "SHORT_DESC", "RETAIL_DESC")


def evaluate(products: DataFrame, truth: DataFrame, attributes: DataFrame, true_attributes: DataFrame) -> DataFrame:
    """seq, scored, classpath_ok, manufacturer_ok, the attribute tally and the status of each description
    (`.._status`) of every product; unscored, with statuses NO_GT, without a labelled row. A description that one of the
    tables lacks counts as empty there."""
    cell = lambda rows, c: F.col(c).cast("string") if c in rows.columns else F.lit(None).cast("string")
    t = truth.select("seq", F.trim("classpath").alias("t_class"), F.trim("manufacturer").alias("t_maker"), *[X.strip(cell(truth, d)).alias(f"t_{d}") for d in DESCRIPTIONS], F.lit(True).alias("scored"))
    made = products.select("seq", "classpath", "manufacturer_name", *[cell(products, d).alias(d) for d in DESCRIPTIONS])
    out = made.join(rowwise(t), "seq", "left").join(rowwise(attribute_tally(true_attributes, attributes)), "seq", "left")
    for d in DESCRIPTIONS:
        out = match_status(out, d, f"t_{d}", f"{d}_status")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return out.select(
        "seq", F.coalesce("scored", F.lit(False)).alias("scored"), F.col("classpath").eqNullSafe(F.col("t_class")).alias("classpath_ok"),
        F.col("manufacturer_name").eqNullSafe(F.col("t_maker")).alias("manufacturer_ok"), *[zero(c) for c in ("expected", "exact", "close", "missed")], *[f"{d}_status" for d in DESCRIPTIONS],
    )


def summarize(evaluated: DataFrame) -> DataFrame:
    """One row over the scored rows: totals, what is right and percentages of classes, makers, attributes and each
    description (`.._total` leaves out rows without a labelled text)."""
    s = evaluated.where("scored")
    total = lambda d: F.count_if(F.col(f"{d}_status") != "NO_GT")
    right = lambda d: F.count_if(F.col(f"{d}_status") == "EXACT")
    counts = [F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in ("expected", "exact", "close")]
    counts += [x for d in DESCRIPTIONS for x in (right(d).alias(f"{d}_correct"), total(d).alias(f"{d}_total"))]
    out = s.agg(F.count("*").alias("n"), F.count_if("classpath_ok").alias("c"), F.count_if("manufacturer_ok").alias("m"), *counts)
    return out.select(
        F.col("n").alias("rows_scored"), F.col("c").alias("classpath_correct"), percent(F.col("c"), F.col("n")).alias("classpath_pct"),
        F.col("m").alias("manufacturer_correct"), percent(F.col("m"), F.col("n")).alias("manufacturer_pct"),
        F.col("expected").alias("attributes"), F.col("exact").alias("exact_correct"), percent(F.col("exact"), F.col("expected")).alias("exact_pct"), percent(F.col("close"), F.col("expected")).alias("close_pct"),
        *[x for d in DESCRIPTIONS for x in (f"{d}_correct", f"{d}_total", percent(F.col(f"{d}_correct"), F.col(f"{d}_total")).alias(f"{d}_pct"))],
    )


def replay(validated: DataFrame, flags: list[str]) -> DataFrame:
    """flag, passed, failed of each validator."""
    long = validated.select(F.explode(F.array(*[F.struct(F.lit(f).alias("flag"), F.col(f).alias("ok")) for f in flags])).alias("x")).select("x.*")
    return long.groupBy("flag").agg(F.count_if("ok").alias("passed"), F.count_if(~F.col("ok")).alias("failed"))


def replay_report(scored: DataFrame, attributes: DataFrame, true_attributes: DataFrame, flags: list[str], inputs: list[str]) -> DataFrame:
    """section, value, products, right, wrong and the mean of each input, by grouping sets in one pass: a section for each
    flag (value true or false), one for the bands, one for all products (value empty).

    right and wrong count a product's labelled attributes whose produced value is the same; products without
    classpath have neither. scored: seq, classpath, band, the flags and inputs. attributes: written before, as they are counted.
    Labelled and produced attributes are dealt as one table, so they meet without a join."""
    side = lambda t, wanted: t.select("seq", "label", "slot", "value", F.lit(wanted).alias("wanted"))
    pairs = side(true_attributes.where("label <> '' and value <> ''"), True).unionByName(side(attributes.where("value <> ''"), False))
    last = lambda c: F.max_by(F.when(c, F.col("value")), F.when(c, F.col("slot")))
    pairs = dealt(pairs, attributes.count(), "seq", rows=SLOTS // 2).groupBy("seq", "label").agg(last(F.col("wanted")).alias("want"), last(~F.col("wanted")).alias("got"), F.max("wanted").alias("wanted"))
    same = F.coalesce(F.col("got") == F.col("want"), F.lit(False))
    per = pairs.where("wanted").groupBy("seq").agg(F.count_if(same).alias("right"), F.count_if(~same).alias("wrong"))
    counted = F.coalesce(F.col("classpath"), F.lit("")) != ""
    both = scored.select("seq", "classpath", "band", *flags, *inputs).join(rowwise(per), "seq", "left")
    both = both.select(*[F.col(f).cast("string").alias(f) for f in flags], "band", *inputs, *[F.when(counted, F.col(c)).otherwise(0).alias(c) for c in ("right", "wrong")])
    keys = [*flags, "band"]
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    out = both.groupingSets([[k] for k in keys] + [[]], *keys).agg(F.grouping_id().alias("g"), F.count("*").alias("products"), zero("right"), zero("wrong"), *[F.round(F.avg(c), 6).alias(f"mean_{c}") for c in inputs])
    # in the set of a key its bit alone is clear
    section = F.lit("all")
    for i, k in enumerate(keys):
        section = F.when(F.col("g") == (1 << len(keys)) - 1 - (1 << (len(keys) - 1 - i)), k).otherwise(section)
    return out.select(section.alias("section"), F.coalesce(*keys, F.lit("")).alias("value"), "products", "right", "wrong", *[f"mean_{c}" for c in inputs])


def source_counts(attributes: DataFrame) -> DataFrame:
    """One row: rows whose filled attributes all have a source URL (strict) or at least a text (gated),
    attributes that fail the strict rule, and of these those with neither (hard) and with a text only (soft)."""
    bare = (F.col("value") != "") & F.col("source_url").isNull()
    hard = bare & F.col("evidence_text").isNull()
    per = attributes.groupBy("seq").agg(F.count_if(bare).alias("b"), F.count_if(hard).alias("h"))
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return per.agg(F.count_if(F.col("b") == 0).alias("strict_pass"), F.count_if(F.col("h") == 0).alias("gated_pass"), zero("b").alias("strict_fails"), zero("h").alias("hard"), (zero("b") - zero("h")).alias("soft"))


def compare_arms(results: DataFrame) -> DataFrame:
    """arm, ok, skipped, errors, expected, right, pct of results (arm, call: ok, skipped or error: .., expected, right)."""
    out = results.groupBy("arm").agg(
        F.count_if(F.col("call") == "ok").alias("ok"), F.count_if(F.col("call") == "skipped").alias("skipped"), F.count_if(F.col("call").startswith("error")).alias("errors"),
        F.sum("expected").alias("expected"), F.sum("right").alias("right"),
    )
    return out.withColumn("pct", percent(F.col("right"), F.col("expected")))


def description_scores(made: DataFrame, truth: DataFrame, led: str, fields: list[str], most: int = 40) -> DataFrame:
    """One row: rows, exact matches of each text with the labelled one, invoice texts over the limit, and
    rows of other classes whose texts speak of bulbs or LEDs."""
    t = truth.select("seq", *[F.col(f).alias(f"t_{f}") for f in fields])
    both = made.join(rowwise(t), "seq")
    said = F.exists(F.transform(F.array(*fields), F.lower), lambda x: x.contains("bulb") | x.contains(" led") | x.startswith("led"))
    wrong = (F.coalesce("classpath", F.lit("")) != led) & F.coalesce(said, F.lit(False))
    return both.agg(F.count("*").alias("rows"), *[F.count_if(F.col(f) == F.col(f"t_{f}")).alias(f"exact_{f.lower()}") for f in fields], F.count_if(F.length(fields[0]) > most).alias("over_limit"), F.count_if(wrong).alias("wrong_noun"))


def whole_run(matched: DataFrame, attributes: DataFrame, true_attributes: DataFrame) -> DataFrame:
    """One row of a whole run against labelled rows, exact matches only. matched: seq (labelled), made (the
    product's seq, null: missing), row_error, classpath, manufacturer_name, t_class, t_maker."""
    want = true_attributes.where("value <> ''").select("seq", "label", F.col("value").alias("want"))
    got = attributes.where("value <> ''").groupBy(F.col("seq").alias("made"), "label").agg(F.max_by("value", "slot").alias("got"))
    fields = matched.where("made is not null").select("seq", "made").join(rowwise(want), "seq").join(rowwise(got), ["made", "label"], "left").agg(F.count("*").alias("fields"), F.count_if(F.col("got") == F.col("want")).alias("fields_right"))
    rows = matched.agg(
        F.count("*").alias("rows"), F.count_if(F.col("made").isNull() | F.col("row_error").isNotNull()).alias("errors"),
        F.count_if(F.col("classpath") == F.col("t_class")).alias("classpath_right"), F.count_if(F.col("manufacturer_name") == F.col("t_maker")).alias("manufacturer_right"),
    )
    return rows.crossJoin(fields)  # one row each


def accuracy(answers: DataFrame, subset: str) -> DataFrame:
    """One row: rows, right, pct of answers (classpath, answer), and the same of the classes that end in subset."""
    right = F.coalesce(F.col("classpath") == F.col("answer"), F.lit(False))
    part = F.col("classpath").endswith(subset)
    out = answers.agg(F.count("*").alias("rows"), F.count_if(right).alias("right"), F.count_if(part).alias("subset_rows"), F.count_if(part & right).alias("subset_right"))
    return out.select("*", percent(F.col("right"), F.col("rows")).alias("pct"), percent(F.col("subset_right"), F.col("subset_rows")).alias("subset_pct"))


def band_table(scored: DataFrame, correct: str) -> DataFrame:
    """band, right, wrong, avg_confidence."""
    return scored.groupBy("band").agg(F.count_if(correct).alias("right"), F.count_if(~F.col(correct)).alias("wrong"), F.round(F.avg("confidence"), 4).alias("avg_confidence"))


def crosstab(rows: DataFrame, group: str, status: str, statuses: list[str]) -> DataFrame:
    """group, a count of each status, total and the percentage of the first."""
    counts = rows.groupBy(group).agg(*[F.count_if(F.col(status) == s).alias(s) for s in statuses], F.count("*").alias("total"))
    return counts.withColumn("pct", percent(F.col(statuses[0]), F.col("total")))


def coverage(attributes: DataFrame) -> DataFrame:
    """rows, and the rounded percentages of rows with any filled attribute and with one from a rule prior."""
    per = attributes.groupBy("seq").agg(F.max(F.col("value") != "").alias("any_"), F.max((F.col("value") != "") & F.coalesce(F.col("origin") == "rule_prior", F.lit(False))).alias("prior"))
    pct = lambda c: F.round(100 * F.avg(F.col(c).cast("double"))).cast("long")
    return per.agg(F.count("*").alias("rows"), pct("any_").alias("any_pct"), pct("prior").alias("prior_pct"))


def same_lists(rows: DataFrame, got: str, want: str) -> DataFrame:
    """rows with equal (whole lists) and agree (places at which both have the same item)."""
    pairs = F.zip_with(got, want, lambda a, b: F.coalesce(a == b, F.lit(False)).cast("long"))
    return rows.withColumns({"equal": F.col(got).eqNullSafe(F.col(want)), "agree": F.aggregate(pairs, F.lit(0).cast("long"), lambda a, x: a + x)})


def stride_sample(rows: DataFrame, order: str, keep: Column, step: int) -> DataFrame:
    """All rows that keep holds for, and every step-th of the others in order of a number (ties by the row).

    Numbers run in two levels: ranges of the order are counted and the counts summed up, then rows are
    numbered within their range, so that no task sorts more than a range."""
    rest = rows.where(~keep)
    edges = [r for r in (rest.stat.approxQuantile(order, [i / RANGES for i in range(1, RANGES)], 1 / (4 * RANGES)) if not rest.isEmpty() else [])]
    part = F.lit(0)
    if edges:
        part = F.aggregate(F.array(*[F.lit(float(e)) for e in edges]), F.lit(0), lambda n, e: n + (F.col(order) > e).cast("int"))
    rest = kept(rest.withColumn("__part", part), "strided")
    before = rest.groupBy("__part").agg(F.count("*").alias("n"))
    before = before.select("__part", (F.sum("n").over(Window.orderBy("__part")) - F.col("n")).alias("__before"))  # RANGES rows
    n = F.row_number().over(Window.partitionBy("__part").orderBy(order, F.xxhash64(*rows.columns))) - 1
    taken = rest.withColumn("__n", n).join(before, "__part").where((F.col("__n") + F.col("__before")) % step == 0)
    return rows.where(keep).unionByName(taken.select(*rows.columns))
