"""What a language model answers, as tables: attributes from texts, classes, prose. Requests are keyed by
their prompt and answered through the cache; the model is a function on the distinct misses, or absent."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators import caching, classifying, describing, prompts, reconciling
from millrace.sources.staging import rowwise

from .resolving import lookup

#: Keys of a prose answer: fixed values.
PROSE = ["long_desc1", "marketing_description"]
Call = Callable[[DataFrame], DataFrame]


def nothing(missing: DataFrame) -> DataFrame:
    """The model where none is configured: every miss stays unanswered."""
    return missing.withColumn("response", F.lit(None).cast("string"))


def configured(call: Call | None, key: str | None) -> Call:
    """The model behind its gate: without a key nothing is asked, and every miss stays unanswered."""
    return call if call and key else nothing


def requested(rows: DataFrame, namespace: str, model: str, prompt: Column, legacy: Column | None = None, temperature: str = "0") -> DataFrame:
    """rows as requests: namespace, model, prompt, prompt_hash and, with a legacy prompt, old_hash."""
    key = lambda p: caching.prompt_hash(F.lit(model), F.lit(namespace), p, temperature)
    out = rows.withColumns({"namespace": F.lit(namespace), "model": F.lit(model), "prompt": prompt})
    out = out.withColumn("prompt_hash", key(F.col("prompt")))
    return out if legacy is None else out.withColumn("old_hash", key(legacy))


def asked(rows: DataFrame, lines: DataFrame, model: str = "m", namespace: str = "extract_fallback") -> DataFrame:
    """The requests of rows (seq, classpath, manufacturer, text) with text and template, written once: seq, classpath,
    namespace, model, prompt, prompt_hash, old_hash. lines: what prompts.slot_lines() returns."""
    asking = rows.where("text <> ''").join(lines, "classpath")
    if namespace == "extract_page":
        prompt = older = prompts.page_prompt(F.col("labels"), F.col("text"))
    else:
        prompt, older = (prompts.fallback_prompt(F.col("text"), F.col("classpath"), m, F.col("lines")) for m in (F.col("manufacturer"), F.lit(None).cast("string")))
    requests = requested(asking, namespace, model, prompt, older)
    return caching.stored(requests.select("seq", "classpath", "namespace", "model", "prompt", "prompt_hash", "old_hash"))


def answers(requests: DataFrame, lines: DataFrame, cache: DataFrame, call: Call | None = None) -> tuple[DataFrame, DataFrame]:
    """seq, label, value of the answers to asked(), and the rows to append to the cache. A row brings its class, so its pairs meet
    the labels of a class and not the rows."""
    answered, fresh = caching.read_through(requests, cache, call or nothing, "old_hash")
    pairs = answered.select("seq", "classpath", F.explode(caching.parsed(F.col("response"))).alias("label", "value")).where(reconciling.telling(F.col("value")))
    labels = lines.select("classpath", F.col("labels").alias("__labels"))
    return pairs.join(labels, "classpath").where(F.array_contains("__labels", F.col("label"))).select("seq", "label", "value"), fresh


def extract(rows: DataFrame, templates: DataFrame, allowed: DataFrame, cache: DataFrame, call: Call | None = None, model: str = "m", namespace: str = "extract_fallback") -> tuple[DataFrame, DataFrame]:
    """seq, label, value that the model reads from rows (seq, classpath, manufacturer, text), and the
    rows to append to the cache. Rows without text or template ask nothing; only labels of the template
    and telling values count. In the namespace extract_page the text is a page's; else it is a row's description,
    and an answer given while the manufacturer was not known still holds."""
    lines = lookup(prompts.slot_lines(templates, allowed))
    return answers(asked(rows, lines, model, namespace), lines, cache, call)


def classify_by_answer(rows: DataFrame, ruled: DataFrame, classes: DataFrame, cache: DataFrame, call: Call | None = None, model: str = "m") -> DataFrame:
    """seq, classpath, confidence, method: the model's choice from a shortlist where it names a known class,
    else the rules'. rows: seq, Part_Desc, manufacturer; ruled: what classify() returns; classes: column classpath."""
    short = classifying.shortlist(ruled, classes)
    asking = rows.select("seq", "Part_Desc", "manufacturer").join(rowwise(short), "seq").join(rowwise(ruled.select("seq", "classpath", "confidence")), "seq")
    prompt = prompts.class_prompt(F.col("candidates"), F.col("Part_Desc"), F.col("manufacturer"))
    answered, _ = caching.read_through(requested(asking, "classify", model, prompt), cache, call or nothing)
    return classifying.accept_answer(answered.select("seq", "classpath", "confidence", F.col("response").alias("answer")), classes)


def prose(rows: DataFrame, cache: DataFrame, call: Call | None = None, model: str = "m") -> DataFrame:
    """seq and the prose texts of rows (seq, Mfg_Part_Num, manufacturer_name, classpath, attrs) with any
    valued attribute; null where the answer lacks them."""
    asking = rows.where("classpath <> '' and size(attrs) > 0")
    facts = F.to_json(F.map_from_entries(F.array_sort(F.map_entries("attrs"))))
    prompt = F.concat(F.lit("Product: "), F.element_at(F.split("classpath", ">"), -1), F.lit("\nManufacturer: "), F.coalesce("manufacturer_name", F.lit("unknown")), F.lit("\nPart number: "), "Mfg_Part_Num", F.lit("\nFacts: "), facts)
    answered, _ = caching.read_through(requested(asking.select("seq", "Mfg_Part_Num", "manufacturer_name", "classpath", "attrs"), "prose", model, prompt, temperature="0.4"), cache, call or nothing)
    said = caching.parsed(F.col("response"))
    return answered.select("seq", *[F.nullif(F.try_element_at(said, F.lit(k)), F.lit("")).alias(k) for k in PROSE])


def routed(described: DataFrame, said: DataFrame, silent: DataFrame, copy: DataFrame) -> DataFrame:
    """described with LONG_DESC1, MARKETING_DESCRIPTION and features: one category by rule and table (copy:
    seq, marketing, features), the others by prose, without marketing in classes (silent: classpath) that
    mostly have none."""
    said = said.select("seq", F.col("long_desc1").alias("__long"), F.col("marketing_description").alias("__copy"))  # names are compared without case
    out = described.join(said, "seq", "left").join(copy.select("seq", "marketing", F.col("features").alias("__features")), "seq", "left")
    out = out.join(lookup(silent.select("classpath", F.lit(True).alias("__silent")).distinct()), "classpath", "left")
    led, none = F.col("classpath") == describing.LED, F.expr("cast(array() as array<string>)")
    marketing = F.when(led, F.col("marketing")).when(F.col("__silent"), F.lit(None)).otherwise(F.col("__copy"))
    texts = {"LONG_DESC1": F.when(led, F.col("LONG_DESC1")).otherwise(F.col("__long")), "MARKETING_DESCRIPTION": F.nullif(marketing, F.lit("")), "features": F.when(led, F.coalesce("__features", none)).otherwise(none)}
    return out.withColumns(texts).drop("marketing", "__features", "__silent", "__copy", "__long")
