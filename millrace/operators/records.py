"""The nested product record: made from enriched rows, stored as JSON, read back with its faults as data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.sources.staging import rowwise

from .exporting import SLOTS, TEXTS

_STRING, _STRINGS = T.StringType(), T.ArrayType(T.StringType())
ATTRIBUTE = T.StructType(
    [T.StructField("slot", T.IntegerType())] + [T.StructField(c, _STRING) for c in ("label", "value", "uom", "source_url", "evidence_text")]
    + [T.StructField("lov_valid", T.BooleanType()), T.StructField("confidence", T.DoubleType()), T.StructField("origin", _STRING)]
)
DESCRIPTIONS = T.StructType([T.StructField(t.lower(), _STRING) for t in ("INVOICE_DESC", "MOBILE_DESC", "SHORT_DESC", "LONG_DESC1", "RETAIL_DESC", "MARKETING_DESCRIPTION")] + [T.StructField("item_features", _STRINGS)])
FLAGS = ("v1_required", "v2_lov", "v3_uom_inline", "v4_casing_inline", "v5_brand_mfr", "v6_source_url")
VALIDATION = T.StructType([T.StructField(f, T.BooleanType()) for f in FLAGS] + [T.StructField("warnings", _STRINGS), T.StructField("needs_human_review", T.BooleanType())])
#: The record of one product.
RECORD = T.StructType(
    [T.StructField(c, _STRING) for c in ("product_id", "job_id", "mfg_part_num", "part_desc", "part_manuf_raw", "manufacturer_name", "brand_name", "classpath", "mfr_url")]
    + [
        T.StructField("ref_urls", _STRINGS), T.StructField("attributes", T.ArrayType(ATTRIBUTE)), T.StructField("descriptions", DESCRIPTIONS), T.StructField("validation", VALIDATION),
        T.StructField("confidence", T.DoubleType()), T.StructField("confidence_band", _STRING), T.StructField("row_error", _STRING), T.StructField("raw_input_cols", T.MapType(_STRING, _STRING)),
    ]
)
BANDS = ["VERIFIED", "REVIEW", "LOW"]
FAILED = "EXPORT_VALIDATION_FAILED"


def product_id(job_id: str):
    """A content hash, so that a rerun gives the same ids."""
    return F.sha2(F.concat(F.lit(job_id + "|"), F.col("seq").cast("string")), 256)


def _cell(rows: DataFrame, c: str, kind: T.DataType | None = None):
    """A column of rows, null where they lack it, in the record's type."""
    return (F.col(c) if c in rows.columns else F.lit(None)).cast(kind or _STRING)


def records(products: DataFrame, attributes: DataFrame, job_id: str) -> DataFrame:
    """seq, record of enriched products (as plans.enrich returns them) and their attributes. Columns that products
    lack are null in the record; a product's attributes, at most its slots, stand in order of slot."""
    have = set(attributes.columns)
    fields = [(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in ATTRIBUTE.fields]
    slots = attributes.groupBy("seq").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("__attributes"))
    p = products.join(rowwise(slots), "seq", "left")
    cell = lambda c, kind=None: _cell(products, c, kind)
    text = lambda c: F.coalesce(cell(c), F.lit(""))
    texts = F.struct(*[cell(t).alias(t.lower()) for t in ("INVOICE_DESC", "MOBILE_DESC", "SHORT_DESC", "LONG_DESC1", "RETAIL_DESC", "MARKETING_DESCRIPTION")], F.coalesce(cell("features", _STRINGS), F.array().cast(_STRINGS)).alias("item_features"))
    flag = lambda c: F.coalesce(cell(c, T.BooleanType()), F.lit(False))
    validation = F.struct(*[flag(f).alias(f) for f in FLAGS], F.coalesce(cell("warnings", _STRINGS), F.array().cast(_STRINGS)).alias("warnings"), flag("needs_review").alias("needs_human_review"))
    urls = F.coalesce(cell("ref_urls", _STRINGS), F.when(cell("mfr_url").isNotNull(), F.array(cell("mfr_url"))), F.array().cast(_STRINGS))
    made = {
        "product_id": product_id(job_id), "job_id": F.lit(job_id), "mfg_part_num": text("Mfg_Part_Num"), "part_desc": text("Part_Desc"), "part_manuf_raw": cell("Part_Manuf"),
        "manufacturer_name": cell("manufacturer_name"), "brand_name": cell("brand"), "classpath": cell("classpath"), "mfr_url": cell("mfr_url"), "ref_urls": urls,
        "attributes": F.coalesce("__attributes", F.array().cast(T.ArrayType(ATTRIBUTE))), "descriptions": texts, "validation": validation,
        "confidence": F.coalesce(cell("confidence", T.DoubleType()), F.lit(0.0)), "confidence_band": F.coalesce(cell("band"), F.lit("LOW")), "row_error": cell("row_error"),
        "raw_input_cols": F.coalesce(cell("raw", T.MapType(_STRING, _STRING)), F.create_map().cast(T.MapType(_STRING, _STRING))),
    }
    return p.select("seq", F.struct(*[made[f.name].cast(f.dataType).alias(f.name) for f in RECORD.fields]).alias("record"))


def parsed(rows: DataFrame, column: str = "data_json", job_id: str = "job_id", mpn: str = "mfg_part_num") -> DataFrame:
    """rows with record: a stored JSON product, whatever has become of it.

    Absent fields have their defaults. The four that must be there are filled from the row: id (a content hash of job and
    JSON), job, part number, an empty description; text that is no JSON counts as an empty object. What is JSON but no
    product (a value of another type, an unknown band, a confidence out of range, an attribute without slot or
    label) becomes a bare record with row_error."""
    known = lambda c: F.col(c).cast(_STRING) if c in rows.columns else F.lit("")
    json = F.coalesce(F.col(column), F.lit(""))
    none = F.try_parse_json(json).isNull()
    read = F.from_json(F.when(none, "{}").otherwise(json), T.StructType([*RECORD.fields, T.StructField("_corrupt", _STRING)]), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    p = rows.withColumn("__none", none).withColumn("__p", read)
    faults = F.array_compact(
        F.array(
            F.when(F.col("__p").isNull() | F.col("__p._corrupt").isNotNull(), "types"),
            F.when(~F.col("__p.confidence_band").isin(BANDS), "confidence_band"),
            F.when(~F.col("__p.confidence").between(0, 100), "confidence"),
            F.when(F.exists("__p.attributes", lambda a: a["slot"].isNull() | a["label"].isNull()), "attributes"),
        )
    )
    p = p.withColumn("__bad", F.size(faults) > 0).withColumn("__error", F.when(F.size(faults) > 0, F.concat(F.lit(FAILED + ": "), F.array_join(faults, ", "))))
    given = lambda c: F.nullif(F.col(f"__p.{c}"), F.lit(""))
    flags = [F.coalesce(F.col(f"__p.validation.{f}"), F.lit(False)).alias(f) for f in (*FLAGS, "needs_human_review")]
    empty = lambda t: F.array().cast(t)
    attributes = T.ArrayType(ATTRIBUTE)
    texts = [F.col(f"__p.descriptions.{f.name}").alias(f.name) for f in DESCRIPTIONS.fields[:-1]]
    none_text = [F.lit(None).cast(_STRING).alias(f.name) for f in DESCRIPTIONS.fields[:-1]]
    unless = lambda good, bad: F.when(F.col("__bad"), bad).otherwise(good)
    features = F.coalesce("__p.descriptions.item_features", empty(_STRINGS))
    made = {f.name: unless(F.col(f"__p.{f.name}"), F.lit(None).cast(f.dataType)) for f in RECORD.fields} | {
        "product_id": F.coalesce(given("product_id"), F.sha2(F.concat_ws("|", known(job_id), known(mpn), json), 256)),
        "job_id": F.coalesce(unless(given("job_id"), F.lit(None)), known(job_id)), "mfg_part_num": F.coalesce(unless(given("mfg_part_num"), F.lit(None)), known(mpn), F.lit("")),
        "part_desc": F.coalesce(unless(F.col("__p.part_desc"), F.lit(None)), F.lit("")), "ref_urls": F.coalesce(unless(F.col("__p.ref_urls"), F.lit(None)), empty(_STRINGS)),
        "attributes": F.coalesce(unless(F.col("__p.attributes"), F.lit(None)), empty(attributes)),
        "descriptions": unless(F.struct(*texts, features.alias("item_features")), F.struct(*none_text, empty(_STRINGS).alias("item_features"))),
        "validation": unless(F.struct(*flags[:-1], F.coalesce("__p.validation.warnings", empty(_STRINGS)).alias("warnings"), flags[-1]), F.struct(*[F.lit(False).alias(f) for f in FLAGS], empty(_STRINGS).alias("warnings"), F.lit(False).alias("needs_human_review"))),
        "confidence": F.coalesce(unless(F.col("__p.confidence"), F.lit(None)), F.lit(0.0)), "confidence_band": F.coalesce(unless(F.col("__p.confidence_band"), F.lit(None)), F.lit("LOW")),
        "row_error": F.coalesce("__error", F.col("__p.row_error")), "raw_input_cols": F.coalesce(unless(F.col("__p.raw_input_cols"), F.lit(None)), F.create_map().cast(T.MapType(_STRING, _STRING))),
    }
    record = F.struct(*[made[f.name].cast(f.dataType).alias(f.name) for f in RECORD.fields])
    return p.withColumn("record", record).drop("__none", "__p", "__bad", "__error")


def flat(rows: DataFrame) -> DataFrame:
    """rows (seq, record) as products that exporting.delivery and evaluating.evaluate read: a projection."""
    r = lambda c: F.col(f"record.{c}")
    names = {"Mfg_Part_Num": "mfg_part_num", "Part_Desc": "part_desc", "Part_Manuf": "part_manuf_raw", "manufacturer_name": "manufacturer_name", "brand": "brand_name", "classpath": "classpath", "mfr_url": "mfr_url", "ref_urls": "ref_urls", "confidence": "confidence", "band": "confidence_band", "row_error": "row_error", "raw": "raw_input_cols"}
    inside = F.filter(r("attributes"), lambda a: a["slot"].between(1, SLOTS))
    # of attributes that share a slot the last counts
    last = F.filter(inside, lambda a, i: ~F.exists(F.slice(inside, i + 2, F.lit(SLOTS)), lambda b: b["slot"] == a["slot"]))
    slots = F.map_from_entries(F.transform(last, lambda a: F.struct(a["slot"].alias("key"), F.struct(a["label"].alias("label"), a["value"].alias("value"), a["uom"].alias("uom")).alias("value"))))
    return rows.select("seq", *[r(c).alias(n) for n, c in names.items()], *[r(f"descriptions.{t.lower()}").alias(t) for t in TEXTS], r("descriptions.item_features").alias("features"), slots.alias("slots"))


def attributes_of(rows: DataFrame) -> DataFrame:
    """seq and the attributes of records, a row each."""
    return rows.select("seq", F.explode("record.attributes").alias("a")).select("seq", "a.*")


