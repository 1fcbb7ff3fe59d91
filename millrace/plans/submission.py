"""The export job: first rows of a feed, enriched, matched to their input rows and delivered as CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators import exporting, records
from millrace.plans import enrich as plan
from millrace.sources import lookups
from millrace.sources.feed import RAW
from millrace.sources.staging import kept, rowwise


def submission(raw: DataFrame, look: plan.Lookups, columns: list[str] | None = None, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """seq and delivery columns of every input row, and one row of counts (rows, with_output, stubbed).

    raw: seq and raw columns. An input row's product is the nth product of its part number, as both stand in
    order of seq: input rows count by the number as written, products by the cleaned one. An input row without
    product gives a row of its raw cells."""
    inputs = kept(lookups.first_rows(raw, "seq", limit), "inputs")
    products, attributes = plan.enrich(inputs, look)
    products = kept(products, "products")  # the records and their numbers
    made = kept(exporting.delivery(records.flat(records.records(products, attributes, "submission")), columns), "made")
    numbers = products.select("seq", F.coalesce("Mfg_Part_Num", F.lit("")).alias("key"))
    keyed = inputs.select("seq", F.coalesce("Mfg_Part_Num", F.lit("")).alias("key"))
    met = kept(exporting.matched(keyed, numbers, "key", "seq").select("seq", "r_seq"), "matched")
    out = met.where("r_seq is not null").join(rowwise(made.withColumnRenamed("seq", "r_seq")), "r_seq").drop("r_seq")
    cells = F.create_map(*[x for c in RAW if c in inputs.columns for x in (F.lit(c), F.col(c))])
    counts = met.agg(F.count("*").alias("rows"), F.count("r_seq").alias("with_output"), F.count_if(F.col("r_seq").isNull()).alias("stubbed"))
    return exporting.with_stubs(out, inputs.select("seq", cells.alias("raw"))), counts


def run(raw: DataFrame, look: plan.Lookups, path: str, columns: list[str] | None = None, limit: int | None = None) -> dict:
    """Writes the submission's CSV; its counts."""
    out, counts = submission(raw, look, columns, limit)
    exporting.write_csv(out, path)
    return counts.first().asDict()
