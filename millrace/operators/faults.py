"""Errors as data: a row that cannot be worked on comes through with row_error, in the same pass as the others."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of an error that are kept.
LONGEST = 500


def attempt(f: Callable, kind: str) -> Callable[..., Column]:
    """A Python function of single values as a column function that does not raise: struct<value, error>, with error
    "Type: message" where f raises. Runs in Arrow batches; a batch goes on behind a row that raises."""

    def tried(*cells: pd.Series) -> pd.DataFrame:
        values, errors = [], []
        for row in zip(*cells):
            try:
                values.append(f(*row))
                errors.append(None)
            except Exception as e:  # noqa: BLE001  whatever a row's data do
                values.append(None)
                errors.append(f"{type(e).__name__}: {e}"[:LONGEST])
        return pd.DataFrame({"value": pd.Series(values, dtype=object), "error": pd.Series(errors, dtype=object)})

    return F.pandas_udf(tried, f"value {kind}, error string")


def settled(rows: DataFrame, tried: dict[str, str]) -> DataFrame:
    """rows with a column for each attempt (name: column of attempt()), and row_error, the first attempt's error if
    any; on such a row the values of all attempts are null."""
    errors = [F.col(f"{c}.error") for c in tried.values()]
    if "row_error" in rows.columns:
        errors = [F.col("row_error"), *errors]
    rows = rows.withColumn("row_error", F.coalesce(*errors))
    return rows.withColumns({n: F.when(F.col("row_error").isNull(), F.col(f"{c}.value")) for n, c in tried.items()}).drop(*tried.values())


def error_rows(rows: DataFrame) -> DataFrame:
    """rows as stubs of products: nothing but what they are, their row_error, confidence 0 and band LOW."""
    return rows.withColumns({"confidence": F.lit(0.0), "band": F.lit("LOW")})


def guarded(enrich: Callable[[DataFrame], DataFrame], checks: dict[str, Column]) -> Callable[[DataFrame], DataFrame]:
    """enrich for the rows that no check holds for, in one pass; a row that one does comes through as it is, with
    the first check's name as row_error, confidence 0 and band LOW. So do rows that enrich itself gives a row_error.
    checks: name and condition (null: does not hold)."""

    def run(rows: DataFrame) -> DataFrame:
        bad = F.coalesce(*[F.when(c, F.lit(n)) for n, c in checks.items()], F.lit(None).cast("string"))
        rows = rows.withColumn("__bad", bad)
        made = enrich(rows.where("__bad is null").drop("__bad"))
        if "row_error" not in made.columns:
            made = made.withColumn("row_error", F.lit(None).cast("string"))
        failed = F.col("row_error").isNotNull()
        made = made.withColumns({c: F.when(failed, F.lit(v)).otherwise(F.col(c)) for c, v in (("confidence", 0.0), ("band", "LOW")) if c in made.columns})
        stubs = error_rows(rows.where("__bad is not null").withColumnRenamed("__bad", "row_error"))
        return made.unionByName(stubs.select(*[c for c in stubs.columns if c in made.columns]), allowMissingColumns=True)

    return run
