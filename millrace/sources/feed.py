"""A catalog feed derived from the star schema, and readers of real feeds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .staging import spread

#: The columns of a raw feed, all strings.
RAW = ["Mfg_Part_Num", "Part_Desc", "E1_Brand", "Unilog_Brand", "DIB_Brand", "Part_Manuf"]
RAW_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in RAW])


def _csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV table by its header. A file is cut into tasks, unless a quoted cell goes over a line's end somewhere (a line
    with an odd number of quotes): then a file is one task. Raises ValueError where a line is not UTF-8. One
    pass over the lines decides both."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    seen = spark.read.text(path).agg(F.max(~F.expr("is_valid_utf8(value)")).alias("bad"), F.max(quotes % 2 == 1).alias("open")).first()
    if seen.bad:
        raise ValueError("not UTF-8")
    return spark.read.option("header", True).option("encoding", "UTF-8").option("emptyValue", "").option("quote", '"').option("escape", '"').option("multiLine", bool(seen.open)).csv(path)


def read_feed(spark: SparkSession, path: str) -> DataFrame:
    """A CSV feed by its header: columns that it lacks are left out, empty cells empty, a byte-order mark goes.
    Raises ValueError where there is no data row, or where a line is not UTF-8."""
    df = _csv(spark, path)
    df = df.toDF(*[c.lstrip("﻿") for c in df.columns])
    if df.isEmpty():
        raise ValueError("no data rows")
    return df.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in RAW if c in df.columns])


def read_labelled(spark: SparkSession, path: str) -> DataFrame:
    """A labelled CSV table, all columns as strings in its own order, with seq in file order; a byte-order
    mark goes, empty cells are empty."""
    df = _csv(spark, path)
    names = [c.lstrip("\ufeff") for c in df.columns]
    return df.toDF(*names).select(F.monotonically_increasing_id().alias("seq"), *[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in names])


def _tables(spark: SparkSession, sf_dir: str):
    part, supplier, nation = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("part", "supplier", "nation"))
    return spread(part, "p_partkey"), supplier, nation


def feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq, the raw columns, and the labels classpath, manufacturer, mfr_url: one row for each part."""
    part, supplier, nation = _tables(spark, sf_dir)
    n = supplier.count()
    p = part.withColumns({"seq": F.col("p_partkey"), "w1": F.substring_index("p_name", " ", 1), "w2": F.substring_index("p_name", " ", -1)})
    p = p.join(supplier, F.col("s_suppkey") == F.col("seq") % n).join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    text = lambda c: F.col(c).cast("string") if isinstance(c, str) else c.cast("string")
    mpn = F.concat(F.lit("R"), F.lpad(text(F.col("seq") % 100), 2, "0"), F.lit("-"), F.upper("w1"), F.lit("-"), text("p_size"), F.when(F.col("seq") % 2 == 0, "KW").otherwise("K"))
    desc = F.concat_ws(" ", "p_name", "p_type", F.concat(text("p_size"), F.lit("W")), F.concat(text(20 + F.col("seq") % 31), F.lit("k")), F.concat(text(F.col("seq") % 9), F.lit(".5in")))
    code = F.col("s_suppkey") % int(0.6 * n)
    name = F.concat(F.when(F.col("seq") % 11 == 1, "Suplier#").otherwise("Supplier#"), F.lpad(text(code), 9, "0"), F.lit(" ("), text(code), F.lit(")"))
    e1 = F.when(F.col("seq") % 7 == 0, "-- Unbranded --").when(F.col("seq") % 7 == 1, F.concat(F.lit(" "), "p_brand", F.lit(" "))).when(F.col("seq") % 7 == 2, "").otherwise(F.col("p_brand"))
    url = F.concat(F.lit("https://www."), F.lower(F.replace("n_name", F.lit("_"), F.lit(""))), F.lit(".com/products/"), F.when(F.col("seq") % 9 == 0, F.concat(F.lit("x"), text("seq"))).otherwise(mpn))
    return p.select(
        "seq", mpn.alias("Mfg_Part_Num"), desc.alias("Part_Desc"), e1.alias("E1_Brand"),
        F.when(F.col("seq") % 5 == 0, "-- No Unilog Brand --").otherwise(F.col("p_brand")).alias("Unilog_Brand"),
        F.when(F.col("seq") % 3 == 0, "-- No DIB Brand --").otherwise(F.col("p_brand")).alias("DIB_Brand"),
        F.when(F.col("seq") % 11 == 0, "-").otherwise(name).alias("Part_Manuf"),
        F.concat("p_type", F.lit(">"), "w2").alias("classpath"), F.col("n_name").alias("manufacturer"), url.alias("mfr_url"),
        "p_size", "p_brand", "w1",
    )


def attributes(rows: DataFrame) -> DataFrame:
    """seq, classpath, slot, label, value, uom of a feed: the labelled attributes, five to a part."""
    text = lambda c: c.cast("string")
    seq = F.col("seq")
    slot = lambda n, label, value, uom: F.struct(F.lit(n).alias("slot"), F.lit(label).alias("label"), value.alias("value"), F.lit(uom).alias("uom"))
    slots = F.array(
        slot(1, "Wattage", text(F.col("p_size")), "W"), slot(2, "Color Temperature", text((20 + seq % 31) * 100), "K"),
        slot(3, "Length", F.concat(text(seq % 9), F.lit(".5")), "in"), slot(4, "Line", F.col("p_brand"), ""),
        slot(5, "Finish", F.when(seq % 4 == 0, "").otherwise(F.col("w1")), ""),
    )
    return rows.select("seq", "classpath", F.explode(slots).alias("s")).select("seq", "classpath", "s.*")


#: The feed and its attributes as DuckDB SQL.
FEED_SQL = """
feed AS (
  SELECT p_partkey AS seq,
    'R' || lpad(CAST(p_partkey % 100 AS VARCHAR), 2, '0') || '-' || upper(substr(p_name, 1, instr(p_name, ' ') - 1)) || '-' || CAST(p_size AS VARCHAR)
      || CASE WHEN p_partkey % 2 = 0 THEN 'KW' ELSE 'K' END AS Mfg_Part_Num,
    p_name || ' ' || p_type || ' ' || CAST(p_size AS VARCHAR) || 'W ' || CAST(20 + p_partkey % 31 AS VARCHAR) || 'k ' || CAST(p_partkey % 9 AS VARCHAR) || '.5in' AS Part_Desc,
    CASE p_partkey % 7 WHEN 0 THEN '-- Unbranded --' WHEN 1 THEN ' ' || p_brand || ' ' WHEN 2 THEN '' ELSE p_brand END AS E1_Brand,
    CASE WHEN p_partkey % 5 = 0 THEN '-- No Unilog Brand --' ELSE p_brand END AS Unilog_Brand,
    CASE WHEN p_partkey % 3 = 0 THEN '-- No DIB Brand --' ELSE p_brand END AS DIB_Brand,
    CASE WHEN p_partkey % 11 = 0 THEN '-' ELSE CASE WHEN p_partkey % 11 = 1 THEN 'Suplier#' ELSE 'Supplier#' END
      || lpad(CAST(s_suppkey % k AS VARCHAR), 9, '0') || ' (' || CAST(s_suppkey % k AS VARCHAR) || ')' END AS Part_Manuf,
    p_type || '>' || substr(p_name, instr(p_name, ' ') + 1) AS classpath, n_name AS manufacturer,
    'https://www.' || lower(replace(n_name, '_', '')) || '.com/products/' || CASE WHEN p_partkey % 9 = 0 THEN 'x' || CAST(p_partkey AS VARCHAR) ELSE
      'R' || lpad(CAST(p_partkey % 100 AS VARCHAR), 2, '0') || '-' || upper(substr(p_name, 1, instr(p_name, ' ') - 1)) || '-' || CAST(p_size AS VARCHAR)
      || CASE WHEN p_partkey % 2 = 0 THEN 'KW' ELSE 'K' END END AS mfr_url,
    p_size, p_brand, substr(p_name, 1, instr(p_name, ' ') - 1) AS w1
  FROM part CROSS JOIN (SELECT count(*) AS n, CAST(floor(0.6 * count(*)) AS BIGINT) AS k FROM supplier)
  JOIN supplier ON s_suppkey = p_partkey % n JOIN nation ON s_nationkey = n_nationkey),
attributes AS (
  SELECT seq, classpath, 1 AS slot, 'Wattage' AS label, CAST(p_size AS VARCHAR) AS value, 'W' AS uom FROM feed
  UNION ALL SELECT seq, classpath, 2, 'Color Temperature', CAST((20 + seq % 31) * 100 AS VARCHAR), 'K' FROM feed
  UNION ALL SELECT seq, classpath, 3, 'Length', CAST(seq % 9 AS VARCHAR) || '.5', 'in' FROM feed
  UNION ALL SELECT seq, classpath, 4, 'Line', p_brand, '' FROM feed
  UNION ALL SELECT seq, classpath, 5, 'Finish', CASE WHEN seq % 4 = 0 THEN '' ELSE w1 END, '' FROM feed)"""
