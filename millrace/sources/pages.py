"""Web pages: main text from HTML, fetch outcomes, magic bytes of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def page_text(html: Column) -> Column:
    """Text of a page: scripts, styles, comments, navigation and footers go, then all tags."""
    t = F.regexp_replace(html, r"(?is)<(script|style|nav|footer)\b.*?</\1\s*>|<!--.*?-->", " ")
    t = F.regexp_replace(t, r"(?s)<[^>]*>", " ")
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&amp;", "&")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(t, r"[ \t\n\r]+", " "))


def page_title(html: Column) -> Column:
    return F.nullif(F.regexp_extract(html, r"(?is)<title>(.*?)</title>", 1), F.lit(""))


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]*)", 1))


#: Parts that a mirror's hosts are dealt over.
PARTS = 64


def write_mirror(pages: DataFrame, path: str, parts: int = PARTS) -> None:
    """Pages (with url) as a mirror: a folder for each part of the hosts, rows in order of host, so that a scan of some
    hosts opens their folders and skips what lies between them."""
    rows = pages.withColumn("host", host(F.col("url"))).withColumn("part", F.pmod(F.xxhash64("host"), F.lit(parts)).cast("int"))
    # a host may hold a third of all pages: pages are dealt by part, host and page
    rows.repartitionByRange("part", "host", F.xxhash64("url")).sortWithinPartitions("part", "host").write.partitionBy("part").parquet(path)


def scan_mirror(spark: SparkSession, path: str, hosts: list[str] | None = None, columns: list[str] | None = None, parts: int = PARTS) -> DataFrame:
    """A mirror's pages of some hosts (all: None), the columns asked for. The folders come from the hosts, the rows of a folder from
    its statistics; other columns are not read."""
    rows = spark.read.parquet(path)
    if hosts is not None:
        names = [h.lower() for h in hosts]
        folders = [r[0] for r in spark.createDataFrame([(h,) for h in names], "h string").select(F.pmod(F.xxhash64("h"), F.lit(parts)).cast("int")).distinct().collect()] if names else []
        rows = rows.where(F.col("part").isin(folders) & F.col("host").isin(names))
    return rows.select(*(columns or [c for c in rows.columns if c != "part"]))


def is_pdf(content: Column) -> Column:
    return F.substring(content, 1, 4) == F.lit(b"%PDF")


def usable_chart(http_status: Column, content: Column) -> Column:
    """Whether a fetched chart can be read: found, and a PDF by its first bytes."""
    return F.coalesce((http_status == 200) & is_pdf(content), F.lit(False))


def fetch_status(url: Column, blocked: Column, http_status: Column, text: Column) -> Column:
    """Outcome of one fetch as the pages table (or a fetcher) reports it."""
    return (
        F.when(F.coalesce(url, F.lit("")) == "", "NO_URL").when(blocked, "BLOCKED_SOURCE").when(http_status.isin(401, 403, 429), "FETCH_BLOCKED")
        .when(http_status.isNull() | (http_status >= 400) | (F.coalesce(text, F.lit("")) == ""), "FETCH_FAILED").otherwise("FETCHED")
    )
