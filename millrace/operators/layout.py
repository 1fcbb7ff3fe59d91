"""Spec sheets as tables of words with coordinates: lines, label columns, tables, charts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.sources.staging import kept, rowwise

TOLERANCE = 2.5
#: x ranges of labels and values on a one-product sheet: fixed values.
LABEL_X, VALUE_X = (305.0, 360.0), 400.0


def pages_of(words: DataFrame) -> DataFrame:
    """doc, page, w: a page's words in order of (rounded top, x0). Pages are bounded."""
    return words.groupBy("doc", "page").agg(F.array_sort(F.collect_list(F.struct(F.round("top", 1).alias("y"), "x0", "top", "text", "x1"))).alias("w"))


def line_numbers(words: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """words (doc, page, text, x0, x1, top) with line: words whose top is within the tolerance of the
    line's first word, in order of (rounded top, x0). Pages are bounded, so a page is folded as one array."""
    return numbered(pages_of(words), tolerance=tolerance)


def numbered(page: DataFrame, *more: str, tolerance: float = TOLERANCE) -> DataFrame:
    """The words of pages_of() with line, and more columns of their page."""
    fold = f"""aggregate(w, named_struct('first', -1e18D, 'n', -1, 'out', cast(array() as array<int>)),
        (a, x) -> if(abs(x.top - a.first) <= {tolerance}D, named_struct('first', a.first, 'n', a.n, 'out', concat(a.out, array(a.n))),
                     named_struct('first', x.top, 'n', a.n + 1, 'out', concat(a.out, array(a.n + 1)))), a -> a.out)"""
    page = page.withColumn("l", F.expr(fold))
    return page.select("doc", "page", *more, F.explode(F.arrays_zip("w", "l")).alias("z")).select("doc", "page", *more, F.col("z.l").alias("line"), "z.w.text", "z.w.x0", "z.w.x1", "z.w.top")


def lines(words: DataFrame) -> DataFrame:
    """doc, page, line, text: the words of each line joined by spaces, left to right."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "text"))), lambda w: w["text"]), " ")
    return line_numbers(words).groupBy("doc", "page", "line").agg(joined.alias("text"))


def label_values(words: DataFrame, labels: DataFrame) -> DataFrame:
    """doc, slot_label, value: label words and value words of a line by their x range; labels (label, slot_label)
    maps what is printed, null drops it; of a label that comes again the last value counts."""
    at = lambda cond: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct("x0", "text")))), lambda w: w["text"]), " ")
    is_label = (F.col("x0") >= LABEL_X[0]) & (F.col("x0") < LABEL_X[1])
    rows = line_numbers(words).groupBy("doc", "page", "line").agg(at(is_label).alias("label"), at(F.col("x0") >= VALUE_X).alias("value"))
    rows = rows.where("label <> '' and value <> ''").join(labels, "label").where("slot_label is not null")
    return rows.groupBy("doc", "slot_label").agg(F.max_by("value", F.struct("page", "line")).alias("value"))


def nearest_header(cells: DataFrame, headers: DataFrame) -> DataFrame:
    """doc, page, line, label, text: every cell word under the header whose centre is nearest, the left one among equals."""
    return under(cells.join(rowwise(header_maps(headers)), ["doc", "page"]))


def centre(a: str, b: str) -> Column:
    return (F.col(a) + F.col(b)) / 2


def header_maps(headers: DataFrame) -> DataFrame:
    """doc, page, h: a page's headers with their centres; bottom: their lowest top."""
    lowest = F.max("top") if "top" in headers.columns else F.lit(None).cast("double")
    return headers.groupBy("doc", "page").agg(F.collect_list(F.struct(centre("x0", "x1").alias("c"), F.col("text").alias("label"))).alias("h"), lowest.alias("bottom"))


def under(cells: DataFrame) -> DataFrame:
    """nearest_header of cells that carry their page's headers (h)."""
    cells = cells.withColumn("at", centre("x0", "x1"))
    best = F.array_min(F.transform("h", lambda x: F.struct(F.abs(x["c"] - F.col("at")).alias("d"), x["c"].alias("c"), x["label"].alias("label"))))["label"]
    cells = cells.withColumn("label", best)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "text"))), lambda w: w["text"]), " ")
    return cells.groupBy("doc", "page", "line", "label").agg(joined.alias("text"))


#: Header words that stand apart but are one header: fixed values.
HEADERS = {"Wattage": "Replacement Wattage", "Replacement": "Replacement Wattage", "Beam": "Beam Angle", "Angle": "Beam Angle", "Pack": "Pack Qty", "Qty": "Pack Qty"}
#: How far header words may stand from the anchor's line, and from each other.
ABOVE, APART = 12.0, 10.0


def headers(words: DataFrame, anchor: str = "Sku") -> DataFrame:
    """doc, page, text, x0, x1, top of a table's headers: words about the anchor's line, those that stand
    closer than APART to the one before joined, known halves as one."""
    return headers_of(pages_of(words), anchor)


def headers_of(page: DataFrame, anchor: str) -> DataFrame:
    """headers() of pages_of()."""
    y = F.array_min(F.transform(F.filter("w", lambda x: x["text"] == anchor), lambda x: x["top"]))
    near = page.withColumn("at", y).select("doc", "page", F.explode(F.filter("w", lambda x: F.abs(x["top"] - F.col("at")) <= ABOVE)).alias("x")).select("doc", "page", "x.*")
    order = Window.partitionBy("doc", "page").orderBy("x0", "top", "text")
    gap = F.coalesce((F.col("x0") - F.max("x1").over(order.rowsBetween(Window.unboundedPreceding, -1)) > APART).cast("int"), F.lit(1))
    near = near.withColumn("gap", gap).withColumn("n", F.sum("gap").over(order))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "top", "text"))), lambda w: w["text"]), " ")
    out = near.groupBy("doc", "page", "n").agg(text.alias("text"), F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.max("top").alias("top"))
    known = F.create_map(*[F.lit(x) for kv in HEADERS.items() for x in kv])
    return out.select("doc", "page", F.coalesce(F.try_element_at(known, "text"), F.when(F.col("text").isin("Wattage Replacement"), "Replacement Wattage"), F.col("text")).alias("text"), "x0", "x1", "top")


def sku_table(words: DataFrame, anchor: str = "Sku") -> DataFrame:
    """doc, page, line, label, text: the cells below the headers, each under the nearest one; lines end with
    the first one after the headers that has nothing under the anchor."""
    page = kept(pages_of(words), "pages")
    cells = page.join(rowwise(header_maps(headers_of(page, anchor))), ["doc", "page"])
    cells = cells.withColumn("w", F.filter("w", lambda x: x["top"] > F.col("bottom") + TOLERANCE))
    table = under(numbered(cells, "h"))
    table = table.withColumn("keyed", F.max((F.col("label") == anchor).cast("int")).over(Window.partitionBy("doc", "page", "line")))
    table = table.withColumn("end", F.min(F.when(F.col("keyed") == 0, F.col("line"))).over(Window.partitionBy("doc", "page")))
    return table.where(F.col("end").isNull() | (F.col("line") < F.col("end"))).drop("keyed", "end")


def table_row(table: DataFrame, sku: str, key: str = "Sku") -> DataFrame:
    """doc, label, text of the row of a part number: rows stop at the first one after it without a key."""
    keys = table.where(F.col("label") == key).select("doc", "page", "line", F.col("text").alias("sku"))
    return table.join(rowwise(keys), ["doc", "page", "line"]).where(F.replace("sku", F.lit("/"), F.lit("-")) == F.replace(F.lit(sku), F.lit("/"), F.lit("-"))).where(F.col("label") != key).select("doc", "label", "text")


#: Empty bands that part a page into regions: their least width between words, and their least height between tops of lines.
WIDE, TALL = 60.0, 40.0


def regions(words: DataFrame, wide: float = WIDE, tall: float = TALL) -> DataFrame:
    """words with region, the number of the part of its page that a word stands in, in reading order.

    A page is cut across where a band of at least tall is empty from side to side, its parts lengthwise where a
    band of at least wide is empty from top to bottom, and so on until no part has such a band. Pages are bounded, so
    a page is cut as one array, in one pass over all pages. The functions stand inside so that they travel to workers whole."""

    def cut(at: list[int], start: list[float], end: list[float], gap: float) -> list[list[int]]:
        """Words (by number) in parts: a sweep in order of their beginning, against the furthest end so far."""
        parts, reach = [], float("inf")
        for i in sorted(at, key=lambda i: (start[i], end[i])):
            if not parts or start[i] - reach >= gap:
                parts.append([])
            reach = end[i] if len(parts[-1]) == 0 and len(parts) == 1 else max(reach, end[i])
            parts[-1].append(i)
        return parts

    def numbered_(x0: list[float], x1: list[float], top: list[float]) -> list[int]:
        """The region of each word of a page."""
        out, n, todo = [0] * len(top), 0, [list(range(len(top)))]
        while todo:
            at = todo.pop()
            parts = [p for band in cut(at, top, top, tall) for p in cut(band, x0, x1, wide)]
            if len(parts) > 1:
                todo.extend(reversed(parts))
                continue
            for i in at:
                out[i] = n
            n += 1
        return out

    def numbers(x0: pd.Series, x1: pd.Series, top: pd.Series) -> pd.Series:
        return pd.Series([numbered_(a.tolist(), b.tolist(), c.tolist()) for a, b, c in zip(x0, x1, top)], dtype=object)

    rest = [c for c in words.columns if c not in ("doc", "page")]
    page = words.groupBy("doc", "page").agg(F.collect_list(F.struct(*rest)).alias("w"))
    page = page.withColumn("n", F.pandas_udf(numbers, "array<int>")("w.x0", "w.x1", "w.top"))
    each = page.select("doc", "page", F.explode(F.arrays_zip("w", "n")).alias("z"))
    return each.select(*[F.col(c) if c in ("doc", "page") else F.col(f"z.w.{c}").alias(c) for c in words.columns], F.col("z.n").alias("region"))


def regional(words: DataFrame) -> DataFrame:
    """words whose page is the pair of page and region: what reads a page then reads each region by itself."""
    return regions(words).withColumn("page", F.struct("page", "region")).drop("region")


def sku_tables(words: DataFrame, anchor: str = "Sku") -> DataFrame:
    """doc, page, region, line, label, text of every table on a page, as sku_table reads one."""
    return sku_table(regional(words), anchor).select("doc", "page.page", "page.region", "line", "label", "text")


#: Lines of the general block: label and pattern, fixed values.
GENERAL = {"Input Voltage, Frequency": r"Input\s+Voltage,?\s+Frequency\s*:\s*(\S.*)", "Functional Life": r"Functional\s+Life\s*:\s*([\d,\s]+(?:Hours|Hrs|hr)?)", "CRI": r"(?<!Ambient Operating )CRI\s*:\s*(\d[\d+]*)"}


def general_block(text_lines: DataFrame) -> DataFrame:
    """doc, label, value of the lines that carry a known label; of one that comes again the last."""
    found = F.explode(F.array(*[F.struct(F.lit(k).alias("label"), F.trim(F.regexp_extract("text", p, 1)).alias("value")) for k, p in GENERAL.items()]))
    rows = text_lines.select("doc", "page", "line", found.alias("f")).where("f.value <> ''")
    return rows.groupBy("doc", F.col("f.label").alias("label")).agg(F.max_by("f.value", F.struct("page", "line")).alias("value"))


def plain_number(value: Column) -> Column:
    """1,050L is 1050, 7.20 is 7.2, 120V/60Hz is 120."""
    n = F.replace(F.regexp_extract(value, r"^\s*([\d,]+(?:\.\d+)?)", 1), F.lit(","), F.lit(""))
    return F.when(n == "", value).otherwise(F.regexp_replace(F.regexp_replace(n, r"(\.\d*?)0+$", "$1"), r"\.$", ""))


def chart(text_lines: DataFrame, sku: str) -> DataFrame:
    """doc, watts ("80/100/120"), temperatures ("3000 K, 4000 K") of one product of a chart.

    A data row is an optional part number, watts and lumens. A part number's row takes the rows
    without one right before and right after it, each of them once, the upper product first.
    """
    header = r"(?i)^\s*Sku\s+Wattage/CCT\s+((?:\d+K\s*)+)$"
    data = r"(?i)^(\S+\s+)?(\d+)W\s+(?:\d+L\s*)+$"
    t = text_lines.withColumns({"cct": F.regexp_extract("text", header, 1), "sku": F.trim(F.regexp_extract("text", data, 1)), "w": F.regexp_extract("text", data, 2)})
    rows = t.where("w <> ''").withColumn("n", F.row_number().over(Window.partitionBy("doc").orderBy("page", "line")))
    w = Window.partitionBy("doc").orderBy("n")
    named = F.col("sku") != ""
    rows = rows.withColumns({"named": named, "up": F.lag(named).over(w), "up2": F.lag(named, 2).over(w), "sku_up": F.lag("sku").over(w), "sku_down": F.lead("sku").over(w)})
    # a nameless row between two products goes to the upper one, unless that has none to spare: the row before decides
    owner = F.when(named, F.col("sku")).when(F.coalesce("up", F.lit(False)), F.col("sku_up")).otherwise(F.col("sku_down"))
    norm = lambda c: F.replace(c, F.lit("/"), F.lit("-"))
    own = rows.withColumn("owner", owner).where(norm(F.col("owner")) == norm(F.lit(sku)))
    watts = own.groupBy("doc").agg(F.array_join(F.transform(F.array_sort(F.collect_set(F.col("w").cast("int"))), lambda x: x.cast("string")), "/").alias("watts"))
    ccts = t.where("cct <> ''").groupBy("doc").agg(F.max("cct").alias("cct"))
    temps = F.array_join(F.transform(F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all("cct", F.lit(r"(\d+)K"), F.lit(1)), lambda x: x.cast("int")))), lambda x: F.concat(x.cast("string"), F.lit(" K"))), ", ")
    return watts.join(rowwise(ccts), "doc", "left").select("doc", "watts", temps.alias("temperatures"))


#: Shape names by the beginning of a shape code, in order of trial, and base names by their code: fixed values.
SHAPES = [("BR", "Type BR"), ("ST", "Type ST"), ("T", "Tube"), ("A", "Type A"), ("G", "Globe"), ("R", "Type R"), ("B", "Type B")]
BASES = {"E26": "Medium", "E12": "Candelabra"}


def shape_name(code: Column) -> Column:
    out = F.lit(None).cast("string")
    for prefix, name in reversed(SHAPES):
        out = F.when(F.upper(F.trim(code)).startswith(prefix), name).otherwise(out)
    return out


def derived(attrs: Column) -> Column:
    """A sheet's map of attributes with names for the codes it prints: a code in place of the base's name
    moves to its own label, and names that are missing come from the codes."""
    at = lambda label: F.try_element_at(attrs, F.lit(label))
    base = lambda code: F.try_element_at(F.create_map(*[F.lit(x) for kv in BASES.items() for x in kv]), F.upper(F.trim(code)))
    moved = base(at("Bulb Base")).isNotNull()
    code = F.when(moved, F.upper(F.trim(at("Bulb Base")))).otherwise(at("Bulb Base Code"))
    names = {
        "Bulb Base Code": code, "Bulb Base": F.when(moved | at("Bulb Base").isNull(), base(code)).otherwise(at("Bulb Base")),
        "Bulb Shape": F.coalesce(at("Bulb Shape"), shape_name(at("Bulb Shape Code"))),
    }
    own = F.map_filter(F.create_map(*[x for k, v in names.items() for x in (F.lit(k), v)]), lambda _, v: v.isNotNull())
    return F.map_concat(F.map_filter(attrs, lambda k, _: ~k.isin(list(names))), own)


def _kept_part(pattern: str):
    """What a pattern's group matches, else the value."""
    return lambda v: F.coalesce(F.nullif(F.trim(F.regexp_extract(v, pattern, 1)), F.lit("")), v)


def _without(pattern: str):
    """The value without thousands separators and what a pattern matches."""
    return lambda v: F.trim(F.regexp_replace(F.replace(v, F.lit(","), F.lit("")), pattern, ""))


def _said(shown: str, yes: str, no: str | None = None):
    """A fixed text where the value says so, else empty."""
    said = lambda v: F.lower(v).rlike(yes) & (~F.lower(v).rlike(no) if no else F.lit(True))
    return lambda v: F.when(said(v), shown).otherwise("")


#: How a printed value is written in each slot; in all others it loses its thousands separators.
SLOT_VALUES = {
    "Wattage": _kept_part(r"^(.+?)\s*W$"), "Incandescent Wattage Equivalent": _kept_part(r"^(.+?)\s*W$"), "Voltage Rating": _kept_part(r"^(\d+(?:\.\d+)?)\s*V"),
    "Color Temperature": _kept_part(r"^(.+?)\s*K$"), "Lumens": _without(r"\s*L$"), "Beam Angle": _without(r'(?i)\s*(deg|degrees|°|"")\s*$'), "Average Life": _without(r"(?i)\s*(hours|hrs|hr)\.?\s*$"),
    "Length": lambda v: _without(r"(?<=\d\.\d{1,9})0+$")(_without(r"[\"']| ?in")(v)), "Diameter": lambda v: _without(r"(?<=\d\.\d{1,9})0+$")(_without(r"[\"']| ?in")(v)),
    "Dimmable": _said("Dimmable", "yes|^(?!.*no).*dimmable"), "Energy Star Certified": _said("Energy Star Certified", "^yes$"),
    "Title 20 Compliant": _said("Title 20 Compliant", "listed|lawful|compliant", "^(?!.*(yes|lawful|listed)).*no"), "Color Rendering Index (CRI)": lambda v: F.when(_without("$^")(v) == "90", "90+").otherwise(_without("$^")(v)),
}


def slot_value(value: Column, slot: Column) -> Column:
    """A value as a sheet prints it, in the form of its slot; empty where there is none."""
    v = F.trim(F.coalesce(value, F.lit("")))
    out = _without("$^")(v)
    for label, form in SLOT_VALUES.items():
        out = F.when(slot == label, form(v)).otherwise(out)
    return F.when(v == "", "").otherwise(out)


#: What only sheets of a whole family print: fixed values.
FAMILY = ["GENERAL SPECIFICATIONS", "ITEM SPECIFICATIONS"]


def sheet(words: DataFrame, labels: DataFrame, skus: DataFrame) -> DataFrame:
    """doc, label, value of spec sheets, by their layout: one product (labels and values side by side) or a
    family (the row of the document's part number in any of a page's tables and the general block; the row counts
    where both do).
    labels: label, slot_label (null drops); skus: doc, sku. A sheet that holds neither has no rows."""
    text = lines(words)
    told = F.exists(F.array(*[F.lit(t) for t in FAMILY]), lambda t: F.upper("text").contains(t))
    family = kept(text.groupBy("doc").agg(F.max(told).alias("family")), "families")
    one = label_values(words.join(rowwise(family.where("not family")), "doc", "left_semi"), labels).select("doc", F.col("slot_label").alias("label"), "value")
    many = kept(regional(words.join(rowwise(family.where("family")), "doc", "left_semi")), "family")
    table = kept(sku_table(many), "table")
    norm = lambda c: F.lower(F.replace(c, F.lit("/"), F.lit("-")))
    keys = table.where(F.col("label") == "Sku").select("doc", "page", "line", F.col("text").alias("own")).join(rowwise(skus), "doc").where(norm(F.col("own")) == norm(F.col("sku"))).select("doc", "page", "line")
    row = table.join(rowwise(keys), ["doc", "page", "line"]).where("label <> 'Sku'").select("doc", "label", F.col("text").alias("value"), F.lit(1).alias("first"))
    block = general_block(lines(many)).select("doc", "label", "value", F.lit(0).alias("first"))
    found = row.unionByName(block).join(labels, "label").where("slot_label is not null")
    found = found.groupBy("doc", F.col("slot_label").alias("label")).agg(F.max_by("value", "first").alias("value"))
    return one.unionByName(found)


def sheet_features(attrs: Column, family: Column, text: Column) -> Column:
    """The bullets of a sheet from its attributes (map) and, for a family's, its text, in order."""
    v = lambda label: F.coalesce(F.try_element_at(attrs, F.lit(label)), F.lit(""))
    full = lambda c, s: F.when(c != "", F.concat(c, F.lit(s)))
    watt, code = v("Wattage"), v("Bulb Shape Code")
    thread = F.when(~family & (code.startswith("T") | code.startswith("ST")), " Filament").otherwise("")
    lead = F.when((watt != "") & (code != ""), F.concat(watt, F.lit(" Watt "), code, F.lit(" LED"), thread))
    shared = [full(v("Color Temperature"), "K")]
    one = bullets(lead, v("Bulb Finish"), full(v("Bulb Base"), " base"), full(F.regexp_replace(v("Color Rendering Index (CRI)"), r"\++$", ""), " CRI"), *shared, full(v("Voltage Rating"), " Volt"))
    many = bullets(lead, F.regexp_extract(text, r"Color:\s*(\w+)", 1), *shared, full(v("Lumens"), " Lumens"), full(v("Voltage Rating"), " Volt"), F.when(F.upper(text).contains("PIR"), "PIR Sensor"))
    return F.when(family, many).otherwise(one)


def bullets(*parts: Column) -> Column:
    """The non-empty cells in order."""
    return F.array_compact(F.array(*[F.when(F.coalesce(p, F.lit("")) != "", p) for p in parts]))
