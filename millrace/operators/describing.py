"""Descriptions from reconciled attributes. Every function takes the map `attrs` of label to value (no
empty values) and returns a column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import text as X

LED = "Electrical>Lamps & Lightings>Light Bulbs>LED Light Bulbs"
MOST = 40
#: Short forms of light appearances: fixed values.
APPEARANCE = {"amber": "AMB"}
#: How a slot's value is written in the long description: fixed values. v value, u unit, l label.
LONG_FORMATS = {
    "Wattage": "v_u_l", "Lumens": "v_u_l", "Bulb Shape": "v_l", "Bulb Shape Code": "v_l", "Color Temperature": "v_u", "Light Appearance": "l_v",
    "Bulb Base": "v_l", "Bulb Base Code": "v_l", "Bulb Finish": "finish", "Voltage Rating": "v_u", "Color Rendering Index (CRI)": "cri",
    "Bulb Designation": "v_l", "Average Life": "v_u_l", "Beam Angle": "v_u_l", "Incandescent Wattage Equivalent": "l_v_u",
    "Halogen Wattage Equivalent": "l_v_u", "Fluorescent Wattage Equivalent": "l_v_u", "HID Wattage Equivalent": "l_v_u", "Dimmable": "l_v",
    "Smart Compatible With": "l_v", "Diameter": "v_u_l", "Length": "v_u_l", "Energy Star Certified": "l_v", "Title 20 Compliant": "l_v",
    "Title 24 Compliant": "l_v", "Additional Information": "l_v",
}


def attribute_maps(attributes: DataFrame) -> DataFrame:
    """seq, attrs (map), ordered (array of slot, label, value, uom of the filled slots in slot order)."""
    slots = F.array_sort(F.collect_list(F.struct("slot", "label", "value", "uom")))
    out = attributes.where("value <> ''").groupBy("seq").agg(slots.alias("ordered"))
    entries = F.transform("ordered", lambda s: F.struct(s["label"].alias("key"), s["value"].alias("value")))
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda o: o["key"] == e["key"]))
    return out.select("seq", "ordered", F.map_from_entries(last).alias("attrs"))


def value(label: str) -> Column:
    return F.coalesce(F.try_element_at(F.col("attrs"), F.lit(label)), F.lit(""))


def is_range(c: Column) -> Column:
    return c.contains(" to ")


def brand_name(manufacturer: Column, names: dict[str, str] | None = None) -> Column:
    """The manufacturer's display name where one is known, else its name; empty for null."""
    out = manufacturer
    for name, shown in (names or {}).items():
        out = F.when(manufacturer == name, shown).otherwise(out)
    return F.coalesce(out, F.lit(""))


def filament() -> Column:
    info, code = value("Additional Information"), value("Bulb Shape Code")
    return F.when(info.contains("Glass"), True).when(info.contains("Plastic"), False).otherwise(code.startswith("T") | code.startswith("ST"))


def shape_noun() -> Column:
    code = value("Bulb Shape Code")
    return F.when(code.startswith("B") & ~code.startswith("BR"), "Candle").otherwise("Bulb")


def noun(classpath: Column) -> Column:
    led = F.concat(F.lit("LED"), F.when(filament(), " Filament").otherwise(""), F.lit(" "), shape_noun())
    return F.when(classpath == LED, led).when(F.coalesce(classpath, F.lit("")) != "", X.generic_noun(classpath)).otherwise("Product")


def _tokens(*parts: Column) -> Column:
    return F.array_compact(F.array(*parts))


def invoice(classpath: Column) -> Column:
    """All capitals, 40 characters at most beyond the base."""
    base = F.concat(
        F.when(shape_noun() == "Candle", "CANDLE").otherwise("BULB"), F.when(filament(), " FIL").otherwise(""), F.lit(" LED"),
        *[F.when(v != "", F.concat(F.lit(" "), v, F.lit(s))).otherwise("") for v, s in ((value("Lumens"), "LUMENS"), (value("Wattage"), "W"), (F.upper(value("Bulb Shape")), ""), (value("Bulb Shape Code"), ""))],
    )
    ct, look = value("Color Temperature"), F.lower(value("Light Appearance"))
    more = _tokens(
        F.when((ct != "") & ~is_range(ct), F.concat(ct, F.lit("K"))), F.when(value("Bulb Base") == "Medium", F.lit("MDM")),
        F.when(value("Bulb Base Code") != "", value("Bulb Base Code")), *[F.when(look == k, F.lit(v)) for k, v in APPEARANCE.items()],
    )
    generic = F.upper(F.when(F.coalesce(classpath, F.lit("")) != "", X.generic_noun(classpath)).otherwise("Product"))
    values = F.transform(F.filter("ordered", lambda s: ~is_range(s["value"])), lambda s: F.upper(s["value"]))
    return F.when(classpath == LED, X.packed(base, more, MOST)).otherwise(X.packed(generic, F.coalesce(values, F.array().cast("array<string>")), MOST))


def mobile(mpn: Column, manufacturer: Column, said: Column, names: dict[str, str] | None = None) -> Column:
    """said: the row's noun."""
    full = lambda c: F.when(F.coalesce(c, F.lit("")) != "", c)
    ct, w = value("Color Temperature"), value("Wattage")
    parts = _tokens(
        full(brand_name(manufacturer, names)), said, full(mpn), F.when(w != "", X.with_unit(w, F.lit("W"), "MOBILE_DESC")),
        full(value("Bulb Shape")), full(value("Bulb Base")), full(value("Bulb Finish")), F.when((ct != "") & ~is_range(ct), X.with_unit(ct, F.lit("K"), "MOBILE_DESC")),
    )
    return F.array_join(parts, ", ")


def retail(said: Column) -> Column:
    comma = lambda c, out=None: F.when(c != "", F.concat(c if out is None else out, F.lit(",")))
    w, ct, lm, beam = value("Wattage"), value("Color Temperature"), value("Lumens"), value("Beam Angle")
    parts = _tokens(
        F.concat(said, F.lit(",")), comma(w, X.with_unit(w, F.lit("W"), "SHORT_DESC")), comma(value("Bulb Shape")), comma(value("Bulb Base")), comma(value("Bulb Finish")),
        comma(ct, X.with_unit(ct, F.lit("K"), "SHORT_DESC")), F.when(lm != "", F.concat(lm, F.lit(" Lumens,"))), F.when(beam != "", X.with_unit(beam, F.lit("deg Beam"), "SHORT_DESC")),
    )
    return F.regexp_replace(X.strip(F.array_join(parts, " ")), ",$", "")


def short(mpn: Column, manufacturer: Column, retail_text: Column, names: dict[str, str] | None = None) -> Column:
    lead = [F.when(F.coalesce(c, F.lit("")) != "", c) for c in (brand_name(manufacturer, names), mpn)]
    return X.strip(F.concat(F.array_join(_tokens(*lead), " "), F.lit(" "), retail_text))


def long_text(manufacturer: Column, classpath: Column, said: Column, names: dict[str, str] | None = None) -> Column:
    """One category only: the noun, then every filled slot in order; empty for others."""
    form = F.create_map(*[F.lit(x) for kv in LONG_FORMATS.items() for x in kv])

    def token(s: Column) -> Column:
        f, v, lab = F.coalesce(F.try_element_at(form, s["label"]), F.lit("v_l")), X.strip(s["value"]), s["label"]
        vu = X.with_unit(v, s["uom"], "LONG_DESC1")
        sp = F.lit(" ")
        return (
            F.when(f == "v_u_l", F.concat(vu, sp, lab)).when(f == "v_u", vu).when(f == "finish", F.concat(v, F.lit(" Bulb"))).when(f == "cri", F.concat(v, F.lit(" CRI")))
            .when(f == "l_v", F.concat(lab, F.lit(": "), v)).when(f == "l_v_u", F.concat(lab, F.lit(": "), vu)).otherwise(F.concat(v, sp, lab))
        )

    prefix = X.strip(F.concat(brand_name(manufacturer, names), F.lit(" "), said))
    parts = F.concat(F.array(prefix), F.coalesce(F.transform("ordered", token), F.array().cast("array<string>")))
    return F.when(classpath == LED, F.array_join(parts, ", ")).otherwise("")


def template_copy(rows: DataFrame, table: DataFrame, maker: str, aliases: dict[str, str] | None = None) -> DataFrame:
    """rows with marketing and features from table (shape, ct, marketing, features) by exact shape code and
    last number of the color temperature, for one manufacturer; null and none otherwise."""
    shape = F.upper(X.strip(value("Bulb Shape Code")))
    for a, b in (aliases or {}).items():
        shape = F.when(shape == a, b).otherwise(shape)
    keyed = rows.withColumns({"shape": F.when(F.col("manufacturer_name") == maker, shape), "ct": X.last_number(value("Color Temperature"))})
    return keyed.join(table, ["shape", "ct"], "left").drop("shape", "ct")


def describe(rows: DataFrame, names: dict[str, str] | None = None) -> DataFrame:
    """rows (Mfg_Part_Num, manufacturer_name, classpath, attrs, ordered) with the five texts; all null without classpath."""
    c, m, n = F.col("classpath"), F.col("manufacturer_name"), F.col("Mfg_Part_Num")
    said, sold = F.col("__noun"), F.col("__retail")
    rows = rows.withColumn("__noun", noun(c)).withColumn("__retail", retail(said))
    texts = {"INVOICE_DESC": invoice(c), "MOBILE_DESC": mobile(n, m, said, names), "SHORT_DESC": short(n, m, sold, names), "RETAIL_DESC": sold, "LONG_DESC1": long_text(m, c, said, names)}
    return rows.withColumns({k: F.when(F.coalesce(c, F.lit("")) != "", F.nullif(v, F.lit(""))) for k, v in texts.items()}).drop("__noun", "__retail")
