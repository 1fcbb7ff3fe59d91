"""Column functions on text: cleaning, tokens, units, casing, similarity. All but similarity run JVM-side."""

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Cells that mean "nothing": fixed values, compared in lower case.
PLACEHOLDERS = ["-- unbranded --", "-- no unilog brand --", "-- no dib brand --", "-", "", "n/a", "na", "none"]
#: Words that say nothing about a class: fixed values.
STOPWORDS = ["the", "a", "an", "with", "for", "and", "or", "in", "on", "of", "to"]
#: Values with a unit in free text, and the unit's usual spelling: fixed values.
UNIT = r"(?i)(\d+(?:\.\d+)?)\s*(W|V|K|A|hr|deg|lm|in\b|mm|cm|ft)\b"
UNIT_NAMES = {"w": "W", "v": "V", "k": "K", "a": "A", "hr": "hr", "deg": "deg", "lm": "Lumens", "in": "in", "mm": "mm", "cm": "cm", "ft": "ft"}
#: Fields that write value and unit together: fixed values.
COMPRESSED = ("INVOICE_DESC", "MOBILE_DESC")


#: White space, Unicode's included (what `(?U)\s` means).
SPACES = "\t\n\x0b\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    """Without white space around, Unicode's included: looks at both ends only, where a pattern tries every character."""
    return F.btrim(c, F.lit(SPACES))


def clean_value(c: Column) -> Column:
    """Stripped; null for a placeholder."""
    s = strip(c)
    return F.when(F.lower(s).isin(PLACEHOLDERS), F.lit(None)).otherwise(s)


def code_suffix_removed(c: Column) -> Column:
    """A name without the distributor's code in parentheses behind it."""
    return strip(F.regexp_replace(c, r"\s*\([^)]*\)\s*$", ""))


def brand_key(c: Column) -> Column:
    """What brands are compared by: no symbols behind, lower case."""
    return F.lower(strip(F.regexp_replace(strip(c), r"(?U)[^\w\s&.-]+$", "")))


def tokens(c: Column) -> Column:
    """Distinct lower-case words of two letters or more, without stopwords."""
    words = F.regexp_extract_all(F.lower(c), F.lit(r"([a-z]{2,})"), F.lit(1))
    return F.array_except(words, F.array(*[F.lit(w) for w in STOPWORDS]))


def unit_priors(c: Column) -> Column:
    """array<struct<value, uom>> of the values with a unit, in text order; two-digit K are hundreds."""
    pair = F.arrays_zip(F.regexp_extract_all(c, F.lit(UNIT), F.lit(1)).alias("v"), F.regexp_extract_all(c, F.lit(UNIT), F.lit(2)).alias("u"))
    names = F.create_map(*[F.lit(x) for kv in UNIT_NAMES.items() for x in kv])

    def canonical(p):
        uom = F.element_at(names, F.lower(p["1"]))
        short = (uom == "K") & ~p["0"].contains(".") & (p["0"].try_cast("bigint") < 100)
        return F.struct(F.when(short, (p["0"].try_cast("bigint") * 100).cast("string")).otherwise(p["0"]).alias("value"), uom.alias("uom"))

    return F.transform(F.coalesce(_positional(pair), F.array()), canonical)


def _positional(pair: Column) -> Column:
    return F.transform(pair, lambda p: F.struct(p["v"].alias("0"), p["u"].alias("1")))


def with_unit(value: Column, uom: Column, field: str) -> Column:
    """"8W" for the compressed fields, "8 W" for the others, the value alone without unit."""
    v, u = strip(value), strip(F.coalesce(uom, F.lit("")))
    return F.when(u == "", v).otherwise(F.concat(v, F.lit("" if field in COMPRESSED else " "), u))


def unit_removed(value: Column, hint: Column) -> Column:
    """The value without its unit behind it, if what is left is a number, a range or a list of numbers."""
    v, h = strip(value), strip(hint)
    rest = strip(F.expr("null").cast("string")) if False else strip(F.substring(v, F.lit(1), F.length(v) - F.length(h)))
    number = F.regexp_replace(rest, " to ", "/").rlike(r"^[\d.\-/,\s]+$")
    ends = (h != "") & (F.length(v) > F.length(h)) & (F.lower(F.right(v, F.length(h))) == F.lower(h))
    return F.when(ends & number, rest).otherwise(value)


def title_case(c: Column) -> Column:
    """Every run of letters begins with a capital and goes on in lower case."""
    runs = F.regexp_extract_all(c, F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.lower(F.substring(r, F.lit(2), F.length(r))))), "")


def cased(c: Column, field: str) -> Column:
    return F.upper(c) if field == "INVOICE_DESC" else title_case(c) if field == "MOBILE_DESC" else c


def fraction(c: Column) -> Column:
    """A plain decimal on a power-of-two fraction up to 64ths as that fraction: 50.25 is 50-1/4."""
    s = strip(c)
    whole = F.regexp_extract(s, r"^(\d+)\.(\d+)$", 1)
    part = F.concat(F.lit("0."), F.regexp_extract(s, r"^(\d+)\.(\d+)$", 2)).cast("double")
    out = c
    for d in (64, 32, 16, 8, 4, 2):  # the smallest denominator that fits decides, so it comes last
        n = F.rint(part * d)
        text = F.concat(n.cast("long").cast("string"), F.lit(f"/{d}"))
        text = F.when((n == 0) | (n == d), c).otherwise(F.when(whole == "0", text).otherwise(F.concat(whole, F.lit("-"), text)))
        out = F.when(F.abs(n / d - part) < 1e-6, text).otherwise(out)
    return F.when(s.rlike(r"^\d+\.\d+$"), out).otherwise(c)


def singular(word: Column) -> Column:
    cut = lambda n: F.substring(word, F.lit(1), F.length(word) - n)
    return (
        F.when(word.endswith("ies") & (F.length(word) > 3), F.concat(cut(3), F.lit("y")))
        .when(word.endswith("ses") | word.endswith("xes") | word.endswith("ches") | word.endswith("shes"), cut(2))
        .when(word.endswith("s") & ~word.endswith("ss"), cut(1))
        .otherwise(word)
    )


def generic_noun(classpath: Column) -> Column:
    """The leaf of a classpath, its last word in the singular."""
    words = F.split(strip(F.element_at(F.split(classpath, ">"), -1)), " ")
    return F.array_join(F.concat(F.slice(words, F.lit(1), F.size(words) - 1), F.array(singular(F.element_at(words, -1)))), " ")


def packed(base: Column, parts: Column, most: int) -> Column:
    """base and as many of parts as fit: one that does not fit is skipped, later ones are still tried."""
    return F.aggregate(parts, base, lambda a, t: F.when(F.length(a) + F.length(t) + 1 <= most, F.concat(a, F.lit(" "), t)).otherwise(a))


def last_number(c: Column) -> Column:
    """The last integer in a text, or null."""
    return F.try_element_at(F.regexp_extract_all(c, F.lit(r"(\d+)"), F.lit(1)), F.lit(-1)).try_cast("int")


def snippet(text: Column, value: Column, around: int = 80, head: int = 160) -> Column:
    """The surroundings of a value's first occurrence, whatever its case; else the beginning."""
    at = F.instr(F.lower(text), F.lower(value)) - 1
    start, stop = F.greatest(at - around, F.lit(0)), F.least(at + F.length(value) + around, F.length(text))
    cut = F.concat(F.when(start > 0, "...").otherwise(""), strip(F.substring(text, start + 1, stop - start)), F.lit("..."))
    return F.when((F.coalesce(value, F.lit("")) != "") & (at >= 0), cut).otherwise(strip(F.substring(text, 1, head)))


#: Words in a description and the label they speak for, in order of trial: fixed values.
KEYWORDS = {
    "stainless steel": "Material", "ss": "Material", "brass": "Material", "aluminum": "Material", "plastic": "Material", "steel": "Material",
    "t9": "Bulb Shape Code", "a19": "Bulb Shape Code", "br30": "Bulb Shape Code", "tube": "Bulb Shape", "round": "Bulb Shape",
}


def keyword_priors(c: Column) -> Column:
    """A map of label to the last of its words that stands in the text; only labels with one."""
    low = F.lower(c)
    found = {}
    for word, label in KEYWORDS.items():
        hit = F.when(low.rlike(rf"(?U)\b{word}\b"), word)
        found[label] = F.coalesce(hit, found[label]) if label in found else hit
    every = F.create_map(*[x for label, v in found.items() for x in (F.lit(label), v)])
    return F.map_filter(every, lambda _, v: v.isNotNull())


def token_sorted(c: Column) -> Column:
    return F.array_join(F.array_sort(F.split(strip(c), r"\s+")), " ")


def similarity(a: str, b: str, where: Column | None = None) -> Column:
    """100 x 2 x longest common subsequence / total length of two string columns, by name; in Arrow
    batches, and null without a call where `where` does not hold."""

    def common(x: str, y: str) -> int:
        """Length of the longest common subsequence: a row of the usual table as the bits of one integer."""
        at: dict[str, int] = {}
        for i, c in enumerate(y):
            at[c] = at.get(c, 0) | 1 << i
        every = row = (1 << len(y)) - 1
        for c in x:
            hit = row & at.get(c, 0)
            row = (row + hit | row - hit) & every
        return len(y) - row.bit_count()

    def one(x, y):
        return None if x is None or y is None else 100.0 if not x and not y else 200.0 * common(x, y) / (len(x) + len(y))

    def both(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series(list(map(one, x, y)), dtype="float64")

    x, y = (F.col(c) if where is None else F.when(where, F.col(c)) for c in (a, b))
    return F.pandas_udf(both, "double")(x, y)


def could_reach(a: str, b: str, least: float) -> Column:
    """Whether two lengths allow a similarity of at least `least`: the pairs left out cannot reach it."""
    return F.abs(F.length(a) - F.length(b)) <= (1 - least / 100) * (F.length(a) + F.length(b))


def could_be_near(a: str, b: str, least: float) -> Column:
    """could_reach, and the edit distance, which is no more than what the common subsequence leaves, allows it."""
    return could_reach(a, b, least) & (F.levenshtein(a, b) <= (1 - least / 100) * (F.length(a) + F.length(b)))
