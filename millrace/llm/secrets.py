"""Secret scans with a randomness test battery. DataFrame functions only.

Three fixed patterns give the base spans. Beyond them, every long token of an encoding's alphabet is
tested (an equals sign ends a token, so NAME=value and the parameters of a URL are tested value by
value): chi-squared uniformity over the alphabet and over its character classes, the number of runs
of character classes, and the lag-1 serial correlation of alphabet places. A token is a candidate if
none of the three rejects uniform randomness. What then counts is how unlikely it would be for ordinary text of the same
length to look that random: under ordinary text the chi-squared statistic is non-central (its excess
grows with the length) and runs are few, so a short token has little evidence and a long one much.
These p-values go through the weighted Benjamini-Hochberg procedure over all tokens of the corpus,
weights growing with length (mean one), by a histogram of bounded size.

A row's spans depend on its text and two numbers of the corpus (mean length and cut), so nothing but
the histogram is shuffled: `redact` reads the texts twice and rewrites them where they lie.

Spans are in code points, end exclusive. Null text is empty and has none. Tokens that lie in a base
span are not repeated. Rows are independent, also those that repeat a doc_id; columns of any other
name are neither read nor lost. A text of any length is scanned whole, in time that grows with its length
and its spans. An empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged

#: Patterns and what a match must have: fixed values.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_VALUE = 6
ACCESS = "AKIA[A-Z0-9]{16,}"  # a whole run of 20 or more; a shorter run holds no longer one
HEX = "[0-9a-f]{24,}"  # likewise
KINDS = ["assign", "access", "hex", "random"]

#: Tokens that are tested, with their padding; shorter ones carry no evidence.
TOKEN = "[A-Za-z0-9+/_-]{20,}(?:={1,2}(?![A-Za-z0-9+/_=-]))?"
#: One-case words and numbers: uniformity over 62 or more symbols is beyond them.
PLAIN = "^[A-Z]?[a-z]+$|^[A-Z]+$|^[0-9]+$|^[-_+/]+=*$"
#: Encodings in the order they are tried: pattern, alphabet, chance that two characters of ordinary
#: text in it agree, chance that the class changes from one character to the next in ordinary text.
ENCODINGS = [
    ("hex", "^[0-9a-f]+$", "0123456789abcdef", 0.12, 0.15),
    ("HEX", "^[0-9A-F]+$", "0123456789ABCDEF", 0.12, 0.15),
    ("base32", "^[A-Z2-7]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 0.065, 0.12),
    ("base32 lower", "^[a-z2-7]+=*$", "abcdefghijklmnopqrstuvwxyz234567", 0.065, 0.12),
    ("base36", "^[0-9a-z]+$", "0123456789abcdefghijklmnopqrstuvwxyz", 0.065, 0.12),
    ("base36 upper", "^[0-9A-Z]+$", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ", 0.065, 0.12),
    ("base62", "^[A-Za-z0-9]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", 0.06, 0.15),
    ("base64", "^[A-Za-z0-9+/]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", 0.06, 0.18),
    ("base64url", "^[A-Za-z0-9_-]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_", 0.06, 0.18),
]
#: Deviations at which a test rejects uniformity, and the false-discovery rate.
REJECT, RATE = 3.3, 0.01
#: Length from which a token's weight grows no further; width and number of histogram bins of -log10 p.
LONG, BIN, BINS = 64, 0.05, 400


def _spans(text: str, pattern: str, kind: int, value: int | None = None, token: bool = False) -> str:
    """SQL for the array of (start, kind, end) of all matches, left to right, with token their texts (tok);
    value: least length of group 2.

    The pieces between the matches and the matches' own lengths add up to the places.
    """
    p = "r'" + pattern.replace("'", "\\x27") + "'"
    ok = f"length(m.v) >= {value}" if value else "true"
    group2 = f"regexp_extract_all({text}, {p}, 2)" if value else f"regexp_extract_all({text}, {p}, 0)"
    found = f"filter(transform(arrays_zip(regexp_extract_all({text}, {p}, 0), {group2}, split({text}, {p}, -1)), z -> named_struct('m', z['0'], 'v', z['1'], 'g', z['2'])), z -> z.m is not null)"
    place = "named_struct('m', f.x.m, 'v', f.x.v, 'start', f.at + length(f.x.g), 'end', f.at + length(f.x.g) + length(f.x.m))"
    placed = f"transform({_running(found, 'length(x.g) + length(x.m)', 'a + v', '0')}, f -> {place})"
    tok = ", 'tok', m.m" if token else ""
    spans = f"transform(filter({placed}, m -> {ok}), m -> named_struct('start', m.start, 'kind', {kind}, 'end', m.end{tok}))"
    return f"if({text} rlike {p}, {spans}, cast(array() as array<struct<start:int,kind:int,end:int{',tok:string' if token else ''}>>))"


#: Items of a block in _running, and code points of a piece of text in redact.
BLOCK, PIECE = 256, 4096


def _let(name: str, value: str, body: str) -> str:
    """SQL for body with name standing for value, which is computed once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _running(items: str, value: str, combine: str, zero: str) -> str:
    """SQL for the array of (x, at) of items: at combines (a, v) the values of all items before x.

    Runs block by block: the blocks' totals are chained, then every block's items, so the work is linear in the items but
    for the copies within a block.
    """
    step = f"aggregate(array({value}), a, (a, v) -> {combine})"
    total = f"aggregate(b, {zero}, (a, x) -> {step})"
    chained = f"""aggregate(transform(blocks, b -> {total}), named_struct('a', {zero}, 'out', cast(array() as array<int>)),
        (s, t) -> named_struct('a', aggregate(array(t), s.a, (a, v) -> {combine}), 'out', concat(s.out, array(s.a))), s -> s.out)"""
    inside = f"""aggregate(b, named_struct('a', z, 'out', cast(array() as array<int>)),
        (s, x) -> named_struct('a', {step.replace(', a, (a, v)', ', s.a, (a, v)', 1)}, 'out', concat(s.out, array(s.a))), s -> s.out)"""
    prefix = f"flatten(zip_with(blocks, {chained}, (b, z) -> {inside}))"
    blocks = f"transform(sequence(0, (size(items) - 1) div {BLOCK}), i -> slice(items, int(i) * {BLOCK} + 1, {BLOCK}))"
    joined = f"zip_with(items, {prefix}, (x, at) -> named_struct('x', x, 'at', at))"
    return _let("items", items, f"if(size(items) = 0, transform(items, x -> named_struct('x', x, 'at', {zero})), {_let('blocks', blocks, joined)})")


def _joined(spans: str) -> str:
    names = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    return f"array_join(transform({spans}, s -> concat({names}[s.kind], ':', s.start, ':', s.end)), ',')"


def _battery() -> list[tuple[str, str]]:
    """Fields of a tested token, each from those before it: SQL over a token `s`."""
    pick = lambda f: "CASE s.enc " + " ".join(f"WHEN {i} THEN {f(e)}" for i, e in enumerate(ENCODINGS, 1)) + " END"
    # classes: digit, lower case, upper case, other; chances of each under uniform randomness
    share = lambda e: [sum(f(c) for c in e[2]) / len(e[2]) for f in (str.isdigit, str.islower, str.isupper, lambda c: not c.isalnum())]
    shares = lambda e: [(i, x) for i, x in zip((0, 1, 2, 3), share(e)) if x]
    # uniformity over the classes as well: names in mixed case spread over letters but hold few capitals and digits
    by_class = lambda e: "(" + " + ".join(f"power(size(filter(s.class, c -> c = '{i}')), 2) / (s.len * {x}D)" for i, x in shares(e)) + f" - s.len) / {[0, 1, 10.8, 13.8, 16.3][len(shares(e))]}D"
    z_chi = "(s.chi2 - (s.k - 1)) / sqrt(2D * (s.k - 1))"
    z_runs = "(s.changes - (s.len - 1) * s.uniform_change) / sqrt((s.len - 1) * s.uniform_change * (1 - s.uniform_change))"
    z_serial = "if(s.spread > 0, (s.serial / s.spread + 1D / s.len) * sqrt(s.len), 99D)"
    far = "s.len * (s.k * s.agree - 1)"
    # upper tail of the normal distribution beyond `away`, by a bound on Mills' ratio
    tail = "if(s.away <= 0, 0D, (s.away * s.away / 2 + ln(sqrt(2 * pi()) * (s.away + sqrt(s.away * s.away + 8 / pi())) / 2)) / ln(10D))"
    return [
        ("enc", "CASE " + " ".join(f"WHEN s.tok rlike '{p}' THEN {i}" for i, (_, p, *_) in enumerate(ENCODINGS, 1)) + " ELSE 0 END"),
        ("body", "regexp_replace(s.tok, '=+$', '')"),
        ("len", "length(s.body)"), ("k", pick(lambda e: len(e[2]))), ("alphabet", pick(lambda e: f"'{e[2]}'")), ("agree", pick(lambda e: f"{e[3]}D")), ("change", pick(lambda e: f"{e[4]}D")),
        ("uniform_change", pick(lambda e: f"{round(1 - sum(x * x for x in share(e)), 6)}D")),
        ("chars", "split(s.body, '')"),
        ("class", "split(translate(s.body, '0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/-_', concat(repeat('0', 10), repeat('1', 26), repeat('2', 26), '3333')), '')"),
        ("chi2", "s.k * aggregate(array_distinct(s.chars), 0L, (a, c) -> a + (s.len - length(replace(s.body, c, ''))) * (s.len - length(replace(s.body, c, '')))) / cast(s.len as double) - s.len"),
        ("class_chi2", pick(by_class)),
        ("changes", "size(filter(zip_with(slice(s.class, 2, s.len - 1), slice(s.class, 1, s.len - 1), (x, y) -> x <> y), x -> x))"),
        ("place", "transform(s.chars, c -> cast(instr(s.alphabet, c) as double))"),
        ("mean", "aggregate(s.place, 0D, (a, x) -> a + x) / s.len"),
        ("spread", "aggregate(s.place, 0D, (a, x) -> a + (x - s.mean) * (x - s.mean))"),
        ("serial", "aggregate(zip_with(slice(s.place, 2, s.len - 1), slice(s.place, 1, s.len - 1), (x, y) -> (x - s.mean) * (y - s.mean)), 0D, (a, x) -> a + x)"),
        ("random", f"s.enc > 0 and s.class_chi2 <= 1 and abs({z_chi}) <= {REJECT} and abs({z_runs}) <= {REJECT} and abs({z_serial}) <= {REJECT}"),
        ("away", f"((s.k - 1 + {far} - s.chi2) / sqrt(2D * (s.k - 1 + 2 * {far})) + (s.changes - (s.len - 1) * s.change) / sqrt((s.len - 1) * s.change * (1 - s.change))) / sqrt(2D)"),
        ("evidence", f"cast(least({BINS - 1}, greatest(0, floor(if(s.random, {tail}, 0D) / {BIN}))) as int)"),
    ]


def _tested(tokens: str) -> str:
    """SQL for an array of tokens (start, end, tok) with len (at most LONG), random (the battery does
    not reject) and evidence (bin of -log10 of the chance that ordinary text looks as random)."""
    fields = ["start", "end", "tok"]
    for name, value in _battery():
        tokens = f"transform({tokens}, s -> named_struct({', '.join(f"'{f}', s.{f}" for f in fields)}, '{name}', {value}))"
        fields.append(name)
    return f"transform({tokens}, s -> named_struct('start', s.start, 'end', s.end, 'len', least(s.len, {LONG}), 'random', s.random, 'evidence', s.evidence))"


def _scanned(df: DataFrame, text: str, keep: list) -> DataFrame:
    """keep (aliased apart from t, base, tested), t (the text), base (array of spans), tested."""
    rows = df.select(*keep, F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("t"))
    base = f"array_sort(concat({_spans('t', ASSIGN, 0, ASSIGN_VALUE)}, {_spans('t', ACCESS, 1)}, {_spans('t', HEX, 2)}))"
    rows = rows.withColumns({"base": F.expr(base), "tokens": F.expr(f"filter({_spans('t', TOKEN, 3, token=True)}, s -> not s.tok rlike '{PLAIN}')")})
    # in order of start, base spans first: a token lies inside one if their furthest end so far reaches its own
    every = "array_sort(concat(transform(base, b -> named_struct('start', b.start, 'kind', b.kind, 'end', b.end, 'tok', '')), tokens))"
    apart = f"filter({_running(every, 'if(x.kind < 3, x.end, 0)', 'greatest(a, v)', '0')}, s -> s.x.kind = 3 and s.at < s.x.end)"
    rows = rows.withColumn("tokens", F.expr(f"if(size(tokens) = 0, cast(array() as array<struct<start:int,end:int,tok:string>>), transform({apart}, s -> named_struct('start', s.x.start, 'end', s.x.end, 'tok', s.x.tok)))"))
    return rows.withColumn("tested", F.expr(_tested("tokens"))).drop("tokens")


def _accepted(scanned: DataFrame) -> str:
    """SQL for the tokens of `tested` that the weighted Benjamini-Hochberg procedure accepts over all of scanned."""
    bins = scanned.where(F.size("tested") > 0).select(F.explode("tested").alias("s")).groupBy("s.len", "s.evidence").agg(F.count("*").alias("n")).collect()  # at most LONG x BINS rows
    total = sum(r["n"] for r in bins)
    mean = sum(r["n"] * r["len"] for r in bins) / total if total else 1.0
    by_bin: dict[int, int] = {}
    for r in bins:
        e = r["evidence"] + weight_bin(r["len"], mean)
        by_bin[e] = by_bin.get(e, 0) + r["n"]
    cut = accepted_bin(by_bin, total)
    weights = ", ".join(str(weight_bin(n, mean)) for n in range(1, LONG + 1))
    return f"transform(filter(tested, s -> s.random and s.evidence + element_at(array({weights}), s.len) >= {cut}), s -> named_struct('start', s.start, 'kind', 3, 'end', s.end))"


def weight_bin(length: int, mean: float) -> int:
    """Bins that a token's weight, its length over the mean length, adds to its evidence."""
    return math.floor(math.log10(max(1, length) / mean) / BIN)


def accepted_bin(by_bin: dict[int, int], total: int) -> int:
    """The least bin of weighted -log10 p that the Benjamini-Hochberg procedure accepts: p <= rate * rank / total."""
    cut, so_far = 10**6, 0
    for e in sorted(by_bin, reverse=True):
        so_far += by_bin[e]
        if 10 ** (-BIN * e) <= RATE * so_far / total:
            cut = e
    return cut


def scan(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, base and found: arrays of (start, kind, end), kind by its place in KINDS."""
    rows = staged(_scanned(df, text, [F.col(f"`{doc_id}`").alias("doc_id")]).drop("t"), "scan")
    return rows.select("doc_id", "base", F.expr(f"array_sort({_accepted(rows)})").alias("found"))


def digests(found: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans from scan()."""
    count = lambda k: F.expr(f"cast(size(filter(base, s -> s.kind = {k})) as bigint)")
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.size("found").cast("long").alias("n_random"),
        F.sha2(F.expr(_joined("base")), 256).alias("base_sha256"), F.expr(_joined("array_sort(concat(base, found))")).alias("spans"),
    )


def redact(df: DataFrame, doc_id: str = "doc_id", text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """df with every span of its texts replaced by the mark; rows and columns stay."""
    accepted = _accepted(staged(_scanned(df, text, []).select("tested"), "tested"))
    rows = _scanned(df, text, [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(df.columns)])
    rows = rows.withColumn("spans", F.expr(f"array_sort(concat(base, {accepted}))"))
    # the text in pieces; a piece's spans are found by halving, and what reaches into it by the furthest end before them
    first = "aggregate(sequence(1, 31), named_struct('lo', 0, 'hi', size(r)), (w, k) -> if(w.lo >= w.hi, w, if(element_at(r, int((w.lo + w.hi) div 2) + 1).x.start < {}, named_struct('lo', int((w.lo + w.hi) div 2) + 1, 'hi', w.hi), named_struct('lo', w.lo, 'hi', int((w.lo + w.hi) div 2)))), w -> w.lo)"
    begin = f"(i * {PIECE})"
    own = _let("l", first.format(begin), f"named_struct('s', slice(r, l + 1, {first.format(f'({begin} + {PIECE})')} - l), 'at', if(l > 0, greatest(element_at(r, greatest(l, 1)).at, element_at(r, greatest(l, 1)).x.end), 0))")
    piece = f"""aggregate(o.s, named_struct('at', greatest(o.at, {begin}), 'out', ''),
        (a, s) -> if(s.x.start < a.at, named_struct('at', greatest(a.at, s.x.end), 'out', a.out),
            named_struct('at', s.x.end, 'out', concat(a.out, substring(p, a.at - {begin} + 1, s.x.start - a.at), '{mark}'))),
        a -> if(a.at - {begin} >= {PIECE}, a.out, concat(a.out, substring(p, a.at - {begin} + 1))))"""
    pieces = f"transform(regexp_extract_all(t, '(?s).{{1,{PIECE}}}', 0), (p, i) -> {_let('o', own, piece)})"
    clean_text = _let("r", _running("spans", "x.end", "greatest(a, v)", "0"), f"array_join({pieces}, '')")
    at = df.columns.index(text)
    clean = F.expr(f"if(size(spans) = 0, c{at}, {clean_text})")
    return rows.select(*[(clean if i == at else F.col(f"c{i}")).alias(c) for i, c in enumerate(df.columns)])
