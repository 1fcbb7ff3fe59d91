"""Periodic runs of words: suffix automaton, small-to-large merging of end positions, extension.

A run is a stretch of words with smallest period q that no neighbouring word extends, of at least
max(min_length, min_exponent * q) words. Each text is searched whole, by itself, in one pass and
without a shuffle.

The automaton of a text's words has a state for each class of substrings that end at the same places.
From long states to short ones, a state's ordered end positions are merged into those of its suffix
link, the smaller set into the larger. Where a merge makes two ends neighbours, at a distance not
above the state's length, the state's longest word sequence stands twice in a row: the square seeds a
run, which is extended by comparing words a period apart. A run of exponent e and length n shows at a
state of at least n * (1 - 1/e) words, so shorter states need no sets. Two of a run's occurrences a
period apart are neighbours where they first meet, which is why no run is missed; a seed at a
multiple of the period gives the same stretch, and its smallest period is kept.

Any word of a run lies in a k-gram that the text holds twice (k = min_length * (1 - 1/e)), so the automaton
reads only the stretches that such k-grams cover, by hash; a collision covers too much, never too little.

Null text has no words, hence no runs and an empty collapsed text. A text of any length is searched whole;
the automaton holds a few hundred bytes for each word of its repeating stretches. Repeated rows are
searched each by itself. Columns of any name pass through; runs and collapsed replace columns of these names.
An empty table gives an empty result.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import GAP, WordHashes, grams, hashes, in_batches, texts_of

MIN_LENGTH, MIN_EXPONENT = 24, 3
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"
#: Ends of a block of an ordered set at most.
BLOCK = 1024


class Ends:
    """An ordered set of end positions in blocks, so that an insertion moves few of them."""

    __slots__ = ("blocks", "lows", "size")

    def __init__(self, first: int):
        self.blocks, self.lows, self.size = [[first]], [first], 1

    def add(self, x: int) -> tuple[int | None, int | None]:
        """Inserts x; its neighbours."""
        at = max(0, bisect_left(self.lows, x) - 1)
        block = self.blocks[at]
        i = bisect_left(block, x)
        below = block[i - 1] if i else None
        above = block[i] if i < len(block) else self.lows[at + 1] if at + 1 < len(self.lows) else None
        block.insert(i, x)
        self.size += 1
        if not i:
            self.lows[at] = x
        if len(block) > BLOCK:
            half = len(block) // 2
            self.blocks.insert(at + 1, block[half:])
            self.lows.insert(at + 1, block[half])
            del block[half:]
        return below, above


def automaton(words: list[int]) -> tuple[list[int], list[int], list[int]]:
    """Length, suffix link and own end position (-1: none) of each state, the root first."""
    length, link, end, moves = [0], [-1], [-1], [{}]
    last = 0
    for i, w in enumerate(words):
        new = len(length)
        length.append(i + 1)
        link.append(0)
        end.append(i)
        moves.append({})
        p = last
        while p >= 0 and w not in moves[p]:
            moves[p][w] = new
            p = link[p]
        if p >= 0:
            q = moves[p][w]
            if length[p] + 1 < length[q]:
                copy = len(length)
                length.append(length[p] + 1)
                link.append(link[q])
                end.append(-1)
                moves.append(moves[q].copy())
                while p >= 0 and moves[p].get(w) == q:
                    moves[p][w] = copy
                    p = link[p]
                link[q] = copy
                q = copy
            link[new] = q
        last = new
    return length, link, end


def _extended(ids: np.ndarray, at: int, d: int) -> tuple[int, int]:
    """The longest stretch of period d around words at and at + d, which are equal: start and end (exclusive)."""
    lo, hi, step = at, at + 1, 64
    while hi < len(ids) - d:
        n = min(step, len(ids) - d - hi)
        differ = ids[hi : hi + n] != ids[hi + d : hi + d + n]
        if differ.any():
            hi += int(differ.argmax())
            break
        hi, step = hi + n, step * 2
    step = 64
    while lo:
        n = min(step, lo)
        differ = (ids[lo - n : lo] != ids[lo - n + d : lo + d])[::-1]
        if differ.any():
            lo -= int(differ.argmax())
            break
        lo, step = lo - n, step * 2
    return lo, hi + d


def runs_of(ids: np.ndarray, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> list[tuple[int, int, int]]:
    """Start, length and period of all runs of a sequence of numbers, in order of start and period."""
    least = math.ceil(min_length * (min_exponent - 1) / min_exponent)
    length, link, end = automaton(ids.tolist())
    order = np.argsort(-np.array(length, dtype=np.int64), kind="stable").tolist()
    sets: dict[int, Ends] = {}
    known: dict[int, list[tuple[int, int]]] = {}  # period -> stretches found
    for v in order:
        if length[v] < least:
            break
        own = sets.pop(v, None)
        if end[v] >= 0:
            # a state with an end of its own merges it like a child's
            own = _merged(own, Ends(end[v]), length[v], min_exponent, ids, known)
        u = link[v]
        if length[u] >= least:
            sets[u] = _merged(sets.get(u), own, length[u], min_exponent, ids, known)
    period: dict[tuple[int, int], int] = {}
    for d, stretches in known.items():
        for s in stretches:
            if s[1] - s[0] >= max(min_length, min_exponent * d):
                period[s] = min(d, period.get(s, d))
    return sorted((lo, hi - lo, d) for (lo, hi), d in period.items())


def _merged(a: Ends | None, b: Ends, length: int, min_exponent: int, ids: np.ndarray, known: dict) -> Ends:
    """The union of two ordered sets of a state; neighbours new to it seed runs."""
    if a is None:
        return b
    if a.size < b.size:
        a, b = b, a
    for block in b.blocks:
        for x in block:
            below, above = a.add(x)
            if below is not None and (x - below) * (min_exponent - 1) <= length:
                _seed(below, x - below, ids, known)
            if above is not None and (above - x) * (min_exponent - 1) <= length:
                _seed(x, above - x, ids, known)
    return a


def _seed(at: int, d: int, ids: np.ndarray, known: dict) -> None:
    """Extends the square of period d whose first half ends at a word, unless its stretch is known."""
    stretches = known.setdefault(d, [])
    i = bisect_left(stretches, (at + 1,)) - 1
    if i < 0 or stretches[i][1] - d <= at:
        insort(stretches, _extended(ids, at, d))


def _covered(h: np.ndarray, k: int) -> list[tuple[int, int]]:
    """Maximal stretches covered by k-grams that stand at least twice."""
    if len(h) <= k:
        return []
    g = grams(h, k)
    order = np.argsort(g, kind="stable")
    same = g[order[1:]] == g[order[:-1]]
    if not same.any():
        return []
    twice = np.zeros(len(g), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(h) + 1, np.int64)
    np.add.at(edge, np.flatnonzero(twice), 1)
    np.add.at(edge, np.flatnonzero(twice) + k, -1)
    cover = np.concatenate([[0], (np.cumsum(edge) > 0).astype(np.int8)])  # the last edge closes all
    return list(zip(np.flatnonzero(np.diff(cover) == 1).tolist(), np.flatnonzero(np.diff(cover) == -1).tolist()))


def text_runs(words: list[bytes], cache: WordHashes, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> list[tuple[int, int, int]]:
    k = math.ceil(min_length * (min_exponent - 1) / min_exponent)
    if len(words) < min_length:
        return []
    out = []
    for lo, hi in _covered(hashes(words, cache), k):
        if hi - lo >= min_length:
            numbers: dict[bytes, int] = {}
            ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words[lo:hi]), np.int64, hi - lo)
            out += [(lo + s, n, q) for s, n, q in runs_of(ids, min_length, min_exponent)]
    return out


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words kept, joined by a space: of every run, its first period alone."""
    keep = np.ones(len(words), bool)
    for s, n, q in runs:
        keep[s + q : s + n] = False
    return b" ".join(w for w, k in zip(words, keep.tolist()) if k) if runs else b" ".join(words)


def collapse(df: DataFrame, text: str = "text", keep: list[str] | None = None, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> DataFrame:
    """keep (all columns by default), runs (start and length in words, period; by start, then period) and
    collapsed, the text with every run cut down to its first period, its words joined by one space."""
    if min_exponent < 2 or min_length < min_exponent:
        raise ValueError("a run holds two periods at least")
    keep = [c for c in (df.columns if keep is None else keep) if c not in ("runs", "collapsed")]

    def run(batches):
        import pyarrow as pa

        cache = WordHashes()
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for batch in batches:
            found, texts = [], []
            for raw in texts_of(batch.column(len(keep))):
                words = raw.split()
                runs = text_runs(words, cache, min_length, min_exponent)
                found.append([{"start": s, "length": n, "period": q} for s, n, q in runs])
                texts.append(collapsed(words, runs).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(found, kind), pa.array(texts, pa.string())], names=[*(f"c{i}" for i in range(len(keep))), "runs", "collapsed"])

    source = df.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)], F.col(f"`{text}`").cast("string").alias("t"))
    fields = "".join(f"c{i} {df.schema[c].dataType.simpleString()}, " for i, c in enumerate(keep))
    out = in_batches(source, run, f"{fields}runs {RUNS}, collapsed string")
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(keep)], "runs", "collapsed")


def looped(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and text, with runs planted in a tenth of the texts: with h = crc32 of the id, g = h // 10, n words,
    a = g % n and p = 1 + (n - a) // (3 + g % 8), the words from a on repeat the p words at a, where h % 10 = 0.
    A row without id is left as it is."""
    words = F.split(F.regexp_replace("text", f"^{GAP}|{GAP}$", ""), GAP)
    h = F.crc32(F.col(f"`{doc_id}`").cast("string"))
    rows = df.select(F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"), h.alias("h"))
    rows = rows.withColumn("words", F.when((F.col("h") % 10 == 0) & F.col("text").rlike("[^\\x20\\x09-\\x0D]"), words))
    rows = rows.withColumns({"n": F.size("words").cast("long"), "g": F.expr("h div 10")}).withColumn("a", F.expr("g % n"))
    rows = rows.withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    loop = "array_join(slice(concat(slice(words, 1, int(a)), flatten(array_repeat(slice(words, int(a) + 1, int(p)), int((n - a) div p) + 1))), 1, int(n)), ' ')"
    return rows.select("doc_id", F.expr(f"if(words is null, text, {loop})").alias("text"))


def digests(found: DataFrame) -> DataFrame:
    """Of collapse()'s rows: doc_id, n_runs, the run of greatest length/period (ties: smallest start, then
    period) with its exponent in thousandths, and digests of all runs and of the collapsed text."""
    # quotients of whole numbers below 2**26 are equal as doubles only if they are equal
    best = F.expr("array_max(transform(runs, r -> struct(r.length / r.period as e, -r.start as s, -r.period as p, r.length as n)))")
    rows = found.withColumn("best", best)
    listed = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')")
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.s")).alias("start"), F.col("best.n").alias("length"), (-F.col("best.p")).alias("period"),
        F.expr("1000 * best.n div -best.p").alias("exponent_milli"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
