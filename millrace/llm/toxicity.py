"""Toxicity scores from a learned lexicon.

A lexicon of terms and of word beginnings that go with the toxic label is learned from labelled
rows. The terms form a trie; every distinct token of a text is run through the trie as a
Levenshtein automaton of one edit (for terms of FUZZY letters or more), so misspelled terms are
found with the path that led to them.
Around each hit a window of words is read: quotation marks and words of reporting speak for
quotation, words of address for abuse. Counts of hits by kind and context feed a logistic
regression. It is fitted crosswise: each half of the labelled rows is read with the lexicon of the
other half; texts are then scored with the lexicon of both.

Labels come only from rows whose crc32(doc_id as text) mod 5 is not 0; FIT_ROWS of them, those with
the least hash of the doc_id, are the documented bound of the sample (every term needs SUPPORT of
them, so the lexicon is bounded too). Labels, lang, source and doc_id never enter a score.

Null text is empty; an empty text gets the score of a text without hits. Without labels of both kinds
every score is the share of toxic rows among what there is (0 if nothing). Rows that repeat a doc_id
are scored each by its own text; as a labelled row such a doc_id counts once, by its least text; where
labels repeat a doc_id, toxic wins. A null doc_id is scored, not labelled, not held out. Columns of
other names are neither read nor lost. A very long text is read whole, by one task. An empty table of
documents gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_batches, staged

#: Labelled rows that are used.
FIT_ROWS = 16_000
#: Rows with a term that the lexicon needs, and log-odds it needs.
SUPPORT, ODDS = 3, 2.5
#: Lengths of word beginnings, and rows with one.
STEMS, STEM_SUPPORT = (4, 5, 6, 7), 5
#: Terms of this length or more are also found with one edit.
FUZZY = 5
WINDOW = 6
#: Words of reporting and of address in the corpus languages: fixed values.
REPORT = frozenset("said says wrote writes quoted quote called calls reported claims dit disait écrit cité appelé dijo escribió llamó citó sagte schrieb nannte zitierte".split())
ADDRESS = frozenset("you your you're u ur yourself tu toi ton ta tes vous votre usted tú te tus ustedes du dich dir dein deine ihr euch".split())
#: Quotation marks; single ones only at the edges of a word, as they are apostrophes within it.
QUOTES = re.compile("[\"“”„«»]|^\\W*['‘’]|['‘’]\\W*$")
FEATURES = ["any", "exact", "stem", "fuzzy", "quoted", "addressed", "density", "strongest"]


class Trie:
    """Terms with weights; a beginning is open: whatever follows it, it is a hit."""

    def __init__(self, terms: dict[str, float], stems: dict[str, float]):
        self.root: dict = {}
        for kind, source in (("$", terms), ("*", stems)):
            for term, weight in source.items():
                node = self.root
                for c in term:
                    node = node.setdefault(c, {})
                node[kind] = weight
        # a token at one edit of a term is the term without a letter, or without one of its own letters is the term or that
        long = [t for t in terms if len(t) >= FUZZY]
        self.cut = {t[:i] + t[i + 1 :] for t in long for i in range(len(t))}
        self.near = self.cut.union(long)
        self.lengths = range(min(map(len, long)) - 1, max(map(len, long)) + 2) if long else range(0)

    def _may_be_near(self, token: str) -> bool:
        """False only for tokens without a term at one edit."""
        if len(token) not in self.lengths:
            return False
        if token in self.cut:
            return True
        near = self.near
        for i in range(len(token)):
            if token[:i] + token[i + 1 :] in near:
                return True
        return False

    def find(self, token: str) -> tuple[int, float] | None:
        """(edits, weight) of the best term: kind 0 exact, 1 beginning, 2 with one edit."""
        stem, node = None, self.root
        for c in token:
            node = node.get(c)
            if node is None:
                break
            if "*" in node:
                stem = max(stem or 0.0, node["*"])
        else:
            if "$" in node:
                return 0, node["$"]
        if stem is not None:
            return 1, stem
        if self._may_be_near(token) and (w := self._near(token)) is not None:
            return 2, w
        return None

    def _near(self, token: str) -> float | None:
        """Weight of the best term of FUZZY letters or more at one edit: the automaton's states are
        (place in the token, edits so far), advanced along every path of the trie that keeps one alive."""
        best, n, depth, node = None, len(token), 0, self.root
        while node is not None and depth <= n:  # edits so far: 0, place: depth
            for c, child in node.items():
                if len(c) != 1 or c in "$*":
                    continue
                for place in (depth + 1, depth):  # c replaces token[depth], or stands before it
                    if place <= n and not (place == depth + 1 and token[depth : depth + 1] == c):
                        best = self._rest(child, token, place, depth + 1, best)
            if depth < n:  # token[depth] is too much
                best = self._rest(node, token, depth + 1, depth, best)
                node = node.get(token[depth])
            depth += 1
        return best

    @staticmethod
    def _rest(node: dict, token: str, place: int, length: int, best: float | None) -> float | None:
        for c in token[place:]:
            node = node.get(c)
            if node is None:
                return best
            length += 1
        if length >= FUZZY and "$" in node:
            return max(best or 0.0, node["$"])
        return best


EDGE = re.compile(r"^\W+|\W+$")


class Seen(dict):
    """token -> what the trie finds; bounded, emptied when full."""

    limit = 400_000

    def __init__(self, trie: Trie):
        self.trie = trie

    def __missing__(self, token: str):
        if len(self) >= self.limit:
            self.clear()
        core = token if token.isalpha() else EDGE.sub("", token)
        hit = self[token] = self.trie.find(core) if core else None
        return hit


class Scorer:
    """Features of texts."""

    def __init__(self, terms: dict[str, float], stems: dict[str, float]):
        self.trie = Trie(terms, stems)
        self.seen = Seen(self.trie)

    def features(self, text: str) -> list[float]:
        words, seen = text.lower().split(), self.seen
        hits = [(i, h) for i, w in enumerate(words) if (h := seen[w])]
        if not hits:
            return [0.0] * len(FEATURES)
        kinds, quoted, addressed = [0, 0, 0], 0, 0
        for i, (kind, _) in hits:
            kinds[kind] += 1
            around = words[max(0, i - WINDOW) : i + WINDOW + 1]
            quoted += any(w in REPORT or QUOTES.search(w) for w in around)
            addressed += any(w in ADDRESS for w in around)
        strong = sum(1 for _, (kind, _) in hits if kind < 2)
        return [
            1.0, math.log1p(kinds[0]), math.log1p(kinds[1]), math.log1p(kinds[2]), math.log1p(quoted), math.log1p(addressed),
            math.log1p(1000 * strong / max(20, len(words))), max(w for _, (kind, w) in hits if kind < 2) / 10 if strong else 0.0,
        ]


def held_out(doc_id: str = "doc_id"):
    return F.col(doc_id).isNotNull() & (F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0)


def sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """text, toxic, half (0 or 1) of at most FIT_ROWS labelled rows."""
    rows = labels.where("doc_id is not null and toxic is not null").where(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIT_ROWS).withColumn("half", F.pmod(F.xxhash64(F.lit("half"), "doc_id"), F.lit(2)))
    out = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text")).join(F.broadcast(rows), "doc_id")  # FIT_ROWS rows of 20 bytes
    return staged(out.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"), F.max("half").alias("half")).drop("doc_id"), "sample")


def lexicon(rows: DataFrame) -> tuple[dict[str, float], dict[str, float]]:
    """Terms and beginnings with their log-odds: a few for each SUPPORT toxic rows of the bounded sample."""

    def count(batches):
        import pyarrow as pa

        tally: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                cores = {c for w in set(text.lower().split()) if (c := EDGE.sub("", w))}
                stems = {c[:k] + "*" for c in cores for k in STEMS if len(c) >= k}
                tally[1 if toxic else 0].update(cores | stems)
        keys = list(tally[0].keys() | tally[1].keys())
        for lo in range(0, len(keys), 50_000):
            part = keys[lo : lo + 50_000]
            yield pa.RecordBatch.from_pydict({"term": pa.array(part, pa.string()), "neg": pa.array([tally[0][k] for k in part], pa.int64()), "pos": pa.array([tally[1][k] for k in part], pa.int64())})

    totals = rows.groupBy().agg(F.count_if(F.col("toxic") > 0).alias("p"), F.count_if(F.col("toxic") <= 0).alias("n")).first()
    odds = F.log((F.col("pos") + 0.5) / (totals["p"] + 1.0)) - F.log((F.col("neg") + 0.5) / (totals["n"] + 1.0))
    counts = in_batches(rows.select("text", F.col("toxic").cast("int")), count, "term string, neg long, pos long").groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    counts = counts.withColumn("odds", odds).withColumn("open", F.col("term").endswith("*"))
    good = counts.where((F.col("pos") >= F.when(F.col("open"), STEM_SUPPORT).otherwise(SUPPORT)) & (F.col("odds") >= ODDS))
    out: tuple[dict, dict] = ({}, {})
    for r in good.select("open", F.col("term"), "odds").orderBy("term").collect():
        out[int(r["open"])][r["term"].removesuffix("*")] = float(r["odds"])
    return out


_SCORERS: dict[str, Scorer] = {}


def scorer(key: str, terms: dict, stems: dict) -> Scorer:
    """One scorer for each Python worker and lexicon."""
    if key not in _SCORERS:
        _SCORERS.clear()
        _SCORERS[key] = Scorer(terms, stems)
    return _SCORERS[key]


def regress(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Logistic regression by Newton steps; the last weight is the intercept, without penalty."""
    x = np.column_stack((x, np.ones(len(x))))
    w, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(h, x.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return w


def _featured(batches, key, lex):
    s = scorer(key, *lex)
    for batch in batches:
        for lo in range(0, batch.num_rows, 1000):
            part = batch.slice(lo, 1000)
            yield part, np.array([s.features(t or "") for t in part.column(1).to_pylist()]).reshape(part.num_rows, len(FEATURES))


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs."""
    import uuid

    rows = sample(docs, labels)
    context = docs.sparkSession.sparkContext
    lexica = [lexicon(rows.where("half = 0")), lexicon(rows.where("half = 1")), lexicon(rows)]
    shared, key = context.broadcast(lexica), uuid.uuid4().hex

    def fit_rows(half):
        def run(batches):
            import pyarrow as pa

            for part, x in _featured(batches, f"{key}{half}", shared.value[1 - half]):
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c) for c in x.T)], names=["toxic", *FEATURES])

        return in_batches(rows.where(F.col("half") == half).select(F.col("toxic").cast("int"), "text"), run, "toxic int, " + ", ".join(f"{f} double" for f in FEATURES))

    fit = fit_rows(0).unionAll(fit_rows(1)).toPandas()  # at most FIT_ROWS
    y = (fit["toxic"].to_numpy() > 0).astype(float)
    if 0 < y.sum() < len(y):
        weights = regress(fit[FEATURES].to_numpy(float), y)
    else:
        share = min(max(y.mean() if len(y) else 0.0, 1e-9), 1 - 1e-9)
        weights = np.array([0.0] * len(FEATURES) + [math.log(share / (1 - share))])

    def scored(batches):
        import pyarrow as pa

        for part, x in _featured(batches, key, shared.value[2]):
            z = x @ weights[:-1] + weights[-1]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(1 / (1 + np.exp(-np.clip(z, -500, 500))))], names=["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = in_batches(docs.select("doc_id", F.col("text").cast("string")), scored, f"doc_id {kind}, score double")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
