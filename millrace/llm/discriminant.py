"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Statistics of every whole text (quality.with_stats) become a vector of logarithms of smoothed ratios.
Each class is a normal distribution: its moments are summed over all labelled rows, so two rows per fold
leave the cluster, whatever the input. A class's covariance is shrunk towards the one that the
classes share (by LAMBDA) and then towards its own diagonal (by GAMMA); which shares, cross-validation over
FOLDS folds decides by log loss, all pairs of shares in one pass over the labelled rows. The Cholesky factor of
each covariance is inverted once and kept: a score is the logistic of the difference of the two log
densities, each a Mahalanobis distance by that factor, and the log prior odds.

Labels: a row per document; of repeated ids the mean decides, half counts as 1; null labels and null ids
are left out. Rows of documents that repeat an id count each. Null text is empty text, which has a vector like
any other and so a score; texts of any length are read whole. Without labelled rows every score is 0.5, with labels of
one class it is that class's smoothed share. Columns of any name pass through score; score and
predicted replace columns of these names. An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import in_batches, staged
from .quality import MORE, STATS, with_stats

#: Shares of the common covariance and of the diagonal that cross-validation chooses from, and its folds.
LAMBDA, GAMMA, FOLDS = (0.0, 0.05, 0.25, 0.75), (0.0, 0.1, 0.5), 4
#: Least variance of a component.
FLOOR = 1e-3
#: Log odds beyond which a score is as good as certain.
SURE = 36.0
COUNTS = [f"q_{s}" for s in STATS + MORE]


def vector() -> list[Column]:
    """Components from the columns of statistics; ratios are smoothed, so that a text of a few words is not extreme."""
    ratio = lambda a, b, by, scale=100.0: F.log1p(F.lit(scale) * F.col(f"q_{a}") / (F.col(f"q_{b}") + F.lit(by)))
    return [
        F.log1p(F.col("q_n_words").cast("double")), F.log((F.col("q_word_chars") + 50.0) / (F.col("q_n_words") + 10.0)), ratio("n_symbols", "word_chars", 100.0), ratio("n_dup_lines", "n_lines", 5.0),
        ratio("n_repeat_words", "n_words", 20.0), ratio("n_upper", "word_chars", 100.0), ratio("n_punct", "word_chars", 100.0), ratio("n_digits", "word_chars", 100.0),
        ratio("n_distinct", "n_words", 20.0, 1.0), F.log((F.col("q_n_words") + 10.0) / (F.col("q_n_lines") + 1.0)),
    ]


P = 10
XS = [f"x{i}" for i in range(P)]
PAIRS = [(i, j) for i in range(P) for j in range(i, P)]


@dataclass
class Moments:
    """Count, sum and sum of products of a class's vectors."""

    n: float
    s: np.ndarray
    m: np.ndarray

    def __add__(self, other: Moments) -> Moments:
        return Moments(self.n + other.n, self.s + other.s, self.m + other.m)

    def mean(self) -> np.ndarray:
        return self.s / self.n

    def cov(self) -> np.ndarray:
        return self.m / self.n - np.outer(self.mean(), self.mean())


NONE = Moments(0.0, np.zeros(P), np.zeros((P, P)))


@dataclass
class Model:
    """Of class 0 and 1: centre, inverse of the Cholesky factor, log determinant; and the log prior odds."""

    mu: list[np.ndarray]
    inverse: list[np.ndarray]
    log_det: list[float]
    odds: float

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.odds)
        for sign, mu, inv, log_det in zip((-1, 1), self.mu, self.inverse, self.log_det):
            out += sign * -0.5 * (log_det + (((x - mu) @ inv.T) ** 2).sum(axis=1))
        return np.clip(out, -SURE, SURE)


def model(classes: list[Moments], lam: float, gamma: float) -> Model:
    """The discriminant of two classes by their moments; a class without rows leaves the prior alone."""
    odds = float(np.log(classes[1].n + 1) - np.log(classes[0].n + 1))
    if not (classes[0].n and classes[1].n):
        return Model([], [], [], odds)
    n = classes[0].n + classes[1].n
    common = sum(c.n * c.cov() for c in classes) / n
    out = Model([], [], [], odds)
    for c in classes:
        cov = (1 - lam) * c.cov() + lam * common
        cov = (1 - gamma) * cov + gamma * np.diag(np.diag(cov))
        root = np.linalg.cholesky(cov + np.diag(np.maximum(FLOOR, FLOOR - np.diag(cov))))
        out.mu.append(c.mean())
        out.inverse.append(np.linalg.inv(root))
        out.log_det.append(2 * float(np.log(np.diag(root)).sum()))
    return out


def moments(rows: DataFrame) -> dict[tuple[int, int], Moments]:
    """By label and fold, of rows with label, fold, weight and x0..."""
    sums = [F.sum(F.col(x) * F.col("weight")).alias(f"s{x}") for x in XS]
    sums += [F.sum(F.col(XS[i]) * F.col(XS[j]) * F.col("weight")).alias(f"m{i}_{j}") for i, j in PAIRS]
    out = {}
    for r in rows.groupBy("label", "fold").agg(F.sum("weight").alias("n"), *sums).collect():  # 2 * FOLDS rows at most
        m = np.zeros((P, P))
        for i, j in PAIRS:
            m[i, j] = m[j, i] = r[f"m{i}_{j}"]
        out[r.label, r.fold] = Moments(float(r.n), np.array([r[f"s{x}"] for x in XS]), m)
    return out


def _losses(rows: DataFrame, models: dict[tuple[int, int], Model]) -> np.ndarray:
    """Log loss of each pair of shares over all rows, every fold judged by the model of the others."""
    tries = max(t for t, _ in models) + 1

    def run(batches):
        import pyarrow as pa

        total = np.zeros(tries)
        for batch in batches:
            x = np.column_stack([batch.column(i).to_numpy() for i in range(P)])
            label, fold, weight = (batch.column(P + i).to_numpy() for i in range(3))
            for (t, f), m in models.items():
                at = fold == f
                if at.any():
                    total[t] += (weight[at] * np.logaddexp(0, np.where(label[at] == 1, -1, 1) * m.log_odds(x[at]))).sum()
        yield pa.RecordBatch.from_arrays([pa.array(range(tries), pa.int32()), pa.array(total)], names=["t", "loss"])

    parts = in_batches(rows.select(*XS, "label", "fold", "weight"), run, "t int, loss double")
    out = np.zeros(tries)
    for r in parts.groupBy("t").agg(F.sum("loss").alias("loss")).collect():  # a row for each pair of shares
        out[r.t] = r.loss
    return out


def fit(stats: DataFrame, labels: DataFrame, label: str, doc_id: str = "doc_id", stats_id: str | None = None) -> Model:
    """From a staged table of ids (stats_id, doc_id by default) and statistics, and labels (doc_id and the label's
    column, 0 or 1) to learn from."""
    known = labels.where(F.col(f"`{doc_id}`").isNotNull() & F.col(f"`{label}`").isNotNull()).groupBy(F.col(f"`{doc_id}`").alias("id")).agg((F.avg(f"`{label}`") >= 0.5).cast("int").alias("label"))
    # rows alike meet before the join: an id may be repeated by a large share of all rows
    own = F.col(f"`{stats_id or doc_id}`")
    rows = stats.where(own.isNotNull()).groupBy(own.alias("id"), *COUNTS).agg(F.count("*").alias("weight"))
    rows = rows.join(known, "id").select((F.crc32(F.concat(F.lit("fold"), F.col("id").cast("string"))) % FOLDS).cast("int").alias("fold"), "label", "weight", *[x.alias(n) for n, x in zip(XS, vector())])
    rows = staged(rows, "labelled")
    by = moments(rows)
    whole = [sum((m for (k, _), m in by.items() if k == c), NONE) for c in (0, 1)]
    shares = list(product(LAMBDA, GAMMA))
    if not by:
        return model(whole, *shares[0])
    others = {f: [sum((m for (k, g), m in by.items() if k == c and g != f), NONE) for c in (0, 1)] for f in range(FOLDS)}
    losses = _losses(rows, {(t, f): model(others[f], *s) for t, s in enumerate(shares) for f in others})
    return model(whole, *shares[int(losses.argmin())])


def scored(stats: DataFrame, by: Model, keep: list[str]) -> DataFrame:
    """keep, score and predicted of every row of a table with statistics."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            x = np.column_stack([batch.column(len(keep) + i).to_numpy() for i in range(P)])
            score = 1 / (1 + np.exp(-by.log_odds(x)))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=[*(f"c{i}" for i in range(len(keep))), "score", "predicted"])

    source = stats.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)], *[x.alias(n) for n, x in zip(XS, vector())])
    fields = "".join(f"c{i} {stats.schema[c].dataType.simpleString()}, " for i, c in enumerate(keep))
    out = in_batches(source, run, f"{fields}score double, predicted int")
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(keep)], "score", "predicted")


def score(df: DataFrame, labels: DataFrame, label: str = "quality", doc_id: str = "doc_id", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """keep (all columns by default), score (0 to 1, higher: label 1 likelier) and predicted of every row of df.
    labels: the rows to learn from."""
    keep = [c for c in (df.columns if keep is None else keep) if c not in ("score", "predicted")]
    name = {c: f"d{i}" for i, c in enumerate(df.columns)}
    inner = [name[c] for c in keep]
    stats = staged(with_stats(df.toDF(*name.values()), name[text], keep=list(dict.fromkeys([name[doc_id], *inner]))), "stats")
    return scored(stats, fit(stats, labels, label, doc_id, name[doc_id]), inner).toDF(*keep, "score", "predicted")


def held_out(doc_id: str, parts: int = 3, part: int = 1) -> Column:
    """Whether a document's label is kept from learning: by crc32 of its id. A row without id has no label."""
    return F.coalesce(F.crc32(F.col(f"`{doc_id}`").cast("string")) % parts == part, F.lit(False))
