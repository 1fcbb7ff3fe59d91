"""Quality rules: robust multivariate outliers.

Statistics of every whole text become a vector of transformed ratios. For each language and source,
each language and the whole corpus the minimum covariance determinant estimate is found by
concentration steps over all rows: distances under the current centre and scatter are binned,
moments are summed for each group and bin before the shuffle, and the bins holding the nearest three
quarters of the group give the next centre and scatter; a last step reweights, over all rows within
the 97.5% quantile. No group is gathered: a step moves one row of moments per group and bin.

A group's estimate counts as its n rows against PRIOR rows of its language's, and that likewise
against the corpus's: a group of many rows is judged by itself, a group of a few mostly by its
language, without a size at which the rule changes. A document whose squared Mahalanobis distance
exceeds the cut is rejected.

Null text has no words, so it fails the base rule; null lang or source form groups of their own.
A very long text is read whole, by one task, and leaves it as counts.
An empty table gives an empty result. Repeated rows count as often as they stand. Columns of any name
pass through reject_outliers; with_stats leaves out columns whose names are those of its statistics.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, grams, in_batches, join_hot, staged, texts_of

SYMBOLS = [b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">"]
PUNCT = bytes(c for c in range(33, 127) if not chr(c).isalnum())
UPPER = bytes(range(65, 91))
DIGITS = bytes(range(48, 58))
MIN_WORDS = 50
#: Columns of statistics.
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MORE = ["n_lines", "n_upper", "n_punct", "n_digits", "n_distinct"]
#: Components of the vector and the least standard deviation of each, in its own unit.
VECTOR = {"length": 0.06, "symbols": 0.25, "dup_lines": 0.7, "repeats": 0.8, "upper": 0.25, "punct": 0.25}
P = len(VECTOR)
#: Share of a group that the estimate rests on, concentration steps, quantile of the reweighting step.
SHARE, STEPS, WITHIN = 0.75, 6, 0.975
#: Rows that the wider group's estimate counts for beside a group's own.
PRIOR = 100
#: Groups up to which their parameters (under 1 KB each) are broadcast; beyond, they are joined, keys of many rows salted.
BROADCAST_GROUPS = 20_000
#: Cut on the squared distance: a chi-squared quantile (upper tail) times a factor for tails heavier than normal.
TAIL, HEAVY = 1e-6, 2.0


def text_stats(raw: bytes, cache: WordHashes) -> tuple[int, ...]:
    words = raw.split()
    n = len(words)
    if not n:
        return (0, 0, sum(map(raw.count, SYMBOLS)), 0, 0, 0, 0, 0, 0, 0)
    joined = b"".join(words)
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    h = np.fromiter(map(cache.__getitem__, words), np.uint64, n)
    repeated = 0
    if n >= 3:
        g = grams(h, 3)
        order = np.argsort(g, kind="stable")
        s = g[order]
        same = s[1:] == s[:-1]
        if same.any():
            twice = np.zeros(len(s), bool)
            twice[1:] |= same
            twice[:-1] |= same
            at = order[twice]
            cover = np.zeros(n, bool)
            for k in range(3):
                cover[at + k] = True
            repeated = int(cover.sum())
    size = len(joined)
    return (
        n, len(joined.decode("utf-8", "replace")), sum(map(raw.count, SYMBOLS)), len(lines) - len(set(lines)), repeated,
        len(lines), size - len(joined.translate(None, UPPER)), size - len(joined.translate(None, PUNCT)), size - len(joined.translate(None, DIGITS)), len(set(words)),
    )


def with_stats(df: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """keep (all columns by default) and the statistics of each whole text, under a `q_` prefix."""
    own = {f"q_{s}" for s in STATS + MORE}
    keep = [c for c in df.columns if c not in own] if keep is None else keep

    def run(batches):
        import pyarrow as pa

        cache = WordHashes()
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                rows = [text_stats(b, cache) for b in texts_of(part.column(at))]
                cols = list(zip(*rows)) if rows else [()] * len(STATS + MORE)
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], *(pa.array(c, pa.int64()) for c in cols)], names=[*(f"c{i}" for i in range(len(keep))), *(f"q_{s}" for s in STATS + MORE)])

    at = keep.index(text) if text in keep else len(keep)  # a text that is kept is not sent twice
    source = df.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)], *([] if text in keep else [F.col(f"`{text}`").cast("string").alias("t")]))
    fields = ", ".join(f"c{i} {df.schema[c].dataType.simpleString()}" for i, c in enumerate(keep))
    out = in_batches(source, run, f"{fields}, " + ", ".join(f"q_{s} long" for s in STATS + MORE))
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(keep)], *[f"q_{s}" for s in STATS + MORE])


def _vector() -> list:
    """The transformed components as columns x0.. of a table with statistics."""
    n = F.greatest(F.col("q_n_words"), F.lit(1)).cast("double")
    chars = F.greatest(F.col("q_word_chars"), F.lit(1)).cast("double")
    wide = lambda c, of, by=100.0: F.log1p(F.lit(by) * c.cast("double") / of)
    return [
        F.log(chars / n), wide(F.col("q_n_symbols"), chars), wide(F.col("q_n_dup_lines"), F.greatest(F.col("q_n_lines"), F.lit(1))),
        wide(F.col("q_n_repeat_words"), n), wide(F.col("q_n_upper"), chars), wide(F.col("q_n_punct"), chars),
    ]


def _base_failed():
    return (F.col("q_n_words") < MIN_WORDS) | (100 * F.col("q_n_repeat_words") > 50 * F.col("q_n_words"))


def _groups(lang: str | None, source: str | None) -> list:
    """Keys of a row's groups: its language and source, its language, the whole corpus (empty)."""
    part = lambda c: F.coalesce(F.concat(F.lit("="), F.col(f"`{c}`").cast("string")), F.lit("-")) if c else F.lit("-")
    return [F.concat(part(lang), F.lit("\x1f"), part(source)), part(lang), F.lit("")]


def chi2_upper(p: int, tail: float) -> float:
    """Upper quantile of chi-squared (Wilson and Hilferty)."""
    from statistics import NormalDist

    z = NormalDist().inv_cdf(1 - tail)
    return p * (1 - 2 / (9 * p) + z * math.sqrt(2 / (9 * p))) ** 3


PARAMS = "g string, n long, mu array<double>, cov array<double>, inv array<double>"


def _floored(cov: np.ndarray) -> np.ndarray:
    floor = np.array(list(VECTOR.values())) ** 2
    return cov + np.diag(np.maximum(0, floor - np.diag(cov)))


def _params(g: str, n: int, mu: np.ndarray, cov: np.ndarray):
    import pandas as pd

    cov = _floored(cov)
    return pd.DataFrame({"g": [g], "n": [n], "mu": [mu.tolist()], "cov": [cov.ravel().tolist()], "inv": [np.linalg.inv(cov).ravel().tolist()]})


def _first(pdf):
    """Medians and scaled median deviations from binned values: diagonal scatter to start from."""
    mu, var, n = np.zeros(P), np.zeros(P), int(pdf.loc[pdf.k == 0, "c"].sum())
    for k in range(P):
        part = pdf[pdf.k == k].sort_values("b")
        x, w = part.b.to_numpy() * 0.02, part.c.to_numpy()
        mu[k] = x[np.searchsorted(np.cumsum(w), w.sum() / 2)]
        away = np.abs(x - mu[k])
        o = np.argsort(away, kind="stable")
        var[k] = (1.4826 * away[o][np.searchsorted(np.cumsum(w[o]), w.sum() / 2)]) ** 2
    return _params(pdf.g.iloc[0], n, mu, np.diag(var))


PAIRS = [(i, j) for i in range(P) for j in range(i, P)]


def _bin(d: float) -> int:
    """The bin of a squared distance, as in fit()."""
    return min(800, math.floor(16 * math.log1p(d)))


def _moments(pdf, kept: float, upto: float | None = None):
    """Centre and scatter from moments for each bin of distance: of the nearest share `kept`, or of the
    bins up to a distance. The nearest rows of a normal group have a smaller scatter than the group."""
    pdf = pdf.sort_values("b")
    n = int(pdf.c.sum())
    near = pdf.iloc[: int(np.searchsorted(np.cumsum(pdf.c.to_numpy()), math.ceil(kept * n))) + 1] if upto is None else pdf[pdf.b <= _bin(upto)]
    near = near if len(near) else pdf
    c = near.c.sum()
    mu = np.array([near[f"s{i}"].sum() for i in range(P)]) / c
    cov = np.zeros((P, P))
    for i, j in PAIRS:
        cov[i, j] = cov[j, i] = near[f"m{i}_{j}"].sum() / c - mu[i] * mu[j]
    return _params(pdf.g.iloc[0], n, mu, cov * (kept / _chi2_cdf(P + 2, chi2_upper(P, 1 - kept))))


def _step(pdf):
    return _moments(pdf, SHARE)


def _reweighted(pdf):
    return _moments(pdf, WITHIN, chi2_upper(P, 1 - WITHIN))


def _chi2_cdf(p: int, x: float) -> float:
    from statistics import NormalDist

    return NormalDist().cdf(((x / p) ** (1 / 3) - (1 - 2 / (9 * p))) / math.sqrt(2 / (9 * p)))


def _distance(x: str, mu: str, inv: str):
    d = [F.col(f"{x}{i}") - F.col(mu)[i] for i in range(P)]
    total = F.lit(0.0)
    for i, j in PAIRS:
        total = total + (1 if i == j else 2) * d[i] * d[j] * F.col(inv)[i * P + j]
    return total


def toward(n: float, mu: np.ndarray, cov: np.ndarray, wider_mu: np.ndarray, wider_cov: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A group's centre and scatter with PRIOR rows of the wider group's beside its n."""
    w = n / (n + PRIOR)
    return w * mu + (1 - w) * wider_mu, w * cov + (1 - w) * wider_cov


def _combined(frames):
    """From a group's estimate (mu, cov), its language's (1) and the corpus's (2): g, n, mu, inv."""
    import pandas as pd

    square = lambda v: np.array(v, float).reshape(P, P)
    for pdf in frames:
        mus, invs = [], []
        for r in pdf.itertuples():
            mu, cov = toward(r.n1, np.array(r.mu1), square(r.cov1), np.array(r.mu2), square(r.cov2))
            mu, cov = toward(r.n, np.array(r.mu), square(r.cov), mu, cov)
            mus.append(mu.tolist())
            invs.append(np.linalg.inv(_floored(cov)).ravel().tolist())
        yield pd.DataFrame({"g": pdf.g, "n": pdf.n, "q_mu": mus, "q_inv": invs})


def _with_group(rows: DataFrame, groups: DataFrame, on: str, counts: DataFrame, how: str = "inner") -> DataFrame:
    """rows with what is known of their group. counts: the groups (n rows each), which decide how to join: the corpus is one
    group of all rows, a language may be one of a third of them."""
    return rows.join(F.broadcast(groups), on, how) if counts.count() <= BROADCAST_GROUPS else join_hot(rows, groups, on, counts, how)


def fit(stats: DataFrame, lang: str | None = "lang", source: str | None = "source") -> DataFrame:
    """g, n, q_mu, q_inv: rows, centre and inverse scatter by which each language and source of a staged table
    with statistics is judged."""
    own, wide, corpus = _groups(lang, source)
    rows = stats.where(~_base_failed()).select(own.alias("own"), wide.alias("wide"), *[x.alias(f"x{i}") for i, x in enumerate(_vector())])
    pairs = staged(rows.select("own", "wide").distinct(), "groups")
    rows = rows.withColumn("g", F.explode(F.array("own", "wide", corpus))).drop("own", "wide")
    coordinate = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.round(F.col(f"x{k}") / 0.02).cast("long").alias("b")) for k in range(P)]))
    binned = rows.select("g", coordinate.alias("v")).groupBy("g", "v.k", "v.b").agg(F.count("*").alias("c"))
    params = staged(binned.groupBy("g").applyInPandas(_first, PARAMS), "mcd0")
    for k, step in enumerate([*[_step] * STEPS, _reweighted]):
        at = _with_group(rows, params.drop("n"), "g", params.select("g", "n")).withColumn("d", _distance("x", "mu", "inv"))
        at = at.withColumn("b", F.least(F.floor(16 * F.log1p(F.greatest("d", F.lit(0.0)))), F.lit(800)).cast("long"))
        sums = at.groupBy("g", "b").agg(F.count("*").alias("c"), *[F.sum(f"x{i}").alias(f"s{i}") for i in range(P)], *[F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"m{i}_{j}") for i, j in PAIRS])
        params = staged(sums.groupBy("g").applyInPandas(step, PARAMS), f"mcd{k + 1}")
    named = lambda n: [F.col(c).alias(f"{c}{n}") for c in ("n", "mu", "cov")]
    every = pairs.join(params.select(F.col("g").alias("own"), "n", "mu", "cov"), "own").join(params.select(F.col("g").alias("wide"), *named(1)), "wide")
    whole = F.broadcast(params.where(F.col("g") == corpus).select(F.col("g").alias("any"), *named(2)))  # one row
    every = every.withColumn("any", corpus).join(whole, "any")
    return staged(every.withColumnRenamed("own", "g").mapInPandas(_combined, "g string, n long, q_mu array<double>, q_inv array<double>"), "estimates")


def verdicts(stats: DataFrame, estimates: DataFrame, lang: str | None = "lang", source: str | None = "source") -> DataFrame:
    """stats with q_base_failed, q_distance (squared) and q_kept."""
    xs = [f"q_x{i}" for i in range(P)]
    rows = stats.withColumns({"q_g": _groups(lang, source)[0], **{x: v for x, v in zip(xs, _vector())}})
    estimates = estimates.withColumnsRenamed({"g": "q_g", "n": "q_n"})
    out = _with_group(rows, estimates.drop("q_n"), "q_g", estimates.select("q_g", F.col("q_n").alias("n")), "left")
    out = out.withColumns({"q_base_failed": _base_failed(), "q_distance": _distance("q_x", "q_mu", "q_inv")})
    out = out.withColumn("q_kept", ~F.col("q_base_failed") & (F.coalesce(F.col("q_distance"), F.lit(0.0)) <= HEAVY * chi2_upper(P, TAIL)))
    return out.select(*stats.columns, "q_base_failed", "q_distance", "q_kept")


def reject_outliers(df: DataFrame, text: str = "text", lang: str | None = "lang", source: str | None = "source") -> DataFrame:
    """The rows of df that are kept, with df's columns. Texts are read twice and never shuffled."""
    name = {c: f"c{i}" for i, c in enumerate(df.columns)}
    rows = df.toDF(*name.values())
    text, lang, source = name[text], lang and name[lang], source and name[source]
    estimates = fit(staged(with_stats(rows, text, [c for c in (lang, source) if c]), "stats"), lang, source)
    return verdicts(with_stats(rows, text), estimates, lang, source).where("q_kept").select(*rows.columns).toDF(*df.columns)
