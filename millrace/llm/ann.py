"""Approximate nearest neighbours by cross-polytope hashing.

Each of TABLES tables turns unit vectors by two pseudo-rotations (each three rounds of random signs and a
fast Hadamard transform) and assigns them to the nearest signed axis of either: a bucket is a pair of axes.
A query probes the buckets whose axes lie nearest to it; what shares a bucket is reranked exactly, by
Euclidean distance of the original vectors in double precision. From 512 axes on, one rotation makes enough buckets.

Vectors whose lengths differ by no more than a factor of BAND share a band, and each band has its own buckets,
since among vectors of about one length the nearest are those of the nearest direction. So one long or short
vector changes nothing for the others. Of a band's n rows, a query probes in each table REACH / n ** 0.25 of the buckets:
the more rows, the nearer the neighbours, and the fewer buckets find them. Where that is every bucket (33 rows), the
band is compared whole.

Rows meet by the bucket's first axis, and in that group each query reads the rows of its second axes. Groups are
dealt in blocks: rows of a group over row blocks, its queries over query blocks, so a
bucket that holds a third of all rows is many tasks, and a task keeps only the K best of each query.
Queries left with fewer than K are compared with all rows, in blocks.

Vectors that are null, zero, or hold null or non-finite components take no part; vectors of another
length than the query's are no candidates. Rows with the query's own id are no candidates. Ties go
to the smaller id. Where queries repeat an id, the least vector asks; where rows do, the nearest counts.
Columns of other names are neither read nor lost. Empty tables give an empty result.

Cost: a query reranks about TABLES * REACH / n ** 0.25 of a band's rows (less what tables share): 31% of 2,000 rows, 17% of
50,000, 1% of a billion. Lengths that spread over many bands cost probes for each.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import in_batches, staged

K = 10
TABLES, SEED = 12, 20
#: Share of a table's buckets that a query probes: REACH / n ** 0.25 among n rows of one band.
REACH = 0.2
#: Bounds of bands of lengths grow by this.
BAND = 1.25
#: Two rotations make buckets of pairs of axes; from this many axes on, there is one.
MANY_AXES = 512
#: Rows and queries of a block.
ROWS, QUERIES = 10_000, 2_000
#: Components of the rows that are gathered for queries at once (and those of one query more).
PAIRS = 4_000_000


def hadamard(a: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of each row; the width is a power of two."""
    n, h = a.shape[1], 1
    while h < n:
        b = a.reshape(-1, n // (2 * h), 2, h)
        a = np.concatenate((b[:, :, 0] + b[:, :, 1], b[:, :, 0] - b[:, :, 1]), axis=2).reshape(-1, n)
        h *= 2
    return a / np.sqrt(n)


def tables_of(x: np.ndarray):
    """For each table the signed coordinates of each row in its rotations: arrays of shape (rows, axes)."""
    width = 1 << max(1, int(x.shape[1] - 1).bit_length())
    padded = np.zeros((len(x), width))
    padded[:, : x.shape[1]] = x
    rng = np.random.default_rng([SEED, width])
    for _ in range(TABLES):
        turned = []
        for _ in range(2 if 2 * width < MANY_AXES else 1):
            y = padded
            for _ in range(3):
                y = hadamard(y * rng.choice([-1.0, 1.0], width))
            turned.append(np.concatenate((y, -y), axis=1))
        yield turned


def share(n: int) -> float:
    """Share of buckets probed in each table, among n rows."""
    return REACH / n**0.25


def assigned(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and second axis of each row in each table: two arrays of shape (rows, tables)."""
    firsts, seconds = [], []
    for turned in tables_of(x):
        firsts.append(turned[0].argmax(axis=1))
        seconds.append(turned[1].argmax(axis=1) if len(turned) > 1 else np.zeros(len(x), np.int64))
    return np.stack(firsts, axis=1), np.stack(seconds, axis=1)


def probed(x: np.ndarray, shares: list[float]):
    """For each row and share, in each table: row, place of the share, table, the probed buckets' first axes
    and for each of them the second axes. The nearest buckets are those that lose the least of the
    coordinates of the row's own axes."""
    for t, turned in enumerate(tables_of(x)):
        axes = turned[0].shape[1]
        lost = [(y.max(axis=1, keepdims=True) - y) ** 2 for y in turned]
        for i in range(len(x)):
            loss = (lost[0][i][:, None] + lost[1][i][None, :]).ravel() if len(turned) > 1 else lost[0][i]
            for place, part in enumerate(shares):
                n = min(len(loss), max(8, math.ceil(part * len(loss))))
                at = np.sort(np.argpartition(loss, n - 1)[:n])
                first, second = np.divmod(at, axes) if len(turned) > 1 else (at, np.zeros(n, np.int64))
                firsts, cuts = np.unique(first, return_index=True)
                yield i, place, t, firsts, np.split(second, cuts[1:])


def valid(df: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """id, v, d (dimension) and band (of the length, which is taken without overflow) of the vectors that take part."""
    v = F.col(f"`{embedding}`").cast("array<double>")
    ok = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = df.select(F.col(f"`{vec_id}`").cast("long").alias("id"), v.alias("v")).where(F.coalesce(ok, F.lit(False)) & F.col("id").isNotNull())
    greatest = F.array_max(F.transform("v", F.abs))
    log_length = F.log(greatest) + 0.5 * F.log(F.aggregate(F.transform("v", lambda e: e / greatest), F.lit(0.0), lambda a, e: a + e * e))
    return rows.withColumns({"d": F.size("v"), "band": F.floor(log_length / math.log(BAND) + 0.5).cast("int")})


#: Key of a bucket's group: place of its band, table, first axis.
def _key(band: int, table: int, axis: int) -> int:
    return (band << 28) + (table << 24) + axis


#: The table of bands that are compared whole.
WHOLE = 15


def _hashed(df: DataFrame, emit, schema: str) -> DataFrame:
    """id, v and a row for each struct in the lists that emit gives for the rows' unit vectors of one dimension."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            lists, bands = batch.column("v"), batch.column("band").to_numpy(zero_copy_only=False)
            sizes = np.diff(lists.offsets.to_numpy())
            flat, first = lists.flatten().to_numpy(zero_copy_only=False), np.cumsum(sizes) - sizes
            out: list = [None] * batch.num_rows
            for d in np.unique(sizes):
                at = np.flatnonzero(sizes == d)
                x = flat[first[at][:, None] + np.arange(d)]
                x = x / np.abs(x).max(axis=1, keepdims=True)
                for k, found in zip(at.tolist(), emit(x / np.sqrt((x * x).sum(axis=1, keepdims=True)), int(d), bands[at])):
                    out[k] = found
            kind = pa.struct([("key", pa.int64()), ("sub", pa.int32() if schema == "int" else pa.list_(pa.int32()))])
            yield pa.RecordBatch.from_arrays([batch.column("id"), lists, pa.array(out, pa.list_(kind))], names=["id", "v", "at"])

    return in_batches(df, run, f"id long, v array<double>, at array<struct<key: long, sub: {schema}>>").select("id", "v", F.inline("at"))


def _hashed_rows(df: DataFrame, bands: dict[int, dict[int, tuple[int, int]]]) -> DataFrame:
    """id, v, key, sub (the second axis): a row for each table, or one in a band that is compared whole."""

    def emit(x, d, own):
        firsts, seconds = assigned(x)
        for f, s, band in zip(firsts.tolist(), seconds.tolist(), own.tolist()):
            place, n = bands[d][band]
            yield [(_key(place, WHOLE, 0), 0)] if share(n) * TABLES >= 1 else [(_key(place, t, f[t]), s[t]) for t in range(TABLES)]

    return _hashed(df, emit, "int")


def _hashed_queries(df: DataFrame, bands: dict[int, dict[int, tuple[int, int]]]) -> DataFrame:
    """id, v, key, sub (the second axes probed, null: all): a row for each first axis probed, in all bands."""

    def emit(x, d, own):
        whole = [(_key(place, WHOLE, 0), None) for place, n in bands.get(d, {}).values() if share(n) * TABLES >= 1]
        others = [(place, share(n)) for place, n in bands.get(d, {}).values() if share(n) * TABLES < 1]
        for lo in range(0, len(x), 50):
            part = x[lo : lo + 50]
            out = [list(whole) for _ in part]
            for i, j, t, firsts, seconds in probed(part, [p for _, p in others]):
                out[i].extend((_key(others[j][0], t, f), s) for f, s in zip(firsts.tolist(), seconds))
            yield from out

    return _hashed(df, emit, "array<int>")


def _parts(a, b, k: int):
    """The k best for each query of b among the rows of a whose second axis it probes."""
    a = a.sort_values("sub", kind="stable")
    ids, x, subs = a.id.to_numpy(), np.array(a.v.tolist()), a["sub"].to_numpy()
    qids, q = b.id.to_numpy(), np.array(b.v.tolist())
    if b["sub"].isna().all():
        return best(ids, x, qids, q, k)
    probes = np.concatenate(b["sub"].to_numpy())
    asks = np.repeat(np.arange(len(b)), b["sub"].map(len))
    lo, hi = np.searchsorted(subs, probes), np.searchsorted(subs, probes, side="right")
    n = hi - lo
    met = np.bincount(asks, n, len(b)).astype(np.int64)  # rows that each query reads
    chunk = np.cumsum(met) // max(1, PAIRS // x.shape[1])
    repeated = len(np.unique(ids)) < len(ids)
    out: tuple[list, list, list] = ([], [], [])
    for c in np.unique(chunk):
        at = np.flatnonzero(chunk[asks] == c)
        rows = np.repeat(hi[at] - np.cumsum(n[at]), n[at]) + np.arange(n[at].sum())
        for held, more in zip(out, nearest_of_pairs(ids[rows], x[rows], qids, q, np.repeat(asks[at], n[at]), k, repeated)):
            held.extend(more.tolist())
    return out


def nearest_of_pairs(ids: np.ndarray, x: np.ndarray, qids: np.ndarray, q: np.ndarray, asks: np.ndarray, k: int, repeated: bool):
    """The k rows nearest to each query among pairs of a row (ids, x) and the place of its query (asks).
    repeated: several rows have one id, of which the nearest counts."""
    d = np.sqrt(((x - q[asks]) ** 2).sum(axis=1))
    at = np.flatnonzero(np.isfinite(d) & (ids != qids[asks]))
    at = at[np.lexsort((ids[at], d[at], asks[at]))]
    if repeated:
        _, first = np.unique(np.stack((asks[at], ids[at])), axis=1, return_index=True)
        at = at[np.sort(first)]
    _, start, n = np.unique(asks[at], return_index=True, return_counts=True)
    at = at[np.arange(len(at)) - np.repeat(start, n) < k]
    return qids[asks[at]], ids[at], d[at]


def best(ids: np.ndarray, x: np.ndarray, qids: np.ndarray, q: np.ndarray, k: int) -> tuple[list, list, list]:
    """The k rows nearest to each query: query ids, row ids, distances."""
    near = (x * x).sum(axis=1)[None, :] - 2 * (q @ x.T)
    near[qids[:, None] == ids[None, :]] = np.inf
    out: tuple[list, list, list] = ([], [], [])
    kth = np.partition(near, min(k, len(ids)) - 1, axis=1)[:, min(k, len(ids)) - 1]
    scale = 1e-9 * (1 + np.abs(near[np.isfinite(near)]).max(initial=0.0))
    for i in range(len(qids)):
        at = np.flatnonzero((near[i] <= kth[i] + scale) & np.isfinite(near[i]))  # with all ties
        d = np.sqrt(((x[at] - q[i]) ** 2).sum(axis=1))
        o = np.lexsort((ids[at], d))
        _, first = np.unique(ids[at][o], return_index=True)
        o = o[np.sort(first)][:k]
        out[0].extend([int(qids[i])] * len(o))
        out[1].extend(ids[at][o].tolist())
        out[2].extend(d[o].tolist())
    return out


FOUND = "query_id long, vec_id long, score double"


def _reranked(rows: DataFrame, queries: DataFrame, row_counts: DataFrame, query_counts: DataFrame, k: int) -> DataFrame:
    """The k best for each query and block of rows. counts: one row for each key, bounded by the
    number of bands, tables and axes."""
    counts = row_counts.join(query_counts, "key").select("key", F.ceil(F.col("n") / ROWS).cast("int").alias("rb"), F.ceil(F.col("m") / QUERIES).cast("int").alias("qb"))
    counts = F.broadcast(counts)
    x = rows.join(counts, "key").withColumn("r", F.pmod(F.xxhash64("id"), "rb")).withColumn("s", F.explode(F.sequence(F.lit(0), F.col("qb") - 1)))
    q = queries.join(counts, "key").withColumn("s", F.pmod(F.xxhash64("id"), "qb")).withColumn("r", F.explode(F.sequence(F.lit(0), F.col("rb") - 1)))
    on = ["key", F.col("r").cast("long").alias("r"), F.col("s").cast("long").alias("s")]

    def compare(a, b):
        import pandas as pd

        if not len(a) or not len(b):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64"})
        got = _parts(a, b, k)
        return pd.DataFrame({"query_id": got[0], "vec_id": got[1], "score": got[2]})

    def fewer(frames):
        """Of what this task has found for a query, the k best."""
        import pandas as pd

        held, n = [], 0

        def top():
            one = pd.concat(held).drop_duplicates(["query_id", "vec_id"]).sort_values(["query_id", "score", "vec_id"])
            return one[one.groupby("query_id").cumcount() < k]

        for f in frames:
            held.append(f)
            n += len(f)
            if n > 400_000:
                held = [top()]
                n = len(held[0])
                if n > 200_000:
                    yield held.pop()
                    n = 0
        if held:
            yield top()

    found = x.select(*on, "id", "v", "sub").groupBy("key", "r", "s").cogroup(q.select(*on, "id", "v", "sub").groupBy("key", "r", "s")).applyInPandas(compare, FOUND)
    return found.mapInPandas(fewer, FOUND)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.dropDuplicates(["query_id", "vec_id"]).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def search(vectors: DataFrame, queries: DataFrame, k: int = K, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k nearest found."""
    x = staged(valid(vectors, vec_id, embedding), "vectors")
    q = staged(valid(queries, vec_id, embedding).groupBy("id").agg(F.min(F.struct("v", "d", "band")).alias("q")).select("id", "q.*"), "queries")
    bands: dict[int, dict[int, tuple[int, int]]] = {}
    for place, r in enumerate(x.groupBy("d", "band").count().orderBy("d", "band").collect()):  # a row for each dimension and band
        bands.setdefault(r["d"], {})[r["band"]] = (place, r["count"])
    hx, hq = staged(_hashed_rows(x, bands), "hashed"), staged(_hashed_queries(q, bands), "probes")
    count = lambda h, name: h.groupBy("key").agg(F.count("*").alias(name))
    found = staged(_ranked(_reranked(hx, hq, count(hx, "n"), count(hq, "m"), k), k).drop("rank"), "found")
    sizes = x.groupBy("d").agg(F.countDistinct("id").alias("n"))
    short = q.join(F.broadcast(sizes), "d").join(found.groupBy("query_id").agg(F.count("*").alias("got")), F.col("id") == F.col("query_id"), "left")
    short = staged(short.where(F.coalesce("got", F.lit(0)) < F.least(F.lit(k), F.col("n") - 1)).select("id", "v", F.col("d").cast("long").alias("key"), F.lit(None).cast("array<int>").alias("sub")), "short")
    if not short.isEmpty():
        every = x.select("id", "v", F.col("d").cast("long").alias("key"), F.lit(0).alias("sub"))
        found = found.unionByName(_reranked(every, short, count(every, "n"), count(short, "m"), k))
    return _ranked(found, k).select("query_id", "rank", "vec_id", "score")
