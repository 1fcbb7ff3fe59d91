"""Passages that repeat across documents: a sparse suffix array over minimiser positions.

Words are compared by 64-bit hashes, A-Z lower-cased. Every window of MIN words has an anchor among its
first WINDOW words, the start of the K-word run with the least hash: the same one in every copy, with at
least CORE words of the window after it. Only suffixes at anchors are looked at first: they are sorted
by their CORE first words, and those whose neighbours do not share them are in no repeated window.

Comparing a suffix with its two neighbours and extending the match to the left is not enough where
many documents share a core: a longer match on the right may stand next to it while the repeated
passage reaches to the left, and the better neighbour is then not the one that repeats. So of the
suffixes that are left, those at the starts of the windows around their anchors (at most WINDOW - 1
words to the left) are sorted in turn by their MIN first words, and neighbours that agree in all of
them are repeats: every window of MIN words that two documents hold is found, whatever else shares parts of
it. Overlapping windows of a document are then joined, which extends a passage as far as it repeats.

The first words are compared as one hash, so that suffixes with equal ones lie side by side. Each sort
is a range partition by hash and document, so a passage that a third of all documents hold is spread
over many tasks and costs one row per copy. Texts that are equal as a whole go through one
representative; their other copies repeat from end to end.

Null or short texts have no passages. Repeats within one document alone are not reported: the operator
looks for what documents share. Rows with a null doc_id are left out; rows that repeat a doc_id are one
document to this operator. Documents without a repeated passage have no row; columns of other names are
neither read nor lost; an empty table gives an empty result. A very long text is read whole, by one
task, as hashes of its words. doc_id is an integer, or a string that Spark casts to one: other
strings raise CAST_INVALID_INPUT.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, grams, hashes, in_batches, join_hot, staged, texts_of

#: Least words of a passage; window of the minimisers and words of their runs.
MIN, WINDOW, K = 50, 32, 5
CORE = MIN - WINDOW + 1


def _words(raw: bytes, cache: WordHashes) -> np.ndarray:
    return hashes(raw.lower().split(), cache)


def anchors(h: np.ndarray) -> np.ndarray:
    """The anchor's place of each window of MIN words of a text of word hashes."""
    n = len(h) - MIN + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    return np.lib.stride_tricks.sliding_window_view(grams(h, K), WINDOW).argmin(axis=1)[:n] + np.arange(n)


def cores(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """d, n_words, whole (hash of all words), at, h (arrays: anchors and their cores): one row per text of MIN words or more."""

    def run(batches):
        import pyarrow as pa

        cache = WordHashes()
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                rows = []
                for d, raw in zip(part.column(0).to_pylist(), texts_of(part.column(1))):
                    h = _words(raw, cache)
                    if d is not None and len(h) >= MIN:
                        at = np.unique(anchors(h))
                        rows.append((d, len(h), xxhash.xxh3_128_digest(h.tobytes()), at, grams(h, CORE)[at].view(np.int64)))
                cols = list(zip(*rows)) if rows else [()] * 5
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.binary()), pa.array(cols[3], pa.list_(pa.int32())), pa.array(cols[4], pa.list_(pa.int64()))],
                    names=["d", "n_words", "whole", "at", "h"],
                )

    source = df.select(F.col(f"`{doc_id}`").cast("long").alias("d"), F.col(f"`{text}`").cast("string").alias("t"))
    return in_batches(source, run, "d long, n_words long, whole binary, at array<int>, h array<long>")


def _windows(batches):
    """From d, anchors, text: d, at, h (arrays: starts and hashes of the windows of these anchors)."""
    import pyarrow as pa

    cache = WordHashes()
    for batch in batches:
        for lo in range(0, batch.num_rows, 200):
            part = batch.slice(lo, 200)
            ds, starts, found = [], [], []
            for d, held, raw in zip(part.column(0).to_pylist(), part.column(1), texts_of(part.column(2))):
                h = _words(raw, cache)
                if len(h) >= MIN:
                    at = np.flatnonzero(np.isin(anchors(h), held.values.to_numpy()))
                    ds.append(d)
                    starts.append(at)
                    found.append(grams(h, MIN)[at].view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(ds, pa.int64()), pa.array(starts, pa.list_(pa.int32())), pa.array(found, pa.list_(pa.int64()))], names=["d", "at", "h"])


#: Kinds of rows of _held: found; of a hash at a task's edge, so far in one document; first document of such a hash.
FOUND, EDGE, BOUND = 0, 1, 2


def _held(batches):
    """From h, d, at sorted by h and d: kind, h, d, at, other (another document that holds h)."""
    import pyarrow as pa

    def rows(kind, h, d, at, other):
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(h), kind, np.int32)), *(pa.array(x.astype(np.int64)) for x in (h, d)), pa.array(at.astype(np.int32)), pa.array(other.astype(np.int64))], names=["kind", "h", "d", "at", "other"])

    first, last = None, None
    held = [np.zeros(0, np.int64)] * 3  # of the last hash: its rows while in one document, then one of its first document
    shown = False  # the row held is shown already
    for batch in batches:
        h, d, at = (batch.column(k).to_numpy() for k in range(3))
        if not len(h):
            continue
        first = first or (h[0], d[0])
        new = np.concatenate((np.full(len(held[0]), not shown), np.ones(len(h), bool)))
        h, d, at = (np.concatenate(x) for x in zip(held, (h, d, at)))
        starts = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
        ends = np.concatenate((starts[1:], [len(h)]))
        low, high = d[starts], d[ends - 1]
        two = low != high
        of = np.repeat(np.arange(len(starts)), ends - starts)
        out = two[of] & new
        yield rows(FOUND, h[out], d[out], at[out], np.where(d == low[of], high[of], low[of])[out])
        if len(starts) > 1 and not two[0] and h[0] == first[0]:
            yield rows(EDGE, h[: ends[0]], d[: ends[0]], at[: ends[0]], d[: ends[0]])
        shown = bool(two[-1])
        keep = slice(starts[-1], starts[-1] + 1 if shown else None)
        held = [h[keep], d[keep], at[keep]]
        last = (h[-1], low[-1])
    if first is not None:
        if not shown:
            yield rows(EDGE, *held, held[1])
        h, d = (np.array(x) for x in zip(first, last))
        yield rows(BOUND, h, d, np.zeros(2), d)


def held_twice(rows: DataFrame, name: str) -> DataFrame:
    """d, at, other: those of the rows (h, d, at) whose h stands with another document too, and one such document."""
    # a hash's rows of one document stay in one task; a hash at the edge of a task may go on in the next
    ordered = rows.select("h", "d", "at").repartitionByRange("h", "d").sortWithinPartitions("h", "d")
    found = staged(ordered.mapInArrow(_held, "kind int, h long, d long, at int, other long"), name)
    bounds = found.where(F.col("kind") == BOUND).groupBy("h").agg(F.min("d").alias("low"), F.max("d").alias("high")).where("low <> high")  # two rows a task at most
    edge = found.where(F.col("kind") == EDGE).join(F.broadcast(bounds), "h").select("d", "at", F.when(F.col("d") == F.col("low"), F.col("high")).otherwise(F.col("low")).alias("other"))
    return found.where(F.col("kind") == FOUND).select("d", "at", "other").unionByName(edge)


def _joined(batches):
    """From d, starts (sorted) of windows, other: doc_id, start, end, other of their unions."""
    import pyarrow as pa

    for batch in batches:
        ds, start, end, other = [], [], [], []
        for d, starts, o in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
            at = starts.values.to_numpy().astype(np.int64)
            cut = np.flatnonzero(np.diff(at) > MIN)
            start += at[np.concatenate(([0], cut + 1))].tolist()
            end += (at[np.concatenate((cut, [len(at) - 1]))] + MIN).tolist()
            ds += [d] * (len(cut) + 1)
            other += [o] * (len(cut) + 1)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (ds, start, end, other)], names=["doc_id", "start", "end", "other"])


def passages(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, start, end (words), other: repeated passages, each with the smallest other document met."""
    rows = staged(cores(df, doc_id, text), "cores")
    same = staged(rows.groupBy("whole").agg(F.min("d").alias("rep"), F.max("d").alias("top"), F.count("*").alias("n")).where("rep <> top"), "same")
    copies = join_hot(rows.select("whole", "d", "n_words"), same.drop("n"), "whole", same)
    copies = staged(copies.select("whole", F.col("d").alias("doc_id"), F.lit(0).cast("long").alias("start"), F.col("n_words").alias("end"), F.when(F.col("d") == F.col("rep"), F.col("top")).otherwise(F.col("rep")).alias("other"), (F.col("d") == F.col("rep")).alias("first")), "copies")
    reps = rows.join(copies.where("not first").select("whole", F.col("doc_id").alias("d")), ["whole", "d"], "left_anti")
    each = lambda t: t.select("d", F.explode(F.arrays_zip("h", "at")).alias("s")).select("s.h", "d", "s.at")
    shared = held_twice(each(staged(reps.select("d", "at", "h"), "anchors")), "shared")
    shared = staged(shared.groupBy("d").agg(F.collect_set("at").alias("at")), "places")
    texts = df.select(F.col(f"`{doc_id}`").cast("long").alias("d"), F.col(f"`{text}`").cast("string").alias("t"))
    windows = staged(in_batches(shared.join(texts, "d").select("d", "at", "t"), _windows, "d long, at array<int>, h array<long>"), "windows")
    found = held_twice(each(windows), "held").groupBy("d").agg(F.array_sort(F.collect_set("at")).alias("at"), F.min("other").alias("other"))
    found = in_batches(found.select("d", "at", "other"), _joined, "doc_id long, start long, end long, other long")
    return found.unionByName(copies.drop("first", "whole"))


def repeated(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_spans, repeated_words, spans (start:end in words, comma-joined, merged), other_doc_id
    (the smallest document met that shares a passage): one row for each document with a passage."""
    found = passages(df, doc_id, text)
    spans = found.groupBy("doc_id").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("s"), F.min("other").alias("other_doc_id"))
    merge = """aggregate(s, cast(array() as array<struct<start:bigint,end:bigint>>), (a, x) ->
        if(size(a) > 0 and element_at(a, -1).end >= x.start,
           concat(slice(a, 1, size(a) - 1), array(named_struct('start', element_at(a, -1).start, 'end', greatest(element_at(a, -1).end, x.end)))),
           concat(a, array(x))))"""
    spans = spans.withColumn("s", F.expr(merge))
    return spans.select(
        "doc_id", F.size("s").cast("long").alias("n_spans"), F.expr("aggregate(s, 0L, (a, x) -> a + x.end - x.start)").alias("repeated_words"),
        F.expr("array_join(transform(s, x -> concat(x.start, ':', x.end)), ',')").alias("spans"), "other_doc_id",
    )
