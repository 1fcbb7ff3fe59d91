"""Near-duplicate groups by fast similarity sketching, banding and exact verification.

Sketch: in round r every shingle is thrown into one of T bins with a value; a bin keeps the least
value of the first round that reaches it. From round T on, round T + i throws everything into bin
i, so every coordinate is filled after 2T rounds; texts with many shingles fill all bins in the
first round, at one hash per shingle. Equal coordinates estimate the Jaccard similarity with
concentration like T independent permutations.

Texts with equal shingle sets are one representative (the smallest doc_id). The sketch is cut into
BANDS bands of ROWS coordinates; at similarity 0.75 a pair shares no band with probability
(1 - 0.75^4)^32 < 1e-5. Candidate pairs are verified on the full shingle sets:
  1. every representative with the smallest doc_id it shares a band with,
  2. every representative with the smallest doc_id of each further band it is in,
  3. in bands that still hold more than one component, pairs from different components: what lies
     outside the band's largest component meets all of the band in blocks, which compare sketches,
     verify what is not far below the bound, and emit links alone.
Between the steps linked representatives are contracted, so no step emits all pairs of a group,
and pairs whose link cannot change a component are not verified again. Joins on a band, a set or a
representative that many rows share are salted (common.join_hot).

The sketch decides who meets: of pairs at the bound, 1e-5 share no band, and 2e-6 are estimated under
NEAR and would be lost in the third step, where no chain of other links joins them; closer pairs are
lost far less often still. Every link that is reported is exact.

Null or wordless texts have an empty set and no links. Rows that repeat a doc_id are one vertex; a
null doc_id is linked with nothing (component null, kept). Columns of other names are neither read
nor lost. An empty table gives an empty result. A very long text enters with its whole shingle set, held
by one task. doc_id is an integer, or a string that Spark casts to one: other strings raise
CAST_INVALID_INPUT, as component ids are the smallest of them.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PLACES, WordHashes, hashes, in_batches, join_hot, mix, shingle_set, staged, texts_of

K = 5
T, BANDS, ROWS = 128, 32, 4
#: Similarity as a fraction: linked if DEN * common >= NUM * union.
NUM, DEN = 75, 100
#: Pairs of the third step are verified if their sketches estimate at least this (4.6 deviations below the bound).
NEAR = 0.57
#: Rows of a band that are compared in one task.
BLOCK = 600
EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
CHUNK = 1 << 20


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """Sketches of non-empty sets of 64-bit hashes, one row each."""
    d = len(sets)
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(d, dtype=np.int64), [len(s) for s in sets]) * T
    out = np.full(d * T, EMPTY)
    for r in range(2 * T):
        h = mix(flat + np.uint64((r + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        bins = owner + ((h >> np.uint64(57)).astype(np.int64) if r < T else r - T)
        np.minimum.at(out, bins, np.uint64(r << 48) | (h & np.uint64((1 << 48) - 1)))
        full = (out.reshape(d, T) != EMPTY).all(axis=1)
        if full.all():
            break
        left = ~full[owner // T]
        flat, owner = flat[left], owner[left]
    return out.reshape(d, T)


def bands(sketch: np.ndarray) -> np.ndarray:
    """One signed 64-bit key for each band of each sketch."""
    parts = sketch.reshape(-1, BANDS, ROWS)
    h = np.broadcast_to(PLACES[:BANDS] * np.uint64(31), parts.shape[:2]).copy()
    for k in range(ROWS):
        h = mix(h ^ parts[:, :, k] * PLACES[k])
    return h.view(np.int64)


def text_set(raw: bytes, cache: WordHashes) -> np.ndarray:
    return shingle_set(hashes(raw.lower().split(), cache), K)


def signatures(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, sig (128-bit hash of the set), bands (band keys), short (16 bits of each coordinate), th (xxhash64 of the text)."""

    def run(batches):
        import pyarrow as pa

        cache = WordHashes()

        def out(ids, sets, ths):
            full = [k for k, s in enumerate(sets) if len(s)]
            keys: list = [None] * len(sets)
            short: list = [None] * len(sets)
            if full:
                sk = sketches([sets[k] for k in full])
                low = sk.astype(np.uint16)
                for k, row, low_row in zip(full, bands(sk).tolist(), low):
                    keys[k], short[k] = row, low_row.tobytes()
            sig = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            return pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, pa.int64()), "n_shingles": pa.array([len(s) for s in sets], pa.int64()), "sig": pa.array(sig, pa.binary()), "bands": pa.array(keys, pa.list_(pa.int64())), "short": pa.array(short, pa.binary()), "th": pa.array(np.array(ths, np.uint64).view(np.int64))})

        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                ids, sets, ths, size = [], [], [], 0
                for d, raw in zip(part.column(0).to_pylist(), texts_of(part.column(1))):
                    s = text_set(raw, cache)
                    ids.append(d)
                    sets.append(s)
                    ths.append(xxhash.xxh64_intdigest(raw, 42))
                    size += len(s)
                    if size > CHUNK:
                        yield out(ids, sets, ths)
                        ids, sets, ths, size = [], [], [], 0
                if ids:
                    yield out(ids, sets, ths)

    source = df.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("t"))
    return in_batches(source, run, "doc_id long, n_shingles long, sig binary, bands array<long>, short binary, th long")


def verified(pairs: DataFrame, texts: DataFrame, counts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are similar enough. counts: a, n (pairs with it, at most)."""

    def run(batches):
        import pyarrow as pa

        cache = WordHashes()
        last: bytes | None = None
        held = np.zeros(0, np.uint64)
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                left, right = texts_of(part.column(2)), texts_of(part.column(3))
                ok = []
                for x, y in zip(left, right):
                    if x != last:
                        last, held = x, text_set(x, cache)
                    other = text_set(y, cache)
                    common = len(np.intersect1d(held, other, assume_unique=True))
                    ok.append(common > 0 and DEN * common >= NUM * (len(held) + len(other) - common))
                mask = pa.array(ok, pa.bool_())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], names=["a", "b"]).filter(mask)

    x = texts.select(F.col("id").alias("a"), F.col("t").alias("ta"))
    y = texts.select(F.col("id").alias("b"), F.col("t").alias("tb"))
    return in_batches(join_hot(pairs.join(y, "b"), x, "a", counts).select("a", "b", "ta", "tb"), run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """id, component (smallest id reachable) of every id in links (a, b), by contraction.

    A round hangs every vertex that has a smaller neighbour under the smallest, follows the pointers to their roots
    and replaces the ends of each link by their roots; links within a root go. Roots are vertices below all
    their neighbours, and those that share a neighbour meet in the next round, so rounds are few. Rows are two numbers: a key that many share is split by Spark's
    own skew join where it is large.
    """
    edges = staged(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "links")
    label: DataFrame | None = None
    while not edges.isEmpty():
        up = edges.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("to"))
        while True:  # every pointer goes to a smaller id; double the steps until all reach roots
            up = staged(up, "pointers")
            far = up.join(up.select(F.col("id").alias("to"), F.col("to").alias("root")), "to", "left")
            if far.where("root is not null").isEmpty():
                break
            up = far.select("id", F.coalesce("root", "to").alias("to"))
        new = up.select("id", F.col("to").alias("component"))
        # a vertex below all its neighbours is a root, also where each of them hangs under a smaller one
        roots = edges.select(F.col("a").alias("id")).distinct().join(up.select("id"), "id", "left_anti").select("id", F.col("id").alias("component"))
        new = new.unionByName(roots)
        if label is None:
            label = staged(new, "components")
        else:  # what hung under an earlier root moves with it
            label = staged(label.join(new.select(F.col("id").alias("component"), F.col("component").alias("c")), "component", "left").select("id", F.coalesce("c", "component").alias("component")), "components")
        one = edges.join(new.select(F.col("id").alias("a"), F.col("component").alias("ca")), "a").join(new.select(F.col("id").alias("b"), F.col("component").alias("cb")), "b")
        edges = staged(one.where("ca <> cb").select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).distinct(), "links")
    spark = links.sparkSession
    return label if label is not None else spark.createDataFrame([], "id long, component long")


def _across(pairs: DataFrame, label: DataFrame, counts: DataFrame) -> DataFrame:
    """Pairs whose ends are not in one component yet."""
    ca = label.select(F.col("id").alias("a"), F.col("component").alias("ca"))
    cb = label.select(F.col("id").alias("b"), F.col("component").alias("cb"))
    out = join_hot(pairs, ca, "a", counts, "left").join(cb, "b", "left")
    return out.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")


def _linked(pdf):
    """Links between a block of a band's rows outside its largest component (asks) and a block of all
    its rows: pairs of different components whose sketches agree enough are verified on their full
    sets, unless links found here already join them. A pair that shares several bands is looked at in
    the first of them only, two rows that ask by the smaller one."""
    import pandas as pd

    sk = np.frombuffer(b"".join(pdf.short), np.uint16).reshape(-1, T)
    keys = np.array(pdf.bands.tolist(), np.int64)
    place = int((keys[0] == pdf.band.iloc[0]).argmax())
    ids, texts, cache = pdf.id.to_numpy(), pdf.t.tolist(), WordHashes()
    asks, minor = pdf.asks.to_numpy(), (pdf.component != pdf.main).to_numpy()
    rows, cols = np.flatnonzero(asks), np.flatnonzero(~asks)
    comp = {c: c for c in pdf.component.tolist()}
    own = pdf.component.to_numpy()
    sets: dict[int, np.ndarray] = {}

    def root(c):
        while comp[c] != c:
            comp[c] = c = comp[comp[c]]
        return c

    def full(i):
        if i not in sets:
            sets[i] = text_set(texts[i].encode(), cache)
        return sets[i]

    a, b = [], []
    for i in rows:
        at = cols[(own[cols] != own[i]) & (~minor[cols] | (ids[cols] > ids[i]))]
        at = at[(keys[at] == keys[i]).argmax(axis=1) == place] if len(at) else at
        at = at[(sk[at] == sk[i]).sum(axis=1) >= NEAR * T] if len(at) else at
        for j in at.tolist():
            x, y = root(own[i]), root(own[j])
            if x == y:
                continue
            common = len(np.intersect1d(full(i), full(j), assume_unique=True))
            if common and DEN * common >= NUM * (len(full(i)) + len(full(j)) - common):
                comp[x] = y
                a.append(int(min(ids[i], ids[j])))
                b.append(int(max(ids[i], ids[j])))
    return pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})


def near_groups(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row for each row of df."""
    spark = df.sparkSession
    rows = staged(signatures(df, doc_id, text), "signatures")
    # texts with one set: their smallest doc_id stands for them
    known = rows.where("doc_id is not null and sig is not null")
    same = staged(known.groupBy("sig").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("top"), F.count("*").alias("n")), "sets")
    twins = join_hot(known.select("sig", "doc_id"), same.where("rep <> top").drop("n"), "sig", same).where("doc_id <> rep").select("sig", F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    twins = staged(twins.distinct(), "twins")
    reps = known.join(twins.select("sig", F.col("b").alias("doc_id")), ["sig", "doc_id"], "left_anti")
    keyed = reps.select(F.col("doc_id").alias("id"), F.explode("bands").alias("band"))
    shared = staged(keyed.groupBy("band").agg(F.min("id").alias("a"), F.max("id").alias("top"), F.count("*").alias("n")).where("a <> top").select("band", "a", "n"), "bands")
    stars = join_hot(keyed, shared.drop("n"), "band", shared).where("id <> a").select("band", "a", F.col("id").alias("b"))
    stars = staged(stars, "stars")
    counts = staged(stars.groupBy("a").agg(F.count("*").alias("n")), "counts")
    ends = stars.select(F.col("a").alias("id")).union(stars.select(F.col("b").alias("id"))).distinct()
    source = df.select(F.col(f"`{doc_id}`").cast("long").alias("id"), F.col(f"`{text}`").cast("string").alias("t"))
    texts = staged(source.join(ends, "id", "left_semi"), "texts")
    # 1: one pair each
    links = staged(verified(stars.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), texts, counts), "linked")
    label = components(links)
    # 2: the other bands, across components
    more = _across(stars.select("a", "b").distinct(), label, counts)
    links = links.union(staged(verified(staged(more, "pairs"), texts, counts), "linked"))
    label = components(links)
    # 3: bands with more than one component
    named = stars.select("band", F.explode(F.array("a", "b")).alias("id")).distinct().join(label, "id", "left").select("band", "id", F.coalesce("component", "id").alias("component"))
    mixed = staged(named, "members")
    sizes = mixed.groupBy("band", "component").agg(F.count("*").alias("m")).groupBy("band").agg(F.max(F.struct("m", "component")).alias("main"), F.sum("m").alias("n"), F.count("*").alias("parts"))
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    sizes = sizes.where("parts > 1 and n > 2").select("band", "n", F.col("main.component").alias("main"), blocks(F.col("n")).alias("rb"), blocks(F.col("n") - F.col("main.m")).alias("qb"))
    sizes = staged(sizes, "open")
    dealt = join_hot(mixed, sizes.drop("n"), "band", sizes)
    block = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    over = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asking = dealt.where("component <> main").withColumns({"asks": F.lit(True), "q": block("qb")}).withColumn("r", over("rb"))
    asked = dealt.withColumns({"asks": F.lit(False), "r": block("rb")}).withColumn("q", over("qb"))
    dealt = asking.unionByName(asked).select("band", "id", "component", "main", "asks", "q", "r")
    # an id may stand for several texts: each goes with its own sketch, into its own bands
    sketch = reps.select(F.col("doc_id").alias("id"), "th", "short", "bands").dropDuplicates(["id", "th"])
    known_texts = texts.withColumn("th", F.xxhash64("t")).dropDuplicates(["id", "th"])
    dealt = dealt.join(sketch.join(known_texts, ["id", "th"]), "id").where(F.array_contains("bands", F.col("band"))).drop("th")
    links = links.union(staged(dealt.groupBy("band", "q", "r").applyInPandas(_linked, "a long, b long"), "linked"))
    label = components(links.union(twins.select("a", "b")))
    out = rows.select("doc_id", "n_shingles").join(label.select(F.col("id").alias("doc_id"), "component"), "doc_id", "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def keep_one(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of df that stand for their group, with df's columns."""
    out = near_groups(df, doc_id, text)
    gone = out.where(~F.col("kept")).select(F.col("doc_id").alias("__gone")).distinct()
    return df.join(gone, F.col(f"`{doc_id}`").cast("long") == F.col("__gone"), "left_anti")
