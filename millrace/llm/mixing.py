"""Mixing sources to target weights by weighted fair queueing.

Every document joins its source's queue in a shuffled order (a hash of its id and text). Its virtual
finish time is the words its source has sent by then, divided by the source's weight; a source may
go through its queue up to COPIES times. All copies are range-sorted by finish time, and the order is
truncated where its running total of words reaches the budget, the words of all documents.

Documents are whole, so the truncated order leaves each source a part of a copy off its target. It is
settled source by source: copies that end above the target (`targets`) are given back, and what is
then missing is filled from the copies behind, in order, with those of at most half of what is
missing. Each round fills more than half of it or ends the queue, so there are at most as many rounds
as bits in a target, mostly a few. In the end a source lacks less than two of the smallest copy left
behind its last round, however long its giants.

Running sums go in two levels: the order's parts, and a source's hash space cut into buckets in
proportion to its rows, are summed and chained, and only within one of them are rows summed in order.
Rows alike in doc_id and text are one weighted entry. What is taken of a source is a copy number and a
hash, and the few copies that filled it, so `take` decides on each row where it lies; the fillers of a
source together have at most as many words as one copy, and Spark broadcasts them below its threshold.

Null text has no words. Documents without words take nothing. Null is a source of its own, last.
Rows that repeat a doc_id are documents of their own; rows alike in doc_id and text are taken alike.
A text of any length is one document; it is read once for its size and hash. Columns of the table that
bear the names used here are neither read nor lost. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, staged, word_count

#: Weights by rank of the source, repeating.
WEIGHTS = (5, 2, 1)
#: Times a source's documents may be taken.
COPIES = 3
#: Rows of a bucket at most, and buckets of a small table.
BUCKET_ROWS, BUCKETS = 20_000, 1024
#: Copies in a part of the sorted order.
PART_ROWS = 200_000


def targets(sources: DataFrame) -> DataFrame:
    """source, source_size, weight, target: shares of the total by weight, at most COPIES times a
    source's size; what is above is shared again by weight until none is above. sources: one row each.

    The excess rounds end at a water level: sources in order of size / weight are full up to one
    of them, and the rest share what is left by weight. Sums run over that order.
    """
    order = Window.orderBy(F.col("code").isNull(), F.col("code"))
    w = sources.withColumn("code", F.encode("source", "UTF-8")).withColumn("rank", F.row_number().over(order) - 1)
    w = w.withColumn("weight", F.element_at(F.array(*[F.lit(float(x)) for x in WEIGHTS]), (F.col("rank") % len(WEIGHTS) + 1).cast("int")))
    w = w.withColumn("ratio", F.col("source_size") / F.col("weight"))
    fill = Window.orderBy("ratio", "rank")
    upto = fill.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    w = w.withColumns({"full": F.coalesce(F.sum("source_size").over(upto), F.lit(0)) * COPIES, "lighter": F.coalesce(F.sum("weight").over(upto), F.lit(0.0))})
    w = w.withColumns({"total": F.sum("source_size").over(everything), "heavy": F.sum("weight").over(everything)})
    # were this source and all after it not full, they would share what is left at this level
    w = w.withColumn("level", (F.col("total") - F.col("full")) / (F.col("heavy") - F.col("lighter")))
    w = w.withColumn("open", F.col("level") <= COPIES * F.col("ratio"))
    w = w.withColumn("level", F.max(F.when(F.col("open"), F.col("level"))).over(everything))
    return w.withColumn("target", F.least(COPIES * F.col("source_size").cast("double"), F.col("level") * F.col("weight"))).select("source", "source_size", "weight", "target", "rank")


def _place(doc_id: str, text: str):
    """A row's place in the shuffled order of its source: 63 bits."""
    return F.xxhash64(F.lit("mix"), F.col(f"`{doc_id}`"), F.col(f"`{text}`")).bitwiseAND(F.lit((1 << 63) - 1))


def _with_sources(rows: DataFrame, per_source: DataFrame, source) -> DataFrame:
    """rows with their source's columns. per_source has a row for each source: broadcast where they are few."""
    on = source.eqNullSafe(F.col("s_source"))
    return rows.join(F.broadcast(per_source) if per_source.count() <= 100_000 else per_source, on).drop("s_source")


def _queue(df: DataFrame, doc_id: str, source: str, text: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The rows of df without their texts (doc_id, source, size, h); the queue, an entry for all rows
    alike: doc_id, size, n (their words), rows, h, bucket, pos (words its source has sent with it, in the
    first round), block (words at its place) and its source's columns; and the sources."""
    rows = df.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{source}`").cast("string").alias("source"), word_count(text).alias("size"), _place(doc_id, text).alias("h"))
    rows = staged(rows, "sizes")
    totals = staged(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows")), "totals")
    everything = totals.agg(F.sum("rows")).first()[0] or 0
    in_bucket = min(BUCKET_ROWS, max(1, everything // BUCKETS))
    sources = targets(totals.select("source", "source_size")).join(totals.select(F.col("source").alias("t_source"), "rows"), F.col("source").eqNullSafe(F.col("t_source")))
    sources = staged(sources.select(F.col("source").alias("s_source"), "source_size", "weight", "target", "rank", "rows", F.ceil(F.col("rows") / in_bucket).alias("buckets")), "sources")
    alike = rows.where("size > 0").groupBy("source", "doc_id", "h", "size").agg(F.count("*").alias("rows")).withColumn("n", F.col("rows") * F.col("size"))
    alike = _with_sources(alike, sources.drop("rows"), F.col("source")).withColumn("bucket", F.floor(F.col("h") / float(1 << 63) * F.col("buckets")))
    sums = alike.groupBy("rank", "bucket").agg(F.sum("n").alias("m"))
    sums = sums.select("rank", "bucket", (F.sum("m").over(Window.partitionBy("rank").orderBy("bucket")) - F.col("m")).alias("before"))
    here = Window.partitionBy("rank", "bucket").orderBy("h")  # entries of one hash have one place
    alike = alike.withColumns({"sent": F.sum("n").over(here), "block": F.sum("n").over(Window.partitionBy("rank", "bucket", "h"))}).join(sums, ["rank", "bucket"])
    alike = alike.select("doc_id", "source", "rows", "n", "h", "bucket", (F.col("before") + F.col("sent")).cast("double").alias("pos"), "block", "rank", "source_size", "weight", "target")
    return rows, staged(alike, "queue"), sources


def _ordered(queue: DataFrame, sources: DataFrame) -> DataFrame:
    """All copies (k from 0) range-sorted by finish time; at: words their source has sent with them;
    part: their part of the order."""
    parts = 1 + COPIES * (sources.agg(F.sum("rows")).first()[0] or 0) // PART_ROWS
    copies = queue.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(COPIES - 1)))).withColumn("at", F.col("pos") + F.col("k") * F.col("source_size"))
    copies = copies.select("doc_id", "source", "rows", "rank", "k", "bucket", "h", "n", "block", "at", "target", (F.col("at") / F.col("weight")).alias("finish"))
    order = ["finish", "rank", "h"]
    return staged(copies.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()), "order")


def _within_budget(ordered: DataFrame) -> DataFrame:
    """The order truncated where its running total of words would exceed the words of all documents."""
    clock = F.struct("finish", "rank")
    parts = ordered.groupBy("part").agg(F.sum("n").alias("m"), F.sum(F.when(F.col("k") == 0, F.col("n"))).alias("own"))
    everywhere = Window.partitionBy(F.lit(0))  # a row for each part
    parts = parts.withColumns({"upto": F.sum("m").over(everywhere.orderBy("part")), "budget": F.sum("own").over(everywhere)})
    last = parts.where("upto >= budget").orderBy("part").first()
    if last is None:  # no words at all
        return ordered
    before = last.upto - last.m
    running = F.lit(before) + F.sum("n").over(Window.partitionBy("part").orderBy("finish", "rank"))
    end = ordered.where(F.col("part") == last.part).withColumn("running", running).where(F.col("running") <= last.budget).agg(F.max(clock).alias("e")).first().e
    inside = F.lit(False) if end is None else (F.col("part") == last.part) & (clock <= F.struct(F.lit(end.finish).alias("finish"), F.lit(end.rank).alias("rank")))
    return ordered.where((F.col("part") < last.part) | inside)


def _behind(k: str, h: str):
    return F.expr(f"k > {k} or k = {k} and h > {h}")


def _cuts(queue: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The sorted order; for each source the last copy before what filled it (cut_k from 0, cut_h); and
    the copies that filled it: f_rank, f_k, f_h."""
    ordered = _ordered(queue, sources)
    sent = _within_budget(ordered).where("at <= target").groupBy("rank").agg(F.max(F.struct("k", "h")).alias("last"), F.sum("n").alias("sent"))
    state = sources.select("s_source", "rank", "target").join(sent, "rank", "left").select(
        "s_source", "rank", F.coalesce("last.k", F.lit(-1)).alias("cut_k"), F.coalesce("last.h", F.lit(-1).cast("long")).alias("cut_h"), (F.col("target") - F.coalesce("sent", F.lit(0))).alias("left")
    )
    cuts = staged(state, "cuts")
    filled = ordered.limit(0)
    state = cuts.select("rank", F.col("cut_k").alias("from_k"), F.col("cut_h").alias("from_h"), "left")
    while state.where("left >= 2").count():
        rows = ordered.select("rank", "k", "bucket", "h", "n", "block").join(state, "rank").where(_behind("from_k", "from_h") & (F.col("block") <= F.col("left") / 2))
        sums = rows.groupBy("rank", "k", "bucket", "left").agg(F.sum("n").alias("m"))
        sums = sums.withColumn("before", F.sum("m").over(Window.partitionBy("rank").orderBy("k", "bucket")) - F.col("m")).where("before < left")
        rows = rows.join(sums.select("rank", "k", "bucket", "before"), ["rank", "k", "bucket"])
        rows = rows.withColumn("upto", F.col("before") + F.sum("n").over(Window.partitionBy("rank", "k", "bucket").orderBy("h")))
        rows = staged(rows.select("rank", "k", "h", "n", "left", (F.col("upto") <= F.col("left")).alias("fits")), "filled")
        filled = filled.select("rank", "k", "h").unionByName(rows.where("fits").select("rank", "k", "h"))
        over = rows.groupBy("rank", "left").agg(F.min(F.when(~F.col("fits"), F.struct("k", "h"))).alias("o"), F.sum(F.when(F.col("fits"), F.col("n"))).alias("m"))
        # without a copy that was too long, all that could fill the source is taken
        state = staged(over.where("o is not null").select("rank", F.col("o.k").alias("from_k"), F.col("o.h").alias("from_h"), (F.col("left") - F.coalesce("m", F.lit(0))).alias("left")), "state")
    filled = staged(filled.select(F.col("rank").alias("f_rank"), F.col("k").alias("f_k"), F.col("h").alias("f_h")).distinct(), "fillers")
    return ordered, cuts.drop("left"), filled


def _with_times(rows: DataFrame, cuts: DataFrame, filled: DataFrame) -> DataFrame:
    """rows (source and h) with their times: how often each is taken."""
    rows = _with_sources(rows, cuts, F.col("source"))
    more = filled.groupBy("f_rank", "f_h").agg(F.count("*").alias("more"))
    rows = rows.join(more, (F.col("rank") == F.col("f_rank")) & (F.col("h") == F.col("f_h")), "left")
    times = F.expr("if(cut_k < 0, 0, cut_k + if(h <= cut_h, 1, 0)) + coalesce(more, 0)")
    return rows.withColumn("times", times).drop("rank", "cut_k", "cut_h", "f_rank", "f_h", "more")


def mix(df: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """doc_id, source, size, source_size, target, taken: one row for each row of df."""
    rows, queue, sources = _queue(df, doc_id, source, text)
    _, cuts, filled = _cuts(queue, sources)
    own = staged(sources.select("s_source", "source_size", "target").join(cuts.withColumnRenamed("s_source", "c_source"), F.col("s_source").eqNullSafe(F.col("c_source"))).drop("c_source"), "decisions")
    return _with_times(rows, own, filled).select("doc_id", "source", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"))


def take(df: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """df's rows as the mix takes them, each as many times as it is taken, with df's columns."""
    _, queue, sources = _queue(df, doc_id, source, text)
    _, cuts, filled = _cuts(queue, sources)
    inner = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(df.columns)]
    rows = df.select(*inner, F.col(f"`{source}`").cast("string").alias("source"), _place(doc_id, text).alias("h")).where(F.col(f"c{df.columns.index(text)}").rlike(WORD))
    rows = _with_times(rows, cuts, filled).where("times > 0")
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
    return rows.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(df.columns)])


def schedule(df: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """doc_id, source, copy, rows (of df alike), finish of all copies taken, range-sorted by finish time:
    the order in which the mix sends them. Copies passed over leave no gap: those behind them keep
    their times."""
    _, queue, sources = _queue(df, doc_id, source, text)
    ordered, cuts, filled = _cuts(queue, sources)
    first = ordered.join(cuts.drop("s_source"), "rank").where(~_behind("cut_k", "cut_h"))
    more = ordered.join(filled, (F.col("rank") == F.col("f_rank")) & (F.col("k") == F.col("f_k")) & (F.col("h") == F.col("f_h")))
    wanted = ["doc_id", "source", F.col("k").alias("copy"), "rows", "finish"]
    return first.select(*wanted).unionByName(more.select(*wanted)).repartitionByRange("finish", "source", "doc_id").sortWithinPartitions("finish", "source", "doc_id")
