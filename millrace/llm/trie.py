"""Prefix trie of conversations, built level by level.

A node is a distinct sequence of first turns (role and text); its id is its smallest conversation's. Per
depth, the live conversations, those that share their node with another, are grouped by their node and
next turn: each group is a child, with its smallest conv_id, its number of conversations and the code
points of its last text. A conversation alone in its node stops living: the rest of it is a chain of nodes of
one member each, which are written down without levels. Joins from the deepest shared level up to the root then
sum leaves and savings.

Turns meet by a digest of role and text (SHA-256), so texts are read once and never shuffled between levels. There are as many levels
as turns that two conversations share. A group may hold any share of all conversations: groups are
counted in partial sums, rows find their group by a salted join. Ends of a shared node are sorted
over all tasks and joined to pieces there; one row for each piece of PIECE ids then meets in the hash of its node,
which SHA-256 takes in order. Turns are numbered in two levels, so a conversation of any number
of turns is spread over tasks.

Turns are ordered by number (null first), then by role and text; rows alike are turns of their own. Null
role or text is empty. Rows without conv_id are no conversation's and are left out. Columns of other names are neither
read nor lost. An empty table gives an empty result. Texts of any length are digested whole.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.sources.staging import scratch

from .common import in_batches, join_hot, staged

#: Ids of a piece of a node's ends.
PIECE = 10_000
NO_ENDS = hashlib.sha256(b"").hexdigest()
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]


def numbered(turns: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), key and chars of every turn; staged."""
    rows = turns.where("conv_id is not null").select("conv_id", "turn", *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")])
    # role and text of turns of one number alone are shuffled, to order these
    again = staged(rows.groupBy("conv_id", "turn").agg(F.count("*").alias("n")).where("n > 1").selectExpr("conv_id as a_conv", "turn as a_turn"), "repeated")
    rows = rows.join(again, (F.col("conv_id") == F.col("a_conv")) & F.col("turn").eqNullSafe(F.col("a_turn")), "left")
    tie = [F.when(F.col("a_conv").isNotNull(), F.col(c)).alias(f"tie_{c}") for c in ("role", "text")]
    key = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    rows = rows.select("conv_id", "turn", *tie, key.alias("key"), F.length("text").cast("long").alias("chars"))
    order = [F.col("turn").asc_nulls_first(), "tie_role", "tie_text", "key"]
    rows = staged(rows.repartitionByRange("conv_id", *order).withColumn("part", F.spark_partition_id()), "turns")
    # a conversation may reach over several parts
    sums = rows.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    sums = sums.select("conv_id", "part", (F.sum("n").over(Window.partitionBy("conv_id").orderBy("part")) - F.col("n")).alias("before"))
    rows = rows.withColumn("pos", F.row_number().over(Window.partitionBy("conv_id", "part").orderBy(*order))).join(sums, ["conv_id", "part"])
    return staged(rows.select("conv_id", (F.col("pos") + F.col("before")).alias("pos"), "key", "chars"), "numbered")


def conversations_of(rows: DataFrame) -> DataFrame:
    """conv_id and n_turns of numbered turns; staged."""
    return staged(rows.groupBy("conv_id").agg(F.count("*").alias("n_turns")), "sizes")


def rebuilt(rows: DataFrame, every: int = 100, heads: int = 6) -> tuple[DataFrame, DataFrame]:
    """Conversations that share first turns, from numbered turns: of each conv_id c, with h = crc32 of c modulo
    heads, the first h turns of conversation c - c % every (none if it is absent), then c's own turns after its
    first h. Returns numbered turns and conversations, those without turns included."""
    own = conversations_of(rows)
    base = F.col("conv_id") - F.pmod(F.col("conv_id"), F.lit(every))
    convs = own.withColumns({"base": base, "h": (F.crc32(F.col("conv_id").cast("string")) % heads).cast("long")})
    convs = convs.join(own.select(F.col("conv_id").alias("base"), F.col("n_turns").alias("of_base")), "base", "left")
    convs = staged(convs.withColumn("taken", F.least("h", F.coalesce("of_base", F.lit(0)))), "rebuilt")
    first = rows.where((F.pmod(F.col("conv_id"), F.lit(every)) == 0) & (F.col("pos") < heads)).withColumnRenamed("conv_id", "base")
    first = convs.select("conv_id", "base", "h").join(first, "base").where("pos <= h").select("conv_id", "pos", "key", "chars")
    rest = join_hot(rows, convs.select("conv_id", "h", "taken"), "conv_id", own.withColumnRenamed("n_turns", "n")).where("pos > h")
    rest = rest.select("conv_id", (F.col("taken") + F.col("pos") - F.col("h")).alias("pos"), "key", "chars")
    after = F.greatest(F.col("n_turns") - F.col("h"), F.lit(0))
    return first.unionByName(rest), convs.select("conv_id", (F.col("taken") + after).alias("n_turns"))


def nodes(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """The trie's nodes, from numbered turns and conversations: conv_id (smallest member), depth, parent_conv_id,
    n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    spark, at = turns.sparkSession, scratch(turns.sparkSession, "trie")

    def put(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{at}/{name}")
        return spark.read.schema(df.schema).parquet(f"{at}/{name}")

    def every(name: str, like: DataFrame) -> DataFrame:
        return spark.read.schema(like.schema).parquet(f"{at}/{name}/*")

    convs = put(convs, "conversations")
    turns = put(turns.select("conv_id", F.col("pos").alias("depth"), "key", "chars").sortWithinPartitions("depth"), "turns")  # a level is a few pages of each file
    root = convs.agg(F.min("conv_id").alias("node"), F.count("*").alias("n")).first()
    at_root = F.lit(root.node).cast(convs.schema["conv_id"].dataType)
    live = put(convs.where(F.lit(root.n > 0)).withColumn("node", at_root), "live/0")
    ends = put(live.where("n_turns = 0").select(F.lit(0).cast("long").alias("depth"), "node", "conv_id"), "ends/0")
    top = convs.agg(F.min("conv_id").alias("node"), F.count("*").alias("n")).where("n > 0")
    nothing = F.lit(None).cast(convs.schema["conv_id"].dataType)
    levels = [put(top.select("node", nothing.alias("parent"), "n", F.lit(0).cast("long").alias("chars")), "level/0")]
    alone = None
    while True:
        d = len(levels)
        step = live.where(F.col("n_turns") >= d).join(turns.where(F.col("depth") == d).drop("depth"), "conv_id")
        path = F.concat("key", F.encode(F.col("node").cast("string"), "UTF-8"))
        step = put(step.select("conv_id", "n_turns", F.col("node").alias("parent"), path.alias("path"), "chars"), f"step/{d}")
        groups = step.groupBy("path").agg(F.min("conv_id").alias("node"), F.min("parent").alias("parent"), F.count("*").alias("n"), F.max("chars").alias("chars"))
        groups = put(groups, f"groups/{d}")
        alone = put(groups.where("n = 1").select(F.col("node").alias("conv_id"), F.lit(d).cast("long").alias("from"), "parent"), f"alone/{d}")
        levels.append(groups)
        shared = groups.where("n > 1")
        if shared.isEmpty():
            break
        live = put(join_hot(step.drop("parent", "chars"), shared.select("path", "node"), "path", groups.select("path", "n")).select("conv_id", "n_turns", "node"), f"live/{d}")
        put(live.where(F.col("n_turns") == d).select(F.lit(d).cast("long").alias("depth"), "node", "conv_id"), f"ends/{d}")
    below = None
    for d in reversed(range(len(levels) - 1)):
        kids = levels[d + 1].where("n = 1").select("parent", F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"))
        if below is not None:
            kids = kids.unionByName(below.select(F.col("parent_conv_id").alias("parent"), "n_leaves", "saved_tokens"))
        kids = kids.groupBy("parent").agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens")).withColumnRenamed("parent", "node")
        here = (levels[d] if d == 0 else levels[d].where("n > 1")).select("node", "parent", "n", ((F.col("n") - 1) * F.col("chars")).alias("own"))
        rolled = here.join(kids, "node", "left").select(
            F.col("node").alias("conv_id"), F.lit(d).cast("long").alias("depth"), F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"),
            F.coalesce("n_children", F.lit(0)).alias("n_children"), F.coalesce("n_leaves", F.lit(1)).alias("n_leaves"), (F.col("own") + F.coalesce("saved_tokens", F.lit(0))).alias("saved_tokens"),
        )
        below = put(rolled, f"rolled/{d}")
    hashed = ends_digests(every("ends", ends)).withColumnRenamed("node", "conv_id")
    common = every("rolled", below).join(hashed, ["depth", "conv_id"], "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NO_ENDS)))
    tails = join_hot(turns.drop("key", "chars"), every("alone", alone).join(convs, "conv_id"), "conv_id", convs.withColumnRenamed("n_turns", "n")).where("depth >= from")
    one, last = F.lit(1).cast("long"), F.col("depth") == F.col("n_turns")
    tails = tails.select(
        "conv_id", "depth", F.when(F.col("depth") == F.col("from"), F.col("parent")).otherwise(F.col("conv_id")).alias("parent_conv_id"), one.alias("n_convs"),
        F.when(last, 0).otherwise(1).cast("long").alias("n_children"), one.alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"),
        F.when(last, F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(NO_ENDS).alias("ends_sha256"),
    )
    return common.select(*COLUMNS, "ends_sha256").unionByName(tails)


def _pieces(batches):
    """Of rows in order of depth, node and conv_id: pieces of a node's ids, joined by commas."""
    import pyarrow as pa

    out: list[tuple] = []
    at, ids = None, []

    def close():
        if ids:
            out.append((*at, ids[0], ",".join(map(str, ids))))

    def batch_of(rows):
        cols = list(zip(*rows))
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols[:3]] + [pa.array(cols[3], pa.string())], names=["depth", "node", "first", "ids"])

    for batch in batches:
        for d, node, c in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if (d, node) != at or len(ids) >= PIECE:
                close()
                at, ids = (d, node), []
            ids.append(c)
        if out:
            yield batch_of(out)
            out = []
    close()
    if out:
        yield batch_of(out)


def _hashed(batches):
    """Of pieces in order of depth, node and first id: the digest of each node's ids."""
    import pyarrow as pa

    at, digest = None, None
    batch_of = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.string()))], names=["depth", "node", "ends_sha256"])
    for batch in batches:
        out = []
        for d, node, ids in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3))):
            if (d, node) == at:
                digest.update(b"," + ids.encode())
                continue
            if at is not None:
                out.append((*at, digest.hexdigest()))
            at, digest = (d, node), hashlib.sha256(ids.encode())
        if out:
            yield batch_of(out)
    if at is not None:
        yield batch_of([(*at, digest.hexdigest())])


def ends_digests(ends: DataFrame) -> DataFrame:
    """depth, node, ends_sha256 (of the node's conv_ids in order, comma-joined), of rows depth, node, conv_id."""
    rows = ends.select("depth", F.col("node").cast("long").alias("node"), F.col("conv_id").cast("long").alias("conv_id"))
    rows = rows.repartitionByRange("depth", "node", "conv_id").sortWithinPartitions("depth", "node", "conv_id")
    pieces = staged(in_batches(rows, _pieces, "depth long, node long, first long, ids string"), "pieces")
    return in_batches(pieces.repartition("depth", "node").sortWithinPartitions("depth", "node", "first"), _hashed, "depth long, node long, ends_sha256 string")


def trie(turns: DataFrame) -> DataFrame:
    """The nodes of the prefix trie of a table with conv_id, turn, role, text."""
    rows = numbered(turns)
    return nodes(rows, conversations_of(rows))
