"""Preference formatting of chosen and rejected conversations.

The longest common prefix of turns (same role, same text, turn by turn) is rendered once as the
prompt; what follows on either side are the two completions. A completion's mask marks what a
model is trained on: the text and end mark of assistant turns; everything else is masked out.

What two conversations share is decided on digests of their turns, so texts are shuffled at most once, to
meet their pair's first differing turn, and not at all where these are few enough to broadcast. Pairs of
many turns are salted, so a conversation of any length is spread over tasks. Output is one row for each
rendered turn, in order (pair, part, turn); `assembled` joins them into strings for pairs of
ordinary length, `digests` summarises them without gathering.

Turns are aligned by their number. Rows without pair, side or turn number are left out. Where a
side repeats a turn number, the smallest (role, text) counts. A null role is "unknown", a null text
empty. A pair of one side only has an empty prompt and one completion; two equal conversations are
all prompt. Columns of other names are neither read nor lost. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_hot, staged

#: What is written around a turn: fixed values of the format.
OPEN, MIDDLE, CLOSE = "<|", "|>\n", "<|end|>\n"
TRAINED = "assistant"


def _one_each(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows (keys, role, text) with nulls filled; where a key is repeated, its smallest (role, text). Only
    rows of repeated keys are grouped."""
    rows = rows.select(*keys, F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    again = staged(rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").drop("n"), "repeated")
    least = rows.join(again, keys, "left_semi").groupBy(*keys).agg(F.min(F.struct("role", "text")).alias("s"))
    return rows.join(again, keys, "left_anti").unionByName(least.select(*keys, "s.role", "s.text"))


def segments(turns: DataFrame) -> DataFrame:
    """turns: pair_id, side (chosen or rejected), turn, role, text. Returns pair_id, part (prompt,
    chosen, rejected), turn, rendered, trained_from and trained_to (code points; equal: all masked)."""
    used = turns.where("pair_id is not null and turn is not null and side in ('chosen', 'rejected')")
    used = _one_each(used.select("pair_id", "side", "turn", "role", "text"), ["pair_id", "side", "turn"])
    digest = F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"))
    on = lambda side: F.max(F.when(F.col("side") == side, F.col("digest")))
    both = used.select("pair_id", "side", "turn", digest.alias("digest")).groupBy("pair_id", "turn").agg((~on("chosen").eqNullSafe(on("rejected"))).alias("differs"), F.count("*").alias("n"))
    split = staged(both.groupBy("pair_id").agg(F.min(F.when(F.col("differs"), F.col("turn"))).alias("split"), F.sum("n").alias("n")), "splits")
    rows = join_hot(used, split.drop("n"), "pair_id", split)
    common = F.col("split").isNull() | (F.col("turn") < F.col("split"))
    rows = rows.withColumn("part", F.when(~common, F.col("side")).when(F.col("side") == "chosen", "prompt")).where("part is not null")
    rendered = F.concat(F.lit(OPEN), "role", F.lit(MIDDLE), "text", F.lit(CLOSE))
    trained = (F.col("part") != "prompt") & (F.col("role") == TRAINED)
    start = F.length("role") + len(OPEN) + len(MIDDLE)
    return rows.select(
        "pair_id", "part", "turn", rendered.alias("rendered"),
        F.when(trained, start).otherwise(0).alias("trained_from"), F.when(trained, F.length(rendered)).otherwise(0).alias("trained_to"),
    )


def assembled(rows: DataFrame) -> DataFrame:
    """pair_id, prompt, chosen, rejected (strings), chosen_mask, rejected_mask (arrays of code point spans)."""
    turns = rows.groupBy("pair_id", "part").agg(F.array_sort(F.collect_list(F.struct("turn", "rendered", "trained_from", "trained_to"))).alias("t"))
    fold = """aggregate(t, named_struct('at', 0, 'out', cast(array() as array<struct<start:int,end:int>>)),
        (a, x) -> named_struct('at', a.at + length(x.rendered), 'out', if(x.trained_to > x.trained_from,
            concat(a.out, array(named_struct('start', a.at + x.trained_from, 'end', a.at + x.trained_to))), a.out)), a -> a.out)"""
    whole = turns.select("pair_id", "part", F.expr("array_join(transform(t, x -> x.rendered), '')").alias("s"), F.expr(fold).alias("m"))
    pick = lambda name, c: F.max(F.when(F.col("part") == name, F.col(c)))
    none = F.expr("cast(array() as array<struct<start:int,end:int>>)")
    return whole.groupBy("pair_id").agg(
        *[F.coalesce(pick(p, "s"), F.lit("")).alias(p) for p in ("prompt", "chosen", "rejected")],
        *[F.coalesce(pick(p, "m"), none).alias(f"{p}_mask") for p in ("chosen", "rejected")],
    )


def digests(rows: DataFrame) -> DataFrame:
    """pair_id and for each part: turns, code points, trained code points, and a sum over its turns of
    the first 32 bits of md5(turn number, rendered)."""
    check = F.conv(F.substring(F.md5(F.concat(F.col("turn").cast("string"), F.lit(":"), "rendered")), 1, 8), 16, 10).cast("long")
    rows = rows.select("pair_id", "part", F.length("rendered").alias("n"), (F.col("trained_to") - F.col("trained_from")).alias("t"), check.alias("c"))
    out = []
    for p in ("prompt", "chosen", "rejected"):
        here = lambda x, p=p: F.coalesce(F.sum(F.when(F.col("part") == p, x)), F.lit(0)).cast("long")
        out += [here(F.lit(1)).alias(f"{p}_turns"), here(F.col("n")).alias(f"{p}_chars"), here(F.col("t")).alias(f"{p}_trained"), here(F.col("c")).alias(f"{p}_check")]
    return rows.groupBy("pair_id").agg(*out)


def swapped_answers(conversations: DataFrame) -> DataFrame:
    """Preferences from a table that has none: of every conversation, the chosen side is itself; the
    rejected one is the same up to its last assistant turn, which says what the last assistant turn of
    the conversation with the next conv_id says (nothing, if there is none) and ends the conversation."""
    rows = _one_each(conversations.where("conv_id is not null and turn is not null").select("conv_id", "turn", "role", "text"), ["conv_id", "turn"])
    # a row for each conversation: its last answer's turn; answers meet by number and turn alone
    last = staged(rows.where(F.col("role") == TRAINED).groupBy("conv_id").agg(F.max("turn").alias("turn")), "last")
    answers = rows.join(last, ["conv_id", "turn"], "left_semi").select((F.col("conv_id") - 1).alias("conv_id"), F.col("text").alias("other"))
    answers = last.join(answers, "conv_id", "left").select(F.col("conv_id").alias("pair_id"), F.lit("rejected").alias("side"), "turn", F.lit(TRAINED).alias("role"), F.coalesce("other", F.lit("")).alias("text"))
    sided = lambda r, side: r.select(F.col("conv_id").alias("pair_id"), F.lit(side).alias("side"), "turn", "role", "text")
    before = rows.join(last.withColumnRenamed("turn", "at"), "conv_id").where("turn < at")
    return sided(rows, "chosen").unionByName(sided(before, "rejected")).unionByName(answers)


#: segments() of swapped_answers() over conversations, as DuckDB SQL.
ORACLE_SQL = """
WITH t AS (
  SELECT conv_id, turn, min({'role': coalesce(role, 'unknown'), 'text': coalesce(text, '')}) AS said
  FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY ALL),
l AS (SELECT conv_id, max(turn) AS at, arg_max(said.text, turn) AS text FROM t WHERE said.role = 'assistant' GROUP BY ALL),
r AS (
  SELECT conv_id, turn, {'role': said.role, 'text': CASE WHEN turn = l.at THEN coalesce(n.text, '') ELSE said.text END} AS said
  FROM t JOIN l USING (conv_id) LEFT JOIN (SELECT conv_id - 1 AS conv_id, text FROM l) n USING (conv_id) WHERE turn <= l.at),
b AS (SELECT conv_id AS pair_id, turn, t.said AS c, r.said AS r FROM t LEFT JOIN r USING (conv_id, turn)),
s AS (SELECT pair_id, min(turn) FILTER (c IS DISTINCT FROM r) AS split FROM b GROUP BY ALL),
p AS (
  SELECT pair_id, turn, 'prompt' AS part, c AS said FROM b JOIN s USING (pair_id) WHERE split IS NULL OR turn < split
  UNION ALL SELECT pair_id, turn, 'chosen', c FROM b JOIN s USING (pair_id) WHERE turn >= split AND c IS NOT NULL
  UNION ALL SELECT pair_id, turn, 'rejected', r FROM b JOIN s USING (pair_id) WHERE turn >= split AND r IS NOT NULL)
SELECT pair_id, part, turn, '<|' || said.role || '|>' || chr(10) || said.text || '<|end|>' || chr(10) AS rendered,
  CAST(CASE WHEN part <> 'prompt' AND said.role = 'assistant' THEN 14 ELSE 0 END AS INTEGER) AS trained_from,
  CAST(CASE WHEN part <> 'prompt' AND said.role = 'assistant' THEN length(said.text) + 22 ELSE 0 END AS INTEGER) AS trained_to
FROM p"""
