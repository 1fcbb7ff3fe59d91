"""Best matches by similarity (200 x longest common subsequence / both lengths), without comparing all pairs.

A common subsequence is no longer than the characters that two texts share, each counted as often as both hold
it. Texts become sets of numbered characters (the second "e" is a token of its own), ordered from the
rarest to the most frequent on the right side. Two texts that reach a score share so many of them that the
first few of each, as many as lengths and score allow, have one in common: these few are the join's
keys. A pair is made at its first common token only, where what is left behind it on both sides can still
reach the score, and goes to the exact measure where the whole sets share enough.

As the best match alone counts, levels are tried from the highest: equal texts by a plain join, texts that are equal once
a character or two are taken off either, then LEVELS, then the least score. A text that has a match on a level is done;
only the rest meets the longer lists of keys below.

Names that are numbered alike share nearly all their characters, so their number of pairs grows with its square on any
level of tokens. What is left of a text without a few characters tells its near ones apart: of all right texts that leave
the same rest the shortest, first in order is the best for whoever shares it, so a rest has one row and this step grows with the texts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import text as X
from millrace.sources.staging import kept, spread

LEVELS = (95.0, 85.0)
#: Texts that one task makes rests of: a text of forty characters has 800.
TEXTS = 2_000
#: How many characters are taken off a text, by the longest length at which so many are.
OFF = ((40, 2), (100, 1))


def characters(c: Column) -> Column:
    """The characters of a text, each with the number of its occurrence."""
    sorted_ = F.array_sort(F.split(c, ""))
    return F.when(c == "", F.array().cast("array<string>")).otherwise(F.transform(sorted_, lambda x, i: F.concat(x, (i - F.array_position(sorted_, x)).cast("string"))))


def _ranked(rows: DataFrame, columns: list[str], ranks: DataFrame) -> DataFrame:
    """rows with tokens: ranks of its characters, rarest first."""
    each = rows.select(*columns, F.explode("chars").alias("token")).join(ranks, "token", "left")
    # a character that the right side lacks is rarer than any, and meets nobody
    tokens = F.array_sort(F.collect_list(F.coalesce("rank", F.lit(-1))))
    return each.groupBy(*columns).agg(tokens.alias("tokens"))


def _first(tokens: str, length: str, least: float) -> Column:
    """How many of a text's rarest tokens hold one that any match at this score shares."""
    w = least / 100
    shortest = F.ceil(F.col(length) * (w / (2 - w)) - 1e-9)
    shared = F.ceil(least / 200 * (F.col(length) + shortest) - 1e-9)
    return F.greatest(F.size(tokens) - F.greatest(shared, F.lit(1)) + 1, F.lit(0)).cast("int")


def candidates(left: DataFrame, right: DataFrame, by: list[str], least: float) -> DataFrame:
    """by, x, y of every pair that can reach the score, each once. left: by, x, tokens; right: by, y, tokens."""
    side = lambda rows, c, t: rows.select(
        *by, c, F.col("tokens").alias(t), F.length(c).alias(f"n_{c}"), F.slice("tokens", F.lit(1), _first("tokens", "n", least)).alias(f"first_{c}")
    ).select("*", F.posexplode(f"first_{c}").alias(f"at_{c}", "token"))
    a, b = side(left.withColumn("n", F.length("x")), "x", "tx"), side(right.withColumn("n", F.length("y")), "y", "ty")
    pairs = a.where("token >= 0").join(b, [*by, "token"])
    need = F.ceil(least / 200 * (F.col("n_x") + F.col("n_y")) - 1e-9)
    behind = F.least(F.size("tx") - F.col("at_x"), F.size("ty") - F.col("at_y"))  # the token itself included
    pairs = pairs.where(X.could_reach("x", "y", least) & (behind >= need))
    pairs = pairs.where(F.array_min(F.array_intersect("first_x", "first_y")) == F.col("token"))
    return pairs.where(F.size(F.array_intersect("tx", "ty")) >= need).select(*by, "x", "y")


def indexed(left: DataFrame, right: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """Both sides' distinct texts (by, x and by, y) with their ranked tokens; staged."""
    x = kept(left.select(*by, "x").distinct().withColumn("chars", characters(F.col("x"))), "left_texts")
    y = kept(right.select(*by, "y").distinct().withColumn("chars", characters(F.col("y"))), "right_texts")
    counts = y.select(F.explode("chars").alias("token")).groupBy("token").agg(F.count("*").alias("n"))  # a row for each letter of the alphabet and occurrence
    ranks = kept(counts.select("token", F.row_number().over(Window.orderBy("n", "token")).alias("rank")), "ranks")
    return kept(_ranked(x, [*by, "x"], ranks), "left_tokens"), kept(_ranked(y, [*by, "y"], ranks), "right_tokens")


def _off(n: Column) -> Column:
    out = F.lit(0)
    for longest, k in reversed(OFF):
        out = F.when(n <= longest, k).otherwise(out)
    return out


def rests(c: Column) -> Column:
    """What is left of a text without any of its characters, up to as many as OFF says for its length; each once."""
    without = lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.length(t)), lambda i: F.concat(F.substring(t, F.lit(1), i - 1), F.substring(t, i + 1, F.length(t)))))
    one = F.array_distinct(without(c))
    two = F.array_distinct(F.flatten(F.transform(one, without)))
    k = _off(F.length(c))
    return F.when(k == 0, F.array(c)).when(k == 1, F.concat(F.array(c), one)).otherwise(F.concat(F.array(c), one, two))


def near_matches(left: DataFrame, right: DataFrame, by: list[str], least: float) -> DataFrame:
    """by, x, y, score of the texts x whose best match is told by what both leave (rests): it scores more than any pair that
    leaves nothing in common could, at the lengths that the right side has. left: by, x (distinct); right: by, y, order; both staged."""
    n, m = F.length("x"), F.length("y")
    left, many = (spread(side, *by, c, rows=TEXTS).select(*by, c, *more) for side, c, more in ((left, "x", []), (right, "y", ["order"])))
    rest = many.select(*by, m.alias("m"), "order", "y", F.explode(rests(F.col("y"))).alias("rest"))
    rest = rest.groupBy(*by, "rest").agg(F.min(F.struct("m", "order", "y")).alias("r"))
    met = left.select(*by, "x", F.explode(rests(F.col("x"))).alias("rest")).join(rest.hint("merge"), [*by, "rest"])
    total = n + F.col("r.m")
    score = F.when(total == 0, 100.0).otherwise(200.0 * F.length("rest") / total)
    best = met.groupBy(*by, "x").agg(F.min(F.struct((-score).alias("s"), F.col("r.order").alias("order"), F.col("r.y").alias("y"))).alias("b"))
    lengths = right.groupBy(*by).agg(F.collect_set(m).alias("lengths"))  # as many numbers as texts have lengths
    best = best.join(lengths, by) if by else best.crossJoin(F.broadcast(lengths))
    unseen = lambda k: F.greatest(F.least(n, k, F.greatest(n - _off(n), k - _off(k)) - 1), F.lit(0))  # noqa: E731  longest common part of a pair that did not meet
    bound = F.array_max(F.transform("lengths", lambda k: F.when(n + k == 0, 0.0).otherwise(200.0 * unseen(k) / (n + k))))
    return best.where((-F.col("b.s") >= least) & (-F.col("b.s") > bound)).select(*by, "x", "b.y", (-F.col("b.s")).alias("score"))


def best_matches(left: DataFrame, right: DataFrame, by: list[str], least: float, levels: tuple[float, ...] = LEVELS) -> DataFrame:
    """by, x, y, score: of every distinct text x of the left side its most similar y among the right side's rows of the
    same group (by, may be empty) with a score of least or more; the smallest order among equals. left: by, x;
    right: by, y, order."""
    firsts = kept(right.groupBy(*by, "y").agg(F.min("order").alias("order")), "known")
    equal = left.select(*by, "x").distinct().join(firsts.withColumnRenamed("y", "x"), [*by, "x"])
    found = [kept(equal.select(*by, "x", F.col("x").alias("y"), F.lit(100.0).alias("score")), "equal")]
    open_ = kept(left.select(*by, "x").distinct().join(found[0], [*by, "x"], "left_anti"), "open")
    found.append(kept(near_matches(open_, firsts, by, least), "near"))
    open_ = kept(open_.join(found[-1], [*by, "x"], "left_anti"), "open")
    x, y = indexed(open_, firsts, by)
    for level in [*sorted((v for v in levels if v > least), reverse=True), least]:
        if x.isEmpty():
            break
        scored = candidates(x, y, by, level).withColumn("score", X.similarity("x", "y")).where(F.col("score") >= level)
        scored = scored.join(firsts, [*by, "y"])
        best = scored.groupBy(*by, "x").agg(F.min(F.struct((-F.col("score")).alias("s"), "order", "y")).alias("b"))
        found.append(kept(best.select(*by, "x", "b.y", (-F.col("b.s")).alias("score")), "matches"))
        if level > least:
            x = kept(x.join(found[-1], [*by, "x"], "left_anti"), "left_over")
    return reduce(DataFrame.unionByName, found)
