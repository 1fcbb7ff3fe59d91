"""Rule-based classification by weighted tokens, and its leave-one-out test."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import text as X
from millrace.sources.staging import kept

from .resolving import lookup

BONUS = 0.5


#: What the rules read of a row: its tokens in order, whether it says anything, its manufacturer.
READ = ["tokens", "said", "manufacturer"]


def read(rows: DataFrame) -> DataFrame:
    """rows with what the rules read of them, and its digest `kind`: rows of a kind score alike."""
    own = {"tokens": F.coalesce(F.array_sort(X.tokens(F.col("Part_Desc"))), F.array().cast("array<string>")), "said": F.coalesce(F.col("Part_Desc") != "", F.lit(False))}
    return rows.withColumns(own).withColumn("kind", F.sha2(F.to_json(F.struct(*READ)), 256))


def scores(kinds: DataFrame, keywords: DataFrame, prior: DataFrame) -> DataFrame:
    """kind, classpath, score, has_kw: sum of matched token weights and the manufacturer's share of the class. kinds: a row
    for each kind, as read() tells it."""
    tok = kinds.select("kind", F.explode("tokens").alias("token"))
    by_token = tok.join(lookup(keywords), "token").groupBy("kind", "classpath").agg(F.sum("weight").alias("score"), F.lit(1).alias("has_kw"))
    share = prior.withColumn("bonus", BONUS * F.col("n") / F.sum("n").over(Window.partitionBy("manufacturer")))
    by_maker = kinds.where("said").join(lookup(share.select("manufacturer", "classpath", "bonus")), "manufacturer").select("kind", "classpath", F.col("bonus").alias("score"), F.lit(0).alias("has_kw"))
    return by_token.unionByName(by_maker).groupBy("kind", "classpath").agg(F.sum("score").alias("score"), F.max("has_kw").alias("has_kw"))


def ranked(s: DataFrame) -> DataFrame:
    """scores with place (1: best; rounded score, then whether a token matched, then the name) and total of each kind."""
    w = Window.partitionBy("kind")
    order = [F.desc(F.round("score", 9)), F.desc("has_kw"), F.asc("classpath")]
    return s.withColumns({"place": F.row_number().over(w.orderBy(*order)), "total": F.sum("score").over(w)})


def classify(rows: DataFrame, keywords: DataFrame, prior: DataFrame) -> DataFrame:
    """seq, classpath, confidence (best score's share), method, runner_up; null and 0 without any score. Rows that the
    rules read alike are scored once: what meets every class is a kind of row, and a row takes its kind's answer."""
    rows = kept(read(rows.select("seq", "Part_Desc", "manufacturer")).select("seq", "kind", *READ), "read")
    kinds = kept(rows.select("kind", *READ).dropDuplicates(["kind"]), "kinds")
    s = ranked(scores(kinds, keywords, prior)).where("place <= 2")
    at = lambda k, c: F.max(F.when(F.col("place") == k, F.col(c)))
    best = s.groupBy("kind").agg(at(1, "classpath").alias("classpath"), F.round(at(1, "score") / F.max("total"), 3).alias("share"), at(2, "classpath").alias("runner_up"))
    out = rows.select("seq", "kind").join(lookup(best), "kind", "left")
    return out.select("seq", "classpath", F.coalesce("share", F.lit(0.0)).alias("confidence"), F.lit("RULE_BASED").alias("method"), "runner_up")


def shortlist(classified: DataFrame, classes: DataFrame, n: int = 8) -> DataFrame:
    """seq, candidates: the best, the runner-up, then classes (column classpath) in order, n at most. The
    first n classes are all that any row can need, so they travel as one row."""
    first = classes.select("classpath").where("classpath is not null").distinct().orderBy("classpath").limit(n).agg(F.array_sort(F.collect_list("classpath")).alias("first"))
    candidates = F.array_distinct(F.array_compact(F.concat(F.array("classpath", "runner_up"), F.col("first"))))
    return classified.crossJoin(F.broadcast(first)).select("seq", F.slice(candidates, 1, n).alias("candidates"))


def accept_answer(rows: DataFrame, known: DataFrame) -> DataFrame:
    """classpath, confidence and method of an external answer (column answer) where it names a known class;
    of the rules (column classpath) where it does not, or is null."""
    hit = rows.join(lookup(known.select(F.col("classpath").alias("__known")).distinct()), F.col("answer") == F.col("__known"), "left")
    ok = F.col("__known").isNotNull()
    method = F.when(ok, "LLM").when(F.col("answer").isNotNull(), "RULE_BASED_LLM_UNKNOWN_FALLBACK").otherwise("RULE_BASED")
    return hit.select("seq", F.when(ok, F.col("answer")).otherwise(F.col("classpath")).alias("classpath"), F.when(ok, 1.0).otherwise(F.col("confidence")).alias("confidence"), method.alias("method"))


def leave_one_out(rows: DataFrame, top: int = 15) -> DataFrame:
    """seq, classpath, predicted of every row: keywords and prior as mined without the row itself. Rows of
    a class of their own are left out.

    Only a row's own tokens can match, so only their weights and places among a class's tokens are
    needed. Without the row, a token of it has one row less (in all classes), and so has its count in
    the row's own class: the weights of its tokens change, those of all others stay. A token's place is
    then the number of others above it: of the class's tokens that the row does not hold, counted by a
    lookup among the class's leading weights, and of the row's own, counted among its few matches. As a
    row holds at most m distinct tokens, the leading `top` + m tokens of a class (m: the most that any
    row has) are all that can stand above one that is kept. Rows meet classes through shared tokens only, and rows of a class that
    are read alike lose the same and are tried once.
    """
    rows = rows.where("classpath <> ''").withColumnRenamed("classpath", "own")
    rows = read(rows).withColumn("kind", F.sha2(F.concat("kind", F.to_json(F.struct("own"))), 256))
    rows = kept(rows.select("seq", "kind", "own", *READ), "read")
    kinds = kept(rows.groupBy("kind").agg(*[F.first(c).alias(c) for c in ("own", *READ)], F.count("*").alias("rows")), "kinds")
    tok = kept(kinds.select("kind", "own", "rows", F.explode("tokens").alias("token")), "tokens")
    freq = tok.groupBy(F.col("own").alias("classpath"), "token").agg(F.sum("rows").alias("freq"))
    df = freq.groupBy("token").agg(F.sum("freq").alias("df"))
    freq = kept(freq.join(df, "token"), "frequencies")
    sizes = kept(kinds.groupBy("own").agg(F.sum("rows").alias("size")), "sizes")
    n_classes = sizes.count()
    weight = lambda f, d: F.round(F.col(f) * (F.lit(n_classes) / F.col(d)), 4)
    most = kinds.agg(F.max(F.size("tokens"))).first()[0] or 0
    leading = Window.partitionBy("classpath").orderBy(F.desc("weight"), "token")
    lead = freq.withColumn("weight", weight("freq", "df")).withColumn("place", F.row_number().over(leading)).where(F.col("place") <= top + most)
    lead = kept(lead.groupBy("classpath").agg(F.array_sort(F.collect_list(F.struct((-F.col("weight")).alias("w"), "token"))).alias("lead")), "leading")  # top + m each
    several = sizes.where("size > 1").select("own")
    test = kinds.join(several, "own")
    # the row's tokens in each class that holds them, the row's own contribution taken off
    mine = tok.join(several, "own", "left_semi").join(freq, "token")
    mine = mine.withColumns({"freq": F.col("freq") - (F.col("classpath") == F.col("own")).cast("int"), "df": F.col("df") - 1}).where("freq > 0").withColumn("weight", weight("freq", "df"))
    per = mine.groupBy("kind", "classpath").agg(F.array_sort(F.collect_list(F.struct((-F.col("weight")).alias("w"), "token"))).alias("mine"))
    per = per.join(kinds.select("kind", F.col("tokens").alias("all")), "kind").join(lead, "classpath")
    # of the leading tokens that the row does not hold, those before a token of its own; its own before it
    others = F.filter("lead", lambda x: ~F.array_contains("all", x["token"]))
    merged = F.slice(F.array_sort(F.concat(F.transform(others, lambda x: F.struct(x["w"].alias("w"), x["token"].alias("token"), F.lit(0).alias("m"))), F.transform("mine", lambda x: F.struct(x["w"].alias("w"), x["token"].alias("token"), F.lit(1).alias("m"))))), 1, top)
    hits = F.filter(merged, lambda x: x["m"] == 1)
    by_token = per.select("kind", "classpath", hits.alias("h")).where("size(h) > 0").select("kind", "classpath", F.aggregate("h", F.lit(0.0), lambda a, x: a - x["w"]).alias("score"), F.lit(1).alias("has_kw"))
    prior = kinds.where("manufacturer <> ''").groupBy("manufacturer", F.col("own").alias("classpath")).agg(F.sum("rows").alias("n"))
    own = test.select("kind", "own", "manufacturer").join(lookup(prior), "manufacturer").withColumn("n", F.col("n") - (F.col("classpath") == F.col("own")).cast("int")).where("n > 0")
    by_maker = own.select("kind", "classpath", (BONUS * F.col("n") / F.sum("n").over(Window.partitionBy("kind"))).alias("score"), F.lit(0).alias("has_kw"))
    s = by_token.unionByName(by_maker).groupBy("kind", "classpath").agg(F.sum("score").alias("score"), F.max("has_kw").alias("has_kw"))
    best = ranked(s).where("place = 1").select("kind", F.col("classpath").alias("predicted"))
    out = test.select("kind", "own").join(best, "kind", "left")
    return rows.select("seq", "kind").join(lookup(out), "kind").select("seq", F.col("own").alias("classpath"), "predicted")
