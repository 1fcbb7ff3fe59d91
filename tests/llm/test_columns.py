"""Extra columns that bear the names the operators use inside pass through, or are left alone."""

import corpus_pipeline
import public_tokenizers as P
from pyspark.sql import functions as F

from millrace.llm import bpe, discriminant, minhash, mixing, periodic, quality, repeats, secrets, toxicity, trie, wavelet

from .cases import frame, odd_documents

NAMES = ["d", "h", "mu", "inv", "g", "n", "id", "t", "band", "c0", "base", "tested", "spans", "q_mu", "q_n_words", "q_kept", "times", "copy", "s_source", "skips", "pos", "a", "b", "sig", "whole", "at", "ids", "__salt"]


def clashing(spark, rows=None):
    return frame(spark, rows).withColumns({n: F.concat(F.lit(n), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) for n in NAMES})


def test_stages_keep_every_column(spark):
    docs = clashing(spark)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns, name
        for r in out.collect():
            assert all(r[n] == n + ("" if r.doc_id is None else str(r.doc_id)) for n in NAMES), name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() == len(odd_documents())


def test_operators_on_clashing_columns(spark):
    docs, n = clashing(spark), len(odd_documents())
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1)], "doc_id long, quality int, toxic int").withColumn("half", F.lit("x"))
    counts = [secrets.scan(docs).count(), mixing.mix(docs).count(), toxicity.score(docs, labels).count(), minhash.near_groups(docs).count(), quality.with_stats(docs).count(), wavelet.read_documents(wavelet.write_shards(docs, P.path("word_bpe_49k.json"), 2)).count(), bpe.digests(docs, P.path("byte_bpe_50k.tiktoken"), ["doc_id"]).count()]
    assert counts == [n] * 7 and repeats.repeated(docs).count() > 0
    found = periodic.collapse(docs.withColumns({"runs": F.lit("x"), "collapsed": F.lit("y")}))
    assert found.count() == n and set(docs.columns) <= set(found.columns) and all(r.n == "n" + ("" if r.doc_id is None else str(r.doc_id)) for r in found.collect())
    marked = discriminant.score(docs.withColumns({"score": F.lit("x"), "x0": F.lit("y"), "weight": F.lit("z")}), labels)
    assert marked.count() == n and {"x0", "weight", *docs.columns} <= set(marked.columns) and dict(marked.dtypes)["score"] == "double"
    talks = spark.createDataFrame([(1, 0, "user", "hi"), (2, 0, "user", "hi")], "conv_id long, turn long, role string, text string").withColumns({c: F.lit("x") for c in [*NAMES, "node", "parent", "path", "depth", "key", "chars", "pos", "part"]})
    assert [tuple(r)[:5] for r in trie.trie(talks).orderBy("depth").collect()] == [(1, 0, None, 2, 1), (1, 1, 1, 2, 0)]
