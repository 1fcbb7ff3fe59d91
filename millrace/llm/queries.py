"""The registered query of each operator: thin, whole tables, production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import ann, bpe, chat, discriminant, minhash, mixing, periodic, quality, repeats, secrets, toxicity, trie, wavelet
from .common import staged, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), ["doc_id"])


@query
def op6_wavelet_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return wavelet.read_documents(wavelet.write_shards(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2))


@query
def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = staged(quality.with_stats(table(spark, sf_dir, "documents"), keep=["doc_id", "lang", "source"]), "stats")
    out = quality.verdicts(stats, quality.fit(stats))
    return out.select("doc_id", *[f"q_{s}" for s in quality.STATS], "q_base_failed", "q_kept", "q_distance").toDF("doc_id", *quality.STATS, "base_failed", "kept", "distance")


@query
def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_groups(table(spark, sf_dir, "documents"))


@query
def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("source")


@query
def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(secrets.scan(table(spark, sf_dir, "documents")))


@query
def op4_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.search(vectors, vectors.where("vec_id % 100 = 0"))


@query
def op5_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.segments(chat.swapped_answers(table(spark, sf_dir, "conversations")))


ORACLE["op5_preferences"] = chat.ORACLE_SQL


@query
def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.repeated(table(spark, sf_dir, "documents"))


@query
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op11_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = periodic.looped(table(spark, sf_dir, "documents"))
    return periodic.digests(periodic.collapse(docs, keep=["doc_id"]))


@query
def op12_discriminant(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = discriminant.held_out("doc_id")
    learnt = table(spark, sf_dir, "labels").where(~held_out)
    out = discriminant.score(table(spark, sf_dir, "documents"), learnt, "quality", keep=["doc_id"])
    return out.select("doc_id", held_out.alias("held_out"), "score", "predicted")


@query
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.nodes(*trie.rebuilt(trie.numbered(table(spark, sf_dir, "conversations"))))
