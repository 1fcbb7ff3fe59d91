"""The pipeline's stages against brute force on a small corpus."""

import hashlib
import random
from collections import Counter

import corpus_pipeline
import public_tokenizers as P

from .cases import frame, odd_documents, words
from .test_texts import brute_components, brute_spans


def test_stages(spark, tmp_path):
    import tiktoken

    from millrace.llm.bpe import load_ranks

    r = random.Random(8)
    rows = odd_documents() + [(100 + k, " ".join(words(60 + r.randrange(80), 50 + k)), "en", r.choice("aab"), "", 0) for k in range(80)]
    rows += [(300 + k, rows[20][1] + f" extra{k}", "en", "a", "", 0) for k in range(4)]
    rows += [(400, "password = hunter2x " + " ".join(words(80, 999)), "en", "b", "", 0)]
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    docs, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path)).persist()
        seen.append((name, docs, out.collect()))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
        docs = out
    by = {name: (before, after) for name, before, after in seen}
    kept = {x.doc_id for x in by["quality"][1]}
    assert {100 + k for k in range(80)} <= kept and not {5, 6, 7, 8, 15} & kept
    before = [(x.doc_id, x.text) for x in by["near_dedup"][0].collect()]
    _, comp = brute_components([(d, t) for d, t in before])
    assert sorted(x.doc_id for x in by["near_dedup"][1] if x.doc_id is not None) == sorted(d for d, _ in before if d is not None and comp[d] == d)
    assert len(by["secrets"][1]) == by["secrets"][0].count() and all(not brute_spans(x.text or "") for x in by["secrets"][1])
    assert any("[SECRET]" in (x.text or "") for x in by["secrets"][1])
    times = Counter(x.doc_id for x in by["mixing"][1])
    rows_of = Counter(x.doc_id for x in by["secrets"][1])  # rows that repeat a doc_id are taken each
    assert all(n <= 3 * rows_of[d] for d, n in times.items()) and set(times) <= {x.doc_id for x in by["secrets"][1]}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=load_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    texts = {x.doc_id: x.text or "" for x in by["mixing"][1]}
    assert len(by["byte_bpe"][1]) == len(by["mixing"][1])
    for x in by["byte_bpe"][1]:
        ids = library.encode_ordinary(texts[x.doc_id])
        assert x.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest() and x.decoded_sha256 == hashlib.sha256(texts[x.doc_id].encode()).hexdigest()
