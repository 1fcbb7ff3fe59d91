"""Periodic runs, the quadratic discriminant and the prefix trie against brute force."""

import hashlib
import random
import zlib
from collections import defaultdict
from fractions import Fraction

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F

from millrace.llm import bpe, discriminant, minhash, periodic, secrets, trie
from millrace.llm import queries as registered
from millrace.llm.common import WordHashes
from millrace.llm.quality import MORE, STATS, text_stats

from .cases import frame, odd_documents, words

SF = "/root/testdata/sf0.001"


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


# ---------------------------------------------------------------- byte-level BPE


def test_every_code_point_is_cut_as_the_library_cuts_it():
    ranks = P.path("byte_bpe_50k.tiktoken")
    c = bpe.Codec(ranks)
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(ranks), special_tokens={})
    points = [p for p in range(0x110000) if not 0xD800 <= p < 0xE000]
    texts = ["".join(f"a{chr(p)}1 {chr(p)}'s  {chr(p)}" for p in points[i : i + 500]) for i in range(0, len(points), 500)]
    for text, ids in zip(texts, c.encode(texts)):
        assert ids.tolist() == library.encode_ordinary(text), hex(ord(text[1]))


# ---------------------------------------------------------------- periodic runs


def brute_runs(w, least=24, e=3):
    seen = {}
    for q in range(1, len(w) // e + 1):
        i = 0
        while i < len(w) - q:
            j = i
            while j < len(w) - q and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, e * q):
                seen.setdefault((i, j - i + q), q)
            i = max(i + 1, j)
    return sorted((s, n, q) for (s, n), q in seen.items())


@pytest.mark.parametrize(("least", "e"), [(24, 3), (6, 2), (4, 2), (9, 3), (12, 4)])
def test_runs_equal_brute_force(least, e):
    r = random.Random(least * e)
    for _ in range(400):
        w, k = [], r.choice([1, 2, 2, 3, 5])
        while len(w) < r.randrange(110):
            w += [b"%d" % r.randrange(k) for _ in range(r.randrange(1, 9))] * r.randrange(1, 8)
        assert periodic.text_runs(w, WordHashes(), least, e) == brute_runs(w, least, e)


def test_blocks_of_end_positions(monkeypatch):
    monkeypatch.setattr(periodic, "BLOCK", 4)
    w = [b"a", b"b", b"a"] * 40 + [b"x"] + [b"c"] * 60 + [b"a", b"b", b"a"] * 9
    assert periodic.text_runs(w, WordHashes()) == brute_runs(w)


def test_a_very_long_text():
    unit = [str(x).encode() for x in range(7000)]
    w = unit * 20 + [b"end"] + [b"z"] * 60_000
    assert periodic.text_runs(w, WordHashes()) == [(0, 140_000, 7000), (140_001, 60_000, 1)]


def brute_row(doc_id, text):
    w = (text or "").encode().split()
    if doc_id is not None and w and (h := zlib.crc32(str(doc_id).encode())) % 10 == 0:
        g, n = h // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(w)
    drop = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2])) if runs else (None,) * 3
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(b" ".join(x for i, x in enumerate(w) if i not in drop)))


def test_periodic_query_on_odd_documents(spark):
    planted = [i for i in range(2000) if zlib.crc32(str(i).encode()) % 10 == 0][:6]
    rows = [r for r in odd_documents() if r[0] != 10] + [(i, t, "en", "a", "", 0) for i, t in zip(planted, [" ".join(words(300, 9)), " one  two\tthree ", None, "", "é " * 90, "x"])]
    rows += [(900, "a b c\n" * 30 + "a b d", "en", "a", "", 0), (901, "x " * 24, "en", "a", "", 0), (902, "x " * 23, "en", "a", "", 0)]
    got = periodic.digests(periodic.collapse(periodic.looped(frame(spark, rows)), keep=["doc_id"]))
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(str(brute_row(r[0], r[1])) for r in rows)
    assert periodic.collapse(frame(spark, [])).count() == 0


def test_periodic_query_on_the_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = sorted(map(str, map(tuple, registered.op11_periodic(spark, SF).collect())))
    assert got == sorted(str(brute_row(d.doc_id, d.text)) for d in docs)


# ---------------------------------------------------------------- discriminant


def vectors(texts):
    s = np.array([text_stats((t or "").encode(), WordHashes()) for t in texts], float)
    c = dict(zip(STATS + MORE, s.T))
    ratio = lambda a, b, by, scale=100.0: np.log1p(scale * c[a] / (c[b] + by))
    return np.column_stack([
        np.log1p(c["n_words"]), np.log((c["word_chars"] + 50) / (c["n_words"] + 10)), ratio("n_symbols", "word_chars", 100), ratio("n_dup_lines", "n_lines", 5), ratio("n_repeat_words", "n_words", 20),
        ratio("n_upper", "word_chars", 100), ratio("n_punct", "word_chars", 100), ratio("n_digits", "word_chars", 100), ratio("n_distinct", "n_words", 20, 1.0), np.log((c["n_words"] + 10) / (c["n_lines"] + 1)),
    ])


def brute_log_odds(x, y, at, lam, gamma):
    n = [(y == k).sum() for k in (0, 1)]
    out = np.full(len(at), np.log(n[1] + 1) - np.log(n[0] + 1))
    covs = [np.cov(x[y == k].T, bias=True) for k in (0, 1)]
    common = (n[0] * covs[0] + n[1] * covs[1]) / sum(n)
    for k, sign in ((0, -1), (1, 1)):
        s = (1 - lam) * covs[k] + lam * common
        s = (1 - gamma) * s + gamma * np.diag(np.diag(s))
        s = s + np.diag(np.maximum(discriminant.FLOOR, discriminant.FLOOR - np.diag(s)))
        d = at - x[y == k].mean(axis=0)
        out += sign * -0.5 * (np.linalg.slogdet(s)[1] + np.einsum("ij,jk,ik->i", d, np.linalg.inv(s), d))
    return np.clip(out, -discriminant.SURE, discriminant.SURE)


def test_discriminant_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").toPandas()
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas()
    got = registered.op12_discriminant(spark, SF).toPandas().set_index("doc_id").sort_index()
    assert sorted(got.index) == sorted(docs.doc_id) and got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.5)).all()
    crc = lambda s, m: zlib.crc32(str(s).encode()) % m
    assert all(got.held_out[i] == (crc(i, 3) == 1) for i in got.index)
    learnt = docs.merge(labels[[crc(i, 3) != 1 for i in labels.doc_id]], on="doc_id")
    x, y = vectors(learnt.text), learnt.quality.to_numpy()
    fold = np.array([crc(f"fold{i}", discriminant.FOLDS) for i in learnt.doc_id])
    losses = {}
    for lam in discriminant.LAMBDA:
        for gamma in discriminant.GAMMA:
            odds = np.concatenate([brute_log_odds(x[fold != f], y[fold != f], x[fold == f], lam, gamma) for f in range(discriminant.FOLDS)])
            truth = np.concatenate([y[fold == f] for f in range(discriminant.FOLDS)])
            losses[lam, gamma] = np.logaddexp(0, np.where(truth == 1, -1, 1) * odds).sum()
    want = 1 / (1 + np.exp(-brute_log_odds(x, y, vectors(docs.text), *min(losses, key=losses.get))))
    assert np.allclose(got.score.to_numpy(), want[np.argsort(docs.doc_id.to_numpy())], atol=1e-5)


@pytest.mark.parametrize("sf", ["sf0.01"])
def test_discriminant_on_held_out_rows(spark, sf):
    got = registered.op12_discriminant(spark, f"/root/testdata/{sf}").where("held_out")
    both = got.join(spark.read.parquet(f"/root/testdata/{sf}/labels.parquet"), "doc_id").toPandas()
    assert (both.predicted == both.quality).mean() >= 0.97 and (both.predicted[both.quality == 1] == 1).mean() >= 0.98


def test_discriminant_without_labels_of_a_class(spark):
    docs = frame(spark)
    label = lambda rows: discriminant.score(docs, spark.createDataFrame(rows, "doc_id long, quality int"))
    assert {r.score for r in label([]).collect()} == {0.5}
    one = {round(r.score, 6) for r in label([(1, 1), (1, None), (None, 1), (4, 1), (4, 0)]).collect()}  # doc 1 stands twice, half counts as 1
    assert one == {0.8}
    assert discriminant.score(frame(spark, []), spark.createDataFrame([(1, 1)], "doc_id long, quality int")).count() == 0
    assert label([(1, 1), (2, 1), (15, 0), (13, 0)]).count() == len(odd_documents())


# ---------------------------------------------------------------- prefix trie


def brute_nodes(rows, rebuild):
    by = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            by[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in by.items()}
    built = own
    if rebuild:
        head = lambda c: zlib.crc32(str(c).encode()) % 6
        built = {c: own.get(c - c % 100, [])[: head(c)] + v[head(c) :] for c, v in own.items()}
    members, kids, roll = defaultdict(list), defaultdict(list), {}
    for c, v in built.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
    for k in members:
        if k:
            kids[k[:-1]].append(k)
    for k in sorted(members, key=len, reverse=True):
        saved = (len(members[k]) - 1) * (len(k[-1][1]) if k else 0)
        roll[k] = (sum(roll[x][0] for x in kids[k]) or 1, saved + sum(roll[x][1] for x in kids[k]))
    ends = lambda k: sha(",".join(map(str, sorted(c for c in members[k] if len(built[c]) == len(k)))))
    return sorted(str((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), len(kids[k]), *roll[k], ends(k))) for k, m in members.items())


TURNS = "conv_id long, turn long, role string, text string"


def odd_turns():
    r = random.Random(3)
    rows = [(c, t, r.choice(["user", "assistant", None]), r.choice(["hi", "", None, "é𝒳", "long " * 50])) for c in [*range(0, 12), *range(100, 130), 250, 251] for t in [None, *range(r.randrange(7))][: r.randrange(8)]]
    rows += [(400, k, "user", f"t{k}") for k in range(40)] + [(400 + i, k, "user", f"t{k}") for i in (1, 2) for k in range(30)]
    rows += [(500, 1, "b", "x"), (500, 1, "a", "y"), (500, 1, "a", "x"), (500, 1, "a", "x"), (None, 0, "user", "hi"), (600, 0, "user:", "a"), (601, 0, "user", ":a")]
    return rows


def test_trie_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(trie, "PIECE", 3)
    rows = odd_turns()
    turns = spark.createDataFrame(rows, TURNS)
    assert sorted(str(tuple(r)) for r in trie.trie(turns).collect()) == brute_nodes(rows, False)
    got = trie.nodes(*trie.rebuilt(trie.numbered(turns)))
    assert sorted(str(tuple(r)) for r in got.collect()) == brute_nodes(rows, True)


def test_trie_of_few_conversations(spark):
    for rows in ([], [(7, 0, "user", "a")], [(7, 0, "user", "a"), (7, 1, "user", "b")], [(100, 0, "u", "x"), (101, 0, "u", "x")]):
        turns = spark.createDataFrame(rows, TURNS)
        assert sorted(str(tuple(r)) for r in trie.nodes(*trie.rebuilt(trie.numbered(turns))).collect()) == brute_nodes(rows, True)


def test_trie_query_on_the_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = registered.op13_prefix_trie(spark, SF)
    assert sorted(str(tuple(r)) for r in got.collect()) == brute_nodes(rows, True)


def test_copies_of_one_conversation_share_pieces(spark):
    turns = spark.range(2500).select(F.col("id").alias("conv_id"), F.explode(F.expr("sequence(0L, 2L)")).alias("turn")).withColumns({"role": F.lit("user"), "text": F.concat(F.lit("t"), F.col("turn").cast("string"))})
    got = {r.depth: r for r in trie.trie(turns).collect()}
    assert [got[d].n_convs for d in range(4)] == [2500] * 4 and got[3].ends_sha256 == sha(",".join(map(str, range(2500)))) and got[0].saved_tokens == 3 * 2 * 2499


# ---------------------------------------------------------------- secrets


def brute_redacted(text, spans):
    out, at = "", 0
    for s, e in sorted(spans):
        if s >= at:
            out += text[at:s] + "[SECRET]"
        at = max(at, e)
    return out + text[at:]


def test_secrets_in_pieces_and_blocks(spark, monkeypatch):
    r = random.Random(8)
    monkeypatch.setattr(secrets, "BLOCK", 3)
    monkeypatch.setattr(secrets, "PIECE", 7)
    one = lambda: r.choice(["password = hunter2x", "api_key: " + "ab12" * 9, "AKIA" + "QWERTY7890ABCDEF" * r.randrange(1, 3), "0123456789abcdef" * r.randrange(1, 4), "plain", "é𝒳", "secret=short", "x" * 30, "Zk3" * 9])
    texts = [r.choice([" ", "\n", "", "; "]).join(one() for _ in range(r.randrange(30))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {x.doc_id: [(s.start, s.end) for s in [*x.base, *x.found]] for x in secrets.scan(df).collect()}
    got = {x.doc_id: x.text for x in secrets.redact(df).collect()}
    assert got == {i: brute_redacted(t, found[i]) for i, t in enumerate(texts)} and sum(map(len, found.values())) > 100


def test_a_long_text_of_secrets(spark):
    text = " ".join(f"password = {i:012x}" for i in range(20_000))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert secrets.digests(secrets.scan(df)).first().n_assign == 20_000
    assert secrets.redact(df).first().text == " ".join(["[SECRET]"] * 20_000)


# ---------------------------------------------------------------- near copies


def test_ids_that_stand_for_several_texts(spark):
    r = random.Random(11)
    bases, rows = [words(60, s) for s in (1, 2, 3)], []
    for i in range(90):
        w = list(r.choice(bases))
        for _ in range(r.choice([0, 1, 2, 3, 5])):
            w[r.randrange(60)] = f"n{r.randrange(10**6)}"
        rows.append((r.randrange(70), " ".join(w)))
    sets = [(i, {tuple(t.split()[k : k + 5]) for k in range(56)}) for i, t in rows]
    least = {i: i for i, _ in rows}
    changed = True
    while changed:
        changed = False
        for i, a in sets:
            for j, b in sets:
                if least[j] < least[i] and 100 * len(a & b) >= 75 * len(a | b):
                    least[i], changed = least[j], True
    got = minhash.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 90 and all(x.component_id == least[x.doc_id] for x in got) and len(set(least.values())) > 3


def test_components_keep_every_link(spark):
    r = random.Random(2)
    for size, links in ((12, 14), (40, 30), (200, 190)):
        pairs = [(r.randrange(size), r.randrange(size)) for _ in range(links)]
        least = list(range(size))
        for _ in range(size):
            for a, b in pairs:
                least[a] = least[b] = min(least[a], least[b])
        got = {x.id: x.component for x in minhash.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
        assert got == {v: least[v] for a, b in pairs if a != b for v in (a, b)}
