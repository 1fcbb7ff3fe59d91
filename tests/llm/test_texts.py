import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.llm import bpe, minhash, mixing, quality, repeats, secrets, wavelet

from .cases import frame, odd_documents, words

RANKS, WORD = P.path("byte_bpe_50k.tiktoken"), P.path("word_bpe_49k.json")
WORDS = re.compile("[^\x20\x09-\x0d]+")


def texts():
    r = random.Random(1)
    alphabet = " '  \n\tabcstredvlm'12é!?.  日ａ\x1c\x85'"
    return ["".join(r.choice(alphabet) for _ in range(r.randint(0, 60))) for _ in range(4000)] + ["a" * 3000, "!" * 900 + "'s", " " * 700, "ab'" * 400 + "ve", ""]


def test_bpe_equals_library_and_round_trips():
    import tiktoken

    c = bpe.Codec(RANKS)
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=c.ranks.ranks, special_tokens={})
    for t, ids in zip(texts(), c.encode(texts())):
        assert ids.tolist() == library.encode_ordinary(t)
        assert c.decode(ids.tolist()) == t.encode()
        assert c.offsets(ids.tolist())[-1] == len(t.encode())


def test_bpe_lanes_do_not_matter(monkeypatch):
    c = bpe.Codec(RANKS)
    whole = list(c.slices(texts()))
    monkeypatch.setattr(bpe, "LANE", 7)
    assert list(c.slices(texts())) == whole
    assert ["".join(s) for s in whole] == texts()


def test_bpe_on_odd_documents(spark):
    rows = bpe.digests(frame(spark), RANKS, ["doc_id"]).collect()
    assert len(rows) == len(odd_documents())
    by = {r.doc_id: r for r in rows}
    for d, t, *_ in odd_documents():
        assert by[d].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert by[5].n_tokens == 0 and by[5].ids_sha256 == hashlib.sha256(b"").hexdigest()
    full = bpe.encode(frame(spark), RANKS, ["doc_id", "n_words"]).where("doc_id = 8").first()
    assert len(full.offsets) == len(full.ids) + 1
    assert bpe.digests(frame(spark, []), RANKS, ["doc_id"]).count() == 0


def test_wavelet_matrix():
    ids = np.random.default_rng(0).zipf(1.3, 20000) % 49000
    for a in (ids, ids[:513], ids[:512], ids[:1], ids[:0]):
        w = wavelet.WaveletMatrix(wavelet.build(a.astype("u4"), [1, None], [len(a), 0]))
        assert (w.all_ids() == a).all() and w.directory()[0] == [1, None] and w.directory()[1].tolist() == [len(a), 0]
        assert all(w.access(i) == a[i] for i in range(0, len(a), max(1, len(a) // 40)))
        for t in (1, 2, 77, 48000, 70000):
            at = np.flatnonzero(a == t)
            assert w.count(t) == len(at)
            assert [w.find(t, j) for j in (0, 3)] == [at[j] if j < len(at) else None for j in (0, 3)]


def test_wavelet_access_unpacks_few_blocks(tmp_path, monkeypatch):
    import mmap

    monkeypatch.setattr(wavelet, "BLOCK", 1 << 10)
    ids = np.random.default_rng(1).integers(0, 49000, 50_000).astype("u4")
    (tmp_path / "shard").write_bytes(wavelet.build(ids, [3], [len(ids)]))
    with open(tmp_path / "shard", "rb") as f, mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ) as image:
        w = wavelet.WaveletMatrix(image)
        assert w.access(31_000) == ids[31_000] and len(w._kept) <= w.bits
        token = int(ids[40_000])
        assert [w.find(token, j) for j in range(w.count(token))] == np.flatnonzero(ids == token).tolist()
        assert w.count(token, 1000, 40_001) == (ids[1000:40_001] == token).sum()


def test_word_codec_equals_library():
    from tokenizers import Tokenizer

    c, plain = wavelet.WordCodec(WORD), Tokenizer.from_file(WORD)
    extra = ["Привет мир İstanbul dIŞ", "ﬁne, Ünïcode. naïve.", "Σίσυφος", "<|endoftext|> x", "a<|endoftext|>b <|startoftext|> <|ENDOFTEXT|>", "H\u0331 e\u0301\u00a0x\u2003y \u0301z", None]
    sample = texts() + extra
    ids, first = c.encode(pa.array(sample))
    assert c.separable and [ids[a:b].tolist() for a, b in zip(first, first[1:])] == [e.ids for e in plain.encode_batch([t or "" for t in sample], add_special_tokens=False)]


def test_wavelet_on_odd_documents(spark, monkeypatch):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORD)
    rows = wavelet.read_documents(wavelet.write_shards(frame(spark), WORD, end_id=2)).orderBy("start").collect()
    docs = sorted(odd_documents(), key=lambda r: (r[0] is not None, r[0] or 0))
    assert [r.doc_id for r in rows] == [d[0] for d in docs]
    start = 0
    for r, d in zip(rows, docs):
        ids = [*t.encode(d[1] or "", add_special_tokens=False).ids, 2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert wavelet.read_documents(wavelet.write_shards(frame(spark, []), WORD, end_id=2)).count() == 0


def brute_components(rows):
    up = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
    sets = {}
    for d, t, *_ in rows:
        if d is None:
            continue
        w = WORDS.findall((t or "").translate(up))
        sets[d] = frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    comp = {d: d for d in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    comp[a] = comp[b] = min(comp[a], comp[b])
    return sets, comp


def test_near_groups_equal_brute_force(spark):
    rows = odd_documents()
    r = random.Random(5)
    base = words(150, 9)
    for k in range(40):  # a family of near copies around the bound, without a centre
        copy = list(base)
        for _ in range(r.randint(1, 9)):
            copy[r.randrange(150)] = f"y{r.randrange(50)}"
        rows.append((100 + k, " ".join(copy), "en", "f", "", 0))
    sets, comp = brute_components(rows)
    got = minhash.near_groups(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    for x in got:
        if x.doc_id is None:
            assert x.component_id is None and x.kept
        else:
            assert (x.n_shingles, x.component_id, x.kept) == (len(sets[x.doc_id]), comp[x.doc_id], comp[x.doc_id] == x.doc_id)
    assert minhash.near_groups(frame(spark, [])).count() == 0


def test_residual_blocks_find_links(spark, monkeypatch):
    """A chain whose ends are not similar is one component, whatever the block size."""
    monkeypatch.setattr(minhash, "BLOCK", 3)
    base, rows = words(120, 11), []
    for k in range(14):
        copy = base[4 * k :] + [f"z{i}" for i in range(4 * k)]
        rows.append((k, " ".join(copy), "en", "a", "", 0))
    _, comp = brute_components(rows)
    assert {x.doc_id: x.component_id for x in minhash.near_groups(frame(spark, rows)).collect()} == comp


def test_sketch_estimates():
    r = np.random.default_rng(3)
    a = r.integers(0, 2**63, 900).astype(np.uint64)
    b = np.concatenate((a[:800], r.integers(0, 2**63, 100).astype(np.uint64)))
    s = minhash.sketches([np.unique(a), np.unique(b), a[:1], a[:3]])
    assert (s != minhash.EMPTY).all()
    assert abs((s[0] == s[1]).mean() - 0.8) < 0.15


def test_quality_statistics_and_verdicts(spark):
    rows = odd_documents() + [(1000 + k, " ".join(words(80 + k % 90, 100 + k)), "en", "a", "", 0) for k in range(400)]
    rows.append((5000, " ".join(w + "$$$%%%" for w in words(200, 77)), "en", "a", "", 0))
    stats = quality.with_stats(frame(spark, rows), keep=["doc_id", "lang", "source"]).cache()
    for r in stats.collect():
        t = next(x[1] for x in rows if x[0] == r.doc_id) or ""
        w = WORDS.findall(t)
        c = Counter(zip(w, w[1:], w[2:]))
        covered = {i + k for i, g in enumerate(zip(w, w[1:], w[2:])) if c[g] > 1 for k in range(3)}
        lines = [x for x in t.split("\n") if WORDS.search(x)]
        assert (r.q_n_words, r.q_word_chars, r.q_n_symbols) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)))
        assert (r.q_n_dup_lines, r.q_n_repeat_words) == (len(lines) - len(set(lines)), len(covered))
    out = {r.doc_id: r for r in quality.verdicts(stats, quality.fit(stats)).collect()}
    assert not out[5000].q_kept and not out[5000].q_base_failed
    assert out[5].q_base_failed and out[15].q_base_failed and not out[15].q_kept
    assert sum(out[1000 + k].q_kept for k in range(400)) >= 398
    for d, x in brute_distances(stats).items():
        assert out[d].q_distance == pytest.approx(x, rel=1e-6, abs=1e-9) and out[d].q_kept == (x <= quality.HEAVY * quality.chi2_upper(quality.P, quality.TAIL))
    kept = quality.reject_outliers(frame(spark, rows))
    assert kept.columns == frame(spark, rows).columns and kept.where("doc_id = 5000").count() == 0
    assert quality.reject_outliers(frame(spark, [])).count() == 0


def test_quality_joins_of_many_groups_give_the_same(spark, monkeypatch):
    """The salted joins that stand in for broadcasts beyond BROADCAST_GROUPS, with a source of most rows."""
    rows = [(k, " ".join(words(60 + k % 90, k)) + ("" if k % 97 else " $$$%%%" * 80), "en" if k % 5 else None, "a" if k % 3 else "b", "", 0) for k in range(1, 700)]
    rows += [(1000, None, None, None, "", 0), (1001, "", "xx", None, "", 0)]
    stats = quality.with_stats(frame(spark, rows), keep=["doc_id", "lang", "source"]).cache()
    want = {r.doc_id: r for r in quality.verdicts(stats, quality.fit(stats)).collect()}
    monkeypatch.setattr(quality, "BROADCAST_GROUPS", 0)
    got = quality.verdicts(stats, quality.fit(stats)).collect()
    assert len(got) == len(rows) and sum(not r.q_kept for r in got) > 2
    for r in got:
        assert r.q_kept == want[r.doc_id].q_kept and (r.q_distance == want[r.doc_id].q_distance or r.q_distance == pytest.approx(want[r.doc_id].q_distance, rel=1e-6))


def brute_distances(stats):
    """Squared distances of the rows that pass the base rules: the estimates over gathered vectors, group by group."""
    import math

    names = [f"x{i}" for i in range(quality.P)]
    rows = stats.where(~quality._base_failed()).select("doc_id", *[g.alias(f"g{i}") for i, g in enumerate(quality._groups("lang", "source"))], *[v.alias(n) for n, v in zip(names, quality._vector())]).toPandas()
    floor = np.array(list(quality.VECTOR.values())) ** 2

    def floored(c):
        return c + np.diag(np.maximum(0, floor - np.diag(c)))

    def estimate(x):
        steps = np.rint(x / 0.02).astype(int)
        mu = np.array([sorted(c)[math.ceil(len(c) / 2) - 1] for c in steps.T]) * 0.02
        spread = np.array([sorted(abs(c * 0.02 - m))[math.ceil(len(c) / 2) - 1] for c, m in zip(steps.T, mu)])
        cov = floored(np.diag((1.4826 * spread) ** 2))
        for kept in [quality.SHARE] * quality.STEPS + [quality.WITHIN]:
            d = np.einsum("ni,ij,nj->n", x - mu, np.linalg.inv(cov), x - mu)
            b = np.minimum(np.floor(16 * np.log1p(np.maximum(d, 0))), 800)
            upto = sorted(b)[math.ceil(kept * len(b)) - 1] if kept == quality.SHARE else quality._bin(quality.chi2_upper(quality.P, 1 - kept))
            near = x[b <= upto] if (b <= upto).any() else x
            mu, cov = near.mean(0), (near.T @ near) / len(near) - np.outer(near.mean(0), near.mean(0))
            cov = floored(cov * (kept / quality._chi2_cdf(quality.P + 2, quality.chi2_upper(quality.P, 1 - kept))))
        return len(x), mu, cov

    est = {}
    for g in ("g0", "g1", "g2"):
        for key, part in rows.groupby(g):
            est[g, key] = estimate(part[names].to_numpy())
    out = {}
    for r in rows.itertuples():
        (n, mu, cov), (n1, mu1, cov1), (_, mu2, cov2) = est["g0", r.g0], est["g1", r.g1], est["g2", r.g2]
        w, w1 = n / (n + quality.PRIOR), n1 / (n1 + quality.PRIOR)
        mu1, cov1 = w1 * mu1 + (1 - w1) * mu2, w1 * cov1 + (1 - w1) * cov2
        mu, cov = w * mu + (1 - w) * mu1, floored(w * cov + (1 - w) * cov1)
        x = np.array([getattr(r, n) for n in names]) - mu
        out[r.doc_id] = float(x @ np.linalg.inv(cov) @ x)
    return {d: x for d, x in out.items() if d == d}


def brute_targets(sizes, copies=3, weights=(5, 2, 1)):
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    target, left, rest = {}, sum(sizes.values()), set(order)
    while rest:
        total = sum(w[s] for s in rest)
        over = [s for s in rest if left * w[s] / total > copies * sizes[s]]
        if not over:
            return target | {s: left * w[s] / total for s in rest}
        for s in over:
            target[s] = copies * sizes[s]
            left -= target[s]
            rest.discard(s)
    return target


def brute_taken(rows, target, weights=(5, 2, 1)):
    """taken by row number: all copies in order of finish time, cut at the budget and at each source's
    target; then copies behind of at most half of what is missing, as long as some fit."""
    ranked = sorted((s for s in target if s is not None)) + ([None] if None in target else [])
    copies = []
    for rank, s in enumerate(ranked):
        block = Counter()
        for _, source, size, h in rows:
            if source == s and size:
                block[h] += size
        at = 0
        for k in range(mixing.COPIES):
            for h in sorted(block):
                at += block[h]
                copies.append((at / weights[rank % 3], rank, k, h, at, block[h]))
    total, budget, taken = 0, sum(r[2] for r in rows), set()
    for _, rank, k, h, at, words in sorted(copies):
        total += words
        if total > budget:
            break
        if at <= target[ranked[rank]]:
            taken.add((rank, k, h))
    for rank, s in enumerate(ranked):
        mine = [c[2:4] + c[5:] for c in copies if c[1] == rank]
        left = target[s] - sum(words for k, h, words in mine if (rank, k, h) in taken)
        behind = [c for c in mine if (rank, *c[:2]) not in taken]
        while behind:
            bound, over = left / 2, None
            for i, (k, h, words) in enumerate(behind):
                if words <= bound:
                    if words > left:
                        over = i
                        break
                    taken.add((rank, k, h))
                    left -= words
            behind = [] if over is None else behind[over + 1 :]
    times = Counter((rank, h) for rank, _, h in taken)
    return {n: size * times[ranked.index(s), h] for n, (_, s, size, h) in enumerate(rows)}


def test_mixing(spark):
    r = random.Random(2)
    rows = odd_documents() + [(2000 + k, " ".join(["w"] * r.randint(0, 120)), "en", r.choice(["a", "a", "a", "b", "c", "d", None]), "", 0) for k in range(600)]
    rows += [(4000 + k, " ".join(["w"] * 9000), "en", s, "", 0) for k, s in enumerate("bcc")]  # giants
    got = mixing.mix(frame(spark, rows)).collect()
    again = mixing.mix(frame(spark, rows[::-1]).repartition(5)).collect()
    key = lambda x: (x.doc_id or -1, x["size"], x.source or "", x.taken)
    assert len(got) == len(rows) and sorted(map(key, got)) == sorted(map(key, again))
    sizes, taken, target = Counter(), Counter(), {}
    for x in got:
        sizes[x.source] += x["size"]
        taken[x.source] += x.taken
        target[x.source] = x.target
        assert 0 <= x.taken <= 3 * x["size"]
    expected = brute_targets(sizes)
    for s in sizes:
        assert target[s] == pytest.approx(expected[s]) and target[s] - max(40, 0.02 * target[s]) <= taken[s] <= target[s] + 1e-6
    places = {(x.doc_id, x.source, x.n): x.h for x in frame(spark, rows).select("doc_id", "source", F.coalesce(mixing.word_count("text"), F.lit(0)).alias("n"), mixing._place("doc_id", "text").alias("h")).collect()}
    flat = [(x.doc_id, x.source, x["size"], places[x.doc_id, x.source, x["size"]]) for x in got]
    brute = brute_taken(flat, target)
    assert [x.taken for x in got] == [brute[n] for n in range(len(flat))]
    out = mixing.take(frame(spark, rows))
    assert out.columns == frame(spark, rows).columns
    times = Counter((x.doc_id, x.source) for x in out.collect())
    assert times == {k: n for k, n in sum((Counter({(x.doc_id, x.source): x.taken // max(1, x["size"])}) for x in got), Counter()).items() if n}
    order = [x.finish for x in mixing.schedule(frame(spark, rows)).collect()]
    assert order == sorted(order) and sum(x.rows for x in mixing.schedule(frame(spark, rows)).collect()) == sum(times.values())
    assert mixing.mix(frame(spark, [])).count() == 0 and mixing.take(frame(spark, [])).count() == 0
    assert mixing.mix(frame(spark, [(1, None, "en", "a", "", 0)])).first().taken == 0


def test_mixing_in_parts(spark, monkeypatch):
    """Buckets and parts of few rows, a third of all rows alike, texts that never fit before many that do."""
    monkeypatch.setattr(mixing, "PART_ROWS", 40)
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 7)
    r = random.Random(9)
    rows = [(k, " ".join(["w"] * (r.choice([1, 2, 3, 400, 700]))), "en", r.choice("aaabc"), "", 0) for k in range(200)]
    rows += [(7000, "one row many times", "en", "a", "", 0)] * 100 + [(8000, " ".join(["w"] * 60_000), "en", "b", "", 0)]
    docs = frame(spark, rows)
    got = mixing.mix(docs).collect()
    places = {x.doc_id: x.h for x in docs.select("doc_id", mixing._place("doc_id", "text").alias("h")).distinct().collect()}
    flat = [(x.doc_id, x.source, x["size"], places[x.doc_id]) for x in got]
    brute = brute_taken(flat, {x.source: x.target for x in got})
    assert [x.taken for x in got] == [brute[n] for n in range(len(flat))]
    times = Counter()
    for x in got:
        times[x.doc_id] += x.taken // x["size"]
    assert Counter(x.doc_id for x in mixing.take(docs).collect()) == +times
    queue, sources = mixing._queue(docs, "doc_id", "source", "text")[1:]
    assert mixing._ordered(queue, sources).agg(F.max("part")).first()[0] > 5


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def brute_spans(t):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in sorted(out))


def test_secret_base_spans(spark):
    r = random.Random(2)
    bits = ["token", "=", ":", " ", "secret", "api_key", "APIKEY", "'", '"', "abcdef", "AKIA", "ABCDEFGHIJKLMNOP", "0123456789abcdef01234567", "é日🎉", "\n", "x", "password: hunter22", "ſecret=abcdefgh", "toKen=abcdefghi"]
    rows = odd_documents() + [(100 + i, "".join(r.choice(bits) for _ in range(r.randint(0, 14))), "en", "a", "", 0) for i in range(1500)]
    got = secrets.digests(secrets.scan(frame(spark, rows))).collect()
    texts_ = {d: t for d, t, *_ in rows}
    assert len(got) == len(rows)
    for x in got:
        s = brute_spans(texts_[x.doc_id] or "")
        assert x.base_sha256 == hashlib.sha256(s.encode()).hexdigest()
        assert set(s.split(",")) <= set(x.spans.split(",")) | {""}
    assert secrets.scan(frame(spark, [])).count() == 0


def r_token(r, alphabet, n):
    return "".join(r.choice(alphabet) for _ in range(n))


def test_false_discovery_control_equals_brute_force(spark):
    """The cut by bins is the Benjamini-Hochberg step-up over all weighted p-values, one by one."""
    r = random.Random(6)
    tokens = [(r.randint(20, 64), r.choice([0, 0, 0, r.randint(0, 200)])) for _ in range(500)]
    mean = sum(n for n, _ in tokens) / len(tokens)
    score = [e + secrets.weight_bin(n, mean) for n, e in tokens]
    p = sorted(10 ** (-secrets.BIN * s) for s in score)
    k = max((i for i, x in enumerate(p, 1) if x <= secrets.RATE * i / len(p)), default=0)
    by_bin = Counter(score)
    cut = secrets.accepted_bin(by_bin, len(tokens))
    assert k and sum(s >= cut for s in score) == k


def test_secret_randomness_battery(spark):
    r = random.Random(4)
    b62 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    rows = []
    for i in range(60):
        rows.append((i, "key " + "".join(r.choice(b62) for _ in range(44)) + " end", "en", "a", "", 0))
        rows.append((100 + i, "see " + r.choice(["TheQuickBrownFoxJumpsOverTheLazyDogAgain", "getUserNameFromRequestContextHandler2", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaB1", "Verantwortungsbewusstseinsentwicklung"]) + " end", "en", "a", "", 0))
    got = {x.doc_id: x for x in secrets.digests(secrets.scan(frame(spark, rows))).collect()}
    assert sum(got[i].n_random for i in range(60)) >= 48
    assert sum(got[100 + i].n_random for i in range(60)) == 0
    glued = [(500 + i, f"AWS_SECRET_ACCESS_KEYS={r_token(r, b62, 40)}&x=1 ?sig={r_token(r, b62, 44)}&y", "en", "a", "", 0) for i in range(30)]
    glued += [(600 + i, "id " + r_token(r, b62[26:52] + b62[52:], 48) + " or " + r_token(r, "abcdefghijklmnopqrstuvwxyz234567", 56) + "= .", "en", "a", "", 0) for i in range(30)]
    more = {x.doc_id: x for x in secrets.digests(secrets.scan(frame(spark, rows + glued))).collect()}
    assert sum(more[500 + i].n_random for i in range(30)) >= 48 and sum(more[600 + i].n_random for i in range(30)) >= 45
    clean = secrets.redact(frame(spark, rows)).where("doc_id < 60 and text like '%[SECRET]%'")
    assert clean.count() >= 48 and secrets.redact(frame(spark, rows)).count() == len(rows)


def test_repeats_equal_brute_force(spark):
    rows = odd_documents()
    up = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
    split = {d: WORDS.findall((t or "").translate(up)) for d, t, *_ in rows if d is not None}
    where = {}
    for d, w in split.items():
        for k in range(len(w) - 49):
            where.setdefault(tuple(w[k : k + 50]), set()).add(d)
    true = {}
    for d, w in split.items():
        cover = {k + j for k in range(len(w) - 49) if len(where[tuple(w[k : k + 50])]) > 1 for j in range(50)}
        if cover:
            true[d] = len(cover)
    got = {x.doc_id: x.repeated_words for x in repeats.repeated(frame(spark, rows)).collect()}
    assert got == true and {11, 12} <= set(got) and 10 not in got
    assert repeats.repeated(frame(spark, [])).count() == 0


def test_passages_of_many_documents_over_many_partitions(spark):
    passage = words(64, 21)
    rows = [(k, " ".join(words(40, 300 + k, 10**6) + passage + words(30, 900 + k, 10**6)), "en", "a", "", 0) for k in range(120)]
    spark.conf.set("spark.sql.shuffle.partitions", "17")
    try:
        got = repeats.repeated(frame(spark, rows)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(got) == 120 and all(x.spans == "40:104" for x in got)


def test_passages_around_a_popular_core(spark):
    common = words(45, 52)  # its least run stands in the middle: every window's anchor, with a core inside
    rows = [(1000 + k, " ".join(words(60, 2000 + k, 10**6) + common + words(60, 4000 + k, 10**6)), "en", "a", "", 0) for k in range(100)]
    want = {}
    for p in range(20):
        passage = words(8, 6000 + p, 10**6) + common + words(7, 7000 + p, 10**6)
        for side in range(2):
            rows.append((2 * p + side, " ".join(words(30, 8000 + 2 * p + side, 10**6) + passage + words(30, 9000 + 2 * p + side, 10**6)), "en", "a", "", 0))
            want[2 * p + side] = (60, "30:90", 2 * p + 1 - side)
    for n in (4, 17):  # rows of a hash go over the edges of tasks
        spark.conf.set("spark.sql.shuffle.partitions", str(n))
        try:
            got = repeats.repeated(frame(spark, rows)).collect()
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
        assert {x.doc_id: (x.repeated_words, x.spans, x.other_doc_id) for x in got} == want
