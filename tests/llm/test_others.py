import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import ann, chat, toxicity

from .cases import frame

DATA = "/root/testdata/sf0.001"


def test_ann_recall_ties_and_odd_vectors(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=(1500, 24)) * r.uniform(0.5, 2, size=(1500, 1))
    x[300:700] = x[300]  # one common vector
    rows = [(i, [float(v) for v in x[i]], i) for i in range(1500)]
    rows += [(2000, None, 0), (2001, [0.0] * 24, 0), (2002, [float("nan")] * 24, 0), (2003, [None] * 24, 0), (2004, [1.0, 2.0], 0), (2100, [1.0, 2.5], 0), (2200, [float("inf")] * 24, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    out = ann.search(df, df.where("vec_id % 100 = 0")).collect()
    x = np.array([[np.float32(v) for v in row] for row in x], float)
    hit = total = 0
    for q in range(0, 1500, 100):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        true = np.lexsort((np.arange(1500), d))[:10].tolist()
        mine = sorted((o.rank, o.vec_id, o.score) for o in out if o.query_id == q)
        assert [m[0] for m in mine] == list(range(1, 11)) and all(abs(d[m[1]] - m[2]) < 1e-9 for m in mine)
        assert [m[2] for m in mine] == sorted(m[2] for m in mine)
        hit, total = hit + len(set(true) & {m[1] for m in mine}), total + 10
    assert hit / total >= 0.9
    assert [o.vec_id for o in out if o.query_id == 300] == list(range(301, 311))
    assert [(o.query_id, o.vec_id) for o in out if o.query_id > 1500] == [(2100, 2004)]
    assert ann.search(df.limit(0), df.limit(0)).count() == 0


def test_ann_recall_with_few_shorter_vectors(spark):
    r = np.random.default_rng(5)
    x = np.repeat(r.normal(size=(200, 64)), 20, axis=0) + 0.5 * r.normal(size=(4000, 64))
    x /= np.sqrt((x * x).sum(axis=1))[:, None]
    x[0] *= 0.9  # a query in one batch of many
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>").repartition(8)
    out = ann.search(df, df.where("vec_id % 40 = 0")).collect()
    hit = 0
    for q in range(0, 4000, 40):
        d = ((x - x[q]) ** 2).sum(1)
        d[q] = np.inf
        hit += len(set(np.argsort(d)[:10].tolist()) & {o.vec_id for o in out if o.query_id == q})
    assert hit / 1000 >= 0.97


def near_vectors(n, seed):
    """Rows of 200 clusters, all of length 1."""
    r = np.random.default_rng(seed)
    x = r.normal(size=(200, 64))[r.integers(0, 200, n)] + 0.2 * r.normal(size=(n, 64))
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def test_ann_long_short_and_extreme_vectors_leave_the_others_alone(spark):
    x = near_vectors(4000, 8)
    rows = [(i, v) for i, v in enumerate(x.tolist())]
    rows += [(5001, (50 * x[1]).tolist()), (5002, (1e-3 * x[2]).tolist()), (5003, (x[3] * 1e-170).tolist()), (5100, (1.5 * x[100]).tolist()), (5005, (1e160 * x[5]).tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = ann.search(df, df.where("vec_id % 100 = 0")).collect()
    all_ids, all_x, hit = np.array([i for i, _ in rows]), np.array([v for _, v in rows]), 0
    queries = all_ids[all_ids % 100 == 0]
    for q in queries:
        with np.errstate(over="ignore"):
            d = np.sqrt(((all_x - all_x[all_ids == q][0]) ** 2).sum(1))
        d[all_ids == q] = np.inf
        mine = {o.vec_id: o.score for o in out if o.query_id == q}
        assert len(mine) == 10 and all(abs(d[all_ids == i][0] - s) < 1e-9 for i, s in mine.items())
        hit += len(set(all_ids[np.argsort(d)[:10]].tolist()) & set(mine))
    assert hit / (10 * len(queries)) >= 0.97
    assert next(o.vec_id for o in out if o.query_id == 5100 and o.rank == 1) in range(4000)


def test_ann_share_reranked_falls_with_the_rows():
    shares = []
    for n in (500, 8000):
        x = near_vectors(n, 9)
        first, second = ann.assigned(x)
        met = np.zeros((20, n), bool)
        for i, _, t, firsts, seconds in ann.probed(x[:20], [ann.share(n)]):
            for f, s in zip(firsts, seconds):
                met[i] |= (first[:, t] == f) & np.isin(second[:, t], s)
        true = np.argsort(((x[:20, None] - x[None]) ** 2).sum(2), axis=1)[:, 1:11]
        assert np.mean([met[i, true[i]].mean() for i in range(20)]) >= 0.95
        shares.append(met.mean())
    assert shares[0] < 0.5 and shares[1] < 0.3 and shares[1] < 0.7 * shares[0]


def test_ann_repeated_ids_count_once(spark):
    x = near_vectors(600, 3)
    rows = [(i % 400, v) for i, v in enumerate(x.tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = ann.search(df, df.where("vec_id = 399")).toPandas()
    asker = x[399]  # the id stands once
    best = {}
    for i, v in rows:
        if i != 399:
            best[i] = min(best.get(i, 9.0), float(np.sqrt(((np.array(v) - asker) ** 2).sum())))
    assert len(out) == 10 and out.vec_id.is_unique and all(abs(best[r.vec_id] - r.score) < 1e-9 for r in out.itertuples())


def test_ann_one_rotation_where_axes_are_many():
    x = np.random.default_rng(2).normal(size=(3, 300))
    first, second = ann.assigned(x)
    assert first.max() >= 512 and not second.any()
    assert all(not np.concatenate(s).any() and len(f) == 8 for _, _, _, f, s in ann.probed(x, [1e-6]))


def test_hadamard_is_orthogonal():
    a = np.random.default_rng(0).normal(size=(5, 16))
    assert np.allclose((ann.hadamard(a) ** 2).sum(1), (a**2).sum(1)) and np.allclose(ann.hadamard(ann.hadamard(a)), a)


def brute_pair(chosen, rejected):
    n = 0
    while n < len(chosen) and n < len(rejected) and chosen[n] == rejected[n]:
        n += 1
    show = lambda t: f"<|{t[0]}|>\n{t[1]}<|end|>\n"
    return ["".join(map(show, x)) for x in (chosen[:n], chosen[n:], rejected[n:])]


def test_preferences_equal_brute_force(spark):
    r = random.Random(3)
    rows, pairs = [], []
    for p in range(60):
        common = [(r.choice(["user", "assistant", "system"]), f"t{r.randrange(3)}") for _ in range(r.randrange(4))]
        sides = [common + [(r.choice(["user", "assistant"]), f"é{r.randrange(3)}") for _ in range(r.randrange(3))] for _ in range(2)]
        pairs.append(sides)
        for side, turns in zip(("chosen", "rejected"), sides):
            rows += [(p, side, k, *t) for k, t in enumerate(turns)]
    df = spark.createDataFrame(rows, "pair_id long, side string, turn long, role string, text string").repartition(7)
    got = {x.pair_id: x for x in chat.assembled(chat.segments(df)).collect()}
    for p, (a, b) in enumerate(pairs):
        if not a and not b:
            assert p not in got
            continue
        assert [got[p].prompt, got[p].chosen, got[p].rejected] == brute_pair(a, b)
        for text, mask in ((got[p].chosen, got[p].chosen_mask), (got[p].rejected, got[p].rejected_mask)):
            assert [text[m.start : m.end] for m in mask] == [s.split("|>\n", 1)[1] + "<|end|>\n" for s in text.split("<|end|>\n")[:-1] if s.startswith("<|assistant")]


def test_preferences_odd_turns(spark):
    rows = [(1, "chosen", 0, None, None), (1, "chosen", 0, "user", "b"), (1, "rejected", 0, "unknown", ""), (None, "chosen", 0, "user", "x"), (2, "rejected", None, "user", "x"), (3, "other", 0, "user", "x"), (4, "chosen", 5, "assistant", "only")]
    df = spark.createDataFrame(rows, "pair_id long, side string, turn long, role string, text string")
    got = {x.pair_id: x for x in chat.digests(chat.segments(df)).collect()}
    assert chat.segments(df.withColumns({"part": F.lit(1), "said": F.lit(2), "chosen": F.lit("x"), "split": F.lit(0)})).count() == 2
    assert set(got) == {1, 4} and got[1].prompt_turns == 1 and got[4].chosen_turns == 1 and got[4].chosen_trained == len("only<|end|>\n")
    assert chat.digests(chat.segments(df.limit(0))).count() == 0


def test_swapped_answers_share_a_prompt(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (1, 2, "user", "c"), (1, 3, "assistant", "d" * 50_000), (1, 4, "user", "bye"), (2, 0, "user", "x"), (2, 1, "assistant", "y"), (4, 0, "user", "alone"), (None, 0, "user", "z"), (2, 1, "assistant", "z")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("at", F.lit("clash"))
    show = lambda *t: "".join(f"<|{r}|>\n{x}<|end|>\n" for r, x in t)
    got = {x.pair_id: x for x in chat.assembled(chat.segments(chat.swapped_answers(df))).collect()}
    assert set(got) == {1, 2, 4}
    assert got[1].prompt == show(("user", "a"), ("assistant", "b"), ("user", "c"))
    assert got[1].chosen == show(("assistant", "d" * 50_000), ("user", "bye")) and got[1].rejected == show(("assistant", "y"))
    assert got[1].chosen[got[1].chosen_mask[0].start : got[1].chosen_mask[0].end] == "d" * 50_000 + "<|end|>\n" and len(got[1].chosen_mask) == 1
    assert (got[2].prompt, got[2].chosen, got[2].rejected) == (show(("user", "x")), show(("assistant", "y")), show(("assistant", "")))
    assert got[4].chosen == show(("user", "alone")) and got[4].rejected == got[4].prompt == ""


def test_quotation_marks_and_apostrophes():
    assert not any(toxicity.QUOTES.search(w) for w in ("don’t", "l'eau", "it's", "plain"))
    assert all(toxicity.QUOTES.search(w) for w in ("“so", "‘so", "so’,", "«so»", "'so", "so'"))


def test_automaton_equals_edit_distance():
    terms = {"idiot": 5.0, "loser": 4.0, "scum": 3.0, "pathetic": 2.0}
    trie = toxicity.Trie(terms, {"lowei": 6.0})

    def one_edit(a, b):
        if abs(len(a) - len(b)) > 1:
            return False
        edits = {a[:i] + a[i + 1 :] for i in range(len(a))} | {b} if len(a) > len(b) else {a}
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) <= 1
        if len(a) > len(b):
            return b in {a[:i] + a[i + 1 :] for i in range(len(a))}
        return a in {b[:i] + b[i + 1 :] for i in range(len(b))} or not edits

    r = random.Random(1)
    for _ in range(4000):
        t = list(r.choice(list(terms)))
        for _ in range(r.randrange(3)):
            k = r.randrange(len(t) + 1)
            t[k : k + r.randrange(2)] = r.choice(["", r.choice("abiols")])
        t = "".join(t)
        if t.startswith("lowei") or not t:
            continue
        near = [w for x, w in terms.items() if len(x) >= 5 and one_edit(t, x)]
        got = trie.find(t)
        if t in terms:
            assert got == (0, terms[t])
        else:
            assert got == ((2, max(near)) if near and len(t) >= 4 else None), t
    assert trie.find("loweiheit") == (1, 6.0)


def test_toxicity_learns_and_holds_out(spark):
    r = random.Random(7)
    docs, labels = [], []
    for i in range(900):
        w = [f"word{r.randrange(500)}" for _ in range(60)]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(3):
                w[r.randrange(60)] = r.choice(["zornbag", "flimwit", "grubface", "zornbagg"])
        docs.append((i, " ".join(w), "en", "a", "", 0))
        labels.append((i, 1, int(toxic)))
    docs += [(5000, None, "en", "a", "", 0), (5001, "", "en", "a", "", 0), (None, "flimwit", "en", "a", "", 0)]
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = {x.doc_id: x for x in toxicity.score(frame(spark, docs), lab).collect()}
    import zlib

    assert len(out) == len(docs)
    held = [i for i in range(900) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(out[i].held_out for i in held) and not out[None].held_out
    assert np.mean([out[i].predicted == int(i % 5 == 0) for i in held]) >= 0.97
    assert out[5000].score == out[5001].score and out[5000].predicted == 0 and all(0 <= x.score <= 1 for x in out.values())
    flipped = lab.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = {x.doc_id: x.score for x in toxicity.score(frame(spark, docs), flipped).collect()}
    assert all(abs(again[i] - out[i].score) < 1e-12 for i in range(900))  # labels of held-out rows say nothing
    twice = toxicity.score(frame(spark, docs + docs[:50] + [(1, "another " * 200_000, "en", "a", "", 0)]).withColumns({"toxic": F.lit("x"), "half": F.lit(1)}), lab.union(lab.limit(50))).collect()
    assert len(twice) == len(docs) + 51 and toxicity.score(frame(spark, []), lab).count() == 0
    empty = toxicity.score(frame(spark, docs[:5]), lab.limit(0)).collect()
    assert len(empty) == 5 and all(x.predicted == 0 for x in empty)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_queries_with_sql(spark):
    import duckdb

    from millrace.llm import queries

    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{DATA}/{f}'")
    for name, sql in queries.ORACLE.items():
        df = queries.QUERIES[name](spark, DATA)
        want = con.sql(sql)
        assert sorted(map(str, (tuple(r[c] for c in want.columns) for r in df.collect()))) == sorted(map(str, want.fetchall()))


def test_queries_import_without_touching_the_catalog():
    from millrace.llm import queries

    assert {n.split("_")[0] for n in queries.QUERIES} == {f"op{i}" for i in range(1, 14)}
