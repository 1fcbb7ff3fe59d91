"""Resolution over the whole feed against brute force on the smallest tables."""

import os
import re
from collections import defaultdict

import pytest

from millrace import more_queries  # noqa: F401
from millrace.queries import QUERIES, cleaned

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def similarity(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return 200.0 * row[-1] / (len(a) + len(b))


def expected(rows):
    """By misspelt name: score, raw and manufacturer of the best known name."""
    makers = defaultdict(set)
    for r in rows:
        if (r.Part_Manuf or "").startswith("Supplier"):
            makers[r.Part_Manuf].add(r.manufacturer)
    known = {raw: min(m) for raw, m in makers.items() if len(m) == 1}
    bare = lambda s: re.sub(r"\s*\([^)]*\)\s*$", "", s).strip()
    names = {r.Part_Manuf for r in rows if (r.Part_Manuf or "").startswith("Suplier")}
    best = {n: min(((-similarity(bare(n), bare(raw)), raw, m) for raw, m in known.items()), default=(0, "", "")) for n in names}
    return {n: (round(-s, 6), raw, m) for n, (s, raw, m) in best.items() if s <= -70}, makers


def test_every_misspelt_name_is_resolved(spark):
    want, _ = expected(cleaned(spark, DATA).collect())
    got = {r.name: (round(r.score, 6), r.raw, r.manufacturer) for r in QUERIES["resolve_similar"](spark, DATA).collect()}
    assert got == want


def test_cascade_covers_every_row(spark):
    rows = cleaned(spark, DATA).collect()
    want, makers = expected(rows)
    out = {r.seq: r for r in QUERIES["resolve_cascade"](spark, DATA).collect()}
    assert sorted(out) == sorted(r.seq for r in rows)
    near = 0
    for r in rows:
        o = out[r.seq]
        if r.Part_Manuf in want:
            score, raw, maker = want[r.Part_Manuf]
            near += 1
            assert (round(o.match_score, 6), o.matched_raw, o.manufacturer_name) == (score, raw, maker)
            assert o.status == ("RESOLVED" if score >= 85 else "NEEDS_REVIEW") and o.domain
        elif len(makers.get(r.Part_Manuf, ())) > 1:
            assert o.status == "NEEDS_DISAMBIGUATION" and o.candidates == "|".join(sorted(makers[r.Part_Manuf]))
    assert near
