"""Suffix order by difference covers, every level and split forced, and the linear check of orders."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandwise.operators import cover, validate

from .test_engine import TEXTS, brute, rows


def texts():
    r = random.Random(5)
    long = "".join(r.choice("ab") for _ in range(400))
    out = [t or "" for t in TEXTS] + [long, long, long[:250] + "q" + long[250:], long[90:], "a" * 100]
    out += ["".join(r.choice("abé😀\x00") for _ in range(r.randint(0, 90))) for _ in range(30)]
    return out + ["a passage of over thirty-one symbols in many documents"] * 9


@pytest.mark.parametrize("c", [cover.TEXT_COVER, cover.NAME_COVER])
def test_covers_meet(c):
    assert {(a - b) % c.period for a in c.residues for b in c.residues} == set(range(c.period))
    for r in range(c.period):
        for s in range(c.period):
            step = c.offsets[r, c.meeting[r, s]]
            assert step == c.offsets[s, c.meeting[s, r]] and (r + step) % c.period in c.residues and (s + step) % c.period in c.residues


@pytest.mark.parametrize("terminators,sizes", [(False, {}), (False, {"base": 40}), (True, {"base": 20, "bound": 6})])
def test_suffix_ranks(docs_of, terminators, sizes):
    found = cover.suffix_ranks(docs_of(texts()), terminators, **sizes)
    assert rows(found, "rank", "idx", "doc") == brute(texts(), terminators)


def test_keys_that_go_over_several_ranges(docs_of, monkeypatch):
    monkeypatch.setattr(cover, "RANGE_ROWS", 40)
    monkeypatch.setattr(cover, "LOT", 64)
    monkeypatch.setattr(cover, "BLOCK", 64)
    given = ["x" * 90] * 5 + texts()[:8]
    assert rows(cover.suffix_ranks(docs_of(given), base=10), "rank", "idx", "doc") == brute(given)


def test_wide_alphabets_and_odd_numbers(docs_of):
    r = random.Random(9)
    given = [(d, "".join(chr(r.choice([0, 65, 300 + d % 50, 0x1F600])) for _ in range(70))) for d in (-(1 << 62), -3, 0, 7, 1 << 62)]
    given += [(100 + k, "".join(chr(0x4E00 + 40 * k + j) for j in range(40))) for k in range(10)]
    wanted = sorted((t[i:], d, i) for d, t in given for i in range(len(t)))
    assert rows(cover.suffix_ranks(docs_of(given)), "rank", "idx", "doc") == [(k, i, d) for k, (_, d, i) in enumerate(wanted)]


def test_nothing(docs_of):
    assert cover.suffix_ranks(docs_of([""])).count() == 0
    assert cover.suffix_ranks(docs_of([]).limit(0)).count() == 0
    assert rows(cover.suffix_ranks(docs_of(["", ""]), True), "rank", "idx", "doc") == [(0, 0, 0), (1, 0, 1)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2), min_size=1, max_size=70), st.sampled_from([cover.TEXT_COVER, cover.NAME_COVER]))
def test_places(symbols, c):
    """Rows of one group, with the true ranks of the covered places of their windows."""
    text = symbols * 2 + [9] * c.period
    order = sorted(range(len(text)), key=lambda i: text[i:])
    rank = {i: k for k, i in enumerate(order)}
    # suffixes that share a window, as tied ones do
    same = [i for i in range(len(text) - c.period) if text[i : i + c.period] == text[: c.period]]
    residue = np.array([i % c.period for i in same])
    s = np.array([[rank[i + step] for step in c.offsets[i % c.period]] for i in same])
    got = cover.places(c, np.zeros(len(same), np.int64), residue, s)
    assert [same[k] for k in np.argsort(got)] == sorted(same, key=lambda i: rank[i])


def test_linear_check(spark, docs_of):
    docs = docs_of(texts())
    good = spark.createDataFrame(brute(texts()), "rnk long, idx long, doc long")
    n = good.count()
    assert rows(validate.check_linear(docs, good), "n", "violations", "missing") == [(n, 0, 0)]
    r = random.Random(1)
    for _ in range(3):  # two neighbours changed round
        k = r.randrange(n - 1)
        swapped = good.withColumn("rnk", F.when(F.col("rnk") == k, k + 1).when(F.col("rnk") == k + 1, k).otherwise(F.col("rnk")))
        assert validate.check_linear(docs, swapped).first()["violations"] > 0
    assert validate.check_linear(docs, good.filter("rnk <> 5")).first()["missing"] > 0
    assert validate.check_linear(docs, good.union(good.filter("rnk = 5"))).first()["missing"] > 0
    assert validate.check_linear(docs, good.withColumn("rnk", F.col("rnk") + F.when(F.col("rnk") >= 9, 1).otherwise(0))).first()["missing"] > 0
    found, old = (f(docs, good).first() for f in (validate.check_linear, validate.check_order))
    assert tuple(found) == tuple(old)


def test_prefixes_within_the_first_sort(docs_of, monkeypatch):
    """Prefixes that the sort has seen ask for no texts; longer ones are those of plain loops, whatever the ranges."""
    import random

    from strandwise.operators import cover, irreducible

    def plain(texts):
        order = sorted((t[i:], d, i) for d, t in enumerate(texts) for i in range(len(t)))
        out = []
        for r, (s, d, i) in enumerate(order):
            n, before = 0, order[r - 1][0] if r else ""
            while n < min(len(s), len(before)) and s[n] == before[n]:
                n += 1
            out.append((r, i, d, n))
        return out

    r = random.Random(5)
    unit = "".join(r.choice("abc") for _ in range(50))
    long = ["", unit, unit + unit, "x" + unit, unit[10:] + "é😀" + unit, "a" * 80, unit[:31], unit[:31], "z" + unit[:32]]
    for rows in (1 << 18, 40):
        monkeypatch.setattr(cover, "RANGE_ROWS", rows)
        assert sorted(map(tuple, cover.suffix_prefixes(docs_of(long), base=50, bound=30).collect())) == plain(long)
    short = ["banana", "", "nan", "ananas é", "nan"] * 3
    monkeypatch.setattr(irreducible, "compare", None)
    assert sorted(map(tuple, cover.suffix_prefixes(docs_of(short)).collect())) == plain(short)
