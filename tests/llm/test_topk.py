import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strandwise.llm import topk


def brute(vectors, queries, k):
    out = []
    for qid in sorted({q for q, _ in queries}):
        q = min(v for i, v in queries if i == qid)
        scores = sorted((-sum(a * b for a, b in zip(q, v)), i) for i, v in vectors if i != qid and len(v) == len(q))[:k]
        out += [(qid, r + 1, i, -s) for r, (s, i) in enumerate(scores)]
    return sorted(out)


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 5).flatmap(lambda d: st.lists(st.lists(st.integers(-70, 70), min_size=d, max_size=d), min_size=1, max_size=90)), st.integers(1, 12))
def test_index(vectors, k):
    v = np.array(vectors, np.int64)
    index = topk.BitSlicedIndex(v)
    ids = np.arange(len(v)) * 2
    for q in (0, len(v) - 1):
        found, scores = topk.top_k(index, ids, v[q], int(ids[q]), k)
        wanted = sorted((-int(v[i] @ v[q]), int(ids[i])) for i in range(len(v)) if i != q)[:k]
        assert sorted(zip([-x for x in scores], found.tolist())) == wanted


@pytest.mark.parametrize("block_rows,block_queries", [(topk.BLOCK_ROWS, topk.BLOCK_QUERIES), (16, 4)])
def test_search(spark, block_rows, block_queries):
    r = random.Random(8)
    rows = [(i, [r.gauss(0, 0.3) for _ in range(6)]) for i in range(120)]
    rows += [(200 + i, rows[0][1]) for i in range(40)]  # many ties
    rows += [(300, None), (301, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (302, [float("nan")] * 6), (303, [float("inf")] + [0.0] * 5), (None, [0.0] * 6), (304, []), (305, [1.0, 2.0]), (310, [3.0, -1.0])]
    rows.append(rows[7])  # a repeated row
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumnRenamed("vec_id", "vec_id")
    v = topk.quantised(df)
    floors = {i: [int(np.floor(64 * float(np.float32(x)))) for x in e] for i, e in rows if i is not None and e and all(x is not None and np.isfinite(x) for x in e)}
    vectors = [(i, floors[i]) for i, _ in rows if i in floors]
    assert sorted((x["vec_id"], topk.integers(np.array([x["v"]]))[0].tolist()) for x in v.collect()) == sorted(vectors)
    found = topk.search(v, v.filter("vec_id % 10 = 0"), 7, block_rows, block_queries)
    assert sorted(map(tuple, found.drop("exact").collect())) == brute(vectors, [(i, x) for i, x in vectors if i % 10 == 0], 7)


def test_numbers_of_any_size(spark):
    """No component is clamped and ranks follow exact scores, though they fit no long."""
    from fractions import Fraction
    from math import floor

    r = random.Random(3)
    scale = [1.0, 1e6, 3e5, 1e14, 1e30, -1e30, 1e300, 1.7e308, 6e5, 5e-324]
    rows = [(i, [r.choice(scale) * r.choice([1, -1, r.random()]) for _ in range(3)]) for i in range(60)]
    rows += [(100, [300000.0, 0.0, 0.0]), (101, [600000.0, 0.0, 0.0]), (110, [1.0, 0.0, 0.0]), (110, [-1.0, 0.5, 0.0])]
    exact = [(i, [floor(Fraction(x) * 64) for x in v]) for i, v in rows]
    df = topk.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    found = topk.search(df, df.filter("vec_id % 10 = 0"), 9, 16, 8).collect()
    assert sorted((x["query_id"], x["rank"], x["vec_id"], int(x["exact"])) for x in found) == brute(exact, [(i, v) for i, v in exact if i % 10 == 0], 9)
    assert all(x["score"] == max(min(int(x["exact"]), 2**63 - 1), -(2**63)) for x in found)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(-(1 << 200), 1 << 200) | st.integers(-300, 300), min_size=2, max_size=6))
def test_sort_key(numbers):
    assert sorted(numbers, key=topk.sort_key) == sorted(numbers)


def test_empty(spark):
    v = topk.quantised(spark.createDataFrame([], "vec_id long, embedding array<float>"))
    assert topk.search(v, v).count() == 0
    one = topk.quantised(spark.createDataFrame([(20, [1.0])], "vec_id long, embedding array<float>"))
    assert topk.search(one, one).count() == 0
