import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandwise.llm import nearest


def brute(vectors, queries, k):
    """(query, rank, id, score) by plain cosines over distinct rows; queries: (id, vector)."""
    vectors, out = sorted(set((i, tuple(v)) for i, v in vectors)), []
    for qid in sorted({q for q, _ in queries}):
        q = min(tuple(v) for i, v in queries if i == qid)
        scores = []
        for i, v in vectors:
            if len(v) == len(q) and (i, v) != (qid, q):
                scores.append((-round(math.fsum(a * b for a, b in zip(q, v)) / math.sqrt(math.fsum(a * a for a in q)) / math.sqrt(math.fsum(a * a for a in v)), 12), i))
        out += [(qid, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scores)[:k])]
    return out


def found(df):
    return sorted((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 12)) for r in df.collect())


def plane(r, dims):
    return [float(np.float32(r.gauss(0, 1))) for _ in range(dims)]


@pytest.mark.parametrize("sizes", [{}, {"list_rows": 40, "block_codes": 16, "block_queries": 3}])
def test_search(spark, sizes):
    r = random.Random(2)
    rows = [(i, plane(r, 24)) for i in range(300)]
    rows += [(1000 + i, rows[0][1]) for i in range(60)]  # copies
    rows += [(2000 + i, [x + r.gauss(0, 0.01) for x in rows[5][1]]) for i in range(60)]
    rows += [(3000, None), (3001, [1.0, None]), (3002, [float("nan")] * 24), (3003, [float("inf")] + [0.0] * 23), (None, plane(r, 24)), (3004, []), (3005, [0.0] * 24), (3006, [-0.0] * 24), (3010, [1.0, 2.0]), (3011, [2.0, 4.5]), (3012, [1e100, 1e-100]), (3020, [5.0])]
    rows += [rows[7], rows[10], (20, plane(r, 24))]  # repeated rows, and an id with two vectors
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("v", F.lit("v")).withColumn("score", F.lit(1))
    v = nearest.usable(df)
    usable = [(i, [x + 0.0 for x in e]) for i, e in rows if i is not None and e and all(x is not None and math.isfinite(x) for x in e) and any(e)]
    assert sorted(map(str, [(x["vec_id"], x["v"]) for x in v.collect()])) == sorted(map(str, usable))
    got = found(nearest.search(v, v.filter("vec_id % 10 = 0"), 5, wanted=1.0, deviations=8.0, **sizes))
    assert got == brute(usable, [(i, x) for i, x in usable if i % 10 == 0], 5)


def test_recall(spark):
    """Against brute force, with production parameters and several lists, on vectors without structure (the hardest case) and in clusters."""
    r = np.random.default_rng(1)
    middles = r.normal(size=(20, 48))
    v = np.concatenate((r.normal(size=(3000, 48)), middles[r.integers(0, 20, 3000)] + 0.3 * r.normal(size=(3000, 48))))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, v array<double>")
    got = nearest.search(df, df.filter("vec_id % 50 = 0"), list_rows=500).toPandas()
    u = v / np.linalg.norm(v, axis=1)[:, None]
    hits = 0
    for q, near in got.groupby("query_id"):
        s = u @ u[q]
        s[q] = -2
        assert np.allclose(np.sort(-near["score"]), -s[near.sort_values("rank")["vec_id"]])
        hits += len(set(np.argsort(-s)[:5]) & set(near["vec_id"]))
    assert len(got) == 5 * 120 and hits / len(got) >= 0.97


def test_codes_estimate_within_their_bounds():
    r = np.random.default_rng(5)
    u = nearest.units(r.normal(size=(4000, 40)))
    centre = u[:50].mean(axis=0)
    codes = nearest.Codes.of(u, np.repeat(centre[None], len(u), axis=0))
    assert codes.signs.shape == (4000, nearest.code_bits(40) // 64)
    estimate, error = codes.bounds(u[3], centre, 2.5)
    wrong = np.abs(estimate - u @ u[3]) > error
    assert wrong.mean() < 0.03 and error.mean() < 0.25
    assert np.abs(estimate - u @ u[3]).mean() < 0.08


def test_rotation_keeps_products():
    r = np.random.default_rng(6)
    v = r.normal(size=(10, 20))
    turned = nearest.rotate(v, 64)
    assert np.allclose(turned @ turned.T, v @ v.T)


def test_nothing(spark):
    df = spark.createDataFrame([(1, [1.0])], "vec_id long, v array<double>")
    assert nearest.search(df.limit(0), df.limit(0)).count() == 0
    assert nearest.search(df, df.limit(0)).count() == 0
    assert nearest.search(df, df).count() == 0  # it has no other
