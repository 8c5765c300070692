import collections
import random

import pytest
from pyspark.sql import functions as F

from strandwise.llm import mixing


def plain_targets(sizes, weights, total, most):
    """Rounds of clamping and sharing anew."""
    full, left = set(), dict(weights)
    while True:
        rest = total - sum(most * sizes[s] for s in full)
        share = {s: rest * w / sum(left.values()) for s, w in left.items()} if left else {}
        over = {s for s, t in share.items() if t >= most * sizes[s]}
        if not over:
            break
        full |= over
        left = {s: w for s, w in left.items() if s not in over}
    return {s: most * sizes[s] if s in full else share[s] for s in weights}


@pytest.mark.parametrize("seed", range(4))
def test_targets(spark, seed):
    r = random.Random(seed)
    sizes = {f"s{i}": r.choice([0, 1, 10, 100, 1000, 20_000]) for i in range(9)}
    weights = {s: float(r.randint(1, 5)) for s in sizes}
    df = spark.createDataFrame([(s, sizes[s], weights[s]) for s in sizes], "source string, source_size long, weight double")
    found = {x["source"]: x["target"] for x in mixing.targets(df).collect()}
    expected = plain_targets(sizes, weights, sum(sizes.values()), 3)
    assert all(abs(found[s] - expected[s]) <= 1e-6 * (1 + expected[s]) for s in sizes)


def test_mix(spark, corpus, empty):
    rows, df = corpus
    df = df.withColumn("size", F.lit("clash"))
    out = mixing.mix(df).collect()
    assert len(out) == len(rows)
    size = lambda t: len((t or "").encode().split())
    sizes = collections.Counter()
    for r in rows:
        sizes[r[3]] += size(r[1])
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    expected = plain_targets(sizes, {s: float(i % 3 + 1) for i, s in enumerate(order)}, sum(sizes.values()), 3)
    taken = collections.Counter()
    for x in out:
        assert x["source_size"] == sizes[x["source"]] and abs(x["target"] - expected[x["source"]]) < 1e-6 * (1 + x["target"])
        assert x["taken"] == x["repeats"] * x["size"] <= 3 * x["size"]
        taken[x["source"]] += x["taken"]
    largest = collections.Counter()
    for x in out:
        largest[x["source"]] = max(largest[x["source"]], x["size"])
    assert all(abs(taken[s] - expected[s]) <= largest[s] for s in sizes)
    again = mixing.mix(df.repartition(5)).collect()
    key = lambda x: (x["doc_id"] is not None, x["doc_id"] or 0, x["size"], x["taken"])
    assert sorted(map(key, out)) == sorted(map(key, again))
    assert mixing.mix(empty).count() == 0


def test_a_hot_source_is_near_its_target(spark):
    df = spark.range(6000).select(F.col("id").alias("doc_id"), F.expr("repeat('w ', cast(id % 40 as int) + 1)").alias("text"), F.when(F.col("id") % 3 == 0, "rare").otherwise("hot").alias("source"))
    rows = mixing.mix(df).groupBy("source").agg(F.sum("taken").alias("t"), F.max("target").alias("g")).collect()
    assert all(abs(r["t"] - r["g"]) <= 40 for r in rows)


def test_given_weights_and_no_words(spark):
    df = spark.createDataFrame([(1, "a b", "x"), (2, None, "y"), (3, "c d", "z")], "doc_id long, text string, source string")
    weights = spark.createDataFrame([("x", 1.0), ("z", 1.0)], "source string, weight double")
    out = {r["doc_id"]: (r["taken"], r["target"]) for r in mixing.mix(df, weights).collect()}
    assert out == {1: (2, 2.0), 2: (0, 0.0), 3: (2, 2.0)}


def test_repeats_are_rows(spark):
    """Rows that share an id are repeated each as its own plan says, and a source's words stay near its target."""
    rows = [(1, "a b", "x", 7), (1, "a b", "x", 8), (1, "c", "x", 9), (None, "d e f", "x", 1), (None, None, None, 2), (3, " ".join("w" * 40), "y", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, repeats long")
    out = mixing.repeat_documents(df)
    assert out.columns == df.columns
    found = sorted(map(str, out.collect()))
    assert found == sorted(map(str, mixing.repeat_documents(df.repartition(3)).collect()))
    words = sum(len((r["text"] or "").split()) for r in out.collect() if r["source"] == "x")
    assert words == sum(r["size"] for r in mixing.mix(df).filter("source = 'x'").select((F.col("taken")).alias("size")).collect())
