import random

import pytest

import corpus_pipeline as p
from strandwise.llm import near_copies as n
from strandwise.llm import simhash


def sets(text):
    words = (text or "").lower().split()
    k = min(5, len(words))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if words else set()


def similar(a, b):
    a, b = sets(a), sets(b)
    return 5 * len(a & b) >= 4 * len(a | b)


def plain(rows):
    """Smallest id by text's place, over all pairs."""
    root = list(range(len(rows)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(rows):
        for j in range(i):
            if similar(a[1], rows[j][1]):
                root[top(i)] = top(j)
    groups = {}
    for i, (doc, _) in enumerate(rows):
        groups.setdefault(top(i), []).append(doc)
    return sorted((doc, min(groups[top(i)])) for i, (doc, _) in enumerate(rows))


@pytest.fixture(scope="module")
def rows():
    r = random.Random(7)
    out = []
    for _ in range(60):
        words = [f"w{r.randrange(5000)}" for _ in range(r.randint(30, 300))]
        out.append(words)
        for _ in range(r.randint(0, 4)):  # similarities on both sides of 0.8
            near = list(words)
            for at in r.sample(range(len(near)), max(1, int(len(near) * r.choice([0.005, 0.01, 0.02, 0.03])))):
                near[at] = f"x{r.randrange(5000)}"
            out.append(near)
    texts = [" ".join(x) for x in out] + [out[0][0].upper() + " " + " ".join(out[0][1:]), None, "", "one", "One", "one two", "a b c d e", "a b c d f"]
    r.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("hot", [n.HOT_BUCKET, 300])
def test_all_pairs(spark, rows, hot):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(map(tuple, n.near_copies(df, hot=hot).select("doc_id", "component_id").collect())) == plain(rows)


def test_stage_drops_copies_far_apart_in_simhash(spark, rows):
    far = [(a, b) for i, (_, a) in enumerate(rows) for _, b in rows[:i] if similar(a, b) and (simhash.fingerprint(a) ^ simhash.fingerprint(b)).bit_count() > 3]
    assert far
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = p.near_dedup(spark, df, "").collect()
    assert sorted(x["doc_id"] for x in kept) == sorted({c for _, c in plain(rows)})


def test_odd_rows(spark, corpus, empty):
    assert n.near_copies(empty).count() == 0
    assert n.near_copies(corpus[1]).count() == len(corpus[0])


def test_columns_by_the_names_of_own_ones(spark, corpus):
    """Columns of documents may have any names that operators and stages use themselves."""
    import corpus_pipeline
    from pyspark.sql import functions as F

    own = ("_doc", "_hash", "_l", "_row", "_own", "_id", "_text", "_d", "_h", "_n", "id", "hash", "key", "bucket", "bands", "lang_pred", "accepted", "_trusted", "_trains", "spans", "root", "rank", "size", "start", "n")
    docs = corpus[1].filter("doc_id IS NULL OR doc_id NOT IN (7, 13)")
    clashing = docs.withColumns({c: F.lit(k) for k, c in enumerate(own)})
    for name, stage in corpus_pipeline.STAGES[:3]:
        plain, same = stage(spark, docs, ""), stage(spark, clashing, "")
        assert same.columns == clashing.columns, name
        assert sorted(map(str, same.select(plain.columns).collect())) == sorted(map(str, plain.collect())), name
        assert same.select(*own).distinct().count() == 1, name


def test_stage_takes_simhash(spark, rows, monkeypatch):
    """Near copies within the bits of SimHash are found by it alone, without any band of MinHash."""
    import numpy as np

    docs = spark.createDataFrame(rows, "doc_id long, text string")
    prints = [simhash.simhash(n.shingles(t)) for _, t in rows]
    within = lambda a, b: similar(rows[a][1], rows[b][1]) and (prints[a] ^ prints[b]).bit_count() <= 3
    pairs = [(rows[a][0], rows[b][0]) for a in range(len(rows)) for b in range(a) if within(a, b) and sets(rows[a][1]) != sets(rows[b][1])]
    assert pairs
    monkeypatch.setattr(n, "buckets", lambda found: np.zeros(0, np.int64))
    of = dict(map(tuple, n.near_copies(docs).select("doc_id", "component_id").collect()))
    assert all(of[a] == of[b] for a, b in pairs)


def test_simhash_of_hashes():
    text = "a b c d e f g"
    assert simhash.simhash(n.shingles(text, 3)) == simhash.fingerprint(text, 3)
