import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandwise.llm import lexical

ITEMS = [(1, "the not with von über"), (2, "the the the!"), (3, "nothing zzzz9"), (4, None), (5, ""), (6, " ,.;"), (7, "İstanbul ﬁn endoftext x"), (None, "und der"), (8, "tail id 456")]


def words(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower)


def brute(documents, items, k):
    docs = [(d, c, sum(c.values())) for d, c in ((d, Counter(words(t))) for d, t in documents) if c]
    n_docs, all_terms = len(docs), sum(n for _, _, n in docs)
    df = Counter(t for _, c, _ in docs for t in c)
    out = []
    for item, text in items:
        scored = []
        for d, c, n in docs:
            m = 100 - 25 + ((25 * n * n_docs) // all_terms)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t in words(text) if t in c)
            if score > 0:
                scored.append((-score, d is None, d or 0, d))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("pairs", [lexical.BLOCK_PAIRS, 6])
def test_search(spark, corpus, pairs):
    rows, docs = corpus
    items = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("score", F.lit(1)).withColumn("rank", F.lit("x"))
    docs = docs.withColumn("term", F.lit(0)).withColumn("n", F.lit("n")).withColumn("item_id", F.lit(5))
    found = lexical.search(docs, items, 9, pairs)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, found.collect()), key=str) == brute([(r[0], r[1]) for r in rows], ITEMS, 9)


def test_items_of_one_id_and_empty_tables(spark, corpus, empty):
    docs = corpus[1]
    items = spark.createDataFrame([(1, "the"), (1, "der"), (1, "der")], "item_id long, text string")
    one = spark.createDataFrame([(1, "der")], "item_id long, text string")
    assert sorted(map(tuple, lexical.search(docs, items).collect())) == sorted(map(tuple, lexical.search(docs, one).collect())) != []
    assert lexical.search(empty, one).count() == 0
    assert lexical.search(docs, one.limit(0)).count() == 0
    assert lexical.search(docs.withColumn("text", F.lit(None).cast("string")), one).count() == 0


def test_many_ties(spark):
    docs = spark.createDataFrame([(i, "same words here") for i in range(500, 0, -1)], "doc_id long, text string").repartition(5)
    items = spark.createDataFrame([(1, "words")], "item_id long, text string")
    assert [r["doc_id"] for r in lexical.search(docs, items).orderBy("rank").collect()] == []  # a term of all documents weighs nothing here
    more = docs.union(spark.createDataFrame([(1000 + i, "other") for i in range(400)], docs.schema))
    assert [r["doc_id"] for r in lexical.search(more, items).orderBy("rank").collect()] == list(range(1, 21))


def test_product_is_that_of_dense_matrices():
    r = random.Random(4)
    a, b = np.array([[r.choice([0, 0, 1, 3]) for _ in range(12)] for _ in range(7)]), np.array([[r.choice([0, 0, 0, 5, 1 << 40]) for _ in range(30)] for _ in range(12)])
    import pyarrow as pa

    i, t = np.nonzero(a)
    block = lexical.ItemBlock(pa.table({"item_id": i, "term": [f"{x:02d}" for x in t], "mult": a[i, t]}))
    kept = [int(x) for x in block.terms]
    terms, docs = np.nonzero(b[kept])
    got = np.zeros((len(block.items), 30), np.int64)
    for row, hit, scores in lexical.product(block, terms, docs, b[kept][terms, docs], 30):
        got[row, hit] = scores
    assert (got == (a @ b)[block.items]).all()


def test_impacts_of_huge_texts():
    """What fits no 64 bits on the way is still exact."""
    big = np.array([1 << 40, 7], np.int64)
    got = lexical.impacts(np.array([5, 5]), np.array([3, 1]), big, 1 << 30, 1 << 50)
    assert got.tolist() == [5 * (10**9 * 3 // (3000 + 12 * (75 + (25 * int(big[0]) * (1 << 30)) // (1 << 50)))), 5 * (10**9 // (1000 + 12 * (75 + (25 * 7 * (1 << 30)) // (1 << 50))))]
