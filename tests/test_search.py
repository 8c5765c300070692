"""Searches for strings: hashed anchors and backward search against plain loops."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strandwise.operators import anchors, backward

from .test_engine import rows

TEXTS = ["banana bandana", "", "ananas", "aaaaaaaaaaaa", "ñaé😀ñaé", "the theme of the thesis", "zebra" * 9]


def occurrences(texts, patterns):
    return sorted((p, d, i) for p in set(patterns) if p for d, t in enumerate(texts) for i in range(len(t)) if t.startswith(p, i))


def pattern_table(spark, patterns):
    return spark.createDataFrame([(p,) for p in patterns], "pattern string")


def many(seed):
    r = random.Random(seed)
    out = [t[i : i + n] for t in TEXTS for n in (1, 2, 3, 5, 7, 11, 14, 40) for i in (r.randrange(len(t) + 1),)]
    return [*out, "", "zz", "thesis!", "q", "a", "a", "x" * 80, "zebra" * 9, "zebra" * 8 + "zebrb"]


@pytest.mark.parametrize("lot", [1 << 19, 5])
def test_anchors(spark, docs_of, monkeypatch, lot):
    monkeypatch.setattr(anchors, "LOT", lot)
    few, docs = ["an", "ana", "é😀", "zz"], docs_of(TEXTS)
    assert rows(anchors.locate(docs, pattern_table(spark, few)), "pattern", "doc", "idx") == occurrences(TEXTS, few)
    assert rows(anchors.locate(docs, pattern_table(spark, many(1))), "pattern", "doc", "idx") == occurrences(TEXTS, many(1))
    assert anchors.locate(docs, pattern_table(spark, [""])).count() == 0
    assert anchors.locate(docs_of([""]), pattern_table(spark, few)).count() == 0


def test_shuffled_anchors(spark, docs_of, monkeypatch):
    monkeypatch.setattr(anchors, "BROADCAST_ROWS", 2)
    assert rows(anchors.locate(docs_of(TEXTS), pattern_table(spark, many(2))), "pattern", "doc", "idx") == occurrences(TEXTS, many(2))


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 0x10FFFF), max_size=60), st.integers(1, 9))
def test_hashes_tell_windows_apart(points, width):
    p = np.array(points + points[:20], np.int64)
    h = anchors.window_hashes(p, width)
    windows = [tuple(p[i : i + width].tolist()) for i in range(len(p) - width + 1)]
    assert len(h) == len(windows)
    assert len(set(zip(h.tolist(), windows))) == len(set(h.tolist())) == len(set(windows))


@pytest.mark.parametrize("block", [4, None])
def test_backward_search(spark, docs_of, monkeypatch, block):
    monkeypatch.setattr(backward, "LISTED", 3)
    index, asked = backward.build(docs_of(TEXTS), block), [p for p in many(3) if len(p) < 9]
    found = occurrences(TEXTS, asked)
    assert rows(backward.locate(index, pattern_table(spark, asked)), "pattern", "doc", "idx") == found
    assert rows(backward.count(index, pattern_table(spark, asked)), "pattern", "n") == sorted((p, sum(f[0] == p for f in found)) for p in set(asked) if p)


@pytest.mark.parametrize("prefix,depth", [("a", 2), ("", 1), ("thesis", 1)])
def test_refine(docs_of, prefix, depth):
    ranked = sorted((t[i:], d, i) for d, t in enumerate(TEXTS) for i in range(len(t)))
    expected: dict = {}
    for k, (s, _, _) in enumerate(ranked):
        if s.startswith(prefix):
            expected.setdefault(s[len(prefix) : len(prefix) + depth], []).append(k)
    found = backward.refine(backward.build(docs_of(TEXTS), 8), prefix, depth)
    assert rows(found, "extension", "first", "last") == sorted((e, v[0], v[-1]) for e, v in expected.items())


def test_index_of_nothing(spark, docs_of):
    index = backward.build(docs_of([""]))
    assert rows(backward.count(index, pattern_table(spark, ["a"])), "pattern", "n") == [("a", 0)]


def test_last_known_over_ranges(spark, docs_of):
    """As-of lookups, with documents over many ranges and ranges without known rows."""
    from strandwise.operators import matching

    r = random.Random(4)
    known = sorted({(d, r.randrange(400)) for d in (0, 0, 0, 1, 5) for _ in range(12)})
    asked = [(d, q) for d in (0, 1, 2, 5) for q in range(0, 420, 3)]
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        k = spark.createDataFrame([(d, i, f"{d}-{i}", i * 10 if i % 3 else None) for d, i in known], "doc long, idx long, name string, n long")
        found = rows(matching.as_of(spark.createDataFrame(asked, "doc long, q long"), k, ["name", "n"]), "doc", "q", "name", "n")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    expected = []
    for d, q in asked:
        i = max((i for e, i in known if e == d and i <= q), default=None)
        expected.append((d, q, None, None) if i is None else (d, q, f"{d}-{i}", i * 10 if i % 3 else None))
    assert found == sorted(expected, key=lambda x: x[:2])
