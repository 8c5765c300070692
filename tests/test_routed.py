"""Matching by routing to ranges of a reference's suffix array against plain loops."""

import random

import pytest

from strandwise.operators import routed

from .test_engine import brute_match, rows


def data():
    r = random.Random(7)
    unit = "".join(r.choice("abc") for _ in range(40))
    parts = ["abracadabra", unit, "", "zz" + unit[10:30] + "é😀", unit + "ab"]
    ref = "".join(parts)
    return parts, ref, ["cadabrac", "", "zzz", unit + unit, unit[5:35] + "q" + unit, ref, ref[20:70] + "é", "".join(r.choice("ab") for _ in range(40)), "é😀", "\x00a"]


@pytest.mark.parametrize("width,size", [(32, 1 << 16), (2, 8)])
def test_matching(docs_of, width, size):
    """The second case crosses ranges and doubles intervals four times."""
    parts, ref, texts = data()
    index = routed.build(docs_of(parts), width, size)
    expected = []
    for d, t in enumerate(texts):
        for i in range(len(t)):
            pos, n, smaller = brute_match(ref, t[i:])
            expected.append((d, i, pos, n, smaller, t[i + n : i + n + 1] or None))
    assert sorted(map(tuple, routed.matching_statistics(index, docs_of(texts)).collect())) == sorted(expected)


def test_pieces(docs_of, monkeypatch):
    texts = ["", "abc", "d", "", "efghijk", "é" * 9]
    whole = "".join(texts)
    for step in (1, 4, 100):
        found = rows(routed.pieces(docs_of(texts), step, 3), "start", "own", "text")
        assert found == [(a, min(step, len(whole) - a), whole[a : a + step + 3]) for a in range(0, len(whole), step)]


def test_no_reference(docs_of):
    with pytest.raises(ValueError):
        routed.build(docs_of([""]))
