"""Matching against a reference that tasks hold, against plain loops; nothing of it is shuffled."""

import random

import numpy as np
import pytest

from strandwise.functions import kernels
from strandwise.operators import held, matching

from .test_engine import brute_match
from .test_routed import data


def expected(ref, texts):
    out = []
    for d, t in enumerate(texts):
        for i in range(len(t)):
            pos, n, smaller = brute_match(ref, t[i:])
            out.append((d, i, pos, n, smaller, t[i + n : i + n + 1] or None))
    return out


@pytest.mark.parametrize("lot", [1, 1 << 18])
def test_matching(docs_of, lot, monkeypatch):
    monkeypatch.setattr(held, "LOT", lot)
    parts, ref, texts = data()
    wanted = expected(ref, texts)
    found = matching.matching_statistics(docs_of(parts), docs_of(texts), plan="held")
    assert sorted(map(tuple, found.collect())) == sorted(wanted)
    heads = [r for k, r in enumerate(wanted) if r[1] == 0 or r[2] != wanted[k - 1][2] + 1]
    only = matching.matching_statistics(docs_of(parts), docs_of(texts), heads_only=True)
    assert sorted(map(tuple, only.collect())) == sorted(heads)


@pytest.mark.parametrize("symbols", ["a", "ab", "abc\U0001f600", "".join(map(chr, range(300, 700)))])
def test_random(symbols):
    r = random.Random(len(symbols))
    for n in (1, 2, 7, 60, 300):
        ref = "".join(r.choice(symbols) for _ in range(n))
        index = held.HeldReference(kernels.code_points(ref))
        texts = ["".join(r.choice(symbols + "!") for _ in range(m)) for m in (0, 1, 9, 70)] + [ref[n // 3 :] + ref, ref[: n // 2] + "\x00" + ref]
        docs = [k for k, _ in enumerate(texts)]

        class Sent:
            value = index

        import pyarrow as pa

        batch = pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(texts)], names=["doc", "text"])
        got = [tuple(x.values()) for b in held._matched(Sent, False)(iter([batch])) for x in b.to_pylist()]
        assert got == expected(ref, texts)


def test_bounds(docs_of, monkeypatch):
    """Beyond its bounds the routed plan answers, with the same rows."""
    parts, ref, texts = data()
    monkeypatch.setattr(held, "REFERENCE_SYMBOLS", 5)
    with pytest.raises(ValueError):
        matching.matching_statistics(docs_of(parts), docs_of(texts), plan="held")
    assert held.hold(docs_of([""]), docs_of(texts)) is None
    assert len(np.unique(held.HeldReference(kernels.code_points("abcab")).array)) == 5
