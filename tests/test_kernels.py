import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strandwise.functions import collection_sort as cs
from strandwise.functions import kernels as k

TEXTS = ["", "a", "banana", "mississippi", "abracadabra", "a" * 1000, "ñaé😀ñaé"]


def common(a, b):
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return n


def order_of(t):
    return sorted(range(len(t)), key=lambda i: t[i:])


def check_text(t):
    s, order = k.code_points(t), order_of(t)
    assert k.suffix_array(s).tolist() == order
    found, lcp = k.lcp_array(s)
    assert found.tolist() == order
    assert lcp.tolist() == [0 if r == 0 else common(t[order[r] :], t[order[r - 1] :]) for r in range(len(t))]
    transform, primary = k.bwt(s)
    assert k.inverse_bwt(transform, primary).tolist() == s.tolist()
    if t:
        assert "".join(map(chr, transform)) == t[-1] + "".join(t[i - 1] for i in order if i)
        assert primary == order.index(0) + 1


@pytest.mark.parametrize("t", TEXTS)
def test_known_texts(t):
    check_text(t)


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab\0é", max_size=40))
def test_any_text(t):
    check_text(t)


def test_bad_primary_index():
    with pytest.raises(ValueError):
        k.inverse_bwt(k.code_points("ab"), 3)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 5), st.integers(0, 6)), min_size=1, max_size=40))
def test_nearest_smaller_and_minimum(rows):
    v, b = np.array([x for x, _ in rows]), np.array([x for _, x in rows])
    n = len(v)
    assert k.previous_smaller(v, b).tolist() == [max((j for j in range(i + 1) if v[j] < b[i]), default=-1) for i in range(n)]
    assert k.next_smaller(v, b).tolist() == [min((j for j in range(i, n) if v[j] < b[i]), default=-1) for i in range(n)]
    first = np.arange(n)
    last = np.minimum(first + b, n - 1)
    assert k.range_minimum(v, first, last).tolist() == [min(v[i : j + 1]) for i, j in zip(first, last)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab\0é", max_size=30), min_size=1, max_size=6), st.booleans(), st.integers(1, 4))
def test_collection_sort(texts, terminators, ranges):
    suffixes = sorted((t[i:], d, i) for d, t in enumerate(texts) for i in range(len(t) + terminators))
    expected = [(r, d, i, common(s, suffixes[r - 1][0]) if r else 0) for r, (s, d, i) in enumerate(suffixes)]
    c = cs.Collection(np.arange(len(texts)), [t.encode() for t in texts])
    cuts = cs.splitters(c, ranges).tolist()
    found = [row for low, high in zip([0, *cuts], [*cuts, None]) for part in cs.sort_range(c, low, high, terminators) for row in zip(*(x.tolist() for x in part))]
    assert found == expected
