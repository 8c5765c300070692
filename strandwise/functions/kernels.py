"""Array kernels over one text or one integer sequence, in numpy; tasks call them on documents."""

from __future__ import annotations

import numpy as np


def code_points(text: str | None) -> np.ndarray:
    """The text's symbols as integers; null counts as empty."""
    return np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)


def _dense(keys: np.ndarray) -> np.ndarray:
    return np.unique(keys, return_inverse=True)[1].astype(np.int64)


def doubling_ranks(symbols: np.ndarray) -> list[np.ndarray]:
    """Dense ranks of all suffixes by their first 1, 2, 4, ... symbols, until all differ. A suffix that ends is smaller."""
    n = len(symbols)
    ranks = [_dense(symbols)]
    h = 1
    while n and ranks[-1].max() < n - 1:
        last = ranks[-1]
        second = np.zeros(n, np.int64)
        second[: max(n - h, 0)] = last[h:] + 1
        ranks.append(_dense(last * (n + 1) + second))
        h *= 2
    return ranks


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Positions of all suffixes in lexicographic order."""
    return invert(doubling_ranks(symbols)[-1]) if len(symbols) else np.array([], np.int64)


def invert(permutation: np.ndarray) -> np.ndarray:
    out = np.empty_like(permutation)
    out[permutation] = np.arange(len(permutation))
    return out


def common_prefixes(ranks: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of the suffixes at a and at b (a != b), from the ranks of all powers of two."""
    n = len(ranks[0])
    length = np.zeros(len(a), np.int64)
    for level in range(len(ranks) - 1, -1, -1):
        x, y = a + length, b + length
        # equal ranks at a level mean equal symbols over its whole width only if neither suffix ends inside it
        fits = np.maximum(x, y) + (1 << level) <= n
        x, y = np.where(fits, x, 0), np.where(fits, y, 0)
        length += np.where(fits & (ranks[level][x] == ranks[level][y]), 1 << level, 0)
    return length


def lcp_array(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array, common prefix of each suffix with the one before it in order; the first has 0)."""
    if not len(symbols):
        return np.array([], np.int64), np.array([], np.int64)
    ranks = doubling_ranks(symbols)
    order = invert(ranks[-1])
    lcp = np.zeros(len(order), np.int64)
    if len(order) > 1:
        a, b = order[1:], order[:-1]
        lcp[1:] = common_prefixes(ranks, a, b)
    return order, lcp


def bwt(symbols: np.ndarray) -> tuple[np.ndarray, int]:
    """(transform, primary index). The first symbol is the text's last; the row of the whole text is left out, its rank plus one is the index."""
    order = suffix_array(symbols)
    if not len(order):
        return symbols, 0
    primary = int(np.flatnonzero(order == 0)[0])
    rest = np.delete(order, primary)
    return np.concatenate((symbols[-1:], symbols[rest - 1])), primary + 1


def lf_mapping(transform: np.ndarray) -> np.ndarray:
    """For each place of the transform, the place of the same occurrence among the sorted symbols."""
    return invert(np.argsort(transform, kind="stable"))


def inverse_bwt(transform: np.ndarray, primary: int) -> np.ndarray:
    """The text of ``bwt``'s result. The walk through the rows is laid out by doubling, not step by step."""
    n = len(transform)
    if n == 0:
        return transform
    if not 0 < primary <= n:
        raise ValueError(f"primary index {primary} is not within 1 to {n}")
    # rows of the sorted suffixes: row 0 is the empty suffix; place p of the transform is row p before the primary row and p + 1 after it
    step = np.empty(n + 1, np.int64)  # row of the suffix that starts one symbol later
    place = np.arange(n)
    row = np.where(place < primary, place, place + 1)
    step[lf_mapping(transform) + 1] = row
    step[0] = primary
    symbol = np.concatenate(([0], np.sort(transform, kind="stable")))
    walk = np.array([primary], np.int64)
    while len(walk) < n:
        walk = np.concatenate((walk, step[walk]))
        step = step[step]
    return symbol[walk[:n]]


def previous_smaller(values: np.ndarray, bounds: np.ndarray | None = None, places: np.ndarray | None = None) -> np.ndarray:
    """Largest j <= i with values[j] < bound, else -1; places i default to all, bounds to the values there. Search by block minima of all powers of two."""
    n = len(values)
    at = np.arange(n) if places is None else places.copy()  # all of at+1 .. i is known not to be smaller
    bounds = values[at] if bounds is None else bounds
    tables = [values]
    while 1 << len(tables) <= n:
        last, h = tables[-1], 1 << (len(tables) - 1)
        tables.append(np.minimum(last[h:], last[:-h]))
    for level in range(len(tables) - 1, -1, -1):
        first = at - (1 << level) + 1
        fits = first >= 0
        least = tables[level][np.where(fits, first, 0)]
        at = np.where(fits & (least >= bounds), first - 1, at)
    return at


def next_smaller(values: np.ndarray, bounds: np.ndarray | None = None, places: np.ndarray | None = None) -> np.ndarray:
    """Smallest j >= i with values[j] < bound, else -1."""
    n = len(values)
    places = np.arange(n) if places is None else places
    bounds = values[places] if bounds is None else bounds
    found = previous_smaller(values[::-1], bounds, n - 1 - places)
    return np.where(found < 0, -1, n - 1 - found)


def range_minimum(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Least value from first to last, both included."""
    tables = [values]
    while 1 << len(tables) <= len(values):
        h = 1 << (len(tables) - 1)
        tables.append(np.minimum(tables[-1][h:], tables[-1][:-h]))
    level = np.floor(np.log2(last - first + 1)).astype(np.int64)
    out = np.empty(len(first), values.dtype)
    for k in range(len(tables)):
        mine = level == k
        out[mine] = np.minimum(tables[k][first[mine]], tables[k][last[mine] - (1 << k) + 1])
    return out
