"""Sorting one key range of all suffixes of a collection that fits in memory.

Every task holds the collection's bytes. It picks the suffixes whose first eight bytes
lie in its range, and since it sees all of them it knows how many sort before: ranks
are final without any exchange between tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

PAD, CHUNK = 16, 1 << 20
#: Rounds of eight bytes after which the few suffixes still tied are compared as slices.
ROUNDS = 4


class Collection:
    """Texts one after another with zero bytes between them, in the order of their document numbers."""

    def __init__(self, docs: np.ndarray, texts: list[bytes]):
        order = np.argsort(docs, kind="stable")
        self.docs = np.asarray(docs, np.int64)[order]
        lengths = np.array([len(texts[i]) for i in order], np.int64)
        self.starts = np.concatenate(([0], np.cumsum(lengths + PAD)[:-1])).astype(np.int64) if len(order) else np.array([], np.int64)
        self.ends = self.starts + lengths
        self.data = b"".join(texts[i] + b"\0" * PAD for i in order) + b"\0" * PAD

    def open(self) -> None:
        """What tasks need besides the bytes; not sent but made where it is used."""
        self.bytes = np.frombuffer(self.data, np.uint8)
        self.has_zero = int((self.bytes == 0).sum()) > len(self.data) - int((self.ends - self.starts).sum())

    def keys(self, first: int, last: int) -> np.ndarray:
        """The eight bytes from each position on, as numbers in the order of the bytes."""
        n = last - first
        out = np.empty(-(-n // 8) * 8, np.uint64)
        for shift in range(8):
            part = self.bytes[first + shift : first + shift + 8 * (len(out) // 8)]
            part = np.concatenate((part, np.zeros(len(out) - len(part), np.uint8))) if len(part) < len(out) else part
            out[shift::8] = np.ascontiguousarray(part).view(">u8")
        return out[:n]

    def at(self, positions: np.ndarray) -> np.ndarray:
        """Keys at scattered positions; zero at and after the data's end."""
        positions = np.minimum(positions, len(self.bytes) - 8)
        return np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(self.bytes, 8)[positions]).view(">u8").ravel().astype(np.uint64)

    def suffixes(self, first: int, last: int, terminators: bool) -> np.ndarray:
        """Which of the positions begin a suffix: first bytes of symbols, and with ``terminators`` the documents' ends."""
        begin = (self.bytes[first:last] & 0xC0) != 0x80
        inside = np.zeros(last - first + 1, np.int8)
        a, b = np.searchsorted(self.ends, first, side="right"), np.searchsorted(self.starts, last)
        s, e = np.clip(self.starts[a:b], first, last) - first, np.clip(self.ends[a:b], first, last) - first
        np.add.at(inside, s, 1)
        np.add.at(inside, e, -1)
        out = begin & (np.cumsum(inside[:-1]) > 0)
        if terminators:
            own = self.ends[(self.ends >= first) & (self.ends < last)] - first
            out[own] = True
        return out

    def doc_of(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, positions, side="right") - 1


def splitters(c: Collection, ranges: int) -> np.ndarray:
    """Keys that cut the suffixes into ranges of about equal size; from a spread of positions."""
    c.open()
    n = len(c.bytes) - PAD
    step = max(1, n // (ranges * 2_000))
    keys = np.sort(c.at(np.arange(0, max(n, 1), step)))
    return np.unique(keys[np.linspace(0, len(keys), ranges + 1).astype(int)[1:-1]]) if ranges > 1 else np.array([], np.uint64)


def _common_bytes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Equal leading bytes of two keys."""
    x = a ^ b
    out = np.zeros(len(x), np.int64)
    for k in range(1, 9):
        out += (x >> np.uint64(64 - 8 * k)) == 0
    return out


def sort_range(c: Collection, low: int, high: int | None, terminators: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(rank, doc, idx, lcp) of the suffixes with keys from ``low`` up to ``high``; lcp is with the suffix before, in symbols."""
    lo = np.uint64(low)
    offset, before, picked, picked_keys = 0, None, [], []
    for first in range(0, len(c.bytes) - PAD, CHUNK):
        last = min(first + CHUNK, len(c.bytes) - PAD)
        keys, there = c.keys(first, last), c.suffixes(first, last, terminators)
        below = there & (keys < lo)
        offset += int(below.sum())
        if below.any():
            # the greatest key below, and the most bytes that a suffix with it has
            key = keys[below].max()
            if before is None or key >= before[0]:
                at = np.flatnonzero(below & (keys == key))[: None if c.has_zero else 1] + first
                left = int((c.ends[c.doc_of(at)] - at).max())
                before = (key, max(left, before[1]) if before and before[0] == key else left)
        mine = np.flatnonzero(there & (keys >= lo) & (keys < np.uint64(high) if high is not None else True))
        picked.append(mine + first)
        picked_keys.append(keys[mine])
    if not picked or not (n := sum(map(len, picked))):
        return
    pos, key = np.concatenate(picked), np.concatenate(picked_keys)
    order = np.argsort(key, kind="stable")
    pos, key = pos[order], key[order]
    end = c.ends[c.doc_of(pos)]
    common = np.zeros(n, np.int64)
    if before is not None:
        common[0] = _common_bytes(key[:1], np.array([before[0]]))[0]
        common[0] = min(common[0], end[0] - pos[0], before[1])
    new = np.concatenate(([True], key[1:] != key[:-1]))
    common[1:] = np.where(new[1:], _common_bytes(key[1:], key[:-1]), 0)
    depth = 8
    tied, group = _tied(new)
    while len(tied) and depth < 8 * ROUNDS:
        here = pos[tied] + depth
        # past its end a suffix reads zeros
        nxt = np.where(here < end[tied], c.at(here), np.uint64(0))
        order = np.lexsort((nxt, group))
        pos[tied], end[tied], nxt = pos[tied[order]], end[tied[order]], nxt[order]
        same = group[1:] == group[:-1]
        split = np.concatenate(([False], same & (nxt[1:] != nxt[:-1])))
        rows = tied[split]
        new[rows] = True
        common[rows] = depth + _common_bytes(nxt[split], nxt[np.flatnonzero(split) - 1])
        depth += 8
        keep, group = _tied(np.concatenate(([True], ~same)) | split)
        tied = tied[keep]
        if not c.has_zero and len(tied):
            # groups of suffixes that have all ended are equal; they stand by document already
            going = np.zeros(int(group[-1]) + 1, bool)
            going[group[pos[tied] + depth < end[tied]]] = True
            tied, group = tied[going[group]], group[going[group]]
    if len(tied):
        # zero bytes of a text look like its end so far: then whole suffixes are compared
        depth = 0 if c.has_zero else depth
        first = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
        size = np.diff(np.append(first, len(tied)))
        two = tied[first[size == 2]]
        swap, m = _pairs(c, pos[two], pos[two + 1], end[two], end[two + 1], depth)
        for x in (pos, end):
            x[two[swap]], x[two[swap] + 1] = x[two[swap] + 1], x[two[swap]]
        common[two + 1], new[two + 1] = m, True
        for at, k in zip(first[size > 2].tolist(), size[size > 2].tolist()):
            rows = tied[at : at + k]
            slices = [c.data[p + depth : e] for p, e in zip(pos[rows].tolist(), end[rows].tolist())]
            order = sorted(range(len(rows)), key=slices.__getitem__)
            pos[rows], end[rows] = pos[rows[order]], end[rows[order]]
            for k in range(1, len(rows)):
                a, b = slices[order[k - 1]], slices[order[k]]
                m = min(len(a), len(b))
                if a[:m] == b[:m]:
                    common[rows[k]] = depth + m
                else:
                    x = np.frombuffer(a, np.uint8, m) != np.frombuffer(b, np.uint8, m)
                    common[rows[k]] = depth + int(np.argmax(x))
                new[rows[k]] = True
    rest = end - pos
    common[1:] = np.where(new[1:], common[1:], rest[1:])
    common[1:] = np.minimum(common[1:], np.minimum(rest[1:], rest[:-1]))
    # bytes to symbols: those that begin a symbol, less one that is cut
    begins = np.concatenate(([0], np.cumsum((c.bytes & 0xC0) != 0x80, dtype=np.int64)))
    doc = c.doc_of(pos)
    stop = pos + common
    cut = (common > 0) & (stop < end) & ((c.bytes[stop] & 0xC0) == 0x80)
    lcp = begins[stop] - begins[pos] - cut
    yield offset + np.arange(n), c.docs[doc], begins[pos] - begins[c.starts[doc]], lcp


def _pairs(c: Collection, p: np.ndarray, q: np.ndarray, p_end: np.ndarray, q_end: np.ndarray, known: int) -> tuple[np.ndarray, np.ndarray]:
    """For pairs of suffixes that share ``known`` bytes: whether the second sorts first, and their common bytes.

    Pairs of one distance that overlap end at the same difference, so one pair of each
    such run is compared and the others follow from it.
    """
    n = len(p)
    limit = np.minimum(p_end - p, q_end - q)
    common = np.zeros(n, np.int64)
    order = np.lexsort((p, q - p))
    place, rest = p[order], limit[order]
    distance = np.cumsum(np.concatenate(([0], np.diff((q - p)[order]) != 0)))
    span = np.int64(len(c.bytes) + 1)
    key = distance * span + place
    lead = np.flatnonzero(np.concatenate(([n > 0], distance[1:] != distance[:-1]))) if n else np.array([], np.int64)
    while len(lead):
        a, b, top = place[lead], q[order[lead]], rest[lead]
        length = np.minimum(known, top)
        going = np.flatnonzero(length < top)
        while len(going):
            same = _common_bytes(c.at(a[going] + length[going]), c.at(b[going] + length[going]))
            length[going] += same
            going = going[(same == 8) & (length[going] < top[going])]
        length = np.minimum(length, top)
        after = np.searchsorted(key, distance[lead] * span + a + length, side="right")
        counts = after - lead
        rows = np.repeat(lead - np.concatenate(([0], np.cumsum(counts)[:-1])), counts) + np.arange(int(counts.sum()))
        common[order[rows]] = np.repeat(a + length, counts) - place[rows]
        more = after < n
        lead = after[more][distance[np.minimum(after, n - 1)[more]] == distance[lead[more]]]
    common = np.minimum(common, limit)
    ended = common >= limit
    swap = np.where(ended, p_end - p > q_end - q, c.bytes[p + common] > c.bytes[q + common])
    return swap, common


def _tied(new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows that share their group with another, and their groups; ``new`` marks where groups begin."""
    rows = np.flatnonzero(~new | np.concatenate((~new[1:], [False])))
    return rows, np.cumsum(new[rows])
