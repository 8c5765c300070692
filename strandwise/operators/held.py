"""Matching statistics against a small reference, whose array every task holds.

A reference within a checked bound is sent to every task once, as a small table is for
a join; documents are matched where they are read, and nothing is shuffled. A place's
interval of ranks by its first symbols comes from one binary search; that of twice the
symbols follows from that of the place so many symbols further on, as in ``routed``,
which takes references and documents of any size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels
from ..plans.storage import spread

#: Symbols of a reference that a task holds, of a document, and of documents that are matched together.
REFERENCE_SYMBOLS, DOCUMENT_SYMBOLS, LOT = 1 << 20, 1 << 21, 1 << 18
MS = "doc long, idx long, pos long, len long, smaller boolean, next string"


class HeldReference:
    """A text, its suffix array, the inverse, and eight bytes of the numbers of the symbols from each place on."""

    def __init__(self, points: np.ndarray):
        self.alphabet = np.unique(points)
        self.kind = np.dtype("u1" if 2 * len(self.alphabet) + 2 < 1 << 8 else ">u2" if 2 * len(self.alphabet) + 2 < 1 << 16 else ">u4")
        self.size, self.width = len(points), 8 // self.kind.itemsize
        self.array = kernels.suffix_array(points).astype(np.int32)
        self.inverse = np.append(kernels.invert(self.array), -1).astype(np.int32)
        self.keys = np.append(self.packed(self.numbers(points)), np.uint64(0))
        self.sorted = self.keys[self.array]

    def numbers(self, points: np.ndarray) -> np.ndarray:
        """Even ones for the reference's symbols, odd ones between them for others; 0 is left for an end."""
        at = np.searchsorted(self.alphabet, points)
        known = self.alphabet[np.minimum(at, len(self.alphabet) - 1)] == points
        return (2 * at + 1 + known).astype(self.kind)

    def packed(self, numbers: np.ndarray) -> np.ndarray:
        padded = np.append(numbers, np.zeros(self.width, self.kind)).astype(self.kind)
        windows = np.lib.stride_tricks.sliding_window_view(padded, self.width)[: len(numbers)]
        return np.ascontiguousarray(windows).view(">u8").reshape(-1).astype(np.uint64)

    def same(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Symbols that two keys share."""
        out, left = np.zeros(len(a), np.int64), a ^ b
        for k in range(self.width):
            out += left >> np.uint64(64 - 8 * self.kind.itemsize * (k + 1)) == 0
        return out


def match(ref: HeldReference, numbers: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pos, len, smaller) of every place of texts one behind another, at least one 0 behind each; ``rest``: symbols that its text has from a place on."""
    n, w, keys = ref.size, ref.width, ref.packed(numbers)
    beyond = np.maximum(w - rest, 0).astype(np.uint64) * np.uint64(8 * ref.kind.itemsize)
    mask = np.where(beyond < 64, (np.uint64(1) << np.minimum(beyond, 63)) - np.uint64(1), np.uint64((1 << 64) - 1))
    low = np.searchsorted(ref.sorted, keys, side="left").astype(np.int32)
    high = np.searchsorted(ref.sorted, keys | mask, side="right").astype(np.int32)
    pos, size, smaller = np.zeros(len(rest), np.int64), np.zeros(len(rest), np.int64), np.zeros(len(rest), bool)
    history: list[tuple[int, np.ndarray, np.ndarray]] = []

    def shared(at: np.ndarray, side: np.ndarray, depth: int) -> np.ndarray:
        """The common prefix with the reference's place ``side``, known to be ``depth`` and less than twice as much (less than ``w`` at depth 0)."""
        found = np.full(len(at), depth, np.int64)
        for h, a, b in reversed(history):
            if h < depth:
                there, rank = at + found, ref.inverse[np.minimum(side + found, n)]
                there = np.minimum(there, len(rest) - 1)
                found += np.where((rest[there] >= h) & (rank >= a[there]) & (rank < b[there]), h, 0)
        there, other = np.minimum(at + found, len(rest) - 1), np.minimum(side + found, n)
        left = np.minimum(rest[at] - found, n - other)
        return found + np.minimum(ref.same(keys[there], ref.keys[other]), np.maximum(left, 0))

    def lost(at: np.ndarray, place: np.ndarray, first: np.ndarray, last: np.ndarray, depth: int) -> None:
        """Places that sort between ranks ``place - 1`` and ``place``, both within [first, last) if they share ``depth``."""
        after, before = ref.array[np.minimum(place, n - 1)].astype(np.int64), ref.array[np.maximum(place - 1, 0)].astype(np.int64)
        nxt = np.where(place < last, shared(at, after, depth), -1)
        prv = np.where(place > first, shared(at, before, depth), -1)
        smaller[at] = nxt >= prv
        pos[at], size[at] = np.where(nxt >= prv, after, before), np.maximum(nxt, prv)

    def ended(at: np.ndarray) -> None:
        """Places that are matched to their text's end: an equal suffix of the reference stands before, longer ones behind."""
        a = low[at].astype(np.int64)
        equal, more = n - ref.array[a] == rest[at], a + 1 < high[at]
        pos[at] = ref.array[np.where(equal & more, a + 1, a)]
        size[at], smaller[at] = rest[at], ~equal | more

    own = np.flatnonzero(rest > 0)
    gone = own[low[own] == high[own]]
    lost(gone, low[gone].astype(np.int64), np.zeros(len(gone), np.int64), np.full(len(gone), n), 0)
    open_ = own[low[own] < high[own]]
    ended(open_[rest[open_] <= w])
    open_, depth = open_[rest[open_] > w], w
    while len(open_):
        history.append((depth, low.copy(), high.copy()))
        first, last = low[open_].astype(np.int64), high[open_].astype(np.int64)
        bounds = []
        # within an interval the ranks of what follows rise
        for wanted in (low[open_ + depth], high[open_ + depth]):
            a, b = first.copy(), last.copy()
            while len(k := np.flatnonzero(a < b)):
                mid = (a[k] + b[k]) >> 1
                less = ref.inverse[ref.array[mid] + depth] < wanted[k]
                a[k], b[k] = np.where(less, mid + 1, a[k]), np.where(less, b[k], mid)
            bounds.append(a)
        low[open_], high[open_] = bounds
        empty = bounds[0] == bounds[1]
        lost(open_[empty], bounds[0][empty], first[empty], last[empty], depth)
        open_, depth = open_[~empty], 2 * depth
        ended(open_[rest[open_] <= depth])
        open_ = open_[rest[open_] > depth]
    return pos, size, smaller


def _matched(sent, heads_only: bool):
    def of(ref: HeldReference, docs: list[int], texts: list[np.ndarray]) -> pa.RecordBatch:
        lengths = np.array([len(x) for x in texts])
        end = np.zeros(1, np.int64)
        points = np.concatenate([y for x in texts for y in (x, end)])
        begins = np.cumsum(lengths + 1) - lengths - 1
        text = np.repeat(np.arange(len(texts)), lengths + 1)
        idx = np.arange(len(points)) - begins[text]
        rest = lengths[text] - idx
        numbers = np.where(rest > 0, ref.numbers(points), 0).astype(ref.kind)
        pos, size, smaller = match(ref, numbers, rest)
        kept = rest > 0
        if heads_only:
            kept[1:] &= (idx[1:] == 0) | (pos[1:] != pos[:-1] + 1)
        at = np.flatnonzero(kept)
        there = at + size[at]
        symbols, which = np.unique(points[there], return_inverse=True)
        following = pa.array([chr(p) for p in symbols.tolist()], pa.string()).take(pa.array(which, mask=rest[there] == 0))
        return pa.RecordBatch.from_arrays([pa.array(np.array(docs, np.int64)[text[at]]), pa.array(idx[at]), pa.array(pos[at]), pa.array(size[at]), pa.array(smaller[at]), following], names=["doc", "idx", "pos", "len", "smaller", "next"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, texts, size = [], [], 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                texts.append(kernels.code_points(text.as_py()))
                docs.append(doc)
                size += len(texts[-1]) + 1
                if size >= LOT:
                    yield of(sent.value, docs, texts)
                    docs, texts, size = [], [], 0
        if docs:
            yield of(sent.value, docs, texts)

    return run


def hold(reference: DataFrame, docs: DataFrame) -> HeldReference | None:
    """The reference, texts (doc, text) as one in the order of doc, if it and every document are within the bounds, which are checked first."""
    size = F.length("text").cast("long")
    row = reference.agg(F.sum(size).alias("n"), F.count(F.lit(1)).alias("texts")).first()
    if not row["n"] or row["n"] > REFERENCE_SYMBOLS or row["texts"] > REFERENCE_SYMBOLS or (docs.agg(F.max(size)).first()[0] or 0) > DOCUMENT_SYMBOLS:
        return None
    texts = reference.select("doc", "text").orderBy("doc").toArrow()["text"]
    return HeldReference(np.concatenate([kernels.code_points(x.as_py()) for x in texts]))


def matching_statistics(ref: HeldReference, docs: DataFrame, heads_only: bool = False) -> DataFrame:
    """(doc, idx, pos, len, smaller, next) of every place of ``docs``, or with ``heads_only`` of those where a match does not go on from the one before."""
    sent = docs.sparkSession.sparkContext.broadcast(ref)
    return spread(docs.select("doc", "text")).mapInArrow(_matched(sent, heads_only), MS)
