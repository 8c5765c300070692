"""Suffix order of a collection of any size by difference covers, on tables.

A cover of a period v is a set of residues such that any two places, some fewer than v
steps on, both meet it. So: all suffixes are sorted once by their first v symbols; the
places of the cover, named by that order, make up shorter sequences whose suffixes are
ranked in the same way; and suffixes that still tie compare by the rank of the covered
place that both reach first. Each level is a few linear exchanges, whatever the length of
repeats, and the next one has a fifth (text) or three sevenths (names) of its rows.

An element is (doc, idx) on every level; the one after it in its sequence is ``stride``
further on.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels
from ..plans.ranking import PART, POSITION, join_ranges, rank_split
from ..plans.storage import materialise, scratch, spread

#: Elements that one task ranks by itself, and rows of one tied prefix that meet in a task; more are parted by splitters.
BASE_ELEMENTS, TIED_ROWS = 1 << 20, 1 << 20
#: Places of a sequence that are read together, and rows that a task works on at once.
BLOCK, LOT = 1 << 13, 1 << 17
#: Suffixes of a range of keys, keys sampled for each, and keys sampled in all at most (fewer a range make ranges less even, no more).
RANGE_ROWS, SAMPLED, SAMPLE_KEYS = 1 << 18, 64, 4_000_000
_LAST = np.iinfo(np.int64).max


@dataclass(frozen=True)
class Cover:
    """A period and residues whose differences are all residues."""

    period: int
    residues: tuple[int, ...]

    @cached_property
    def offsets(self) -> np.ndarray:
        """For each residue of a place, how far on the covered places of its window are, ascending."""
        return np.array([sorted((d - r) % self.period for d in self.residues) for r in range(self.period)])

    @cached_property
    def meeting(self) -> np.ndarray:
        """[r, c]: which of r's offsets is the first that a place of residue c has too."""
        out = np.zeros((self.period, self.period), np.int64)
        for r in range(self.period):
            for c in range(self.period):
                out[r, c] = np.flatnonzero(np.isin(self.offsets[r], self.offsets[c]))[0]
        return out


#: Perfect difference sets, in which each difference occurs once.
TEXT_COVER = Cover(31, (0, 1, 3, 8, 12, 18))
NAME_COVER = Cover(7, (0, 1, 3))
#: Symbols behind its own that a piece of a document has.
AHEAD = TEXT_COVER.period + 1


def _binary(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Slices of bytes as one Arrow array."""
    sizes = ends - begins
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    gathered = data[np.repeat(begins - offsets[:-1], sizes) + np.arange(offsets[-1])]
    return pa.Array.from_buffers(pa.binary(), len(begins), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(gathered))])


class Alphabet:
    """Symbols numbered in order from 1, in as few bytes as their number takes; 0 stands behind a text's end."""

    def __init__(self, points: np.ndarray):
        self.points = np.sort(points)
        self.kind = np.dtype("u1" if len(points) < 1 << 8 else ">u2" if len(points) < 1 << 16 else ">u4")

    @staticmethod
    def of(docs: DataFrame) -> Alphabet:
        """That of a collection: a row a symbol comes to the driver."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen = np.zeros(0x110000, bool)
            for batch in batches:
                for text in batch.column(0):
                    seen[kernels.code_points(text.as_py())] = True
            yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(seen))], names=["point"])

        return Alphabet(docs.select("text").mapInArrow(run, "point long").distinct().toArrow()["point"].to_numpy())

    @cached_property
    def table(self) -> np.ndarray:
        out = np.zeros(int(self.points.max(initial=0)) + 1, self.kind)
        out[self.points] = np.arange(1, len(self.points) + 1)
        return out

    def numbers(self, text: np.ndarray) -> np.ndarray:
        return self.table[text]


def _text_keys(alphabet: Alphabet, width: int, terminators: bool, chosen=None):
    """Of every suffix: document, place and key, a lot at a time. ``chosen`` picks places.

    A key is the numbers of the first symbols, and then the document's number if the
    suffix ends with them, else the largest number: a suffix that ends is smaller. Texts
    may be pieces: from place ``start`` on, ``own`` symbols and some of those behind them.
    """
    size = width * alphabet.kind.itemsize

    def of(docs: np.ndarray, begins: np.ndarray, counts: np.ndarray, numbers: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        lengths = np.array([len(x) for x in numbers])
        gap = np.zeros(width, alphabet.kind)
        padded = np.concatenate([y for x in numbers for y in (x, gap)]).astype(alphabet.kind)  # in the byte order of the keys
        firsts = np.concatenate(([0], np.cumsum(lengths + width)))[:-1]
        counts = counts + terminators
        ends = np.cumsum(counts)
        windows = np.lib.stride_tricks.sliding_window_view(padded, width)
        for at in range(0, int(ends[-1]), LOT):
            k = np.arange(at, min(at + LOT, ends[-1]))
            own = np.searchsorted(ends, k, side="right")
            idx = k - (ends - counts)[own]
            if chosen is not None:
                kept = chosen(docs[own], begins[own] + idx)
                own, idx = own[kept], idx[kept]
            key = np.empty((len(own), size + 8), np.uint8)
            key[:, :size] = np.ascontiguousarray(windows[firsts[own] + idx]).view(np.uint8).reshape(len(own), size)
            tie = np.where(idx + width < lengths[own], _LAST, docs[own])
            key[:, size:] = (tie.astype(np.uint64) ^ np.uint64(1 << 63)).astype(">u8").view(np.uint8).reshape(-1, 8)
            yield docs[own], begins[own] + idx, key

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        held: list[tuple[int, int, int]] = []
        numbers, size = [], 0
        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("doc", "start", "own")]
            for doc, start, own, text in zip(*columns, batch.column(batch.schema.get_field_index("text"))):
                numbers.append(alphabet.numbers(kernels.code_points(text.as_py())))
                held.append((doc, start, own))
                size += len(numbers[-1]) + 1
                if size >= LOT:
                    yield from of(*np.array(held, np.int64).T, numbers)
                    held, numbers, size = [], [], 0
        if held:
            yield from of(*np.array(held, np.int64).T, numbers)

    return run


def _comparable(key: np.ndarray) -> np.ndarray:
    """Rows of bytes as fixed strings, which compare as bytes do."""
    return np.ascontiguousarray(key).view(f"S{key.shape[1]}").reshape(-1)


def _sampled(keys, every: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, key in keys(batches):
            yield pa.RecordBatch.from_arrays([pa.array([k.tobytes() for k in key], pa.binary())], names=["key"])

    return run


def _dealt(keys, splitters: np.ndarray):
    """(part, docs, places, keys): suffixes by the range of their key, packed; keys that several ranges share go to any of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for docs, idx, key in keys(batches):
            own = _comparable(key)
            low, high = np.searchsorted(splitters, own, side="left"), np.searchsorted(splitters, own, side="right")
            # the first of the ranges may also hold smaller keys, so every range between is free
            part = low + (docs * 31 + idx) % (high - low + 1)
            order = np.argsort(part, kind="stable")
            parts, begins = np.unique(part[order], return_index=True)
            cuts = list(zip(begins, [*begins[1:], len(order)]))
            lists = lambda x: pa.array([x[order[a:b]] for a, b in cuts], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(parts.astype(np.int32)), lists(docs), lists(idx), pa.array([key[order[a:b]].tobytes() for a, b in cuts], pa.binary())], names=["part", "docs", "places", "keys"])

    return run


def _common(numbers: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Symbols that keys share, a row each of numbers; 0 stands behind an end."""
    differ = (numbers != before) | (numbers == 0)
    return np.where(differ.any(axis=1), differ.argmax(axis=1), numbers.shape[1])


def _sort_range(size: int, kind: np.dtype):
    """(doc, idx, _lcp, _part, _position, _first, _near, key) of a range's suffixes: sorted by key, those of equal keys numbered by the first. _lcp: symbols of its key that the first of them shares with the key before; null for the others."""

    def run(packed: pa.Table) -> pa.Table:
        docs, idx = (np.concatenate([x.flatten().to_numpy() for x in packed[c].chunks]) for c in ("docs", "places"))
        key = np.frombuffer(b"".join(packed["keys"].to_pylist()), np.uint8).reshape(len(docs), size)
        wide = np.zeros((len(docs), -(-size // 8) * 8), np.uint8)
        wide[:, :size] = key
        columns = wide.view(">u8").astype(np.uint64)
        # by the first eight bytes, and those that tie there by all
        order = np.argsort(columns[:, 0], kind="stable")
        head = columns[order, 0]
        open_ = np.zeros(len(order), bool)
        open_[1:] = head[1:] == head[:-1]
        open_[:-1] |= open_[1:]
        at = np.flatnonzero(open_)
        order[at] = order[at][np.lexsort([columns[order[at], c] for c in range(columns.shape[1] - 1, -1, -1)])]
        new = np.ones(len(order), bool)
        near = np.flatnonzero(open_[1:]) + 1
        new[near] = (columns[order[near]] != columns[order[near - 1]]).any(axis=1)
        places = np.arange(len(order))
        starts = np.maximum.accumulate(np.where(new, places, 0))
        same = ~new
        same[:-1] |= ~new[1:]
        shown = pa.array(np.where((places == 0) | (places == len(order) - 1), places, 0), mask=(places > 0) & (places < len(order) - 1))
        ends = pa.array([key[order[k]].tobytes() if k in (0, len(order) - 1) else None for k in (0, len(order) - 1)], pa.binary())
        ends = ends.take(pa.array(np.where(places == 0, 0, 1), mask=shown.is_null().to_numpy(zero_copy_only=False)))
        part = pa.array(np.full(len(order), packed["part"][0].as_py(), np.int32))
        del wide, columns
        numbers, lcp = key[:, : size - 8], np.zeros(len(order), np.int64)
        for at in range(1, len(order), LOT):
            k = np.arange(at, min(at + LOT, len(order)))
            own, before = (np.ascontiguousarray(numbers[order[x]]).view(kind) for x in (k, k - 1))
            lcp[k] = _common(own, before)
        return pa.table([pa.array(docs[order]), pa.array(idx[order]), pa.array(lcp, mask=~new), part, pa.array(places), pa.array(starts), pa.array(same), ends], names=["doc", "idx", "_lcp", PART, POSITION, "_first", "_near", "key"])

    return run


def _first_ranks(docs: DataFrame, width: int, terminators: bool) -> DataFrame:
    """(doc, idx, lcp, rank, tied): all suffixes ranked by their first symbols. Bounds of the ranges come from a sample of keys, some for each range.

    lcp: symbols that the first of those with one rank shares with the one before it in order, which are fewer than its key has or all of either suffix; null for the others.
    """
    own = F.col("own") if "own" in docs.columns else F.length("text")
    rows = spread(docs.select("doc", "text", (F.col("start") if "start" in docs.columns else F.lit(0)).cast("long").alias("start"), own.cast("long").alias("own")))
    alphabet = Alphabet.of(rows)
    n = rows.agg(F.sum(F.col("own") + F.lit(int(terminators)))).first()[0] or 0
    parts = max(1, -(-n // RANGE_ROWS), min(n // 20_000, docs.sparkSession.sparkContext.defaultParallelism))
    every = max(1, n // min(parts * SAMPLED, SAMPLE_KEYS))
    chosen = lambda d, i: (d * 7_368_787 + i * 2_654_435_761 >> 7) % every == 0
    found = rows.mapInArrow(_sampled(_text_keys(alphabet, width, terminators, chosen), every), "key binary").toArrow()["key"].to_pylist() if parts > 1 else []
    size = width * alphabet.kind.itemsize + 8
    keys = np.sort(np.array(found, f"S{size}"))
    splitters = keys[np.linspace(0, len(keys), parts + 1).astype(np.int64)[1:-1]] if len(keys) >= parts else keys
    dealt = rows.mapInArrow(_dealt(_text_keys(alphabet, width, terminators), splitters), "part int, docs array<long>, places array<long>, keys binary")
    placed = dealt.groupBy("part").applyInArrow(_sort_range(size, alphabet.kind), f"doc long, idx long, _lcp long, {PART} int, {POSITION} long, _first long, _near boolean, key binary")
    placed = materialise(placed, "first-ranks")
    # a range's first row meets the last one of the range before; two rows a range come to the driver
    ends = placed.filter("key IS NOT NULL").select(PART, "key").orderBy(PART, POSITION).collect()
    numbers = [np.frombuffer(r["key"][:-8], alphabet.kind)[None] for r in ends]
    begins = [k for k, r in enumerate(ends) if not k or ends[k - 1][PART] != r[PART]]
    met = [(ends[k][PART], None if k and ends[k - 1]["key"] == ends[k]["key"] else int(_common(numbers[k], numbers[k - 1])[0]) if k else 0) for k in begins]
    known = F.broadcast(docs.sparkSession.createDataFrame(met, f"{PART} int, _met long"))
    placed = placed.join(known, PART).withColumn("lcp", F.when(F.col(POSITION) == 0, F.col("_met")).otherwise(F.col("_lcp"))).drop("_met", "_lcp")
    return join_ranges(placed, ["key"], ["doc", "idx", "lcp"])


def _place_of(stride: int):
    return F.expr(f"idx div {stride}")


def _by_sequence(rows: DataFrame, stride: int, ahead: int, kind: str | None = None) -> DataFrame:
    """Rows dealt by sequence and block of places and sorted; those that the block before looks ahead to (``kind`` of them) are there too, marked ``extra``."""
    placed = rows.select("*", (F.col("idx") % stride).alias("seq"), _place_of(stride).alias("place"))
    begins = (F.col("place") % BLOCK < ahead) & (F.col("place") >= BLOCK)
    block = F.expr(f"place div {BLOCK}")
    own = placed.select("*", F.lit(False).alias("extra"), block.alias("block"))
    shared = placed.filter(begins & F.col(kind) if kind else begins).select("*", F.lit(True).alias("extra"), (block - 1).alias("block"))
    key = ["doc", "seq", "block"]
    return own.unionByName(shared).repartition(*key).sortWithinPartitions(*key, "place", *([kind] if kind else []))


def _lots(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict[str, np.ndarray], np.ndarray]]:
    """Columns of whole blocks, some at a time, and the number of the block that each row is of."""
    held: list[pa.RecordBatch] = []
    size = 0

    def numbered(table: pa.Table) -> tuple[dict[str, np.ndarray], np.ndarray]:
        c = {n: table[n].to_numpy() for n in table.schema.names}
        new = np.zeros(table.num_rows, bool)
        for k in ("doc", "seq", "block"):
            new[1:] |= c[k][1:] != c[k][:-1]
        return c, np.cumsum(new)

    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= LOT:
            table = pa.Table.from_batches(held)
            c, of = numbered(table)
            cut = int(np.searchsorted(of, of[-1]))  # the last block may go on
            if cut:
                yield {n: x[:cut] for n, x in c.items()}, of[:cut]
            held, size = table.slice(cut).to_batches(), size - cut
    if size:
        yield numbered(pa.Table.from_batches(held))


def _name_keys(width: int):
    """(doc, idx, key, tie) of every element: its name and those after it, up to one that is the only one of its name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c, of in _lots(batches):
            n = len(of)
            own = np.flatnonzero(~c["extra"])
            there = own[:, None] + np.arange(width)
            inside = np.minimum(there, n - 1)
            same = (there < n) & (of[inside] == of[own][:, None])
            stops = ~c["tied"][inside] | ~same
            size = np.where(stops.any(axis=1), stops.argmax(axis=1) + 1, width)
            names = c["rank"][inside].astype(">i8").reshape(-1).view(np.uint8)
            begins = np.arange(len(own)) * width * 8
            yield pa.RecordBatch.from_arrays([pa.array(c["doc"][own]), pa.array(c["idx"][own]), _binary(names, begins, begins + size * 8), pa.array(np.zeros(len(own), np.int64))], names=["doc", "idx", "key", "tie"])

    return run


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, idx, rank, tied) of elements that tie, and of those behind them: no other name can decide between two that tie."""
    for c, of in _lots(batches):
        behind = np.zeros(len(of), bool)
        behind[1:] = (of[1:] == of[:-1]) & c["tied"][:-1]
        at = np.flatnonzero((c["tied"] & ~c["extra"]) | (~c["tied"] & behind))
        yield pa.RecordBatch.from_arrays([pa.array(c[n][at]) for n in ("doc", "idx", "rank", "tied")], names=["doc", "idx", "rank", "tied"])


def _base(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, idx, sample) of tied elements that one task holds, in the order of their sequences: their name and their place among all of it."""
    table = pa.Table.from_batches(list(batches))
    if table.num_rows:
        names, tied = table["rank"].to_numpy(), table["tied"].to_numpy()
        # what follows an element that ties ends with a name of its own, so no comparison goes beyond it
        order = kernels.invert(kernels.doubling_ranks(names)[-1])
        held = names[order]
        sample = np.empty(len(order), np.int64)
        sample[order] = held + np.arange(len(order)) - np.searchsorted(held, held)
        at = np.flatnonzero(tied)
        for part in pa.table({"doc": table["doc"].take(pa.array(at)), "idx": table["idx"].take(pa.array(at)), "sample": sample[at]}).to_batches(LOT):
            yield part


def _ranks(elements: DataFrame, stride: int, base: int) -> DataFrame:
    """(doc, idx, sample): the order of the sequences' suffixes, from (doc, idx, rank, tied) of all elements.

    Only elements that tie are ranked anew, by places among those of their name.
    """
    alone = elements.filter("NOT tied").select("doc", "idx", F.col("rank").alias("sample"))
    if not elements.filter("tied").limit(1).count():
        return alone
    kept = materialise(_by_sequence(elements, stride, 1).mapInArrow(_kept, "doc long, idx long, rank long, tied boolean"), "cover-kept")
    if kept.count() <= base:
        one = kept.repartition(1).sortWithinPartitions("doc", F.col("idx") % stride, "idx")
        return alone.unionByName(materialise(one.mapInArrow(_base, "doc long, idx long, sample long"), "cover-base"))
    keys = _by_sequence(kept, stride, NAME_COVER.period).mapInArrow(_name_keys(NAME_COVER.period), "doc long, idx long, key binary, tie long")
    ranked = _resolve(rank_split(keys, ["key", "tie"], ["doc", "idx"]), NAME_COVER, stride, base)
    named = materialise(kept.filter("tied").select("doc", "idx", F.col("rank").alias("name")).join(ranked, ["doc", "idx"]), "cover-named")
    first = named.groupBy("name").agg(F.min("rank").alias("first"))
    return alone.unionByName(materialise(named.join(first, "name").select("doc", "idx", (F.col("name") + F.col("rank") - F.col("first")).alias("sample")), "cover-ranks"))


def _windows(cover: Cover, stride: int):
    """(doc, idx, rank, residue, s): tied elements with the ranks of the covered places from theirs on, packed."""
    width = len(cover.residues)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c, _ in _lots(batches):
            covered = c["sample"] >= 0
            before = np.cumsum(covered) - covered
            own = np.flatnonzero((c["rank"] >= 0) & ~c["extra"])
            held = c["sample"][covered][before[own][:, None] + np.arange(width)]
            begins = np.arange(len(own)) * width * 8
            packed = _binary(held.astype("<i8").reshape(-1).view(np.uint8), begins, begins + width * 8)
            residue = (c["place"][own] % cover.period).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(c["doc"][own]), pa.array(c["idx"][own]), pa.array(c["rank"][own]), pa.array(residue), packed], names=["doc", "idx", "rank", "residue", "s"])

    return run


def _unpacked(packed: pa.Array, width: int) -> np.ndarray:
    """Ranks that ``_windows`` has packed, a row each."""
    offsets = np.frombuffer(packed.buffers()[1], np.int32)[packed.offset : packed.offset + len(packed) + 1]
    return np.frombuffer(packed.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view("<i8").reshape(len(packed), width)


def places(cover: Cover, group: np.ndarray, residue: np.ndarray, s: np.ndarray) -> np.ndarray:
    """The place of each row in the order of (group, suffix): how many rows of each residue are before it.

    Rows of one residue are in the order of any of their ranks. Rows of two residues
    compare by the ranks of the covered place that both reach first.
    """
    _, dense = np.unique(s, return_inverse=True)
    dense = dense.reshape(s.shape).astype(np.int64)
    key = group.astype(np.int64)[:, None] * (dense.max(initial=0) + 1) + dense
    classes = {}
    for r in np.unique(residue).tolist():
        own = np.flatnonzero(residue == r)
        classes[r] = own[np.argsort(key[own, 0], kind="stable")]
    out = np.zeros(len(group), np.int64)
    for r, rows in classes.items():
        for c, others in classes.items():
            out[rows] += np.searchsorted(key[others, cover.meeting[c, r]], key[rows, cover.meeting[r, c]])
    return out


def _splitters(tied: DataFrame, cover: Cover, bound: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Of each prefix that more than ``bound`` rows share, rows that part it into as many shares as it needs: their residues and ranks. At most one for every few rows that a task may hold."""
    hot = {r["rank"]: r["count"] for r in tied.groupBy("rank").count().filter(F.col("count") > bound).collect()}
    out = {}
    for rank, n in hot.items():
        shares = -(-2 * n // bound)
        few = tied.filter(F.col("rank") == rank).filter(F.pmod(F.xxhash64("doc", "idx"), F.lit(1 << 20)) <= (1 << 20) * min(1.0, 24 * shares / n))
        got = few.select("residue", "s").toArrow()
        residue = got["residue"].to_numpy()
        s = np.frombuffer(b"".join(got["s"].to_pylist()), "<i8").reshape(len(residue), len(cover.residues))
        order = np.argsort(places(cover, np.zeros(len(s), np.int64), residue, s))
        chosen = order[np.unique(np.linspace(0, len(order) - 1, shares + 1).astype(np.int64)[1:-1])] if len(order) else order
        out[rank] = (residue[chosen], s[chosen])
    return out


def _share(cover: Cover, splitters: dict[int, tuple[np.ndarray, np.ndarray]]):
    """Adds ``sub``, which of its prefix's shares a row is in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sub, ranks = np.zeros(batch.num_rows, np.int64), batch.column(2).to_numpy()
            for rank, (residues, held) in splitters.items():
                own = np.flatnonzero(ranks == rank)
                if len(own):
                    r = batch.column(3).to_numpy()[own]
                    s = _unpacked(batch.column(4), len(cover.residues))[own]
                    low, high = np.zeros(len(own), np.int64), np.full(len(own), len(residues))
                    while (low < high).any():
                        mid = np.minimum((low + high) >> 1, len(residues) - 1)
                        c = residues[mid]
                        after = (low < high) & (held[mid, cover.meeting[c, r]] <= s[np.arange(len(own)), cover.meeting[r, c]])
                        low, high = np.where(after, mid + 1, low), np.where(~after & (low < high), mid, high)
                    sub[own] = low
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sub)], names=[*batch.schema.names, "sub"])

    return run


def _place(cover: Cover):
    """(doc, idx, rank, sub, at): the place of each tied row within its prefix's share. A task's rows are whole shares, sorted by prefix."""

    def of(table: pa.Table) -> Iterator[pa.RecordBatch]:
        rank, sub, residue = (table[c].to_numpy() for c in ("rank", "sub", "residue"))
        s = np.concatenate([_unpacked(x, len(cover.residues)) for x in table["s"].chunks])
        group = np.concatenate(([0], np.cumsum((rank[1:] != rank[:-1]) | (sub[1:] != sub[:-1]))))
        begins = np.searchsorted(group, group)
        at = places(cover, group, residue, s) - begins
        yield from pa.table({"doc": table["doc"], "idx": table["idx"], "rank": table["rank"], "sub": table["sub"], "at": at}).to_batches(LOT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= LOT:
                table = pa.Table.from_batches(held)
                rank, sub = table["rank"].to_numpy(), table["sub"].to_numpy()
                cut = int(np.flatnonzero((rank == rank[-1]) & (sub == sub[-1]))[0])
                if cut:
                    yield from of(table.slice(0, cut))
                held = table.slice(cut).to_batches()
                size = table.num_rows - cut
        if size:
            yield from of(pa.Table.from_batches(held))

    return run


def _resolve(ranked: DataFrame, cover: Cover, stride: int, base: int, bound: int | None = None) -> DataFrame:
    """(doc, idx, rank) with all ranks different, from (doc, idx, rank, tied) by the cover's period of symbols."""
    if not ranked.filter("tied").limit(1).count():
        return ranked.select("doc", "idx", "rank")
    return ranked.filter("NOT tied").select("doc", "idx", "rank").unionByName(_resolve_tied(ranked, cover, stride, base, bound).drop("shared"))


def _resolve_tied(ranked: DataFrame, cover: Cover, stride: int, base: int, bound: int | None = None) -> DataFrame:
    """(doc, idx, shared, rank) of those that tie: the rank that they share, and their own."""
    ranked, bound = ranked.select("doc", "idx", "rank", "tied"), bound or TIED_ROWS
    sampled = _ranks(ranked.filter((_place_of(stride) % cover.period).isin(list(cover.residues))), stride * cover.period, base)
    none = F.lit(-1).cast("long")
    asked = ranked.filter("tied").select("doc", "idx", "rank", none.alias("sample"), F.lit(False).alias("covered"))
    # a covered place is listed behind the element that asks from there, which is its own first covered place
    known = sampled.select("doc", "idx", none.alias("rank"), "sample", F.lit(True).alias("covered"))
    rows = _by_sequence(asked.unionByName(known), stride, cover.period, "covered")
    tied = materialise(rows.mapInArrow(_windows(cover, stride), "doc long, idx long, rank long, residue long, s binary"), "cover-windows")
    splitters = _splitters(tied, cover, bound)
    shared = tied.mapInArrow(_share(cover, splitters), "doc long, idx long, rank long, residue long, s binary, sub long") if splitters else tied.withColumn("sub", F.lit(0).cast("long"))
    # ranks are places, so equal steps of ranks are ranges of about equal loads
    step = max(1, ranked.count() * RANGE_ROWS // (4 * max(1, tied.count())))
    dealt = shared.repartition(F.floor(F.col("rank") / step), F.col("sub")).sortWithinPartitions("rank", "sub")
    placed = materialise(dealt.mapInArrow(_place(cover), "doc long, idx long, rank long, sub long, at long"), "cover-places")
    shares = placed.filter("sub > 0").select("rank").distinct()
    counts = placed.join(F.broadcast(shares), "rank", "left_semi").groupBy("rank", "sub").agg(F.count(F.lit(1)).alias("n"))
    earlier = counts.select("rank", F.col("sub").alias("_s"), "n").join(counts.select("rank", "sub"), "rank").filter("_s < sub").groupBy("rank", "sub").agg(F.sum("n").alias("before"))
    return placed.join(F.broadcast(earlier), ["rank", "sub"], "left").select("doc", "idx", F.col("rank").alias("shared"), (F.col("rank") + F.coalesce("before", F.lit(0)) + F.col("at")).alias("rank"))


def suffix_ranks(docs: DataFrame, terminators: bool = False, base: int | None = None, bound: int | None = None) -> DataFrame:
    """(doc, idx, rank): the place of every suffix among all, equal ones by document.

    Whole documents are sorted once, with ranks of few places (``minima``). A document may
    come in pieces instead, ``docs`` being (doc, start, own, text): the place of a
    piece's first symbol, how many symbols are its own, and these with at least
    AHEAD of the symbols behind them, or all there are. ``base`` and ``bound`` replace
    BASE_ELEMENTS and, for pieces, TIED_ROWS. The tables on the way are deleted when the
    result is written.
    """
    if "start" not in docs.columns:
        from .minima import suffix_ranks as whole

        return whole(docs, terminators, base)

    def make() -> DataFrame:
        return _resolve(_first_ranks(docs, TEXT_COVER.period, terminators), TEXT_COVER, 1, base or BASE_ELEMENTS, bound)

    return scratch(docs.sparkSession, "suffix-ranks", make)


def suffix_prefixes(docs: DataFrame, base: int | None = None, bound: int | None = None) -> DataFrame:
    """(rnk, idx, doc, lcp): as ``suffix_ranks`` without terminators, with what each suffix shares with the one before it; the first has 0.

    Suffixes that the first sort parts are compared there. Only those that share all
    their first symbols with the one before them look further (``irreducible.beyond``).
    """
    from .irreducible import beyond

    def make() -> DataFrame:
        ranked = _first_ranks(docs, TEXT_COVER.period, False)
        known = ranked.filter("lcp IS NOT NULL AND NOT tied").select(F.col("rank").alias("rnk"), "idx", "doc", "lcp")
        if not ranked.filter("tied").limit(1).count():
            return known
        tied = _resolve_tied(ranked, TEXT_COVER, 1, base or BASE_ELEMENTS, bound)
        tied = materialise(tied.select(F.col("rank").alias("rnk"), "idx", "doc", "shared"), "tied-ranks")
        first = ranked.filter("lcp IS NOT NULL AND tied").select(F.col("rank").alias("rnk"), "lcp")
        heads = tied.filter("rnk = shared").join(first, "rnk").select("rnk", "idx", "doc", "lcp")
        return known.unionByName(heads).unionByName(beyond(docs, tied, TEXT_COVER.period))

    return scratch(docs.sparkSession, "suffix-prefixes", make)
