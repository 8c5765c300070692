"""Matching statistics against a reference of any size, by routing to ranges of its suffix array.

The reference is a relation of pieces; its suffix array is saved in ranges of ranks, each
with the first symbols of its suffixes. The first symbol strings of the ranges are
splitters: they route every suffix of the collection to the range that it belongs to,
which is searched there. The collection is never sorted, and no task or driver holds
the reference.

Most suffixes are decided by their first symbols. One that matches all of them has an
interval of ranks; the interval of twice the symbols follows from that of the place so
many symbols further on, for within an interval the ranks of what follows rise. So
rounds are as many as the doublings of the longest match, and only suffixes still
open take part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels
from ..plans.ranking import running_total
from ..plans.storage import materialise, scratch, spread
from . import symbols as sym
from .cover import AHEAD, suffix_ranks

#: Symbols by which suffixes are routed, ranks of a range, symbols of a piece, and suffixes that meet a range in one task.
WIDTH, RANGE, PIECE, LOAD = 32, 1 << 16, 1 << 14, 1 << 18
LOT = 1 << 16
MS = "doc long, idx long, pos long, len long, smaller boolean, next string"


def _cut(step: int, ahead: int):
    """(piece, at, part): a text from place ``start`` on, cut at multiples of the step; parts also go to the piece before, as what is behind it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = []
                for k in range(max(0, (start - ahead) // step), (start + len(text) - 1) // step + 1 if text else 0):
                    a, b = max(k * step, start), min((k + 1) * step + ahead, start + len(text))
                    if a < b:
                        rows.append((k, a, text[a - start : b - start]))
                for at in range(0, len(rows), 500):
                    piece, begin, part = zip(*rows[at : at + 500])
                    yield pa.RecordBatch.from_arrays([pa.array(piece, pa.int64()), pa.array(begin, pa.int64()), pa.array(part, pa.string())], names=["piece", "at", "part"])

    return run


def pieces(texts: DataFrame, step: int | None = None, ahead: int | None = None) -> DataFrame:
    """(doc, start, own, text): the texts of (doc, text), one behind another in the order of doc, as document 0 in even pieces that overlap."""
    step, ahead = step or PIECE, ahead or max(AHEAD, WIDTH + 1)
    starts = running_total(texts.select("doc", F.length("text").cast("long").alias("n")), ["doc"], "n", "start")
    total = starts.agg(F.sum("n")).first()[0] or 0
    placed = texts.join(starts.select("doc", "start"), "doc").select("start", "text")
    parts = placed.mapInArrow(_cut(step, ahead), "piece long, at long, part string").groupBy("piece").agg(F.array_sort(F.collect_list(F.struct("at", "part"))).alias("p"))
    text = F.array_join(F.transform("p", lambda x: x["part"]), "").alias("text")
    start = (F.col("piece") * step).alias("start")
    return parts.filter(F.col("piece") * step < total).select(F.lit(0).cast("long").alias("doc"), start, F.least(F.lit(step).cast("long"), F.lit(total) - F.col("piece") * step).alias("own"), text)


def _encoded(points: np.ndarray, width: int) -> np.ndarray:
    """The first ``width`` symbols of every suffix in three bytes each, one above the code point; nothing is zero, and sorts first."""
    p = np.concatenate((points + 1, np.zeros(width, np.int64)))
    data = np.stack(((p >> 16) & 255, (p >> 8) & 255, p & 255), axis=1).astype(np.uint8).reshape(-1)
    return np.lib.stride_tricks.sliding_window_view(data, 3 * width)[::3][: len(points)]


def _strings(rows: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(rows).view(f"S{rows.shape[1]}").reshape(-1)


def _bytes(rows: np.ndarray) -> pa.Array:
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(rows))])


def _heads(width: int):
    """(pos, rest, head) of every place of a reference; rest: the symbols that a piece has from there on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start, own, texts = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("start", "own", "text"))
            for a, n, text in zip(start, own, texts):
                points = kernels.code_points(text)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(a, a + n)), _bytes(_encoded(points, width)[:n])], names=["pos", "head"])

    return run


@dataclass
class RoutedReference:
    """``array``: (rnk, pos); ``ranges``: (part, rnk, pos, head), with the rows beside each range; ``splitters``: the heads at which ranges after the first begin."""

    array: DataFrame
    ranges: DataFrame
    splitters: np.ndarray
    symbols: int
    width: int
    size: int


def build(reference: DataFrame, width: int | None = None, size: int | None = None) -> RoutedReference:
    """Of texts (doc, text), which are one reference in the order of doc."""
    width, size = width or WIDTH, size or RANGE
    cut = materialise(pieces(reference, ahead=max(AHEAD, width + 1)), "reference-pieces")
    total = cut.agg(F.sum("own")).first()[0] or 0
    if not total:
        raise ValueError("the reference is empty")
    array = materialise(suffix_ranks(cut).select(F.col("rank").alias("rnk"), F.col("idx").alias("pos")), "reference-array")
    rows = array.join(cut.mapInArrow(_heads(width), "pos long, head binary"), "pos").withColumn("own", F.expr(f"rnk div {size}"))
    beside = F.array_distinct(F.array("own", F.greatest(F.expr(f"(rnk - 1) div {size}"), F.lit(0).cast("long")), F.least(F.expr(f"(rnk + 1) div {size}"), F.lit((total - 1) // size).cast("long"))))
    ranges = materialise(rows.select(F.explode(beside).alias("part"), "rnk", "pos", "head").repartition("part"), "reference-ranges")
    first = ranges.filter((F.col("rnk") % size == 0) & (F.col("rnk") > 0) & (F.expr(f"rnk div {size}") == F.col("part"))).orderBy("rnk").select("head").toArrow()["head"].to_pylist()  # a row a range
    return RoutedReference(array, ranges, np.array(first, f"S{3 * width}"), total, width, size)


def _route(splitters: np.ndarray, width: int, salts: dict[int, int], every: int = 1):
    """(part, salt, only_end, doc, idx, rest, head): suffixes by the range where they belong, and again by that where their interval ends if it is another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                points = kernels.code_points(text)
                for at in range(0, len(points), LOT):
                    heads = _encoded(points[at : at + LOT + width], width)[: min(LOT, len(points) - at)]
                    idx = np.arange(at, at + len(heads))
                    if every > 1:
                        kept = (idx * 2_654_435_761 + doc * 40_503 >> 5) % every == 0
                        heads, idx = heads[kept], idx[kept]
                    rest = len(points) - idx
                    last = heads.copy()
                    last[np.arange(3 * width) >= 3 * np.minimum(rest, width)[:, None]] = 255
                    low, high = np.searchsorted(splitters, _strings(heads), side="left"), np.searchsorted(splitters, _strings(last), side="right")
                    more = np.flatnonzero(high != low)
                    part = np.concatenate((low, high[more]))
                    own = np.concatenate((np.arange(len(low)), more))
                    if salts:
                        number = np.array([salts.get(p, 1) for p in part.tolist()])
                        salt = (idx[own] * 40_503 + doc) % number
                    else:
                        salt = np.zeros(len(part), np.int64)
                    only = np.arange(len(part)) >= len(low)
                    yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int64)), pa.array(salt.astype(np.int64)), pa.array(only), pa.array(np.full(len(own), doc)), pa.array(idx[own]), pa.array(rest[own].astype(np.int64)), _bytes(heads[own])], names=["part", "salt", "only_end", "doc", "idx", "rest", "head"])

    return run


def _shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Symbols that heads share, row by row."""
    width = a.shape[1] // 3
    same = (a == b).reshape(len(a), width, 3).all(axis=2)
    return np.where(same.all(axis=1), width, same.argmin(axis=1))


def _search(width: int, size: int):
    """(doc, idx, low, high, pos, len, smaller, next): what a range knows of its suffixes. Where nothing shares the whole head (or what is left of the text) the match is known; else the interval is, but for an end in another range (-1)."""
    empty = {"doc": "int64", "idx": "int64", "low": "int64", "high": "int64", "pos": "int64", "len": "int64", "smaller": "bool", "next": "object"}

    def run(key: tuple, asked: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if not len(asked) or not len(rows):
            return pd.DataFrame({c: pd.Series([], dtype=t) for c, t in empty.items()})
        rows = rows.sort_values("rnk", ignore_index=True)
        rnk, pos = rows["rnk"].to_numpy(), rows["pos"].to_numpy()
        heads = np.frombuffer(b"".join(rows["head"]), np.uint8).reshape(len(rows), 3 * width)
        given = np.frombuffer(b"".join(asked["head"]), np.uint8).reshape(len(asked), 3 * width)
        rest, only = asked["rest"].to_numpy(), asked["only_end"].to_numpy()
        begin = int(np.searchsorted(rnk, key[0] * size))
        end = int(np.searchsorted(rnk, (key[0] + 1) * size))
        own = _strings(heads[begin:end])
        last = given.copy()
        last[np.arange(3 * width) >= 3 * np.minimum(rest, width)[:, None]] = 255
        low, high = np.searchsorted(own, _strings(given), side="left") + begin, np.searchsorted(own, _strings(last), side="right") + begin
        # the row behind the range tells whether the interval goes on
        on = np.zeros(len(asked), bool)
        if end < len(rows):
            at_end = np.flatnonzero(high == end)
            on[at_end] = _shared(given[at_end], np.repeat(heads[end][None], len(at_end), axis=0)) >= np.minimum(rest[at_end], width)
        open_ = (high > low) | on
        nxt = np.where(low < len(rows), _shared(given, heads[np.minimum(low, len(rows) - 1)]), -1)
        prv = np.where(low > 0, _shared(given, heads[np.maximum(low - 1, 0)]), -1)
        # heads of texts that end share their ends as well
        nxt, prv = np.minimum(nxt, rest), np.minimum(prv, rest)
        smaller = nxt >= prv
        found, length = pos[np.clip(np.where(smaller, low, low - 1), 0, len(rows) - 1)], np.maximum(nxt, prv)
        more = np.minimum(np.maximum(length, 0), width - 1)
        points = (given.reshape(len(given), width, 3)[np.arange(len(given)), more] * np.array([65536, 256, 1])).sum(axis=1) - 1
        symbol = [None if n >= r or o else chr(p) for n, r, o, p in zip(length, rest, open_ | only, points)]
        rank = lambda x: np.where(x < len(rows), rnk[np.minimum(x, len(rows) - 1)], rnk[-1] + 1)
        out = pd.DataFrame({"doc": asked["doc"], "idx": asked["idx"], "low": np.where(only, -1, rank(low)), "high": np.where(on & ~only, -1, rank(high)), "pos": np.where(open_ | only, -1, found), "len": length, "smaller": smaller, "next": symbol})
        return out

    return run


def _narrow(size: int):
    """(doc, idx, below, until): how many ranks of a part of an interval go on before ``a``, and before ``b``."""

    def run(key: tuple, asked: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if not len(asked) or not len(rows):
            return pd.DataFrame({"doc": [], "idx": [], "below": [], "until": []}).astype("int64")
        rows = rows.sort_values("rnk", ignore_index=True)
        first, v = int(rows["rnk"].iloc[0]), rows["v"].to_numpy()
        begin, end = np.maximum(asked["low"].to_numpy(), first) - first, np.minimum(asked["high"].to_numpy(), first + len(v)) - first
        out = []
        for bound in ("a", "b"):
            wanted, low, high = asked[bound].to_numpy(), begin.copy(), end.copy()
            while (low < high).any():  # within an interval what follows rises
                mid = np.minimum((low + high) >> 1, len(v) - 1)
                less = (low < high) & (v[mid] < wanted)
                low, high = np.where(less, mid + 1, low), np.where(~less & (low < high), mid, high)
            out.append(low - begin)
        return pd.DataFrame({"doc": asked["doc"], "idx": asked["idx"], "below": out[0], "until": out[1]})

    return run


def _ended(index: RoutedReference, rows: DataFrame) -> DataFrame:
    """(doc, idx, pos, len, smaller) of suffixes that are matched to their text's end, from (doc, idx, rest, low, high).

    The one behind in order is matched, unless it is shorter: then the reference ends there too, and that suffix, which comes first, is.
    """
    first = index.array.select(F.col("rnk").alias("low"), F.col("pos").alias("p0"))
    second = index.array.select((F.col("rnk") - 1).alias("low"), F.col("pos").alias("p1"))
    held = rows.join(first, "low").join(second, "low", "left")
    equal = F.lit(index.symbols) - F.col("p0") == F.col("rest")
    after = F.col("low") + 1 < F.col("high")
    return held.select("doc", "idx", F.when(equal & after, F.col("p1")).otherwise(F.col("p0")).alias("pos"), F.col("rest").alias("len"), (~equal | after).alias("smaller"))


def _prefixes(rows: DataFrame, side: str, history: list[tuple[int, DataFrame]], index: RoutedReference, isa: DataFrame, docs: DataFrame, heads: DataFrame, depth: int) -> DataFrame:
    """``rows`` (with doc, idx and the reference's place ``side``) with ``<side>_len``: the common prefix, known to be ``depth`` and less than twice as much; -1 where the place is null."""
    n = f"{side}_len"
    rows = rows.withColumn(n, F.lit(depth).cast("long"))
    for h, held in reversed([x for x in history if x[0] < depth]):
        there = held.select(F.col("doc").alias("_d"), F.col("idx").alias("_i"), F.col("low").alias("_a"), F.col("high").alias("_b"))
        ranks = isa.select(F.col("pos").alias("_p"), F.col("rnk").alias("_r"))
        both = rows.join(there, (F.col("doc") == F.col("_d")) & (F.col("idx") + F.col(n) == F.col("_i")), "left").join(ranks, F.col(side) + F.col(n) == F.col("_p"), "left")
        same = F.coalesce((F.col("_r") >= F.col("_a")) & (F.col("_r") < F.col("_b")), F.lit(False))
        rows = materialise(both.withColumn(n, F.col(n) + F.when(same, h).otherwise(0)).select(*rows.columns), "prefixes")
    # what is left is shorter than a head
    tail = sym.snippets(rows, docs, "doc", F.col("idx") + F.col(n), index.width, "_more")
    tail = tail.join(heads.select(F.col("pos").alias("_p"), "head"), F.col(side) + F.col(n) == F.col("_p"), "left").drop("_p")
    names, schema, width = rows.columns, rows.schema, index.width

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ends = [0 if head is None else int(_shared(_encoded(kernels.code_points(text), width)[:1], np.frombuffer(head, np.uint8)[None])[0]) if text else 0 for text, head in zip(b["_more"], b["head"])]
            ends = np.minimum(ends, [len(t) for t in b["_more"]]) if len(b) else ends
            b[n] = b[n] + np.array(ends, np.int64)
            b[n] = np.where(b[side].isna(), -1, b[n])
            yield b.astype({c: "Int64" for c in ("after", "before")})[names]

    return tail.mapInPandas(run, schema)


def matching_statistics(index: RoutedReference, docs: DataFrame) -> DataFrame:
    """(doc, idx, pos, len, smaller, next) of every place of ``docs``; of two equally long matches the one that sorts after is taken."""
    return scratch(docs.sparkSession, "matching-statistics", lambda: _match(index, docs))


def _match(index: RoutedReference, docs: DataFrame) -> DataFrame:
    docs = docs.select("doc", "text")
    width, size, rows = index.width, index.size, spread(docs)
    schema = "part long, salt long, only_end boolean, doc long, idx long, rest long, head binary"
    # the load of every range, from a sample of places
    every = 64
    loads = rows.mapInArrow(_route(index.splitters, width, {}, every), schema).groupBy("part").count().collect()  # a row a range
    salts = {r["part"]: -(-r["count"] * every // LOAD) for r in loads if r["count"] * every > LOAD}
    asked = rows.mapInArrow(_route(index.splitters, width, salts), schema)
    number = F.lit(1) if not salts else F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p, n in salts.items() for x in (p, n)]), F.col("part")), F.lit(1))
    given = index.ranges.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), (number - 1).cast("long"))))
    found = asked.groupBy("part", "salt").cogroup(given.groupBy("part", "salt")).applyInPandas(_search(width, size), "doc long, idx long, low long, high long, pos long, len long, smaller boolean, next string")
    first = materialise(found, "routed")
    sizes = docs.select("doc", F.length("text").cast("long").alias("n"))
    known = first.filter("pos >= 0").select("doc", "idx", "pos", "len", "smaller", "next")
    ends = first.filter("low < 0").select("doc", "idx", F.col("high").alias("end"))
    held = first.filter("low >= 0 AND pos < 0").select("doc", "idx", "low", "high").join(ends, ["doc", "idx"], "left")
    held = held.select("doc", "idx", "low", F.when(F.col("high") < 0, F.col("end")).otherwise(F.col("high")).alias("high")).join(sizes, "doc").select("doc", "idx", (F.col("n") - F.col("idx")).alias("rest"), "low", "high")
    held = materialise(held, "intervals")
    parts = [known]
    closed = [_ended(index, held.filter(F.col("rest") <= width))]
    open_ = held.filter(F.col("rest") > width)
    # of places that are settled, where they go in the reference's order
    at = F.col("low").alias("high")
    settled = [first.filter("pos >= 0").select("doc", "idx", "low", at), held.filter(F.col("rest") <= width).select("doc", "idx", "low", "high")]
    history, depth = [(width, held.filter(F.col("rest") >= width).select("doc", "idx", "low", "high"))], width
    isa = index.array.select("pos", "rnk")
    heads = index.ranges.filter(F.expr(f"rnk div {size}") == F.col("part")).select("pos", "head")
    while open_.limit(1).count():
        beyond = open_.select("doc", "idx", "low", "high")
        for s in settled:
            beyond = beyond.unionByName(s)
        there = beyond.select(F.col("doc").alias("_d"), (F.col("idx") - depth).alias("_i"), F.col("low").alias("a"), F.col("high").alias("b"))
        pairs = materialise(open_.join(there, (F.col("doc") == F.col("_d")) & (F.col("idx") == F.col("_i"))).drop("_d", "_i"), "doubled-asked")
        follow = isa.select((F.col("pos") - depth).alias("pos"), F.col("rnk").alias("v"))
        values = index.array.join(follow, "pos", "left").select(F.expr(f"rnk div {size}").alias("part"), "rnk", F.coalesce("v", F.lit(-1).cast("long")).alias("v"))
        spans = pairs.withColumn("part", F.explode(F.sequence(F.expr(f"low div {size}"), F.expr(f"(high - 1) div {size}"))))
        values = values.join(spans.select("part").distinct(), "part", "left_semi")
        counts = spans.groupBy("part").cogroup(values.groupBy("part")).applyInPandas(_narrow(size), "doc long, idx long, below long, until long")
        counts = counts.groupBy("doc", "idx").agg(F.sum("below").alias("below"), F.sum("until").alias("until"))
        moved = pairs.join(counts, ["doc", "idx"]).select("doc", "idx", "rest", "low", "high", (F.col("low") + F.col("below")).alias("lo"), (F.col("low") + F.col("until")).alias("hi"))
        moved = materialise(moved, "doubled")
        lost = moved.filter("lo = hi")
        # the neighbours in order that share the last interval
        place = lambda c, on: index.array.select((F.col("rnk") + on).alias("lo"), F.col("pos").alias(c))
        near = lost.join(place("after", 0), "lo", "left").join(place("before", 1), "lo", "left")
        near = near.select("doc", "idx", "rest", "lo", F.when(F.col("lo") < F.col("high"), F.col("after")).alias("after"), F.when(F.col("lo") > F.col("low"), F.col("before")).alias("before"))
        for side in ("after", "before"):
            near = _prefixes(materialise(near, "neighbours"), side, history, index, isa, docs, heads, depth)
        near = materialise(near, "neighbours")
        chosen = F.col("after_len") >= F.col("before_len")
        closed.append(near.select("doc", "idx", F.when(chosen, F.col("after")).otherwise(F.col("before")).alias("pos"), F.greatest("after_len", "before_len").alias("len"), chosen.alias("smaller")))
        settled.append(lost.select("doc", "idx", F.col("lo").alias("low"), F.col("lo").alias("high")))
        depth *= 2
        going = moved.filter("lo < hi").select("doc", "idx", "rest", F.col("lo").alias("low"), F.col("hi").alias("high"))
        done = going.filter(F.col("rest") <= depth)
        closed.append(_ended(index, done))
        settled.append(done.select("doc", "idx", "low", "high"))
        history.append((depth, going.filter(F.col("rest") >= depth).select("doc", "idx", "low", "high")))
        open_ = going.filter(F.col("rest") > depth)
    late = closed[0]
    for c in closed[1:]:
        late = late.unionByName(c)
    late = sym.snippets(late, docs, "doc", F.col("idx") + F.col("len"), 1, "next")
    return known.unionByName(late.select("doc", "idx", "pos", "len", "smaller", F.when(F.col("next") != "", F.col("next")).alias("next")))
