"""Exact search for any number of strings in one pass over the texts, by hashes of windows.

A string's anchor is its first symbols, of one of a few widths. Hashes of all windows of
these widths are taken from prefix sums of a polynomial; a bitmap of fixed size, made of
all anchors, lets through what may be one, and only that is joined and compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels
from ..plans.storage import materialise, spread
from . import symbols as sym

#: Widths of anchors at most, bits of the bitmap, symbols that are hashed at once, and rows of anchors up to which they are broadcast.
WIDTHS, BITS, LOT, BROADCAST_ROWS = 8, 1 << 26, 1 << 19, 50_000
_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so that it has an inverse


def _powers(base: np.uint64, n: int) -> np.ndarray:
    return np.concatenate((np.ones(1, np.uint64), np.cumprod(np.full(max(n - 1, 0), base, np.uint64), dtype=np.uint64)))[:n]


_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def window_hashes(points: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of every window of ``width`` symbols."""
    n = len(points)
    if n < width:
        return np.empty(0, np.int64)
    terms = (points.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, n)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)))
    h = (sums[width:] - sums[:-width]) * _powers(_INVERSE, n - width + 1)
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return h.view(np.int64)


def _anchored(widths: list[int]):
    """(pattern, width, hash): each string with its anchor, the widest that it has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).to_pylist()
            chosen = [max(w for w in widths if w <= len(t)) for t in texts]
            hashes = [int(window_hashes(kernels.code_points(t[:w]), w)[0]) for t, w in zip(texts, chosen)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(chosen, pa.int32()), pa.array(hashes, pa.int64())], names=["pattern", "width", "hash"])

    return run


def _bit(h: np.ndarray) -> np.ndarray:
    return h & (BITS - 1)


def _windows(widths: list[int], sent):
    """(width, hash, doc, idx, window) of all windows that the bitmap lets through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = sent.value
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                points = kernels.code_points(text)
                for width in widths:
                    for at in range(0, len(points) - width + 1, LOT):
                        h = window_hashes(points[at : at + LOT + width - 1], width)
                        bit = _bit(h)
                        hit = np.flatnonzero((bitmap[bit >> 6] >> (bit & 63).astype(np.uint64)) & np.uint64(1))
                        for a in range(0, len(hit), 20_000):
                            own = hit[a : a + 20_000]
                            places = own + at
                            cut = pa.array([text[i : i + width] for i in places.tolist()], pa.string())
                            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), width, np.int32)), pa.array(h[own]), pa.array(np.full(len(own), doc)), pa.array(places), cut], names=["width", "hash", "doc", "idx", "window"])

    return run


def locate(docs: DataFrame, patterns: DataFrame) -> DataFrame:
    """(pattern, doc, idx): all occurrences, overlapping ones too, of each pattern that is not empty."""
    wanted = patterns.filter(F.length("pattern") > 0).select("pattern").distinct()
    lengths = [r["n"] for r in wanted.groupBy(F.length("pattern").alias("n")).count().orderBy("n").limit(WIDTHS + 1).collect()]
    # of many lengths, powers of two are anchors, and what is longer is compared behind them
    widths = lengths if len(lengths) <= WIDTHS else [1 << k for k in range(WIDTHS)]
    spark = docs.sparkSession
    anchors = materialise(wanted.mapInArrow(_anchored(widths), "pattern string, width int, hash long") if lengths else wanted.selectExpr("pattern", "1 AS width", "0L AS hash"), "anchors")
    # a row a word of the bitmap that has a bit
    bit = F.expr(f"hash & {BITS - 1}L")
    words = anchors.select(F.shiftright(bit, 6).alias("word"), F.expr(f"shiftleft(1L, cast((hash & {BITS - 1}L) & 63 AS int))").alias("bits")).groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    bitmap = np.zeros(BITS >> 6, np.uint64)
    bitmap[words["word"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    found = spread(docs.select("doc", "text")).mapInArrow(_windows(widths, spark.sparkContext.broadcast(bitmap)), "width int, hash long, doc long, idx long, window string")
    known = F.broadcast(anchors) if anchors.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else anchors
    met = found.join(known, ["width", "hash"]).filter(F.left("pattern", F.col("width")) == F.col("window"))
    if len(lengths) <= WIDTHS:
        return met.select("pattern", "doc", "idx")
    whole = met.filter(F.length("pattern") == F.col("width")).select("pattern", "doc", "idx")
    longer = materialise(met.filter(F.length("pattern") > F.col("width")).select("pattern", "doc", "idx", F.col("width").cast("long").alias("at")), "begun")
    parts = [whole]
    while longer.limit(1).count():  # by pieces, of which each is as long as all before
        width = int(longer.agg(F.max("at")).first()[0])
        both = sym.snippets(longer, docs, "doc", F.col("idx") + F.col("at"), width, "_more")
        same = F.substring("pattern", (F.col("at") + 1).cast("int"), F.lit(width)) == F.substring("_more", F.lit(1), F.least(F.lit(width), F.length("pattern") - F.col("at")).cast("int"))
        longer = materialise(both.filter(same).select("pattern", "doc", "idx", (F.col("at") + width).alias("at")), "begun")
        parts.append(longer.filter(F.length("pattern") <= F.col("at")).select("pattern", "doc", "idx"))
        longer = longer.filter(F.length("pattern") > F.col("at"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
