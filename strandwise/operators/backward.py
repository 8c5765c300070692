"""Backward search: an index of a collection's transform as tables, and patterns that step through it together.

The transform lists, in the order of all suffixes (the empty one of each document
included), the symbol before each. It is kept in blocks of rows; a block also has, for
every symbol, where its occurrences before the block end in the order of all suffixes (its
checkpoint). A pattern's interval of ranks is narrowed from its last symbol to its first:
a step asks the block of each of its bounds for one number. All patterns step at once,
with one exchange by block for every symbol of the longest.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.packing import unpack
from ..plans.ranking import running_total
from ..plans.storage import materialise, materialise_compact
from . import placed
from . import symbols as sym
from .suffix_array import gsa

#: Rows of a block at least; it has sixteen times as many as there are symbols, so that checkpoints are small beside it.
BLOCK = 1 << 13
#: Ranks of an interval that one row stands for before it is listed.
LISTED = 1 << 14


@dataclass
class BackwardIndex:
    """``rows``: (rnk, doc, idx); ``blocks``: (block, codes, base), codes as numbers of as few bytes as the alphabet takes; ``alphabet``: symbols in order, numbered from 1; ``starts``: the first rank of each symbol's suffixes, and the end."""

    rows: DataFrame
    blocks: DataFrame
    alphabet: list[str]
    starts: list[int]
    block: int
    documents: int


def build(docs: DataFrame, block: int | None = None, plan: str = "auto") -> BackwardIndex:
    """The index of a collection. ``plan`` is that of the suffix array."""
    counts = sorted((r["symbol"], r["n"]) for r in sym.histogram(docs).collect())  # a row a symbol
    counts.sort(key=lambda x: [ord(c) for c in x[0]])
    alphabet = [s for s, _ in counts]
    documents = docs.count()
    starts = (documents + np.concatenate(([0], np.cumsum([n for _, n in counts])))).astype(np.int64).tolist()
    size = block or max(BLOCK, 16 * len(alphabet))
    rows = materialise_compact(gsa(docs, include_terminator=True, plan=plan).select("rnk", "doc", "idx"), "fm-rows")
    group = max(1, placed.TASK_ROWS // size)
    met, _ = placed.by_rank(docs, rows, starts[-1], _asked(np.array([ord(s) for s in alphabet], np.int64)), group * size)
    listed = materialise(met.mapInArrow(_listed(size, group, len(alphabet), _kind(len(alphabet))), "block long, codes binary, counts array<long>"), "fm-transform", compression="zstd")
    if starts[-1] % size == 0:  # the end of all ranks is asked for as well
        empty = docs.sparkSession.range(1).select(F.lit(starts[-1] // size).cast("long").alias("block"), F.lit(b"").alias("codes"), F.array_repeat(F.lit(0).cast("long"), len(alphabet) + 1).alias("counts"))
        listed = listed.unionByName(empty)
    dense = listed.select("block", F.posexplode("counts").alias("code", "n"))
    # what comes before in the order of (symbol, block) is where the symbol's next occurrence goes
    base = running_total(dense, ["code", "block"], "n", "base").groupBy("block").agg(F.transform(F.array_sort(F.collect_list(F.struct("code", "base"))), lambda x: x["base"]).alias("base"))
    blocks = base.join(listed.select("block", "codes"), "block")
    return BackwardIndex(rows, materialise(blocks, "fm-blocks"), alphabet, starts, size, documents)


def _kind(symbols: int) -> np.dtype:
    """Of a block's codes: as few bytes as the alphabet takes."""
    return np.dtype("u1" if symbols < 1 << 8 else "<u2" if symbols < 1 << 16 else "<u4")


def _asked(points: np.ndarray):
    """Of every suffix its rank and the number of the symbol before it, 0 at a document's begin."""

    def run(met: placed.Met) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        own = np.flatnonzero(met.own)
        before = met.symbols[met.at[own] - 1]
        codes = np.where(met.idx[own] > 0, np.searchsorted(points, before) + 1, 0)
        return met.rnk[own], met.rnk[own], codes, np.empty((len(own), 0), np.uint8)

    return run


def _listed(size: int, group: int, symbols: int, kind: np.dtype):
    """(block, codes, counts) of a range of whole blocks, one after another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, rnk, code, _ = unpack(batches, 0)
        own = rnk // (group * size) == part  # the last rank of the range before is not
        rnk, code = rnk[own], code[own]
        code = code[np.argsort(rnk)].astype(kind)
        for k in range(0, len(code), size):
            held = code[k : k + size]
            counts = np.bincount(held, minlength=symbols + 1)
            yield pa.RecordBatch.from_arrays([pa.array([part * group + k // size], pa.int64()), pa.array([held.tobytes()], pa.binary()), pa.array([counts], pa.list_(pa.int64()))], names=["block", "codes", "counts"])

    return run


def _coded(alphabet: list[str]):
    """(pattern, codes): a pattern's symbols as numbers, from the last to the first; 0 for one that no text has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {s: k + 1 for k, s in enumerate(alphabet)}
        for batch in batches:
            codes = [[number.get(s, 0) for s in reversed(p)] for p in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(codes, pa.list_(pa.int32()))], names=["pattern", "codes"])

    return run


def _step(size: int, kind: np.dtype):
    def run(key: tuple, asked: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        if not len(asked) or not len(block):
            return pd.DataFrame({"pattern": [], "low": [], "rank": []}).astype({"pattern": "object", "low": "bool", "rank": "int64"})
        codes, base = np.frombuffer(block["codes"].iloc[0], kind), np.asarray(block["base"].iloc[0])
        code, at = asked["code"].to_numpy(), (asked["rank"] % size).to_numpy()
        rank = base[code]
        for c in np.unique(code):
            own = code == c
            rank[own] += np.searchsorted(np.flatnonzero(codes == c), at[own])
        return pd.DataFrame({"pattern": asked["pattern"], "low": asked["low"], "rank": rank})

    return run


def intervals(index: BackwardIndex, patterns: DataFrame) -> DataFrame:
    """(pattern, first, after): the ranks of the suffixes that begin with each distinct pattern that is not empty, empty ones included in the order; first = after if there are none."""
    spark = patterns.sparkSession
    wanted = patterns.filter(F.length("pattern") > 0).select("pattern").distinct()
    state = wanted.mapInArrow(_coded(index.alphabet), "pattern string, codes array<int>")
    starts = spark.createDataFrame([(k + 1, int(a), int(b)) for k, (a, b) in enumerate(zip(index.starts, index.starts[1:]))], "code int, first long, after long")
    zero = F.lit(0).cast("long")
    state = state.withColumn("code", F.col("codes")[0]).join(F.broadcast(starts), "code", "left")
    state = materialise(state.select("pattern", "codes", F.coalesce("first", zero).alias("first"), F.coalesce("after", zero).alias("after")), "backward")
    longest = state.agg(F.max(F.size("codes"))).first()[0] or 0
    for k in range(1, longest):
        on = (F.size("codes") > k) & (F.col("first") < F.col("after")) & (F.get("codes", F.lit(k)) > 0)
        none = (F.size("codes") > k) & ~F.coalesce(on, F.lit(False))
        sides = F.explode(F.array(F.struct(F.lit(True).alias("low"), F.col("first").alias("rank")), F.struct(F.lit(False).alias("low"), F.col("after").alias("rank")))).alias("side")
        asked = state.filter(on).select("pattern", F.col("codes")[k].alias("code"), sides).select("pattern", "code", "side.*").withColumn("block", F.expr(f"rank div {index.block}"))
        asked = materialise(asked, "backward-asked")
        blocks = index.blocks.join(asked.select("block").distinct(), "block", "left_semi")
        moved = asked.groupBy("block").cogroup(blocks.groupBy("block")).applyInPandas(_step(index.block, _kind(len(index.alphabet))), "pattern string, low boolean, rank long")
        pairs = moved.groupBy("pattern").agg(F.max(F.when(F.col("low"), F.col("rank"))).alias("_first"), F.max(F.when(~F.col("low"), F.col("rank"))).alias("_after"))
        joined = state.join(pairs, "pattern", "left")
        first, after = (F.when(none, zero).otherwise(F.coalesce(f"_{c}", c)).alias(c) for c in ("first", "after"))
        state = materialise(joined.select("pattern", "codes", first, after), "backward")
    return state.select("pattern", "first", "after")


def count(index: BackwardIndex, patterns: DataFrame) -> DataFrame:
    """(pattern, n): number of occurrences of each distinct pattern that is not empty; 0 where there is none."""
    return intervals(index, patterns).select("pattern", (F.col("after") - F.col("first")).alias("n"))


def locate(index: BackwardIndex, patterns: DataFrame) -> DataFrame:
    """(pattern, doc, idx): all occurrences. A long interval is cut into pieces before its ranks are listed."""
    found = intervals(index, patterns).filter("first < after")
    pieces = found.select("pattern", "after", F.explode(F.sequence(F.col("first"), F.col("after") - 1, F.lit(LISTED))).alias("begin")).repartition("pattern", "begin")
    ranks = pieces.select("pattern", F.explode(F.sequence(F.col("begin"), F.least(F.col("begin") + LISTED, F.col("after")) - 1)).alias("rnk"))
    return ranks.join(index.rows, "rnk").select("pattern", "doc", "idx")


def refine(index: BackwardIndex, prefix: str, depth: int = 1) -> DataFrame:
    """(extension, first, last): rank intervals of the suffixes that begin with ``prefix``, by their next ``depth`` symbols, or fewer where a text ends. Ranks do not count empty suffixes."""
    spark = index.rows.sparkSession
    frontier = spark.createDataFrame([("",)], "extension string")
    head = F.lit(prefix)
    total = index.starts[-1]
    if prefix:
        held = intervals(index, frontier.select(F.concat(head, "extension").alias("pattern"))).select(F.lit("").alias("extension"), "first", "after")
    else:
        held = frontier.select("extension", F.lit(0 + index.documents).cast("long").alias("first"), F.lit(total).cast("long").alias("after"))
    held, parts = materialise(held.filter("first < after"), "prefix"), []
    for _ in range(depth):
        every = F.explode(F.filter(F.split(F.lit("".join(index.alphabet)), ""), lambda x: x != "")).alias("symbol")
        grown = held.select("extension", every).select(F.concat("extension", "symbol").alias("grown"), "extension")
        found = intervals(index, grown.select(F.concat(head, "grown").alias("pattern"))).filter("first < after")
        found = materialise(found.join(grown, found["pattern"] == F.concat(head, grown["grown"])).select("grown", "extension", "first", "after"), "prefix")
        # suffixes that end there come first
        least = found.groupBy("extension").agg(F.min("first").alias("_next"))
        parts.append(held.join(least, "extension", "left").select("extension", "first", F.coalesce("_next", "after").alias("after")).filter("first < after"))
        held = found.select(F.col("grown").alias("extension"), "first", "after")
    out = held
    for p in parts:
        out = out.unionByName(p)
    return out.select("extension", (F.col("first") - index.documents).alias("first"), (F.col("after") - 1 - index.documents).alias("last"))
