"""Packing of token sequences into windows by best-fit decreasing.

A document longer than a window is first cut into full windows; what is left over
joins the other documents. Pieces are dealt to groups of bounded size by a hash and
each group is packed by itself: longest piece first, into the open window with the
least room that still takes it, which a segment tree over remaining capacities
finds in as many steps as a capacity has bits. Only lengths and checksums travel.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import tokens
from ._common import read_table, save, sized

WINDOW = 4096
#: Pieces that one task packs; a group leaves about one window partly filled.
GROUP_PIECES = 40_000
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
_BATCH = 20_000


def _cut(vocabulary: str, end_id: int, window: int):
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]

    def batch_of(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(x), pa.int64()) for x in zip(*rows)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, rows = tokens.encoder(vocabulary), []
        for doc, ids in encoder.encode_rows(batches, end_id):
            for at in range(0, len(ids), window):
                piece = ids[at : at + window]
                rows.append((doc, at, len(piece), tokens.crc32(piece), len(ids)))
            if len(rows) >= _BATCH:
                yield batch_of(rows)
                rows = []
        if rows:
            yield batch_of(rows)

    return run


class CapacityTree:
    """Segment tree over remaining capacities 0 to ``window``: counts of open windows, smallest sufficient capacity first."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.count = [0] * (2 * self.leaves)

    def add(self, capacity: int, n: int) -> None:
        at = self.leaves + capacity
        while at:
            self.count[at] += n
            at >>= 1

    def tightest(self, need: int) -> int:
        """The smallest capacity of at least ``need`` that an open window has; -1: none."""
        count, at = self.count, self.leaves + need
        if count[at]:
            return need
        while at > 1:  # up to the first right-hand subtree with a window, then down its left edge
            if not at & 1 and count[at + 1]:
                at += 1
                while at < self.leaves:
                    at = 2 * at if count[2 * at] else 2 * at + 1
                return at - self.leaves
            at >>= 1
        return -1


def best_fit_decreasing(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """For lengths in falling order: the window each goes to and its offset there."""
    tree, open_at = CapacityTree(window), {}
    to, offset, n = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), 0
    for i, length in enumerate(lengths.tolist()):
        room = tree.tightest(length)
        if room < 0:
            at, room, n = n, window, n + 1
        else:
            at = open_at[room].pop()
            tree.add(room, -1)
        to[i], offset[i] = at, window - room
        if room > length:
            tree.add(room - length, 1)
            open_at.setdefault(room - length, []).append(at)
    return to, offset


def _pack(window: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True], kind="stable", ignore_index=True)
        group["local"], group["offset"] = best_fit_decreasing(group["length"].to_numpy(), window)
        return group

    return run


def pack(docs: DataFrame, window: int = WINDOW, vocabulary: str | None = None, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null text is empty and still has its end id; a null id stays null; rows that share
    an id are packed each. An empty table gives no rows. Other columns are not read.
    A document longer than a window is cut into full windows and a rest. Pieces of one
    length are taken by id, start and content.
    """
    pieces = save(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_cut(vocabulary or tokens.default_vocabulary(), end_id, window), PIECES), "pieces")
    groups = max(1, -(-pieces.count() // GROUP_PIECES))
    group = F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(groups)).cast("int")
    packed = save(pieces.withColumn("bin", group).groupBy("bin").applyInPandas(_pack(window), f"{PIECES}, bin int, local long, offset long"), "packed")
    sizes = packed.groupBy("bin").agg((F.max("local") + 1).alias("n"))  # a row a group of GROUP_PIECES
    before = F.coalesce(F.sum("n").over(Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = save(sizes.select("bin", before.alias("first")), "first-windows")
    return packed.join(sized(first), "bin").select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("first") + F.col("local")).alias("sequence_id"), "offset")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into windows of 4096 tokens; nulls, ties, repeats and empty tables as ``pack`` states."""
    return pack(read_table(spark, sf_dir, "documents"))
