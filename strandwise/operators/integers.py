"""Transforms and prefixes of integer sequences; symbols of any width are the same case.

Sequences within a bound, which is checked first, are sorted inside a task each. If one
is longer, all go through tables: suffix arrays by doubling, prefixes by the ranks of
all widths, and the inverse transform by a walk from stop to stop, of stops only, and so on.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import kernels
from ..plans.ranking import global_rank, running_total
from ..plans.storage import materialise
from .suffix_array import _integer_history, integer_suffix_array

#: Symbols of a sequence up to which one task sorts it.
SEQUENCE_SYMBOLS = 2_000_000
#: One in so many nodes of a walk is a stop for the steps of all others.
STOPS = 4


def _fits(values: DataFrame) -> bool:
    return (values.groupBy("seq").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0) <= SEQUENCE_SYMBOLS


def _dense(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    values = rows.sort_values("pos")["value"].to_numpy()
    alphabet, codes = np.unique(values, return_inverse=True)
    return alphabet, codes.astype(np.int64)


def lcp(values: DataFrame) -> DataFrame:
    """(seq, rnk, pos, lcp) of (seq, pos, value)."""

    if not _fits(values):
        return _lcp_by_tables(values)

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        order, found = kernels.lcp_array(_dense(rows)[1])
        return pd.DataFrame({"seq": key[0], "rnk": np.arange(len(order)), "pos": order, "lcp": found})

    return values.groupBy("seq").applyInPandas(run, "seq long, rnk long, pos long, lcp long")


def bwt(values: DataFrame) -> DataFrame:
    """(seq, row, value, primary): the transform of each sequence, its primary index in every row."""

    if not _fits(values):
        return _bwt_by_tables(values)

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        alphabet, codes = _dense(rows)
        transform, primary = kernels.bwt(codes)
        return pd.DataFrame({"seq": key[0], "row": np.arange(len(transform)), "value": alphabet[transform], "primary": primary})

    return values.groupBy("seq").applyInPandas(run, "seq long, row long, value long, primary long")


def inverse_bwt(transforms: DataFrame) -> DataFrame:
    """(seq, pos, value) of (seq, row, value, primary)."""

    if not _fits(transforms):
        return _inverse_by_tables(transforms)

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        alphabet, codes = np.unique(rows.sort_values("row")["value"].to_numpy(), return_inverse=True)
        text = kernels.inverse_bwt(codes.astype(np.int64), int(rows["primary"].iloc[0]))
        return pd.DataFrame({"seq": key[0], "pos": np.arange(len(text)), "value": alphabet[text]})

    return transforms.groupBy("seq").applyInPandas(run, "seq long, pos long, value long")


def _sizes(values: DataFrame) -> DataFrame:
    return values.groupBy("seq").agg(F.count(F.lit(1)).alias("n"))


def _lcp_by_tables(values: DataFrame) -> DataFrame:
    history = _integer_history(values)
    order = materialise(integer_suffix_array(values), "int-array")
    before = order.select("seq", (F.col("rnk") + 1).alias("rnk"), F.col("pos").alias("pos2"))
    pairs = order.join(before, ["seq", "rnk"], "left").join(_sizes(values), "seq").withColumn("lcp", F.lit(0).cast("long"))
    for h, ranks in reversed(history):
        one = ranks.select(F.col("doc").alias("_d"), F.col("idx").alias("_i"), F.col("rank").alias("_r"))
        there = pairs
        for at, name in (("pos", "r1"), ("pos2", "r2")):
            there = there.join(one, (F.col("seq") == F.col("_d")) & (F.col(at) + F.col("lcp") == F.col("_i")), "left").drop("_d", "_i").withColumnRenamed("_r", name)
        # a shared rank means as many shared symbols where neither suffix ends before
        whole = (F.greatest("pos", "pos2") + F.col("lcp") + h <= F.col("n")) & (F.col("r1") == F.col("r2"))
        pairs = materialise(there.withColumn("lcp", F.col("lcp") + F.when(whole, F.lit(h)).otherwise(F.lit(0))).select(*pairs.columns), "int-prefixes")
    return pairs.select("seq", "rnk", "pos", "lcp")


def _bwt_by_tables(values: DataFrame) -> DataFrame:
    order = materialise(integer_suffix_array(values), "int-array")
    whole = order.filter("pos = 0").select("seq", (F.col("rnk") + 1).alias("primary"))
    # the symbol before a suffix; the transform begins with the last symbol, and the whole sequence has no row
    before = values.select("seq", (F.col("pos") + 1).alias("pos"), "value")
    rows = order.join(before, ["seq", "pos"]).join(whole, "seq").select("seq", F.when(F.col("rnk") + 1 < F.col("primary"), F.col("rnk") + 1).otherwise(F.col("rnk")).alias("row"), "value", "primary")
    last = values.join(_sizes(values), "seq").filter(F.col("pos") == F.col("n") - 1).join(whole, "seq").select("seq", F.lit(0).cast("long").alias("row"), "value", "primary")
    return materialise(rows.unionByName(last), "int-transform")


def _inverse_by_tables(transforms: DataFrame) -> DataFrame:
    """A node is a suffix by its place in order, from 1; its step leads to the suffix one symbol later, and the last one's to node 0."""
    sizes = materialise(running_total(_sizes(transforms), ["seq"], "n", "before"), "int-sizes")
    placed = global_rank(transforms, ["seq", "value", "row"], row="place")
    row = F.when(F.col("row") < F.col("primary"), F.col("row")).otherwise(F.col("row") + 1)
    steps = placed.join(sizes, "seq").select("seq", (F.col("place") - F.col("before") + 1).alias("node"), "value", "n", row.alias("next"))
    steps = materialise(steps, "int-steps")
    far = _walked(steps.select("seq", "node", "next", F.lit(1).cast("long").alias("far")))
    return steps.select("seq", "node", "value", "n").join(far, ["seq", "node"]).select("seq", (F.col("n") - F.col("far")).alias("pos"), "value")


def _walk(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """The distances of one walk's nodes, by doubling."""
    rows = rows.sort_values("node")
    node, end = rows["node"].to_numpy(), len(rows)
    after = rows["next"].to_numpy()
    to = np.append(np.where(after == 0, end, np.searchsorted(node, after)), end)
    far = np.append(rows["far"].to_numpy(), 0)
    while (to < end).any():
        far, to = far + far[to], to[to]
    return pd.DataFrame({"seq": key[0], "node": node, "far": far[:-1]})


def _walked(steps: DataFrame, level: int = 0) -> DataFrame:
    """(seq, node, far): how far each node is from node 0, from (seq, node, next, far) of single steps.

    One node in STOPS, by its hash, is a stop. Steps are doubled until they lead to one,
    which takes few rounds, and what has arrived is not moved again. The stops make up a
    shorter walk of the same kind, so rows moved are in proportion to the nodes.
    """
    if _fits(steps):
        return steps.groupBy("seq").applyInPandas(_walk, "seq long, node long, far long")

    def stops(node: str) -> Column:
        return F.pmod(F.xxhash64("seq", node, F.lit(level)), F.lit(STOPS)) == 0

    moving = (F.col("next") > 0) & ~stops("next")
    there, open_ = [steps.filter(~moving)], steps.filter(moving)
    while open_.limit(1).count():
        known = reduce(DataFrame.unionByName, [*there, open_]).filter(~stops("node"))
        ahead = known.select("seq", F.col("node").alias("next"), F.col("next").alias("then"), F.col("far").alias("more"))
        moved = open_.join(ahead, ["seq", "next"]).select("seq", "node", F.col("then").alias("next"), (F.col("far") + F.col("more")).alias("far"))
        moved = materialise(moved, "int-walk")
        there.append(moved.filter(~moving))
        open_ = moved.filter(moving)
    arrived = reduce(DataFrame.unionByName, there)
    held = materialise(_walked(materialise(arrived.filter(stops("node")), "int-stops"), level + 1), "int-stops")
    rest = held.select("seq", F.col("node").alias("next"), F.col("far").alias("more"))
    others = arrived.filter(~stops("node")).join(rest, ["seq", "next"], "left")
    return others.select("seq", "node", (F.col("far") + F.coalesce("more", F.lit(0).cast("long"))).alias("far")).unionByName(held)


def histogram(values: DataFrame) -> DataFrame:
    """(value, n) over all sequences."""
    return values.groupBy("value").agg(F.count(F.lit(1)).alias("n"))
