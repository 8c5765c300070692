"""Range minima and nearest smaller values over a long array in blocks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels
from ..plans.storage import materialise

BLOCK = 128
#: Entries that one task searches; of the rest it sees the minima of blocks of as many.
PART = 1 << 16


def block_minima(values: DataFrame, block: int = BLOCK) -> DataFrame:
    """(block, least) of (i, value)."""
    return values.groupBy(F.floor(F.col("i") / block).cast("long").alias("block")).agg(F.min("value").alias("least"))


def _search(backward: bool):
    """Places of a part's entries nearest to each question with a smaller value; -1: none in the part."""

    def run(key: tuple, asked: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        found = np.full(len(asked), -1, np.int64)
        if len(asked) and len(rows):
            rows = rows.sort_values("i", ignore_index=True)
            i, v, at = rows["i"].to_numpy(), rows["value"].to_numpy(), asked["at"].to_numpy()
            place = np.searchsorted(i, at, side="right") - 1 if backward else np.searchsorted(i, at)
            inside = (place >= 0) & (place < len(i))
            hit = (kernels.previous_smaller if backward else kernels.next_smaller)(v, asked["bound"].to_numpy()[inside], place[inside])
            found[inside] = np.where(hit < 0, -1, i[hit])
        return pd.DataFrame({"part": asked["part"], "at": asked["at"], "bound": asked["bound"], "found": found})

    return run


def nearest_below(values: DataFrame, asked: DataFrame, backward: bool, part: int = PART) -> DataFrame:
    """(at, bound, found) for questions (at, bound): the largest i <= at (smallest i >= at, unless ``backward``) with a value below the bound, else -1.

    Every part of the array answers its own questions. One that a part can't answer is
    asked again of the table of the parts' minima, in the same way, and then of the
    part that is found there. Equal questions are asked once.
    """
    number = lambda c: F.floor(F.col(c) / part).cast("long")
    values = values.select("i", F.col("value").cast("long").alias("value"), number("i").alias("part"))
    asked = materialise(asked.select("at", "bound").distinct().withColumn("part", number("at")), "asked")
    answer = "part long, at long, bound long, found long"
    rows = values.groupBy("part")
    near = materialise(asked.groupBy("part").cogroup(rows).applyInPandas(_search(backward), answer), "answered")
    minima = materialise(values.groupBy("part").agg(F.min("value").alias("value")).withColumnRenamed("part", "i"), "part-minima")
    if minima.limit(2).count() < 2:
        return near.select("at", "bound", "found")
    # the parts next to a question's own, and beyond
    far = near.filter("found < 0").select("at", "bound", (F.col("part") + (-1 if backward else 1)).alias("next"))
    there = nearest_below(minima, far.select(F.col("next").alias("at"), "bound"), backward, part)
    there = there.select(F.col("at").alias("next"), "bound", F.col("found").alias("part"))
    far = far.join(there, ["next", "bound"])
    # the end of the part that is nearest to the question
    end = F.col("part") * part + (part - 1 if backward else 0)
    wanted = far.filter("part >= 0").select("part", end.alias("at"), "bound").distinct()
    inside = wanted.groupBy("part").cogroup(rows).applyInPandas(_search(backward), answer).select("part", "bound", "found")
    late = far.join(inside, ["part", "bound"], "left").select("at", "bound", F.coalesce("found", F.lit(-1).cast("long")).alias("found"))
    return near.filter("found >= 0").select("at", "bound", "found").unionByName(late)


def nearest_smaller(values: DataFrame, part: int = PART) -> DataFrame:
    """(i, psv, nsv) of (i, value): largest j <= i and smallest j >= i with a smaller value than i's, else -1."""
    own = values.select("i", F.col("value").cast("long").alias("bound"))
    for name, backward in (("psv", True), ("nsv", False)):
        found = nearest_below(values, own.select(F.col("i").alias("at"), "bound"), backward, part)
        own = own.join(found.select(F.col("at").alias("i"), F.col("found").alias(name)), "i")
    return own.select("i", "psv", "nsv")


def widen(intervals: DataFrame, prefixes: DataFrame, part: int = PART) -> DataFrame:
    """(q, first, last) of (q, first, last, depth): each rank interval widened to all ranks that share ``depth`` symbols with it.

    ``prefixes``: (rnk, lcp). An interval ends before the next rank whose common prefix
    with the one before it is shorter.
    """
    values = prefixes.select(F.col("rnk").alias("i"), F.col("lcp").alias("value"))
    n = prefixes.agg(F.count(F.lit(1))).first()[0]
    asked = materialise(intervals.select("q", "first", (F.col("last") + 1).alias("after"), F.col("depth").cast("long").alias("depth")), "intervals")
    low = nearest_below(values, asked.select(F.col("first").alias("at"), F.col("depth").alias("bound")), True, part)
    high = nearest_below(values, asked.select(F.col("after").alias("at"), F.col("depth").alias("bound")), False, part)
    out = asked.join(low.select(F.col("at").alias("first"), F.col("bound").alias("depth"), F.col("found").alias("low")), ["first", "depth"])
    out = out.join(high.select(F.col("at").alias("after"), F.col("bound").alias("depth"), F.col("found").alias("high")), ["after", "depth"])
    return out.select("q", F.greatest(F.col("low"), F.lit(0).cast("long")).alias("first"), F.when(F.col("high") < 0, F.lit(n - 1)).otherwise(F.col("high") - 1).cast("long").alias("last"))


def contract_left(intervals: DataFrame, array: DataFrame, prefixes: DataFrame, part: int = PART) -> DataFrame:
    """(q, first, last) of (q, first, last, depth): the suffix-link interval, of the suffixes one symbol later, at ``depth``.

    ``array``: (rnk, idx, doc); ``prefixes``: (rnk, lcp). Where a bound's suffix has no
    next symbol the interval is that of all suffixes.
    """
    n = array.agg(F.count(F.lit(1))).first()[0]
    place = array.select(F.col("rnk").alias("_r"), F.col("doc").alias("_d"), (F.col("idx") + 1).alias("_i"))
    rank = array.select(F.col("doc").alias("_d"), F.col("idx").alias("_i"), F.col("rnk").alias("_n"))
    out = intervals
    for side in ("first", "last"):
        out = out.join(place, F.col(side) == F.col("_r")).drop("_r").join(rank, ["_d", "_i"], "left").drop("_d", "_i").withColumnRenamed("_n", f"next_{side}")
    out = materialise(out, "suffix-links")
    whole = F.col("next_first").isNull() | F.col("next_last").isNull()
    root = out.filter(whole).select("q", F.lit(0).cast("long").alias("first"), F.lit(n - 1).cast("long").alias("last"))
    linked = out.filter(~whole).select("q", F.col("next_first").alias("first"), F.col("next_last").alias("last"), "depth")
    return widen(linked, prefixes, part).unionByName(root)


def range_minimum(values: DataFrame, asked: DataFrame, block: int = BLOCK) -> DataFrame:
    """(q, least) of questions (q, first, last), both ends included, over (i, value).

    A question takes single values and then blocks at each of its ends and goes up to
    blocks of blocks for what lies between: at most two blocks' entries a level.
    """
    level = values.select("i", F.col("value").alias("value"))
    open_, parts = asked.select("q", "first", "last"), []
    while True:
        # entries up to the next block's begin, and from the last block's begin on
        b1, b2 = F.ceil(F.col("first") / block).cast("long"), F.floor((F.col("last") + 1) / block).cast("long")
        spans = open_.withColumn("b1", b1).withColumn("b2", b2)
        near = F.when(F.col("b1") >= F.col("b2"), F.array(F.struct(F.col("first").alias("a"), F.col("last").alias("z")))).otherwise(
            F.array(F.struct(F.col("first").alias("a"), (F.col("b1") * block - 1).alias("z")), F.struct((F.col("b2") * block).alias("a"), F.col("last").alias("z")))
        )
        ends = spans.select("q", F.explode(F.filter(near, lambda s: s["a"] <= s["z"])).alias("s")).select("q", F.explode(F.sequence("s.a", "s.z")).alias("i"))
        parts.append(ends.join(level, "i").select("q", "value"))
        open_ = materialise(spans.filter("b1 < b2").select("q", F.col("b1").alias("first"), (F.col("b2") - 1).alias("last")), "open-ranges")
        if not open_.limit(1).count():
            break
        level = materialise(block_minima(level, block).select(F.col("block").alias("i"), F.col("least").alias("value")), "minima")
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.groupBy("q").agg(F.min("value").alias("least"))
