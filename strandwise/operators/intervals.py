"""The tree of common-prefix intervals of a suffix array: a suffix tree's inner nodes as a relation.

A node is a range of ranks (first, last) whose suffixes share ``depth`` symbols and no
more, and which no range around it does. The root holds all suffixes, at depth 0. All
is joins by rank and nearest smaller values by parts; there is no stack over the array.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.ranking import running_total
from ..plans.storage import materialise
from . import irreducible, ranges


def _of_ranks(prefixes: DataFrame, part: int) -> DataFrame:
    """(rnk, first, last, depth): the node that each rank's common prefix with the one before it belongs to."""
    values = prefixes.select(F.col("rnk").alias("i"), F.col("lcp").alias("value"))
    n = values.count()
    ends = ranges.nearest_smaller(values, part).join(values, "i")
    last = F.when(F.col("nsv") < 0, F.lit(n - 1)).otherwise(F.col("nsv") - 1).cast("long")
    return ends.select(F.col("i").alias("rnk"), F.greatest("psv", F.lit(0).cast("long")).alias("first"), last.alias("last"), F.col("value").alias("depth"))


def nodes(prefixes: DataFrame, part: int = ranges.PART) -> DataFrame:
    """(first, last, depth) of every node from (rnk, lcp). No row if there is no suffix."""
    return _of_ranks(prefixes, part).select("first", "last", "depth").distinct()


def tree(prefixes: DataFrame, part: int = ranges.PART) -> DataFrame:
    """(first, last, depth, parent_first, parent_last, parent_depth) of every node; the root's parent is null.

    A node's parent is that of the deeper one of the common prefixes at its two bounds.
    """
    own = materialise(_of_ranks(prefixes, part), "rank-nodes")
    parent = F.struct("depth", "first", "last")
    found = own.select("first", "last", "depth").distinct().withColumn("_after", F.col("last") + 1)
    found = found.join(own.select(F.col("rnk").alias("first"), parent.alias("_left")), "first")
    found = found.join(own.select(F.col("rnk").alias("_after"), parent.alias("_right")), "_after", "left")
    up = F.when(F.coalesce(F.col("_right.depth"), F.lit(0)) > F.col("_left.depth"), F.col("_right")).otherwise(F.col("_left"))
    up = F.when(F.col("depth") > 0, up)
    return found.withColumn("_up", up).select("first", "last", "depth", *[F.col(f"_up.{c}").alias(f"parent_{c}") for c in ("first", "last", "depth")])


def suffix_links(array: DataFrame, prefixes: DataFrame, part: int = ranges.PART) -> DataFrame:
    """(first, last, depth, link_first, link_last) of every node but the root: the node of its text without the first symbol, one less deep."""
    given = materialise(nodes(prefixes, part).filter("depth > 0"), "nodes")
    asked = given.select(F.struct("first", "last", "depth").alias("q"), "first", "last", (F.col("depth") - 1).alias("depth"))
    found = ranges.contract_left(asked, array, prefixes, part)
    return found.select("q.first", "q.last", "q.depth", F.col("first").alias("link_first"), F.col("last").alias("link_last"))


def maximal_repeats(docs: DataFrame, array: DataFrame, prefixes: DataFrame, least: int = 1, part: int = ranges.PART) -> DataFrame:
    """(first, last, len, doc, idx): substrings of at least ``least`` symbols that occur twice or more and that no symbol on either side extends at all occurrences.

    ``first`` and ``last`` are the ranks of their occurrences, (doc, idx) the place of the
    first. Beginnings and ends of documents are like no symbol. A node's text is one of
    these if a rank behind its first is irreducible, that is, if its suffixes follow
    different symbols; these ranks are counted once, by a running total.
    """
    flags = irreducible.neighbours(docs, array).select("rnk", F.col("irreducible").cast("long").alias("n"))
    counted = materialise(running_total(flags, ["rnk"], "n", "before").select("rnk", (F.col("before") + F.col("n")).alias("upto")), "irreducible-counts")
    found = nodes(prefixes, part).filter((F.col("depth") > 0) & (F.col("depth") >= least))
    for side in ("first", "last"):
        found = found.join(counted.select(F.col("rnk").alias(side), F.col("upto").alias(f"_{side}")), side)
    kept = found.filter("_last > _first").select("first", "last", F.col("depth").alias("len"))
    return kept.join(array.select(F.col("rnk").alias("first"), "doc", "idx"), "first").select("first", "last", "len", "doc", "idx")
