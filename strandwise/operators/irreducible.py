"""Common prefixes of neighbouring suffixes in linear exchanges, from irreducible places only.

A suffix and the one before it in order often follow the same symbol. Then the two
suffixes one symbol earlier are neighbours as well, and share one symbol more: the
place is reducible, and its common prefix is that of the place before it, less one.
Only the other places compare texts. Their common prefixes sum to at most n log n
symbols, however long and many the repeats are, and the rest are carried along the
text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import common_prefix
from ..plans.ranking import last_marked
from ..plans.storage import materialise
from . import symbols as sym

#: Ranks that one group of the neighbours' window holds.
RANKS = 1 << 14
#: Symbols compared at first; pairs that agree in all of them compare as many times more, up to a bound.
FIRST, TIMES, LONGEST = 32, 4, 1 << 20


def neighbours(docs: DataFrame, array: DataFrame) -> DataFrame:
    """(rnk, idx, doc, prev_doc, prev_idx, irreducible) of a suffix array (rnk, idx, doc) without terminators.

    Ranks meet in blocks: the last row of each is given to the next one too. A suffix at
    the beginning of its document follows nothing and is irreducible.
    """
    rows = sym.snippets(array, docs, "doc", F.col("idx") - 1, 1, "before")
    block = F.floor(F.col("rnk") / RANKS).cast("long")
    blocks = F.when((F.col("rnk") + 1) % RANKS == 0, F.array(block, block + 1)).otherwise(F.array(block))
    order = Window.partitionBy("_block").orderBy("rnk")
    last = {f"prev_{c}": F.lag(c).over(order) for c in ("doc", "idx", "before")}
    met = rows.withColumn("_block", F.explode(blocks)).withColumns(last).filter(F.col("_block") == block)
    irreducible = F.col("prev_doc").isNull() | (F.col("before") == "") | (F.col("before") != F.col("prev_before"))
    return met.select(*array.columns, "prev_doc", "prev_idx", irreducible.alias("irreducible"))


def compare(docs: DataFrame, pairs: DataFrame, known: int = 0) -> DataFrame:
    """``pairs``, (doc, idx, prev_doc, prev_idx) and others, with ``lcp``: symbols that the two suffixes share, ``known`` at least.

    They are read in pieces that grow, and only pairs still equal go on. A place stands
    in at most one pair on either side, so no piece is asked for by more pairs than it
    has symbols.
    """
    names, open_, done, width = pairs.columns, pairs.withColumn("lcp", F.lit(known).cast("long")), [], FIRST
    while True:
        both = sym.snippets(open_, docs, "doc", F.col("idx") + F.col("lcp"), width, "_a")
        both = sym.snippets(both, docs, "prev_doc", F.col("prev_idx") + F.col("lcp"), width, "_b")
        shared = both.withColumn("_same", common_prefix(F.col("_a"), F.col("_b"), width.bit_length()))
        compared = materialise(shared.select(*names, (F.col("lcp") + F.col("_same")).alias("lcp"), (F.col("_same") == width).alias("_more")), "compared")
        done.append(compared.filter("NOT _more").drop("_more"))
        open_ = compared.filter("_more").drop("_more")
        if not open_.limit(1).count():
            return reduce(DataFrame.unionByName, done)
        width = min(TIMES * width, LONGEST)


def irreducible_prefixes(docs: DataFrame, array: DataFrame) -> DataFrame:
    """(doc, idx, plcp) of the irreducible places; every other's follows from the one before it."""
    pairs = materialise(neighbours(docs, array.select("rnk", "idx", "doc")).filter("irreducible"), "irreducible")
    first = pairs.filter("prev_doc IS NULL").select("doc", "idx", F.lit(0).cast("long").alias("plcp"))
    return compare(docs, pairs.filter("prev_doc IS NOT NULL")).select("doc", "idx", F.col("lcp").alias("plcp")).unionByName(first)


def prefixes(docs: DataFrame, array: DataFrame) -> DataFrame:
    """(rnk, idx, doc, lcp) of a suffix array (rnk, idx, doc) without terminators: what each suffix shares with the one before it; the first has 0.

    The last irreducible place at or before each suffix is carried within ranges of
    documents and places, so that a document of any length lies in any number of tasks.
    """
    rows = materialise(neighbours(docs, array.select("rnk", "idx", "doc")), "neighbours")
    open_ = compare(docs, rows.filter("irreducible AND prev_doc IS NOT NULL").drop("irreducible"))
    known = open_.select("rnk", "idx", "doc", F.col("idx").alias("_start"), F.col("lcp").alias("_lcp"), F.lit(True).alias("_mark"))
    first = rows.filter("prev_doc IS NULL").select("rnk", "idx", "doc", F.col("idx").alias("_start"), F.lit(0).cast("long").alias("_lcp"), F.lit(True).alias("_mark"))
    return _carried(known.unionByName(first), rows.filter("NOT irreducible"))


def _carried(known: DataFrame, reducible: DataFrame) -> DataFrame:
    none = F.lit(None).cast("long")
    rest = reducible.select("rnk", "idx", "doc", none.alias("_start"), none.alias("_lcp"), F.lit(False).alias("_mark"))
    carried = last_marked(known.unionByName(rest), "doc", ["idx"], "_mark", ["_start", "_lcp"])
    return carried.select("rnk", "idx", "doc", (F.col("_lcp") - F.col("idx") + F.col("_start")).alias("lcp"))


def beyond(docs: DataFrame, tied: DataFrame, known: int) -> DataFrame:
    """(rnk, idx, doc, lcp) of suffixes that share ``known`` symbols or more with the one before them: of ``tied`` (rnk, idx, doc, shared), all but those of which rnk is ``shared``, the first rank of those with the same symbols.

    A reducible place shares one symbol less than the place before it, so that one
    shares enough as well and is among them.
    """
    rows = materialise(neighbours(docs, tied).filter("rnk <> shared").drop("shared"), "neighbours")
    open_ = compare(docs, rows.filter("irreducible").drop("irreducible"), known)
    marked = open_.select("rnk", "idx", "doc", F.col("idx").alias("_start"), F.col("lcp").alias("_lcp"), F.lit(True).alias("_mark"))
    return _carried(marked, rows.filter("NOT irreducible"))
