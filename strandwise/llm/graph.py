"""Connected components of a table of links, by alternating stars; tables only, nothing on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import join_counted, remove, save, save_only


def _with_minima(links: DataFrame, total: int) -> DataFrame:
    """``links`` (u, v) with m, the least v of their u; a hub's links stay where they are. The minima are read several times, so they are written first."""
    least = save(links.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")), "minima")
    return join_counted(links, least, "u", total)


def _pairs(*pairs: tuple) -> Column:
    """Rows (u, v) in the place of one, so that what gives it is planned once."""
    return F.inline(F.array(*[F.struct(F.col(u).alias("u"), F.col(v).alias("v")) for u, v in pairs]))


def _large_star(links: DataFrame, total: int) -> DataFrame:
    """Every node's larger neighbours are hung on the smallest of its neighbours and itself."""
    both = links.select(_pairs(("u", "v"), ("v", "u")))
    return _with_minima(both, 2 * total).filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.least("u", "m").alias("v"))


def _small_star(links: DataFrame, total: int) -> DataFrame:
    """Every node and its smaller neighbours are hung on the smallest of them."""
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    return _with_minima(down, total).select(_pairs(("v", "m"), ("u", "m")))


def connected_components(links: DataFrame) -> DataFrame:
    """``links`` (u, v): pairs of numbers. Returns (node, root), root the smallest number reachable, for every node named.

    Ends when a round changes nothing; rounds grow with the logarithm of the longest
    path. Null ends and links of a node to itself are ignored; an empty table gives none.
    """
    links = save(links.filter("u <> v").distinct(), "links")
    before, total = None, links.count()
    while True:
        # each star's table is written whole before the next reads it, or plans would hold all before them many times; a round has no more links than the one before it and their nodes
        new = save_only(links.sparkSession, "links", lambda: _small_star(save(_large_star(links, total), "large-star"), total).filter("u <> v").distinct())  # noqa: B023
        state = new.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        old = links.inputFiles()[:1]
        if old:
            remove(links.sparkSession, old[0].rsplit("/", 1)[0])
        links, total = new, state[0]
        if state == before or not state[0]:
            break
        before = state
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).union(links.select(F.col("v"), F.col("v"))).distinct()
