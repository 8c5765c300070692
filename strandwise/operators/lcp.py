"""Longest common prefixes and what follows from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .suffix_array import gsa, gsa_lcp


def phi(docs: DataFrame, array: DataFrame | None = None) -> DataFrame:
    """(doc, idx, prev_doc, prev_idx): each suffix's predecessor in order; the first has none. A join on neighbouring ranks."""
    array = gsa(docs) if array is None else array
    before = array.select((F.col("rnk") + 1).alias("rnk"), F.col("doc").alias("prev_doc"), F.col("idx").alias("prev_idx"))
    return array.join(before, "rnk", "left").select("doc", "idx", "prev_doc", "prev_idx")


def lcp_array(docs: DataFrame) -> DataFrame:
    """(rnk, lcp), in rank order."""
    return gsa_lcp(docs).select("rnk", "lcp")


def plcp_array(docs: DataFrame) -> DataFrame:
    """(doc, idx, plcp), in text order."""
    return gsa_lcp(docs).select("doc", "idx", F.col("lcp").alias("plcp"))


def unique_prefix(docs: DataFrame) -> DataFrame:
    """(doc, idx, len): the longest prefix that a suffix shares with any other, the larger of its two neighbours'."""
    array = gsa_lcp(docs)
    after = array.select((F.col("rnk") - 1).alias("rnk"), F.col("lcp").alias("after"))
    return array.join(after, "rnk", "left").select("doc", "idx", F.greatest("lcp", F.coalesce("after", F.lit(0).cast("long"))).alias("len"))


def longest_repeat(docs: DataFrame) -> DataFrame:
    """(len, substring): the longest substring that occurs twice, the first in order; no row if no symbol repeats."""
    best = gsa_lcp(docs).filter("lcp > 0").orderBy(F.desc("lcp"), "rnk").limit(1)
    return best.join(docs, "doc").select(F.col("lcp").alias("len"), F.substring("text", (F.col("idx") + 1).cast("int"), F.col("lcp").cast("int")).alias("substring"))


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """(doc, dup_of): documents whose text another has, with the smallest of these; found by a digest and checked on the text's length."""
    keyed = docs.filter(F.length("text") > 0).select("doc", F.sha2("text", 256).alias("digest"), F.length("text").alias("n"))
    first = keyed.groupBy("digest", "n").agg(F.min("doc").alias("dup_of"), F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    return keyed.join(first, ["digest", "n"]).filter("doc <> dup_of").select("doc", "dup_of")
