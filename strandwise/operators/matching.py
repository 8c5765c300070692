"""Matching statistics of a collection against a reference text, and pattern search."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import anchors, backward, held, routed
from . import symbols as sym
from .anchors import locate


def matching_statistics(reference: DataFrame, docs: DataFrame, augment: bool = False, heads_only: bool = False, plan: str = "auto") -> DataFrame:
    """(doc, idx, pos, len, smaller, next) of every place of ``docs``.

    pos and len: the longest match in the reference; smaller: whether the suffix sorts
    before the one matched; next: the symbol after the match, null at the end. Of two
    equally long matches the one that sorts after is taken. The reference is any number
    of texts (doc, text), one behind another in the order of doc. With ``augment`` it is
    first given the symbols that it lacks. With ``heads_only`` the result is that of
    ``heads``.
    """
    if augment:
        last = reference.agg(F.max("doc")).first()[0]
        runs = sym.augmentation(reference, docs).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("symbol", "run"))), lambda x: x["run"]), "").alias("text"))
        reference = reference.select("doc", "text").unionByName(runs.select(F.lit((last or 0) + 1).cast("long").alias("doc"), "text"))
    known = held.hold(reference, docs) if plan in ("auto", "held") else None
    if known is not None:
        return held.matching_statistics(known, docs, heads_only)
    if plan == "held":
        raise ValueError("the reference is empty, or it or a document is larger than tasks may hold")
    found = routed.matching_statistics(routed.build(reference), docs)
    return heads(found) if heads_only else found


def heads(ms: DataFrame) -> DataFrame:
    """Places where a match does not go on from the one before: pos is not the last pos plus one. Each place meets the one before it by a join."""
    before = ms.select("doc", (F.col("idx") + 1).alias("idx"), (F.col("pos") + 1).alias("_goes_on"))
    joined = ms.join(before, ["doc", "idx"], "left")
    return joined.filter(F.col("_goes_on").isNull() | (F.col("pos") != F.col("_goes_on"))).select(*ms.columns)


def parse_stats(found: DataFrame) -> DataFrame:
    """(doc, n_heads, max_len, sum_len) of heads."""
    return found.groupBy("doc").agg(F.count(F.lit(1)).alias("n_heads"), F.max("len").alias("max_len"), F.sum("len").alias("sum_len"))


def heads_per_position(found: DataFrame) -> DataFrame:
    """(pos, n): heads by the reference place that they match."""
    return found.groupBy("pos").agg(F.count(F.lit(1)).alias("n"))


HEAD_ORDER = ["isa", "side", "closeness", "next"]


def suffix_order_by_matches(ms: DataFrame, inverse: DataFrame) -> DataFrame:
    """(doc, idx, isa, side, closeness, next): the key by which matched suffixes compare up to the symbol after the match.

    isa: rank of the matched reference suffix, by ``inverse`` (doc, idx, rnk) of the
    reference; side: 0 before it; closeness: match length, rising before and falling after.
    """
    ranked = inverse.select(F.col("idx").alias("pos"), F.col("rnk").alias("isa"))
    side, closeness = F.when(F.col("smaller"), 0).otherwise(1), F.when(F.col("smaller"), F.col("len")).otherwise(-F.col("len"))
    return ms.join(ranked, "pos").select("doc", "idx", "isa", side.alias("side"), closeness.alias("closeness"), "next")


def rank_heads(found: DataFrame, inverse: DataFrame) -> DataFrame:
    """(doc, idx, rank): 0-based place among the distinct heads in lexicographic order, which is that of the matched rank, side, closeness and next symbol.

    Distinct heads are ordered by range partitions.
    """
    from ..plans.ranking import global_rank
    from ..plans.storage import materialise

    keyed = materialise(suffix_order_by_matches(found, inverse), "head-keys")
    ranked = global_rank(keyed.select(*HEAD_ORDER).distinct(), HEAD_ORDER, row="rank").withColumnsRenamed({k: f"_{k}" for k in HEAD_ORDER})
    same = (F.col("isa") == F.col("_isa")) & (F.col("side") == F.col("_side")) & (F.col("closeness") == F.col("_closeness")) & F.col("next").eqNullSafe(F.col("_next"))
    return keyed.join(ranked, same).select("doc", "idx", "rank")


def sort_heads(found: DataFrame, inverse: DataFrame) -> DataFrame:
    """(rnk, doc, idx): all heads in the order of ``rank_heads``, equal ones by document and place."""
    from ..plans.ranking import global_rank

    return global_rank(suffix_order_by_matches(found, inverse), [*HEAD_ORDER, "doc", "idx"], row="rnk").select("rnk", "doc", "idx")


def head_names(found: DataFrame, inverse: DataFrame) -> DataFrame:
    """(seq, pos, value, idx): each document as the sequence of its heads' ranks. Heads are numbered within a document by range partitions."""
    from ..plans.ranking import global_rank, running_total

    placed = global_rank(rank_heads(found, inverse), ["doc", "idx"], row="place")
    before = running_total(found.groupBy("doc").agg(F.count(F.lit(1)).alias("n")), ["doc"], "n", "before").select("doc", "before")
    return placed.join(before, "doc").select(F.col("doc").alias("seq"), (F.col("place") - F.col("before")).alias("pos"), F.col("rank").alias("value"), "idx")


def head_suffix_array(found: DataFrame, inverse: DataFrame) -> DataFrame:
    """(rnk, doc, k, idx): the suffixes of all documents' head sequences in order, equal ones by document; k counts a document's heads, idx is the head's place."""
    from ..plans.storage import materialise
    from .suffix_array import integer_gsa

    names = materialise(head_names(found, inverse), "head-names")
    array = integer_gsa(names.select("seq", "pos", "value"))
    return array.join(names.select("seq", "pos", "idx"), ["seq", "pos"]).select("rnk", F.col("seq").alias("doc"), F.col("pos").alias("k"), "idx")


def full_order_keys(ms: DataFrame, inverse: DataFrame) -> DataFrame:
    """(doc, idx, isa, side, closeness, next_isa, next_head_rank): the key of ``suffix_order_by_matches`` and what stands for the remainder.

    next_isa: rank of the reference suffix matched at the place behind the match;
    next_head_rank: place of the head that covers it, in the order of ``head_suffix_array``.
    Both are null where the match reaches the end of its document.
    """
    from ..plans.storage import materialise

    ms = materialise(ms, "matches")
    found = materialise(heads(ms), "heads")
    keys = materialise(suffix_order_by_matches(ms, inverse), "match-keys")
    ends = ms.select("doc", "idx", (F.col("idx") + F.col("len")).alias("q"))
    there = keys.select("doc", F.col("idx").alias("q"), F.col("isa").alias("next_isa"))
    ranked = head_suffix_array(found, inverse).select("doc", "idx", F.col("rnk").alias("next_head_rank"))
    covering = as_of(ms.select("doc", F.col("idx").alias("q")), ranked, ["next_head_rank"])
    out = ends.join(there.join(covering, ["doc", "q"]), ["doc", "q"], "left").select("doc", "idx", "next_isa", "next_head_rank")
    return keys.join(out, ["doc", "idx"]).select("doc", "idx", "isa", "side", "closeness", "next_isa", "next_head_rank")


def order_by_matches(ms: DataFrame, inverse: DataFrame) -> DataFrame:
    """(doc, idx, rank): the lexicographic place of every suffix, equal ones sharing it, from matches alone.

    A suffix is its match and then the remainder behind it, which is a suffix that is
    matched itself. Ranks by the first match are refined by those of the remainders,
    whose width doubles each round; no text is read.
    """
    from ..plans.ranking import global_rank
    from ..plans.storage import materialise

    ms = materialise(ms, "matches")
    keys = global_rank(suffix_order_by_matches(ms, inverse), HEAD_ORDER, rank="rank").select("doc", "idx", "rank")
    # a row a suffix on either side: what files or plans are taken to hold says little of that, and neither may be sent to all
    ranked = keys.join(ms.select("doc", "idx", (F.col("idx") + F.col("len")).alias("q")).hint("merge"), ["doc", "idx"])
    ranked, before = materialise(ranked, "match-ranks"), -1
    while True:
        state = ranked.select("rank").distinct().count()
        if state == before:
            return ranked.select("doc", "idx", "rank")
        before = state
        after = ranked.select(F.col("doc").alias("_doc"), F.col("idx").alias("_idx"), (F.col("rank") + 1).alias("second"), F.col("q").alias("far"))
        # behind a document's end there is nothing, which is smaller than anything
        pairs = ranked.join(after.hint("merge"), (F.col("doc") == F.col("_doc")) & (F.col("q") == F.col("_idx")), "left")
        pairs = pairs.select("doc", "idx", F.col("rank").alias("one"), F.coalesce("second", F.lit(0).cast("long")).alias("second"), F.coalesce("far", F.col("q")).alias("q"))
        ranked = materialise(global_rank(pairs, ["one", "second"], rank="rank").select("doc", "idx", "rank", "q"), "match-ranks")


def as_of(asked: DataFrame, known: DataFrame, carry: list[str]) -> DataFrame:
    """(doc, q, *carry): for each (doc, q) the last row of ``known`` (doc, idx, ...) with idx <= q; nulls if there is none.

    Both sides are sorted together by ranges of document and place, and a range hands on
    its last known row: no task needs a whole document.
    """
    from ..plans.ranking import last_marked

    kinds = {f.name: f.dataType for f in known.schema}
    a = asked.select("doc", F.col("q").alias("at"), F.lit(False).alias("known"), *[F.lit(None).cast(kinds[c]).alias(c) for c in carry])
    b = known.select("doc", F.col("idx").alias("at"), F.lit(True).alias("known"), *[F.col(c) for c in carry])
    # a known row stands before what asks at its place
    both = a.unionByName(b).withColumn("side", F.when(F.col("known"), 0).otherwise(1))
    return last_marked(both, "doc", ["at", "side"], "known", carry).filter("NOT known").select("doc", F.col("at").alias("q"), *carry)


def next_heads(found: DataFrame) -> DataFrame:
    """(doc, idx, next_idx): the head that covers the place where each head's match ends."""
    ends = found.select("doc", (F.col("idx") + F.col("len")).alias("q"), "idx")
    covered = as_of(ends.select("doc", "q").distinct(), found.select("doc", "idx", F.col("idx").alias("next_idx")), ["next_idx"])
    return ends.join(covered, ["doc", "q"]).select("doc", "idx", "next_idx")


def _substrings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for doc, text, n in zip(*(batch.column(i).to_pylist() for i in range(3))):
            for at in range(0, len(text) - n + 1, 50_000):
                to = min(at + 50_000, len(text) - n + 1)
                yield pa.RecordBatch.from_arrays([pa.array([text[i : i + n] for i in range(at, to)], pa.string()), pa.array(np.full(to - at, doc)), pa.array(np.arange(at, to))], names=["pattern", "doc", "idx"])


def count_patterns(docs: DataFrame, patterns: DataFrame) -> DataFrame:
    """(pattern, n): number of occurrences; 0 where there is none."""
    found = anchors.locate(docs, patterns).groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))
    return patterns.select("pattern").distinct().join(found, "pattern", "left").select("pattern", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def refine(docs: DataFrame, prefix: str, depth: int = 1) -> DataFrame:
    """(extension, first, last): rank intervals of the suffixes that begin with ``prefix``, by their next ``depth`` symbols; by backward search."""
    return backward.refine(backward.build(docs), prefix, depth)


def longest_shared(docs: DataFrame, items: DataFrame, least: int) -> DataFrame:
    """(doc, item, len): the longest exact match of each item within each document, from ``least`` symbols on.

    Every place of an item is an anchor of ``least`` symbols, so no match is missed;
    anchors found on one diagonal are merged into runs.
    """
    width = items.select("doc", "text", F.lit(least).alias("n"))
    grams = width.mapInArrow(_substrings, "pattern string, doc long, idx long").select(F.col("doc").alias("item"), F.col("idx").alias("q"), "pattern")
    both = anchors.locate(docs, grams.select("pattern")).join(grams, "pattern").select("doc", "item", (F.col("idx") - F.col("q")).alias("diagonal"), F.col("idx").alias("p"))
    run = F.col("p") - F.row_number().over(Window.partitionBy("doc", "item", "diagonal").orderBy("p"))
    runs = both.withColumn("run", run).groupBy("doc", "item", "diagonal", "run").agg((F.count(F.lit(1)) + least - 1).alias("len"))
    return runs.groupBy("doc", "item").agg(F.max("len").alias("len"))
