"""Suffix arrays: of a collection, of each document, of integer sequences.

Three physical plans. A small collection, whose bytes fit a checked bound, is sent to
every task once, and each task sorts one range of keys without any exchange. Any other
is sorted by difference covers on tables, in a few linear exchanges. Prefix doubling on
tables is there too: ranks by the first symbols come from range partitions, and only
suffixes that are still tied look up the rank of what follows. Single documents are
sorted inside the task that reads them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import collection_sort, kernels
from ..plans.ranking import global_rank, running_total
from ..plans.storage import materialise, spread
from .cover import suffix_prefixes, suffix_ranks
from .irreducible import prefixes

#: Bytes of a collection up to which every task gets all of it, and of the longest document.
COLLECTION_BYTES, DOCUMENT_BYTES = 4 << 20, 256 << 10
FIRST_SYMBOLS = 16
_BATCH = 200_000


def _collected(docs: DataFrame) -> collection_sort.Collection | None:
    """The collection if its size, which is checked first, is within the bound."""
    size = F.octet_length("text").cast("long")
    row = docs.agg(F.sum(size).alias("n"), F.max(size).alias("longest"), F.count(F.lit(1)).alias("docs")).first()
    if (row["n"] or 0) > COLLECTION_BYTES or (row["longest"] or 0) > DOCUMENT_BYTES or row["docs"] * collection_sort.PAD > COLLECTION_BYTES:
        return None
    rows = docs.select("doc", F.col("text").cast("binary").alias("text")).toArrow()
    return collection_sort.Collection(rows["doc"].to_numpy(), [bytes(x) for x in rows["text"].to_pylist()])


def _ranges(c: collection_sort.Collection, tasks: int) -> list[tuple[int, int | None]]:
    n = len(c.data)
    cuts = collection_sort.splitters(c, max(1, min(2 * tasks, n // 20_000))).tolist()
    del c.bytes
    return list(zip([0, *cuts], [*cuts, None]))


def _by_ranges(docs: DataFrame, c: collection_sort.Collection, terminators: bool) -> DataFrame:
    spark = docs.sparkSession
    ranges = _ranges(c, spark.sparkContext.defaultParallelism)
    sent = spark.sparkContext.broadcast(c)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column(0).to_pylist():
                sent.value.open()
                for columns in collection_sort.sort_range(sent.value, *ranges[k], terminators):
                    for at in range(0, len(columns[0]), _BATCH):
                        yield pa.RecordBatch.from_arrays([pa.array(x[at : at + _BATCH], pa.int64()) for x in columns], names=["rnk", "doc", "idx", "lcp"])

    return spark.range(0, len(ranges), 1, len(ranges)).mapInArrow(run, "rnk long, doc long, idx long, lcp long")


def _prefixes(symbols: int, terminators: bool):
    """(doc, idx, key, whole): the first symbols of every suffix as bytes, and whether there are as many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                data = text.encode("utf-8", "surrogatepass")
                begins = np.flatnonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)
                ends = np.concatenate((begins, np.full(symbols, len(data))))[symbols:]
                for at in range(0, len(begins) + terminators, 50_000):
                    keys = [data[a:b] for a, b in zip(begins[at : at + 50_000].tolist(), ends[at : at + 50_000].tolist())]
                    if terminators and at + 50_000 > len(begins):
                        keys.append(b"")
                    idx = np.arange(at, at + len(keys))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), doc)), pa.array(idx), pa.array(keys, pa.binary()), pa.array(idx + symbols <= len(begins))], names=["doc", "idx", "key", "whole"])

    return run


def _double(ranked: DataFrame, h: int) -> list[tuple[int, DataFrame]]:
    """Refines (doc, idx, rank, tied) by doubling until only equal suffixes share a rank. Returns the tables of all widths.

    Tied suffixes are ordered by ranges of (rank, rank of what follows), so those that
    share a long prefix are spread over tasks; what is settled is not written again.
    """
    settled = [ranked.filter("NOT tied")]
    open_, history = ranked.filter("tied"), [(h, ranked)]
    while open_.limit(1).count():
        after = history[-1][1].select(F.col("doc").alias("_doc"), (F.col("idx") - h).alias("_idx"), (F.col("rank") + 1).alias("second"))
        # a suffix that ends inside its width has no second half and is smaller
        pairs = open_.join(after, (F.col("doc") == F.col("_doc")) & (F.col("idx") == F.col("_idx")), "left").select("doc", "idx", "rank", F.coalesce("second", F.lit(0).cast("long")).alias("second"))
        placed = materialise(global_rank(pairs, ["rank", "second"], rank="place"), "doubling")
        groups = placed.groupBy("rank", "second").agg(F.min("place").alias("place"), F.count(F.lit(1)).alias("same"))
        base = groups.groupBy("rank").agg(F.min("place").alias("base"))
        moved = placed.select("doc", "idx", "rank", "second").join(groups.join(base, "rank"), ["rank", "second"])
        # suffixes that are tied and have both ended are equal, and stay so
        moved = materialise(moved.select("doc", "idx", (F.col("rank") + F.col("place") - F.col("base")).alias("rank"), ((F.col("same") > 1) & (F.col("second") > 0)).alias("tied")), "doubled")
        open_ = moved.filter("tied")
        h *= 2
        history.append((h, _together([*settled, moved])))
        settled.append(moved.filter("NOT tied"))
    return history


def _together(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _order_ties(ranked: DataFrame) -> DataFrame:
    """(rnk, idx, doc): equal suffixes by document."""
    place = F.row_number().over(Window.partitionBy("rank").orderBy("doc", "idx")) - 1
    return ranked.select((F.col("rank") + place).cast("long").alias("rnk"), "idx", "doc")


def _by_doubling(docs: DataFrame, terminators: bool) -> DataFrame:
    rows = spread(docs.select("doc", "text")).mapInArrow(_prefixes(FIRST_SYMBOLS, terminators), "doc long, idx long, key binary, whole boolean")
    first = global_rank(rows, ["key"], rank="rank")
    # suffixes that have ended and share a key are equal
    many = (F.count(F.lit(1)).over(Window.partitionBy("rank")) > 1) & F.col("whole")
    ranked = materialise(first.select("doc", "idx", "rank", many.alias("tied")), "first-ranks")
    return _order_ties(_double(ranked, FIRST_SYMBOLS)[-1][1])


def gsa(docs: DataFrame, include_terminator: bool = False, plan: str = "auto") -> DataFrame:
    """(rnk, idx, doc): all suffixes of all documents in lexicographic order, equal ones by document.

    ``plan``: "ranges" (collection in every task), "cover" or "doubling" (tables), or
    "auto": ranges for what fits the bound, and cover beyond.
    """
    c = _collected(docs) if plan in ("auto", "ranges") else None
    if c is None and plan == "ranges":
        raise ValueError("the collection is larger than tasks may hold")
    if c is not None:
        return _by_ranges(docs, c, include_terminator).select("rnk", "idx", "doc")
    if plan == "doubling":
        return _by_doubling(docs, include_terminator)
    return suffix_ranks(docs, include_terminator).select(F.col("rank").alias("rnk"), "idx", "doc")


def gsa_lcp(docs: DataFrame, plan: str = "auto") -> DataFrame:
    """(rnk, idx, doc, lcp): the suffix array with each suffix's common prefix with the one before it; the first has 0.

    Plans are those of ``gsa``. On tables prefixes within the first symbols come from the sort, and beyond only irreducible places compare texts.
    """
    c = _collected(docs) if plan in ("auto", "ranges") else None
    if c is None and plan == "ranges":
        raise ValueError("the collection is larger than tasks may hold")
    if c is not None:
        return _by_ranges(docs, c, False).select("rnk", "idx", "doc", "lcp")
    if plan == "doubling":
        return prefixes(docs, materialise(gsa(docs, plan="doubling"), "gsa"))
    return suffix_prefixes(docs)


def isa(array: DataFrame) -> DataFrame:
    """(doc, idx, rnk): the suffix array read by place. The relation is its own inverse."""
    return array.select("doc", "idx", "rnk")


def gather(values: DataFrame, places: DataFrame, key: list[str]) -> DataFrame:
    """Rows of ``places`` with what ``values`` holds for their key."""
    return places.join(values, key)


def _each(kernel, names: list[str]):
    """A kernel over each document's symbols; it returns one array a column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                columns = kernel(kernels.code_points(text))
                for at in range(0, len(columns[0]), _BATCH):
                    part = [x[at : at + _BATCH] for x in columns]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part[0]), doc)), *[pa.array(x) for x in part]], names=["doc", *names])

    return run


def per_document(docs: DataFrame) -> DataFrame:
    """(doc, rnk, pos): the suffix array of each document by itself; nothing is shuffled."""

    def kernel(symbols):
        order = kernels.suffix_array(symbols)
        return np.arange(len(order)), order

    return spread(docs.select("doc", "text")).mapInArrow(_each(kernel, ["rnk", "pos"]), "doc long, rnk long, pos long")


def _integer_history(values: DataFrame) -> list[tuple[int, DataFrame]]:
    """Ranks (doc, idx, rank, tied) of all suffixes of (seq, pos, value) by their first 1, 2, 4, ... symbols; a suffix that ends is smaller."""
    counts = values.groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    starts = running_total(counts, ["value"], "n", "rank")
    first = values.select(F.col("seq").alias("doc"), F.col("pos").alias("idx"), "value").join(starts, "value")
    return _double(materialise(first.select("doc", "idx", "rank", (F.col("n") > 1).alias("tied")), "int-ranks"), 1)


def integer_gsa(values: DataFrame) -> DataFrame:
    """(rnk, seq, pos) from (seq, pos, value): all suffixes of all integer sequences in order, equal ones by sequence. Symbols of any width are the same case."""
    return _order_ties(_integer_history(values)[-1][1]).select("rnk", F.col("doc").alias("seq"), F.col("idx").alias("pos"))


def integer_suffix_array(values: DataFrame) -> DataFrame:
    """(seq, rnk, pos) from (seq, pos, value): suffix arrays of integer sequences of any length, by doubling on tables.

    Each sequence's suffixes are numbered by their place in the order of all; no
    sequence is sorted in one task.
    """
    order = global_rank(materialise(integer_gsa(values), "int-gsa"), ["seq", "rnk"], row="place")
    before = running_total(values.groupBy("seq").agg(F.count(F.lit(1)).alias("n")), ["seq"], "n", "before").select("seq", "before")
    return order.join(before, "seq").select("seq", (F.col("place") - F.col("before")).alias("rnk"), "pos")


def unique_suffixes(docs: DataFrame) -> DataFrame:
    """(n_unique): suffixes of the collection that no other equals: those that are longer than what they share with both neighbours in order."""
    array = gsa_lcp(docs)
    after = array.select((F.col("rnk") - 1).alias("rnk"), F.col("lcp").alias("after"))
    sizes = docs.select(F.col("doc").alias("_doc"), F.length("text").alias("n"))
    rest = array.join(after, "rnk", "left").join(sizes, F.col("doc") == F.col("_doc")).select("lcp", F.coalesce("after", F.lit(0).cast("long")).alias("after"), (F.col("n") - F.col("idx")).alias("rest"), "rnk")
    # the first has none before it; a suffix that is a prefix of the next one differs from it if that is longer
    equal_before = (F.col("rnk") > 0) & (F.col("lcp") == F.col("rest"))
    longer = array.join(sizes, F.col("doc") == F.col("_doc")).select((F.col("rnk") - 1).alias("_r"), (F.col("n") - F.col("idx")).alias("rest_after"))
    rows = rest.join(longer, F.col("rnk") == F.col("_r"), "left")
    equal_after = (F.col("after") == F.col("rest")) & F.coalesce(F.col("rest_after") == F.col("rest"), F.lit(False))
    return rows.agg(F.count_if(~equal_after & ~equal_before).alias("n_unique"))
