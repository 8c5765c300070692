"""Symbols of documents: positions, counts, runs, types, bounds. All DataFrame functions."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def symbols(docs: DataFrame) -> DataFrame:
    """(doc, idx, symbol): one row a symbol."""
    return docs.filter(F.length("text") > 0).select("doc", F.posexplode(F.split("text", "")).alias("idx", "symbol")).select("doc", F.col("idx").cast("long").alias("idx"), "symbol")


def suffixes(docs: DataFrame, include_terminator: bool = False) -> DataFrame:
    """(doc, idx): all suffixes, with ``include_terminator`` the empty one of each document too."""
    last = (F.length("text") - (0 if include_terminator else 1)).cast("long")
    given = docs if include_terminator else docs.filter(F.length("text") > 0)
    return given.select("doc", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("idx"))


def suffix_at(docs: DataFrame, places: DataFrame) -> DataFrame:
    """(doc, idx, suffix) for each (doc, idx) asked for."""
    return places.join(docs, "doc").select("doc", "idx", F.substring("text", F.col("idx").cast("int") + 1, F.length("text")).alias("suffix"))


def _pieces(step: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for at in range(0, len(text), 4096 * step):
                    cut = [text[i : i + step + width] for i in range(at, min(len(text), at + 4096 * step), step)]
                    yield pa.RecordBatch.from_arrays([pa.array([doc] * len(cut), pa.int64()), pa.array(range(at // step, at // step + len(cut)), pa.int64()), pa.array(cut, pa.string())], names=["_doc", "_block", "_piece"])

    return run


def snippets(places: DataFrame, docs: DataFrame, doc: str, at: Column, width: int, into: str) -> DataFrame:
    """``places`` with ``into``: up to ``width`` symbols from place ``at`` of the document in column ``doc``; empty behind its end and for nulls.

    Texts are cut into pieces that overlap by ``width`` and joined by their number, so
    that no row ever carries a whole text.
    """
    step = max(width, 64)
    pieces = docs.select("doc", "text").mapInArrow(_pieces(step, width), "_doc long, _block long, _piece string")
    block = F.floor(at / F.lit(step)).cast("long")
    found = places.withColumn("_at", at).withColumn("_of", block).join(pieces, (F.col(doc) == F.col("_doc")) & (F.col("_of") == F.col("_block")), "left")
    cut = F.substring("_piece", (F.col("_at") - F.col("_of") * step + 1).cast("int"), F.lit(width))
    return found.withColumn(into, F.coalesce(cut, F.lit(""))).drop("_at", "_of", "_doc", "_block", "_piece")


def histogram(docs: DataFrame) -> DataFrame:
    """(symbol, n); counted before it is shuffled."""
    return docs.select(F.explode(F.split("text", "")).alias("symbol")).filter("symbol <> ''").groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))


def bigrams(docs: DataFrame) -> DataFrame:
    """(symbol, next, n): neighbouring symbols within a document."""
    chars = F.filter(F.split("text", ""), lambda x: x != "")
    pairs = F.zip_with(chars, F.slice(chars, 2, F.greatest(F.length("text"), F.lit(1))), lambda a, b: F.struct(a.alias("symbol"), b.alias("next")))
    return docs.select(F.explode(pairs).alias("p")).filter("p.next is not null").groupBy("p.symbol", "p.next").agg(F.count(F.lit(1)).alias("n"))


def _runs(docs: DataFrame) -> DataFrame:
    """(doc, symbol, start, length, before, after): maximal runs of one symbol and the symbols beside them; all inside the document's row."""
    found = F.expr(r"regexp_extract_all(text, '(?s)(.)\\1*+', 0)")
    return docs.select("doc", found.alias("r")).mapInArrow(_placed_runs, "doc long, symbol string, start long, length long, before string, after string")


def _placed_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import numpy as np

    for batch in batches:
        for doc, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            length, symbol = np.array([len(x) for x in found], np.int64), [x[0] for x in found]
            ends = np.cumsum(length)
            sides = [pa.array([None, *symbol[:-1]], pa.string()), pa.array([*symbol[1:], None], pa.string())] if found else [pa.array([], pa.string())] * 2
            out = pa.RecordBatch.from_arrays([pa.array([doc] * len(found), pa.int64()), pa.array(symbol, pa.string()), pa.array(ends - length), pa.array(length), *sides], names=["doc", "symbol", "start", "length", "before", "after"])
            for at in range(0, len(found), 100_000):
                yield out.slice(at, 100_000)


def runs(docs: DataFrame) -> DataFrame:
    """(doc, symbol, start, length): maximal runs of one symbol, found inside the document's row."""
    return _runs(docs).select("doc", "symbol", "start", "length")


def max_runs(docs: DataFrame) -> DataFrame:
    """(symbol, max_run): the longest run of each symbol in any document."""
    found = docs.select(F.explode(F.expr(r"regexp_extract_all(text, '(?s)(.)\\1*+', 0)")).alias("run"))
    return found.groupBy(F.left("run", F.lit(1)).alias("symbol")).agg(F.max(F.length("run")).cast("long").alias("max_run"))


def bucket_bounds(docs: DataFrame) -> DataFrame:
    """(symbol, start, end): the ranks that suffixes beginning with each symbol take. Ordered in one task: a row a symbol."""
    counts = histogram(docs)
    end = F.sum("n").over(Window.orderBy("symbol"))
    return counts.select("symbol", (end - F.col("n")).alias("start"), end.alias("end"))


def suffix_types(docs: DataFrame) -> DataFrame:
    """(doc, idx, type, is_lms). L: the suffix is larger than the next; S: smaller. LMS: S after L, not the first.

    A suffix's type is decided by the first different symbol after its own, which is
    the one at the end of its run: runs are found in the row and only they are windowed.
    """
    after, before = F.col("after"), F.col("before")
    typed = _runs(docs).select("doc", "start", "length", F.when(after > F.col("symbol"), "S").otherwise("L").alias("type"), (before > F.col("symbol")).alias("falls"))
    listed = typed.select("doc", "type", "falls", "start", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1)).alias("k"))
    lms = (F.col("type") == "S") & (F.col("k") == 0) & F.coalesce("falls", F.lit(False))
    return listed.select("doc", (F.col("start") + F.col("k")).alias("idx"), "type", lms.alias("is_lms"))


def lms_suffixes(docs: DataFrame) -> DataFrame:
    """(doc, idx) of the leftmost S suffixes."""
    return suffix_types(docs).filter("is_lms").select("doc", "idx")


def lms_per_symbol(docs: DataFrame) -> DataFrame:
    """(symbol, n): leftmost S suffixes by first symbol, and their total with a null symbol."""
    s = _runs(docs).filter("after > symbol AND before > symbol")
    return s.rollup("symbol").agg(F.count(F.lit(1)).alias("n"))


def _lms_cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, idx, lms_substring), cut where the document is read."""
    for batch in batches:
        for doc, text, runs in zip(*(batch.column(k).to_pylist() for k in range(3))):
            at, starts = 0, []
            for k, run in enumerate(runs):
                if 0 < k < len(runs) - 1 and runs[k - 1][0] > run[0] < runs[k + 1][0]:
                    starts.append(at)
                at += len(run)
            for a in range(0, len(starts), 50_000):
                own, ends = starts[a : a + 50_000], [*starts[a + 1 : a + 50_001], len(text)]
                cut = [text[b : e + 1] for b, e in zip(own, ends)]
                yield pa.RecordBatch.from_arrays([pa.array([doc] * len(own), pa.int64()), pa.array(own, pa.int64()), pa.array(cut, pa.string())], names=["doc", "idx", "lms_substring"])


def lms_substrings(docs: DataFrame) -> DataFrame:
    """(doc, idx, lms_substring): from each leftmost S suffix's start to the next one's first symbol, or to the end. Runs are found and cut in the document's row."""
    found = F.expr(r"regexp_extract_all(text, '(?s)(.)\\1*+', 0)")
    return docs.select("doc", "text", found.alias("r")).mapInArrow(_lms_cut, "doc long, idx long, lms_substring string")


def lms_names(docs: DataFrame) -> DataFrame:
    """(doc, idx, name, is_unique): the substring's place among the distinct ones, 0-based, and whether no other has it.

    Only distinct substrings are ordered, by range partitions.
    """
    from ..plans.ranking import global_rank
    from ..plans.storage import materialise

    cut = materialise(lms_substrings(docs), "lms")
    counted = cut.groupBy("lms_substring").agg(F.count(F.lit(1)).alias("n"))
    named = global_rank(counted, ["lms_substring"], row="name")
    return cut.join(named, "lms_substring").select("doc", "idx", "name", (F.col("n") == 1).alias("is_unique"))


def lengths(docs: DataFrame) -> DataFrame:
    """(n_docs, n_symbols, max_length) of the collection."""
    n = F.length("text").cast("long")
    return docs.agg(F.count(F.lit(1)).alias("n_docs"), F.coalesce(F.sum(n), F.lit(0)).alias("n_symbols"), F.coalesce(F.max(n), F.lit(0)).alias("max_length"))


def augmentation(reference: DataFrame, docs: DataFrame) -> DataFrame:
    """(symbol, run): symbols of the collection that the reference lacks, each as often as its longest run."""
    return max_runs(docs).join(histogram(reference), "symbol", "left_anti").select("symbol", F.repeat("symbol", F.col("max_run").cast("int")).alias("run"))


def augment(reference: DataFrame, docs: DataFrame) -> DataFrame:
    """The reference with the missing symbols' runs behind it, in symbol order; one row."""
    tail = augmentation(reference, docs).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("symbol", "run"))), lambda x: x["run"]), "").alias("tail"))
    return reference.crossJoin(F.broadcast(tail)).select("doc", F.concat("text", F.coalesce("tail", F.lit(""))).alias("text"))


def shift_key(position: Column, bits: int) -> Column:
    """The bucket of a position: its value without its lowest bits."""
    return F.shiftright(position, bits)
