"""Ranked lexical search as a blocked sparse matrix product.

Scores of all documents for all items are the product of two sparse integer matrices:
how often an item holds a term, times what a term is worth in a document (its impact).
Documents stay where they are read. A task takes one block of documents at a time as
term rows of impacts, merges the rows of each item's terms (Gustavson's method with a
dense accumulator over the block's documents), and keeps each item's best documents;
Spark reduces the best of all tasks in two steps.

Items go in blocks of a bounded number of item-term pairs; more items take more blocks,
each a pass over the documents.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import read_table, release, save, term_table

#: Results an item, item-term pairs of a block of items (an item with more has its own), and shares in which an item's best are reduced first.
K, BLOCK_PAIRS, SHARES = 20, 200_000, 32
#: Texts that a task holds as Python objects at once.
_SLICE = 128
_LONG = np.iinfo(np.int64).max

TERM_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, term, mult): how often each item holds a term. Null texts hold none; of rows that share an id the smallest text counts."""
    lower = F.translate(F.col("text"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    one = items.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).alias("text")).filter(F.col("text").isNotNull()).groupBy("item_id").agg(F.min("text").alias("text"))
    terms = one.select("item_id", F.explode(F.array_remove(F.split(lower, TERM_GAP), "")).alias("term"))
    return terms.groupBy("item_id", "term").agg(F.count(F.lit(1)).alias("mult"))


class ItemBlock:
    """A block of items as a matrix in rows: ``terms`` numbers the columns, row i has ``columns[starts[i]:starts[i + 1]]`` and ``mult`` there."""

    def __init__(self, pairs: pa.Table):
        ids = pairs["item_id"].to_pylist()
        terms, columns = np.unique(np.array(pairs["term"].to_pylist(), object), return_inverse=True)
        self.terms = [t.encode() for t in terms]
        known = sorted(set(ids), key=lambda x: (x is None, x or 0))
        row = {x: k for k, x in enumerate(known)}
        rows = np.array([row[x] for x in ids], np.int64)
        order = np.lexsort((columns, rows))
        self.items, self.columns, self.mult = known, columns[order], pairs["mult"].to_numpy()[order]
        self.starts = np.searchsorted(rows[order], np.arange(len(known) + 1))


def _postings(sent):
    """(doc_id, n, terms, counts) of every document that has a term: its number of terms, and the block's terms in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, table = {t: k for k, t in enumerate(sent.value.terms)}, term_table(digits=True)
        for batch in batches:
            for at in range(0, batch.num_rows, _SLICE):
                part = batch.slice(at, _SLICE)
                ids, sizes, terms, counts = [], [], [], []
                for doc, text in zip(part.column(0).to_pylist(), part.column(1)):
                    words = text.as_py().translate(table).split()
                    if words:
                        found = [(number[w], n) for w, n in Counter(words).items() if w in number]
                        ids.append(doc)
                        sizes.append(len(words))
                        terms.append([t for t, _ in found])
                        counts.append([n for _, n in found])
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int64()))], names=["doc_id", "n", "terms", "counts"])
        release()

    return run


def weights(df: np.ndarray, n_docs: int) -> np.ndarray:
    """floor(1000 ln((2 N + 2) / (2 df + 1))), in doubles."""
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(d) + 1))) for d in df], np.int64)


def impacts(weight: np.ndarray, counts: np.ndarray, length: np.ndarray, n_docs: int, all_terms: int) -> np.ndarray:
    """What terms of ``weight`` that a document holds ``counts`` times are worth, all in whole numbers; ``length``: the document's terms."""
    fits = 25 * n_docs * int(length.max(initial=0)) <= _LONG
    share = 25 * length * n_docs // all_terms if fits else np.array([25 * int(n) * n_docs // all_terms for n in length], np.int64)
    return weight * (1_000_000_000 * counts // (1000 * counts + 12 * (75 + share)))


def best(scores: np.ndarray, ids: np.ndarray, unknown: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, highest first; equal ones by id, those without an id last."""
    if len(scores) > k:
        at = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], unknown[at], -scores[at]))[:k]]


def product(block: ItemBlock, terms: np.ndarray, docs: np.ndarray, values: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(item, documents, scores) of a block of n documents: rows of the term-document matrix (terms, docs, values) merged for each item."""
    order = np.argsort(terms, kind="stable")
    docs, values = docs[order], values[order]
    rows = np.searchsorted(terms[order], np.arange(len(block.terms) + 1))
    total = np.zeros(n, np.int64)
    for i in range(len(block.items)):
        total[:] = 0
        for at in range(block.starts[i], block.starts[i + 1]):
            t = block.columns[at]
            row = slice(rows[t], rows[t + 1])
            total[docs[row]] += block.mult[at] * values[row]  # a document is once in a row
        hit = np.flatnonzero(total)
        yield i, hit, total[hit]


def _search(sent, weight: np.ndarray, n_docs: int, all_terms: int, k: int):
    """(item_id, doc_id, score): a task's best documents of each item, by blocks of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = sent.value
        none = np.empty(0, np.int64)
        held = [(none, none, np.empty(0, bool)) for _ in block.items]
        for batch in batches:
            lists, length = batch.column(2), batch.column(1).to_numpy()
            docs = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy())
            terms, counts = lists.flatten().to_numpy(), batch.column(3).flatten().to_numpy()
            values = impacts(weight[terms], counts, length[docs], n_docs, all_terms)
            ids, unknown = batch.column(0).fill_null(0).to_numpy(), batch.column(0).is_null().to_numpy(zero_copy_only=False)
            for i, hit, scores in product(block, terms, docs, values, batch.num_rows):
                if len(hit):
                    s, d, u = (np.concatenate(x) for x in zip(held[i], (scores, ids[hit], unknown[hit])))
                    at = best(s, d, u, k)
                    held[i] = (s[at], d[at], u[at])
        sizes = [len(s) for s, _, _ in held]
        items = pa.array([x for x, n in zip(block.items, sizes) for _ in range(n)], pa.int64())
        scores, docs, unknown = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (list(y) for y in zip(*held)))
        yield pa.RecordBatch.from_arrays([items, pa.array(docs, pa.int64(), mask=unknown.astype(bool)), pa.array(scores, pa.int64())], names=["item_id", "doc_id", "score"])
        release()

    return run


def _top(rows: DataFrame, keys: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search(documents: DataFrame, items: DataFrame, k: int = K, block_pairs: int = BLOCK_PAIRS) -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents of the highest score above 0 for each item, equal scores by ascending id.

    ``documents``: (doc_id, text), ``items``: (item_id, text); other columns are not read.
    Null texts hold no term and empty tables give no row. Rows that share a doc_id are
    documents each, rows with a null doc_id come last among equals; of items that share
    an id the smallest text counts, and a null id is one item. Texts of any length are
    read whole.
    """
    spark = documents.sparkSession
    pairs = save(item_terms(items), "item-terms")
    blocks = max(1, -(-pairs.count() // block_pairs))
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    parts = [spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")]
    n_docs = all_terms = None
    for b in range(blocks):
        own = pairs.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).toArrow()
        if not own.num_rows:
            continue
        block = ItemBlock(own)
        sent = spark.sparkContext.broadcast(block)
        postings = save(texts.mapInArrow(_postings(sent), "doc_id long, n long, terms array<int>, counts array<long>"), "postings")
        if n_docs is None:
            n_docs, all_terms = postings.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        if not n_docs:
            break
        df = np.zeros(len(block.terms), np.int64)
        for t, n in postings.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n")).collect():  # a row a term of the block
            df[t] = n
        found = postings.mapInArrow(_search(sent, weights(df, n_docs), n_docs, all_terms, k), "item_id long, doc_id long, score long")
        shares = found.withColumn("share", F.pmod(F.xxhash64("doc_id", "score"), F.lit(SHARES)))
        top = _top(_top(shares, ["item_id", "share"], k).drop("rank", "share"), ["item_id"], k)
        parts.append(top.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"))
    return reduce(DataFrame.unionByName, parts)


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents of each benchmark item; nulls, ties, repeats and empty tables as ``search`` states."""
    return search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


SEARCH_SQL = r"""
WITH t AS (
  SELECT rowid AS row, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM (SELECT row_number() OVER () AS rowid, doc_id, text FROM documents WHERE text IS NOT NULL)
), d AS (SELECT row, any_value(doc_id) AS doc_id, count(*) AS n FROM t GROUP BY row
), a AS (SELECT count(*) AS big_n, CAST(sum(n) AS BIGINT) AS big_l FROM d
), f AS (SELECT row, term, count(*) AS tf FROM t GROUP BY row, term
), w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * big_n + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM f, a GROUP BY term, big_n
), i AS (
  SELECT item_id, term, count(*) AS mult
  FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark WHERE text IS NOT NULL)
  GROUP BY item_id, term
), s AS (
  SELECT item_id, row, doc_id, CAST(sum(mult * w.w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * d.n * a.big_n) // a.big_l)))) AS BIGINT) AS score
  FROM i JOIN f USING (term) JOIN w USING (term) JOIN d USING (row), a
  GROUP BY item_id, row, doc_id
), r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 20
"""

