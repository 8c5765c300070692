"""Exact top-k by inner product over a bit-sliced index.

Vectors are quantised to integers and dealt to blocks. In a block each attribute is
kept as bit slices: one bitmap over the block's rows for every bit of the attribute.
A query adds slices: each set bit of a query component contributes the attribute's
slices, moved up by that bit (complemented slices for negative components), and
carry-save addition over whole bitmaps turns them into the slices of all rows' scores
at once. The top rows are then chosen from the most significant slice downward, and
the rows that tie at the boundary are resolved by their ids.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import read_table, save

#: Rows of an index block, most queries of a block of queries, and least tasks if there are queries enough.
BLOCK_ROWS, BLOCK_QUERIES, MIN_TASKS = 1 << 16, 1 << 14, 24
SCALE = 64
#: Vectors with a component of this size or more go to blocks of their own, so that few long numbers do not widen the slices of all.
WIDE = 1 << 40
_LONG = 1 << 63


def integers(vectors: np.ndarray) -> np.ndarray:
    """floor(64 x) of finite doubles, exactly: 64-bit integers where they fit, else Python's own."""
    if not vectors.size or np.abs(vectors).max() < 2.0**55:
        return np.floor(vectors * SCALE).astype(np.int64)
    whole = [[int(x) * SCALE if abs(x) >= 2.0**52 else int(np.floor(x * SCALE)) for x in v] for v in vectors.tolist()]
    out = np.empty(vectors.shape, object)
    out[:] = whole
    return out


def sort_key(score: int) -> bytes:
    """Bytes that order as integers of any size do: sign and length, then the digits, complemented below zero."""
    digits = abs(score).to_bytes(max(1, -(-abs(score).bit_length() // 8)), "big")
    head = (0x8000 + len(digits) if score >= 0 else 0x8000 - len(digits)).to_bytes(2, "big")
    return head + (digits if score >= 0 else bytes(255 - d for d in digits))


class BitSlicedIndex:
    """Slices of all attributes of a block of integer vectors (rows x attributes), of as many bits as the block needs."""

    def __init__(self, values: np.ndarray):
        self.n, self.dims = values.shape
        self.low = int(values.min()) if values.size else 0
        self.width = int(int(values.max()) - self.low).bit_length() if values.size else 0
        self.words = -(-self.n // 64)
        shifted = values.T - self.low
        shifted, one = (shifted.astype(np.uint64), np.uint64(1)) if self.width < 64 and shifted.dtype != object else (shifted, 1)
        self.slices = np.zeros((self.dims, max(self.width, 1), self.words), np.uint64)
        for b in range(self.width):
            bits = np.packbits((shifted >> type(one)(b) & one).astype(np.uint8), axis=1, bitorder="little")
            self.slices[:, b].view(np.uint8)[:, : bits.shape[1]] = bits
        self.full = np.zeros(self.words, np.uint64)
        ones = np.packbits(np.ones(self.n, np.uint8), bitorder="little")
        self.full.view(np.uint8)[: len(ones)] = ones

    def scores(self, query: np.ndarray) -> tuple[list[np.ndarray], int]:
        """Slices of (score - base) of all rows, least significant first, and base. All summands are made non-negative."""
        top = (1 << self.width) - 1
        columns: dict[int, list[np.ndarray]] = {}
        base = 0
        for sign in (1, -1):
            chosen = np.flatnonzero(query * sign > 0)
            weights = query[chosen] * sign
            # q*a = q*low + q*a' for q > 0, and |q|*(top - a') + q*(low + top) for q < 0, with a' = a - low
            base += sum(int(w) for w in weights) * sign * (self.low if sign > 0 else self.low + top)
            for bit in range(int(weights.max()).bit_length() if len(weights) else 0):
                dims = chosen[((weights >> bit) & 1).astype(bool)]
                if len(dims):
                    for b in range(self.width):
                        part = self.slices[dims, b]
                        columns.setdefault(bit + b, []).append(part if sign > 0 else ~part & self.full)
        out, place = [], 0
        while columns:
            parts = columns.pop(place, None)
            if parts is None:
                out.append(np.zeros(self.words, np.uint64))
            else:
                held = np.concatenate(parts) if len(parts) > 1 else parts[0]
                while len(held) > 1:  # carry-save: three bitmaps of a place become one, and one of the next place
                    m = len(held) // 3
                    if m:
                        a, b, c = held[:m], held[m : 2 * m], held[2 * m : 3 * m]
                        ab = a ^ b
                        carry, held = a & b | c & ab, np.concatenate((ab ^ c, held[3 * m :]))
                    else:
                        a, b = held[:1], held[1:2]
                        carry, held = a & b, a ^ b
                    columns.setdefault(place + 1, []).append(carry)
                out.append(held[0])
            place += 1
        return out, base

    def top(self, slices: list[np.ndarray], k: int, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sure, ties): bitmaps of rows that belong to the top k, and of those that share the last score with others."""
        sure, ties = np.zeros(self.words, np.uint64), allowed.copy()
        for s in reversed(slices):
            ones = ties & s
            n = int(np.bitwise_count(sure).sum() + np.bitwise_count(ones).sum())
            if n > k:
                ties = ones
            else:
                sure, ties = sure | ones, ties & ~s
                if n == k:
                    return sure, np.zeros_like(ties)
        return sure, ties

    def rows(self, bitmap: np.ndarray) -> np.ndarray:
        return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little")[: self.n])


def top_k(index: BitSlicedIndex, ids: np.ndarray, query: np.ndarray, query_id: int, k: int) -> tuple[np.ndarray, list[int]]:
    """Ids and exact scores of the k best rows of a block (ids ascending in it), the query's own row left out."""
    slices, base = index.scores(query)
    allowed = index.full.copy()
    for own in range(*np.searchsorted(ids, [query_id, query_id + 1])):
        allowed[own >> 6] &= ~(np.uint64(1) << np.uint64(own & 63))
    sure, ties = index.top(slices, k, allowed)
    rows = index.rows(sure)
    rows = np.concatenate((rows, index.rows(ties)[: k - len(rows)]))
    fits = len(slices) < 62 and abs(base) < 1 << 61
    scores = np.full(len(rows), base, np.int64 if fits else object)
    for place, s in enumerate(slices):
        bits = (s[rows >> 6] >> (rows & 63).astype(np.uint64) & np.uint64(1)).astype(np.int64)
        scores += bits << place if fits else bits.astype(object) << place
    return ids[rows], scores.tolist()


def _search(k: int):
    def run(key: tuple, rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        ids_of, vec_ids, scores = [], [], []
        if len(rows) and len(queries):
            rows = rows.sort_values("vec_id", kind="stable")
            ids, index = rows["vec_id"].to_numpy(), BitSlicedIndex(integers(np.stack(rows["v"].to_numpy())))
            for qid, v in zip(queries["vec_id"], queries["v"]):
                found, best = top_k(index, ids, integers(np.asarray(v, np.float64)[None])[0], qid, k)
                ids_of += [qid] * len(found)
                vec_ids += found.tolist()
                scores += best
        held = np.array([min(max(x, -_LONG), _LONG - 1) for x in scores], np.int64)
        out = {"query_id": np.array(ids_of, np.int64), "vec_id": np.array(vec_ids, np.int64), "score": held, "order": [sort_key(x) for x in scores], "exact": [str(x) for x in scores]}
        return pd.DataFrame({name: pd.Series(x, dtype=object if isinstance(x, list) else x.dtype) for name, x in out.items()})

    return run


def quantised(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, v): vectors that can take part, as doubles; those that are null, empty, or hold null or non-finite components are left out, as are null ids.

    A component stands for floor(64 x), which ``integers`` takes where slices are made:
    as a number of any size, for 64 x need be no finite double.
    """
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    whole = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return vectors.filter(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).filter((F.size(vector_col) > 0) & whole).select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, block_rows: int = BLOCK_ROWS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score, exact): the k best rows of each query, ties to the smaller id.

    Both tables: (vec_id, v) as ``quantised`` gives. Vectors are compared with those of
    their own length only. Rows are dealt to blocks by their id's hash and queries go
    in blocks past every block of rows; a block's k best are merged at the end. Ranks
    follow exact scores of any size; ``exact`` has their digits, and ``score`` is the
    nearest long. Rows that share an id are candidates each; of queries that share an
    id the one with the smallest vector, in the order of arrays, is asked.
    """
    wide = F.exists("v", lambda x: F.abs(x) >= F.lit(float(WIDE // SCALE)))
    vectors = save(vectors.select("vec_id", "v", F.size("v").alias("dims"), wide.alias("wide")), "vectors")
    queries = save(queries.groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("dims", F.size("v")), "queries")
    n, nq = vectors.count(), queries.count()
    row_blocks = max(1, -(-n // block_rows))
    query_blocks = max(1, -(-nq // block_queries), min(-(-nq // 64), -(-MIN_TASKS // row_blocks)))
    rows = vectors.withColumn("r", F.pmod(F.xxhash64("vec_id"), F.lit(row_blocks))).withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    blocks = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(row_blocks - 1).cast("long")))
    kinds = [r["wide"] for r in vectors.select("wide").distinct().collect()]  # two at most
    asked = queries.withColumn("q", F.pmod(F.xxhash64(F.lit(1), "vec_id"), F.lit(query_blocks)).cast("int")).withColumn("r", blocks).withColumn("wide", F.explode(F.array(*map(F.lit, kinds or [False]))))
    key = ("dims", "wide", "r", "q")
    found = rows.groupBy(*key).cogroup(asked.groupBy(*key)).applyInPandas(_search(k), "query_id long, vec_id long, score long, order binary, exact string")
    best = Window.partitionBy("query_id").orderBy(F.desc("order"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", "exact")


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best rows for every vector whose id is divisible by 20."""
    vectors = quantised(read_table(spark, sf_dir, "embeddings"))
    return search(vectors, vectors.filter(F.col("vec_id") % 20 == 0)).drop("exact")


TOPK_SQL = """
WITH q AS (
  SELECT vec_id, [floor(64 * CAST(x AS DOUBLE)) for x in embedding] AS v
  FROM embeddings
  WHERE len(embedding) > 0 AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id,
         CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM q a JOIN q b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
