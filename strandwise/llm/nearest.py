"""Approximate nearest neighbours by randomly rotated one-bit codes.

A vector is scaled to length 1, its list's centre is taken off, and the rest is rotated
at random; a code keeps the signs. Signs and a few correction scalars estimate the inner
product with any query, with an error bound that holds with a chosen probability. A
query looks at the codes of its lists, and only vectors whose upper bound reaches the
k-th best exact value are compared as they are.

Lists are centres fitted on a bounded sample. How many lists a query visits is measured
there too: as many as hold the wanted share of the sample's true neighbours, all if need be.
Every distinct vector is in the index once, with the smallest ids that have it: of
copies no query can need more.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import join_counted, read_table, save, sized

#: Neighbours, vectors the lists are fitted on, vectors a list has on average, lists at most, and share of the sample's neighbours that visited lists hold.
K, SAMPLE_ROWS, LIST_ROWS, MAX_LISTS, WANTED = 5, 20_000, 8192, 1024, 0.99
#: Standard deviations of the estimate that its bound allows for, and shares of a list: codes and queries that meet in one task.
DEVIATIONS, BLOCK_CODES, BLOCK_QUERIES, SEED = 2.5, 1 << 15, 1 << 12, 11
#: Numbers in the sample at most, and sample queries that the visited lists are measured with.
SAMPLE_VALUES, PROBED = 4_000_000, 512


def code_bits(dims: int) -> int:
    """Bits of a code: a power of two, twice the dimensions at least."""
    return max(64, 1 << (2 * dims - 1).bit_length())


def rotate(vectors: np.ndarray, bits: int, seed: int = SEED) -> np.ndarray:
    """Vectors (rows) padded to ``bits`` dimensions and rotated: random signs and a Hadamard transform, three times."""
    out = np.zeros((len(vectors), bits))
    out[:, : vectors.shape[1]] = vectors
    r = np.random.default_rng(seed)
    for _ in range(3):
        out *= r.choice([-1.0, 1.0], bits)
        h = 1
        while h < bits:
            pairs = out.reshape(len(out), bits // (2 * h), 2, h)
            a, b = pairs[:, :, 0], pairs[:, :, 1]
            out = np.stack((a + b, a - b), axis=2).reshape(len(out), bits)
            h *= 2
        out /= np.sqrt(bits)
    return out


def units(vectors: np.ndarray) -> np.ndarray:
    """Vectors of length 1; scaled by a power of two first, so that no square is lost or infinite."""
    _, exponent = np.frexp(np.abs(vectors).max(axis=1))
    scaled = np.ldexp(vectors, -exponent[:, None])
    return scaled / np.sqrt((scaled * scaled).sum(axis=1))[:, None]


class Originals:
    """Vectors as they are, for exact cosines in doubles."""

    def __init__(self, vectors: np.ndarray):
        self.vectors, self.norms = self._scaled(vectors)

    @staticmethod
    def _scaled(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        _, exponent = np.frexp(np.abs(vectors).max(axis=1))
        scaled = np.ldexp(vectors, -exponent[:, None])
        return scaled, np.sqrt((scaled * scaled).sum(axis=1))

    def cosines(self, query: np.ndarray, places: np.ndarray) -> np.ndarray:
        q, size = self._scaled(query[None])
        return (self.vectors[places] * q[0]).sum(axis=1) / (self.norms[places] * size[0])


@dataclass
class Codes:
    """Codes of vectors of one list: packed signs of the rotated rest, its length, its part along the code, and its product with the centre."""

    signs: np.ndarray
    length: np.ndarray
    along: np.ndarray
    with_centre: np.ndarray

    @staticmethod
    def of(vectors: np.ndarray, centres: np.ndarray) -> Codes:
        """``vectors`` of length 1 and the centre of each."""
        bits = code_bits(vectors.shape[1])
        rest = vectors - centres
        length = np.sqrt((rest * rest).sum(axis=1))
        turned = rotate(rest / np.where(length > 0, length, 1)[:, None], bits)
        along = np.abs(turned).sum(axis=1) / np.sqrt(bits)
        signs = np.packbits(turned > 0, axis=1, bitorder="little").view(np.uint64)
        return Codes(signs, length, along, (rest * centres).sum(axis=1))

    def bounds(self, query: np.ndarray, centre: np.ndarray, deviations: float) -> tuple[np.ndarray, np.ndarray]:
        """(estimate, error) of the inner products of a query of length 1 with all vectors, from packed bits alone.

        The query's rest is rotated and rounded to whole numbers of 8 bits, so that the
        product with a code is a count of common bits for each of 8 slices; what
        rounding can do is added to the error.
        """
        bits = code_bits(len(query))
        rest = query - centre
        size = np.sqrt((rest * rest).sum())
        turned = rotate(rest[None], bits)[0]
        low = turned.min()
        step = (turned.max() - low) / 255 or 1.0
        whole = np.rint((turned - low) / step).astype(np.uint8)
        slices = np.packbits((whole[None] >> np.arange(8, dtype=np.uint8)[:, None]) & 1, axis=1, bitorder="little").view(np.uint64)
        held = sum(np.bitwise_count(self.signs & s).sum(axis=1, dtype=np.int64) << j for j, s in enumerate(slices))
        ones = np.bitwise_count(self.signs).sum(axis=1, dtype=np.int64)
        root = np.sqrt(bits)
        # the code's coordinates are plus and minus 1 / root: twice what its ones hold, less everything
        product = (2 * (low * ones + step * held) - (low * bits + step * int(whole.sum(dtype=np.int64)))) / root
        rounding = np.abs(turned - (low + step * whole)).sum() / root
        along = np.where(self.along > 0, self.along, 1)
        estimate = query @ centre + self.with_centre + self.length * product / along
        spread = np.sqrt(np.maximum(1 - along * along, 0)) / along / np.sqrt(max(bits - 1, 1))
        return estimate, self.length * (deviations * size * spread + rounding / along) + 1e-9


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, v): vectors that can take part, as doubles. Null, empty and zero vectors, those with null or non-finite components, and null ids are left out."""
    v = F.transform(F.col(vector_col), lambda x: x.cast("double") + F.lit(0.0))  # no negative zero
    fits = (F.size(vector_col) > 0) & ~F.exists(vector_col, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))) & F.exists(vector_col, lambda x: x != 0)
    return vectors.filter(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).filter(fits).select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))


def distinct_vectors(vectors: DataFrame, k: int) -> DataFrame:
    """(v, ids, dims): each vector once, with its k + 1 smallest ids, of which a query can be one."""
    if vectors.groupBy("vec_id").count().filter("count > 1").limit(1).count():
        vectors = vectors.distinct()
    # the limit on the row number works before the exchange too, so any number of copies is no load
    few = vectors.withColumn("_n", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).filter(F.col("_n") <= k + 1)
    return few.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).select("v", "ids", F.size("v").alias("dims"))


@dataclass
class Lists:
    """Centres of the lists of one number of dimensions, and how many of them a query visits."""

    centres: np.ndarray
    visited: int

    def nearest(self, vectors: np.ndarray) -> np.ndarray:
        return np.argmin((self.centres * self.centres).sum(axis=1) - 2 * (vectors @ self.centres.T), axis=1)


def fit(sample: np.ndarray, lists: int, k: int, wanted: float) -> Lists:
    """Centres by ten rounds of k-means over vectors of length 1, and the visited lists as measured over the sample itself."""
    lists = min(lists, max(1, len(sample) // 8))
    r = np.random.default_rng(SEED)
    centres = sample[r.choice(len(sample), lists, replace=False)]
    for _ in range(10 if lists > 1 else 1):
        at = Lists(centres, lists).nearest(sample)
        sizes = np.bincount(at, minlength=lists)
        sums = np.zeros_like(centres)
        np.add.at(sums, at, sample)
        centres = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], centres)
    found = Lists(centres, lists)
    if lists > 1:
        at = found.nearest(sample)
        asked = r.choice(len(sample), min(PROBED, len(sample)), replace=False)
        near = sample[asked] @ sample.T
        near[np.arange(len(asked)), asked] = -2
        true = np.argpartition(-near, min(k, near.shape[1] - 1), axis=1)[:, :k]
        order = np.argsort(visiting(centres, sample[asked]), axis=1)
        place = np.argsort(order, axis=1)
        needed = np.sort(np.take_along_axis(place, at[true], axis=1).ravel())
        found.visited = int(needed[min(len(needed) - 1, int(np.ceil(wanted * len(needed))))]) + 1
    return found


def visiting(centres: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """How far centres are from queries: the lists of smallest values are visited."""
    return (centres * centres).sum(axis=1) - 2 * (queries @ centres.T)


def fit_lists(distinct: DataFrame, rows: int, k: int = K, wanted: float = WANTED, list_rows: int = LIST_ROWS) -> dict[int, Lists]:
    """Lists by number of dimensions, from a sample of SAMPLE_ROWS vectors (those of the smallest hashes; fewer long ones); vectors of other numbers are one list each."""
    longest = distinct.agg(F.max("dims")).first()[0] or 1
    sample = distinct.orderBy(F.xxhash64("v")).limit(min(SAMPLE_ROWS, max(1, SAMPLE_VALUES // longest))).select("v").toPandas()["v"]
    by_dims: dict[int, list] = {}
    for v in sample:
        by_dims.setdefault(len(v), []).append(v)
    lists = max(1, min(MAX_LISTS, rows // list_rows))
    return {d: fit(units(np.array(v, np.float64)), lists, k, wanted) for d, v in by_dims.items()}


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pd.DataFrame]]:
    """Rows by number of dimensions."""
    for batch in batches:
        rows = batch.to_pandas()
        yield from rows.groupby("dims")


def _centres(models: dict[int, Lists], dims: int) -> np.ndarray:
    return models[dims].centres if dims in models else np.zeros((1, dims))


def _encode(models: dict[int, Lists]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dims, rows in _batches(batches):
            centres = _centres(models, dims)
            vectors = units(np.stack(rows["v"].to_numpy()))
            at = Lists(centres, 1).nearest(vectors)
            codes = Codes.of(vectors, centres[at])
            out = {"dims": rows["dims"], "list": at.astype(np.int32), "ids": rows["ids"], "v": rows["v"], "signs": [x.tobytes() for x in codes.signs], "length": codes.length, "along": codes.along, "with_centre": codes.with_centre}
            yield pa.RecordBatch.from_pandas(pd.DataFrame(out), preserve_index=False)

    return run


def _visits(models: dict[int, Lists]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dims, rows in _batches(batches):
            centres, n = _centres(models, dims), models[dims].visited if dims in models else 1
            order = np.argsort(visiting(centres, units(np.stack(rows["v"].to_numpy()))), axis=1)[:, :n].astype(np.int32)
            yield pa.RecordBatch.from_pandas(pd.DataFrame({"dims": rows["dims"], "qrep": rows["qrep"], "v": rows["v"], "lists": list(order)}), preserve_index=False)

    return run


def rerank(query: np.ndarray, originals: Originals, estimate: np.ndarray, error: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, cosines) of the k best vectors and of all that tie with the last of them.

    The best estimates are compared first; the k-th best of these is what the upper
    bound of any other vector has to reach.
    """
    n = len(estimate)
    first = np.argpartition(-estimate, 4 * k)[: 4 * k] if n > 4 * k else np.arange(n)
    values = originals.cosines(query, first)
    if n > len(first):
        least = np.partition(values, len(values) - k)[len(values) - k]
        first = np.flatnonzero(estimate + error >= least)
        values = originals.cosines(query, first)
    if len(values) > k:
        kept = values >= np.partition(values, len(values) - k)[len(values) - k]
        first, values = first[kept], values[kept]
    return first, values


def _compare(models: dict[int, Lists], k: int, deviations: float):
    """(qrep, score, vec_id, same): a block's best vectors for each query vector, with their ids; same: it is the query's own vector."""

    def run(key: tuple, codes: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(codes) and len(queries):
            dims, number = int(codes["dims"].iloc[0]), int(codes["list"].iloc[0])
            centre = _centres(models, dims)[number]
            vectors, ids = np.stack(codes["v"].to_numpy()), codes["ids"].to_numpy()
            originals = Originals(vectors)
            held = Codes(np.frombuffer(b"".join(codes["signs"]), np.uint64).reshape(len(codes), -1), *(codes[c].to_numpy() for c in ("length", "along", "with_centre")))
            for qrep, v in zip(queries["qrep"].to_numpy(), queries["v"].to_numpy()):
                places, values = rerank(v, originals, *held.bounds(units(v[None])[0], centre, deviations), k)
                entries = [(-s, i, np.array_equal(vectors[p], v)) for p, s in zip(places, values) for i in ids[p]]
                out += [(qrep, -s, i, same) for s, i, same in sorted(entries)[:k]]
        return pd.DataFrame(out, columns=["qrep", "score", "vec_id", "same"]).astype({"qrep": "int64", "score": "float64", "vec_id": "int64", "same": "bool"})

    return run


def search(vectors: DataFrame, queries: DataFrame, k: int = K, wanted: float = WANTED, deviations: float = DEVIATIONS, list_rows: int = LIST_ROWS, block_codes: int = BLOCK_CODES, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest vectors found for each query by cosine, ties to the smaller id.

    Both tables: (vec_id, v) as ``usable`` gives. Vectors are compared with those of
    their own length only. Rows with equal id and vector are one row; rows that share
    an id but not the vector are candidates each, and of queries that share an id the
    one with the smallest vector, in the order of arrays, is asked. Empty tables give
    no row.
    """
    more = k + 1  # a query's own row may be among the best
    distinct = save(distinct_vectors(vectors, k), "distinct-vectors")
    n = distinct.count()
    models = fit_lists(distinct, n, k, wanted, list_rows)
    codes = save(distinct.mapInArrow(_encode(models), "dims int, list int, ids array<long>, v array<double>, signs binary, length double, along double, with_centre double"), "codes")
    asked = save(queries.groupBy("vec_id").agg(F.min("v").alias("v")), "queries")
    once = save(asked.groupBy("v").agg(F.min("vec_id").alias("qrep"), F.count(F.lit(1)).alias("n")), "query-vectors")
    visits = once.select("qrep", "v", F.size("v").alias("dims")).mapInArrow(_visits(models), "dims int, qrep long, v array<double>, lists array<int>")
    visits = save(visits.withColumn("list", F.explode("lists")).drop("lists"), "visits")
    # large lists are cut: codes by their hash, and queries by theirs
    sizes = codes.groupBy("dims", "list").agg(F.ceil(F.count(F.lit(1)) / block_codes).cast("int").alias("code_parts"))
    loads = visits.groupBy("dims", "list").agg(F.ceil(F.count(F.lit(1)) / block_queries).cast("int").alias("query_parts"))
    parts = sized(save(sizes.join(loads, ["dims", "list"]), "parts"))
    own = lambda c: F.pmod(F.xxhash64("v"), F.col(c)).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    left = codes.join(parts, ["dims", "list"]).withColumn("cp", own("code_parts")).withColumn("qp", every("query_parts")).drop("code_parts", "query_parts")
    right = visits.join(parts, ["dims", "list"]).withColumn("qp", own("query_parts")).withColumn("cp", every("code_parts")).drop("code_parts", "query_parts")
    key = ("dims", "list", "cp", "qp")
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(_compare(models, more, deviations), "qrep long, score double, vec_id long, same boolean")
    best = Window.partitionBy("qrep").orderBy(F.desc("score"), "vec_id")
    merged = found.withColumn("_n", F.row_number().over(best)).filter(F.col("_n") <= more).groupBy("qrep").agg(F.collect_list(F.struct("score", "vec_id", "same")).alias("near"))
    answers = save(once.join(merged, "qrep").select("v", "near", "n"), "answers")
    rows = join_counted(asked, answers, "v", asked.count())
    others = F.filter("near", lambda x: ~(x["same"] & (x["vec_id"] == F.col("vec_id"))))
    ranked = F.slice(F.array_sort(F.transform(others, lambda x: F.struct((-x["score"]).alias("order"), x["vec_id"].alias("vec_id"), x["score"].alias("score")))), 1, k)
    return rows.select(F.col("vec_id").alias("query_id"), F.posexplode(ranked).alias("at", "near")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("near")["vec_id"].alias("vec_id"), F.col("near")["score"].alias("score"))


def op11_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest vectors found for every vector whose id is divisible by 50; rows that take no part, ties, repeats and empty tables as ``usable`` and ``search`` state."""
    vectors = usable(read_table(spark, sf_dir, "embeddings"))
    return search(vectors, vectors.filter(F.col("vec_id") % 50 == 0))
