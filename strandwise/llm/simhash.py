"""Near duplicates by SimHash fingerprints, found through anchor points of a covering code.

The anchors are the words of a product of two perfect binary Golay codes, each of
which covers 23 bits with radius 3: every fingerprint has exactly one anchor within
that radius in both parts. Two fingerprints at most three bits apart have a midpoint
one bit from one and two bits from the other. Each fingerprint is replicated to every
anchor within the covering radius plus that share of the threshold, so both reach the
midpoint's anchor, and fingerprints are compared only with others at the same anchor.
The 18 bits outside the code count in the comparison alone.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import join_counted, read_table, save, sized
from .graph import connected_components

THRESHOLD, SHINGLE, SEED = 3, 3, 42
#: Fingerprints at one anchor beyond which their pairs are dealt to several tasks, by blocks of half as many.
HOT_ANCHOR = 40_000
#: Generator polynomial of the [23, 12] Golay code.
_GENERATOR, _BITS, _CHECKS, _RADIUS = 0b110001110101, 23, 11, 3
_EDGES = 1_000_000


# ---- fingerprints


def simhash(hashes: np.ndarray) -> int:
    """Of 64-bit hashes: a bit is 1 if it is set in over half of them."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        counts += np.unpackbits(hashes[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """64-bit SimHash of a text's word shingles; no word: 0; fewer words than a shingle: the whole sequence."""
    import xxhash

    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    digest, counts, n = xxhash.xxh64_intdigest, np.zeros(64, np.int64), len(words) - shingle + 1
    for at in range(0, n, 1 << 16):
        part = words[at : at + (1 << 16) + shingle - 1]
        grams = map(b" ".join, zip(*(itertools.islice(part, k, None) for k in range(shingle))))
        hashes = np.array([digest(x, seed) for x in grams], dtype="<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def _fingerprints(shingle: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(x.as_py(), shingle, seed) for x in batch.column(2)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found)], names=["doc_id", "text_hash", "fp"])

    return run


def text_hash(text_col: str = "text"):
    """With the id it names a row: rows that agree in both hold the same text."""
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, fp): one row a document, the fingerprint as a signed long. Nothing is shuffled."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_hash(text_col).alias("text_hash"), F.col(text_col).alias("text")).mapInArrow(_fingerprints(shingle, seed), "doc_id long, text_hash long, fp long")


# ---- anchors


def _syndrome(word: np.ndarray) -> np.ndarray:
    """Remainder of 23-bit polynomials by the generator."""
    word = word.astype(np.int64)
    for bit in range(_BITS - 1, _CHECKS - 1, -1):
        word = np.where(word >> bit & 1, word ^ (_GENERATOR << (bit - _CHECKS)), word)
    return word


@lru_cache(None)
def _patterns() -> list[tuple[np.ndarray, np.ndarray]]:
    """For excess 0, 1, 2 over the radius: error patterns by syndrome, as (starts, patterns)."""
    out = []
    for weights in (range(_RADIUS + 1), [_RADIUS + 1], [_RADIUS + 2]):
        found = np.array([sum(1 << b for b in bits) for w in weights for bits in itertools.combinations(range(_BITS), w)], dtype=np.int64)
        syndromes = _syndrome(found)
        order = np.argsort(syndromes, kind="stable")
        out.append((np.searchsorted(syndromes[order], np.arange((1 << _CHECKS) + 1)), found[order]))
    return out


def anchors(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, anchor, near): all anchors within the radius plus two, near where within the radius plus one."""
    fps = fps.view(np.uint64)
    mask = np.uint64((1 << _BITS) - 1)
    left, right = (fps & mask).astype(np.int64), (fps >> np.uint64(_BITS) & mask).astype(np.int64)
    s1, s2, table, rows, found, near = _syndrome(left), _syndrome(right), _patterns(), [], [], []
    for a, b in ((0, 0), (0, 1), (1, 0), (0, 2), (1, 1), (2, 0)):
        (at1, p1), (at2, p2) = table[a], table[b]
        n1, n2 = np.diff(at1)[s1], np.diff(at2)[s2]
        each = n1 * n2
        row = np.repeat(np.arange(len(fps)), each)
        k = np.arange(len(row)) - np.repeat(np.cumsum(each) - each, each)
        first = left[row] ^ p1[at1[s1[row]] + k // np.maximum(n2[row], 1)]
        second = right[row] ^ p2[at2[s2[row]] + k % np.maximum(n2[row], 1)]
        rows.append(row)
        found.append(first | second << _BITS)
        near.append(np.full(len(row), a + b <= 1))
    return np.concatenate(rows), np.concatenate(found), np.concatenate(near)


def _replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = batch.column(0).to_numpy(zero_copy_only=False)
        for at in range(0, len(fps), 4096):
            row, anchor, near = anchors(fps[at : at + 4096])
            yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(fps[at : at + 4096][row]), pa.array(near)], names=["anchor", "fp", "near"])


# ---- comparison at each anchor


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links with the same components as the given ones, at most one a node."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        new = label.copy()
        np.minimum.at(new, x, label[y])
        np.minimum.at(new, y, label[x])
        new = new[new]
        if (new == label).all():
            break
        label = new
    hung = label != np.arange(len(nodes))
    return nodes[label[hung]], nodes[hung]


def _compare(threshold: int):
    def links(key: np.ndarray, fp: np.ndarray, near: np.ndarray):
        """Links within runs of equal keys: rows are held against those 1, 2, 3 ... places on."""
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size, shift, left = 0, 1, np.arange(len(key))
        while len(left := left[left + shift < len(key)]) and len(left := left[key[left] == key[left + shift]]):
            right = left + shift
            apart = np.bitwise_count(fp[left] ^ fp[right])
            hit = (apart <= threshold) & (apart > 0) & (near[left] | near[right])
            if hit.any():
                held.append((fp[left[hit]], fp[right[hit]]))
                size += len(held[-1][0])
                if size > _EDGES:
                    held = [_forest(*(np.concatenate(x) for x in zip(*held)))]
                    size = len(held[0][0])
            shift += 1
        return _forest(*(np.concatenate(x) for x in zip(*held))) if held else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                new = [batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64), batch.column(2).to_numpy(zero_copy_only=False)]
                new = [np.concatenate(x) for x in zip(rest, new)] if rest else new
                if not len(new[0]):
                    continue
                cut = np.searchsorted(new[0], new[0][-1])  # the last run may go on
                rest, new = [x[cut:] for x in new], [x[:cut] for x in new]
            else:
                rest, new = None, rest
            if new and len(new[0]) and (found := links(*new)):
                yield pa.RecordBatch.from_arrays([pa.array(found[0].view(np.int64)), pa.array(found[1].view(np.int64))], names=["u", "v"])

    return run


def near_links(distinct: DataFrame, threshold: int = THRESHOLD, hot: int = HOT_ANCHOR) -> DataFrame:
    """Links (u, v) that join the same fingerprints as all pairs of ``distinct`` (fp) at most ``threshold`` (3 at most) bits apart do.

    At an anchor at most one link a fingerprint is given out. Fingerprints at an
    anchor that has more than ``hot`` are dealt to blocks, and each pair of blocks is
    a key of its own.
    """
    if threshold > 3:
        raise ValueError("anchors are replicated for thresholds up to 3")
    rows = save(distinct.select("fp").mapInArrow(_replicate, "anchor long, fp long, near boolean"), "anchors")
    crowded = save(rows.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > hot).select(F.col("anchor").alias("hot_anchor"), F.ceil(F.col("n") / F.lit(max(1, hot // 2))).cast("int").alias("blocks")), "hot-anchors")
    mine = F.pmod(F.xxhash64(F.lit(3), "fp"), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    pair = F.struct(F.least("mine", "other"), F.greatest("mine", "other"))
    marked = rows.join(sized(crowded), F.col("anchor") == F.col("hot_anchor"), "left")
    plain = marked.filter(F.col("blocks").isNull()).select(F.col("anchor").alias("key"), "fp", "near")
    dealt = marked.filter(F.col("blocks").isNotNull()).withColumn("mine", mine).withColumn("other", other).select(F.xxhash64("anchor", pair).alias("key"), "fp", "near")
    return plain.unionByName(dealt).repartition("key").sortWithinPartitions("key").mapInArrow(_compare(threshold), "u long, v long")


def near_duplicates(docs: DataFrame, threshold: int = THRESHOLD, shingle: int = SHINGLE, seed: int = SEED, hot: int = HOT_ANCHOR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, fp, component_id, is_first) of every document; component_id is the smallest id reachable over links.

    is_first marks the one document of its component that ``keep_first`` keeps. Null
    and empty texts have fingerprint 0 and link like any other. Copies share a
    fingerprint and meet as one row. Rows with one id are one row each; null ids never
    are a component's id unless it has no other. An empty table gives no rows. Other
    columns are not read.
    """
    fps = save(fingerprints(docs, shingle, seed, id_col, text_col), "fingerprints")
    distinct = save(first_of(fps, "fp"), "distinct-fingerprints")
    roots = save(connected_components(near_links(distinct, threshold, hot)), "roots")
    return with_components(fps, distinct, roots, "fp")


def first_of(rows: DataFrame, key: str, *more) -> DataFrame:
    """(key, first, n, ...): the smallest of the rows' (id, text_hash), null ids last, and how many rows have the key."""
    return rows.groupBy(key).agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("first"), F.count(F.lit(1)).alias("n"), *more)


def with_components(rows: DataFrame, distinct: DataFrame, roots: DataFrame, key: str) -> DataFrame:
    """``rows`` (doc_id, text_hash, key) with component_id and is_first, from the smallest ``first`` of the keys that hang on the same root.

    ``distinct``: as ``first_of`` gives; ``roots``: (node, root) of the keys that are
    linked. All copies of a text share a key, and a large component a root: neither
    meets in one task.
    """
    named = distinct.join(roots, F.col(key) == F.col("node"), "left").select(key, "first", F.col("n").alias("rows"), F.coalesce("root", key).alias("root"))
    named = save(named, "grouped")
    least = named.groupBy("root").agg(F.min("first").alias("head"), F.count(F.lit(1)).alias("n"))
    by_key = save(join_counted(named, least, "root", named.count()).select(key, "head", F.col("rows").alias("n")), "components")
    own = F.col("doc_id").eqNullSafe(F.col("head.doc_id")) & (F.col("text_hash") == F.col("head.text_hash"))
    return join_counted(rows, by_key, key, rows.count()).select("doc_id", "text_hash", key, F.col("head.doc_id").alias("component_id"), own.alias("is_first"))


def keep_first(docs: DataFrame, duplicates: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each component: the one with the smallest id; null ids come last, and of one id's texts the smallest hash first.

    Rows that agree in id and text are one document: of them the row that comes first
    by a digest of all its columns stays, so reruns agree. ``duplicates``: as
    ``near_duplicates`` gives, with is_first.
    """
    named = duplicates.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "is_first")
    gone = save(named.filter("NOT is_first").select("_id", "_hash").distinct(), "gone")
    equal = save(named.filter("is_first").groupBy("_id", "_hash").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("_id", "_hash"), "equal-rows")
    same = F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_hash"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_own"), F.col(id_col).cast("long").alias("_doc"), text_hash(text_col).alias("_text"))
    # what goes is less than what stays: texts move only if it is more than fits a broadcast
    kept = rows.join(sized(gone), same, "left_anti")
    if not equal.limit(1).count():
        return kept.select("_own.*")
    digest = F.sha2(F.to_json("_own", {"ignoreNullFields": "false"}), 256)
    chosen = kept.join(sized(equal), same).groupBy("_id", "_hash").agg(F.min_by("_own", digest).alias("_own"))
    return kept.join(sized(equal), same, "left_anti").select("_own.*").unionByName(chosen.select("_own.*"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and the smallest document that it is linked to."""
    found = near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
