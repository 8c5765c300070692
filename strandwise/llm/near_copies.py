"""Near copies by the Jaccard similarity of word shingles: candidates by SimHash and by MinHash bands, each verified exactly.

Documents whose sets of shingles are equal are one row. Every set has a SimHash
fingerprint; fingerprints are linked through the anchors of ``simhash``, and sets that
hang together share a bucket. Sets of similarity 0.8 are often further apart than
fingerprints may be, so every set is also put in one bucket a band of MinHash; two sets
of similarity s meet in at least one of these with probability 1 - (1 - s^ROWS)^BANDS,
which is 0.99995 at 0.8. Only sets that share a bucket are read again, and within a
bucket all pairs that are not joined yet are compared by their whole sets.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import release, save, sized
from .graph import connected_components
from .simhash import first_of, simhash, text_hash, with_components
from .simhash import near_links as fingerprint_links

SIMILARITY, SHINGLE, SEED = 0.8, 5, 42
BANDS, ROWS = 25, 5
#: Shingles in one bucket beyond which its pairs are dealt to several tasks, by blocks of half as many.
HOT_BUCKET = 1_000_000
_random = np.random.default_rng(SEED)
_XOR, _TIMES = (_random.integers(0, 1 << 64, BANDS * ROWS, dtype=np.uint64) for _ in range(2))
_TIMES |= np.uint64(1)


def shingles(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of a text's word shingles; no word: none; fewer words than a shingle: the whole sequence."""
    import xxhash

    words, digest = (text or "").encode("utf-8", "replace").lower().split(), xxhash.xxh64_intdigest
    if not words:
        return np.zeros(0, np.uint64)
    shingle, step, parts = min(shingle, len(words)), 1 << 16, []
    for at in range(0, len(words) - shingle + 1, step):
        part = words[at : at + step + shingle - 1]
        parts.append(np.array([digest(b" ".join(x), SEED) for x in zip(*(itertools.islice(part, k, None) for k in range(shingle)))], dtype=np.uint64))
    return np.unique(np.concatenate(parts))


def _key(found: np.ndarray) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(found.tobytes(), SEED)


def buckets(found: np.ndarray) -> np.ndarray:
    """One bucket a band, as a hash of the band's number and smallest values; none for no shingle."""
    import xxhash

    if not len(found):
        return np.zeros(0, np.int64)
    least = np.full(len(_TIMES), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), 4096):
        mixed = (found[at : at + 4096, None] ^ _XOR) * _TIMES
        # the low bits of a product depend on few bits of its factors
        least = np.minimum(least, (mixed ^ mixed >> np.uint64(32)).min(axis=0))
    return np.array([xxhash.xxh64_intdigest(x.tobytes(), band) for band, x in enumerate(least.reshape(BANDS, ROWS))], dtype=np.uint64).view(np.int64)


def _sketch(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, sizes, bands, fps = [], [], [], []
            for x in batch.column(2):
                found = shingles(x.as_py(), shingle)
                keys.append(_key(found))
                sizes.append(len(found))
                bands.append(buckets(found))
                fps.append(simhash(found))
            fps = pa.array(np.array(fps, dtype=np.uint64).view(np.int64))
            keys = pa.array(np.array(keys, dtype=np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), keys, pa.array(sizes, pa.int64()), pa.array(bands, pa.list_(pa.int64())), fps], names=["doc_id", "text_hash", "key", "size", "bands", "fp"])
        release()

    return run


def _sets(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                found = [shingles(x.as_py(), shingle) for x in batch.column(0).slice(at, 256)]
                keys = pa.array(np.array([_key(x) for x in found], dtype=np.uint64).view(np.int64))
                yield pa.RecordBatch.from_arrays([keys, pa.array([x.tobytes() for x in found], pa.binary())], names=["key", "shingles"])
        release()

    return run


def similar_links(keys: list[int], sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Links that join the same keys as all pairs of at least that similarity do, fewer than there are keys."""
    sizes = np.array([len(x) for x in sets])
    flat, starts = np.unique(np.concatenate(sets), return_inverse=True)[1], np.cumsum(sizes) - sizes
    group, out, mark = np.arange(len(sets)), [], np.zeros(flat.max() + 1, np.int64)
    for i in range(len(sets) - 1):
        if (group[i + 1 :] == group[i]).all():
            continue
        own, rest = flat[starts[i] : starts[i] + sizes[i]], starts[i + 1]
        mark[own] = 1
        both = np.add.reduceat(mark[flat[rest:]], starts[i + 1 :] - rest)
        mark[own] = 0
        for j in np.flatnonzero(both + 1e-9 >= similarity * (sizes[i] + sizes[i + 1 :] - both)) + i + 1:
            if group[j] != group[i]:
                out.append((keys[i], keys[j]))
                group[group == group[j]] = group[i]
    return out


def _verify(similarity: float):
    def links(rows: dict[int, bytes]):
        found = similar_links(list(rows), [np.frombuffer(x, np.uint64) for x in rows.values()], similarity) if len(rows) > 1 else []
        if found:
            u, v = zip(*found)
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, {}
        for batch in batches:
            for bucket, key, found in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if bucket != now:
                    yield from links(rows)
                    now, rows = bucket, {}
                rows[key] = found
        yield from links(rows)
        release()

    return run


def near_links(docs: DataFrame, distinct: DataFrame, similarity: float, shingle: int, hot: int, id_col: str, text_col: str) -> DataFrame:
    """Links (u, v) between the keys of ``distinct`` (key, first, size, bands) that are similar; ``docs`` holds their texts."""
    rows = distinct.select("key", "size", F.explode("bands").alias("bucket"))
    shared = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("key").cast("decimal(38,0)")).alias("who"), F.sum("size").alias("all")).filter("n > 1")
    # buckets of the same sets are compared once
    once = save(shared.groupBy("n", "who", "all").agg(F.min("bucket").alias("b")).select("b", F.when(F.col("all") > hot, F.ceil(F.col("all") / F.lit(max(1, hot // 2)))).otherwise(1).cast("int").alias("blocks")), "buckets")
    members = save(rows.join(sized(once), F.col("bucket") == F.col("b")).select("bucket", "key", "blocks"), "members")
    wanted = save(distinct.join(members.select("key").distinct(), "key", "left_semi").select(F.col("first.doc_id").alias("_doc"), F.col("first.text_hash").alias("_hash")), "candidates")
    own = docs.select(F.col(id_col).cast("long").alias("id"), text_hash(text_col).alias("hash"), F.col(text_col).alias("text"))
    texts = own.join(sized(wanted), F.col("id").eqNullSafe(F.col("_doc")) & (F.col("hash") == F.col("_hash")), "left_semi").select("text")
    sets = save(texts.mapInArrow(_sets(shingle), "key long, shingles binary"), "shingle-sets")
    mine = F.pmod(F.xxhash64(F.lit(3), "key"), F.col("blocks")).cast("int")
    pair = F.struct(F.least("mine", "other"), F.greatest("mine", "other"))
    dealt = members.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select(F.when(F.col("blocks") == 1, F.col("bucket")).otherwise(F.xxhash64("bucket", pair)).alias("bucket"), "key")
    # repeated rows can give a set twice
    return dealt.join(sets, "key").select("bucket", "key", "shingles").repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_verify(similarity), "u long, v long")


def with_groups(distinct: DataFrame) -> DataFrame:
    """``distinct`` (key, fp, bands, ...) with one more bucket, that of the fingerprints which hang together; none for no shingle."""
    links = fingerprint_links(distinct.filter("size > 0").select("fp").distinct())
    roots = save(connected_components(links), "fingerprint-roots")
    named = distinct.join(sized(roots.withColumnsRenamed({"node": "fp", "root": "group"})), "fp", "left")
    own = F.when(F.col("size") > 0, F.array(F.xxhash64(F.lit(-1), F.coalesce("group", "fp")))).otherwise(F.array().cast("array<long>"))
    return named.withColumn("bands", F.concat(own, "bands")).select(*distinct.columns)


def near_copies(docs: DataFrame, similarity: float = SIMILARITY, shingle: int = SHINGLE, hot: int = HOT_BUCKET, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, component_id, is_first) of every document; component_id is the smallest id reachable over pairs of at least that similarity.

    is_first marks the document of each component that ``keep_first`` keeps. Texts
    without a word are copies of each other. Rows with one id are one row each; null
    ids never are a component's id unless it has no other. An empty table gives no
    rows. Other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_hash(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    found = save(rows.mapInArrow(_sketch(shingle), "doc_id long, text_hash long, key long, size long, bands array<long>, fp long"), "sketches")
    distinct = save(first_of(found, "key", F.first("size").alias("size"), F.first("bands").alias("bands"), F.first("fp").alias("fp")), "distinct-sets")
    distinct = save(with_groups(distinct), "grouped-sets")
    roots = save(connected_components(near_links(docs, distinct, similarity, shingle, hot, id_col, text_col)), "roots")
    return with_components(found.select("doc_id", "text_hash", "key"), distinct.select("key", "first", "n"), roots, "key").drop("key")
