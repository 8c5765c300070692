"""Mixing of sources to target weights by capped water-filling, DataFrame functions only.

Each source asks for its weight's share of the whole. A source that would be read
more than ``max_epochs`` times is clamped there, and what it can't take is shared by
the others in proportion to their weights, until no source is above its cap. Then
each document is taken a whole number of times, and a fraction of the documents of
a source once more: those that come first in a seeded hash order, up to the words
that are missing. The order is cut with sums over hash buckets, so that only one
bucket of each source is ever sorted, and no source meets in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import read_table, save, sized, words_of

MAX_EPOCHS, SEED, BUCKETS = 3.0, 20_240_917, 4_096
CYCLE = (1.0, 2.0, 3.0)
_HASHES = 1 << 62


def n_words(text: str) -> Column:
    return F.size(words_of(text)).cast("long")


def targets(sources: DataFrame, total: float | None = None, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """Adds ``target`` to rows of (source, source_size, weight); one row a source.

    ``total`` defaults to the sum of all sizes. A source without words gets 0; if all
    caps together are below the total, every source gets its cap.
    """
    cap = F.col("source_size") * F.lit(float(max_epochs))
    if total is None:
        total = float(sources.agg(F.sum("source_size")).first()[0] or 0)
    level = 0.0
    while True:  # the level only rises; a round that clamps no further source is the last
        clamped = cap <= F.col("weight") * F.lit(level)
        row = sources.agg(F.sum(F.when(clamped, cap)).alias("full"), F.sum(F.when(~clamped, F.col("weight"))).alias("weight"), F.count(F.when(~clamped, 1)).alias("n")).first()
        if not row["n"]:
            level = float("inf")
            break
        new = max(0.0, total - (row["full"] or 0.0)) / row["weight"]
        if new <= level or not sources.filter((~clamped) & (cap <= F.col("weight") * F.lit(new))).limit(1).count():
            level = max(level, new)
            break
        level = new
    share = F.least(cap, F.col("weight") * F.lit(level)) if level != float("inf") else cap
    return sources.withColumn("target", F.when(F.col("source_size") > 0, share).otherwise(F.lit(0.0)))


def cycled_weights(sources: DataFrame, cycle: tuple = CYCLE) -> DataFrame:
    """Weights that repeat ``cycle`` over the sources in code-point order, null last. One row a source is ordered here, not a document."""
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    return sources.withColumn("weight", F.element_at(F.array(*map(F.lit, cycle)), ((rank - 1) % len(cycle) + 1).cast("int")))


def mix(docs: DataFrame, weights: DataFrame | None = None, max_epochs: float = MAX_EPOCHS, seed: int = SEED, carry: tuple = (), id_col: str = "doc_id") -> DataFrame:
    """One row a document: doc_id, source, size, source_size, target, repeats, taken, and the columns in ``carry``.

    ``weights``: rows of (source, weight); default the repeating cycle. size is the
    number of words; null text has none. Null is a source of its own. Documents that
    share an id are separate rows; equal rows may swap their repeats, which changes
    nothing. A document without words is repeated as its source's whole epochs, at
    least once if its source's share is above nothing, and adds no words. An empty
    table gives no rows.
    """
    hashed = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("size"), F.col("source")).bitwiseAND(F.lit(_HASHES - 1))
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), "source", n_words("text").alias("size"), *carry).withColumn("order", hashed).withColumn("bucket", F.shiftright("order", 50).cast("int"))
    base = save(base, "mix-docs")
    by_bucket = save(base.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size")), "mix-buckets")
    sources = save(by_bucket.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), "mix-sources")
    if weights is None:
        sources = cycled_weights(sources)
    else:
        sources = sources.alias("s").join(weights.alias("w"), F.col("s.source").eqNullSafe(F.col("w.source")), "left").select("s.source", "source_size", F.coalesce(F.col("weight").cast("double"), F.lit(0.0)).alias("weight"))
    sources = save(targets(save(sources, "mix-weights"), max_epochs=max_epochs), "mix-targets")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    sources = sources.withColumn("whole", F.floor(rate + F.lit(1e-12)).cast("long")).withColumn("rest", F.greatest(F.lit(0.0), F.col("target") - F.col("whole") * F.col("source_size"))).withColumnRenamed("source", "s_source")
    sources = save(sources, "mix-rates")

    # the bucket in which the missing words end, for each source: at most BUCKETS rows a source are ordered
    before = F.coalesce(F.sum("bucket_size").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ends = (
        by_bucket.withColumn("before", before)
        .join(sized(sources), F.col("source").eqNullSafe(F.col("s_source")))
        .filter((F.col("before") <= F.col("rest")) & (F.col("before") + F.col("bucket_size") > F.col("rest")))
        .select("s_source", F.col("bucket").alias("cut"), (F.col("rest") - F.col("before")).alias("room"))
    )
    ends = save(ends, "mix-cuts")
    sources = save(sources.alias("s").join(sized(ends).alias("e"), F.col("s.s_source").eqNullSafe(F.col("e.s_source")), "left").select("s.*", "cut", "room"), "mix-plan")

    rows = base.join(sized(sources), F.col("source").eqNullSafe(F.col("s_source")))
    inner = rows.filter(F.col("bucket") == F.col("cut"))
    outer = rows.filter(F.col("cut").isNull() | (F.col("bucket") != F.col("cut"))).withColumn("extra", (F.col("rest") > 0) & (F.col("cut").isNull() | (F.col("bucket") < F.col("cut"))))
    ordered = Window.partitionBy("source", "bucket").orderBy("order", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    passed = F.coalesce(F.sum("size").over(ordered), F.lit(0))
    # the document in which the words end is taken if that comes nearer than leaving it
    inner = inner.withColumn("extra", (F.col("rest") > 0) & (passed + F.col("size") / F.lit(2.0) <= F.col("room")))
    repeats = F.col("whole") + F.when(F.col("extra"), F.lit(1)).otherwise(F.lit(0))
    return outer.unionByName(inner).select("doc_id", "source", "size", "source_size", "target", repeats.alias("repeats"), (F.col("size") * repeats).alias("taken"), *carry)


def repeat_documents(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with each row as often as ``mix`` takes it: repeats are repeated rows. Ids may repeat or be null, as every row carries its own plan; rows taken no time are left out."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    mixed = mix(docs.withColumn("_mixed_row", row), carry=("_mixed_row",), **options).filter(F.col("repeats") > 0)
    return mixed.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("repeats").cast("int")))).select("_mixed_row.*")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed with weights 1, 2, 3, repeating over the sources."""
    return mix(read_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def mixing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every source's size and target, to thousandths, as the mix of all documents has them."""
    mixed = mix(read_table(spark, sf_dir, "documents"))
    return mixed.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("size").alias("size"), F.max("source_size").alias("source_size"), F.round(F.max("target"), 3).alias("target"))


TARGETS_SQL = r"""
WITH d AS (SELECT source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
s AS (SELECT source, count(*) AS n_docs, CAST(sum(size) AS BIGINT) AS size FROM d GROUP BY source),
w AS (SELECT *, 3.0::DOUBLE * size AS cap, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS weight, CAST(sum(size) OVER () AS DOUBLE) AS total FROM s),
o AS (SELECT *, cap / weight AS ratio, coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS full_before, sum(weight) OVER (ORDER BY cap / weight DESC, source DESC NULLS FIRST ROWS UNBOUNDED PRECEDING) AS weight_from FROM w),
l AS (SELECT arg_min((total - full_before) / weight_from, ratio) FILTER ((total - full_before) / weight_from <= ratio) AS level FROM o)
SELECT source, n_docs, size, size AS source_size, round(CASE WHEN size > 0 THEN least(cap, weight * level) ELSE 0 END, 3) AS target FROM o, l
"""
