"""Suffix arrays as files: Parquet, or 8-byte records."""

from __future__ import annotations

import itertools
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.ranking import running_total
from ..plans.storage import materialise

#: Records read or joined at a time.
_RECORDS = 200_000
#: One record: place in the document, then document, both 32 bits, little-endian; rows in rank order.
RECORD = np.dtype([("idx", "<u4"), ("doc", "<i4")])


def output_path(collection: str, given: str | None = None) -> str:
    """Where the array of a collection goes if no path is given."""
    return given or f"{collection}.gsa"


def write_gsa(array: DataFrame, path: str) -> None:
    """(rnk, idx, doc) as Parquet, files and rows in rank order."""
    array.repartitionByRange("rnk").sortWithinPartitions("rnk").write.parquet(path)


def records(array: DataFrame) -> DataFrame:
    """(part, data): packed records, one row a few thousand of them, parts and rows in rank order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        for k, batch in enumerate(batches):
            idx, doc = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            if len(idx) and (idx.max() >= 1 << 32 or not -(1 << 31) <= doc.min() <= doc.max() < 1 << 31):
                raise ValueError("a place or document does not fit 32 bits; write Parquet instead")
            out = np.empty(len(idx), RECORD)
            out["idx"], out["doc"] = idx, doc
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([k], pa.int32()), pa.array([out.tobytes()], pa.binary())], names=["part", "k", "data"])

    return array.repartitionByRange("rnk").sortWithinPartitions("rnk").select("idx", "doc").mapInArrow(run, "part int, k int, data binary")


def _mounted(path: str) -> str | None:
    """The path as tasks can open it, if it is one of a mounted file system; None for other stores."""
    scheme, colon, rest = path.partition(":")
    if not colon or "/" in scheme:
        return path
    return "/" + rest.lstrip("/") if scheme == "file" else None


def _write_at(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        with open(path, "r+b") as f:
            for batch in batches:
                for start, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                    f.seek(start)
                    n += f.write(data.as_buffer())
        yield pa.RecordBatch.from_arrays([pa.array([n])], names=["n"])

    return run


def write_gsa_records(array: DataFrame, path: str) -> int:
    """Writes one file of 8-byte records; returns the number of bytes.

    On a mounted file system every task writes its records at their place in the file,
    again if it is run again. A store that knows no places gets one stream, whose bytes
    pass through the driver a chunk at a time.
    """
    spark = array.sparkSession
    rows = materialise(records(array).withColumn("n", F.length("data").cast("long")), "records")
    placed = materialise(running_total(rows, ["part", "k"], "n", "start").select("start", "data"), "placed-records")
    total = rows.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    if mounted := _mounted(path):
        with open(mounted, "wb") as f:
            f.truncate(total)
        placed.mapInArrow(_write_at(mounted), "n long").agg(F.sum("n")).collect()
        return total
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(hadoop, True)
    try:
        for row in placed.orderBy("start").toLocalIterator():
            out.write(bytearray(row["data"]))
    finally:
        out.close()
    return total


def _unpacked(first: int, data) -> pa.RecordBatch:
    held = np.frombuffer(data, RECORD)
    return pa.RecordBatch.from_arrays([pa.array(first + np.arange(len(held))), pa.array(held["idx"].astype(np.int64)), pa.array(held["doc"].astype(np.int64))], names=["rnk", "idx", "doc"])


def _read_blocks(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with open(path, "rb") as f:
            for batch in batches:
                for k in batch.column(0).to_pylist():
                    f.seek(k * _RECORDS * RECORD.itemsize)
                    yield _unpacked(k * _RECORDS, f.read(_RECORDS * RECORD.itemsize))

    return run


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, data in zip(batch.column(0).to_pylist(), batch.column(1)):
            yield _unpacked(first, data.as_buffer())


def read_gsa_records(spark: SparkSession, path: str) -> DataFrame:
    """(rnk, idx, doc) of a file of 8-byte records, unpacked by blocks of records in parallel."""
    if mounted := _mounted(path):
        blocks = -(-os.path.getsize(mounted) // (_RECORDS * RECORD.itemsize))
        return spark.range(0, blocks, 1, max(1, min(blocks, 4 * spark.sparkContext.defaultParallelism))).mapInArrow(_read_blocks(mounted), "rnk long, idx long, doc long")

    def joined(part: int, rows: Iterator[bytes]):
        for k, chunk in enumerate(iter(lambda: b"".join(itertools.islice(rows, _RECORDS)), b"")):
            yield part, k, len(chunk) // RECORD.itemsize, bytearray(chunk)

    raw = spark.sparkContext.binaryRecords(path, RECORD.itemsize).mapPartitionsWithIndex(joined)  # a file's records, split by Spark
    rows = materialise(spark.createDataFrame(raw, "part int, k int, n long, data binary"), "record-chunks")
    return running_total(rows, ["part", "k"], "n", "first").select("first", "data").mapInArrow(_unpack, "rnk long, idx long, doc long")


def write_fasta(docs: DataFrame, path: str, width: int = 80) -> None:
    """(doc, text) as a FASTA text folder, records in document order, lines of ``width`` symbols."""
    chunks = F.regexp_replace("text", f"(?s)(.{{{width}}})(?!\\z)", "$1\n")
    lines = docs.repartitionByRange("doc").sortWithinPartitions("doc").select(F.concat(F.lit(">"), F.col("doc").cast("string"), F.when(F.length("text") > 0, F.concat(F.lit("\n"), chunks)).otherwise("")).alias("value"))
    lines.write.text(path)
