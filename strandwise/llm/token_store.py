"""Token-id files: Parquet lists of token ids in document order, read selectively.

Documents are dealt by ranges of their id and sorted, so the files in name order
hold all documents in ascending order. Each row has the document's id, its number
of tokens, the ids of the same file before it, and its ids as a list column. List
values are dictionary-encoded (few distinct ids a row group), lengths and starts
delta-encoded; row groups and pages are of set sizes and Parquet's page indexes
let a reader fetch the pages of a few documents, or the metadata columns alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import tokens
from ._common import new_path, read_table, save, sized

ROW_GROUP_BYTES, PAGE_BYTES, PAGE_ROWS = 32 << 20, 64 << 10, 2_000
_FLUSH_IDS = 400_000
#: Words whose ids a worker keeps, twice as many as where other stages share its memory.
_CACHE_WORDS = 600_000
SCHEMA = "doc_id long, part int, start_in_part long, n_tokens int, ids array<int>"


def _rows(part: int, held: list, start: int) -> pa.RecordBatch:
    lengths = np.array([len(ids) for _, ids in held], dtype=np.int64)
    starts = start + np.concatenate(([0], np.cumsum(lengths)[:-1]))
    offsets = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
    values = np.concatenate([ids for _, ids in held]).astype(np.int32)
    return pa.RecordBatch.from_arrays(
        [pa.array([d for d, _ in held], pa.int64()), pa.array(np.full(len(held), part, np.int32)), pa.array(starts.astype(np.int64)), pa.array(lengths.astype(np.int32)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))],
        names=["doc_id", "part", "start_in_part", "n_tokens", "ids"],
    )


def _encode(vocabulary: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, encoder, held, size, start = TaskContext.get().partitionId(), tokens.encoder(vocabulary, _CACHE_WORDS), [], 0, 0
        for doc, ids in encoder.encode_rows(batches, end_id):
            held.append((doc, ids))
            size += len(ids)
            if size >= _FLUSH_IDS:
                yield _rows(part, held, start)
                start, held, size = start + size, [], 0
        if held:
            yield _rows(part, held, start)

    return run


def write_tokens(docs: DataFrame, path: str, vocabulary: str | None = None, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encodes every document and writes the token files to ``path``.

    Null text is empty (its row holds the end id alone); a null id sorts first;
    rows that share an id are kept, ordered by text. An empty table writes no row.
    Columns besides the two named are not read.
    """
    (
        docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
        .repartitionByRange(F.col("doc_id").asc_nulls_first())
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
        .mapInArrow(_encode(vocabulary or tokens.default_vocabulary(), end_id), SCHEMA)
        .write.options(
            **{
                "compression": "zstd",
                "parquet.writer.version": "PARQUET_2_0",
                "parquet.block.size": str(ROW_GROUP_BYTES),
                "parquet.page.size": str(PAGE_BYTES),
                "parquet.page.row.count.limit": str(PAGE_ROWS),
                "parquet.enable.dictionary": "false",
                "parquet.enable.dictionary#ids.list.element": "true",
            }
        )
        .parquet(path)
    )


def read_tokens(spark: SparkSession, path: str, columns: list[str] | None = None, first_id: int | None = None, last_id: int | None = None) -> DataFrame:
    """Rows of the token files; id bounds are pushed to row groups and pages, and only ``columns`` are read."""
    df = spark.read.schema(SCHEMA).parquet(path)
    if first_id is not None:
        df = df.filter(F.col("doc_id") >= first_id)
    if last_id is not None:
        df = df.filter(F.col("doc_id") <= last_id)
    return df.select(*columns) if columns else df


def with_starts(df: DataFrame, metadata: DataFrame) -> DataFrame:
    """Adds ``start``: the ids of all documents before. ``metadata``: part and n_tokens of all rows (its columns alone are read).

    The table of parts has one row a file; it is broadcast if it is small, and else joined.
    """
    parts = metadata.groupBy("part").agg(F.sum(F.col("n_tokens").cast("long")).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = save(parts.select("part", before.alias("part_start")), "part-starts")
    return df.join(sized(first), "part").withColumn("start", F.col("part_start") + F.col("start_in_part"))


def _checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(batch.schema.get_field_index("ids"))
        values, offsets = lists.values.to_numpy(), lists.offsets.to_numpy()
        sums = [tokens.crc32(values[a:b]) for a, b in zip(offsets[:-1], offsets[1:])]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(np.diff(offsets).astype(np.int64)), pa.array(sums, pa.int64())], names=["doc_id", "part", "start_in_part", "n_tokens", "ids_crc32"])


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded, written and read back: id, start, number of ids and checksum of the ids read."""
    path = new_path(spark, "token-files")
    write_tokens(read_table(spark, sf_dir, "documents"), path)
    back = read_tokens(spark, path).mapInArrow(_checksums, "doc_id long, part int, start_in_part long, n_tokens long, ids_crc32 long")
    return with_starts(back, read_tokens(spark, path, ["part", "n_tokens"])).select("doc_id", "start", "n_tokens", "ids_crc32")
