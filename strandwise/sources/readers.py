"""Sequence files: FASTA, raw bytes, and a list of two paths.

FASTA is a splittable text format here: lines are read by Spark with their place in
the file, and a line's record is the number of headers before it, found by a running
total over ranges of lines. Nothing is read into one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.ranking import global_rank, running_total
from ..plans.storage import materialise

#: The byte that parts documents of a raw collection, and what is trimmed behind a raw reference.
SEPARATOR = "\u0002"
TRIM_END, TRIM_MARK = "\n\r\0", "$"


def path_list(spark: SparkSession, path: str) -> tuple[str, str]:
    """(reference, collection): the first two lines of a file, with or without a final newline."""
    lines = [r["value"].rstrip("\r") for r in spark.read.text(path).limit(2).collect()]
    if len(lines) < 2 or not all(lines):
        raise ValueError(f"{path} does not name a reference and a collection")
    return lines[0], lines[1]


def is_fasta(spark: SparkSession, path: str) -> bool:
    """Whether the first byte is the mark of a FASTA header."""
    head = spark.read.format("binaryFile").load(path).select(F.substring("content", 1, 1).alias("b")).limit(1).collect()
    return bool(head) and bytes(head[0]["b"]) == b">"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(k, line): lines in the order of files by path, and in file order within each; a last line without newline is a line.

    Spark packs splits into partitions by size, so a line's place is that of its file,
    then of its split in the file, then of its row among the rows of its partition.
    """
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"), F.rtrim("value", F.lit("\r")).alias("line"))
    return global_rank(materialise(rows, "rows"), ["file", "block", "row"], row="k").select("k", "line")


def fasta(spark: SparkSession, path: str, blank_ends_record: bool = False) -> DataFrame:
    """(doc, header, text) of a FASTA file, records numbered from 1, headers without their mark.

    Sequence lines of a record are joined. Lines before the first header are record 0,
    if there are any. With ``blank_ends_record`` a blank line also ends a record: what
    follows has no header.
    """
    lines = materialise(_lines(spark, path), "lines")
    head, blank = F.col("line").startswith(">"), F.col("line") == ""
    starts = (head | (blank & F.lit(blank_ends_record))).cast("long")
    numbered = running_total(lines.withColumn("starts", starts), ["k"], "starts", "before").withColumn("rec", F.col("before") + F.col("starts"))
    body = numbered.filter(~head & ~blank).groupBy("rec").agg(F.array_sort(F.collect_list(F.struct("k", "line"))).alias("l"))
    texts = body.select("rec", F.array_join(F.transform("l", lambda x: x["line"]), "").alias("text"))
    headers = numbered.filter(head).select("rec", F.expr("substring(line, 2)").alias("header"))
    if not blank_ends_record:
        return headers.join(texts, "rec", "full").select(F.col("rec").alias("doc"), "header", F.coalesce("text", F.lit("")).alias("text"))
    # blank lines leave gaps in the numbers: documents are numbered by those that have a header or text
    kept = headers.join(texts, "rec", "full").select("rec", "header", F.coalesce("text", F.lit("")).alias("text"))
    return global_rank(kept, ["rec"], row="n").select((F.col("n") + 1).alias("doc"), "header", "text")


def fasta_reference(spark: SparkSession, path: str) -> DataFrame:
    """(doc, text): all records of a FASTA file as one text, document 0."""
    records = fasta(spark, path).filter(F.length("text") > 0)
    joined = records.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc", "text"))), lambda x: x["text"]), "").alias("text"))
    return joined.select(F.lit(0).cast("long").alias("doc"), "text")


def _whole(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.col("value").alias("text"))


def raw_reference(spark: SparkSession, path: str) -> DataFrame:
    """(doc, text) of a file as it is, without line ends, zero bytes and then one mark at its end."""
    trimmed = F.regexp_replace(F.rtrim("text", F.lit(TRIM_END)), r"\$\z", "")
    return _whole(spark, path).select(F.lit(0).cast("long").alias("doc"), trimmed.alias("text"))


def raw_collection(spark: SparkSession, path: str) -> DataFrame:
    """(doc, text) of files whose documents are parted by the separator byte, numbered from 1 in the order of files; a last empty piece is none.

    The separator is the line end of a splittable read, so a file is no single row.
    """
    rows = spark.read.option("lineSep", SEPARATOR).text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"), F.col("value").alias("text"))
    return global_rank(materialise(rows, "pieces"), ["file", "block", "row"], row="k").select((F.col("k") + 1).alias("doc"), "text")


def read_reference(spark: SparkSession, path: str) -> DataFrame:
    return fasta_reference(spark, path) if is_fasta(spark, path) else raw_reference(spark, path)


def read_collection(spark: SparkSession, path: str) -> DataFrame:
    return fasta(spark, path).select("doc", "text") if is_fasta(spark, path) else raw_collection(spark, path)
