"""A corpus from raw documents to packed token sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame: the columns of
documents, but for the last, which returns the packed pieces. run() writes each
stage's result to the shared folder and reads it back as the next one's input.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandwise.llm import langid, mixing, near_copies, packing, pii, simhash
from strandwise.llm._common import read_table, save_only


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is clear, with that language; learned from the given languages of four fifths of them.

    Texts that are null or have no letter, and exact ties, are rejected. Rows with one
    id are judged each; other columns stay as they are, whatever their names. No row, or none with a language, gives no rows.
    """
    model = langid.train(docs.filter(langid.fold(5) != 0))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), "text")
    judged = langid.identify(rows, model).filter("accepted")
    return judged.select(*[F.col("lang_pred").alias(c) if c == "lang" else F.col("_row")[c].alias(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (5-word shingles, similarity 0.8 or more): the one with the smallest id.

    Texts without a word are one group. Null ids come last; equal rows are one
    document, of which the first by a digest of its columns stays. No row gives none.
    """
    return simhash.keep_first(docs, near_copies.near_copies(docs))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data in their texts replaced by its kind; n_chars follows. Null texts stay null, repeated rows and empty tables stay as they are."""
    redacted = pii.redact(docs)
    return redacted.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else redacted


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target weight asks for; repeats are repeated rows. Null is a source of its own, and rows that share an id are repeated each. No row gives none."""
    return mixing.repeat_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 4096 tokens. Null and empty texts are their end alone; every row is packed; no row gives none."""
    return packing.pack(docs)


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("pii", personal_data), ("mixing", mix_sources), ("packing", pack_sequences)]

#: SQL can't express compression, fingerprints, hash sampling or tokenizers: the stages are tested against plain versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents; a stage's own tables go when its result is written."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = save_only(spark, f"stage-{name}", partial(stage, spark, docs, sf_dir))
    return docs
