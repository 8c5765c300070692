"""The engine's input: relations of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sequences(df: DataFrame, doc: str | Column = "doc", text: str | Column = "text") -> DataFrame:
    """(doc, text) from any table. Null texts become empty; doc is a long."""
    doc, text = (F.col(x) if isinstance(x, str) else x for x in (doc, text))
    return df.select(doc.cast("long").alias("doc"), F.coalesce(text.cast("string"), F.lit("")).alias("text"))


def require_rows(df: DataFrame, what: str) -> DataFrame:
    """``df``, unless it is empty or all its texts are."""
    if df.filter(F.length("text") > 0).limit(1).count() == 0:
        raise ValueError(f"the {what} is empty")
    return df


def limit_symbols(docs: DataFrame, symbols: int) -> DataFrame:
    """The first ``symbols`` symbols of the collection in document order; the last document may be cut.

    Lengths are summed over ranges of documents, and only the totals of the ranges are
    ordered in one place.
    """
    from .plans.ranking import running_total

    lengths = running_total(docs.select("doc", F.length("text").cast("long").alias("n")), ["doc"], "n", "before")
    left = F.lit(symbols) - F.col("before")
    kept = lengths.filter(left > 0).select(F.col("doc").alias("_doc"), left.alias("left"))
    cut = F.when(F.col("left") < F.length("text"), F.substring("text", F.lit(1), F.col("left").cast("int"))).otherwise(F.col("text"))
    return docs.join(kept, F.col("doc") == F.col("_doc")).select("doc", cut.alias("text"))
