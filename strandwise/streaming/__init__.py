"""Statistics of a collection that is still arriving."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def symbol_counts(texts: DataFrame) -> DataFrame:
    """(symbol, n) of a stream of (text), in update or complete mode."""
    return texts.select(F.explode(F.split("text", "")).alias("symbol")).filter("symbol <> ''").groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))


def match_stream(reference: DataFrame, texts: DataFrame, sink) -> object:
    """Starts matching a stream of (doc, text) against a fixed reference, whose suffix array is made once; ``sink`` gets each batch's matches and its number."""
    from ..operators import routed

    index = routed.build(reference)
    return texts.writeStream.foreachBatch(lambda batch, epoch: sink(routed.matching_statistics(index, batch), epoch)).start()
