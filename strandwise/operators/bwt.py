"""Burrows-Wheeler transforms of documents, their samples and their inverse. Each document stays in the task that reads it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels
from ..plans.storage import spread
from .suffix_array import _BATCH, _each


def _text(symbols: np.ndarray) -> str:
    return symbols.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")


def bwt(docs: DataFrame) -> DataFrame:
    """(doc, transform, primary): one row a document. primary is the rank of the whole text plus one; 0 for an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [kernels.bwt(kernels.code_points(t)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([_text(x) for x, _ in found], pa.string()), pa.array([p for _, p in found], pa.int64())], names=["doc", "transform", "primary"])

    return spread(docs.select("doc", "text")).mapInArrow(run, "doc long, transform string, primary long")


def bwt_rows(docs: DataFrame) -> DataFrame:
    """(doc, rnk, symbol): the symbol before each suffix in order; null where the suffix is the whole text."""

    def kernel(symbols):
        order = kernels.suffix_array(symbols)
        chars = np.array(list(_text(symbols)), dtype=object) if len(symbols) else np.array([], object)
        before = chars[order - 1] if len(order) else chars
        before[order == 0] = None
        return np.arange(len(order)), before

    return spread(docs.select("doc", "text")).mapInArrow(_each(kernel, ["rnk", "symbol"]), "doc long, rnk long, symbol string")


def samples(docs: DataFrame, rate: int) -> DataFrame:
    """(doc, t, isa): rank plus one of every ``rate``-th suffix. ``rate`` is a power of two of at least 2."""
    _check(rate)

    def kernel(symbols):
        ranks = kernels.invert(kernels.suffix_array(symbols))[::rate]
        return np.arange(len(ranks)), ranks + 1

    return spread(docs.select("doc", "text")).mapInArrow(_each(kernel, ["t", "isa"]), "doc long, t long, isa long")


def _check(rate: int) -> None:
    if rate < 2 or rate & (rate - 1):
        raise ValueError(f"sampling rate {rate} is not a power of two of at least 2")


def lf_mapping(transforms: DataFrame) -> DataFrame:
    """(doc, row, lf): for each place of a transform, the place of the same occurrence among the sorted symbols."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, transform in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                lf = kernels.lf_mapping(kernels.code_points(transform))
                for at in range(0, len(lf), _BATCH):
                    n = len(lf[at : at + _BATCH])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, doc)), pa.array(np.arange(at, at + n)), pa.array(lf[at : at + n])], names=["doc", "row", "lf"])

    return transforms.select("doc", "transform").mapInArrow(run, "doc long, row long, lf long")


def inverse(transforms: DataFrame) -> DataFrame:
    """(doc, text) of (doc, transform, primary). A primary index out of range is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [_text(kernels.inverse_bwt(kernels.code_points(t), p)) for t, p in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc", "text"])

    return transforms.select("doc", "transform", "primary").mapInArrow(run, "doc long, text string")


def inverse_blocks(transforms: DataFrame, sampled: DataFrame, rate: int) -> DataFrame:
    """(doc, t, block) of transforms and their samples: blocks of ``rate`` symbols decoded from their own sample.

    The samples of a document walk side by side, one step of all of them at a time.
    """
    _check(rate)

    def run(key: tuple, rows: pd.DataFrame, starts: pd.DataFrame) -> pd.DataFrame:
        out = []
        starts = starts.sort_values("t")
        for transform, primary in zip(rows["transform"], rows["primary"]):
            symbols = kernels.code_points(transform)
            n = len(symbols)
            at = starts["isa"].to_numpy(np.int64)
            if n and (len(at) != -(-n // rate) or at.min() < 1 or at.max() > n):
                raise ValueError("a sample is not within the transform")
            place = np.arange(n)
            step = np.empty(n + 1, np.int64)
            step[kernels.lf_mapping(symbols) + 1] = np.where(place < primary, place, place + 1)
            step[0] = primary
            sorted_ = np.concatenate(([0], np.sort(symbols, kind="stable")))
            columns = np.empty((len(at), rate), np.int64)
            for k in range(rate):
                columns[:, k] = sorted_[at]
                at = step[at]
            for t in range(len(columns)):
                out.append((key[0], t, _text(columns[t, : min(rate, n - t * rate)])))
        return pd.DataFrame(out, columns=["doc", "t", "block"])

    return transforms.groupBy("doc").cogroup(sampled.groupBy("doc")).applyInPandas(run, "doc long, t long, block string")


def join_blocks(blocks: DataFrame) -> DataFrame:
    """(doc, text): the blocks of each document in order."""
    held = F.array_sort(F.collect_list(F.struct("t", "block")))
    return blocks.groupBy("doc").agg(F.array_join(F.transform(held, lambda x: x["block"]), "").alias("text"))
