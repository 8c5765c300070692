"""Rows that move packed: one Spark row is what a task has for a partition, its columns of bytes compressed."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def _planes(values: np.ndarray) -> np.ndarray:
    """Differences of longs, a row for each of their bytes."""
    return np.diff(values, prepend=0).astype("<i8").view(np.uint8).reshape(-1, 8).T


def pack(part: np.ndarray, docs: np.ndarray, idx: np.ndarray, more: np.ndarray) -> pa.RecordBatch:
    """(part, n, packed) of rows: two longs, of which the differences are small, and a row of bytes each."""
    order = np.argsort(part.astype(np.uint16) if part.max(initial=0) < 1 << 16 else part, kind="stable")
    part, docs, idx, more = part[order], docs[order], idx[order], np.take(more, order, axis=0)
    begins = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else np.empty(0, np.int64)
    ends, codec, packed = np.append(begins[1:], len(part)), pa.Codec("zstd", 1), []
    for a, b in zip(begins.tolist(), ends.tolist()):
        held = b"".join(np.ascontiguousarray(x).tobytes() for x in (_planes(docs[a:b]), _planes(idx[a:b]), more[a:b].T))
        packed.append(codec.compress(held, asbytes=True))
    return pa.RecordBatch.from_arrays([pa.array(part[begins].astype(np.int32)), pa.array((ends - begins).astype(np.int32)), pa.array(packed, pa.binary())], names=["part", "n", "packed"])


def longs(rows: np.ndarray) -> np.ndarray:
    """Rows of eight bytes, the least first, as longs."""
    return np.ascontiguousarray(rows).view("<i8")[:, 0].astype(np.int64)


def unpack(batches: Iterator[pa.RecordBatch], size: int) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """(part, docs, idx, more) of all rows of a partition; ``size``: bytes of a row of ``more``."""
    held, part = [], 0
    for batch in batches:
        names = batch.schema.names
        for p, n, packed in zip(*(batch.column(names.index(c)) for c in ("part", "n", "packed"))):
            held.append((n.as_py(), packed.as_buffer()))
            part = p.as_py()
    total, at, codec = sum(n for n, _ in held), 0, pa.Codec("zstd", 1)
    docs, idx, more = np.empty(total, np.int64), np.empty(total, np.int64), np.empty((total, size), np.uint8)
    for n, packed in held:
        planes = np.frombuffer(codec.decompress(packed, n * (16 + size)), np.uint8).reshape(16 + size, n)
        docs[at : at + n], idx[at : at + n], more[at : at + n] = np.cumsum(longs(planes[:8].T)), np.cumsum(longs(planes[8:16].T)), planes[16:].T
        at += n
    return part, docs, idx, more
