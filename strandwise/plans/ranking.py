"""Global order without a single task: range partitions, local positions, and offsets of the partitions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .storage import materialise

PART, POSITION = "_part", "_position"


def _offsets(df: DataFrame, total: Column) -> DataFrame:
    """Sum of ``total`` over all earlier partitions, one row a partition."""
    sums = df.groupBy(PART).agg(total.alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")
    return F.broadcast(sums.select(PART, before.alias("_offset")))


def _schema(df: DataFrame, *more: str) -> T.StructType:
    out = T.StructType(list(df.schema.fields))
    out.add(PART, T.IntegerType())
    for name in more:
        out.add(name, T.LongType())
    return out


def _sorted(df: DataFrame, keys: list[str], partitions: int | None) -> DataFrame:
    spread = df.repartitionByRange(partitions, *keys) if partitions else df.repartitionByRange(*keys)
    return spread.sortWithinPartitions(*keys)


def _number(keys: list[str]):
    """Adds each row's place in its partition, and the place of the first row with equal keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, at, last, first = TaskContext.get().partitionId(), 0, None, 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            columns = [batch.column(batch.schema.get_field_index(k)) for k in keys]
            new = np.zeros(n, bool)
            for c in columns:
                nulls = c.is_null().to_numpy(zero_copy_only=False)
                new[1:] |= nulls[1:] != nulls[:-1]
                same = pa.compute.equal(c.slice(1), c.slice(0, n - 1)) if n > 1 else pa.array([], pa.bool_())
                new[1:] |= ~pa.compute.fill_null(same, True).to_numpy(zero_copy_only=False)
            head = tuple(c[0].as_py() for c in columns)
            new[0] = last is None or head != last
            places = at + np.arange(n)
            starts = np.where(new, places, -1)
            starts[0] = places[0] if new[0] else first
            starts = np.maximum.accumulate(starts)
            last, first, at = tuple(c[n - 1].as_py() for c in columns), int(starts[-1]), at + n
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, part, np.int32)), pa.array(places), pa.array(starts)], names=[*batch.schema.names, PART, POSITION, "_first"])

    return run


def global_rank(df: DataFrame, keys: list[str], row: str | None = None, rank: str | None = None, partitions: int | None = None) -> DataFrame:
    """Adds ``row``, the 0-based place in the order of ``keys``, and ``rank``, the place of the first row with equal keys.

    Range partitioning keeps equal keys together; a key that very many rows share is
    one task's work, so put a tie-breaking column last if there is one.
    """
    import pyarrow.compute  # noqa: F401 - loaded before the function is sent

    placed = materialise(_sorted(df, keys, partitions).mapInArrow(_number(keys), _schema(df, POSITION, "_first")), "ranked")
    out = placed.join(_offsets(placed, F.count(F.lit(1))), PART)
    added = {name: F.col("_offset") + F.col(local) for name, local in ((row, POSITION), (rank, "_first")) if name}
    return out.withColumns(added).select(*df.columns, *added)


def _split_number(keys: list[str], carry: list[str]):
    """(*carry, _part, _position, _first, _near, *keys): place in the partition, that of the first row with equal keys, and whether a neighbour there has them; keys of a partition's first and last row only."""

    def columns(batch: pa.RecordBatch, names: list[str]) -> list[pa.Array]:
        return [batch.column(batch.schema.get_field_index(c)) for c in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, at, last, first, held = TaskContext.get().partitionId(), 0, None, 0, None

        def out(batch: pa.RecordBatch, places: np.ndarray, starts: np.ndarray, new: np.ndarray, joined: bool, ends: bool) -> pa.RecordBatch:
            n = batch.num_rows
            near = ~new
            near[:-1] |= ~new[1:]
            near[-1] |= joined
            shown = places == 0
            shown[-1] |= ends
            take = pa.array(np.where(shown, np.arange(n), 0), mask=~shown)
            return pa.RecordBatch.from_arrays([*columns(batch, carry), pa.array(np.full(n, part, np.int32)), pa.array(places), pa.array(starts), pa.array(near), *[c.take(take) for c in columns(batch, keys)]], names=[*carry, PART, POSITION, "_first", "_near", *keys])

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            new = np.zeros(n, bool)
            for c in columns(batch, keys):
                new[1:] |= ~pa.compute.equal(c.slice(1), c.slice(0, n - 1)).to_numpy(zero_copy_only=False) if n > 1 else False
            head = tuple(c[0].as_py() for c in columns(batch, keys))
            new[0] = head != last
            if held is not None:
                yield out(*held, not new[0], False)
            places = at + np.arange(n)
            starts = np.where(new, places, -1)
            starts[0] = places[0] if new[0] else first
            starts = np.maximum.accumulate(starts)
            held = (batch, places, starts, new)
            last, first, at = tuple(c[n - 1].as_py() for c in columns(batch, keys)), int(starts[-1]), at + n
        if held is not None:
            yield out(*held, False, True)

    return run


def rank_split(df: DataFrame, keys: list[str], within: list[str]) -> DataFrame:
    """(*within, rank, tied): the place of the first row with equal ``keys`` in their order, and whether another row has them.

    Rows are sorted by ranges of keys and ``within``, so rows of one key may lie in any
    number of tasks. Keys are never null.
    """
    import pyarrow.compute  # noqa: F401 - loaded before the function is sent

    kinds = {f.name: f for f in df.schema}
    schema = T.StructType([kinds[c] for c in within] + _SPLIT + [kinds[c] for c in keys])
    return join_ranges(materialise(_sorted(df, [*keys, *within], None).mapInArrow(_split_number(keys, within), schema), "split-ranked"), keys, within)


_SPLIT = [T.StructField(PART, T.IntegerType()), T.StructField(POSITION, T.LongType()), T.StructField("_first", T.LongType()), T.StructField("_near", T.BooleanType())]


def join_ranges(placed: DataFrame, keys: list[str], within: list[str]) -> DataFrame:
    """(*within, rank, tied) from rows numbered in their range: (*within, _part, _position, _first, _near, *keys), keys in a range's first and last row.

    These, two rows a range, are put together on the driver: where a range begins in the
    order of all, and where a key goes on from one range to the next.
    """
    ends = placed.filter(F.col(keys[0]).isNotNull()).select(PART, POSITION, "_first", *keys).orderBy(PART, POSITION).collect()
    parts: dict[int, list] = {}
    for r in ends:
        parts.setdefault(r[0], []).append(r)
    table, offset, last, start = [], 0, None, 0
    for part, rows in sorted(parts.items()):
        head, tail = rows[0], rows[-1]
        joins = last == tuple(head[3:])
        if table and joins:
            table[-1][4] = True
        first = start if joins else offset
        table.append([part, offset, first if joins else None, tail[2], False])
        start = first if tail[2] == 0 else offset + tail[2]
        last, offset = tuple(tail[3:]), offset + tail[1] + 1
    known = F.broadcast(placed.sparkSession.createDataFrame([tuple(x) for x in table], f"{PART} int, _offset long, _carried long, _tail long, _goes_on boolean"))
    carried = (F.col("_first") == 0) & F.col("_carried").isNotNull()
    rank = F.when(carried, F.col("_carried")).otherwise(F.col("_offset") + F.col("_first"))
    tied = F.col("_near") | carried | (F.col("_goes_on") & (F.col("_first") == F.col("_tail")))
    return placed.join(known, PART).select(*within, rank.alias("rank"), tied.alias("tied"))


def running_total(df: DataFrame, keys: list[str], value: str, into: str) -> DataFrame:
    """Adds the sum of ``value`` over all earlier rows in the order of ``keys``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, total = TaskContext.get().partitionId(), 0
        for batch in batches:
            values = batch.column(batch.schema.get_field_index(value)).to_numpy(zero_copy_only=False).astype(np.int64)
            ends = total + np.cumsum(values)
            total = int(ends[-1]) if len(ends) else total
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(values), part, np.int32)), pa.array(ends - values)], names=[*batch.schema.names, PART, POSITION])

    placed = materialise(_sorted(df, keys, None).mapInArrow(run, _schema(df, POSITION)), "totals")
    return placed.join(_offsets(placed, F.sum(value)), PART).withColumn(into, F.col("_offset") + F.col(POSITION)).select(*df.columns, into)


def _carry_on(group: str, mark: str, held: list[str]):
    """Replaces ``held`` of every row by those of the last marked row of its group so far; adds _part, _position, and whether the group may have had one before the range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, at, first, last = TaskContext.get().partitionId(), 0, None, None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            table = pa.Table.from_batches([batch])
            if first is None:
                first = table[group][0].as_py()
            if last is not None:
                table = pa.concat_tables([last, table])
            groups, marks = table[group].to_numpy(), table[mark].to_numpy(zero_copy_only=False).astype(bool)
            place = np.maximum.accumulate(np.where(marks, np.arange(len(marks)), -1))
            known = (place >= 0) & (groups[np.maximum(place, 0)] == groups)
            taken = pa.array(np.maximum(place, 0), mask=~known)
            if place[-1] >= 0:
                keep = table.slice(int(place[-1]), 1)
            skip = len(marks) - n
            own = table.slice(skip)
            columns = [table[c].take(taken).slice(skip).combine_chunks() if c in held else own[c].combine_chunks() for c in table.schema.names]
            columns = [c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in columns]
            before = (groups == first) & ~known
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.full(n, part, np.int32)), pa.array(at + np.arange(n)), pa.array(before[skip:])], names=[*table.schema.names, PART, POSITION, "_before"])
            at += n
            if place[-1] >= 0:
                last = keep

    return run


def last_marked(df: DataFrame, group: str, order: list[str], mark: str, held: list[str]) -> DataFrame:
    """``df`` with ``held`` of the last marked row of the same group, up to each row itself, in the order of (group, *order); nulls if there is none.

    Rows are sorted by ranges, so a group of any size may lie in any number of tasks. A
    range's last marked row, one a range, is handed on through the driver. Groups are longs.
    """
    placed = df.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in df.schema] + [T.StructField(PART, T.IntegerType()), T.StructField(POSITION, T.LongType()), T.StructField("_before", T.BooleanType())])
    placed = materialise(placed.mapInArrow(_carry_on(group, mark, held), schema), "carried")
    parts = placed.select(PART).distinct().orderBy(PART).collect()
    ends = {r[PART]: r["e"] for r in placed.filter(mark).groupBy(PART).agg(F.max_by(F.struct(group, *held), POSITION).alias("e")).collect()}
    rows, known = [], None
    for p in parts:
        rows.append((p[PART], *(known if known is not None else [None] * (1 + len(held)))))
        known = ends.get(p[PART], known)
    kinds = {f.name: f for f in df.schema}
    given = df.sparkSession.createDataFrame(rows, T.StructType([T.StructField(PART, T.IntegerType()), T.StructField("_group", T.LongType())] + [T.StructField(f"_{c}", kinds[c].dataType) for c in held]))
    out = placed.join(F.broadcast(given), PART)
    use = F.col("_before") & F.coalesce(F.col("_group") == F.col(group), F.lit(False))
    return out.select(*[F.when(use, F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in held else F.col(c) for c in df.columns])
