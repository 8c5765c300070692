"""FASTA and suffix-array records as formats of Spark's readers and writers.

    formats.register(spark)
    spark.read.format("fasta").load(path)                       # file, start, header, text
    spark.read.format("fasta").schema("header string").load(path)  # texts are skipped, not kept
    formats.ordered(array).write.format("gsa").mode("append").save(path)
    spark.read.format("gsa").load(path)                         # rnk, idx, doc

Files are read by byte ranges (option ``partitionBytes``) on every store that Arrow opens by
its URI, and nothing passes through the driver. A task writes one file under a name of
its own; the commit lists the files of all tasks in the order of partitions in a
manifest, written last, and only what it lists is read. So neither a task that ran twice
nor one that failed leaves anything to be seen, and a store needs no renames.
"""

from __future__ import annotations

import io
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from .writers import RECORD

MANIFEST = "_manifest.json"
PARTITION_BYTES, BATCH_BYTES, BATCH_ROWS = 32 << 20, 8 << 20, 100_000


def _open(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    store, at = pyarrow.fs.FileSystem.from_uri(path)
    return store, at.rstrip("/")


def _listed(store: pyarrow.fs.FileSystem, folder: str) -> list[str] | None:
    """Names in a folder's manifest; None without one."""
    path = f"{folder}/{MANIFEST}"
    if store.get_file_info(path).type == pyarrow.fs.FileType.NotFound:
        return None
    with store.open_input_stream(path) as f:
        return json.loads(f.read())["files"]


def files(path: str) -> list[tuple[str, int]]:
    """(path in its store, bytes) of a file, or of a folder's: those in its manifest, else all but hidden ones, by name."""
    store, at = _open(path)
    info = store.get_file_info(at)
    if info.type == pyarrow.fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.is_file:
        return [(at, info.size)]
    names = _listed(store, at)
    if names is not None:
        found = store.get_file_info([f"{at}/{n}" for n in names])
    else:
        found = sorted((x for x in store.get_file_info(pyarrow.fs.FileSelector(at)) if x.is_file and not x.base_name.startswith(("_", "."))), key=lambda x: x.path)
    return [(x.path, x.size) for x in found]


@dataclass
class Range(InputPartition):
    """Bytes of one file, and how many bytes of the table are in files before it."""

    file: str
    begin: int
    end: int
    before: int


class _Reader(DataSourceReader):
    unit = 1

    def __init__(self, options: dict, schema):
        self.path, self.names = options["path"], schema.names
        self.schema = schema
        self.step = max(1, int(options.get("partitionBytes", PARTITION_BYTES)) // self.unit) * self.unit

    def partitions(self) -> list[Range]:
        out, before = [], 0
        for file, size in files(self.path):
            out += [Range(file, a, min(a + self.step, size), before) for a in range(0, size, self.step)]
            before += size
        return out or [Range("", 0, 0, 0)]

    def batch(self, columns: dict[str, pa.Array]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([columns[n] for n in self.names], names=self.names)


class FastaReader(_Reader):
    """Records whose header begins in the range; their lines may go on behind it. Line ends and blank lines are left out."""

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if partition.file:
            store = _open(self.path)[0]
            with io.BufferedReader(store.open_input_file(partition.file), 1 << 20) as f:
                yield from self.batches(partition.file, self.records(f, partition.begin, partition.end))

    def records(self, f: io.BufferedReader, begin: int, end: int) -> Iterator[tuple[int, bytes | None, bytes]]:
        """(start, header, text); lines before a file's first header are a record without one."""
        texts, held = "text" in self.names, None
        f.seek(max(0, begin - 1))
        at = begin - 1 + len(f.readline()) if begin else 0
        while (at < end or held is not None) and (line := f.readline()):
            start, body = at, line.rstrip(b"\r\n")
            at += len(line)
            if line[:1] == b">":
                if held is not None:
                    yield held[0], held[1], b"".join(held[2])
                held = (start, body[1:], []) if start < end else None
                if held is None:
                    return
            elif body:
                if held is None and begin == 0 and start < end:
                    held = (start, None, [])
                if held is not None and texts:
                    held[2].append(body)
        if held is not None:
            yield held[0], held[1], b"".join(held[2])

    def batches(self, file: str, records: Iterator) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0

        def full() -> pa.RecordBatch:
            starts, headers, texts = zip(*rows)
            decoded = lambda x: None if x is None else x.decode("utf-8", "replace")
            return self.batch({"file": pa.array([file] * len(rows)), "start": pa.array(starts, pa.int64()), "header": pa.array(map(decoded, headers), pa.string()), "text": pa.array(map(decoded, texts), pa.string())})

        for row in records:
            rows.append(row)
            size += len(row[2])
            if size >= BATCH_BYTES or len(rows) >= BATCH_ROWS:
                yield full()
                rows, size = [], 0
        if rows:
            yield full()


class GsaReader(_Reader):
    """8-byte records; a row's rank is its place in all files."""

    unit = RECORD.itemsize

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.file:
            return
        with _open(self.path)[0].open_input_file(partition.file) as f:
            for at in range(partition.begin, partition.end, BATCH_ROWS * self.unit):
                f.seek(at)
                held = np.frombuffer(f.read(min(BATCH_ROWS * self.unit, partition.end - at)), RECORD)
                first = (partition.before + at) // self.unit
                yield self.batch({"rnk": pa.array(first + np.arange(len(held))), "idx": pa.array(held["idx"].astype(np.int64)), "doc": pa.array(held["doc"].astype(np.int64))})


@dataclass
class Written(WriterCommitMessage):
    part: int
    name: str


class _Writer(DataSourceArrowWriter):
    """One file a task, listed by the commit."""

    suffix, appends = "", True

    def __init__(self, options: dict, schema, overwrite: bool):
        self.path, self.overwrite, self.schema = options["path"], overwrite, schema
        self.width = int(options.get("width", 80))
        store, at = _open(self.path)
        old = _listed(store, at)
        self.old = old or []
        if old is not None and not overwrite and not self.appends:
            raise ValueError(f"{self.path} holds an array already; ranks can't be appended")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        name = f"part-{part:06d}-{uuid.uuid4().hex}{self.suffix}"
        store, at = _open(self.path)
        store.create_dir(at, recursive=True)
        with store.open_output_stream(f"{at}/{name}") as f:
            for batch in iterator:
                f.write(self.encoded(batch))
        return Written(part, name)

    def commit(self, messages: list[Written | None]) -> None:
        store, at = _open(self.path)
        names = [m.name for m in sorted((m for m in messages if m is not None), key=lambda m: m.part)]
        store.create_dir(at, recursive=True)
        with store.open_output_stream(f"{at}/{MANIFEST}") as f:
            f.write(json.dumps({"files": names if self.overwrite else self.old + names}).encode())
        if self.overwrite:
            for name in self.old:
                store.delete_file(f"{at}/{name}")

    def abort(self, messages: list[Written | None]) -> None:
        store, at = _open(self.path)
        for m in messages:
            if m is not None:
                store.delete_file(f"{at}/{m.name}")


class FastaWriter(_Writer):
    """(header, text) as records in lines of ``width`` symbols; nulls are empty, and what FASTA reads as a line's end or header is refused."""

    suffix = ".fa"

    def encoded(self, batch: pa.RecordBatch) -> bytes:
        lines = []
        for header, text in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("header", "text"))):
            header, text = header or "", text or ""
            if "\n" in header or "\r" in header or "\n" in text or "\r" in text or ">" in text:
                raise ValueError("a record holds a line end or a mark")
            lines += [">" + header, *(text[a : a + self.width] for a in range(0, len(text), self.width))]
        return "".join(x + "\n" for x in lines).encode("utf-8")


class GsaWriter(_Writer):
    suffix, appends = ".gsa", False

    def encoded(self, batch: pa.RecordBatch) -> bytes:
        idx, doc = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("idx", "doc"))
        if len(idx) and not (0 <= idx.min() and idx.max() < 1 << 32 and -(1 << 31) <= doc.min() and doc.max() < 1 << 31):
            raise ValueError("a place or document does not fit 32 bits; write Parquet instead")
        out = np.empty(len(idx), RECORD)
        out["idx"], out["doc"] = idx, doc
        return out.tobytes()


class FastaSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fasta"

    def schema(self) -> str:
        return "file string, start long, header string, text string"

    def reader(self, schema) -> FastaReader:
        return FastaReader(self.options, schema)

    def writer(self, schema, overwrite: bool) -> FastaWriter:
        return FastaWriter(self.options, schema, overwrite)


class GsaSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "gsa"

    def schema(self) -> str:
        return "rnk long, idx long, doc long"

    def reader(self, schema) -> GsaReader:
        return GsaReader(self.options, schema)

    def writer(self, schema, overwrite: bool) -> GsaWriter:
        return GsaWriter(self.options, schema, overwrite)


def register(spark: SparkSession) -> None:
    """Makes ``format("fasta")`` and ``format("gsa")`` known to the session."""
    for source in (FastaSource, GsaSource):
        spark.dataSource.register(source)


def ordered(array: DataFrame) -> DataFrame:
    """(rnk, idx, doc) in rank order over partitions, as the format ``gsa`` writes it."""
    return array.select("rnk", "idx", "doc").repartitionByRange("rnk").sortWithinPartitions("rnk")


def read_fasta(spark: SparkSession, path: str, partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """(doc, header, text), records numbered from 1 in the order of files and places.

    A first read without texts counts the records of each range; the second numbers
    them. Texts are never shuffled.
    """
    register(spark)
    read = lambda schema: spark.read.format("fasta").schema(schema).option("partitionBytes", partition_bytes).load(path)
    counts = read("start long").groupBy(F.spark_partition_id().alias("part")).agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect()
    before, offsets = 0, []
    for r in counts:  # a row a range
        offsets.append((r["part"], before))
        before += r["n"]
    known = spark.createDataFrame(offsets, "_part int, _before long")
    place = F.monotonically_increasing_id()
    rows = read("header string, text string").select(F.shiftright(place, 33).cast("int").alias("_part"), place.bitwiseAND(F.lit((1 << 33) - 1)).alias("_place"), "header", "text")
    return rows.join(F.broadcast(known), "_part").select((F.col("_before") + F.col("_place") + 1).alias("doc"), "header", "text")
