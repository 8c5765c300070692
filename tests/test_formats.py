"""The formats fasta and gsa: byte ranges, columns asked for, commits and aborts."""

import pytest
from pyspark.sql import functions as F

from strandwise.operators.suffix_array import gsa
from strandwise.sources import formats, readers


def rows(df):
    return sorted(tuple(r) for r in df.collect())


TEXT = ">one\r\nAC\r\nGT\r\n\n>two\n>\nA>é\n\n>long\n" + "ACGT\n" * 30 + "T"
WANTED = [("one", "ACGT"), ("two", ""), ("", "A>é"), ("long", "ACGT" * 30 + "T")]


@pytest.mark.parametrize("size", [1, 7, 16, 1 << 20])
def test_byte_ranges(spark, tmp_path, size):
    (tmp_path / "a.fa").write_bytes(TEXT.encode())
    (tmp_path / "b.fa").write_bytes(b"")
    (tmp_path / "c.fa").write_bytes(b">last")
    found = formats.read_fasta(spark, f"file://{tmp_path}", size)
    assert rows(found) == [(k + 1, *x) for k, x in enumerate([*WANTED, ("last", "")])]
    assert rows(readers.fasta(spark, f"file://{tmp_path}/a.fa")) == rows(formats.read_fasta(spark, f"file://{tmp_path}/a.fa", size))


def test_columns_and_lines_without_header(spark, tmp_path):
    formats.register(spark)
    (tmp_path / "a.fa").write_bytes(b"\nAC\nGT\n>x\nT\n")
    read = lambda schema: spark.read.format("fasta").schema(schema).option("partitionBytes", 3)
    assert rows(read("start long").load(str(tmp_path / "a.fa"))) == [(1,), (7,)]
    assert [tuple(r) for r in read("text string, header string").load(str(tmp_path / "a.fa")).collect()] == [("ACGT", None), ("T", "x")]
    (tmp_path / "e.fa").write_bytes(b"")
    assert formats.read_fasta(spark, str(tmp_path / "e.fa")).count() == 0


def test_fasta_written(spark, docs_of, tmp_path):
    formats.register(spark)
    docs = docs_of([(1, "é" * 200), (2, ""), (3, "b" * 80)]).select(F.col("doc").cast("string").alias("header"), "text").coalesce(1)
    path = f"file://{tmp_path}/f"
    for mode, times in (("append", 1), ("append", 2), ("overwrite", 1)):
        docs.write.format("fasta").option("width", 7).mode(mode).save(path)
        assert [tuple(r)[1:] for r in formats.read_fasta(spark, path, 50).orderBy("doc").collect()] == [tuple(r) for r in docs.collect()] * times
    with pytest.raises(Exception, match="mark"):
        docs.withColumn("text", F.lit("a>b")).write.format("fasta").mode("append").save(path)
    assert formats.read_fasta(spark, path).count() == 3


def test_records_written(spark, docs_of, tmp_path):
    formats.register(spark)
    array, path = gsa(docs_of(["banana" * 20, "", "ban"])), f"file://{tmp_path}/g"
    formats.ordered(array).write.format("gsa").mode("append").save(path)
    read = lambda schema="rnk long, idx long, doc long": spark.read.format("gsa").schema(schema).option("partitionBytes", 24)
    assert rows(read().load(path)) == rows(array.select("rnk", "idx", "doc"))
    assert rows(read("doc long, rnk long").load(path)) == rows(array.select("doc", "rnk"))
    with pytest.raises(Exception, match="appended"):
        array.write.format("gsa").mode("append").save(path)
    names = sorted(p.name for p in (tmp_path / "g").iterdir())
    late = array.repartition(3).withColumn("idx", F.when(F.col("rnk") == 50, F.lit(1 << 33)).otherwise(F.col("idx")))
    with pytest.raises(Exception, match="32 bits"):
        late.write.format("gsa").mode("overwrite").save(path)
    assert rows(read().load(path)) == rows(array.select("rnk", "idx", "doc"))
    assert set(names) <= {p.name for p in (tmp_path / "g").iterdir()}
    formats.ordered(array.filter("rnk < 5")).write.format("gsa").mode("overwrite").save(path)
    assert read().load(path).count() == 5 and not {p.name for p in (tmp_path / "g").iterdir()} & (set(names) - {formats.MANIFEST})
