import struct

import pytest

from strandwise import cli
from strandwise.operators.suffix_array import gsa
from strandwise.sources import readers, writers


def put(path, text):
    path.write_bytes(text.encode())
    return f"file://{path}"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_fasta(spark, tmp_path):
    path = put(tmp_path / "a.fa", ">one\nAC\nGT\n\n>two\n>three\nA")
    assert rows(readers.fasta(spark, path)) == [(1, "one", "ACGT"), (2, "two", ""), (3, "three", "A")]
    assert rows(readers.fasta_reference(spark, path)) == [(0, "ACGTA")]
    assert readers.is_fasta(spark, path)


def test_blank_lines_can_end_records(spark, tmp_path):
    path = put(tmp_path / "a.fa", ">one\nAC\n\nGT\n")
    assert [r[2] for r in rows(readers.fasta(spark, path, blank_ends_record=True))] == ["AC", "GT"]


def test_raw(spark, tmp_path):
    assert rows(readers.raw_reference(spark, put(tmp_path / "r", "banana$\n\n"))) == [(0, "banana")]
    assert rows(readers.raw_collection(spark, put(tmp_path / "c", "ab\x02\x02cd\x02"))) == [(1, "ab"), (2, ""), (3, "cd")]
    assert not readers.is_fasta(spark, f"file://{tmp_path / 'r'}")


def test_path_list(spark, tmp_path):
    assert readers.path_list(spark, put(tmp_path / "l", "x\ny")) == ("x", "y")
    with pytest.raises(ValueError):
        readers.path_list(spark, put(tmp_path / "m", "x\n"))


def test_fasta_round_trip(spark, docs_of, tmp_path):
    docs = docs_of([(1, "a" * 200), (2, ""), (3, "b" * 80)])
    writers.write_fasta(docs, f"file://{tmp_path}/f")
    assert rows(readers.fasta(spark, f"file://{tmp_path}/f").select("doc", "text")) == rows(docs)


def test_records(spark, docs_of, tmp_path):
    array = gsa(docs_of([(1, "banana"), (2, "ban")]))
    path = f"file://{tmp_path}/x.gsa"
    assert writers.write_gsa_records(array, path) == 72
    held = struct.unpack("<" + "Ii" * 9, (tmp_path / "x.gsa").read_bytes())
    assert list(zip(held[::2], held[1::2])) == [(r["idx"], r["doc"]) for r in array.orderBy("rnk").collect()]
    assert rows(writers.read_gsa_records(spark, path)) == rows(array)


def test_command_line(spark, tmp_path):
    put(tmp_path / "r", "banana")
    put(tmp_path / "c.fa", ">x\nban\n>y\nana\n")
    given = tmp_path / "list"
    put(given, f"file://{tmp_path}/r\nfile://{tmp_path}/c.fa\n")
    out = cli.main([f"file://{given}", "-p", "5", "--stats"], spark)
    assert out == f"file://{given}.gsa"
    assert (tmp_path / "list.gsa").stat().st_size == 40
    assert writers.output_path("a", "b") == "b"


def test_streams(spark, docs_of, tmp_path):
    from strandwise import streaming

    docs_of(["aab", "b"]).write.parquet(f"{tmp_path}/s")
    stream = spark.readStream.schema("doc long, text string").parquet(f"{tmp_path}/s")
    q = streaming.symbol_counts(stream).writeStream.outputMode("complete").format("memory").queryName("counts").start()
    q.processAllAvailable()
    q.stop()
    assert rows(spark.table("counts")) == [("a", 2), ("b", 2)]
    seen = []
    q = streaming.match_stream(docs_of(["ab"]), stream, lambda df, epoch: seen.extend(df.collect()))
    q.processAllAvailable()
    q.stop()
    assert len(seen) == 4


def test_records_are_in_the_order_of_files(spark, tmp_path):
    """Small files first by name, a large one later: Spark reads the large one first."""
    texts = ["a", "bc", "x" * 50, "y" * 5000, "z" * 200_000, "q"]
    for k, t in enumerate(texts):
        (tmp_path / f"{k}.fa").write_text(f">h{k}\n" + "\n".join(t[i : i + 70] for i in range(0, len(t), 70)) + "\n")
    found = sorted((r["doc"], r["header"], r["text"]) for r in readers.fasta(spark, f"file://{tmp_path}").collect())
    assert found == [(k + 1, f"h{k}", t) for k, t in enumerate(texts)]
    assert readers.fasta_reference(spark, f"file://{tmp_path}").first()["text"] == "".join(texts)


def test_raw_documents_of_a_split_file(spark, tmp_path):
    texts = [f"{i}" * (i % 50) for i in range(3000)]
    (tmp_path / "c.raw").write_text("\x02".join(texts) + "\x02")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        found = sorted(map(tuple, readers.raw_collection(spark, f"file://{tmp_path}/c.raw").collect()))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert found == [(i + 1, t) for i, t in enumerate(texts)]
