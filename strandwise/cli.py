"""python -m strandwise.cli [-p SYMBOLS] [-t TASKS] [-o OUTPUT] LIST: suffix array of a collection.

LIST is a file of two lines, the paths of a reference and of a collection.
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .model import limit_symbols, require_rows
from .operators.matching import matching_statistics, parse_stats
from .operators.suffix_array import gsa
from .sources import readers, writers


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("list", help="file with the reference's and the collection's path")
    p.add_argument("-p", "--prefix", type=int, help="take only so many symbols of the collection")
    p.add_argument("-t", "--tasks", type=int, help="local tasks at a time; default: Spark's own setting")
    p.add_argument("-o", "--output", help="output path; default: the list's path and .gsa")
    p.add_argument("--parquet", action="store_true", help="write Parquet instead of 8-byte records")
    p.add_argument("--stats", action="store_true", help="also print how the reference covers the collection")
    return p


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> str:
    args = parser().parse_args(arguments)
    if spark is None:
        builder = SparkSession.builder.appName("strandwise")
        spark = (builder.master(f"local[{args.tasks}]") if args.tasks else builder).getOrCreate()
    reference_path, collection_path = readers.path_list(spark, args.list)
    reference = require_rows(readers.read_reference(spark, reference_path), "reference")
    docs = require_rows(readers.read_collection(spark, collection_path), "collection")
    docs = limit_symbols(docs, args.prefix) if args.prefix else docs
    path = writers.output_path(args.list, args.output)
    array = gsa(docs)
    if args.parquet:
        writers.write_gsa(array, path)
    else:
        writers.write_gsa_records(array, path)
    if args.stats:
        parse_stats(matching_statistics(reference, docs, augment=True, heads_only=True)).orderBy("doc").show(50)
    return path


if __name__ == "__main__":
    main()
