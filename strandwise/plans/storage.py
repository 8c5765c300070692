"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder only where none is set and the session is local."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            return current.get().rstrip("/")
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="strandwise-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _at_exit(spark: SparkSession, path: str) -> None:
    try:
        if spark.sparkContext._jsc is not None:
            delete(spark, path)
    except Exception:  # noqa: BLE001 - the session may have ended
        return


def spread(df: DataFrame, bytes_a_task: int = 16 << 20) -> DataFrame:
    """``df``, dealt evenly to all cores if it is small and comes in few partitions; large tables are left as they are read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(2 * cores) if size <= cores * bytes_a_task and df.rdd.getNumPartitions() < 2 * cores else df


_paths: list[str] = []


def materialise(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Writes ``df`` once and reads it back, so that what follows neither recomputes it nor sees other partition bounds."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _paths.append(path)
    atexit.register(_at_exit, spark, path)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def materialise_compact(df: DataFrame, name: str) -> DataFrame:
    """The same for very many rows of longs: differences in as few bits as they take."""
    return materialise(df, name, **{"compression": "zstd", "parquet.writer.version": "v2", "parquet.enable.dictionary": "false"})


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffled files of plans that are done with; it does so when the driver's memory is collected, which a driver with little to do puts off."""
    spark.sparkContext._jvm.System.gc()


def scratch(spark: SparkSession, name: str, make: Callable[[], DataFrame], **options: str) -> DataFrame:
    """Materialises what ``make`` returns and deletes the tables that were written on the way to it."""
    start = len(_paths)
    out = materialise(make(), name, **options)
    for path in _paths[start:-1]:
        delete(spark, path)
    del _paths[start:-1]
    return out
