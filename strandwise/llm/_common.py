"""What the operators of this subpackage share: the shared folder, sized joins, word expressions."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: One word: a run of characters other than space and the control characters 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Rows up to which a side of a join is sent to every executor.
BROADCAST_ROWS = 50_000
#: Rows of one key that may meet in one task; a key of more is joined where its rows lie.
HOT_ROWS = 200


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where none is set and the session is local (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            folder = current.get()
        else:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            folder = "file://" + tempfile.mkdtemp(prefix="strandwise-shared-")
            spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def hadoop_path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a table written by ``save``."""
    fs, p = hadoop_path(spark, path)
    fs.delete(p, True)


def _remove_at_exit(spark: SparkSession, path: str) -> None:
    try:
        if spark.sparkContext._jsc is not None:
            remove(spark, path)
    except Exception:  # noqa: BLE001 - the session may be gone already
        return


_paths: list[str] = []


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _paths.append(path)
    atexit.register(_remove_at_exit, spark, path)
    return path


def save(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: lineage ends here and lost executors cost nothing."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def save_only(spark: SparkSession, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """Saves what ``make`` returns and deletes the tables that were saved on the way to it."""
    start = len(_paths)
    out = save(make(), name)
    for path in _paths[start:-1]:
        remove(spark, path)
    del _paths[start:-1]
    return out


def sized(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` (already saved), marked for broadcast if it has at most ``rows`` rows; else the join shuffles."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def join_counted(rows: DataFrame, table: DataFrame, key: str, total: int) -> DataFrame:
    """``rows`` (``total`` of them) joined with ``table``: one row a key, ``n`` how many rows have it; n is left out.

    Keys of more rows than a bound are at most total / bound, and the bound grows with
    total, so their part of ``table`` never has more than BROADCAST_ROWS rows: it is
    broadcast, and their rows stay where they are. All others are dealt by key.
    """
    bound = max(HOT_ROWS, -(-total // BROADCAST_ROWS))
    hot = F.broadcast(table.filter(F.col("n") > bound))
    cold = rows.join(hot.select(key), key, "left_anti").join(table.filter(F.col("n") <= bound), key)
    return cold.unionByName(rows.join(hot, key)).drop("n")


def words_of(text: Column | str) -> Column:
    """The words of a text as an array; null text: none."""
    text = F.col(text) if isinstance(text, str) else text
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP), "")


def term_table(digits: bool) -> bytes:
    """For bytes.translate: A-Z become a-z, and what belongs to no term becomes a space. Terms are runs of letters, all that is not ASCII, and digits if wanted."""
    kept = {*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100), *(range(0x30, 0x3A) if digits else ())}
    return bytes(0x20 if b not in kept else b + 0x20 if b < 0x5B and b >= 0x41 else b for b in range(256))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def let(value: Column, body) -> Column:
    """Binds ``value`` to a lambda variable, so that it is computed once however often ``body`` names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def release() -> None:
    """Gives memory that a task no longer uses back to the system: Python workers live on and share their executor's bound."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # no such call on this system
        return


def read_table(spark: SparkSession, sf_dir: str, name: str, bytes_a_core: int = 16 << 20) -> DataFrame:
    """A table; one that comes in fewer partitions than there are cores, and is small, is dealt to all cores."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(2 * cores) if size <= cores * bytes_a_core else df
