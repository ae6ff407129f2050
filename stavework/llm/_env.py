"""Shared storage, lineage cuts and batch helpers of the training-data operators.

Intermediate tables go to the folder that the cluster names in
``spark.checkpoint.dir``; executors may be lost at any time after that without
recomputation from unstable state. A folder of our own is chosen only where
that setting is unset (tests, local mode).
"""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BATCH_ROWS = 2000
_live: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the session; a local one where none is set and the master is local."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = f"file://{tempfile.mkdtemp(prefix='stavework-')}"
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _sweep() -> None:
    for path, spark in list(_live.items()):
        try:
            _delete(spark, path)
        except Exception:  # the JVM may be gone already; the folder belongs to this run only
            return


class Table:
    """A table written to the shared folder: ``df()`` reads it, ``drop()`` deletes it."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType):
        self.spark, self.path, self.schema = spark, path, schema

    def df(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)  # an empty partitioned table has no files

    def drop(self) -> None:
        _live.pop(self.path, None)
        _delete(self.spark, self.path)


def write_table(df: DataFrame, name: str, *, partition_by: list[str] | None = None) -> Table:
    """Write ``df`` to the shared folder; it is deleted when the driver's process ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stavework-{uuid.uuid4().hex}-{name}"
    _live[path] = spark
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return Table(spark, path, df.schema)


def drop(*tables: Table) -> None:
    """Delete tables that nothing reads any more."""
    for t in tables:
        t.drop()


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark delete shuffle files whose results have been written to a table."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def input_splits(df: DataFrame) -> int:
    """Partitions of a scan: proportional to its bytes, so a measure of input size."""
    return max(1, df.rdd.getNumPartitions())


def trim_memory() -> None:
    """Give freed memory of this worker back to the machine (where the C library can): workers
    are used again by other stages."""
    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        return


@lru_cache(maxsize=1)
def lean_memory() -> None:
    """Let this worker give large arrays back as soon as they are freed (where the C library can)."""
    try:
        libc = ctypes.CDLL("libc.so.6")
        libc.mallopt(-3, 1 << 20)  # blocks from this size on are mapped by themselves
        libc.mallopt(-1, 4 << 20)  # as much may stay free at the top of the heap
    except (OSError, AttributeError):
        return


def folded(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus`` (the fold of a row)."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(modulus)


def project(df: DataFrame, **columns: str | Column) -> DataFrame:
    """Only the named columns, under our own names: extra columns never clash.

    Texts may be long, so Python gets batches of fewer rows than Spark's default. This
    lowers a setting of the session, which results that are read later still need.
    """
    spark = df.sparkSession
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return df.select(*[(F.col(f"`{c}`") if isinstance(c, str) else c).alias(k) for k, c in columns.items()])
