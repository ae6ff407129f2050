"""Stored tables: note caches, count tables by order, results, logs; written once, read with pruning."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_made: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in ``spark.checkpoint.dir``; a temporary one where it
    is unset and the master is local."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = f"file://{tempfile.mkdtemp(prefix='stavework-')}"
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that is deleted when the driver's process ends."""
    path = f"{shared_folder(spark)}/stavework-{uuid.uuid4().hex}-{name}"
    _made.append((spark, path))
    return path


def discard(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder that nothing reads any more."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    _made.remove((spark, path))


@atexit.register
def _sweep() -> None:
    for spark, path in _made:
        try:
            target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # the JVM may be gone already; the folder belongs to this run only
            return


def store(rows: DataFrame, path: str, by: tuple[str, ...] = (), mode: str = "overwrite", plain: bool = False) -> DataFrame:
    """Write compressed Parquet, one folder per value of ``by``, and read it back. ``plain``:
    neither compressed nor coded, for numbers that are packed already."""
    writer = rows.write.mode(mode).option("compression", "none" if plain else "zstd").option("parquet.enable.dictionary", not plain)
    (writer.partitionBy(*by) if by else writer).parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path).select(*rows.columns)


def merged(rows: DataFrame) -> DataFrame:
    """Rows to join by sorting. Spark plans by the size of stored files, which compress a
    hundredfold, so it would send whole models to the driver to broadcast them."""
    return rows.hint("merge")


def load_counts(spark: SparkSession, path: str, orders: tuple[int, ...] | None = None, stratum: str | None = None) -> DataFrame:
    """The stored counts; orders (column n) and a stratum are pruned by folder."""
    rows = spark.read.parquet(path)
    if stratum is not None:
        rows = rows.where(F.col("stratum") == stratum)
    return rows if orders is None else rows.where(F.col("n").isin(*orders))


def load_work(spark: SparkSession, path: str, work_id) -> DataFrame:
    """The cached notes of one work, in order; no rows if it is not there. ``bar_remaining``
    is -1 in caches that do not hold it."""
    rows = spark.read.parquet(path)
    if "bar_remaining" not in rows.columns:
        rows = rows.withColumn("bar_remaining", F.lit(-1.0))
    return rows.where(F.col("work_id") == F.lit(work_id)).orderBy("pos")


def load_catalog(catalog: DataFrame, in_analysis: bool = True, primary_only: bool = True, exclude_target: bool = False) -> DataFrame:
    """One row per work: the attributes of its first unit in file order (file_order) and its units
    in that order. The flags are filters on the scan."""
    rows = catalog
    if in_analysis:
        rows = rows.where("in_analysis = 1")
    if primary_only:
        rows = rows.where("is_primary = 1")
    if exclude_target:
        rows = rows.where("is_target = 0")
    rest = [c for c in rows.columns if c not in ("work_id", "unit_id", "file_order")]
    units = F.transform(F.array_sort(F.collect_list(F.struct("file_order", "unit_id"))), lambda x: x.unit_id)
    first = F.min_by(F.struct(*rest), F.struct("file_order", "unit_id")).alias("first")
    return rows.groupBy("work_id").agg(first, units.alias("units")).select("work_id", *[f"first.{c}" for c in rest], "units")


def with_notes(works: DataFrame, notes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(notes of the catalogue's works with their attributes, works without any notes)."""
    return notes.join(works, "work_id"), works.join(notes.select("work_id").distinct(), "work_id", "left_anti")


def union_stratum(counts: DataFrame, names: tuple[str, ...], to: str) -> DataFrame:
    """Counts with a further stratum that holds those of several others."""
    more = counts.where(F.col("stratum").isin(*names)).withColumn("stratum", F.lit(to))
    return counts.unionByName(more)


def merge_log(old: DataFrame, new: DataFrame, key: str = "unit_id", status: str = "status", cached: str = "cached") -> DataFrame:
    """A log after a resumed run: new rows replace old ones, but a row that only says the unit
    was there already does not replace what is known of it."""
    fresh = new.where(F.col(status) != cached)
    seen = new.where(F.col(status) == cached)
    kept = old.join(fresh.select(key), key, "left_anti")
    return fresh.unionByName(kept).unionByName(seen.join(old.select(key), key, "left_anti"))


def pending(jobs: DataFrame, log: DataFrame, only: str | None = None, retry_failed: bool = False, limit: int | None = None, key: str = "unit_id") -> DataFrame:
    """Jobs still to run: those without a row in the log, with ``retry_failed`` those that failed;
    ``only``: a prefix of the key, ``limit``: the first jobs of that order."""
    rows = jobs.join(log.where("status = 'fail'").select(key), key, "left_semi") if retry_failed else jobs.join(log.select(key), key, "left_anti")
    if only:
        rows = rows.where(F.startswith(F.col(key), F.lit(only)))
    return rows.orderBy(key).limit(limit) if limit is not None else rows


def read_results(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Stored JSON results, one document per file."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def report(rows: DataFrame, columns: list[str], order: list[Column], title: str | None = None) -> DataFrame:
    """(line_no, line): a Markdown table of a small result in the given order."""
    cells = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("–")) for c in columns]), F.lit(" |"))
    head = ([title, ""] if title else []) + [f"| {' | '.join(columns)} |", f"|{'---|' * len(columns)}"]
    top = rows.sparkSession.createDataFrame([(i - len(head), x) for i, x in enumerate(head)], "line_no int, line string")
    w = Window.partitionBy(F.lit(1)).orderBy(*order)  # a report: as many rows as it has lines
    return top.unionByName(rows.select((F.row_number().over(w) - 1).alias("line_no"), cells.alias("line")))


def append_report(lines: DataFrame, path: str) -> None:
    lines.orderBy("line_no").select("line").coalesce(1).write.mode("append").text(path)
