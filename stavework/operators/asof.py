"""Backward as-of joins: one sort of the union per key, no range join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof_backward(left: DataFrame, right: DataFrame, key: list[str], at: str, values: list[str], ahead: float | Column = 0) -> DataFrame:
    """Rows of ``left`` with the ``values`` of the last row of ``right`` of the same key whose
    ``at`` is not after theirs (by more than ``ahead``); null where there is none.

    Of right rows at one time the greatest by their values counts.
    """
    packed = F.struct(*values)
    r = right.groupBy(*key, F.col(at).alias("__t")).agg(F.max(packed).alias("__r")).withColumn("__side", F.lit(0))
    mine = F.struct(*[F.col(c) for c in left.columns])
    moment = F.col(at) + ahead if isinstance(ahead, Column) or ahead else F.col(at)
    rows = left.select(*key, moment.alias("__t"), mine.alias("__l")).withColumn("__side", F.lit(1))
    both = rows.unionByName(r, allowMissingColumns=True)
    w = Window.partitionBy(*key).orderBy("__t", "__side").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("__last", F.last("__r", ignorenulls=True).over(w)).where("__side = 1")
    return found.select("__l.*", *[F.col(f"__last.{c}").alias(c) for c in values])


def bar_remaining(notes: DataFrame, measures: DataFrame, part: list[str]) -> DataFrame:
    """Notes with the time left in their measure (part, offset, bar_offset, bar_length); -1 without one."""
    m = measures.select(*part, F.col("bar_offset").alias("offset"), F.col("bar_offset").alias("__from"), "bar_length")
    placed = asof_backward(notes.drop("bar_remaining"), m, part, "offset", ["__from", "bar_length"], ahead=1e-9)
    return placed.withColumn("bar_remaining", F.coalesce(F.col("__from") + F.col("bar_length") - F.col("offset"), F.lit(-1.0))).drop("__from", "bar_length")
