"""Running sums over a whole table without a single-task window.

Rows are cut into ranges of one ordering column by its approximate quantiles (one row,
broadcast), summed per range, and only inside a range is there a window. Equal values
share a range, so any finer order may follow the column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranged(rows: DataFrame, by: Column, ranges: int = 64) -> DataFrame:
    """Adds ``__range``: how many of the quantiles of the number ``by`` lie below it (null: 0)."""
    shares = F.array(*[F.lit(k / ranges) for k in range(1, ranges)])
    cuts = rows.agg(F.percentile_approx(by.cast("double"), shares, F.lit(50 * ranges)).alias("__cuts"))
    key = by.cast("double")
    return rows.crossJoin(F.broadcast(cuts)).withColumn("__range", F.coalesce(F.size(F.filter("__cuts", lambda c: c < key)), F.lit(0))).drop("__cuts")


def running(rows: DataFrame, by: Column, order: list[Column], sums: dict[str, Column], ranges: int = 64, descending: bool = False) -> DataFrame:
    """Adds running sums (``name``: expression, the row itself included) in the order of
    ``by``, then ``order``; descending turns the order of ``by`` round."""
    cut = ranged(rows, by, ranges).withColumns({f"__v_{n}": F.coalesce(e.cast("double"), F.lit(0.0)) for n, e in sums.items()})
    per = cut.groupBy("__range").agg(*[F.sum(f"__v_{n}").alias(f"__t_{n}") for n in sums])
    # as many rows as ranges
    before = Window.partitionBy(F.lit(1)).orderBy(F.desc("__range") if descending else F.asc("__range")).rowsBetween(Window.unboundedPreceding, -1)
    starts = per.select(F.col("__range").alias("__r"), *[F.coalesce(F.sum(f"__t_{n}").over(before), F.lit(0.0)).alias(f"__b_{n}") for n in sums])
    inside = Window.partitionBy("__range").orderBy(by.desc() if descending else by.asc(), *order).rowsBetween(Window.unboundedPreceding, 0)
    joined = cut.join(F.broadcast(starts), F.col("__range") == F.col("__r")).withColumns({n: F.col(f"__b_{n}") + F.sum(f"__v_{n}").over(inside) for n in sums})
    return joined.drop("__range", "__r", *[f"__{k}_{n}" for n in sums for k in "vb"])
