"""Connected components of a link table by alternating large-star and small-star
steps: every step is a pre-aggregated minimum per vertex and an equi-join, so a
hub with a third of all links is never gathered into one task (the minimum is
combined before the shuffle, the join may be split by AQE)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stavework.sources.tables import shared_folder


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def connected_components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(vertex, component): the smallest vertex reachable over ``links``, for every
    vertex of a link between two different vertices.

    Nulls and self-links are ignored, repeated links count once; no links give an
    empty table. Steps alternate until nothing changes; each round is checkpointed to
    the shared folder.
    """
    spark = links.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    e = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct().checkpoint()
    before = _signature(e)
    while before[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        e = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(least.select("u", F.col("m").alias("v"))).distinct().checkpoint()
        after = _signature(e)
        if after == before:
            break
        before = after
    tops = e.select(F.col("v").alias("vertex")).distinct().select("vertex", F.col("vertex").alias("component"))
    return e.select(F.col("u").alias("vertex"), F.col("v").alias("component")).unionByName(tops)
