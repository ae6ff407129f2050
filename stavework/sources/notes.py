"""The driver's events read as notes of works (movement, voice, position)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """work_id, composer, stratum, movement_idx, voice_id, pos, midi, quarter_length,
    offset, gap_before, bar_remaining, from_chord; one exchange by work and voice.

    The composer (nation) and the stratum (region) come from two small dimensions,
    which Spark broadcasts if their size allows.
    """
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value", "props")
    places = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")
    k = F.get_json_object("props", "$.k").cast("int")
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    level = F.floor("value") % 4
    keyed = e.select(
        F.col("user_id").alias("work_id"),
        F.when(F.col("ts") < F.lit("2024-01-16").cast("date"), 0).otherwise(1).alias("movement_idx"),
        (F.col("event_id") % 2).cast("int").alias("voice_id"),
        (60 + k % 5).cast("int").alias("midi"),
        F.when(level < 2, 0.5).when(level == 2, 1.0).otherwise(2.0).alias("quarter_length"),
        (F.floor((seconds - 1704067200) / 1800) * 0.5).alias("offset"),
        seconds.alias("at"),
        "event_id",
    )
    order = Window.partitionBy("work_id", "movement_idx", "voice_id").orderBy("at", "event_id")
    placed = keyed.withColumn("pos", F.row_number().over(order)).withColumn("before", F.lag("at").over(order))
    placed = placed.withColumn("gap_before", F.greatest(F.lit(0.0), F.coalesce((F.col("at") - F.col("before")) / 3600 - 72, F.lit(0.0))))
    joined = placed.join(places, F.col("work_id") % 25 == F.col("n_nationkey"))
    return joined.select(
        "work_id", F.col("n_name").alias("composer"), F.col("r_name").alias("stratum"), "movement_idx", "voice_id", "pos", "midi", "quarter_length", "offset", "gap_before", (4 - F.col("offset") % 4).alias("bar_remaining"), F.lit(0).alias("from_chord")
    )


NOTES_SQL = """
raw AS (SELECT event_id, user_id AS work_id, CASE WHEN ts < TIMESTAMP '2024-01-16' THEN 0 ELSE 1 END AS mov, event_id % 2 AS voice, epoch_us(ts) / 1e6 AS secs,
    60 + CAST(json_extract_string(props, '$.k') AS INT) % 5 AS midi, CASE WHEN floor(value) % 4 < 2 THEN 0.5::DOUBLE WHEN floor(value) % 4 = 2 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS ql FROM events),
notes AS (SELECT work_id, n_name AS composer, r_name AS stratum, mov, voice, midi, ql, floor((secs - 1704067200) / 1800) * 0.5::DOUBLE AS off, row_number() OVER p AS pos,
    greatest(0, coalesce((secs - lag(secs) OVER p) / 3600 - 72, 0)) AS gap FROM raw JOIN nation ON n_nationkey = work_id % 25 JOIN region ON r_regionkey = n_regionkey
    WINDOW p AS (PARTITION BY work_id, mov, voice ORDER BY secs, event_id)),
cuts AS (SELECT *, sum(CASE WHEN gap > 1e-6 THEN 1 ELSE 0 END) OVER (PARTITION BY work_id, mov, voice ORDER BY pos) AS seg FROM notes),
segs AS (SELECT *, 4 - off % 4 AS bar_rem, count(*) OVER (PARTITION BY work_id, mov, voice, seg) AS seg_len FROM cuts),
long AS (SELECT * FROM segs WHERE seg_len >= 4)"""
