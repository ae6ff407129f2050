"""Sessionising notes into segments, and windows of symbols over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stavework.functions.symbols import TOL, iv_symbol, ivr_symbol, rhythm_class

VOICE = ("work_id", "movement_idx", "voice_id")
SEGMENT = (*VOICE, "seg")


def segments(notes: DataFrame, rest_break: float = 0.0, min_len: int = 4) -> DataFrame:
    """Notes of maximal runs without a rest longer than ``rest_break``; shorter runs go.

    Adds seg, seg_pos and seg_len. All windows share the exchange by voice.
    """
    order = Window.partitionBy(*VOICE).orderBy("pos")
    cut = F.when(F.col("gap_before") > rest_break + TOL, 1).otherwise(0)
    inside = Window.partitionBy(*SEGMENT)
    out = notes.withColumn("seg", F.sum(cut).over(order)).withColumn("seg_len", F.count("*").over(inside)).where(F.col("seg_len") >= min_len)
    return out.withColumn("seg_pos", F.row_number().over(inside.orderBy("pos")))


def bass_voices(notes: DataFrame) -> DataFrame:
    """(work_id, movement_idx, bass): lowest median pitch where there are two voices or more; ties: the lower voice."""
    medians = notes.groupBy(*VOICE).agg(F.median("midi").alias("m"))
    return medians.groupBy("work_id", "movement_idx").agg(F.min_by("voice_id", F.struct("m", "voice_id")).alias("bass"), F.count("*").alias("voices")).where("voices > 1").drop("voices")


def symbol_arrays(segs: DataFrame) -> DataFrame:
    """One row per segment: arrays iv and ivr of its symbols in order."""
    inside = Window.partitionBy(*SEGMENT).orderBy("pos")
    step = F.lead("midi").over(inside) - F.col("midi")
    beat = rhythm_class(F.col("quarter_length"), F.lead("quarter_length").over(inside))
    s = segs.withColumn("iv", iv_symbol(step)).withColumn("ivr", ivr_symbol(step, beat)).where("iv is not null")
    rows = s.groupBy("composer", "stratum", *SEGMENT).agg(F.array_sort(F.collect_list(F.struct("pos", "iv", "ivr"))).alias("s"))
    return rows.select("composer", "stratum", *SEGMENT, F.col("s.iv").alias("iv"), F.col("s.ivr").alias("ivr"))


def ngrams(arrays: DataFrame, column: str, sizes: list[int]) -> DataFrame:
    """(composer, stratum, work_id, n, gram) for every window of n notes (n - 1 symbols),
    all sizes in one pass over the segment arrays, no exchange."""
    each = arrays.select("composer", "stratum", "work_id", F.col(column).alias("s"), F.explode(F.array(*map(F.lit, sizes))).alias("n")).where(F.size("s") >= F.col("n") - 1)
    return each.select("composer", "stratum", "work_id", "n", F.explode(F.expr("transform(sequence(1, size(s) - n + 2), i -> slice(s, i, n - 1))")).alias("gram"))


def symbol_windows(arrays: DataFrame, column: str, m: int) -> DataFrame:
    """(composer, stratum, work_id, movement_idx, voice_id, seg, pos, query): every window of m
    symbols with its place (from 1) in its segment; no exchange."""
    each = arrays.select("composer", "stratum", *SEGMENT, F.col(column).alias("s")).where(F.size("s") >= m)
    starts = each.select("composer", "stratum", *SEGMENT, F.posexplode(F.expr(f"transform(sequence(1, size(s) - {m} + 1), i -> slice(s, i, {m}))")).alias("p", "query"))
    return starts.select("composer", "stratum", *SEGMENT, (F.col("p") + 1).alias("pos"), "query")


def padded_windows(rows: DataFrame, key: str, column: str, length: int = 32, step: int = 8, pad: int = 48, start: int = 50) -> DataFrame:
    """(key, k, tokens, mask): training windows of ``length`` tokens every ``step``, the sequence led
    by ``start`` and the last ones filled up with ``pad`` (mask 0). An empty sequence gives one window."""
    led = rows.select(key, F.concat(F.array(F.lit(start)), F.coalesce(F.col(column), F.array().cast("array<int>"))).alias("s"))
    cut = led.select(key, F.posexplode(F.expr(f"transform(sequence(0, greatest(size(s) - {length}, 0), {step}), i -> slice(s, i + 1, {length}))")).alias("k", "w"))
    fill = F.lit(length) - F.size("w")
    return cut.select(key, "k", F.concat("w", F.array_repeat(F.lit(pad), fill)).alias("tokens"), F.concat(F.array_repeat(F.lit(1), F.size("w")), F.array_repeat(F.lit(0), fill)).alias("mask"))
