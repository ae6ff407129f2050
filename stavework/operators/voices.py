"""Voices that double another one: found by containment of their tokens, dropped in order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stavework.functions.symbols import rhythm_class


def voice_tokens(notes: DataFrame, unit: list[str], voice: str = "voice_id") -> DataFrame:
    """Distinct (offset, interval, rhythm class) of each pair of neighbouring notes of a voice."""
    w = Window.partitionBy(*unit, voice).orderBy("pos")
    step = F.lead("midi").over(w) - F.col("midi")
    beat = rhythm_class(F.col("quarter_length"), F.lead("quarter_length").over(w))
    rows = notes.select(*unit, F.col(voice).alias("voice"), F.bround("offset", 3).alias("at"), step.alias("step"), beat.alias("beat")).where("step is not null")
    return rows.distinct()


def greedy(all_voices: DataFrame, tokens: DataFrame, unit: list[str], share: float = 0.95, least: int = 4) -> DataFrame:
    """(unit, voice, kept, place): voices in order; one goes if more than ``share`` of the smaller
    side's tokens are shared with an earlier voice that stays. Both need ``least`` tokens.

    Pairs come from an equi-join on tokens; only a unit's list of voices is folded in order.
    """
    size = tokens.groupBy(*unit, "voice").agg(F.count("*").alias("n"))
    a, b = tokens.withColumnRenamed("voice", "a"), tokens.withColumnRenamed("voice", "b")
    shared = a.join(b, [*unit, "at", "step", "beat"]).where("a < b").groupBy(*unit, "a", "b").agg(F.count("*").alias("s"))
    pairs = shared.join(size.select(*unit, F.col("voice").alias("a"), F.col("n").alias("na")), [*unit, "a"]).join(size.select(*unit, F.col("voice").alias("b"), F.col("n").alias("nb")), [*unit, "b"])
    twin = pairs.where((F.least("na", "nb") >= least) & (F.col("s") / F.least("na", "nb") > share)).groupBy(*unit).agg(F.collect_list(F.struct("a", "b")).alias("twins"))
    rows = all_voices.groupBy(*unit).agg(F.array_sort(F.collect_set("voice")).alias("voices")).join(twin, unit, "left")
    nobody = F.filter("voices", lambda v: F.lit(False))
    doubled = lambda kept, v: F.coalesce(F.exists("twins", lambda t: (t["b"] == v) & F.array_contains(kept, t["a"])), F.lit(False))
    folded = rows.withColumn("kept", F.aggregate("voices", nobody, lambda kept, v: F.when(doubled(kept, v), kept).otherwise(F.concat(kept, F.array(v)))))
    each = folded.select(*unit, F.explode("voices").alias("voice"), F.col("kept").alias("k"))
    return each.select(*unit, "voice", F.array_contains("k", F.col("voice")).alias("kept"), F.array_position("k", F.col("voice")).cast("int").alias("place"))


def kept_voices(notes: DataFrame, unit: list[str], voice: str = "voice_id", share: float = 0.95) -> DataFrame:
    """``greedy`` over the voices of each unit's notes."""
    return greedy(notes.select(*unit, F.col(voice).alias("voice")).distinct(), voice_tokens(notes, unit, voice), unit, share)


def collapse_voices(notes: DataFrame, unit: list[str], voice: str = "voice_id", share: float = 0.95) -> DataFrame:
    """The notes of the voices that stay."""
    stay = kept_voices(notes, unit, voice, share).where("kept").select(*unit, F.col("voice").alias(voice))
    return notes.join(stay, [*unit, voice], "left_semi").select(*notes.columns)
