"""Column functions on notes: intervals, rhythm classes, symbols, predicates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tolerance of time comparisons, base and width of the symbol code.
TOL = 1e-6
IV_BASE, RHYTHM_BASE, RHYTHMS = 200, 2, 8


def rhythm_class(before: Column, after: Column) -> Column:
    """Class -2..2 of the ratio of two durations; 0 where either is not positive."""
    r = after.cast("double") / before.cast("double")
    steps = F.when(r < 0.4, -2).when(r < 0.9, -1).when(r <= 1.1, 0).when(r <= 2.5, 1).otherwise(2)
    return F.when((before <= 0) | (after <= 0), 0).otherwise(steps)


def iv_symbol(interval: Column) -> Column:
    return interval + IV_BASE


def ivr_symbol(interval: Column, rhythm: Column) -> Column:
    return (interval + IV_BASE) * RHYTHMS + rhythm + RHYTHM_BASE


def symbol_interval(symbol: Column) -> Column:
    """The interval of a joint symbol."""
    return F.floor(symbol / RHYTHMS).cast("int") - IV_BASE


def symbol_rhythm(symbol: Column) -> Column:
    return F.pmod(symbol, F.lit(RHYTHMS)) - RHYTHM_BASE


def same_then_long(d1: Column, d2: Column, d3: Column, d4: Column) -> Column:
    """Three equal positive durations and a fourth of at least twice their length."""
    return (d1 > 0) & (d2 > 0) & (d3 > 0) & (F.abs(d1 - d2) <= TOL) & (F.abs(d2 - d3) <= TOL) & (d4 >= 2 * d3 - TOL)


def falls_by_third(i1: Column, i2: Column, i3: Column) -> Column:
    return (i1 == 0) & (i2 == 0) & i3.isin(-4, -3)


def weak_beat(offset: Column) -> Column:
    """Off the beat, or on an odd beat (beats rounded half to even)."""
    beat = F.bround(offset)
    return (F.abs(offset - beat) > TOL) | (F.pmod(beat.cast("long"), F.lit(2)) == 1)


def good_turing_alpha(n: Column, v: Column, n1: Column) -> Column:
    """Pseudo-count under which the unseen types get the mass n1 / n."""
    return n1 / (v + 1) * (n / F.greatest(n - n1, F.lit(1)))


def laplace(count: Column, n: Column, v: Column, alpha) -> Column:
    return (count + alpha) / (n + alpha * (v + 1))


def e_value(windows: Column, p: Column) -> Column:
    return windows * p


def presence(e: Column) -> Column:
    return 1 - F.exp(-e)


def per_100k(count: Column, windows: Column) -> Column:
    return F.when(windows > 0, 1e5 * count / windows)


def nearest(value: Column, bins: list[float]) -> Column:
    """The closest of some levels; the smaller one on ties."""
    return F.array_min(F.array(*[F.struct(F.abs(value - b).alias("d"), F.lit(b).alias("b")) for b in bins]))["b"]


def influence_weight(similarity: Column, year_from: Column, year_to: Column) -> Column:
    """0 unless the first is older; else decays with the years between."""
    gap = (year_to - year_from).cast("double")
    return F.when(year_from >= year_to, F.lit(0.0)).otherwise(F.round(similarity * (0.5 + 0.5 * F.exp(-gap / 80)), 3))


def moving_token(midi: Column, duration_level: Column) -> Column:
    """Pitch class and one of four duration levels as one token."""
    return F.pmod(midi, F.lit(12)) * 4 + duration_level
