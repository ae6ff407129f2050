"""Uniqueness of n-grams within and across works, shared types, document frequency."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stavework.operators.components import connected_components


def per_gram_work(grams: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """(by, gram, work_id, t): tokens of each type in each work; the one large exchange."""
    return grams.groupBy(*by, "gram", "work_id").agg(F.count("*").alias("t"))


def curve(grams: DataFrame, by: tuple[str, ...] = ("n",)) -> DataFrame:
    """tokens, types, unique_types, p_cross, p_pair, works for each group.

    p_cross: share of tokens whose type occurs in another work. p_pair: mean over works
    A of the chance that a window of A occurs in one other given work; null for one work.
    """
    pairs = per_gram_work(grams, by)
    types = pairs.groupBy(*by, "gram").agg(F.count("*").alias("works"), F.sum("t").alias("tokens"))
    head = types.groupBy(*by).agg(F.sum("tokens").alias("tokens"), F.count("*").alias("types"), F.count_if(F.col("works") == 1).alias("unique_types"), F.sum(F.when(F.col("works") > 1, F.col("tokens")).otherwise(0)).alias("shared"))
    per_work = pairs.join(types.select(*by, "gram", "works"), [*by, "gram"]).groupBy(*by, "work_id").agg(F.sum(F.col("t") * (F.col("works") - 1)).alias("s"), F.sum("t").alias("t"))
    tail = per_work.groupBy(*by).agg(F.count("*").alias("works"), F.avg(F.col("s") / F.col("t")).alias("mean"))
    return head.join(tail, list(by)).select(*by, "tokens", "types", "unique_types", F.round(F.col("shared") / F.col("tokens"), 6).alias("p_cross"), F.round(F.when(F.col("works") > 1, F.col("mean") / (F.col("works") - 1)), 6).alias("p_pair"), "works")


def shared_types(grams: DataFrame, max_works: int = 40) -> DataFrame:
    """(a, b, shared): numbers of distinct types two works share, types of more than
    ``max_works`` works left out, so no type joins more than that many works."""
    types = grams.select("composer", "work_id", "gram").distinct()
    usual = types.groupBy("gram").agg(F.count("*").alias("df")).where(F.col("df").between(2, max_works))
    kept = types.join(usual.select("gram"), "gram")
    a, b = kept.select("gram", F.col("work_id").alias("a"), F.col("composer").alias("ca")), kept.select("gram", F.col("work_id").alias("b"), F.col("composer").alias("cb"))
    return a.join(b, "gram").where("a < b").groupBy("a", "b", "ca", "cb").agg(F.count("*").alias("shared"))


def containment_pairs(grams: DataFrame, min_shared: int = 50, share: float = 0.5, max_works: int = 40, same_composer: bool = True) -> DataFrame:
    """Works that share enough of the smaller one's types (all types in the denominator)."""
    sizes = grams.select("work_id", "gram").distinct().groupBy("work_id").agg(F.count("*").alias("types"))
    pairs = shared_types(grams, max_works)
    if same_composer:
        pairs = pairs.where("ca = cb")
    x, y = sizes.select(F.col("work_id").alias("a"), F.col("types").alias("ta")), sizes.select(F.col("work_id").alias("b"), F.col("types").alias("tb"))
    both = pairs.join(x, "a").join(y, "b").withColumn("containment", F.col("shared") / F.least("ta", "tb"))
    return both.where((F.col("shared") >= min_shared) & (F.col("containment") >= share)).select("a", "b", "shared", F.round("containment", 6).alias("containment"))


def components(pairs: DataFrame) -> DataFrame:
    """(work_id, component): smallest work reachable over pairs (a, b); a work that is paired
    with itself only is its own component, nulls are ignored."""
    valid = pairs.select("a", "b").where("a is not null and b is not null")
    works = valid.select("a").unionByName(valid.select(F.col("b").alias("a"))).distinct()
    parts = connected_components(valid, "a", "b").toDF("a", "low")
    return works.join(parts, "a", "left").select(F.col("a").alias("work_id"), F.coalesce("low", "a").alias("component"))


def incipits(grams: DataFrame, pattern: list[int], sizes: list[int]) -> DataFrame:
    """For each n of ``sizes``: tokens and works of the first n - 1 symbols of a fixed pattern, 0
    where it does not occur."""
    rows = grams.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, sizes))).alias("n"))
    wanted = rows.select("n", F.slice(F.array(*map(F.lit, pattern)), F.lit(1), F.col("n") - 1).alias("gram"))
    found = grams.join(F.broadcast(wanted), ["n", "gram"]).groupBy("n").agg(F.count("*").alias("tokens"), F.countDistinct("work_id").alias("works"))
    return rows.join(found, "n", "left").select("n", F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("works", F.lit(0)).alias("works"))


def motif_starts(arrays: DataFrame, column: str, m: int, still: int = 200) -> DataFrame:
    """(work_id, movement_idx, voice_id, seg, gram, start) of motifs that are not all repeated notes."""
    each = arrays.select("work_id", "movement_idx", "voice_id", "seg", F.col(column).alias("s")).where(F.size("s") >= m)
    rows = each.select("work_id", "movement_idx", "voice_id", "seg", F.posexplode(F.expr(f"transform(sequence(1, size(s) - {m} + 1), i -> slice(s, i, {m}))")).alias("start", "gram"))
    return rows.where(F.exists("gram", lambda x: x != still))


def motif_positions(arrays: DataFrame, column: str, m: int) -> DataFrame:
    """(work_id, gram, occurrences, first_start) of motifs that are not all repeated notes."""
    return motif_starts(arrays, column, m).groupBy("work_id", "gram").agg(F.count("*").alias("occurrences"), F.min("start").alias("first_start"))


def shared_motifs(starts: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, gram, starts_a, starts_b) of the motifs that two works share; starts are (movement,
    voice, segment, place) in order."""
    place = F.struct("movement_idx", "voice_id", "seg", "start")
    held = starts.groupBy("work_id", "gram").agg(F.array_sort(F.collect_list(place)).alias("starts"))
    a, b = held.toDF("a", "gram", "starts_a"), held.toDF("b", "gram", "starts_b")
    return pairs.select("a", "b").join(a, "a").join(b, ["b", "gram"]).select("a", "b", "gram", "starts_a", "starts_b")


def boldest(shared: DataFrame, still: int = 200) -> DataFrame:
    """Of each pair the shared motif of the largest leaps; ties to the first motif."""
    leaps = F.aggregate("gram", F.lit(0), lambda s, x: s + F.abs(x - still))
    return shared.groupBy("a", "b").agg(F.max_by(F.struct("gram", "starts_a", "starts_b"), F.struct(leaps.alias("l"), F.transform("gram", lambda x: -x).alias("g"))).alias("m")).select("a", "b", "m.*")


def highlights(starts: DataFrame, column: str, m: int) -> DataFrame:
    """(a, movement_idx, voice_id, seg, note): the notes that occurrences of m intervals cover."""
    each = starts.select("a", F.explode(column).alias("s"))
    return each.select("a", "s.movement_idx", "s.voice_id", "s.seg", F.explode(F.sequence(F.col("s.start"), F.col("s.start") + m)).alias("note")).distinct()
