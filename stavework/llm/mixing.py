"""Mixing sources to target weights by capped water-filling.

Targets: every source is offered its share of the budget by weight, is clamped
at ``max_epochs`` times its size, and the excess is offered again to the others
until no source is above its clamp. Sampling: a source at ratio r = target/size
takes every document floor(r) times, and the fraction of r once more from the
front of a seeded order of its documents, as long as at least half of the document
fits: a source misses its target by half of its longest document at most.

The order is cut into hash slices, so a source with a third of all rows is spread
over all tasks: whole slices are placed by their totals, and only inside a slice
is there a running sum.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stavework.llm._env import project, write_table

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of words of a text as a long (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def water_fill(sizes: list[tuple[str | None, int]], weights: list[float], share: float, max_epochs: float) -> dict[str | None, float]:
    """Target words of each source.

    Sources are ordered by code point, null last, and take ``weights`` in turn.
    Exact rational arithmetic; sources of size 0 get 0. If the clamps cannot hold
    the budget, every source ends at its clamp.
    """
    order = sorted(sizes, key=lambda s: (s[0] is None, s[0] or ""))
    weight = {s: Fraction(weights[i % len(weights)]) for i, (s, _) in enumerate(order)}
    size = dict(order)
    left = Fraction(share) * sum(size.values())
    target: dict[str | None, Fraction] = {}
    open_ = list(size)
    while open_:
        unit = left / sum(weight[s] for s in open_)
        above = [s for s in open_ if unit * weight[s] > Fraction(max_epochs) * size[s]]
        if not above:
            target |= {s: unit * weight[s] for s in open_}
            break
        for s in above:
            target[s] = Fraction(max_epochs) * size[s]
            left -= target[s]
        open_ = [s for s in open_ if s not in target]
    return {s: float(t) for s, t in target.items()}


def mixture(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, max_epochs: float = 2, seed: int = 17, slices: int = 1024) -> DataFrame:
    """How often the mix takes each document.

    Returns one row per input row: doc_id, source, size (words), source_size,
    target (words, of its source), times (repetitions), taken (size * times).

    Null texts have size 0 and are taken as their slice says (0 words either way);
    a null source is a source of its own; repeated rows are rows of their own;
    an empty table gives an empty result. Reruns agree: the order depends on the
    seed, the id and the text's hash only. The totals of the sources (one row per
    source, a small dimension of the corpus) are the only thing the driver sees.
    """
    spark = docs.sparkSession
    raw = project(docs, doc_id=doc_id, source=source, text=text)
    sized = write_table(
        raw.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64("doc_id", F.coalesce(F.length("text"), F.lit(-1)), F.lit(seed)).alias("h")).withColumn("slice", F.pmod("h", F.lit(slices)).cast("int")),
        "mixing-sizes",
    ).df()
    per_slice = write_table(sized.groupBy("source", "slice").agg(F.sum("size").alias("slice_size")), "mixing-slices").df()
    totals = [(r["source"], r["n"]) for r in per_slice.groupBy("source").agg(F.sum("slice_size").alias("n")).collect()]
    targets = water_fill(totals, list(weights), share, max_epochs)
    plan = spark.createDataFrame(
        [(s, n, targets[s], int(min(targets[s] / n, max_epochs)) if n else 0) for s, n in totals],
        T.StructType([T.StructField("source", T.StringType()), T.StructField("source_size", T.LongType()), T.StructField("target", T.DoubleType()), T.StructField("whole", T.IntegerType())]),
    )
    by_source = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_slice.withColumn("before", F.coalesce(F.sum("slice_size").over(by_source), F.lit(0)))
    # one row per source and slice, as many as sources times slices at most
    starts = starts.alias("a").join(plan.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source"))).select(
        F.col("a.source").alias("p_source"), F.col("slice").alias("p_slice"), "before", "source_size", "target", "whole", (F.col("target") - F.col("whole") * F.col("source_size")).alias("extra")
    )
    inside = Window.partitionBy("source", "slice").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    placed = sized.withColumn("upto", F.sum("size").over(inside))
    joined = placed.join(starts, F.col("source").eqNullSafe(F.col("p_source")) & (F.col("slice") == F.col("p_slice")))
    times = F.col("whole") + F.when(F.col("before") + F.col("upto") - F.col("size") / 2 <= F.col("extra"), 1).otherwise(0)
    return joined.select("doc_id", "source", "size", "source_size", "target", times.cast("int").alias("times"), (F.col("size") * times).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as it is taken.

    Documents need unique ids here; rows that share an id are taken alike.
    """
    key = options.get("doc_id", "doc_id")
    times = mixture(docs, **options).groupBy(F.col("doc_id").alias("__mix_id")).agg(F.max("times").alias("__mix_times")).where("__mix_times > 0")
    joined = docs.join(times, F.col(f"`{key}`").eqNullSafe(F.col("__mix_id")))
    return joined.withColumn("__mix_copy", F.explode(F.expr("sequence(1, __mix_times)"))).select(*[F.col(f"`{c}`") for c in docs.columns])
