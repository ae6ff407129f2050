"""ROC and PR curves, calibration metrics, reliability and decile tables, rank correlation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stavework.operators.running import running


def roc_points(scored: DataFrame, score: str, label: str) -> DataFrame:
    """One point per distinct score: fpr, tpr, precision, and the rates before it. Counts
    are combined per score first, so the running sums see distinct scores only."""
    per = scored.groupBy(F.col(score).alias("score")).agg(F.sum(label).alias("p"), F.sum(1 - F.col(label)).alias("n"))
    c = running(per, F.col("score"), [], {"tp": F.col("p"), "fp": F.col("n")}, descending=True)
    c = c.crossJoin(F.broadcast(per.agg(F.sum("p").alias("all_p"), F.sum("n").alias("all_n"))))
    return c.select(
        "score", (F.col("fp") / F.col("all_n")).alias("fpr"), (F.col("tp") / F.col("all_p")).alias("tpr"), (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"),
        ((F.col("fp") - F.col("n")) / F.col("all_n")).alias("fpr_before"), ((F.col("tp") - F.col("p")) / F.col("all_p")).alias("tpr_before"),
    )


def roc_summary(points: DataFrame) -> DataFrame:
    """auc (trapezoids) and ap (steps)."""
    up, right = F.col("tpr") - F.col("tpr_before"), F.col("fpr") - F.col("fpr_before")
    return points.agg(F.sum(right * (F.col("tpr") + F.col("tpr_before")) / 2).alias("auc"), F.sum(up * F.col("precision")).alias("ap"))


def threshold_at(scored: DataFrame, score: str, label: str, share: float) -> DataFrame:
    """The score's quantile among negatives (linear interpolation)."""
    return scored.where(F.col(label) == 0).agg(F.percentile(score, share).alias("threshold"))


def largest_at_share(scored: DataFrame, score: str, label: str, share: float) -> DataFrame:
    """The largest observed score that at most ``share`` of the negatives do not exceed (0 if none)."""
    per = scored.groupBy(F.col(score).alias("score")).agg(F.count_if(F.col(label) == 0).alias("n"))
    c = running(per, F.col("score"), [], {"below": F.col("n")}).crossJoin(F.broadcast(per.agg(F.sum("n").alias("all_n"))))
    return c.agg(F.coalesce(F.max(F.when(F.col("below") / F.col("all_n") <= share, F.col("score"))), F.lit(0.0)).alias("threshold"))


def pair_summary(instances: DataFrame, t_df: float | Column, t_e: float | Column) -> DataFrame:
    """Per labelled pair: shared types, those under each threshold and under both, smallest scores."""
    low, rare = F.col("df") <= t_df, F.col("e") <= t_e
    return instances.groupBy("pair", "label").agg(F.count("*").alias("shared_types"), F.count_if(low).alias("pass_df"), F.count_if(rare).alias("pass_e"), F.count_if(low & rare).alias("pass_both"), F.min("df").alias("min_df"), F.min("e").alias("min_e"))


def log_metrics(rows: DataFrame, observed: str, predicted: str, shift: float = 0.05) -> DataFrame:
    """Slope, mean absolute error and bias of log(x + shift)."""
    o, p = F.ln(F.col(observed) + shift), F.ln(F.col(predicted) + shift)
    return rows.agg(F.regr_slope(o, p).alias("slope"), F.avg(F.abs(o - p)).alias("mae"), F.avg(p - o).alias("bias"), (F.sum(observed) / F.sum(predicted)).alias("ratio"))


def reliability(rows: DataFrame, observed: str, predicted: str, edges: list[float], weight: str | None = None) -> DataFrame:
    """(bin, pairs, mean_pred, mean_obs); a row stands for as many pairs as ``weight`` says."""
    bins = F.lit(0)
    for e in edges:
        bins = bins + F.when(F.col(predicted) >= e, 1).otherwise(0)
    if weight:
        w = F.col(weight)
        return rows.groupBy(bins.alias("bin")).agg(F.sum(w).alias("pairs"), (F.sum(w * F.col(predicted)) / F.sum(w)).alias("mean_pred"), (F.sum(w * F.col(observed)) / F.sum(w)).alias("mean_obs"))
    return rows.groupBy(bins.alias("bin")).agg(F.count("*").alias("pairs"), F.avg(predicted).alias("mean_pred"), F.avg(observed).alias("mean_obs"))


def decile_means(rows: DataFrame, order: list, value: str, k: int = 10) -> DataFrame:
    """Means over ``k`` equal parts of the order; the first parts get the rows that are left over."""
    first, *rest = [F.col(c) for c in order]
    place = running(rows, F.unix_micros(first.cast("timestamp")) if dict(rows.dtypes)[order[0]].startswith("timestamp") else first, [first, *rest], {"at": F.lit(1)})
    placed = place.crossJoin(F.broadcast(rows.agg(F.count("*").alias("all_rows"))))
    size, more = F.floor(F.col("all_rows") / k), F.col("all_rows") % k
    part = F.when(F.col("at") <= more * (size + 1), F.ceil(F.col("at") / (size + 1))).otherwise(more + F.ceil((F.col("at") - more * (size + 1)) / F.greatest(size, F.lit(1))))
    return placed.withColumn("decile", part.cast("int")).groupBy("decile").agg(F.count("*").alias("rows"), F.avg(value).alias("mean"), (F.stddev_samp(value) / F.sqrt(F.count("*"))).alias("sem"))


def average_ranks(rows: DataFrame, column: str) -> DataFrame:
    """(value, rank): the average rank of each distinct value."""
    per = rows.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    return running(per, F.col("value"), [], {"upto": F.col("n")}).select("value", (F.col("upto") - (F.col("n") - 1) / 2).alias("rank"))


def spearman(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Correlation of average ranks; rows with a null on either side are left out."""
    ranks = rows.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null")
    both = ranks.join(average_ranks(ranks, "a").toDF("a", "ra"), "a").join(average_ranks(ranks, "b").toDF("b", "rb"), "b")
    return both.agg(F.corr("ra", "rb").alias("rho"))


def regression_check(found: DataFrame, golden: DataFrame, tolerance: float = 0.02) -> DataFrame:
    """(key, stat, found, golden, deviation, ok): counts against stored ones, both sides kept."""
    both = found.join(golden, ["key", "stat"], "full_outer")
    gap = F.try_divide(F.col("found") - F.col("golden"), F.col("golden").cast("double"))
    return both.select("key", "stat", "found", "golden", gap.alias("deviation"), F.coalesce(F.abs(gap) <= tolerance, F.col("found").eqNullSafe(F.col("golden"))).alias("ok"))
