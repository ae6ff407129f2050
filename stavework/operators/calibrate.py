"""Calibration of n-gram backgrounds with both composers left out, mixture weights, model choice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stavework.functions.symbols import presence
from stavework.operators import background as bg
from stavework.operators.running import running
from stavework.sources.tables import merged, scratch, store


def sample_rows(rows: DataFrame, key: list[str], size: int, seed: int = 20260903) -> DataFrame:
    """A uniform sample of ``size`` rows: the smallest digests of (seed, key). The same on every
    run; a work takes part by its number of rows."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in key]))
    return rows.orderBy(digest, *key).limit(size)


def weighted_picks(weights: DataFrame, key: str, weight: str, picks: DataFrame) -> DataFrame:
    """(pick, key, place): the row of ``weights`` in whose stretch of the running total each
    pick (a number from 0) lies, and its place there; picks beyond the total are left out.

    Both sides meet by blocks of 1024 places of the running total, so neither is broadcast."""
    ends = running(weights.select(F.col(key).alias("key"), F.col(weight).alias("w")).where("w > 0"), F.xxhash64("key").cast("double"), [F.col("key")], {"upto": F.col("w")})
    block = lambda x: F.floor(x / 1024)
    stretch = ends.select("key", (F.col("upto") - F.col("w")).alias("a"), F.col("upto").alias("b"))
    stretch = stretch.select("key", "a", "b", F.explode(F.sequence(block(F.col("a")), block(F.col("b")))).alias("block"))
    found = picks.withColumn("block", block(F.col("pick"))).join(merged(stretch), "block").where((F.col("pick") >= F.col("a")) & (F.col("pick") < F.col("b")))
    return found.select("pick", "key", (F.col("pick") - F.col("a")).cast("long").alias("place"))


def held_out_works(counts: DataFrame, share: float = 0.2, seed: int = 20260903) -> DataFrame:
    """(work_id): that share of the works, chosen by a digest of their id."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("work_id").cast("string")))
    return counts.select("work_id").distinct().where(F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") < share * 2.0**32)


def _kept(rows: DataFrame, name: str) -> DataFrame:
    """A table that several models read, worked out once."""
    return store(rows, scratch(rows.sparkSession, name))


def _out(*composers: str) -> Column:
    return F.array_sort(F.array_distinct(F.array(*composers)))


def asked_pairs(counts: DataFrame, queries: DataFrame, m: int) -> DataFrame:
    """(composer, query, composer_b, out): each query of a composer and each other composer."""
    others = counts.where(F.col("n") == m + 1).select(F.col("composer").alias("composer_b")).distinct()
    # composers are a small dimension beside their works
    rows = queries.select("composer", "query").distinct().crossJoin(F.broadcast(others)).where("composer <> composer_b")
    return _kept(rows.withColumn("out", _out("composer", "composer_b")), "asked-pairs")


def _discounts(counts: DataFrame) -> DataFrame:
    return bg.discounts(counts).select((F.col("n") - 1).alias("o"), "discount")


def without_both(counts: DataFrame, asked: DataFrame, m: int) -> DataFrame:
    """(out, query, p_kn): Kneser-Ney without the composers ``out``."""
    whole = counts.withColumn("g", F.lit("all"))
    kn = bg.kneser_ney_without(bg.net_counts(whole, "g", "composer"), _discounts(counts), asked.withColumn("g", F.lit("all")), m)
    return kn.select("out", "query", F.col("p").alias("p_kn"))


def _works(counts: DataFrame, m: int) -> DataFrame:
    top = counts.where(F.col("n") == m + 1)
    return top.groupBy("composer", "work_id").agg(F.sum("c").alias("windows_b")).withColumnsRenamed({"composer": "composer_b", "work_id": "work_b"})


def work_models(counts: DataFrame, asked: DataFrame, m: int) -> DataFrame:
    """(composer_b, work_b, query, windows_b, observed, p_comp) of each work of a composer and each
    query asked of it (``asked``: composer_b, query); p_comp: that composer's model without the
    work, null where there is no other work of theirs."""
    works = _works(counts, m)
    alone = _kept(asked.select("composer_b", "query").distinct().join(merged(works), "composer_b").select(F.col("composer_b").alias("g"), F.array("work_b").alias("out"), "query"), "asked-works")
    comp = bg.kneser_ney_without(bg.net_counts(counts, "composer", "work_id"), _discounts(counts), alone, m).select(F.col("g").alias("composer_b"), F.col("out")[0].alias("work_b"), "query", F.col("p").alias("p_comp"))
    seen = counts.where(F.col("n") == m + 1).groupBy(F.col("work_id").alias("work_b"), F.col("gram").alias("query")).agg(F.sum("c").alias("observed"))
    rows = comp.join(merged(seen), ["work_b", "query"], "left")
    rows = rows.join(merged(works), ["composer_b", "work_b"])
    return rows.select("composer_b", "work_b", "query", "windows_b", F.coalesce("observed", F.lit(0)).alias("observed"), "p_comp")


def scored_pairs(counts: DataFrame, queries: DataFrame, m: int, alpha: float = 1.0) -> DataFrame:
    """One row per query window of a work A and every work B of another composer.

    ``counts``: grams of 1..m symbols per work; ``queries``: q, composer, query. Returns q,
    work_b, composer_b, windows_b, observed, p_laplace, p_kn (both composers left out), p_comp
    (the composer of B without B; null where there is no such work) and df.
    """
    queries = _kept(queries.select("q", "composer", "query"), "queries")
    out = asked_pairs(counts, queries, m)
    lap = bg.laplace_without(counts, out, m + 1, alpha).select("out", "query", F.col("p").alias("p_laplace"))
    df = bg.document_frequency_without(counts, _discounts(counts), out, m).select("out", "query", "df")
    near = out.join(merged(without_both(counts, out, m)), ["out", "query"]).join(merged(lap), ["out", "query"]).join(merged(df), ["out", "query"])
    by_composer = _kept(queries.join(merged(near), ["composer", "query"]).select("q", "query", "composer_b", "p_laplace", "p_kn", "df"), "model-pairs")
    pairs = work_models(counts, out, m).join(by_composer, ["composer_b", "query"])
    return pairs.select("q", "work_b", "composer_b", "windows_b", "observed", "p_laplace", "p_kn", "p_comp", "df")


def document_frequency_pairs(counts: DataFrame, queries: DataFrame, m: int) -> DataFrame:
    """(q, composer_b, works, share, df): the works of each other composer, the share of them that
    holds the query, and what is predicted: the same for all of them."""
    queries = _kept(queries.select("q", "composer", "query"), "queries")
    out = asked_pairs(counts, queries, m)
    df = bg.document_frequency_without(counts, _discounts(counts), out, m).select("out", "query", "df")
    top = counts.where(F.col("n") == m + 1)
    works = top.groupBy(F.col("composer").alias("composer_b")).agg(F.countDistinct("work_id").alias("works"))
    held = top.groupBy(F.col("composer").alias("composer_b"), F.col("gram").alias("query")).agg(F.countDistinct("work_id").alias("held"))
    rows = out.join(merged(df), ["out", "query"]).join(merged(works), "composer_b").join(merged(held), ["composer_b", "query"], "left")
    return queries.join(merged(rows), ["composer", "query"]).select("q", "composer_b", "works", (F.coalesce("held", F.lit(0)) / F.col("works")).alias("share"), "df")


def per_query(pairs: DataFrame, lam: float) -> DataFrame:
    """Per query: works compared, occurrences and works observed and predicted by each model."""
    mixed = bg.mixture(F.col("p_comp"), F.col("p_kn"), lam)
    out = [F.count("*").alias("n_b"), F.sum("observed").alias("obs_occ"), F.count_if(F.col("observed") > 0).alias("obs_works")]
    for name, p in (("laplace", F.col("p_laplace")), ("kn", F.col("p_kn")), ("hier", mixed)):
        e = F.col("windows_b") * p
        out += [F.sum(e).alias(f"occ_{name}"), F.sum(presence(e)).alias(f"works_{name}")]
    return pairs.groupBy("q").agg(*out, F.sum("df").alias("works_df"))


def summary_by_seen(queries: DataFrame, models: tuple[str, ...] = ("laplace", "kn", "hier")) -> DataFrame:
    """Slope, mean absolute error, bias and ratio of each model, over all queries and those that
    occur elsewhere."""
    long = queries.select("obs_occ", F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.col(f"occ_{m}").alias("pred")) for m in models])).alias("x")).select("obs_occ", "x.*")
    sets = long.withColumn("rows", F.explode(F.when(F.col("obs_occ") > 0, F.array(F.lit("all"), F.lit("seen"))).otherwise(F.array(F.lit("all")))))
    o, p = F.ln(F.col("obs_occ") + 0.05), F.ln(F.col("pred") + 0.05)
    return sets.groupBy("model", "rows").agg(F.count("*").alias("n"), F.regr_slope(o, p).alias("slope"), F.avg(F.abs(o - p)).alias("mae"), F.avg(o - p).alias("bias"), (F.sum("obs_occ") / F.sum("pred")).alias("ratio"))


def best_model(summary: DataFrame, low: float = 0.9, high: float = 1.1) -> DataFrame:
    """The model of least error among those whose slope lies between the bounds."""
    return summary.where(F.col("slope").between(low, high)).agg(F.min_by("model", F.struct(F.round("mae", 9).alias("a"), "model")).alias("model"), F.min("mae").alias("mae"))


def deleted_interpolation(counts: DataFrame, windows: DataFrame, m: int, share: float = 0.2, most: int = 150, steps: int = 20) -> DataFrame:
    """(lam, loglik, windows): log-likelihood of windows of held-out works under mixtures of their
    composer's other works and of all works without that composer.

    ``windows``: composer, work_id, pos, query; at most ``most`` of each held-out work take part,
    chosen by a digest. Works whose composer has no other training work are left out.
    """
    hold = held_out_works(counts, share)
    d = _discounts(counts)
    train = counts.join(hold, "work_id", "left_anti")
    digest = F.md5(F.concat_ws("|", F.col("work_id").cast("string"), F.col("pos").cast("string")))
    held = windows.join(hold, "work_id", "left_semi").join(train.select("composer").distinct(), "composer", "left_semi")
    w = Window.partitionBy("work_id").orderBy(digest, "pos")
    chosen = held.withColumn("k", F.row_number().over(w)).where(F.col("k") <= most).select("composer", "query")
    each = chosen.distinct()
    nobody = F.array().cast("array<string>")
    pc = bg.kneser_ney_without(bg.net_counts(train, "composer", "composer"), d, each.select(F.col("composer").alias("g"), nobody.alias("out"), "query"), m).select(F.col("g").alias("composer"), "query", F.col("p").alias("pc"))
    all_ = train.withColumn("g", F.lit("all"))
    ps = bg.kneser_ney_without(bg.net_counts(all_, "g", "composer"), d, each.select(F.lit("all").alias("g"), F.array("composer").alias("out"), "query"), m).select(F.col("out")[0].alias("composer"), "query", F.col("p").alias("ps"))
    scored = chosen.join(merged(pc), ["composer", "query"]).join(merged(ps), ["composer", "query"])
    grid = bg.lambda_grid(scored, steps)
    return grid.crossJoin(F.broadcast(scored.agg(F.count("*").alias("windows"))))


def best_lambda(grid: DataFrame) -> DataFrame:
    """The weight of the largest log-likelihood; the smallest such weight on ties."""
    return grid.agg(F.min_by("lam", F.struct((-F.round("loglik", 6)).alias("a"), "lam")).alias("lam"), F.max("loglik").alias("loglik"))


def query_sums(pairs: DataFrame) -> DataFrame:
    """(n, obs, pc, ps) per query: occurrences, and those predicted by either model alone."""
    e = lambda p: F.sum(F.col("windows_b") * p)
    return pairs.groupBy("q").agg(F.lit(1).alias("n"), F.sum("observed").alias("obs"), e(F.coalesce("p_comp", "p_kn")).alias("pc"), e(F.col("p_kn")).alias("ps")).drop("q")


def query_sums_of_all(counts: DataFrame, windows: DataFrame, m: int) -> DataFrame:
    """The sums of every window (composer, query): those of one type of one composer are equal, so
    each is a row with their number ``n``. Works are summed per composer before they are compared."""
    asked = _kept(windows.groupBy("composer", "query").agg(F.count("*").alias("n")), "queries")
    out = asked_pairs(counts, asked, m)
    per = work_models(counts, out, m).groupBy("composer_b", "query").agg(
        F.sum("observed").alias("obs"), F.sum("windows_b").alias("all_b"), F.sum(F.col("windows_b") * F.col("p_comp")).alias("pc"), F.sum(F.when(F.col("p_comp").isNull(), F.col("windows_b"))).alias("rest"),
    )
    near = out.join(merged(without_both(counts, out, m)), ["out", "query"]).join(merged(per), ["composer_b", "query"])
    zero = F.lit(0)
    sums = near.groupBy("composer", "query").agg(F.sum("obs").alias("obs"), F.sum(F.coalesce("pc", zero) + F.coalesce("rest", zero) * F.col("p_kn")).alias("pc"), F.sum(F.col("all_b") * F.col("p_kn")).alias("ps"))
    return asked.join(merged(sums), ["composer", "query"]).select("n", "obs", "pc", "ps")


def lambda_calibration(sums: DataFrame, steps: int = 20) -> DataFrame:
    """(lam, slope, mae, bias, ratio) over ``query_sums``: predictions are linear in the weight, so
    any weight is tried on the sums of both models. A row counts ``n`` times."""
    sums = _kept(sums, "query-sums")
    tried = sums.select("n", "obs", "pc", "ps", F.explode(F.transform(F.sequence(F.lit(0), F.lit(steps)), lambda i: i / F.lit(steps))).alias("lam")).withColumn("pred", F.col("lam") * F.col("pc") + (1 - F.col("lam")) * F.col("ps"))
    tried = tried.withColumn("o", F.ln(F.col("obs") + 0.05)).withColumn("p", F.ln(F.col("pred") + 0.05))
    n, mean = F.col("n"), lambda x: F.sum(F.col("n") * x) / F.sum("n")
    middle = tried.groupBy("lam").agg(mean(F.col("o")).alias("mean_o"), mean(F.col("p")).alias("mean_p"))  # a row per weight
    o, p, dp = F.col("o"), F.col("p"), F.col("p") - F.col("mean_p")
    slope = F.when(F.min("p") < F.max("p"), F.sum(n * dp * (o - F.col("mean_o"))) / F.sum(n * dp * dp))
    return tried.join(F.broadcast(middle), "lam").groupBy("lam").agg(slope.alias("slope"), mean(F.abs(o - p)).alias("mae"), mean(o - p).alias("bias"), (F.sum(n * F.col("obs")) / F.sum(n * F.col("pred"))).alias("ratio"))


def least_bias(grid: DataFrame, low: float = 0.9, high: float = 1.1) -> DataFrame:
    """The weight of least absolute bias among those whose slope lies between the bounds."""
    return grid.where(F.col("slope").between(low, high)).agg(F.min_by("lam", F.struct(F.round(F.abs("bias"), 9).alias("a"), "lam")).alias("lam"))


def pair_instances(counts: DataFrame, arrays: DataFrame, pairs: DataFrame, m: int, lam: float) -> DataFrame:
    """Types that two works of a labelled pair share, with their scores.

    ``pairs``: pair, label, work_a, work_b; ``arrays``: windows (work_id, movement_idx, query).
    Returns pair, label, query, occ_a, occ_b, movements (of A, from 1, joined), windows_b, df, e,
    e_laplace, uniform_rhythm (all rhythm classes are 'same').
    """
    named = pairs.select(F.col("work_a").alias("work_id")).unionByName(pairs.select(F.col("work_b").alias("work_id"))).distinct()
    mine = arrays.join(named, "work_id", "left_semi")
    held = mine.groupBy("work_id", "query").agg(F.count("*").alias("occ"), F.array_join(F.transform(F.array_sort(F.collect_set("movement_idx")), lambda x: (x + 1).cast("string")), "|").alias("movements"))
    who = merged(counts.join(named, "work_id", "left_semi").select("work_id", "composer").distinct())
    size = mine.groupBy(F.col("work_id").alias("work_b")).agg(F.count("*").alias("windows_b"))
    p = pairs.join(who.toDF("work_a", "ca"), "work_a").join(who.toDF("work_b", "cb"), "work_b").withColumn("out", _out("ca", "cb"))
    a, b = held.toDF("work_a", "query", "occ_a", "movements"), held.drop("movements").toDF("work_b", "query", "occ_b")
    both = _kept(p.join(merged(a), "work_a").join(merged(b), ["work_b", "query"]).join(merged(size), "work_b"), "shared-types")
    kn = without_both(counts, both, m).withColumnRenamed("p_kn", "ps")
    comp = bg.kneser_ney_without(bg.net_counts(counts, "composer", "work_id"), _discounts(counts), both.select(F.col("cb").alias("g"), F.array("work_b").alias("out"), "query"), m).select(F.col("g").alias("cb"), F.col("out")[0].alias("work_b"), "query", F.col("p").alias("pc"))
    lap = bg.laplace_without(counts, both, m + 1).select("out", "query", F.col("p").alias("pl"))
    df = bg.document_frequency_without(counts, _discounts(counts), both, m).select("out", "query", "df")
    rows = both.join(merged(kn), ["out", "query"]).join(merged(lap), ["out", "query"]).join(merged(df), ["out", "query"]).join(merged(comp), ["cb", "work_b", "query"], "left")
    same = ~F.exists("query", lambda s: F.pmod(s, F.lit(8)) != 2)
    return rows.select("pair", "label", "query", "occ_a", "occ_b", "movements", "windows_b", "df", (F.col("windows_b") * bg.mixture(F.col("pc"), F.col("ps"), lam)).alias("e"), (F.col("windows_b") * F.col("pl")).alias("e_laplace"), same.alias("uniform_rhythm"))


def refuse(rows: DataFrame, columns: list[str], forbidden: list[str]) -> DataFrame:
    """The rows as they are; the job fails if a column holds a forbidden word."""
    bad = F.lit(False)
    for c in columns:
        for word in forbidden:
            bad = bad | F.coalesce(F.contains(F.lower(F.col(c).cast("string")), F.lit(word.lower())), F.lit(False))
    return rows.where(F.when(bad, F.raise_error(F.lit("a forbidden word in a pair"))).otherwise(F.lit(True)))
