"""Smoothed n-gram models with groups left out: Laplace, Kneser-Ney, mixtures, document frequency.

Tables hold one row per (ord, gram, composer, work_id) with its count, so leaving
works or composers out is a filtered sum, never a rebuilt table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stavework.functions.symbols import good_turing_alpha, laplace
from stavework.sources.tables import merged


def counts_table(grams: DataFrame) -> DataFrame:
    """(n, gram, composer, work_id, c): combined before the exchange."""
    return grams.groupBy("n", "gram", "composer", "work_id").agg(F.count("*").alias("c"))


def summary(counts: DataFrame) -> DataFrame:
    """Per n: tokens, types, hapaxes, Good-Turing pseudo-count, unseen probability."""
    types = counts.groupBy("n", "gram").agg(F.sum("c").alias("c"))
    s = types.groupBy("n").agg(F.sum("c").alias("tokens"), F.count("*").alias("types"), F.count_if(F.col("c") == 1).alias("hapaxes"))
    return s.select("n", "tokens", "types", "hapaxes", F.round(good_turing_alpha(F.col("tokens"), F.col("types"), F.col("hapaxes")), 6).alias("alpha"), F.round(1 / (F.col("tokens") + F.col("types") + 1), 10).alias("p_unseen"))


def composer_totals(counts: DataFrame) -> DataFrame:
    """Per n and composer: tokens, and types that no other composer has."""
    per = counts.groupBy("n", "gram", "composer").agg(F.sum("c").alias("c"))
    alone = per.groupBy("n", "gram").agg(F.count("*").alias("k"))
    return per.join(alone, ["n", "gram"]).groupBy("n", "composer").agg(F.sum("c").alias("tokens"), F.count_if(F.col("k") == 1).alias("exclusive"))


def laplace_excluding(counts: DataFrame, alpha: float = 1.0) -> DataFrame:
    """(n, composer, gram, c, p): probability of each of a composer's types under the model
    without that composer. The composer's totals are a table of one row each."""
    total = summary(counts).select("n", F.col("tokens").alias("all_tokens"), F.col("types").alias("all_types"))
    out = composer_totals(counts).join(total, "n").select("n", "composer", (F.col("all_tokens") - F.col("tokens")).alias("rest_n"), (F.col("all_types") - F.col("exclusive")).alias("rest_v"))
    per = counts.groupBy("n", "gram", "composer").agg(F.sum("c").alias("own"))
    types = per.groupBy("n", "gram").agg(F.sum("own").alias("all"))
    joined = per.join(types, ["n", "gram"]).join(out, ["n", "composer"])
    c = F.col("all") - F.col("own")
    return joined.select("n", "composer", "gram", c.alias("c"), laplace(c, F.col("rest_n"), F.col("rest_v"), alpha).alias("p"))


def document_frequency(counts: DataFrame) -> DataFrame:
    """(n, gram, works, df): the share of works that hold a type."""
    works = counts.groupBy("n").agg(F.countDistinct("work_id").alias("nw"))
    per = counts.groupBy("n", "gram").agg(F.countDistinct("work_id").alias("works"))
    return per.join(works, "n").select("n", "gram", "works", (F.col("works") / F.col("nw")).alias("df"))


def discounts(counts: DataFrame) -> DataFrame:
    """Per n: absolute discount n1 / (n1 + 2 n2), one half where undefined; tokens and types."""
    types = counts.groupBy("n", "gram").agg(F.sum("c").alias("c"))
    s = types.groupBy("n").agg(F.sum("c").alias("tokens"), F.count("*").alias("types"), F.count_if(F.col("c") == 1).alias("n1"), F.count_if(F.col("c") == 2).alias("n2"))
    d = F.col("n1") + 2 * F.col("n2")
    return s.select("n", "tokens", "types", "n1", "n2", F.when(d > 0, F.col("n1") / d).otherwise(0.5).alias("discount"))


def leaving_out(counts: DataFrame, composers: tuple = (), works: tuple = ()) -> DataFrame:
    """The counts without the works of ``composers`` and without ``works``; null keys stay."""
    gone = F.lit(False)
    for key, values in (("composer", composers), ("work_id", works)):
        if values:
            gone = gone | F.coalesce(F.col(key).isin(*values), F.lit(False))
    return counts.where(~gone)


def _continuations(t: DataFrame, by: list[str], carry: list) -> DataFrame:
    """(by, kind, o, key, carry): what each type of order o counts for, beside itself: as a
    follower of its prefix (f), before its suffix (s) and around its middle (m)."""
    part = lambda kind, o, a, n, least: t.where(F.col("o") >= least).select(*by, F.lit(kind).alias("kind"), o.alias("o"), F.slice("gram", F.lit(a), n).alias("key"), *carry)
    o = F.col("o")
    return part("f", o, 1, o - 1, 2).unionByName(part("s", o - 1, 2, o - 1, 2)).unionByName(part("m", o - 1, 2, o - 2, 3))


def _slots(m: int) -> list[tuple[str, int, int, int]]:
    """(kind, order, start, length) of every count that the chain of a window of m symbols needs."""
    needs = []
    for k in range(1, m + 1):
        needs += [("c", k, 1, k), ("f", k, 1, k - 1)] if k > 1 else [("c", 1, 1, 1)]
        for j in range(1, k):
            needs.append(("s", j, k - j + 1, j))
            if j > 1:
                needs += [("m", j, k - j + 1, j - 1), ("f", j, k - j + 1, j - 1)]
    return sorted(set(needs))


def _wanted(queries: DataFrame, by: list[str], m: int) -> DataFrame:
    slots = F.array(*[F.struct(F.lit(kind).alias("kind"), F.lit(o).alias("o"), F.slice("query", a, n).alias("key"), F.lit(f"{kind}{o}_{a}_{n}").alias("slot")) for kind, o, a, n in _slots(m)])
    return queries.select(*by, "query", F.explode(slots).alias("x")).select(*by, "query", "x.*")


def _slot(*slot) -> Column:
    return F.col("{}{}_{}_{}".format(*slot))


def _per_slot(m: int) -> list[Column]:
    """The sum of v of each slot side by side."""
    return [F.sum(F.when(F.col("slot") == name, F.col("v"))).alias(name) for name in ("{}{}_{}_{}".format(*x) for x in _slots(m))]


def parts(out: str = "out") -> Column:
    """Every set of units (``who``) whose rows count for a sorted array of at most two units that
    are left out: none, each one, both. Rows are met by equality, not by a comparison of sets."""
    return F.explode(F.array_distinct(F.array(F.slice(out, 1, 0), F.slice(out, 1, 1), F.slice(out, 2, 1), F.col(out)))).alias("who")


def _folded(rows: DataFrame, m: int, window: bool) -> DataFrame:
    """Rows with ``__p``: the interpolated chain over a count per slot and N1.., V1.., D1.. .

    Every level is a column that the next one names, so the plan grows with the square of m,
    not with its power.
    """
    v = lambda kind, o, a, n: F.coalesce(_slot(kind, o, a, n), F.lit(0)).cast("double")
    col, zero, low = F.col, F.lit(0.0), F.col("__low")
    log = lambda p: F.ln(F.greatest(p, F.lit(1e-300)))
    rows = rows.withColumn("__uniform", 1 / (F.greatest(col("V1"), F.lit(1.0)) + 1))
    first = F.greatest(v("c", 1, 1, 1) - col("D1"), zero) / col("N1") + col("D1") * col("V1") / col("N1") * col("__uniform")
    rows = rows.withColumn("__logs", log(F.when(col("N1") > 0, first).otherwise(col("__uniform"))))
    for k in range(2, m + 1):
        rows = rows.withColumn("__low", col("__uniform"))
        for j in range(1, k):
            cont = F.greatest(v("s", j, k - j + 1, j) - col(f"D{j}"), zero)
            if j == 1:
                level = F.when(col("V2") == 0, low).otherwise(cont / col("V2") + col("D1") * col("V1") / col("V2") * low)
            else:
                den = v("m", j, k - j + 1, j - 1)
                level = F.when(den == 0, low).otherwise(cont / den + col(f"D{j}") * v("f", j, k - j + 1, j - 1) / den * low)
            rows = rows.withColumn("__low", level)
        ctx = v("c", k - 1, 1, k - 1)
        p = F.when(ctx == 0, low).otherwise(F.greatest(v("c", k, 1, k) - col(f"D{k}"), zero) / ctx + col(f"D{k}") * v("f", k, 1, k - 1) / ctx * low)
        rows = rows.withColumn("__logs", col("__logs") + log(p))
    scale = F.when(col(f"N{m}") > 0, col("N1") / col(f"N{m}")).otherwise(1.0) if window else F.lit(1.0)
    return rows.withColumn("__p", F.exp("__logs") * scale)


def _orders(stats: DataFrame, m: int, columns: dict[str, str], by: list[str]) -> DataFrame:
    """One row per group with the numbers of orders 1..m side by side."""
    missing = {"D": 0.5}
    return stats.groupBy(*by).agg(*[F.coalesce(F.max(F.when(F.col("o") == o, F.col(c))), F.lit(missing.get(x, 0))).cast("double").alias(f"{x}{o}") for o in range(1, m + 1) for x, c in columns.items()])


def kneser_ney(counts: DataFrame, queries: DataFrame, m: int, without: tuple = (), without_works: tuple = (), window: bool = True) -> DataFrame:
    """(query, p): interpolated Kneser-Ney probability of arrays of m symbols.

    ``counts`` has the grams of 1..m symbols (column n counts notes: symbols + 1).
    All counts a query needs are fetched by one equi-join on (kind, order, key) and
    folded in an unrolled recursion. ``window``: the chain's value times N1 / Nm.
    The works of the composers ``without`` and ``without_works`` are left out of every
    count, continuation count and discount.
    """
    counts = leaving_out(counts, without, without_works)
    t = counts.groupBy((F.col("n") - 1).alias("o"), "gram").agg(F.sum("c").alias("c"))
    table = t.select(F.lit("c").alias("kind"), "o", F.col("gram").alias("key"), F.col("c").alias("v")).unionByName(_continuations(t, [], []).groupBy("kind", "o", "key").agg(F.count("*").alias("v")))
    got = _wanted(queries.select("query").distinct(), [], m).join(merged(table), ["kind", "o", "key"]).groupBy("query").agg(*_per_slot(m))
    stats = discounts(counts).select((F.col("n") - 1).alias("o"), "tokens", "types", "discount")
    scalars = _orders(stats, m, {"N": "tokens", "V": "types", "D": "discount"}, [])  # one row
    return _folded(queries.select("query").join(merged(got), "query", "left").crossJoin(F.broadcast(scalars)), m, window).select("query", F.col("__p").alias("p"))


def net_counts(counts: DataFrame, group: str, unit: str) -> tuple[DataFrame, DataFrame]:
    """Count tables of the model of each ``group`` from which up to two ``unit`` can be left out.

    Rows (g, kind, o, key, who, v): the value of a key without the units ``out`` is the sum
    of v over the rows whose ``who`` lies within ``out``. The total has an empty ``who``;
    a unit's own tokens, and a type that only one or two units hold, are negative rows. The
    second table holds the tokens (N) and types (V) of each order the same way.
    """
    per = counts.groupBy(F.col(group).alias("g"), (F.col("n") - 1).alias("o"), "gram", F.col(unit).alias("u")).agg(F.sum("c").alias("c"))
    t = per.groupBy("g", "o", "gram").agg(F.sum("c").alias("c"), F.count("*").alias("k"), F.min("u").alias("low"), F.max("u").alias("high"))
    nobody, gone = F.array().cast(f"array<{dict(per.dtypes)['u']}>"), F.array_distinct(F.array("low", "high"))
    tokens = t.select("g", "o", "gram", nobody.alias("who"), "c").unionByName(per.select("g", "o", "gram", F.array("u").alias("who"), (-F.col("c")).alias("c")))
    one = F.lit(1).cast("long")
    types = t.select("g", "o", "gram", nobody.alias("who"), one.alias("v")).unionByName(t.where("k <= 2").select("g", "o", "gram", gone.alias("who"), (-one).alias("v")))
    around = _continuations(types, ["g"], ["who", "v"]).groupBy("g", "kind", "o", "key", "who").agg(F.sum("v").alias("v"))
    table = tokens.select("g", F.lit("c").alias("kind"), "o", F.col("gram").alias("key"), "who", F.col("c").alias("v")).unionByName(around)
    size = tokens.groupBy("g", "o", "who").agg(F.sum("c").alias("v")).withColumn("kind", F.lit("N"))
    return table, size.unionByName(types.groupBy("g", "o", "who").agg(F.sum("v").alias("v")).withColumn("kind", F.lit("V")))


def kneser_ney_without(tables: tuple[DataFrame, DataFrame], discount: DataFrame, queries: DataFrame, m: int, window: bool = True) -> DataFrame:
    """(g, out, query, p, n_m): Kneser-Ney under the model of group g without the units ``out``.

    ``queries``: g, out (a sorted array of at most two units), query. ``discount`` (o, discount)
    stays that of the full tables. The counts of a query are worked out once per group and once
    per unit that holds any of them, so the work grows with the units, not with their pairs. A model without any symbols gives null. n_m: tokens of order m.
    """
    table, sizes = tables
    asked = queries.select("g", "out", "query").distinct()
    each = asked.select("g", "out", "query", parts())
    needed = asked.select("g", "out").distinct().select("g", parts()).distinct()
    rows = table.join(merged(needed), ["g", "who"], "left_semi")
    slots = _wanted(asked.select("g", "query").distinct(), ["g"], m)
    held = merged(rows).join(slots, ["g", "kind", "o", "key"]).groupBy("g", "who", "query").agg(*_per_slot(m))
    names = [c for c in held.columns if c not in ("g", "who", "query")]
    got = each.join(merged(held), ["g", "who", "query"]).groupBy("g", "out", "query").agg(*[F.sum(c).alias(c) for c in names])
    models = asked.select("g", "out").distinct().select("g", "out", parts())
    per = models.join(merged(sizes), ["g", "who"]).groupBy("g", "out", "o").agg(F.sum(F.when(F.col("kind") == "N", F.col("v"))).alias("tokens"), F.sum(F.when(F.col("kind") == "V", F.col("v"))).alias("types"))
    scalars = _orders(per, m, {"N": "tokens", "V": "types"}, ["g", "out"])
    d = _orders(discount, m, {"D": "discount"}, [])  # one row
    rows = asked.join(merged(got), ["g", "out", "query"], "left").join(merged(scalars), ["g", "out"], "left").crossJoin(F.broadcast(d))
    return _folded(rows, m, window).select("g", "out", "query", F.when(F.col("N1") > 0, F.col("__p")).alias("p"), F.col(f"N{m}").alias("n_m"), F.col("N1").alias("n_1"))


def laplace_without(counts: DataFrame, queries: DataFrame, n: int, alpha: float = 1.0, exact_types: bool = False) -> DataFrame:
    """(out, query, c, p): Laplace under the counts without up to two composers.

    Types are reduced by those that a left-out composer has alone; with ``exact_types`` also
    by those that only the two share.
    """
    own = counts.where(F.col("n") == n)
    per = own.groupBy("gram", "composer").agg(F.sum("c").alias("c"))
    t = per.groupBy("gram").agg(F.sum("c").alias("c"), F.count("*").alias("k"), F.array_distinct(F.array(F.min("composer"), F.max("composer"))).alias("who"))
    nobody = F.array().cast("array<string>")
    sizes = per.groupBy("composer").agg((-F.sum("c")).alias("n")).select(F.array("composer").alias("who"), "n", F.lit(0).cast("long").alias("v"))
    sizes = sizes.unionByName(t.agg(F.sum("c").alias("n"), F.count("*").alias("v")).select(nobody.alias("who"), "n", "v"))
    sizes = sizes.unionByName(t.where(F.col("k") <= (2 if exact_types else 1)).groupBy("who").agg((-F.count("*")).alias("v")).select("who", F.lit(0).cast("long").alias("n"), "v"))
    within = F.size(F.array_except("who", "out")) == 0
    asked = queries.select("out", "query").distinct()
    model = asked.select("out").distinct().crossJoin(F.broadcast(sizes)).where(within).groupBy("out").agg(F.sum("n").alias("n"), F.sum("v").alias("v"))
    seen = t.select(F.col("gram").alias("query"), nobody.alias("who"), "c").unionByName(per.select(F.col("gram").alias("query"), F.array("composer").alias("who"), (-F.col("c")).alias("c")))
    c = asked.select("out", "query", parts()).join(merged(seen), ["query", "who"]).groupBy("out", "query").agg(F.sum("c").alias("c"))
    rows = asked.join(merged(c), ["out", "query"], "left").join(merged(model), "out").withColumn("c", F.coalesce("c", F.lit(0)))
    return rows.select("out", "query", "c", laplace(F.col("c"), F.col("n"), F.col("v"), alpha).alias("p"))


def work_counts(counts: DataFrame) -> DataFrame:
    """Every work counts a type once."""
    return counts.withColumn("c", F.lit(1).cast("long"))


def document_frequency_without(counts: DataFrame, discount: DataFrame, queries: DataFrame, m: int) -> DataFrame:
    """(out, query, works, df): the share of the works outside the composers ``out`` that hold the
    query; for one that none of them holds, the chain over work counts, at most 1 / (works + 1)."""
    docs = work_counts(counts.withColumn("g", F.lit("all")))
    tables = net_counts(docs, "g", "composer")
    chain = kneser_ney_without(tables, discount, queries.withColumn("g", F.lit("all")), m, window=False)
    within = F.size(F.array_except("who", "out")) == 0
    held = tables[0].where((F.col("kind") == "c") & (F.col("o") == m)).select(F.col("key").alias("query"), "who", "v")
    asked = queries.select("out", "query").distinct()
    d = asked.select("out", "query", parts()).join(merged(held), ["query", "who"]).groupBy("out", "query").agg(F.sum("v").alias("d"))
    per = counts.groupBy("composer").agg(F.countDistinct("work_id").alias("w"))
    works = per.agg(F.sum("w").alias("w")).select(F.array().cast("array<string>").alias("who"), "w").unionByName(per.select(F.array("composer").alias("who"), (-F.col("w")).alias("w")))
    nw = asked.select("out").distinct().crossJoin(F.broadcast(works)).where(within).groupBy("out").agg(F.greatest(F.sum("w"), F.lit(1)).alias("nw"))
    rows = chain.join(merged(d), ["out", "query"], "left").join(merged(nw), "out")
    unseen = F.least(1 / (F.col("nw") + 1), F.col("p") * F.col("n_1") / F.col("nw"))
    return rows.select("out", "query", F.coalesce("d", F.lit(0)).alias("works"), F.when(F.col("d") > 0, F.col("d") / F.col("nw")).otherwise(unseen).alias("df"))


def mixture(pc, ps, lam: float):
    """lam * composer + (1 - lam) * stratum; the stratum alone where there is no composer model."""
    return F.coalesce(lam * pc + (1 - lam) * ps, ps)


def lambda_grid(scored: DataFrame, steps: int = 20) -> DataFrame:
    """(lam, loglik) of a mixture of columns pc and ps over a grid."""
    grid = F.explode(F.transform(F.sequence(F.lit(0), F.lit(steps)), lambda i: i / F.lit(steps))).alias("lam")
    rows = scored.select("pc", "ps", grid)
    return rows.groupBy("lam").agg(F.sum(F.ln(F.greatest(F.coalesce(F.col("lam") * F.col("pc") + (1 - F.col("lam")) * F.col("ps"), F.col("ps")), F.lit(1e-300)))).alias("loglik"))
