"""Embedding near-dedup: an exact metric range join over unit vectors.

cosine >= c is Euclidean distance <= eps = sqrt(2 - 2c). Pivots cut the space into
cells (nearest pivot). A vector x of cell i can only be linked with one of cell j if
    d(x, p_j) - d(x, p_i) <= 2 eps                                (triangle inequality)
    (d(x, p_j)^2 - d(x, p_i)^2) / (2 d(p_i, p_j)) <= eps          (distance to the border)
so it is replicated to those cells, the ones after its own only, and the cells are
joined independently. Cells that are too large are cut again by pivots of their own,
level by level, as long as that saves comparisons: what was replicated into a cell is
replicated to all of its parts that it may have a link in. Vectors of different
lengths are in different cells from the start. A cell's join is cut into blocks of
bounded size, so a cell with a third of all rows becomes many tasks. Identical vectors
are one vector with a weight, and inside a block links are counted and reduced to a
spanning forest: no pair leaves its task unless it joins two parts. The driver sees
no vector and no cell.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stavework.llm._env import Table, drop, write_table
from stavework.llm._words import components
from stavework.operators.components import connected_components
from stavework.llm.vectors import matrix, unit_vectors

#: Squared distances carry rounding errors of about 1e-15, distances up to 1e-7; bounds are wider.
SLACK = 1e-6
#: A cut is kept if it leaves this share of the comparisons, and so many times the rows, at most.
SAVES, GROWS = 0.75, 8
#: Rows of a cell that are compared with its pivots in one group.
GROUP_ROWS = 50_000
MEMBERS = "cell string, side int, id long, n long, v binary"


def _targets(x: np.ndarray, pivots: np.ndarray, eps: float) -> tuple[np.ndarray, np.ndarray]:
    """(home cell of each row, matrix of the cells that may hold a neighbour, home included)."""
    d2 = np.maximum(2 - 2 * x @ pivots.T, 0)
    home = d2.argmin(1)
    own = d2[np.arange(len(x)), home][:, None]
    apart = np.sqrt(np.maximum(2 - 2 * pivots @ pivots.T, 0))[home]
    near = (np.sqrt(d2) - np.sqrt(own) <= 2 * eps + SLACK) & (d2 - own <= 2 * eps * apart + SLACK)
    near[np.arange(len(x)), home] = True
    return home, near


def _cut(eps: float):
    """Rows of a cell for its parts: home rows once as such, and as replicas in later parts;
    replicas wherever they may meet a home row."""

    def run(pdf: pd.DataFrame, pivots: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf) or not len(pivots):
            return pdf[["cell", "side", "id", "n", "v"]][:0].assign(parent=pd.Series(dtype=str))
        home, near = _targets(matrix(pdf.v), matrix(pivots.sort_values("k").p), eps)
        own = pdf.side.to_numpy() == 0
        later = near & (np.arange(near.shape[1]) > home[:, None])
        r, c = np.nonzero(np.where(own[:, None], later, near))
        stay = np.flatnonzero(own)
        at, part, side = np.concatenate((stay, r)), np.concatenate((home[stay], c)), np.repeat([0, 1], [len(stay), len(r)])
        out = pdf.iloc[at]
        return pd.DataFrame({"cell": out.cell + "." + part.astype(str), "side": side, "id": out.id, "n": out.n, "v": out.v, "parent": out.cell})

    return run


def _cells(reps: DataFrame, eps: float, cell_rows: int, fan: int) -> list[Table]:
    """Tables of the members of all cells (``MEMBERS``): each is final or was not worth a cut."""
    size = lambda t, by: t.groupBy(by).agg(F.count_if(F.col("side") == 0).alias("own"), F.count_if(F.col("side") == 1).alias("other"))
    pairs = F.col("own") * (F.col("own") / 2 + F.col("other"))
    open_ = write_table(reps.select(F.concat(F.lit("l"), F.octet_length("v").cast("string")).alias("cell"), F.lit(0).alias("side"), "id", "n", "v"), "cells-0")
    done: list[Table] = []
    level = 0
    while True:
        level += 1
        sizes = size(open_.df(), "cell").withColumn("rows", F.col("own") + F.col("other"))
        large = sizes.where((F.col("rows") > cell_rows) & (F.col("own") > 1)).withColumns({"fan": F.least(F.lit(fan), F.greatest(F.lit(2), F.ceil(F.col("rows") / cell_rows))), "salts": F.ceil(F.col("rows") / GROUP_ROWS).cast("int"), "before": pairs})
        large = write_table(large, f"large-cells-{level}")
        if not large.df().count():
            return [*done, open_]
        plan = large.df()
        done.append(write_table(open_.df().join(plan.select("cell"), "cell", "left_anti"), f"small-cells-{level}"))
        members = open_.df().join(plan, "cell")
        # pivots: the first by a hash among the few rows of a cell that another hash lets through
        through = F.pmod(F.xxhash64("v", F.lit(-level)), F.lit(1 << 20)) < F.ceil(F.lit(1 << 20) * 4 * F.col("fan") / F.col("own"))
        order = Window.partitionBy("cell").orderBy(F.xxhash64("v", F.lit(level)), "id")
        pivots = members.where((F.col("side") == 0) & through).withColumn("k", F.row_number().over(order)).where(F.col("k") <= F.col("fan"))
        pivots = pivots.select(F.col("cell").alias("p_cell"), "k", F.col("v").alias("p"), F.explode(F.expr("sequence(0, salts - 1)")).alias("p_salt"))
        salted = members.select("cell", "side", "id", "n", "v", F.pmod(F.xxhash64("id", F.lit(level)), F.col("salts")).cast("int").alias("salt"))
        cut = write_table(salted.groupBy("cell", "salt").cogroup(pivots.groupBy("p_cell", "p_salt")).applyInPandas(_cut(eps), MEMBERS + ", parent string"), f"cut-cells-{level}")
        after = size(cut.df(), ["parent", "cell"]).groupBy("parent").agg(F.sum(pairs).alias("after"), F.sum(F.col("own") + F.col("other")).alias("rows_after"), F.max("own").alias("most"))
        kept = plan.join(after, F.col("cell") == F.col("parent")).where((F.col("after") < SAVES * F.col("before")) & (F.col("rows_after") <= GROWS * F.col("rows")) & (F.col("most") < F.col("own"))).select("parent")
        kept = write_table(kept, f"kept-cuts-{level}")
        done.append(write_table(open_.df().join(plan.select("cell"), "cell", "left_semi").join(kept.df(), F.col("cell") == F.col("parent"), "left_anti"), f"whole-cells-{level}"))
        following = write_table(cut.df().join(kept.df(), "parent", "left_semi").select("cell", "side", "id", "n", "v"), f"cells-{level}")
        drop(open_, large, cut, kept)
        open_ = following


def _block_links(a: np.ndarray, b: np.ndarray, wa: np.ndarray, wb: np.ndarray, cosine: float, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(weighted links of a's rows, of b's rows, component label over both)."""
    na, nb = len(a), len(b)
    la, lb = np.zeros(na, np.int64), np.zeros(nb, np.int64)
    shift = 0 if same else na
    label = np.arange(na + (0 if same else nb))
    for i in range(0, na, 256):
        s = a[i : i + 256] @ b.T
        r, c = np.nonzero(s >= cosine)
        r += i
        if same:
            r, c = r[r < c], c[r < c]
        la += np.bincount(r, wb[c], minlength=na).astype(np.int64)
        lb += np.bincount(c, wa[r], minlength=nb).astype(np.int64)
        u, v = label[r], label[c + shift]
        if (keep := u != v).any():
            label = components(u[keep], v[keep], len(label))[label]
    return la, lb, label


def _join(cosine: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, w = pdf.id.to_numpy(), pdf.n.to_numpy()
        first = pdf.side.to_numpy() == 0
        if bool(pdf.same.iloc[0]):
            a = matrix(pdf.v[first])
            la, lb, label = _block_links(a, a, w, w, cosine, True)
            links, names = la + lb, ids
        elif first.all() or not first.any():
            return pd.DataFrame({"id": [], "links": [], "root": []}).astype("int64")
        else:
            la, lb, label = _block_links(matrix(pdf.v[first]), matrix(pdf.v[~first]), w[first], w[~first], cosine, False)
            links, names = np.concatenate((la, lb)), np.concatenate((ids[first], ids[~first]))
        hit = links > 0
        return pd.DataFrame({"id": names[hit], "links": links[hit], "root": names[label[hit]]})

    return run


def near_duplicates(vectors: DataFrame, *, vec_id: str = "vec_id", embedding: str = "embedding", cosine: float = 0.9, cell_rows: int = 4096, fan: int = 32, block_rows: int = 8192, slab_rows: int = 16384) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Vectors that are null, empty, zero or hold null or non-finite components link
    with nothing, nor do vectors of different lengths. Identical vectors (ties) link
    with each other. Ids are expected to be unique; rows that share one are treated
    as one vertex. A null id is no vertex: 0 links and no component. An empty table
    gives an empty result. Cells of more than ``cell_rows`` rows are cut by up to
    ``fan`` pivots each while that saves comparisons (see ``SAVES``, ``GROWS``).
    """
    rows_table = write_table(unit_vectors(vectors, vec_id, embedding).select("id", "v"), "vectors")
    rows = rows_table.df()
    reps = write_table(rows.where("v is not null and id is not null").groupBy("v").agg(F.min("id").alias("id"), F.count("*").alias("n")), "distinct-vectors").df()
    eps = float(np.sqrt(max(2 - 2 * cosine, 0)))
    cells = _cells(reps, eps, cell_rows, fan)
    members = reduce(DataFrame.unionByName, [t.df() for t in cells])
    sizes = members.groupBy("cell").agg(F.count_if(F.col("side") == 0).alias("own"), F.count_if(F.col("side") == 1).alias("other"))
    plan = write_table(sizes.select("cell", F.greatest(F.ceil(F.col("own") / block_rows), F.lit(1)).cast("int").alias("blocks"), F.ceil(F.col("other") / slab_rows).cast("int").alias("slabs")), "cell-blocks")
    placed = members.join(plan.df(), "cell").withColumn("k", F.pmod(F.xxhash64("id", F.lit(7)), F.when(F.col("side") == 0, F.col("blocks")).otherwise(F.col("slabs"))).cast("int"))
    # own block k meets own blocks (as the left side of later ones) and every slab
    own = placed.where("side = 0").withColumn("t", F.explode(F.expr("concat(transform(sequence(0, blocks - 1), j -> struct(least(k, j) as a, greatest(k, j) as b, int(j < k) as side)), transform(filter(sequence(0, slabs), j -> j < slabs), j -> struct(k as a, blocks + j as b, 0 as side)))")))
    other = placed.where("side = 1").withColumn("t", F.explode(F.expr("transform(sequence(0, blocks - 1), j -> struct(j as a, blocks + k as b, 1 as side))")))
    tasks = own.unionByName(other).select("cell", F.col("t.a").alias("a"), F.col("t.b").alias("b"), F.col("t.side").alias("side"), (F.col("t.a") == F.col("t.b")).alias("same"), "id", "n", "v")
    found = write_table(tasks.groupBy("cell", "a", "b").applyInPandas(_join(cosine), "id long, links long, root long"), "links").df()
    drop(plan, *cells)
    links = found.groupBy("id").agg(F.sum("links").alias("others"))
    parts = connected_components(found, "id", "root")
    # identical vectors hang on their representative
    summary = reps.join(links, "id", "left").join(parts, F.col("id") == F.col("vertex"), "left").select("v", (F.coalesce("others", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    valid = rows.where("v is not null and id is not null").join(summary, "v").select("id", "n_links", "component_id")
    rest = rows.where("v is null or id is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return valid.unionByName(rest).select(F.col("id").alias("vec_id"), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
