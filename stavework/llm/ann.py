"""Approximate nearest neighbours by multiprobe p-stable hashing.

h(x) = floor((a.x + b) / w) with Gaussian a, ``bits`` of them per table. A query
visits its own bucket and the perturbed ones in order of estimated success: the
smallest sum of squared distances from its projections to the cells' borders. The
candidates of all tables are merged and ranked by the exact cosine.

Buckets meet their probes by an equi-join on (table, bucket, slice); a bucket
with many vectors is cut into slices of bounded size, each probed like the bucket,
so nothing is capped. Queries that found fewer than ``k`` are compared with every
vector, in blocks.

The number of projections of a table follows the number of rows, the number of probes
follows from a bounded sample of queries: their exact neighbours are found in one pass,
and as many buckets are probed as it takes to meet the wanted share of them. A bucket returns at most ``k`` candidates per query (and those
tied with the last): no pair of vector and query is ever a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stavework.llm._env import write_table
from stavework.llm.vectors import matrix, unit_vectors


def _hashes(size: int, tables: int, bits: int, width: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng([seed, size])
    return rng.normal(size=(tables, bits, size)), rng.uniform(0, width, (tables, bits))


def _names(cells: np.ndarray) -> np.ndarray:
    """One long per row of lattice coordinates (equal rows, equal names)."""
    h = np.zeros(cells.shape[:-1], np.int64)
    for j in range(cells.shape[-1]):
        h = h * 1_000_003 + cells[..., j]
    return h


def probes(p: np.ndarray, width: float, n: int, reach: int = 2) -> np.ndarray:
    """The n most promising cells of each row of projections, best first.

    The score is a sum over the coordinates, so keeping the n best partial sums after
    every coordinate loses none of the n best.
    """
    cell = np.floor(p / width)
    f = p - cell * width
    shifts = np.arange(-reach, reach + 1)
    gap = np.where(shifts > 0, shifts * width - f[..., None], np.where(shifts < 0, f[..., None] - (shifts + 1) * width, 0.0)) ** 2
    cost, chosen = np.zeros((len(p), 1)), np.zeros((len(p), 1, 0), np.int64)
    for j in range(p.shape[1]):
        total = (cost[:, :, None] + gap[:, j, None, :]).reshape(len(p), -1)
        best = np.argsort(total, axis=1, kind="stable")[:, :n]
        cost = np.take_along_axis(total, best, 1)
        chosen = np.concatenate((np.take_along_axis(chosen, (best // len(shifts))[:, :, None], 1), shifts[best % len(shifts)][:, :, None]), 2)
    return cell[:, None, :].astype(np.int64) + chosen


def _scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Cosines of paired rows on the original vectors, each computed alike wherever it is met."""
    return (q * x).sum(1) / (np.sqrt((q * q).sum(1)) * np.sqrt((x * x).sum(1)))


SAMPLE = 64
#: Rows that a table of the fewest projections is made for, and the probes that are tried.
ROWS_FOR_LEAST, LEAST_BITS, LADDER = 128_000, 5, (32, 64, 128, 256, 512, 1024, 2048, 4096)


def _exact(sample: dict[int, tuple[np.ndarray, np.ndarray]], k: int):
    """The k nearest of each sampled query within a batch of rows; ``sample``: ids and unit vectors by size."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for size, part in pdf.groupby(pdf.v.map(len)):
                if size not in sample:
                    continue
                names, q = sample[size]
                s = q @ matrix(part.v).T
                s[names[:, None] == part.id.to_numpy()[None, :]] = -9
                at = np.argpartition(-s, min(k, s.shape[1]) - 1, axis=1)[:, :k]
                r, c = np.repeat(np.arange(len(names)), at.shape[1]), at.ravel()
                keep = s[r, c] > -8
                r, c = r[keep], c[keep]
                yield pd.DataFrame({"query_id": names[r], "vec_id": part.id.to_numpy()[c], "score": s[r, c], "v": part.v.to_numpy()[c]})

    return run


def probes_for(rows: DataFrame, is_query, k: int, recall: float, tables: int, bits: int, width: float, seed: int) -> int:
    """How many buckets of each table a query visits so that a sample of queries (``SAMPLE`` of
    them, by a hash of the id) meets ``recall`` of its exact neighbours; the last of ``LADDER`` if
    that does not do either."""
    asked = rows.where(is_query).orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(SAMPLE).select("id", "v").collect()
    by_size: dict[int, list] = {}
    for r in asked:
        by_size.setdefault(len(r["v"]), []).append(r)
    sample = {n: (np.array([r["id"] for r in rs]), matrix(bytes(r["v"]) for r in rs)) for n, rs in by_size.items()}
    if not sample:
        return LADDER[0]
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    near = rows.select("id", "v").mapInPandas(_exact(sample, k), "query_id long, vec_id long, score double, v binary").withColumn("k", F.row_number().over(order)).where(F.col("k") <= k).collect()
    first = []  # the number of the probe that meets each neighbour
    for size, (names, q) in sample.items():
        mine = [r for r in near if len(r["v"]) == size]
        if not mine:
            continue
        a, b = _hashes(size // 8, tables, bits, width, seed)
        x, of = matrix(bytes(r["v"]) for r in mine), np.searchsorted(np.sort(names), [r["query_id"] for r in mine])
        of = np.argsort(names)[of]
        at = np.full(len(mine), LADDER[-1])
        for t in range(tables):
            visited = _names(probes(q @ a[t].T + b[t], width, LADDER[-1]))
            hit = visited[of] == _names(np.floor((x @ a[t].T + b[t]) / width).astype(np.int64))[:, None]
            at = np.minimum(at, np.where(hit.any(1), hit.argmax(1), LADDER[-1]))
        first.append(at)
    met = np.concatenate(first) if first else np.zeros(0)
    return next((n for n in LADDER if len(met) == 0 or (met < n).mean() >= recall), LADDER[-1])


def _rank(k: int):
    def run(key, index: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = []
        for size, x in index.groupby(index.raw.map(len)) if len(index) and len(asked) else []:
            a = asked[asked.raw.map(len) == size].drop_duplicates("id")
            if not len(a):
                continue
            xs, ids = matrix(x.raw), x.id.to_numpy()
            xu = xs / np.abs(xs).max(1)[:, None]
            xu /= np.sqrt((xu * xu).sum(1))[:, None]
            for i in range(0, len(a), 512):
                qs, names = matrix(a.raw[i : i + 512]), a.id.to_numpy()[i : i + 512]
                qu = qs / np.abs(qs).max(1)[:, None]
                s = (qu / np.sqrt((qu * qu).sum(1))[:, None]) @ xu.T
                s[names[:, None] == ids[None, :]] = -9
                kth = np.partition(s, -k, axis=1)[:, -k] if s.shape[1] > k else np.full(len(s), -2.0)
                r, c = np.nonzero((s >= kth[:, None] - 1e-9) & (s > -8))
                d = pd.DataFrame({"query_id": names[r], "vec_id": ids[c], "score": _scores(qs[r], xs[c])})
                d = d.sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True], kind="stable")
                out.append(d.groupby("query_id", sort=False).head(k))
        return pd.concat(out) if out else pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype=float)})

    return run


def search(vectors: DataFrame, is_query, *, vec_id: str = "vec_id", embedding: str = "embedding", k: int = 5, tables: int = 5, bits: int | None = None, width: float = 1.5, n_probes: int | None = None, recall: float = 0.97, seed: int = 3, slice_rows: int = 8192) -> DataFrame:
    """(query_id, rank, vec_id, score): up to ``k`` nearest by cosine of each query.

    ``is_query``: a condition on column ``id``. Vectors that are null, empty, zero or
    hold null or non-finite components take no part, nor does a null id; vectors of
    other lengths than the query's are no candidates. Ties go to the smaller vec_id,
    a vector never finds its own id, repeated rows of an id count once. An empty
    table gives an empty result. ``bits`` and ``n_probes``: by the rows and by a sample
    (see ``probes_for``) unless they are given.
    """
    rows = write_table(unit_vectors(vectors, vec_id, embedding).where("v is not null and id is not null").dropDuplicates(["id"]), "ann-vectors").df()

    if bits is None:
        bits = LEAST_BITS + max(0, int(np.ceil(np.log2(max(rows.count(), 1) / ROWS_FOR_LEAST) / 2)))
    if n_probes is None:
        n_probes = probes_for(rows, is_query, k, recall, tables, bits, width, seed)

    def bucketed(query: bool):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for size, part in pdf.groupby(pdf.v.map(len)):
                    a, b = _hashes(size // 8, tables, bits, width, seed)
                    x = matrix(part.v)
                    for t in range(tables):
                        p = x @ a[t].T + b[t]
                        if query:
                            names = _names(probes(p, width, n_probes))
                            at = np.repeat(np.arange(len(part)), names.shape[1])
                        else:
                            names, at = _names(np.floor(p / width).astype(np.int64)), np.arange(len(part))
                        yield pd.DataFrame({"t": t, "bucket": names.ravel(), "id": part.id.to_numpy()[at], "raw": part.raw.to_numpy()[at]})

        return run

    schema = "t int, bucket long, id long, raw binary"
    index = rows.mapInPandas(bucketed(False), schema)
    slices = write_table(index.groupBy("t", "bucket").agg(F.count("*").alias("n")).withColumn("slices", F.ceil(F.col("n") / slice_rows).cast("int")).drop("n"), "ann-buckets").df()
    index = index.join(slices, ["t", "bucket"]).withColumn("slice", F.pmod(F.xxhash64("id"), F.col("slices")).cast("int")).drop("slices")
    asked = rows.where(is_query).mapInPandas(bucketed(True), schema).join(slices, ["t", "bucket"]).withColumn("slice", F.explode(F.expr("sequence(0, slices - 1)"))).drop("slices")
    near = index.groupBy("t", "bucket", "slice").cogroup(asked.groupBy("t", "bucket", "slice")).applyInPandas(_rank(k), "query_id long, vec_id long, score double")
    found = write_table(near.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")), "ann-found").df()
    queries = rows.where(is_query)
    lacking = queries.join(found.groupBy("query_id").agg(F.count("*").alias("c")), F.col("id") == F.col("query_id"), "left").where(F.coalesce("c", F.lit(0)) < k).select("id", "raw")
    lacking = write_table(lacking, "ann-lacking").df()
    open_ = lacking.count()
    if open_:
        blocks, slabs = -(-open_ // slice_rows), -(-rows.count() // slice_rows)
        part = lambda n, salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(n)).cast("int")
        left = rows.select("id", "raw", part(slabs, 1).alias("slab"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
        right = lacking.select("id", "raw", part(blocks, 2).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(slabs - 1))).alias("slab"))
        all_ = left.groupBy("slab", "block").cogroup(right.groupBy("slab", "block")).applyInPandas(_rank(k), "query_id long, vec_id long, score double")
        found = found.unionByName(all_).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
