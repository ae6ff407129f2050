"""N-gram Jaccard join by token-combination prefixes.

Every text becomes its set of distinct word shingles. In a global order of tokens
(rare ones first, by a sketch of frequencies; ties by hash) two sets of similarity t
share a token among their first n - ceil(t n) + 1, and two tokens once these
prefixes are extended by one. So the index holds
  * single tokens where few prefixes hold them: groups of bounded size give pairs with
    the number of tokens they share, and a pair whose prefixes cannot reach the
    similarity any more is dropped before its sets are fetched;
  * two-token combinations where many do. First every document of such a token is
    compared with the token's smallest one, which merges groups of near copies in
    linear time. What is left are the pairs of different parts: the first token is the
    key of the exchange, the second is intersected inside the group, and a pair
    belongs to the first token it shares there. Groups are cut into blocks; blocks of
    one and the same part never meet; sets are fetched only by documents that share a
    combination, and a block emits a spanning forest.
Equal sets are one vertex throughout.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stavework.llm._env import drop, free_shuffles, lean_memory, project, trim_memory, write_table
from stavework.llm._words import U, chunks, components, distinct_sorted, rolling, words_of
from stavework.operators.components import connected_components

SKETCH_BITS, SLICES = 22, 16
#: Rows of at most so many bytes are broadcast; larger tables are joined by exchange.
BROADCAST_BYTES = 16_000_000
#: Candidate pairs, and tokens of one side of a block, that a task verifies at once.
PART_PAIRS, BLOCK_TOKENS = 8_000, 1_000_000


def shingle_sets(texts: list[bytes], words: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text; a shorter text is one shingle."""
    lean_memory()
    w = words_of(texts, lower=True)
    for a, b in zip(w.first.tolist(), w.first[1:].tolist()):
        h = w.hash[a:b]
        yield distinct_sorted(rolling(h, min(words, len(h)))) if len(h) else h


def _sketch(words: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = np.zeros(1 << SKETCH_BITS, np.uint32)
        for pdf in batches:
            for _, texts in chunks(pdf.text.tolist(), pdf.text.tolist()):
                tokens = [s for s in shingle_sets(texts, words) if len(s)]
                if tokens:
                    cell, count = np.unique_counts((np.concatenate(tokens) >> U(64 - SKETCH_BITS)).astype(np.uint32))
                    seen[cell] += count.astype(np.uint32)
        trim_memory()
        if seen.any():
            packer = zstandard.ZstdCompressor(3)
            yield pd.DataFrame({"slice": np.arange(SLICES), "counts": [packer.compress(s.tobytes()) for s in np.split(seen, SLICES)]})

    return run


def _add_slices(pdf: pd.DataFrame) -> pd.DataFrame:
    total = np.zeros((1 << SKETCH_BITS) // SLICES, np.uint32)
    for c in pdf.counts:
        total += np.frombuffer(zstandard.ZstdDecompressor().decompress(c), np.uint32)
    return pd.DataFrame({"slice": pdf.slice.iloc[:1], "counts": [zstandard.ZstdCompressor(3).compress(total.tobytes())]})


def frequency_classes(docs: DataFrame, words: int) -> np.ndarray:
    """Class of each sketch cell: 0 for ordinary ones, else the logarithm of a count far
    above the mean. Of fixed size; it only shapes the order, any order gives exact results."""
    parts = docs.select("text").mapInPandas(_sketch(words), "slice int, counts binary")
    half = parts.groupBy("slice", F.pmod(F.spark_partition_id(), F.lit(64)).alias("p")).applyInPandas(_add_slices, "slice int, counts binary")
    rows = half.groupBy("slice").applyInPandas(_add_slices, "slice int, counts binary").collect()
    counts = np.zeros((SLICES, (1 << SKETCH_BITS) // SLICES), np.uint32)
    for r in rows:
        counts[r["slice"]] = np.frombuffer(zstandard.ZstdDecompressor().decompress(r["counts"]), np.uint32)
    mean = counts.mean()
    high = counts > mean + 6 * np.sqrt(mean) + 32
    return np.where(high, np.frexp(counts.astype(float))[1], 0).astype(np.uint8).ravel()


def prefix_keys(s: np.ndarray, classes: np.ndarray, num: int, den: int) -> np.ndarray:
    """The extended prefix of a set, in the global order: class, then hash."""
    n = len(s)
    length = min(n, n - -(-num * n // den) + 2)
    key = (classes[(s >> U(64 - SKETCH_BITS)).astype(np.int64)].astype(U) << U(56)) | (s >> U(8))
    return np.sort(np.partition(key, length - 1)[:length]) if length < n else np.sort(key)


def _prefixes(words: int, classes, num: int, den: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("key", pa.binary()), ("prefix", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, texts in chunks(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                n, key, prefix = [], [], []
                for s in shingle_sets(texts, words):
                    n.append(len(s))
                    key.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                    prefix.append(prefix_keys(s, classes.value, num, den).astype(np.int64) if len(s) else None)
                yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.array(prefix, pa.list_(pa.int64()))], schema=schema)
        trim_memory()

    return run


def _sets(words: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for ids, texts in chunks(pdf.doc_id.tolist(), pdf.text.tolist()):
                yield pd.DataFrame({"doc_id": ids, "s": [s.tobytes() for s in shingle_sets(texts, words)]})
        trim_memory()

    return run


def _matrix(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, int]:
    """(row, column, columns) of the tokens that at least two of the sets hold."""
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, col, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    new = np.cumsum(count > 1) - 1
    keep = count[col] > 1
    return row[keep], new[col[keep]], int((count > 1).sum())


def overlaps(sets: list[np.ndarray], split: int, width: int = 1024) -> np.ndarray:
    """Sizes of all intersections between the first ``split`` sets and the others."""
    row, col, n = _matrix(sets)
    out = np.zeros((split, len(sets) - split), np.float32)
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    for a in range(0, n, width):
        i, j = np.searchsorted(col, [a, a + width])
        m = np.zeros((len(sets), min(width, n - a)), np.float32)
        m[row[i:j], col[i:j] - a] = 1
        out += m[:split] @ m[split:].T
    return out


def _linked(inter: np.ndarray, na: np.ndarray, nb: np.ndarray, num: int, den: int) -> np.ndarray:
    inter = np.rint(inter).astype(np.int64)
    return inter * den >= num * (na + nb - inter)


def _forest(names_a: np.ndarray, names_b: np.ndarray, linked: np.ndarray) -> pd.DataFrame:
    r, c = np.nonzero(linked)
    names = np.concatenate((names_a, names_b))
    label = components(r, c + len(names_a), len(names))
    hit = label != np.arange(len(names))
    return pd.DataFrame({"a": names[hit], "b": names[label[hit]]})


NO_LINKS = pd.DataFrame({"a": pd.Series(dtype="int64"), "b": pd.Series(dtype="int64")})


def _verify_pairs(num: int, den: int):
    def run(key, pairs: pd.DataFrame, sets: pd.DataFrame) -> pd.DataFrame:
        if not len(pairs):
            return NO_LINKS
        held = {i: np.frombuffer(s, U) for i, s in sorted(zip(sets.doc_id, sets.s), reverse=True)}
        found = []
        for a, mates in pairs.groupby("a").b:
            others = mates.to_numpy()
            x, ys = held[a], [held[b] for b in others]
            at = np.minimum(np.searchsorted(x, flat := np.concatenate(ys)), len(x) - 1)
            inter = np.add.reduceat((x[at] == flat).astype(np.int64), np.concatenate(([0], np.cumsum([len(y) for y in ys])[:-1])))
            good = _linked(inter, np.int64(len(x)), np.array([len(y) for y in ys]), num, den)
            found.append(pd.DataFrame({"a": a, "b": others[good]}))
        return pd.concat(found)

    return run


def _first_here(left: pd.DataFrame, right: pd.DataFrame, token: int) -> np.ndarray:
    """Pairs of different parts that share two frequent tokens, ``token`` the first of them."""
    both = pd.concat((left, right))
    heads = [np.sort(np.asarray(f, np.int64)) for f in both.heads]
    cut = len(left)
    shared = overlaps(heads, cut)
    before = overlaps([h[h < token] for h in heads], cut)
    return (shared > 1.5) & (before < 0.5) & (left.part.to_numpy()[:, None] != right.part.to_numpy()[None, :])


def _sides(pdf: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
    left = pdf[pdf.side == 0]
    return left, left if bool(pdf.same.iloc[0]) else pdf[pdf.side == 1]


def _needed(pdf: pd.DataFrame) -> pd.DataFrame:
    """Rows of a block's documents that take part in a pair there."""
    left, right = _sides(pdf)
    if not len(left) or not len(right):
        return pdf[:0]
    mine = _first_here(left, right, int(pdf.token.iloc[0]))
    rows = [left[mine.any(1)], right[mine.any(0)]]
    return rows[0] if left is right else pd.concat(rows)


def _verify_blocks(num: int, den: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        left, right = _sides(pdf)
        if not len(left) or not len(right):
            return NO_LINKS
        mine = _first_here(left, right, int(pdf.token.iloc[0]))
        sets = [np.frombuffer(s, U) for s in pd.concat((left, right)).s]
        n, cut = np.array([len(s) for s in sets]), len(left)
        linked = _linked(overlaps(sets, cut), n[:cut, None], n[None, cut:], num, den) & mine
        return _forest(left.doc_id.to_numpy(), right.doc_id.to_numpy(), linked)

    return run


def _joined(big: DataFrame, small: DataFrame, rows: int, width: int, on) -> DataFrame:
    """Inner join; the small side is broadcast only if its counted rows fit the bound."""
    return big.join(F.broadcast(small) if rows * width <= BROADCAST_BYTES else small, on)


def jaccard_classes(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", words: int = 5, similarity: tuple[int, int] = (80, 100), rare: int = 64, block: int = 1024) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id.

    Two documents link when intersection / union >= similarity (a fraction above 1/2);
    component_id is the smallest doc_id reachable by links, itself included. Null,
    empty and blank texts have the empty set and link with nothing; equal sets (ties,
    repeated rows) always link. Ids are expected to be unique: rows that share one are
    one vertex. A null id keeps a null component. An empty table gives an empty result.
    """
    num, den = similarity
    if 2 * num <= den:
        raise ValueError("two-token combinations need a similarity above one half")
    spark = docs.sparkSession
    texts = project(docs, doc_id=doc_id, text=text).withColumn("doc_id", F.col("doc_id").cast("long"))
    classes = spark.sparkContext.broadcast(frequency_classes(texts, words))  # 4 MB, whatever the input
    free_shuffles(spark)
    with_prefixes = write_table(texts.mapInArrow(_prefixes(words, classes, num, den), "doc_id long, n long, key binary, prefix array<long>"), "shingle-prefixes")
    rows = write_table(with_prefixes.df().select("doc_id", "n", "key", F.element_at("prefix", -1).alias("last")), "shingle-sets").df()
    known = rows.where("key is not null and doc_id is not null")
    heads = write_table(known.groupBy("key").agg(F.min("doc_id").alias("rep")), "distinct-sets").df()
    # a vertex is a set's smallest document; the prefixes of the others are left out
    copies = write_table(known.join(heads, "key").where("doc_id <> rep").select(F.col("doc_id").alias("copy")).distinct(), "copies")
    small = copies.df().count() * 8 <= BROADCAST_BYTES
    not_copy = lambda t: t.join(F.broadcast(copies.df()) if small else copies.df(), F.col("doc_id") == F.col("copy"), "left_anti")
    # a set of one token is similar to its equals only
    postings = not_copy(with_prefixes.df().where("key is not null and doc_id is not null and n > 1")).select(F.explode("prefix").alias("token"), "doc_id", "n")
    counts = write_table(postings.groupBy("token").agg(F.count("*").alias("df")).where("df > 1"), "shared-tokens")
    free_shuffles(spark)
    held = write_table(postings.join(counts.df(), "token"), "shared-postings")
    drop(with_prefixes, counts)
    free_shuffles(spark)

    # documents with frequent tokens in their extended prefix
    many = held.df().where(F.col("df") > rare)
    frequent = write_table(many.groupBy("doc_id", "n").agg(F.collect_list("token").alias("heads")), "frequent-heads")
    # single tokens: pairs of bounded groups, with the number of tokens they share
    few = held.df().where(F.col("df") <= rare)
    x, y = few.select("token", F.col("doc_id").alias("a"), F.col("n").alias("na")), few.select("token", F.col("doc_id").alias("b"), F.col("n").alias("nb"))
    fits = (F.least("na", "nb") * den >= F.greatest("na", "nb") * num) & (F.col("a") < F.col("b"))
    pairs = write_table(x.join(y, "token").where(fits).groupBy("a", "na", "b", "nb").agg(F.count("*").alias("c")), "candidate-pairs")
    ends = known.groupBy("doc_id", "n").agg(F.max("last").alias("last")).join(frequent.df().select("doc_id", "n", F.size("heads").alias("f")), ["doc_id", "n"], "left").select("doc_id", "n", "last", F.coalesce("f", F.lit(0)).alias("f"))
    ends = write_table(ends, "prefix-ends")
    bounded = pairs.df()
    for k in "ab":
        bounded = bounded.join(ends.df().toDF(k, f"n{k}", f"last_{k}", f"f{k}"), [k, f"n{k}"])
    # what both hold up to the smaller of their last tokens is shared in the prefixes; behind it
    # lie ceil(t n) - 2 tokens of the set whose prefix ends there
    behind = lambda n: F.greatest(F.ceil(F.col(n) * num / den) - 2, F.lit(0))
    most = F.col("c") + F.least("fa", "fb") + F.when(F.col("last_a") <= F.col("last_b"), behind("na")).otherwise(behind("nb"))
    close = bounded.where(most * den >= (F.col("na") + F.col("nb") - most) * num).select("a", "b")
    # frequent tokens: every document with the token's smallest one
    least = many.groupBy("token").agg(F.min_by(F.struct("doc_id", "n"), "doc_id").alias("a"))
    to_least = many.join(least, "token").select(F.col("a.doc_id").alias("a"), F.col("a.n").alias("na"), F.col("doc_id").alias("b"), F.col("n").alias("nb")).where(fits).select("a", "b")
    close = write_table(close.unionByName(to_least).distinct(), "close-pairs")
    drop(pairs, ends)
    # neighbours of one smallest neighbour are verified together; large gatherings in parts
    lead = close.df().groupBy("b").agg(F.min("a").alias("lead"))
    labelled = close.df().join(lead.withColumnRenamed("b", "x"), F.col("a") == F.col("x"), "left").select(F.coalesce("lead", "a").alias("lead"), "a", "b")
    crowd = labelled.groupBy("lead").agg(F.ceil(F.count("*") / PART_PAIRS).cast("int").alias("parts"))
    tasks = write_table(labelled.join(crowd, "lead").withColumn("part", F.pmod(F.xxhash64("a", "b"), F.col("parts")).cast("int")).select("lead", "part", "a", "b"), "pair-tasks")
    wanted = write_table(tasks.df().select(F.explode(F.array("a", "b")).alias("id")).unionByName(frequent.df().where(F.size("heads") > 1).select(F.col("doc_id").alias("id"))).distinct(), "wanted-sets")
    drop(close)
    free_shuffles(spark)
    sets = write_table(_joined(texts, wanted.df(), wanted.df().count(), 16, F.col("doc_id") == F.col("id")).select("doc_id", "text").mapInPandas(_sets(words), "doc_id long, s binary"), "sets")
    needed = tasks.df().select("lead", "part", F.explode(F.array("a", "b")).alias("doc_id")).distinct().join(sets.df(), "doc_id").select(F.col("lead").alias("to_lead"), F.col("part").alias("to_part"), "doc_id", "s")
    links = [write_table(tasks.df().groupBy("lead", "part").cogroup(needed.groupBy("to_lead", "to_part")).applyInPandas(_verify_pairs(num, den), "a long, b long"), "pair-links")]
    drop(tasks, wanted)
    free_shuffles(spark)
    parts = write_table(connected_components(links[0].df(), "a", "b"), "parts")

    # combinations: documents with two frequent tokens, of different parts
    placed = frequent.df().where(F.size("heads") > 1).join(parts.df(), F.col("doc_id") == F.col("vertex"), "left").select("doc_id", "heads", "n", F.coalesce("component", "doc_id").alias("part"))
    nested = write_table(placed.select("doc_id", "heads", "n", "part", F.explode("heads").alias("token")), "combinations")
    weight = F.greatest(F.count("*") / block, F.sum("n") / BLOCK_TOKENS).alias("w")  # long sets make smaller blocks
    by_part = nested.df().groupBy("token", "part").agg(weight)
    # the largest part of a token meets the others, not itself
    plan = by_part.groupBy("token").agg(F.max_by("part", F.struct("w", "part")).alias("main"), F.max("w").alias("main_w"), F.sum("w").alias("w"), F.count("*").alias("k")).where("k > 1")
    plan = plan.select("token", "main", F.ceil(F.col("w") - F.col("main_w")).cast("int").alias("others"), F.ceil("main_w").cast("int").alias("mains"))
    plan = write_table(plan.withColumn("others", F.greatest("others", F.lit(1))), "combination-blocks")
    met = nested.df().join(plan.df(), "token").withColumn("h", F.xxhash64("doc_id"))
    rest = met.where("part <> main").withColumn("k", F.pmod("h", F.col("others")).cast("int"))
    rest = rest.withColumn("t", F.explode(F.expr("concat(transform(sequence(0, others - 1), j -> struct(least(k, j) as x, greatest(k, j) as y, int(j < k) as side)), transform(sequence(others, others + mains - 1), j -> struct(k as x, j as y, 0 as side)))")))
    most_ = met.where("part = main").withColumn("k", F.col("others") + F.pmod("h", F.col("mains")).cast("int"))
    most_ = most_.withColumn("t", F.explode(F.expr("transform(sequence(0, others - 1), j -> struct(j as x, k as y, 1 as side))")))
    columns = ["token", F.col("t.x").alias("x"), F.col("t.y").alias("y"), F.col("t.side").alias("side"), (F.col("t.x") == F.col("t.y")).alias("same"), "doc_id", "part", "heads"]
    schema = "token long, x int, y int, side int, same boolean, doc_id long, part long, heads array<long>"
    shared = write_table(rest.select(*columns).unionByName(most_.select(*columns)).groupBy("token", "x", "y").applyInPandas(_needed, schema), "shared-combinations")
    drop(nested, plan)
    links.append(write_table(shared.df().join(sets.df(), "doc_id").groupBy("token", "x", "y").applyInPandas(_verify_blocks(num, den), "a long, b long").distinct(), "combination-links"))
    drop(held, frequent, shared, sets, copies)
    free_shuffles(spark)

    # parts that combinations link become one
    label = lambda t, k: t.join(parts.df().toDF("v", "c"), F.col(k) == F.col("v"), "left").withColumn(k, F.coalesce("c", k)).drop("v", "c")
    joined = connected_components(label(label(links[1].df(), "a"), "b"), "a", "b").toDF("p", "whole")
    named = heads.join(parts.df(), F.col("rep") == F.col("vertex"), "left").select("key", F.coalesce("component", "rep").alias("part")).join(joined, F.col("part") == F.col("p"), "left").select("key", F.coalesce("whole", "part").alias("component"))
    full = rows.where("key is not null").select("doc_id", "n", "key").join(named, "key", "left").select("doc_id", "n", F.when(F.col("doc_id").isNotNull(), F.col("component")).alias("component"))
    empty = rows.where("key is null").select("doc_id", "n", F.col("doc_id").alias("component"))
    return full.unionByName(empty).select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))
