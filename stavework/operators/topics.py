"""Latent Dirichlet allocation without a model in one place: neither the driver nor any task holds
the weights of all words.

Rows are packed into blocks of so many words, the vocabulary is cut into ranges of the words' hash.
In each step a block gets the weights of its own words from the ranges and sends its expected counts
back to them, one packed row per block and range; what a task holds is bounded by a block's size.
"""

from __future__ import annotations

import gc

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stavework.sources.tables import discard, scratch, store

#: Words of a block (its last row may exceed them), and words of blocks that one range takes.
BLOCK_WORDS, RANGE_WORDS = 1_000_000, 250_000
#: A row's mixture is settled when its mean change is no larger; entries that are worked on at once.
SETTLED, AT_ONCE = 1e-3, 1 << 16

BLOCKS = "block long, words array<string>, keys binary, ends binary, cols binary, counts binary"
PLACED = "block long, cuts binary, ends binary, cols binary, counts binary"
RANGES = "part long, size long, words array<string>, blocks array<long>, ends array<long>, at binary"
TO_BLOCKS = "block long, part long, weights binary, totals binary"
TO_RANGES = "part long, block long, counts binary"


def digamma(x: np.ndarray) -> np.ndarray:
    """The derivative of log gamma for positive numbers."""
    y, low = x + 6.0, np.zeros_like(x)
    for i in range(6):
        low += 1.0 / (x + i)
    r = 1.0 / (y * y)
    return np.log(y) - 0.5 / y - r * (1 / 12 - r * (1 / 120 - r * (1 / 252 - r * (1 / 240 - r * (5 / 660 - r * 691 / 32760))))) - low


def first_weights(keys: np.ndarray, k: int, seed: int) -> np.ndarray:
    """(k, words): draws near Gamma(100, 1/100) that follow from the word, topic and seed only
    (Wilson and Hilferty's cube of a normal)."""

    def uniform(salt: int) -> np.ndarray:
        z = keys + np.uint64((seed * 2654435761 + salt * 0x9E3779B97F4A7C15) % 2**64)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
        return ((z ^ (z >> np.uint64(31))) >> np.uint64(11)).astype(float) * 2.0**-53 + 2.0**-54

    normal = [np.sqrt(-2 * np.log(uniform(2 * t + 1))) * np.cos(2 * np.pi * uniform(2 * t + 2)) for t in range(k)]
    return (1 - 1 / 900 + np.array(normal).reshape(k, -1) / 30) ** 3


def expected_counts(ends: np.ndarray, cols: np.ndarray, counts: np.ndarray, weights: np.ndarray, alpha: float) -> np.ndarray:
    """(k, words): expected counts of a block's words in the topics; rows are entries up to ``ends``,
    ``weights`` (k, words) the exponent of the expected log share of a word in a topic.

    Every row starts from an even mixture and is worked on until it is settled by itself."""
    k, n = weights.shape
    share = np.empty((k, len(cols)))
    begins = np.concatenate([[0], ends[:-1]])
    row = 0
    while row < len(ends):
        upto = max(row + 1, int(np.searchsorted(ends, begins[row] + AT_ONCE, "right")))
        lo, hi = begins[row], ends[upto - 1]
        beta, c = weights[:, cols[lo:hi]], counts[lo:hi].astype(float)
        lens = (ends - begins)[row:upto]
        final = np.empty((k, upto - row))
        left, b, x, size = np.arange(upto - row), beta, c, lens
        gamma = np.ones((k, len(left)))
        theta = np.exp(digamma(gamma) - digamma(gamma.sum(axis=0)))
        while len(left):
            ratio = x / ((np.repeat(theta, size, axis=1) * b).sum(axis=0) + 1e-100)
            new = alpha + theta * np.add.reduceat(ratio * b, np.cumsum(size) - size, axis=1)
            moves = np.abs(new - gamma).mean(axis=0) > SETTLED
            gamma, theta = new, np.exp(digamma(new) - digamma(new.sum(axis=0)))
            if not moves.all():
                final[:, left[~moves]] = theta[:, ~moves]
                kept = np.repeat(moves, size)
                left, gamma, theta, b, x, size = left[moves], gamma[:, moves], theta[:, moves], b[:, kept], x[kept], size[moves]
        mixed = np.repeat(final, lens, axis=1) * beta
        share[:, lo:hi] = mixed * (c / (mixed.sum(axis=0) + 1e-100))
        row = upto
    return np.array([np.bincount(cols, weights=share[t], minlength=n) for t in range(k)])


def _numbers(column, kind) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), kind) for x in column]


def _bytes(arrays) -> pa.Array:
    return pa.array([np.ascontiguousarray(a).tobytes() for a in arrays], pa.binary())


def _keys(words: pa.Array) -> np.ndarray:
    """64-bit hashes that order the words; words of one hash are still told apart."""
    return pd.util.hash_array(words.to_numpy(zero_copy_only=False).astype(object), categorize=False)


def _block(number: int, texts: list[pa.Array], lens: list[np.ndarray]) -> pa.RecordBatch:
    coded = pa.chunked_array(texts).combine_chunks().dictionary_encode()
    coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
    words, codes = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    keys, by_word = _keys(words), np.empty(len(words), np.int64)
    by_word[pc.sort_indices(words).to_numpy()] = np.arange(len(words))
    order = np.lexsort((by_word, keys))
    place = np.empty(len(words), np.int64)
    place[order] = np.arange(len(words))
    lens = np.concatenate(lens)
    entry, count = np.unique(np.repeat(np.arange(len(lens)), lens) * len(words) + place[codes], return_counts=True)
    ends = np.cumsum(np.bincount(entry // len(words), minlength=len(lens)))
    lists = pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words.take(pa.array(order)))
    data = [pa.array([number], pa.int64()), lists, *[_bytes([a]) for a in (keys[order], ends, (entry % len(words)).astype(np.int32), count.astype(np.int32))]]
    return pa.RecordBatch.from_arrays(data, ["block", "words", "keys", "ends", "cols", "counts"])


def _pack(batches, limit: int):
    """Rows of words as blocks of ``limit`` words or little more."""
    from pyspark import TaskContext

    number, texts, lens, held = TaskContext.get().partitionId() << 32, [], [], 0
    for batch in batches:
        lists = batch.column(0)
        flat, sizes = lists.flatten(), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, row = np.cumsum(sizes), 0
        while row < len(sizes):
            begin = ends[row] - sizes[row]
            upto = min(len(sizes), int(np.searchsorted(ends, begin + limit - held)) + 1)
            texts.append(flat.slice(begin, ends[upto - 1] - begin))
            lens.append(sizes[row:upto])
            held, row = held + int(ends[upto - 1] - begin), upto
            if held >= limit:
                yield _block(number, texts, lens)
                number, texts, lens, held = number + 1, [], [], 0
    if lens:
        yield _block(number, texts, lens)


def _cuts(keys: np.ndarray, parts: int) -> np.ndarray:
    """Where the ranges of the vocabulary begin and end among sorted hashes."""
    return np.searchsorted((keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32), np.arange(parts + 1, dtype=np.uint64))


def _deal(batches, parts: int):
    """The words of every block by range; a row for every range, even without a word of the block."""
    for batch in batches:
        for number, words, keys in zip(batch.column("block").to_pylist(), batch.column("words"), _numbers(batch.column("keys"), np.uint64)):
            lists = pa.ListArray.from_arrays(pa.array(_cuts(keys, parts), pa.int32()), words.values)
            yield pa.RecordBatch.from_arrays([pa.array(range(parts), pa.int64()), pa.array([number] * parts, pa.int64()), lists], ["part", "block", "words"])


def _place(batches, parts: int):
    """What a block keeps for all steps: where its words are cut, and its rows."""
    for batch in batches:
        for number, keys, rest in zip(batch.column("block"), _numbers(batch.column("keys"), np.uint64), zip(*(batch.column(c) for c in ("ends", "cols", "counts")))):
            data = [_bytes([_cuts(keys, parts)]), *[pa.array([x.as_py()], pa.binary()) for x in rest]]
            yield pa.RecordBatch.from_arrays([pa.array([number.as_py()], pa.int64()), *data], ["block", "cuts", "ends", "cols", "counts"])


def _range(rows: pa.Table) -> pa.Table:
    """The vocabulary of a range, and where the words of its blocks stand in it."""
    rows = rows.sort_by("block")
    coded = rows["words"].combine_chunks().flatten().dictionary_encode()
    order = pc.sort_indices(coded.dictionary)
    place = np.empty(len(order), np.int32)
    place[order.to_numpy()] = np.arange(len(order))
    words, ends = coded.dictionary.take(order), np.cumsum(pc.list_value_length(rows["words"]).to_numpy())
    lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (words, pa.array(rows["block"].to_pylist(), pa.int64()), pa.array(ends, pa.int64()))]
    data = [pa.array([rows["part"][0].as_py()], pa.int64()), pa.array([len(words)], pa.int64()), *lists, _bytes([place[coded.indices.to_numpy()]])]
    return pa.Table.from_arrays(data, ["part", "size", "words", "blocks", "ends", "at"])


def _send(part: int, blocks: list[int], ends: list[int], at: np.ndarray, model: np.ndarray) -> pa.RecordBatch:
    """The weights of a range to all blocks: those of the words that the block holds, and the sums."""
    weights, n = np.exp(digamma(model)), len(blocks)
    slices = [weights[:, a] for a in np.split(at, ends[:-1])]
    return pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), pa.array([part] * n, pa.int64()), _bytes(slices), _bytes([model.sum(axis=1)] * n)], ["block", "part", "weights", "totals"])


def _begin(batches, k: int, seed: int):
    for batch in batches:
        for part, words, blocks, ends, at in zip(*(batch.column(c).to_pylist() if c in ("part", "blocks", "ends") else batch.column(c) for c in ("part", "words", "blocks", "ends", "at"))):
            yield _send(part, blocks, ends, np.frombuffer(at.as_buffer(), np.int32), first_weights(_keys(words.values), k, seed))


def _in_block(sent: pa.Table, block: pa.Table, k: int, alpha: float) -> pa.Table:
    """Expected counts of a block's words, to their ranges."""
    sent = sent.sort_by("part")
    weights = np.concatenate([w.reshape(k, -1) for w in _numbers(sent["weights"], np.float64)], axis=1)
    totals = sum(_numbers(sent["totals"], np.float64))
    cuts, ends, cols, counts = (_numbers(block[c], kind)[0] for c, kind in (("cuts", np.int64), ("ends", np.int64), ("cols", np.int32), ("counts", np.int32)))
    found = expected_counts(ends, cols, counts, weights / np.exp(digamma(totals))[:, None], alpha)
    pieces = np.split(found, cuts[1:-1], axis=1)
    return pa.Table.from_arrays([sent["part"], pa.array([block["block"][0].as_py()] * len(pieces), pa.int64()), _bytes(pieces)], ["part", "block", "counts"])


def _model(sent: pa.Table, row: pa.Table, k: int, eta: float) -> tuple[np.ndarray, list[int], list[int], np.ndarray]:
    """The weights of a range's words: what all blocks counted, in the order of the blocks."""
    blocks, ends, at = row["blocks"][0].as_py(), row["ends"][0].as_py(), _numbers(row["at"], np.int32)[0]
    model = np.full((k, row["size"][0].as_py()), eta)
    for a, counts in zip(np.split(at, ends[:-1]), _numbers(sent.sort_by("block")["counts"], np.float64)):
        model[:, a] += counts.reshape(k, -1)
    return model, blocks, ends, at


def _in_range(sent: pa.Table, row: pa.Table, k: int, eta: float) -> pa.Table:
    model, blocks, ends, at = _model(sent, row, k, eta)
    return pa.Table.from_batches([_send(row["part"][0].as_py(), blocks, ends, at, model)])


def _top(sent: pa.Table, row: pa.Table, k: int, eta: float, top: int) -> pa.Table:
    """The heaviest words of a range by topic; the first one of each carries the range's sum."""
    model, words = _model(sent, row, k, eta)[0], row["words"].combine_chunks().flatten()
    best = np.argsort(-model, axis=1, kind="stable")[:, :top]
    n = best.shape[1]
    totals = np.zeros((k, n))
    totals[:, :1] = model.sum(axis=1, keepdims=True)
    data = [pa.array(np.repeat(np.arange(k), n), pa.int32()), words.take(pa.array(best.ravel())), pa.array(np.take_along_axis(model, best, axis=1).ravel()), pa.array(totals.ravel())]
    return pa.Table.from_arrays(data, ["topic", "term", "weight", "total"])


def top_words(words: DataFrame, k: int, iterations: int, seed: int, alpha: float, eta: float, top: int, block_words: int = BLOCK_WORDS, range_words: int = RANGE_WORDS) -> DataFrame:
    """(topic, rank, term, weight): the heaviest words of topics over the lists in column ``words``
    and their shares; ties by word. Batch variational Bayes: every row takes part in every step.

    The result depends on the rows and the seed; how rows are dealt out only changes the order in
    which numbers are added."""
    spark = words.sparkSession
    rows = words.select(F.array_compact("words").alias("words")).where(F.size("words") > 0)
    made = [scratch(spark, "topic-blocks")]
    blocks = store(rows.mapInArrow(lambda b: _pack(b, block_words), BLOCKS), made[0])
    n, held = blocks.agg(F.count("*"), F.sum(F.size("words"))).first()
    if not n:
        return spark.createDataFrame([], "topic int, rank int, term string, weight double")
    parts = -(-held // range_words)
    made.append(scratch(spark, "topic-ranges"))
    dealt = blocks.mapInArrow(lambda b: _deal(b, parts), "part long, block long, words array<string>")
    ranges = store(dealt.groupBy("part").applyInArrow(_range, RANGES), made[1])
    placed = blocks.mapInArrow(lambda b: _place(b, parts), PLACED).repartition(n, "block").persist(StorageLevel.DISK_ONLY)
    slim = ranges.drop("words").repartition(parts, "part").persist(StorageLevel.DISK_ONLY)
    sent = ranges.mapInArrow(lambda b: _begin(b, k, seed), TO_BLOCKS)
    for step in range(1, iterations + 1):
        counted = sent.groupBy("block").cogroup(placed.groupBy("block")).applyInArrow(lambda s, b: _in_block(s, b, k, alpha), TO_RANGES).groupBy("part")
        if step == iterations:
            break
        made.append(scratch(spark, "topic-step"))
        sent = store(counted.cogroup(slim.groupBy("part")).applyInArrow(lambda s, r: _in_range(s, r, k, eta), TO_BLOCKS), made[-1], plain=True)
        if step > 1:
            discard(spark, made.pop(-2))
        gc.collect()  # lets Spark delete the exchange files of the step
        spark.sparkContext._jvm.System.gc()
    best = counted.cogroup(ranges.groupBy("part")).applyInArrow(lambda s, r: _top(s, r, k, eta, top), "topic int, term string, weight double, total double")
    w = Window.partitionBy("topic")
    shares = best.select("topic", F.row_number().over(w.orderBy(F.desc("weight"), "term")).alias("rank"), "term", (F.col("weight") / F.sum("total").over(w)).alias("weight"))
    found = shares.where(F.col("rank") <= top).orderBy("topic", "rank").collect()  # k rows of ``top`` words
    for cached in (placed, slim):
        cached.unpersist()
    for path in made:
        discard(spark, path)
    return spark.createDataFrame(found, shares.schema)
