"""Quality classifier: a factorisation machine over hashed words, structure
statistics and metadata.

score = sigmoid(b + sum w_i x_i + 1/2 sum_f [(sum_i v_if x_i)^2 - sum_i (v_if x_i)^2]),
so all pairwise interactions cost time linear in the number of features.

It is fitted on the driver on a bounded sample (``sample_rows`` labelled rows, the
first by a hash of the id), and then scores every whole text on the executors.
Labels, language, source and id are never inputs. Metadata are numeric columns that the
caller names; a null, and a value that is not finite, is a bin of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stavework.llm._env import folded, project, trim_memory
from stavework.llm._words import chunks, words_of

WORD_BITS, BINS = 14, 13
#: Byte classes: space, line feed, lower, upper, digit, ASCII punctuation, control, non-ASCII.
_CLASS = np.full(256, 7, np.uint8)
_CLASS[:128] = 6
for _k, _c in ((0, b" \t\r\x0b\x0c"), (1, b"\n"), (2, bytes(range(97, 123))), (3, bytes(range(65, 91))), (4, b"0123456789"), (5, bytes(c for c in range(33, 127) if not chr(c).isalnum()))):
    _CLASS[list(_c)] = _k
STATS = ("bytes", "words", "word_len", "line_len", "space", "upper", "digit", "punct", "other", "doubled_punct", "repeats", "distinct", "lone_punct", "end_punct")


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(dense statistics, row pointer, word bucket, weight) of a batch of texts."""
    n = len(texts)
    w = words_of(texts, lower=True)
    sizes = np.array([len(t) for t in texts], np.int64)
    raw = w.buf[: int(sizes.sum()) + n]
    doc_of_byte = np.repeat(np.arange(n), sizes + 1)
    kind = _CLASS[raw]
    by = np.bincount(doc_of_byte * 8 + kind, minlength=8 * n).reshape(n, 8).astype(float)
    by[:, 1] -= 1  # the separator of the batch
    n_words = np.diff(w.first)
    punct = kind == 5
    twice = np.bincount(doc_of_byte[1:][punct[1:] & punct[:-1]], minlength=n)
    again = np.bincount(w.doc[1:][(w.hash[1:] == w.hash[:-1]) & (w.doc[1:] == w.doc[:-1])], minlength=n)
    ends_punct = kind[w.end - 1] == 5
    alone = np.bincount(w.doc[ends_punct & (w.end - w.start == 1)], minlength=n)
    ends = np.bincount(w.doc[ends_punct], minlength=n)
    key, count = np.unique((w.doc << WORD_BITS) | (w.hash >> np.uint64(64 - WORD_BITS)).astype(np.int64), return_counts=True)
    row, bucket = key >> WORD_BITS, key & ((1 << WORD_BITS) - 1)
    pointer = np.searchsorted(row, np.arange(n + 1))
    value = np.log1p(count)
    norm = np.sqrt(np.bincount(row, value**2, minlength=n))
    value = value / norm[row]
    total, nw = np.maximum(sizes, 1), np.maximum(n_words, 1)
    dense = np.column_stack([
        np.log1p(sizes), np.log1p(n_words), (sizes - by[:, 0] - by[:, 1]) / nw, np.log1p(sizes / (1 + by[:, 1])), by[:, 0] / total, by[:, 3] / total, by[:, 4] / total, by[:, 5] / total,
        by[:, 6] / total, twice / total, again / nw, np.diff(pointer) / nw, alone / nw, ends / nw,
    ])
    return dense, pointer, bucket.astype(np.int64), value.astype(np.float32)


class Model:
    """Weights of the machine; ``edges`` are the bins of the statistics and the metadata, the
    last bin of each is for values that are not there."""

    def __init__(self, edges: np.ndarray, b: float, w: np.ndarray, v: np.ndarray):
        self.edges, self.b, self.w, self.v = edges, b, w, v

    def inputs(self, dense: np.ndarray, pointer: np.ndarray, bucket: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row pointer, feature and value with one bin per statistic beside the words."""
        n, k = dense.shape
        bins = np.stack([np.where(np.isfinite(dense[:, j]), np.searchsorted(self.edges[j], dense[:, j], side="right"), BINS - 1) for j in range(k)], 1) + np.arange(k) * BINS + (1 << WORD_BITS)
        size = np.diff(pointer) + k
        out = np.concatenate(([0], np.cumsum(size)))
        f, x = np.empty(out[-1], np.int64), np.empty(out[-1], np.float32)
        at = (out[:-1, None] + np.arange(k)).ravel()
        f[at], x[at] = bins.ravel(), 1 / np.sqrt(k)
        rest = np.ones(out[-1], bool)
        rest[at] = False
        f[rest], x[rest] = bucket, value
        return out, f, x

    def margin(self, out: np.ndarray, f: np.ndarray, x: np.ndarray) -> np.ndarray:
        if len(out) == 1:
            return np.zeros(0)
        vx = self.v[f] * x[:, None]
        s, q = np.add.reduceat(vx, out[:-1]), np.add.reduceat(vx * vx, out[:-1])
        return self.b + np.add.reduceat(self.w[f] * x, out[:-1]).astype(float) + 0.5 * (s * s - q).sum(1)

    def score(self, texts: list[bytes], metadata: np.ndarray | None = None) -> np.ndarray:
        """Probability of label 1; ``metadata``: one row of numbers per text."""
        if not texts:
            return np.zeros(0)
        dense, *words = features(texts)
        if metadata is not None:
            dense = np.hstack((dense, metadata))
        return 1 / (1 + np.exp(-np.clip(self.margin(*self.inputs(dense, *words)), -40, 40)))


def fit(dense: np.ndarray, rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, *, rank: int = 8, epochs: int = 12, least_steps: int = 800, rate: float = 0.02, decay: float = 1e-3, seed: int = 5) -> Model:
    """Adam on the logistic loss. Without both classes: the smoothed share of ones."""
    rng = np.random.default_rng(seed)
    k = dense.shape[1]
    edges = np.zeros((k, BINS - 2))
    for j in range(k):
        there = dense[np.isfinite(dense[:, j]), j]
        if len(there):
            edges[j] = np.quantile(there, np.linspace(0, 1, BINS)[1:-1])
    size = (1 << WORD_BITS) + k * BINS
    prior = (y.sum() + 1) / (len(y) + 2)
    m = Model(edges, float(np.log(prior / (1 - prior))), np.zeros(size, np.float32), np.zeros((size, rank), np.float32))
    if len(np.unique(y)) < 2:
        return m
    m.v = rng.normal(0, 0.05, (size, rank)).astype(np.float32)
    pointer = np.concatenate(([0], np.cumsum([len(i) for i, _ in rows])))
    out, f, x = m.inputs(dense, pointer, np.concatenate([i for i, _ in rows]), np.concatenate([v for _, v in rows]))
    moment = [np.zeros_like(m.w), np.zeros_like(m.w), np.zeros_like(m.v), np.zeros_like(m.v)]
    mb, step = np.zeros(2), 0
    batches = max(1, len(y) // 128)
    for _ in range(max(epochs, -(-least_steps // batches))):
        order = rng.permutation(len(y))
        for part in np.array_split(order, batches):
            step += 1
            size_of = out[part + 1] - out[part]
            o = np.concatenate(([0], np.cumsum(size_of)))
            take = np.repeat(out[part] - o[:-1], size_of) + np.arange(o[-1])
            fi, xi = f[take], x[take]
            vx = m.v[fi] * xi[:, None]
            s = np.add.reduceat(vx, o[:-1])
            z = m.b + np.add.reduceat(m.w[fi] * xi, o[:-1]) + 0.5 * (s * s - np.add.reduceat(vx * vx, o[:-1])).sum(1)
            g = (1 / (1 + np.exp(-z)) - y[part]) / len(part)
            gr = np.repeat(g, size_of).astype(np.float32)
            used, slot = np.unique(fi, return_inverse=True)
            gw = np.bincount(slot, gr * xi) + decay * m.w[used] / 10
            each = gr[:, None] * xi[:, None] * (np.repeat(s, size_of, 0) - vx)
            gv = np.stack([np.bincount(slot, each[:, j]) for j in range(rank)], 1) + decay * m.v[used]
            scale = rate * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for p, gp, a, c in ((m.w, gw, moment[0], moment[1]), (m.v, gv, moment[2], moment[3])):
                a[used] = 0.9 * a[used] + 0.1 * gp
                c[used] = 0.999 * c[used] + 0.001 * gp * gp
                p[used] -= (scale * a[used] / (np.sqrt(c[used]) + 1e-8)).astype(np.float32)
            gb = g.sum()
            mb = np.array([0.9, 0.999]) * mb + np.array([0.1, 0.001]) * np.array([gb, gb * gb])
            m.b -= scale * mb[0] / (np.sqrt(mb[1]) + 1e-8)
    return m


def _numbers(pdf: pd.DataFrame, metadata: tuple[str, ...]) -> np.ndarray:
    """Metadata of each row; what is not there is not a number."""
    return np.column_stack([np.zeros((len(pdf), 0)), *[pd.to_numeric(pdf[f"meta_{k}"], errors="coerce").to_numpy(float, na_value=np.nan) for k in range(len(metadata))]])


def _feature_rows(metadata: tuple[str, ...]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            numbers = _numbers(pdf, metadata)
            for at, texts in chunks(list(range(len(pdf))), pdf.text.tolist()):
                dense, p, bucket, value = features(texts)
                dense = np.hstack((dense, numbers[at]))
                yield pd.DataFrame({"label": pdf.label.iloc[at].tolist(), "stats": list(dense), "bucket": [bucket[a:b] for a, b in zip(p, p[1:])], "value": [value[a:b] for a, b in zip(p, p[1:])]})

    return run


def _metadata_columns(metadata: tuple[str, ...]) -> dict:
    return {f"meta_{k}": F.col(f"`{c}`").cast("double") for k, c in enumerate(metadata)}


def train(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "quality", folds: int = 5, sample_rows: int = 6000, metadata: tuple[str, ...] = (), **options) -> Model:
    """Fit on at most ``sample_rows`` labelled documents whose fold is not 0.

    Rows with a null label or id are left out; a document labelled several times
    takes its largest label; a null text is an empty text. ``metadata``: numeric columns
    of ``docs`` that are inputs beside the words and the statistics.
    """
    y = project(labels, id=doc_id, label=label).where("id is not null and label is not null").groupBy("id").agg(F.max("label").cast("int").alias("label"))
    sample = y.where(folded(F.col("id"), folds) != 0).orderBy(F.xxhash64("id", F.lit(11)), "id").limit(sample_rows)
    # bounded by sample_rows rows of two numbers
    rows = project(docs, id=doc_id, text=text, **_metadata_columns(metadata)).join(F.broadcast(sample), "id").drop("id")
    got = rows.mapInPandas(_feature_rows(metadata), "label int, stats array<double>, bucket array<long>, value array<float>").toPandas()
    got = got.iloc[np.lexsort((got.bucket.map(len), got.stats.map(lambda s: s[0]), got.label))] if len(got) else got
    dense = np.array(got.stats.tolist(), float).reshape(-1, len(STATS) + len(metadata))
    return fit(dense, [(np.asarray(b, np.int64), np.asarray(v, np.float32)) for b, v in zip(got.bucket, got.value)], got.label.to_numpy(float), **options)


def classify(docs: DataFrame, model: Model, *, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.3, folds: int = 5, metadata: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row; whole texts, null as empty.

    ``metadata`` as in training. Repeated rows are scored alike; an empty table gives an
    empty result.
    """

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            numbers = _numbers(pdf, metadata)
            for at, texts in chunks(list(range(len(pdf))), pdf.text.tolist()):
                yield pd.DataFrame({"doc_id": pdf.doc_id.iloc[at].astype("Int64").to_numpy(), "score": model.score(texts, numbers[at])})
        trim_memory()

    out = project(docs, doc_id=doc_id, text=text, **_metadata_columns(metadata)).withColumn("doc_id", F.col("doc_id").cast("long")).mapInPandas(scored, "doc_id long, score double")
    return out.select("doc_id", F.coalesce(folded(F.col("doc_id"), folds) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
