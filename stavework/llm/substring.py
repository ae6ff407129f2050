"""Substring dedup by fixed-block anchors.

A repeat of w words holds a whole aligned block of b = (w + 1) // 2 words wherever it
lies. So the index takes the non-overlapping blocks of every text, and every rolling
window of b words of every text probes it; a hit in another text is extended to all
w-word windows around it, these are matched by a 64-bit hash of their words, and
consecutive ones merge into maximal repeats.

Index and probes meet in hash buckets as compressed sorted signatures of each batch
(a window shared by a third of all texts is one number per batch). The buckets answer
with a blocked Bloom filter of fixed size; it may let windows through that have no
partner, never the reverse, and only windows it lets through are exchanged as rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stavework.llm import _packed
from stavework.llm._env import free_shuffles, input_splits, lean_memory, project, trim_memory, write_table
from stavework.llm._words import U, Words, chunks, rolling, words_of

SIGNATURE_BITS = 40
#: Bits of the Bloom filter, whatever the input: 32 MB.
FILTER_BITS = 28
_PROBES = (U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F), U(0x165667B19E3779F9))
BROADCAST_BYTES = 16_000_000


def _windows(w: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of the first word, hash) of each window that lies within one text."""
    lean_memory()
    h = rolling(w.hash, width)
    at = np.flatnonzero(w.doc[: len(h)] == w.doc[width - 1 :]) if len(h) else np.zeros(0, np.int64)
    return at, h[at]


def _filter_bits(signature: np.ndarray, bucket_bits: int) -> Iterator[np.ndarray]:
    segment = FILTER_BITS - bucket_bits
    for odd in _PROBES:
        yield ((signature * odd) >> U(64 - segment)).astype(np.int64)


def _signatures(width: int, bucket_bits: int):
    schema = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("values", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in chunks(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), 4_000_000):
                w = words_of(texts, lower=False)
                at, h = _windows(w, width)
                if not len(at):
                    continue
                s = h >> U(64 - SIGNATURE_BITS)
                aligned = (at - w.first[w.doc[at]]) % width == 0
                order = np.argsort(s, kind="stable")
                sorted_, doc = s[order], w.doc[at][order]
                same = sorted_[1:] == sorted_[:-1]
                several = np.unique(sorted_[1:][same & (doc[1:] != doc[:-1])])
                kinds = (np.unique(sorted_), np.unique(s[aligned]), several)
                cut = np.arange(1 << bucket_bits, dtype=U) << U(SIGNATURE_BITS - bucket_bits)
                out = []
                for kind, values in enumerate(kinds):
                    ends = [*np.searchsorted(values, cut).tolist(), len(values)]
                    out += [(k, kind, _packed.put_sorted(values[a:b])) for k, (a, b) in enumerate(zip(ends, ends[1:])) if a < b]
                yield pa.record_batch([pa.array([o[j] for o in out], t) for j, t in enumerate((pa.int32(), pa.int32(), pa.binary()))], schema=schema)
        trim_memory()

    return run


def _meet(bucket_bits: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        kinds = [[_packed.get_sorted(v) for v in pdf["values"][pdf.kind == k]] for k in range(3)]
        if not kinds[1]:
            return pd.DataFrame({"bucket": pd.Series(dtype="int32"), "bits": pd.Series(dtype=object)})
        values, batches = np.unique(np.concatenate(kinds[0]), return_counts=True)
        twice = values[batches > 1]
        hit = np.intersect1d(np.unique(np.concatenate(kinds[1])), np.unique(np.concatenate((twice, *kinds[2]))), assume_unique=True)
        bits = np.zeros(1 << (FILTER_BITS - bucket_bits), bool)
        for at in _filter_bits(hit, bucket_bits):
            bits[at] = True
        packed = np.packbits(bits, bitorder="little")
        del kinds, values, batches, twice, hit, bits
        trim_memory()
        return pd.DataFrame({"bucket": pdf.bucket.iloc[:1], "bits": [_packed.put(packed)]})

    return run


def _passing(filter_, width: int, block: int, bucket_bits: int):
    schema = pa.schema([("h", pa.int64()), ("doc_id", pa.int64()), ("pos", pa.int32())])
    segment = FILTER_BITS - bucket_bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = filter_.value
        for batch in batches:
            for ids, texts in chunks(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                w = words_of(texts, lower=False)
                at, h = _windows(w, block)
                if not len(at):
                    continue
                s = h >> U(64 - SIGNATURE_BITS)
                base = (s >> U(SIGNATURE_BITS - bucket_bits)).astype(np.int64) << segment
                hit = np.ones(len(at), bool)
                for k in _filter_bits(s, bucket_bits):
                    k += base
                    hit &= (bits[k >> 3] >> (k & 7).astype(np.uint8)) & 1 == 1
                near = np.zeros(len(w.hash) + 1, np.int64)
                near[at[hit]] = 1
                near = np.cumsum(near)
                first, full = _windows(w, width)
                if not len(first):
                    continue
                before = np.where(first > 0, near[first - 1], 0)
                keep = near[first + width - block] > before
                first, full = first[keep], full[keep]
                doc = w.doc[first]
                yield pa.record_batch([pa.array(full.view(np.int64)), pa.array(np.array(ids, np.int64)[doc]), pa.array((first - w.first[doc]).astype(np.int32))], schema=schema)
        trim_memory()

    return run


def _runs(width: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for p in pdf.pos:
                p = np.sort(np.asarray(p))
                # windows that touch or overlap are one maximal repeat
                cut = np.flatnonzero(np.diff(p) > width)
                out.append(np.column_stack((p[np.concatenate(([0], cut + 1))], p[np.concatenate((cut, [len(p) - 1]))] + width)).ravel().tolist())
            yield pd.DataFrame({"id": pdf.doc_id, "spans": out})

    return run


def _filter(rows: DataFrame, block: int, bucket_bits: int) -> np.ndarray:
    """The Bloom filter of all anchors that another text holds. Plans of these exchanges end here,
    so that Spark may delete their files."""
    sent = rows.mapInArrow(_signatures(block, bucket_bits), "bucket int, kind int, values binary")
    answers = sent.groupBy("bucket").applyInPandas(_meet(bucket_bits), "bucket int, bits binary")
    bits = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    step = len(bits) >> bucket_bits
    for r in answers.toLocalIterator():  # segments of the filter: 32 MB in all
        bits[r["bucket"] * step : (r["bucket"] + 1) * step] = _packed.get(bytes(r["bits"]), np.uint8)
    return bits


def repeated_spans(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", width: int = 13) -> DataFrame:
    """(id, spans): word ranges [start, end, ...] of each text that are covered by windows
    of ``width`` words whose sequence also starts in a text with a smaller id."""
    spark = docs.sparkSession
    block = (width + 1) // 2
    rows = project(docs, doc_id=doc_id, text=text).select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    bucket_bits = min(20, max(4, int(np.ceil(np.log2(2 * input_splits(docs))))))
    bits = _filter(rows, block, bucket_bits)
    free_shuffles(spark)
    filter_ = spark.sparkContext.broadcast(bits)
    found_table = write_table(rows.mapInArrow(_passing(filter_, width, block, bucket_bits), "h long, doc_id long, pos int"), "near-windows")
    filter_.unpersist()
    found = found_table.df()
    first = write_table(found.groupBy("h").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("h", "first"), "repeated-windows").df()
    small = first.count() * 16 <= BROADCAST_BYTES
    free_shuffles(spark)
    later = found.join(F.broadcast(first) if small else first, "h").where("doc_id > first")
    return later.groupBy("doc_id").agg(F.collect_set("pos").alias("pos")).mapInPandas(_runs(width), "id long, spans array<int>")


def remove_repeats(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", width: int = 13) -> DataFrame:
    """(doc_id, kept, n_words, n_removed) of every document.

    kept: the words outside repeats (see ``repeated_spans``) joined by one space. Null
    and blank texts have no words; texts shorter than ``width`` words keep all; rows
    that share an id are no repeats of each other; a null id keeps its text. An empty
    table gives an empty result.
    """
    spans_table = write_table(repeated_spans(docs, doc_id=doc_id, text=text, width=width), "spans")
    free_shuffles(docs.sparkSession)
    spans = spans_table.df()
    size = spans.agg(F.coalesce(F.sum(F.size("spans") * 4 + 32), F.lit(0))).first()[0]
    rows = project(docs, doc_id=doc_id, text=text).withColumn("doc_id", F.col("doc_id").cast("long"))
    joined = rows.join(F.broadcast(spans) if size <= BROADCAST_BYTES else spans, F.col("doc_id") == F.col("id"), "left").select("doc_id", "text", "spans")
    schema = pa.schema([("doc_id", pa.int64()), ("kept", pa.string()), ("n_words", pa.int64()), ("n_removed", pa.int64())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = batch.column("spans").to_pylist()
            at = 0
            for ids, texts in chunks(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                kept, total, removed = [], [], []
                for t, s in zip(texts, spans[at : at + len(ids)]):
                    words = t.split()
                    total.append(len(words))
                    for a, b in zip(s[-2::-2], s[::-2]) if s else ():
                        del words[a:b]
                    removed.append(total[-1] - len(words))
                    kept.append(b" ".join(words).decode("utf-8", "surrogatepass"))
                at += len(ids)
                yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(kept, pa.string()), pa.array(total, pa.int64()), pa.array(removed, pa.int64())], schema=schema)
        trim_memory()

    return joined.mapInArrow(cut, "doc_id long, kept string, n_words long, n_removed long")
