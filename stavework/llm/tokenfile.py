"""Token-ID files in patched frame-of-reference blocks.

Documents are put in ascending order of their id by range partitioning, encoded
with the tokenizers library, closed by an end id and written as segments of whole
documents. A segment is a self-contained byte string (see ``pack``): blocks of 128
ids hold the distance from the block's minimum in a width chosen at a percentile
of the block, larger distances keep their high bits in an exception list, and an
index holds where each block starts. The segments are rows of a Parquet dataset,
so that any store Spark writes to will do and a lost task is simply run again.
"""

from __future__ import annotations

import gc
import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stavework.llm._env import input_splits, project, shared_dir
from stavework.llm._words import U, distinct_sorted, hash_spans

BLOCK, MAGIC = 128, 0x31524650
_HEAD = np.dtype([("magic", "<u4"), ("docs", "<u4"), ("ids", "<u8")])
_INDEX = np.dtype([("start", "<u8"), ("base", "<u4"), ("width", "u1"), ("exceptions", "u1")])


def pack(ids: np.ndarray, lengths: np.ndarray, percentile: float = 90) -> bytes:
    """Segment of the concatenated ``ids`` of documents of the given ``lengths``.

    Layout: header, document lengths (u32), index of the blocks, blocks. A block is
    128 distances of ``width`` bits, then its exceptions: positions (u8), high bits (u32).
    """
    n = len(ids)
    blocks = -(-n // BLOCK)
    v = np.zeros((blocks, BLOCK), np.uint32)
    v.ravel()[:n] = ids
    if n % BLOCK:
        v[-1, n % BLOCK :] = v[-1, : n % BLOCK].min()
    index = np.zeros(blocks + 1, _INDEX)
    base = v.min(1) if blocks else np.zeros(0, np.uint32)
    d = v - base[:, None]
    # np.frexp gives the bit length of every distance
    cut = np.sort(d, 1)[:, min(BLOCK - 1, int(BLOCK * percentile / 100))] if blocks else base
    width = np.frexp(cut.astype(np.float64))[1].astype(np.int64)
    high = (d.astype(np.uint64) >> width[:, None].astype(np.uint64)).astype(np.uint32)
    row, col = np.nonzero(high)
    exceptions = np.bincount(row, minlength=blocks)
    start = np.concatenate(([0], np.cumsum(width * (BLOCK // 8) + exceptions * 5)))
    index["start"], index["base"][:-1], index["width"][:-1], index["exceptions"][:-1] = start, base, width, exceptions
    body = np.zeros(start[-1], np.uint8)
    for w in np.unique(width[width > 0]):
        k = np.flatnonzero(width == w)
        bits = ((d[k][:, :, None] >> np.arange(w, dtype=np.uint32)) & np.uint32(1)).astype(np.uint8)
        body[start[k][:, None] + np.arange(w * (BLOCK // 8))] = np.packbits(bits.reshape(len(k), -1), axis=1, bitorder="little")
    if len(row):
        nth = np.arange(len(row)) - np.repeat(np.cumsum(exceptions) - exceptions, exceptions)
        at = start[row] + width[row] * (BLOCK // 8)
        body[at + nth] = col
        body[(at + exceptions[row] + 4 * nth)[:, None] + np.arange(4)] = high[row, col].astype("<u4").view(np.uint8).reshape(-1, 4)
    head = np.array((MAGIC, len(lengths), n), _HEAD)
    return head.tobytes() + lengths.astype("<u4").tobytes() + index.tobytes() + body.tobytes()


def unpack(segment: bytes, first: int = 0, last: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(ids, document lengths); ``first`` and ``last``: only the ids of those blocks."""
    head = np.frombuffer(segment, _HEAD, 1)[0]
    if head["magic"] != MAGIC:
        raise ValueError("not a token segment")
    docs, n = int(head["docs"]), int(head["ids"])
    blocks = -(-n // BLOCK)
    lengths = np.frombuffer(segment, "<u4", docs, _HEAD.itemsize)
    at = _HEAD.itemsize + 4 * docs
    index = np.frombuffer(segment, _INDEX, blocks + 1, at)
    body = np.frombuffer(segment, np.uint8, -1, at + index.nbytes)
    last = blocks if last is None else min(last, blocks)
    part = index[first:last]
    start, width, exceptions = part["start"].astype(np.int64), part["width"].astype(np.int64), part["exceptions"].astype(np.int64)
    out = np.zeros((len(part), BLOCK), np.uint32)
    for w in np.unique(width[width > 0]):
        k = np.flatnonzero(width == w)
        bits = np.unpackbits(body[start[k][:, None] + np.arange(w * (BLOCK // 8))], axis=1, bitorder="little").reshape(len(k), BLOCK, w)
        out[k] = bits @ (np.uint32(1) << np.arange(w, dtype=np.uint32))
    total = int(exceptions.sum())
    if total:
        row = np.repeat(np.arange(len(part)), exceptions)
        nth = np.arange(total) - np.repeat(np.cumsum(exceptions) - exceptions, exceptions)
        where = start[row] + width[row] * (BLOCK // 8)
        col = body[where + nth]
        high = np.ascontiguousarray(body[(where + exceptions[row] + 4 * nth)[:, None] + np.arange(4)]).view("<u4").ravel()
        out[row, col] |= (high.astype(np.uint64) << width[row].astype(np.uint64)).astype(np.uint32)
    out += part["base"].astype(np.uint32)[:, None]
    return out.ravel()[: min(n, last * BLOCK) - first * BLOCK], lengths


class Places:
    """64-bit hashes and the numbers they were added under, in open addressing on arrays."""

    def __init__(self, bits: int = 20):
        self.keys, self.number, self.n = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int32), 0

    def find(self, h: np.ndarray) -> np.ndarray:
        """The number of each hash (none is 0), -1 where it is not held."""
        mask = len(self.keys) - 1
        at = h.astype(np.int64) & mask
        held = self.keys[at]
        out = np.where(held == h, self.number[at], np.int32(-1))
        open_ = np.flatnonzero((held != h) & (held != 0))
        at = at[open_]
        while len(open_):
            at = (at + 1) & mask
            held, want = self.keys[at], h[open_]
            hit = held == want
            out[open_[hit]] = self.number[at[hit]]
            more = ~hit & (held != 0)
            open_, at = open_[more], at[more]
        return out

    def add(self, h: np.ndarray) -> None:
        """Distinct hashes that are not held get the next numbers."""
        if 2 * (self.n + len(h)) > len(self.keys):
            old = self.keys != 0
            keys, number = self.keys[old], self.number[old]
            bits = int(2 * (self.n + len(h))).bit_length() + 1
            self.keys, self.number = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int32)
            self._put(keys, number)
        self._put(h, np.arange(self.n, self.n + len(h), dtype=np.int32))
        self.n += len(h)

    def _put(self, h: np.ndarray, number: np.ndarray) -> None:
        mask = len(self.keys) - 1
        at = h.astype(np.int64) & mask
        while len(h):
            free = self.keys[at] == 0
            self.keys[at[free]] = h[free]
            mine = free & (self.keys[at] == h)
            self.number[at[mine]] = number[mine]
            h, number, at = h[~mine], number[~mine], (at[~mine] + 1) & mask


def _lanes(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on, as one number."""
    return np.ndarray((len(buf) - 8,), "<u8", buf, 0, (1,))


_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E), *range(0x1C, 0x20)]] = True
# bytes that may end, or begin, a white space character outside ASCII
_MAY_END, _MAY_BEGIN = _WHITE.copy(), _WHITE.copy()
_MAY_END[[*range(0x80, 0x8B), 0x9F, 0xA0, 0xA8, 0xA9, 0xAF]] = True
_MAY_BEGIN[[0xC2, 0xE1, 0xE2, 0xE3]] = True


class Encoder:
    """Whole texts through the tokenizers library, each distinct space-led run once.

    For byte-level vocabularies a text may be cut before a single space unless white
    space stands on both sides of it; texts with such places, or with the text of a
    special token, are encoded in one piece. Runs are found by a 64-bit hash and compared
    byte by byte with the run they were learnt from; a text with a run that only shares
    its hash is encoded in one piece too.
    """

    _RUN = re.compile(r"\s (?:\s|\Z)")

    def __init__(self, path: str, cache_runs: int = 500_000):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        gc.set_threshold(200_000, 50, 50)
        self.tok = Tokenizer.from_file(path)
        self.tok.no_padding()
        self.tok.no_truncation()
        self.special = [t.content.encode() for t in self.tok.get_added_tokens_decoder().values()]
        if any(b" " in t for t in self.special):
            raise ValueError("special tokens with spaces cannot be told apart in cut texts")
        size = {i: len(t) for t, i in self.tok.get_vocab(with_added_tokens=False).items()}
        size |= {i: len(t.content.encode()) for i, t in self.tok.get_added_tokens_decoder().items()}
        self.token_bytes = np.zeros(max(size) + 1, np.int64)
        self.token_bytes[list(size)] = list(size.values())
        self.cache_runs = cache_runs
        self._clear()

    def _clear(self) -> None:
        self.places = Places()
        self.flat, self.used = np.zeros(1 << 20, np.int32), 0
        self.off, self.len = np.zeros(1 << 18, np.int64), np.zeros(1 << 18, np.int64)
        # of each run: its length, and where its bytes stand in raw
        self.size, self.at = np.zeros(1 << 18, np.int32), np.zeros(1 << 18, np.int64)
        self.raw, self.raw_used = np.zeros(1 << 22, np.uint8), 8

    def _keep_bytes(self, k: int, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
        size = end - start
        total = int(size.sum())
        while self.raw_used + total + 16 > len(self.raw):
            self.raw = np.concatenate((self.raw, np.zeros_like(self.raw)))
        place = self.raw_used + np.cumsum(size) - size
        self.raw[self.raw_used : self.raw_used + total] = buf[np.repeat(start - np.cumsum(size) + size, size) + np.arange(total)]
        self.raw_used += total
        self.size[k : k + len(start)], self.at[k : k + len(start)] = size, place

    def _differs(self, at: np.ndarray, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Runs whose bytes are not those of the run of the same hash. Up to eight bytes the hash
        is a bijection for each length."""
        size = (end - start).astype(np.int32)
        bad = self.size[at] != size
        long_ = np.flatnonzero(size > 8)
        a, b, left = start[long_], self.at[at[long_]], size[long_] - 8
        mine, held = _lanes(buf), _lanes(self.raw)
        unlike = mine[a] != held[b]
        while len(long_):
            bad[long_[unlike]] = True
            step = np.minimum(left, 8)  # the last eight bytes may overlap those before
            a, b, left = a + step, b + step, left - step
            unlike = mine[a] != held[b]
            more = left > 0
            bad[long_[unlike & ~more]] = True
            long_, a, b, left, unlike = long_[more], a[more], b[more], left[more], unlike[more]
        return np.flatnonzero(bad)

    def _plain_runs(self, runs: list[str], bytes_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each) of runs that a space leads and that neither start nor end
        in further white space: many to a text, which is cut before every single space anyway.
        A byte-level token stands for as many bytes as it has letters."""
        texts = ["".join(runs[a : a + 500]) for a in range(0, len(runs), 500)]
        ids = np.array([i for e in self.tok.encode_batch_fast(texts, add_special_tokens=False) for i in e.ids], np.int32)
        at, ends = np.cumsum(self.token_bytes[ids]), np.cumsum(bytes_)
        last = np.searchsorted(at, ends)
        if len(runs) and (last[-1] != len(ids) - 1 or not np.array_equal(at[last], ends)):
            raise ValueError("a token crosses the space between two runs")
        return ids, np.diff(last, prepend=-1)

    def _learn(self, h: np.ndarray, raw: bytes, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
        runs = [str(raw[a:b], "utf-8") for a, b in zip(start.tolist(), end.tolist())]
        plain = np.array([r[0] == " " and not r[1:2].isspace() and not r[-1].isspace() for r in runs], bool)
        ids, size = self._plain_runs([r for r, p in zip(runs, plain.tolist()) if p], (end - start)[plain])
        if not plain.all():
            got = self.tok.encode([r for r, p in zip(runs, plain.tolist()) if not p], is_pretokenized=True, add_special_tokens=False)
            ids = np.concatenate((ids, np.array(got.ids, np.int32)))
            size = np.concatenate((size, np.bincount(np.array(got.word_ids, np.int64), minlength=int((~plain).sum()))))
        k = self.places.n
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate((self.flat, np.zeros_like(self.flat)))
        while k + len(runs) > len(self.off):
            for name in ("off", "len", "size", "at"):
                setattr(self, name, np.concatenate((x := getattr(self, name), np.zeros_like(x))))
        self.flat[self.used : self.used + len(ids)] = ids
        self.off[k : k + len(runs)] = self.used + np.cumsum(size) - size
        self.len[k : k + len(runs)] = size
        order = np.concatenate((np.flatnonzero(plain), np.flatnonzero(~plain)))
        self._keep_bytes(k, buf, start[order], end[order])
        self.places.add(h[order])
        self.used += len(ids)

    def __call__(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each), without end ids; none is null."""
        if self.places.n > self.cache_runs:
            self._clear()
        offsets = text_offsets(texts)
        base, edge = int(offsets[0]), (offsets - offsets[0]).astype(np.int64)
        n = int(edge[-1])
        raw = texts.buffers()[2].slice(base, n).to_pybytes() if n else b""
        buf = np.frombuffer(raw + b"\0" * 8, np.uint8)
        space = np.flatnonzero(buf[:n] == 0x20)
        start = distinct_sorted(np.concatenate((space, edge[:-1][edge[:-1] < edge[1:]])))
        end = np.append(start[1:], n) if len(start) else start
        h = np.maximum(hash_spans(buf, start, end), U(1))
        at = self.places.find(h)
        if len(lacking := np.flatnonzero(at < 0)):
            new, first = np.unique(h[lacking], return_index=True)
            first = lacking[first]
            self._learn(new, raw, buf, start[first], end[first])
            at[lacking] = self.places.find(h[lacking])
        differs = self._differs(at, buf, start, end)
        size = self.len[at]
        ids = self.flat[np.repeat(self.off[at] - np.cumsum(size) + size, size) + np.arange(int(size.sum()))]
        ends = np.concatenate(([0], np.cumsum(size)))[np.searchsorted(start, edge)]
        lengths = np.diff(ends)
        whole = self._whole(texts, raw, buf, space, edge, start[differs])
        if whole:
            parts = [whole.get(k, ids[a:b]) for k, (a, b) in enumerate(zip(ends, ends[1:]))]
            return np.concatenate(parts), np.array([len(p) for p in parts], np.int64)
        return ids, lengths

    def _whole(self, texts: pa.StringArray, raw: bytes, buf: np.ndarray, space: np.ndarray, edge: np.ndarray, unknown: np.ndarray) -> dict[int, np.ndarray]:
        """Ids of the texts that must not be cut, or hold an ``unknown`` run."""
        last = np.zeros(len(buf), bool)
        last[edge[1:]] = True
        inner = space[space > 0]
        odd = inner[_MAY_END[buf[inner - 1]] & (_MAY_BEGIN[buf[inner + 1]] | last[inner + 1])].tolist()
        for s in self.special:
            i = raw.find(s)
            while i >= 0:
                odd.append(i)
                i = raw.find(s, i + 1)
        out = {}
        must = set((np.searchsorted(edge, unknown, side="right") - 1).tolist())
        for k in sorted(must | set((np.searchsorted(edge, np.array(odd, np.int64), side="right") - 1).tolist())):
            t = texts[k].as_py()
            if k in must or self._RUN.search(t) or any(s.decode() in t for s in self.special):
                out[k] = np.array(self.tok.encode(t, add_special_tokens=False).ids, np.int32)
        return out


def text_offsets(texts: pa.StringArray) -> np.ndarray:
    return np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int32)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def write(docs: DataFrame, target: str, tokenizer_path: str, *, doc_id: str = "doc_id", text: str = "text", end_id: int = 0, segment_ids: int = 500_000, percentile: float = 90) -> None:
    """Encode every whole text and write the segments to the folder ``target``.

    Rows: part (in the order of ids), segment (in its part), start (ids of its part
    before it), n_ids, doc_ids, payload. A null text is an empty one (its end id
    only); a null doc_id sorts first; repeated rows are written repeatedly; an empty
    table gives an empty dataset.
    """
    schema = pa.schema([("part", pa.int32()), ("segment", pa.int32()), ("start", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("payload", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = encoder(tokenizer_path), TaskContext.get().partitionId()
        held: list[tuple[np.ndarray, np.ndarray, pa.Array]] = []
        segment = start = n_held = 0

        def row() -> pa.RecordBatch:
            ids, lengths = (np.concatenate([h[k] for h in held]) for k in (0, 1))
            owners = pa.concat_arrays([h[2] for h in held])
            listed = pa.ListArray.from_arrays(pa.array([0, len(owners)], pa.int32()), owners)
            return pa.record_batch([pa.array([part], pa.int32()), pa.array([segment], pa.int32()), pa.array([start]), pa.array([len(ids)]), listed, pa.array([pack(ids, lengths, percentile)])], schema=schema)

        for batch in batches:
            owners, texts = batch.column("doc_id"), batch.column("text").cast(pa.string())
            if texts.null_count:
                texts = texts.fill_null("")
            offsets, a = text_offsets(texts).astype(np.int64), 0
            while a < len(texts):
                # about two million bytes at once; a longer text stands alone
                b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + 2_000_000, side="right")) - 1)
                flat, lengths = enc(texts.slice(a, b - a))
                ids = np.insert(flat, np.cumsum(lengths), end_id)
                cut = np.concatenate(([0], np.cumsum(lengths + 1)))
                i = 0
                while i < b - a:  # whole documents until the segment is full
                    j = min(b - a, int(np.searchsorted(cut, cut[i] + segment_ids - n_held)))
                    held.append((ids[cut[i] : cut[j]], lengths[i:j] + 1, owners.slice(a + i, j - i)))
                    n_held += int(cut[j] - cut[i])
                    i = j
                    if n_held >= segment_ids:
                        yield row()
                        segment, start, n_held = segment + 1, start + n_held, 0
                        held.clear()
                a = b
        if held:
            yield row()

    rows = project(docs, doc_id=doc_id, text=text).withColumn("doc_id", F.col("doc_id").cast("long"))
    n = max(2, 2 * input_splits(docs))
    ordered = rows.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(run, "part int, segment int, start long, n_ids long, doc_ids array<long>, payload binary").write.parquet(target)


def read(spark, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document from the files: ``start`` counts
    the ids of all documents before it, ``ids`` are little-endian unsigned 32-bit bytes."""
    files = spark.read.parquet(path)
    totals = sorted((r["part"], r["n"]) for r in files.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())
    before, at = [], 0
    for part, n in totals:
        before.append((part, at))
        at += n
    # one row per partition of the writing job
    parts = spark.createDataFrame(before, "p int, before long")
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for base, owners, payload in zip(batch.column("base").to_pylist(), batch.column("doc_ids").to_pylist(), batch.column("payload")):
                ids, lengths = unpack(payload.as_buffer())
                ends = np.cumsum(lengths.astype(np.int64))
                raw = ids.astype("<u4").tobytes()
                cut = np.concatenate(([0], 4 * ends)).tolist()
                yield pa.record_batch([pa.array(owners, pa.int64()), pa.array(base + ends - lengths), pa.array(lengths.astype(np.int64)), pa.array([raw[a:b] for a, b in zip(cut, cut[1:])], pa.binary())], schema=schema)

    placed = files.join(F.broadcast(parts), files.part == parts.p).select((F.col("before") + F.col("start")).alias("base"), "doc_ids", "payload")
    return placed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def crc32(ids: bytes) -> int:
    return zlib.crc32(ids)


def new_target(spark) -> str:
    """A folder for a dataset that only lives as long as this application."""
    import uuid

    from stavework.llm import _env

    path = f"{shared_dir(spark)}/stavework-{uuid.uuid4().hex}-tokens"
    _env._live[path] = spark
    return path
