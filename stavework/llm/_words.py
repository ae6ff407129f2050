"""Vectorised word splitting and hashing of whole texts (words: runs of bytes
other than space, tab, LF, VT, FF, CR). One numpy pass over a batch of texts."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np

U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [2**64 - 1], dtype=U)
#: Odd constants of the mixing function (splitmix64's published finaliser).
M1, M2, GOLD = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB), U(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit over all."""
    h = h ^ (h >> U(30))
    h *= M1
    h ^= h >> U(27)
    h *= M2
    h ^= h >> U(31)
    return h


class Words(NamedTuple):
    hash: np.ndarray  # uint64 of each word
    doc: np.ndarray  # int64 index of its text in the batch
    first: np.ndarray  # int64, per text: index of its first word; one more entry at the end
    start: np.ndarray  # byte range of each word in buf
    end: np.ndarray
    buf: np.ndarray


def hash_spans(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each byte range of ``buf``, which has eight more bytes than the ranges use."""
    lengths = end - start
    lanes = np.ndarray((len(buf) - 8,), "<u8", buf, 0, (1,))
    h = mix(lengths.astype(U) * GOLD + U(1))
    at, left, rows = start, lengths, None
    while len(at):
        part = mix((lanes[at] & _MASK[np.minimum(left, 8)]) + GOLD)
        if rows is None:
            h = mix((h ^ part) + GOLD)
            rows = np.arange(len(start))
        else:
            h[rows] = mix((h[rows] ^ part) * U(3) + GOLD)
        more = left > 8
        at, left, rows = at[more] + 8, left[more] - 8, rows[more]
    return h


def words_of(texts: list[bytes], lower: bool) -> Words:
    """All words of a batch; equal words have equal hashes on every machine."""
    joined = b"\n".join(texts) + b"\n" + b"\0" * 8
    raw = np.frombuffer(joined, np.uint8)
    buf = _LOWER[raw] if lower else raw
    n = len(joined) - 8
    space = _SPACE[raw[:n]]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if n and not space[0]:
        edge = np.concatenate(([0], edge))
    start, end = edge[0::2], edge[1::2]
    h = hash_spans(np.ascontiguousarray(buf), start, end)
    ends = np.cumsum([len(t) + 1 for t in texts]) if texts else np.zeros(0, np.int64)
    first = np.concatenate(([0], np.searchsorted(start, ends))).astype(np.int64)
    doc = np.repeat(np.arange(len(texts)), np.diff(first))
    return Words(h, doc, first, start, end, raw)


def rolling(h: np.ndarray, width: int) -> np.ndarray:
    """Hashes of every ``width`` consecutive values (len(h) - width + 1 of them)."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, U)
    out = np.full(n, mix(np.array([width], U))[0])
    for k in range(width):
        out = mix((out ^ h[k : k + n]) * U(5) + GOLD)
    return out


def encoded(texts: Iterable[str | None]) -> list[bytes]:
    return [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]


def chunks(ids: list, texts: list[str | None], most: int = 2_000_000) -> Iterator[tuple[list, list[bytes]]]:
    """(ids, encoded texts) of about ``most`` bytes each; a longer text stands alone."""
    a, b, size = [], [], 0
    for i, t in zip(ids, encoded(texts)):
        if size and size + len(t) > most:
            yield a, b
            a, b, size = [], [], 0
        a.append(i)
        b.append(t)
        size += len(t)
    if a:
        yield a, b


def distinct_sorted(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.concatenate(([True], x[1:] != x[:-1]))] if len(x) else x


def components(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest reachable vertex of 0..n-1 for each vertex, for edges (a, b)."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label = up
        keep = label[a] != label[b]
        a, b = a[keep], b[keep]
    return label
