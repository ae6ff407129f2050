"""BPE encoding and decoding by speculation and verification.

A word's pieces are guessed by greedy longest match (one automaton pass over all
new words of a batch). A guess is the exact result if every piece encodes to
itself and every adjacent pair is compatible, i.e. no merge would have crossed
the border while both neighbours existed. All pairs of a batch are tested at once
on arrays; only the words that fail go through exact merging.

Words are cut at white space, so each distinct run of other characters is
normalised, split and encoded once per worker and cache generation.
"""

from __future__ import annotations

import gc
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stavework.llm._env import project, trim_memory

#: Unicode's White_Space characters (fixed values).
WHITE = "\t\n\x0b\x0c\r \x85\xa0                　"
#: str.split() also cuts at these, which are not White_Space.
_ODD_CUTS = re.compile("[\x1c-\x1f]")
_RUNS = re.compile(f"[^{WHITE}]+")
#: Words of more letters are merged one by one.
MATRIX = 32
_END = "\n"  # stands for the end-of-word mark inside the automaton; no piece holds it


class Bpe:
    """The tokenizer of a file: a BPE model with end-of-word marks and no decoder."""

    def __init__(self, path: str, cache_words: int = 400_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.mark = model["end_of_word_suffix"]
        if spec.get("decoder") is not None or not self.mark:
            raise ValueError("a tokenizer with end-of-word marks and no decoder is needed")
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.text_of = {i: t for t, i in (self.vocab | self.special).items()}
        self._special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self._split = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self._bytes = _byte_letters()
        n = max(self.vocab.values()) + 1
        self.rank = np.full(n, -1, np.int64)
        self.left, self.right = np.zeros(n, np.int64), np.zeros(n, np.int64)
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        for r, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            t = self.vocab[a + b]
            self.rank[t], self.left[t], self.right[t] = r, self.vocab[a], self.vocab[b]
            self.merge[self.vocab[a], self.vocab[b]] = (r, t)
        self.n = n
        keys = np.array([a * n + b for a, b in self.merge], np.int64)
        order = np.argsort(keys)
        self._keys, self._ranks = keys[order], np.array([r for r, _ in self.merge.values()], np.int64)[order]
        self._result = np.zeros(len(keys), np.int64)  # of the merge of each rank
        self._result[[r for r, _ in self.merge.values()]] = [t for _, t in self.merge.values()]
        self.sound = self._self_encoding()
        self._finder = ahocorasick.Automaton()
        for t, i in self.vocab.items():
            self._finder.add_word(t[: -len(self.mark)] + _END if t.endswith(self.mark) else t, i)
        self._finder.make_automaton()
        self._verdicts: tuple[np.ndarray, np.ndarray] = (np.zeros(0, np.int64), np.zeros(0, bool))
        self._number = [str(i) for i in range(max(self.text_of) + 1)]
        self.cache: dict[str, str] = {}
        self.cache_words = cache_words
        self.merged_words = 0  # how many distinct words needed exact merging

    # -- verification on arrays -------------------------------------------------

    def _pair_rank(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        key = x * self.n + y
        at = np.minimum(np.searchsorted(self._keys, key), len(self._keys) - 1)
        return np.where(self._keys[at] == key, self._ranks[at], np.iinfo(np.int64).max)

    def _no_crossing(self, x: np.ndarray, y: np.ndarray, own: np.ndarray | None = None) -> np.ndarray:
        """For each border x|y: no merge crosses it before both sides are whole.

        x and y shrink backwards in merge order to the pieces that met at the
        border; a crossing merge of rank q fires if it comes before the merge
        that took either neighbour away (on equal rank the leftmost goes first).
        ``own``: the whole pair's own merge, which is allowed at the top.
        """
        never = np.iinfo(np.int64).max
        x, y = x.copy(), y.copy()
        gone_x, gone_y = np.full(len(x), never - 1), np.full(len(x), never - 1)
        if own is not None:
            gone_x, gone_y = own.copy(), own - 1  # the pair's own merge does not count against it
        good, live = np.ones(len(x), bool), np.arange(len(x))
        while len(live):
            q = self._pair_rank(x[live], y[live])
            fires = (q < gone_x[live]) & (q <= gone_y[live])
            good[live[fires]] = False
            live = live[~fires]
            rx, ry = self.rank[x[live]], self.rank[y[live]]
            live, rx, ry = (v[(rx >= 0) | (ry >= 0)] for v in (live, rx, ry))
            back = rx > ry
            i, j = live[back], live[~back]
            gone_x[i], x[i] = rx[back], self.right[x[i]]
            gone_y[j], y[j] = ry[~back], self.left[y[j]]
        return good

    def _self_encoding(self) -> np.ndarray:
        ok = np.ones(self.n, bool)
        t = np.flatnonzero(self.rank >= 0)
        t = t[np.argsort(self.rank[t])]
        fine = self._no_crossing(self.left[t], self.right[t], self.rank[t])
        for i, f in zip(t.tolist(), fine.tolist()):
            ok[i] = f and ok[self.left[i]] and ok[self.right[i]]
        return ok

    def compatible(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Verdicts on pairs of pieces; each distinct pair is worked out once."""
        key = x * self.n + y
        wanted = np.unique(key)
        known, verdict = self._verdicts
        at = np.minimum(np.searchsorted(known, wanted), max(len(known) - 1, 0))
        new = wanted[known[at] != wanted] if len(known) else wanted
        if len(new):
            if len(known) > 2_000_000:
                known, verdict, new = known[:0], verdict[:0], wanted
            all_ = np.concatenate((known, new))
            order = np.argsort(all_)
            found = np.concatenate((verdict, self._no_crossing(new // self.n, new % self.n)))
            known, verdict = self._verdicts = all_[order], found[order]
        return verdict[np.searchsorted(known, key)]

    # -- words ------------------------------------------------------------------

    def merged(self, words: list[str]) -> list[list[int]]:
        """Exact merging of words given in byte letters: lowest rank first, leftmost first.

        Words of one batch are rows of a matrix; every round merges one pair of each word that
        still has one to merge.
        """
        parts = [[*map(self.vocab.__getitem__, w[:-1]), self.vocab[w[-1] + self.mark]] for w in words]
        out: list[list[int] | None] = [self._merged_long(p) if len(p) > MATRIX else None for p in parts]
        rows = sorted((i for i, o in enumerate(out) if o is None), key=lambda i: len(parts[i]))
        for a in range(0, len(rows), 4096):  # words of about one length share a matrix
            part = rows[a : a + 4096]
            for i, p in zip(part, self._merge_rows([parts[i] for i in part])):
                out[i] = p
        return out

    def _merge_rows(self, parts: list[list[int]]) -> list[list[int]]:
        size = np.array([len(p) for p in parts])
        wide = int(size.max())
        m = np.full((len(parts), wide), -1, np.int64)
        m[np.arange(wide) < size[:, None]] = np.fromiter(chain.from_iterable(parts), np.int64, int(size.sum()))
        never = np.iinfo(np.int64).max
        due = np.where(m[:, 1:] >= 0, self._pair_rank(m[:, :-1], m[:, 1:]), never)
        live = np.flatnonzero(due.min(1) < never) if wide > 1 else np.zeros(0, np.int64)
        x, d, columns = m[live], due[live], np.arange(wide)
        while len(live):
            j = d.argmin(1)
            row = np.arange(len(live))
            x[row, j] = self._result[d[row, j]]
            # what follows the merged pair moves up by one
            take = columns + (columns > j[:, None])
            take[:, -1] = wide - 1
            x = np.take_along_axis(x, take, 1)
            size[live] -= 1
            x[row, size[live]] = -1
            d = np.take_along_axis(d, np.minimum(columns[:-1] + (columns[:-1] > j[:, None]), wide - 2), 1)
            d[row, np.maximum(size[live] - 1, 0)] = never
            for k, there in ((j - 1, j > 0), (j, j + 1 < size[live])):
                at = np.flatnonzero(there)
                d[at, k[at]] = self._pair_rank(x[at, k[at]], x[at, k[at] + 1])
            more = d.min(1) < never
            m[live[~more]] = x[~more]
            live, x, d = live[more], x[more], d[more]
        return [r[:n] for r, n in zip(m.tolist(), size.tolist())]

    def _merged_long(self, part: list[int]) -> list[int]:
        """The same over a heap of due merges, for words of any length."""
        n = len(part)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(m[0], i, m[1], p) for i, p in enumerate(zip(part, part[1:])) if (m := self.merge.get(p))]
        heapq.heapify(heap)
        while heap:
            _, i, whole, pair = heapq.heappop(heap)
            j = after[i]
            if j >= n or (part[i], part[j]) != pair:
                continue
            part[i], part[j] = whole, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (m := self.merge.get((part[x], part[y]))):
                    heapq.heappush(heap, (m[0], x, m[1], (part[x], part[y])))
        return [p for p in part if p >= 0]

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Pieces of each word, given in byte letters."""
        if not words:
            return []
        text = "".join([w + _END for w in words])
        found = np.array(list(self._finder.iter_long(text)), np.int64).reshape(-1, 2)
        end, piece = found[:, 0], found[:, 1]
        last = np.cumsum([len(w) + 1 for w in words]) - 1
        owner = np.searchsorted(last, end)
        size = np.bincount(owner, minlength=len(words))
        final = np.cumsum(size)
        good = (size > 0) & (end[np.maximum(final - 1, 0)] == last)
        np.logical_and.at(good, owner, self.sound[piece])
        inside = np.flatnonzero(owner[1:] == owner[:-1])
        np.logical_and.at(good, owner[inside], self.compatible(piece[inside], piece[inside + 1]))
        pieces = piece.tolist()
        out = [pieces[b - s : b] if g else None for g, s, b in zip(good.tolist(), size.tolist(), final.tolist())]
        failed = np.flatnonzero(~good).tolist()
        for i, pieces_ in zip(failed, self.merged([words[i] for i in failed])):
            out[i] = pieces_
        self.merged_words += int((~good).sum())
        return out

    def _pieces(self, run: str) -> list[str | int]:
        """Words (in byte letters) and ids of special tokens in a run without white space."""
        if run.isascii() and run.isalpha():
            return [run.lower()]
        out: list[str | int] = []
        for part in self._special.split(run) if self._special and "<" in run else [run]:
            if part in self.special:
                out.append(self.special[part])
            elif part:
                if part.isascii() and part.isprintable():
                    low = part.lower()
                    out += [low] if low.isalpha() else self._split.findall(low)
                    continue
                # lower case letter by letter: str.lower() alone would look at a sigma's neighbours
                low = unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()
                words = [low] if low.isalpha() else self._split.findall(low)
                out += [w if w.isascii() and w.isprintable() else w.encode("utf-8", "surrogatepass").decode("latin-1").translate(self._bytes) for w in words]
        return out

    def learn(self, runs: set[str]) -> None:
        """Encode runs that the cache does not hold yet."""
        split = [(r, self._pieces(r)) for r in runs]
        words = list({w for _, p in split for w in p if isinstance(w, str)})
        known: dict[str | int, list[int]] = dict(zip(words, self.encode_words(words)))
        known |= {i: [i] for i in self.special.values()}
        number = self._number
        for r, pieces in split:
            ids = known[pieces[0]] if len(pieces) == 1 else [i for p in pieces for i in known[p]]
            self.cache[r] = " ".join([number[i] for i in ids])

    def encode_texts(self, texts: list[str | None]) -> list[tuple[str, int]]:
        """(ids joined by one space, number of ids) of each text."""
        runs = [_RUNS.findall(t) if _ODD_CUTS.search(t) else t.split() for t in (x or "" for x in texts)]
        if len(self.cache) > self.cache_words:
            self.cache.clear()
        get = self.cache.get
        got = [list(map(get, r)) for r in runs]
        lacking = [k for k, g in enumerate(got) if None in g]
        if lacking:
            self.learn({w for k in lacking for w, g in zip(runs[k], got[k]) if g is None})
            get = self.cache.__getitem__
            for k in lacking:
                got[k] = list(map(get, runs[k]))
        out = []
        for g in got:
            # runs of no word (nothing but dropped characters) leave no trace
            line = " ".join(g if all(g) else filter(None, g))
            out.append((line, line.count(" ") + 1 if line else 0))
        return out


class Decoder:
    """Token texts of a tokenizer file by their decimal ids."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec.get("decoder") is not None:
            raise ValueError("a tokenizer without a decoder is needed")
        self.text_of = {str(i): t for t, i in spec["model"]["vocab"].items()} | {str(t["id"]): t["content"] for t in spec["added_tokens"]}

    def __call__(self, ids: str) -> str:
        """The text of decimal ids joined by one space: their tokens joined by one space (the
        file has no decoder); ids that no token has are left out."""
        texts = list(map(self.text_of.get, ids.split(" "))) if ids else []
        return " ".join(texts if None not in texts else [t for t in texts if t is not None])


def _byte_letters() -> dict[int, str]:
    """Byte -> letter of byte-level vocabularies: printable ones stand for themselves,
    the others follow from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


@lru_cache(maxsize=2)
def tokenizer(path: str) -> Bpe:
    """One tokenizer per worker process and file."""
    gc.set_threshold(200_000, 50, 50)  # the cache is many small objects without cycles
    return Bpe(path)


@lru_cache(maxsize=2)
def decoder(path: str) -> Decoder:
    return Decoder(path)


def _pieces_of(texts: list[str | None], most: int = 2_000_000) -> Iterator[tuple[int, int]]:
    a = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t or "") > most:
            yield a, i
            a, size = i, 0
        size += len(t or "")
    if a < len(texts):
        yield a, len(texts)


def encode(docs: DataFrame, path: str, *, doc_id: str = "doc_id", text: str = "text", decoded: bool = False) -> DataFrame:
    """(doc_id, ids, n_tokens): decimal ids of the whole text joined by one space, their number;
    with ``decoded`` also the text that these ids stand for, read from them (see ``decode``) in
    the same pass.

    Null and blank texts have no ids and decode to the empty text. Repeated rows are encoded
    alike, an empty table gives an empty result. ``path`` must be readable on the executors
    (it is part of the installed tokenizer files).
    """
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.string()), ("n_tokens", pa.int64()), *[("decoded", pa.string())] * decoded])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, of = tokenizer(path), decoder(path)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in _pieces_of(texts):
                ids, n = map(list, zip(*tok.encode_texts(texts[a:b])))
                columns = [batch.column("doc_id")[a:b], pa.array(ids, pa.string()), pa.array(n, pa.int64())]
                yield pa.record_batch(columns + [pa.array(map(of, ids), pa.string())] * decoded, schema=schema)
        # workers are reused by other stages: the cache goes with its task
        tok.cache.clear()
        trim_memory()

    rows = project(docs, doc_id=doc_id, text=text).withColumn("doc_id", F.col("doc_id").cast("long"))
    return rows.mapInArrow(run, "doc_id long, ids string, n_tokens long" + ", decoded string" * decoded)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """The rows of ``encoded`` (doc_id, ids, n_tokens) with ``decoded``, the text that their ids
    stand for.

    Only the ids are read: null or empty ids decode to the empty text, ids that no token has
    are left out, special tokens are kept. Repeated rows are decoded alike.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.string()), ("n_tokens", pa.int64()), ("decoded", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = decoder(path)
        for batch in batches:
            ids = batch.column("ids")
            for a, b in _pieces_of(ids.to_pylist()):
                part = batch.slice(a, b - a)
                texts = [of(i or "") for i in part.column("ids").to_pylist()]
                yield pa.record_batch([*part.select(["doc_id", "ids", "n_tokens"]).columns, pa.array(texts, pa.string())], schema=schema)

    return encoded.select("doc_id", "ids", "n_tokens").mapInArrow(run, "doc_id long, ids string, n_tokens long, decoded string")


def token_ids(ids: str = "ids"):
    """Column of the ids as an array of integers."""
    return F.when(F.col(ids) == "", F.array().cast("array<int>")).otherwise(F.split(ids, " ").cast("array<int>"))
