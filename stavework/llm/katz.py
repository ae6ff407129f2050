"""Language model scoring: a Katz back-off model of any order, trigrams by default.

    P(w | h) = d(r) r / c(h)            if h w was seen r > 0 times in training
             = alpha(h) P(w | h')       otherwise; h' is h without its first word,
                                        alpha = 1 for an h that was never seen
    P(w)     = d(c) c / N               if w was seen c > 0 times, else what is left over
d is Good-Turing's discount of each order for counts up to k, the largest k <= 5 for which
the counts 1..k+1 occur, every discount lies in (0, 1) and what is kept grows with the
count (half an occurrence is taken off counts up to 5 if there is none), and takes a tenth
of an occurrence off larger counts, so every context keeps mass to back off with.
alpha(h) divides what the discounts leave of h by the mass that the words never seen after
h have under h', so every distribution sums to one, the unknown word included.

Three exchanges of compressed arrays, none of one row per token:
  1. words -> their training counts, kept as the table of unigrams;
  2. (word, its contexts, text) by word: counts of all n-grams that end in the word, kept as
     tables of n-grams by context, and each text's sums over tokens seen at the top order;
  3. n-grams and unseen tokens by the last word of the context: back-off weights of all
     orders, and the recursion for every token that the top order has not seen.
Words that hold more than an eighth of a bucket (``HOT`` at most) are spread: as words by
their context, as contexts by the word before, and their own sums are added up once.
Frequent words travel as their rank, the others as their 64-bit hash. n-grams are the same
if these hashes are. Sums of texts travel as multiples of 2^-30.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stavework.llm._env import folded, free_shuffles, input_splits, lean_memory, project, trim_memory, write_table
from stavework.llm._packed import get, get_sorted, put, put_sorted
from stavework.llm._words import U, chunks, mix, words_of

K, TAIL = 5, 0.1
#: Words that travel as their rank; words that may be spread over the buckets.
NAMES, HOT = 262_143, 4_096
END, START = mix(np.array([1, 2], U))
NO_ID = -(2**63)
PART = "kind int, bucket int, payload array<binary>"
CHUNK = 4_000_000


class Discount:
    """What is kept of a count: ``value(r)`` is d(r) r, which grows with r."""

    def __init__(self, count_of_counts: list[int]):
        n = [0, *count_of_counts]
        d = [1 - 0.5 / r for r in range(1, K + 1)]
        for k in range(K, 0, -1):
            if not all(n[r] > 0 for r in range(1, k + 2)) or (cut := (k + 1) * n[k + 1] / n[1]) == 1:
                continue
            gt = [((r + 1) * n[r + 1] / (n[r] * r) - cut) / (1 - cut) for r in range(1, k + 1)]
            kept = [x * r for r, x in enumerate(gt, 1)] + [k + 1 - TAIL]
            if all(0 < x < 1 for x in gt) and all(a < b for a, b in zip(kept, kept[1:])):
                d = gt + [1 - TAIL / r for r in range(k + 1, K + 1)]
                break
        self.kept = np.array([0.0] + [x * r for r, x in enumerate(d, 1)])

    def value(self, r: np.ndarray) -> np.ndarray:
        return np.where(r <= K, self.kept[np.minimum(r, K)], r - TAIL)


class Unigrams:
    """Discounted word probabilities from N, V and the counts of counts."""

    def __init__(self, n: int, v: int, count_of_counts: list[int]):
        self.n, self.v, self.discount = n, v, Discount(count_of_counts)
        low = count_of_counts[:K]
        large, large_n = v - sum(low), n - sum(r * x for r, x in enumerate(low, 1))
        seen = sum(x * self.discount.kept[r] for r, x in enumerate(low, 1)) + large_n - TAIL * large
        self.unknown = 1 - seen / n if n else 1.0

    def p(self, c: np.ndarray) -> np.ndarray:
        return np.where(c > 0, self.discount.value(c) / max(self.n, 1), self.unknown)


class Names:
    """Frequent words by their rank (from 1), the others by their hash; the hot ones' counts."""

    def __init__(self, ranked: np.ndarray, hot: np.ndarray, hot_c: np.ndarray):
        order = np.argsort(ranked)
        self.ranked, self.words, self.rank = ranked, ranked[order], (order + 1).astype(np.uint32)
        self.hot, self.hot_c = hot, hot_c

    def put(self, h: np.ndarray) -> list[bytes]:
        at = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
        known = self.words[at] == h
        return [put(np.where(known, self.rank[at], np.uint32(0))), put(h[~known])]

    def get(self, code: bytes, other: bytes) -> np.ndarray:
        at = get(code, np.uint32).astype(np.int64)
        out = self.ranked[np.maximum(at - 1, 0)]
        out[at == 0] = get(other, U)
        return out

    def place(self, h: np.ndarray) -> np.ndarray:
        """Index among the hot words, -1 for others."""
        if not len(self.hot):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self.hot, h), len(self.hot) - 1)
        return np.where(self.hot[at] == h, at, -1)


def _batch(texts: list[bytes], order: int) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """(word, the words before it, text) of every token, the end of each text included."""
    lean_memory()
    w = words_of(texts, lower=True)
    n = len(texts)
    at = w.first[1:] + np.arange(n)  # where the ends go
    token = np.full(len(w.hash) + n, END)
    token[np.delete(np.arange(len(token)), at)] = w.hash
    doc = np.repeat(np.arange(n), np.diff(w.first) + 1)
    begin = (w.first[:-1] + np.arange(n))[doc] if n else np.zeros(0, np.int64)
    place = np.arange(len(token))
    return token, [np.where(place - k >= begin, token[np.maximum(place - k, 0)], START) for k in range(1, order)], doc


def _split_by(bucket: np.ndarray, buckets: int) -> list[tuple[int, np.ndarray]]:
    order = np.argsort(bucket, kind="stable")
    cut = np.searchsorted(bucket[order], np.arange(buckets + 1))
    return [(k, order[a:b]) for k, (a, b) in enumerate(zip(cut, cut[1:])) if a < b]


def _top(x: np.ndarray, bits: int) -> np.ndarray:
    return (x >> U(64 - bits)).astype(np.int64) if bits else np.zeros(len(x), np.int64)


def _frame(rows: list[tuple[int, int, list[bytes]]]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["kind", "bucket", "payload"])


def _put_sums(x: np.ndarray) -> bytes:
    n = np.rint(x * 2**30).astype(np.int64)
    return put((n << 1) ^ (n >> 63))  # small either side of zero


def _get_sums(data: bytes) -> np.ndarray:
    n = get(data, np.int64)
    return ((n >> 1) ^ -(n & 1)) / 2**30


def _new(*keys: np.ndarray) -> np.ndarray:
    """Where the first of equal (sorted) rows stands."""
    out = np.zeros(len(keys[0]), bool)
    out[:1] = True
    for k in keys:
        out[1:] |= k[1:] != k[:-1]
    return out


def _count_words(bits: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            learn = pdf[~pdf.held]
            for _, texts in chunks(learn.doc_id.tolist(), learn.text.tolist(), CHUNK):
                w, c = np.unique(_batch(texts, 1)[0], return_counts=True)
                yield _frame([(0, k, [put_sorted(w[i]), put(c[i].astype(np.uint32))]) for k, i in _split_by(_top(w, bits), 1 << bits)])

    return run


def _add_words(most: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        w = np.concatenate([get_sorted(p[0]) for p in pdf.payload])
        n = np.concatenate([get(p[1], np.uint32) for p in pdf.payload])
        w, at = np.unique(w, return_inverse=True)
        c = np.bincount(at, n).astype(np.int64)
        top = np.sort(np.argsort(-c, kind="stable")[:most])
        return pd.DataFrame({"bucket": pdf.bucket.iloc[:1], "words": [put_sorted(w)], "counts": [put(c)], "n": [c.sum()], "v": [len(c)], "r": [np.bincount(np.minimum(c, K + 2), minlength=K + 3)[1 : K + 2]], "top": [put(w[top])], "top_c": [put(c[top])]})

    return run


def _send_tokens(bits: int, names: Names, order: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        row, part = 0, TaskContext.get().partitionId()
        for pdf in batches:
            for at, texts in chunks(list(range(len(pdf))), pdf.text.tolist(), CHUNK):
                docs = pdf.iloc[at]
                key = np.arange(row, row + len(at), dtype=np.int64) + (part << 40)
                row += len(at)
                ids, held = docs.doc_id.fillna(NO_ID).to_numpy(np.int64), docs.held.to_numpy(bool)
                w, before, d = _batch(texts, order)
                near = before[0] if before else np.zeros(len(w), U)
                bucket = _top(np.where(names.place(w) >= 0, mix(w ^ (near * U(3))), w), bits)
                out = []
                for k, i in _split_by(bucket, 1 << bits):
                    i = i[np.lexsort((near[i], w[i]))]
                    firsts = np.flatnonzero(_new(w[i]))
                    used, di = np.unique(d[i], return_inverse=True)
                    ends = d[i[w[i] == END]]  # a text's id goes with its end
                    sent = [put_sorted(w[i][firsts]), put(np.diff(firsts, append=len(i)).astype(np.uint32)), put(di.astype(np.uint32)), put_sorted(key[used].view(U)), put(held[used]), put(np.searchsorted(used, ends).astype(np.uint32)), put(ids[ends])]
                    out.append((0, k, sent + [x for b in before for x in names.put(b[i])]))
                yield _frame(out)

    return run


def _by_context(v: np.ndarray, u: np.ndarray | None, names: Names, bits: int) -> np.ndarray:
    """Bucket of a context: by its last word, hot ones by the word before it."""
    return _top(np.where(names.place(v) >= 0, mix(v ^ (u * U(3))), v) if u is not None else v, bits)


def _ngrams(bits: int, names: Names, uni: Unigrams, order: int):
    """Bucket of words: (0) sums of texts by text, (1) n-grams and (2) tokens unseen at the top
    order by context, (3) sums over the followers of hot contexts, (4) counts of counts."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        lean_memory()
        p = list(pdf.payload)
        w = np.concatenate([np.repeat(get_sorted(x[0]), get(x[1], np.uint32)) for x in p])
        before = [np.concatenate([names.get(x[7 + 2 * k], x[8 + 2 * k]) for x in p]) for k in range(order - 1)]
        offset = np.cumsum([0] + [len(get(x[4], bool)) for x in p])[:-1]
        d = np.concatenate([get(x[2], np.uint32).astype(np.int32) + np.int32(o) for x, o in zip(p, offset)])
        keys, held = np.concatenate([get_sorted(x[3]).view(np.int64) for x in p]), np.concatenate([get(x[4], bool) for x in p])
        ids = np.full(len(keys), NO_ID, np.int64)
        has_id = np.zeros(len(keys), bool)
        for x, o in zip(p, offset):
            at = get(x[5], np.uint32).astype(np.int64) + o
            ids[at], has_id[at] = get(x[6], np.int64), True
        del p
        sort = np.lexsort((*before[::-1], w))
        w, d = w[sort], d[sort]
        for k in range(order - 1):
            before[k] = before[k][sort]
        del sort
        learns = ~held[d]
        # types of every order: equal words with equally many words before them, nested
        new = _new(w)
        firsts, counts = [], []
        for j in range(order):
            if j:
                new[1:] |= before[j - 1][1:] != before[j - 1][:-1]
            firsts.append(np.flatnonzero(new))
            counts.append(np.add.reduceat(learns, firsts[j], dtype=np.int64))
        del new, learns
        place = names.place(w[firsts[0]])
        if len(names.hot):
            counts[0] = np.where(place >= 0, names.hot_c[np.maximum(place, 0)], counts[0])
        size = [np.diff(f, append=len(w)) for f in firsts]
        each = lambda x, j: np.repeat(x, size[j])  # noqa: E731  of types for tokens
        m, top = len(keys), order - 1
        log = lambda x, on: np.log10(np.where(on, x, 1))
        add = lambda x, j: np.bincount(d, each(x, j), minlength=m)
        # the gram of the top order but one is the context of the next token, an end is none
        r = counts[top]
        if order > 1:
            followed = (w[firsts[top - 1]] != END) & (counts[top - 1] > 0)
            main = add(log(r - TAIL, r > K), top) - add(log(counts[top - 1], followed), top - 1)
        else:
            main = add(log(r - TAIL, r > K) - np.log10(max(uni.n, 1)), top)
        sums = [_put_sums, add(np.log10(counts[0] + 0.1), 0)], [_put_sums, main]
        small = [np.bincount(d, minlength=m), add(counts[0] > 0, 0), *(add(r == k, top) for k in range(1, K + 1))]
        sums = [*sums, *([put, x.astype(np.uint32)] for x in small)]
        out = []
        for k, i in _split_by(_top(mix(keys.view(U)), bits), 1 << bits):
            i = i[np.argsort(keys[i], kind="stable")]
            out.append((0, k, [put_sorted(keys[i].view(U)), put(held[i]), put(np.flatnonzero(has_id[i]).astype(np.uint32)), put(ids[i][has_id[i]]), *[f(x[i]) for f, x in sums]]))
        del sums, small, main
        # of every type the type of each lower order that it continues
        parent = lambda at, j: np.searchsorted(firsts[j], at, side="right") - 1
        c_of = lambda at: counts[0][parent(at, 0)]
        second = before[1] if order > 2 else None
        if order > 1:
            pairs = firsts[1][counts[1] > 0]
            hot = names.place(before[0][pairs])
            some = np.unique(hot[hot >= 0])
            if len(some):
                at, rest, n = np.searchsorted(some, hot[hot >= 0]), pairs[hot >= 0], counts[1][counts[1] > 0][hot >= 0]
                low = [np.bincount(at, np.minimum(n, K + 1) == k, minlength=len(some)).astype(np.int64) for k in range(1, K + 2)]
                mass = np.bincount(at, uni.p(c_of(rest)), minlength=len(some))
                out += [(3, int(k), [put(some[i]), *[put(x[i]) for x in low], put(mass[i])]) for k, i in _split_by(some % 64, 64)]
            model = firsts[top][r > 0] if order > 2 else pairs[hot < 0]
            v = before[0][model]
            for k, i in _split_by(_by_context(v, None if second is None else second[model], names, bits), 1 << bits):
                i = model[i]
                i = i[np.argsort(before[0][i], kind="stable")]  # by context, then word: pairs and their longer grams
                of = [parent(i, j) for j in range(1, order)]
                starts = [np.flatnonzero(_new(*of[: j + 1])) for j in range(order - 1)]
                first = i[starts[0]]
                sent = [put_sorted(before[0][first]), put(c_of(first))]
                for j in range(order - 1):
                    sent += names.put(before[j][i[starts[j]]]) if j else []
                    sent.append(put(counts[j + 1][of[j][starts[j]]].astype(np.uint32)))
                    if j < order - 2:
                        sent.append(put(np.diff(np.searchsorted(starts[j + 1], starts[j]), append=len(starts[j + 1])).astype(np.uint32)))
                out.append((1, k, sent))
        lost = np.flatnonzero(each(r == 0, top))
        v = before[0][lost] if order > 1 else keys[d[lost]].view(U)
        for k, i in _split_by(_by_context(v, second[lost] if second is not None else None, names, bits), 1 << bits):
            i = lost[i]
            i = i[np.argsort(before[0][i], kind="stable")] if order > 1 else i
            near = before[0][i] if order > 1 else np.zeros(len(i), U)
            out.append((2, k, [put_sorted(near), put(keys[d[i]]), *[put(counts[j][parent(i, j)]) for j in range(top)], *[x for b in before[1:] for x in names.put(b[i])]]))
        spread = [np.bincount(np.minimum(counts[j], K + 2), minlength=K + 3)[1 : K + 2] for j in range(order)]
        out.append((4, int(pdf.bucket.iloc[0]) % 64, [np.array(spread, np.int64).tobytes()]))
        found = _frame(out)
        del w, before, d, firsts, counts, size, out, each, add, parent, c_of, second, lost, v, r
        trim_memory()
        return found

    return run


def _add_up(pdf: pd.DataFrame) -> pd.DataFrame:
    """Counts of counts, or sums of hot contexts, of many buckets as one row."""
    kind = int(pdf.kind.iloc[0])
    if kind == 4:
        total = np.sum([np.frombuffer(p[0], np.int64) for p in pdf.payload], 0)
        return _frame([(4, 0, [total.tobytes()])])
    names, at = np.unique(np.concatenate([get(p[0], np.int64) for p in pdf.payload]), return_inverse=True)
    low = [np.bincount(at, np.concatenate([get(p[k], np.int64) for p in pdf.payload])).astype(np.int64) for k in range(1, K + 2)]
    mass = np.bincount(at, np.concatenate([get(p[K + 2], float) for p in pdf.payload]))
    return _frame([(3, 0, [put(names), *map(put, low), put(mass)])])


class Level:
    """Contexts of one order: their counts, what discounts leave of them, and the mass of the
    words never seen after them under the next lower order."""

    def __init__(self, contexts: list[np.ndarray], count: np.ndarray, left: np.ndarray, rest: np.ndarray):
        self.key, self.count, self.left, self.rest = _context_key(contexts), count, left, rest
        sort = np.argsort(self.key, kind="stable")
        self.key, self.count, self.left, self.rest = (x[sort] for x in (self.key, count, left, rest))

    def find(self, contexts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(count, left, rest) of each context; a count of 0 where it was never seen."""
        key = _context_key(contexts)
        if not len(self.key):
            return np.zeros(len(key)), np.ones(len(key)), np.ones(len(key))
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        hit = self.key[at] == key
        return np.where(hit, self.count[at], 0), np.where(hit, self.left[at], 1.0), np.where(hit, self.rest[at], 1.0)


def _context_key(contexts: list[np.ndarray]) -> np.ndarray:
    key = contexts[0]
    for c in contexts[1:]:
        key = mix(key * U(5) + c)
    return key


def _levels(rows: list, names: Names, hot: tuple[np.ndarray, ...], uni: Unigrams, discounts: list[Discount], order: int) -> list[Level]:
    """Back-off weights of every context of a bucket, shortest contexts first."""
    levels: list[Level] = []
    parts = [np.concatenate([get_sorted(x[0]) for x in rows])] if rows else [np.zeros(0, U)]
    lower = np.concatenate([get(x[1], np.int64) for x in rows]) if rows else np.zeros(0, np.int64)
    at = 2
    for j in range(1, order):
        if j > 1:
            n = np.concatenate([get(x[at], np.uint32) for x in rows]) if rows else np.zeros(0, np.uint32)
            more = np.concatenate([names.get(x[at + 1], x[at + 2]) for x in rows]) if rows else np.zeros(0, U)
            parts, lower, at = [*[np.repeat(x, n) for x in parts], more], np.repeat(r, n), at + 3
        r = np.concatenate([get(x[at], np.uint32) for x in rows]).astype(np.int64) if rows else np.zeros(0, np.int64)
        at += 1
        p = uni.p(lower) if j == 1 else discounts[j - 1].value(lower) / np.maximum(levels[-1].find(parts[: j - 1])[0], 1)
        # hot words as contexts come with their sums: a bucket holds some of their followers only
        own = names.place(parts[0]) < 0 if j == 1 else slice(None)
        key, first, group = np.unique(_context_key(parts)[own], return_index=True, return_inverse=True)
        count = np.bincount(group, r[own], minlength=len(key))
        left = np.bincount(group, (r - discounts[j].value(r))[own], minlength=len(key))
        rest = 1 - np.bincount(group, p[own], minlength=len(key))
        context = [x[own][first] for x in parts]
        if j == 1 and len(hot[0]):
            context, count, left, rest = [np.concatenate((context[0], hot[0]))], np.concatenate((count, hot[1])), np.concatenate((left, hot[2])), np.concatenate((rest, hot[3]))
        levels.append(Level(context, count, left, np.maximum(rest, 1e-300)))
    return levels


def _back_off(bits: int, names: Names, hot: tuple[np.ndarray, ...], uni: Unigrams, discounts: list[Discount], order: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        lost = list(pdf.payload[pdf.kind == 2])
        if not lost:
            return _frame([])
        levels = _levels(list(pdf.payload[pdf.kind == 1]), names, hot, uni, discounts, order)
        key = np.concatenate([get(x[1], np.int64) for x in lost])
        counts = [np.concatenate([get(x[2 + k], np.int64) for x in lost]) for k in range(order - 1)]
        contexts = [np.concatenate([get_sorted(x[0]) for x in lost])]
        contexts += [np.concatenate([names.get(x[1 + order + 2 * k], x[2 + order + 2 * k]) for x in lost]) for k in range(order - 2)]
        value, open_ = np.zeros(len(key)), np.ones(len(key), bool)
        for j in range(order - 1, 0, -1):  # nothing was seen with j words before it
            count, left, rest = levels[j - 1].find(contexts[:j])
            # the count of the longest context is already in the text's sums
            value += np.where(open_ & (count > 0), np.log10(left / rest) - (np.log10(np.maximum(count, 1)) if j < order - 1 else 0), 0)
            if j > 1:
                r = counts[j - 1]
                below = levels[j - 2].find(contexts[: j - 1])[0]
                seen = open_ & (r > 0)
                value += np.where(seen, np.log10(np.maximum(discounts[j - 1].value(r), 1e-300)) - np.log10(np.maximum(below, 1)), 0)
                open_ &= ~seen
        value += np.where(open_, np.log10(uni.p(counts[0])) if order > 1 else np.log10(uni.unknown), 0)
        if order == 1:  # the text's sums divide every token by N
            value += np.log10(max(uni.n, 1))
        keys, at = np.unique(key, return_inverse=True)
        total = np.bincount(at, value)
        return _frame([(5, k, [put_sorted(keys[i].view(U)), put(total[i])]) for k, i in _split_by(_top(mix(keys.view(U)), bits), 1 << bits)])

    return run


def _finish(uni: Unigrams, top: Discount, starts: int, order: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        docs = [x for x, k in zip(pdf.payload, pdf.kind) if k == 0]
        more = [x for x, k in zip(pdf.payload, pdf.kind) if k == 5]
        key = np.concatenate([get_sorted(x[0]).view(np.int64) for x in docs])
        held = np.concatenate([get(x[1], bool) for x in docs])
        keys, first, at = np.unique(key, return_index=True, return_inverse=True)
        ids = np.full(len(keys), NO_ID, np.int64)
        for x in docs:
            ids[np.searchsorted(keys, get_sorted(x[0]).view(np.int64)[get(x[2], np.uint32)])] = get(x[3], np.int64)
        add = lambda j, kind: np.bincount(at, np.concatenate([get(x[j], kind) for x in docs]))
        sums = lambda j: np.bincount(at, np.concatenate([_get_sums(x[j]) for x in docs]))
        base, score, tokens, known = sums(4), sums(5), add(6, np.uint32).astype(np.int64), add(7, np.uint32).astype(np.int64)
        for r in range(1, K + 1):
            score += add(7 + r, np.uint32) * np.log10(top.kept[r])
        if starts and order > 1:
            score -= np.log10(starts)
        for x in more:
            score[np.searchsorted(keys, get_sorted(x[0]).view(np.int64))] += get(x[1], float)
        base -= tokens * np.log10(uni.n + 0.1 * (uni.v + 1))
        named = pd.array(ids, "Int64")
        named[ids == NO_ID] = pd.NA
        return pd.DataFrame({"doc_id": named, "held_out": held[first], "n_tokens": tokens, "n_known": known, "train_tokens": uni.n, "base_score": base, "score": score})

    return run


def score_texts(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", folds: int = 10, order: int = 3) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    The model learns n-grams of up to ``order`` words from all rows whose fold is not 0. Null
    and empty texts are one end token. A null id is never held out. Repeated rows are rows
    of their own, and train as often as they occur. Without training rows every token is the
    unknown word. An empty table gives an empty result. The driver sees counts of counts, the
    ``NAMES`` most frequent words and the sums of ``HOT`` contexts at most.
    """
    spark = docs.sparkSession
    bits = int(min(20, max(4, np.ceil(np.log2(2 * input_splits(docs))))))
    rows = project(docs, doc_id=doc_id, text=text).select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("held", F.coalesce(folded(F.col("doc_id"), folds) == 0, F.lit(False)))
    sent = rows.mapInPandas(_count_words(bits), PART)
    most = max(64, 2 * NAMES >> bits)
    words = write_table(sent.groupBy("bucket").applyInPandas(_add_words(most), "bucket int, words binary, counts binary, n long, v long, r array<long>, top binary, top_c binary"), "unigrams", partition_by=["bucket"]).df()
    stats = words.select("n", "v", "r", "top", "top_c").collect()
    n, v = sum(s["n"] for s in stats), sum(s["v"] for s in stats)
    uni = Unigrams(n, v, [sum(s["r"][k] for s in stats) for k in range(K + 1)])
    w = np.concatenate([np.zeros(0, U), *[get(bytes(s["top"]), U) for s in stats]])
    c = np.concatenate([np.zeros(0, np.int64), *[get(bytes(s["top_c"]), np.int64) for s in stats]])
    rank = np.lexsort((w, -c))[: NAMES - 1]  # and the start of a text
    often = rank[:HOT][c[rank[:HOT]] * 8 * 2**bits >= n]
    often = often[np.argsort(w[often])]
    starts = int(c[w == END].sum())  # one end a text; the start of a text is a context as often
    hot, hot_c = w[often], c[often]
    if starts * 8 * 2**bits >= n > 0:
        at = int(np.searchsorted(hot, START))
        hot, hot_c = np.insert(hot, at, START), np.insert(hot_c, at, starts)
    names = Names(np.append(w[rank], START), hot, hot_c)
    free_shuffles(spark)

    tokens = rows.mapInPandas(_send_tokens(bits, names, order), PART)
    counted = write_table(tokens.groupBy("bucket").applyInPandas(_ngrams(bits, names, uni, order), PART), "ngrams", partition_by=["kind"])
    totals = counted.df().where("kind in (3, 4)").groupBy("kind", "bucket").applyInPandas(_add_up, PART).collect()
    found = [np.frombuffer(bytes(t["payload"][0]), np.int64).reshape(order, -1) for t in totals if t["kind"] == 4]
    per_order = np.sum(found, 0) if found else np.zeros((order, K + 1), np.int64)
    discounts = [uni.discount] + [Discount([int(x) for x in per_order[j]]) for j in range(1, order)]
    sums = _hot_sums([t["payload"] for t in totals if t["kind"] == 3], names, discounts)
    free_shuffles(spark)
    by_context = counted.df().where("kind in (1, 2)").groupBy("bucket").applyInPandas(_back_off(bits, names, sums, uni, discounts, order), PART)
    parts = counted.df().where("kind = 0").select("kind", "bucket", "payload").unionByName(by_context)
    return parts.groupBy("bucket").applyInPandas(_finish(uni, discounts[-1], starts, order), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def _hot_sums(rows: list, names: Names, discounts: list[Discount]) -> tuple[np.ndarray, ...]:
    """(word, count, left, rest) of the hot words as contexts."""
    if not rows or len(discounts) < 2:
        return (np.zeros(0, U),) * 4
    at = np.concatenate([get(bytes(x[0]), np.int64) for x in rows])
    left = np.zeros(len(at))
    for k in range(1, K + 2):
        taken = k - discounts[1].kept[k] if k <= K else TAIL
        left += taken * np.concatenate([get(bytes(x[k]), np.int64) for x in rows])
    rest = 1 - np.concatenate([get(bytes(x[K + 2]), float) for x in rows])
    return names.hot[at], names.hot_c[at].astype(float), left, rest
