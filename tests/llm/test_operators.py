"""Brute-force comparisons on small, awkward tables: nulls, empty texts, ties, repeats, extra columns."""

import hashlib
import random
import zlib

import numpy as np
import pytest

pytest.importorskip("stavework.llm")
pytest.importorskip("stavework.llm.queries")

public_tokenizers = pytest.importorskip("public_tokenizers")

random.seed(4)
WORDS = [f"w{i}" for i in range(400)]


def _text(n):
    return " ".join(random.choice(WORDS) for _ in range(n))


PASSAGE = _text(70)
BASE = [_text(random.randint(20, 120)) for _ in range(30)]
TEXTS = BASE + [BASE[0], BASE[0] + " extra", BASE[1].replace(" ", "  "), None, "", "   ", "one", "one", "two words", BASE[2] + " " + PASSAGE, PASSAGE + " " + BASE[3], "A" * 3000, _text(3000), "İstanbul <|endoftext|> Ünï", "x\x00y \x1c z"]


@pytest.fixture(scope="module")
def docs(spark):
    # extra columns under names that the operators use themselves
    rows = [(i, t, "en", None if i % 7 == 0 else f"s{i % 3}", len(t or ""), "k", 1) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key string, n int").repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark, docs):
    return spark.createDataFrame([], docs.schema)


def _words(t):
    return (t or "").encode().split()


def test_substrings(docs, empty):
    from stavework.llm.substring import remove_repeats

    got = {r.doc_id: r for r in remove_repeats(docs).collect()}
    first = {}
    for i, t in enumerate(TEXTS):
        w = _words(t)
        gone = [False] * len(w)
        for k in range(len(w) - 12):
            if first.setdefault(tuple(w[k : k + 13]), i) < i:
                gone[k : k + 13] = [True] * 13
        assert got[i].kept == b" ".join(x for x, g in zip(w, gone) if not g).decode()
        assert (got[i].n_words, got[i].n_removed) == (len(w), sum(gone))
    assert remove_repeats(empty).count() == 0


@pytest.mark.parametrize("words,num", [(4, 85), (5, 80)])
def test_jaccard_classes(docs, words, num):
    from stavework.llm.ngram_join import jaccard_classes

    def shingles(t):
        w = [x.lower() for x in _words(t)]
        return {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set())

    sets = [shingles(t) for t in TEXTS]
    part = list(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a):
            inter = len(sets[a] & sets[b])
            if inter and 100 * inter >= num * len(sets[a] | sets[b]):
                low, high = sorted((part[a], part[b]))
                part = [low if p == high else p for p in part]
    for rare, block in ((64, 1024), (1, 8)):  # the second sends everything through combinations
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_classes(docs, words=words, similarity=(num, 100), rare=rare, block=block).collect()}
        assert got == {i: (len(s), part[i]) for i, s in enumerate(sets)}


def test_bpe_round_trip(docs, empty):
    from tokenizers import Tokenizer

    from stavework.llm import bpe

    path = str(public_tokenizers.path("word_bpe_49k.json"))
    tok = Tokenizer.from_file(path)
    both = {r.doc_id: (r.ids, r.n_tokens, r.decoded) for r in bpe.encode(docs, path, decoded=True).collect()}
    for r in bpe.decode(bpe.encode(docs, path), path).collect():
        want = tok.encode(TEXTS[r.doc_id] or "", add_special_tokens=False).ids
        assert (r.ids, r.n_tokens, r.decoded) == tuple(both[r.doc_id]) == (" ".join(map(str, want)), len(want), tok.decode(want, skip_special_tokens=False))
    assert bpe.decode(bpe.encode(empty, path), path).count() == 0


def test_token_files(spark, docs, tmp_path):
    from tokenizers import Tokenizer

    from stavework.llm import tokenfile

    path = str(public_tokenizers.path("byte_bpe_50k.json"))
    tok, start = Tokenizer.from_file(path), 0
    tokenfile.write(docs, f"file://{tmp_path}/t", path, segment_ids=500)
    got = {r.doc_id: r for r in tokenfile.read(spark, f"file://{tmp_path}/t").collect()}
    for i, t in enumerate(TEXTS):
        want = np.array(tok.encode(t or "", add_special_tokens=False).ids + [0], "<u4").tobytes()
        assert (got[i].start, got[i].n_tokens, zlib.crc32(got[i].ids)) == (start, len(want) // 4, zlib.crc32(want))
        start += len(want) // 4


def test_pack_keeps_outliers():
    from stavework.llm.tokenfile import pack, unpack

    ids = np.r_[np.arange(300), [2**32 - 1], np.zeros(200, int)].astype(np.int64)
    back, lengths = unpack(pack(ids, np.array([300, 201])))
    assert (back == ids).all() and list(lengths) == [300, 201]


def test_mixture(docs, empty):
    from stavework.llm.mixing import mixed_documents, mixture, water_fill

    rows = mixture(docs).collect()
    assert sorted((r.doc_id, r.taken) for r in rows) == sorted((r.doc_id, r.taken) for r in mixture(docs.repartition(5)).collect())
    assert all(r.size == len(_words(TEXTS[r.doc_id])) and r.taken <= 2 * r.size for r in rows)
    target = water_fill([("a", 10), ("b", 100), (None, 50)], [5, 2, 1], 1.5, 2)
    assert target["a"] == 20 and sum(target.values()) == pytest.approx(240) and target["b"] == pytest.approx(220 * 2 / 3)
    assert mixed_documents(docs).count() == sum(r.times for r in rows)
    assert mixture(empty).count() == 0


def test_mixture_meets_targets_within_half_a_document(spark):
    from stavework.llm.mixing import mixture

    texts = [(0, "w " * 100, "long")] + [(i, "w " * (3 * i), "short") for i in range(1, 9)]
    rows = mixture(spark.createDataFrame(texts, "doc_id long, text string, source string"), weights=(1, 1), share=1.6, max_epochs=2).collect()
    for source in ("long", "short"):
        mine = [r for r in rows if r.source == source]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= max(r.size for r in mine) / 2


class BruteKatz:
    """The model by its definition, on tuples of words."""

    def __init__(self, texts, order):
        from collections import Counter

        from stavework.llm.katz import Discount, Unigrams

        self.order, self.grams = order, [Counter() for _ in range(order)]
        for t in texts:
            w = self.tokens(t)
            for i in range(order - 1, len(w)):
                for j in range(order):
                    self.grams[j][tuple(w[i - j : i + 1])] += 1
        spread = lambda g: [sum(c == r for c in g.values()) for r in range(1, 7)]
        self.uni = Unigrams(sum(self.grams[0].values()), len(self.grams[0]), spread(self.grams[0]))
        self.kept = [None] + [Discount(spread(g)) for g in self.grams[1:]]
        self.after = [{} for _ in range(order)]
        for j in range(1, order):
            for g, c in self.grams[j].items():
                self.after[j].setdefault(g[:-1], {})[g[-1]] = c

    def tokens(self, t):
        return ["<s>"] * (self.order - 1) + [x.lower() for x in _words(t)] + ["</s>"]

    def p(self, w, h):
        if not h:
            return float(self.uni.p(np.array([self.grams[0][(w,)]]))[0])
        seen = self.after[len(h)].get(h)
        if not seen:
            return self.p(w, h[1:])
        total, value = sum(seen.values()), self.kept[len(h)].value
        if w in seen:
            return float(value(np.array([seen[w]]))[0]) / total
        left = sum(c - float(value(np.array([c]))[0]) for c in seen.values()) / total
        return left / (1 - sum(self.p(x, h[1:]) for x in seen)) * self.p(w, h[1:])

    def score(self, t):
        w = self.tokens(t)
        k = self.order - 1
        return sum(np.log10(self.p(w[i], tuple(w[i - k : i]))) for i in range(k, len(w)))


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_katz_scores_every_text(docs, empty, order):
    from stavework.llm.katz import Discount, score_texts

    held = {i for i in range(len(TEXTS)) if zlib.crc32(str(i).encode()) % 10 == 0}
    model = BruteKatz([t for i, t in enumerate(TEXTS) if i not in held], order)
    rows = score_texts(docs, order=order).collect()
    assert len(rows) == len(TEXTS) and {r.doc_id for r in rows if r.held_out} == held
    for r in rows:
        w = [x.lower() for x in _words(TEXTS[r.doc_id])] + ["</s>"]
        n, v = model.uni.n, model.uni.v
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(model.grams[0][(x,)] > 0 for x in w), n)
        assert r.base_score == pytest.approx(sum(np.log10((model.grams[0][(x,)] + 0.1) / (n + 0.1 * (v + 1))) for x in w))
        assert r.score == pytest.approx(model.score(TEXTS[r.doc_id]), rel=1e-9)
    assert (np.diff(Discount([120, 40, 20, 12, 8, 5]).kept) > 0).all() and (np.diff(Discount([1000, 300, 140, 100, 40, 90]).kept) > 0).all()
    assert score_texts(empty, order=order).count() == 0


def test_katz_distributions_sum_to_one():
    model = BruteKatz([t for t in TEXTS if t and len(t) < 800], 3)
    words = [g[0] for g in model.grams[0]]
    contexts = [("<s>", "<s>"), *list(model.after[2])[:40], ("never", "seen"), ("never", words[0])]
    for h in contexts:
        assert sum(model.p(w, h) for w in words) + model.p("<unknown>", h) == pytest.approx(1)


def test_katz_null_ids_and_no_training(spark):
    from stavework.llm.katz import score_texts

    rows = score_texts(spark.createDataFrame([(None, "a b"), (None, None), (7, "a a")], "doc_id long, text string")).collect()
    assert sorted((r.doc_id or -1, r.n_tokens) for r in rows) == [(-1, 1), (-1, 3), (7, 3)]
    alone = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    only = score_texts(spark.createDataFrame([(alone, "a b")], "doc_id long, text string")).collect()
    assert [(r.n_known, r.train_tokens, r.score) for r in only] == [(0, 0, 0.0)]


def test_vectors(spark):
    from stavework.llm import ann, near_embed

    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 8))
    x[100:140] = x[0] + rng.normal(0, 0.05, (40, 8))
    x[150] = x[7]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(300, None), (301, [0.0] * 8), (302, [float("nan")] * 8), (303, [1.0, None] + [0.0] * 6)]
    t = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    u = x / np.linalg.norm(x, axis=1)[:, None]
    s = u @ u.T
    np.fill_diagonal(s, -1)
    got = {r.vec_id: r for r in near_embed.near_duplicates(t, cell_rows=50, block_rows=20, slab_rows=30).collect()}
    assert [got[i].n_links for i in range(300)] == (s >= 0.9).sum(1).tolist() and all(got[i].n_links == 0 and got[i].kept for i in range(300, 304))
    part = list(range(300))
    for a, b in zip(*np.nonzero(s >= 0.9)):
        low, high = sorted((part[a], part[b]))
        part = [low if p == high else p for p in part]
    assert [got[i].component_id for i in range(300)] == part
    near = ann.search(t, "id % 50 = 0").collect()
    hits = sum(r.vec_id in np.lexsort((np.arange(300), -s[r.query_id]))[:5] for r in near)
    assert len(near) == 30 and hits >= 27


def _links_by_force(x, cosine=0.9):
    u = x / np.linalg.norm(x, axis=1)[:, None]
    s = u @ u.T
    np.fill_diagonal(s, -1)
    part = list(range(len(x)))
    for a, b in zip(*np.nonzero(s >= cosine)):
        low, high = sorted((part[a], part[b]))
        if low != high:
            part = [low if p == high else p for p in part]
    return (s >= cosine).sum(1).tolist(), part


def test_near_embeddings_in_cells_of_several_levels(spark, monkeypatch):
    from stavework.llm import near_embed

    rng = np.random.default_rng(2)
    x = rng.normal(size=(900, 3))  # low dimension: distances to pivots tell much
    x[500] = x[3]
    seen = []
    cells = near_embed._cells
    monkeypatch.setattr(near_embed, "_cells", lambda *a: seen.append(cells(*a)) or seen[-1])
    t = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r for r in near_embed.near_duplicates(t, cosine=0.995, cell_rows=60, fan=4, block_rows=25, slab_rows=25).collect()}
    links, part = _links_by_force(x, 0.995)
    assert sum(links) > 1000 and len(seen[0]) > 5  # several levels were cut
    assert [got[i].n_links for i in range(900)] == links and [got[i].component_id for i in range(900)] == part


def test_vectors_awkward(spark):
    """Nulls, empty and repeated rows, one vector in a third of all rows, lengths that differ, clashing columns."""
    from stavework.llm import ann, near_embed

    rng = np.random.default_rng(3)
    same, few = [1.0, 2.0, 0.5, -1.0], [[float(v) for v in rng.normal(size=4)] for _ in range(20)]
    rows = [(i, same if i < 10 else few[i - 10], "c", 1) for i in range(30)] + [(30, [1.0, 2.0], "c", 1), (31, [], "c", 1), (None, same, "c", 1), (32, [float("inf"), 1.0, 1.0, 1.0], "c", 1)]
    t = spark.createDataFrame(rows, "vec_id long, embedding array<double>, cell string, n int")
    got = {r.vec_id: r for r in near_embed.near_duplicates(t, cell_rows=4, fan=2, block_rows=3, slab_rows=3).collect()}
    links, part = _links_by_force(np.array([same] * 10 + few))
    assert [got[i].n_links for i in range(30)] == links and [got[i].component_id for i in range(30)] == part
    assert all(got[i].n_links == 0 and got[i].component_id == i for i in (30, 31, 32)) and got[None].n_links == 0
    for r in ann.search(t, "id in (0, 29, 30)").collect():
        assert r.query_id != 30 and r.vec_id != r.query_id
    near = sorted((r["rank"], r.vec_id) for r in ann.search(t, "id = 0", width=0.4).collect())
    assert near == [(k, k) for k in range(1, 6)]  # ties go to the smaller id
    empty = spark.createDataFrame([], t.schema)
    assert near_embed.near_duplicates(empty).count() == 0 and ann.search(empty, "id = 0").count() == 0
    twice = spark.createDataFrame([(1, same), (1, same), (2, few[0])], "vec_id long, embedding array<double>")
    assert {r.component_id for r in near_embed.near_duplicates(twice).where("vec_id = 1").collect()} == {1}


def test_few_candidates_are_all_found(spark):
    """A query finds every candidate where there are fewer than k, however far away they are."""
    from stavework.llm import ann

    x = [[1.0, 0.0, 0.0], [-1.0, 0.1, 0.0], [0.0, -1.0, 0.2], [0.1, 0.0, -1.0]]
    t = spark.createDataFrame(list(enumerate(x)), "vec_id long, embedding array<double>")
    got = [(r.query_id, r.vec_id) for r in ann.search(t, "id = 0", n_probes=1, tables=1, width=0.2).orderBy("rank").collect()]
    assert got == [(0, 3), (0, 2), (0, 1)]


def test_licences_inherit(spark):
    from stavework.llm.licenses import scan

    files = [("a/LICENSE", "Licensed under the Apache License, Version 2.0."), ("a/b/x.txt", "plain words"), ("a/c/LICENSE", "Released under the MIT License."), ("a/c/d/y.txt", None), ("z.txt", "hi\nLicensed under CC BY-NC 4.0.\nbye"), ("q/none.txt", "")]
    got = {r.path: (r.license, r.origin) for r in scan(spark.createDataFrame(files, "path string, text string")).collect()}
    assert got == {"a/LICENSE": ("Apache-2.0", "notice"), "a/b/x.txt": ("Apache-2.0", "inherited"), "a/c/LICENSE": ("MIT", "notice"), "a/c/d/y.txt": ("MIT", "inherited"), "z.txt": ("CC-BY-NC-4.0", "notice"), "q/none.txt": (None, "none")}


def test_licences_wrapped_and_in_line(spark):
    from stavework.llm.licenses import scan

    gpl = "/*\n * This program is free software: you can redistribute it and/or modify\n * it under the terms of the GNU General Public License as published by\n * the Free Software Foundation, either version 3 of the License, or\n * (at your option) any later version.\n */"
    prose = "The end of the road and the sea. Licensed under the Apache License, Version 2.0. It went to any of the other places and to the river."
    files = [("a/LICENSE", "Released\nunder the\nMIT License."), ("a/b.txt", "plain words"), ("g.c", gpl), ("p.txt", prose), ("q.txt", "to the sea and\nof the public road")]
    got = {r.path: (r.license, r.origin) for r in scan(spark.createDataFrame(files, "path string, text string")).collect()}
    assert got == {"a/LICENSE": ("MIT", "notice"), "a/b.txt": ("MIT", "inherited"), "g.c": ("GPL-3.0", "notice"), "p.txt": ("Apache-2.0", "notice"), "q.txt": (None, "none")}


def test_classifier_without_labels_and_held_out(spark, docs):
    from stavework.llm import fm

    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert all(r.score == pytest.approx(0.5) for r in fm.classify(docs, fm.train(docs, labels)).collect())
    sf = "/root/testdata/sf0.01"
    d, y = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    held = fm.classify(d, fm.train(d, y)).where("held_out").join(y, "doc_id").toPandas()
    assert (held.predicted == held.quality).mean() > 0.9


def test_pipeline_runs_whole(spark):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001").toPandas()
    assert len(out) > 0 and all(hashlib.sha256(" ".join(map(str, i)).encode()).hexdigest() == h for i, h in zip(out.ids, out.ids_sha256))
