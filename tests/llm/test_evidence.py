"""Operators against their definitions: brute force on small tables, and awkward input."""

import random

import numpy as np
import pytest

pytest.importorskip("stavework.llm")
pytest.importorskip("stavework.llm.queries")
public_tokenizers = pytest.importorskip("public_tokenizers")

rng = random.Random(11)
VOCABULARY = [f"v{i}" for i in range(300)]


def _text(n):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


def _words(t):
    return (t or "").encode().split()


def _union(n, links):
    part = list(range(n))
    for a, b in links:
        low, high = sorted((part[a], part[b]))
        if low != high:
            part = [low if p == high else p for p in part]
    return part


def _jaccard_parts(texts, words, num):
    from collections import Counter, defaultdict

    sets = []
    for t in texts:
        w = [x.lower() for x in _words(t)]
        sets.append({tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set()))
    held = defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            held[g].append(i)
    shared = Counter((a, b) for ids in held.values() for k, a in enumerate(ids) for b in ids[k + 1 :])
    links = [(a, b) for (a, b), c in shared.items() if 100 * c >= num * (len(sets[a]) + len(sets[b]) - c)]
    return [len(s) for s in sets], _union(len(texts), links)


def test_jaccard_with_a_hot_shingle_and_a_large_group(spark):
    """A line in a third of 1500 texts, a group of 150 near copies, chains that only neighbours link."""
    from stavework.llm.ngram_join import jaccard_classes

    line, base = _text(9), _text(60).split()
    texts = [_text(12) + (" " + line if i % 3 == 0 else "") for i in range(1200)]
    texts += [line + f" tail{i}" for i in range(100)]
    for i in range(150):
        copy = list(base)
        for _ in range(i % 4):
            copy[rng.randrange(60)] = f"x{rng.randrange(9)}"
        texts.append(" ".join(copy))
    chain = _text(80).split()
    for i in range(50):
        chain = chain[2:] + [f"c{i}", f"d{i}"]
        texts.append(" ".join(chain))
    sizes, part = _jaccard_parts(texts, 4, 85)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    for rare, block in ((16, 32), (64, 1024)):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_classes(df, words=4, similarity=(85, 100), rare=rare, block=block).collect()}
        assert got == {i: (n, p) for i, (n, p) in enumerate(zip(sizes, part))}
    assert len(set(part[1300:1450])) < 100 and len(set(part[1450:])) == 1


def test_scores_are_the_sum_over_all_pairs():
    from stavework.llm import fm

    r = np.random.default_rng(1)
    size = (1 << fm.WORD_BITS) + (len(fm.STATS) + 1) * fm.BINS
    m = fm.Model(np.sort(r.normal(size=(len(fm.STATS) + 1, fm.BINS - 2)), axis=1), 0.3, r.normal(size=size).astype(np.float32), r.normal(0, 0.3, (size, 8)).astype(np.float32))
    texts = [b"", b"one", _text(40).encode(), "É è 9 9 9 !! ..".encode()]
    meta = np.array([[1.0], [np.nan], [np.inf], [-2.0]])
    dense, *words = fm.features(texts)
    out, f, x = m.inputs(np.hstack((dense, meta)), *words)
    for k, margin in enumerate(m.margin(out, f, x)):
        fi, xi = f[out[k] : out[k + 1]], x[out[k] : out[k + 1]].astype(float)
        pairs = sum(float(m.v[fi[i]].astype(float) @ m.v[fi[j]].astype(float)) * xi[i] * xi[j] for i in range(len(fi)) for j in range(i))
        assert margin == pytest.approx(m.b + float((m.w[fi] * xi).sum()) + pairs, rel=1e-4, abs=1e-4)
        assert m.score(texts, meta)[k] == pytest.approx(1 / (1 + np.exp(-margin)), rel=1e-5)
    last = np.arange(len(fm.STATS), len(fm.STATS) + 1) * fm.BINS + (1 << fm.WORD_BITS) + fm.BINS - 1
    assert last[0] in f[out[1] : out[2]] and last[0] in f[out[2] : out[3]]  # what is not there has a bin


def test_metadata_alone_can_decide(spark):
    from stavework.llm import fm

    rows = [(i, "same words here", float(i % 2), None if i % 11 == 0 else i % 2) for i in range(600)]
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, weight double")
    labels = spark.createDataFrame([(r[0], r[3]) for r in rows] + [(None, 1)], "doc_id long, quality int")
    model = fm.train(docs, labels, metadata=("weight",))
    got = fm.classify(docs, model, metadata=("weight",)).toPandas()
    assert (got.predicted == got.doc_id % 2).mean() > 0.99
    nulls = spark.createDataFrame([(None, None, None), (5, None, 1.0), (5, "", float("nan"))], docs.schema)
    assert fm.classify(nulls, model, metadata=("weight",)).count() == 3 and fm.classify(docs.limit(0), model, metadata=("weight",)).count() == 0
    assert fm.train(docs, labels.limit(0), metadata=("weight",)).score([b"x"], np.array([[1.0]]))[0] == pytest.approx(0.5)


def _taken(rows, weights, share, most):
    """Targets by offering the budget again and again, then whole and fractional repetitions.

    rows: (id, source, size, place in the seeded order)."""
    from fractions import Fraction

    sources = sorted({r[1] for r in rows}, key=lambda s: (s is None, s or ""))
    weight = {s: Fraction(weights[i % len(weights)]) for i, s in enumerate(sources)}
    size = {s: sum(r[2] for r in rows if r[1] == s) for s in sources}
    target = dict.fromkeys(sources, Fraction(0))
    for _ in range(len(sources) + 1):
        left = Fraction(share) * sum(size.values()) - sum(target.values())
        free = [s for s in sources if target[s] < most * size[s]]
        if not free or left <= 0:
            break
        unit = left / sum(weight[s] for s in free)
        over = [s for s in free if unit * weight[s] > most * size[s] - target[s]]
        for s in over or free:
            target[s] = Fraction(most * size[s]) if over else target[s] + unit * weight[s]
    times = {}
    for s in sources:
        whole = int(min(target[s] / size[s], most)) if size[s] else 0
        extra, before = target[s] - whole * size[s], 0
        for r in sorted((r for r in rows if r[1] == s), key=lambda r: r[3]):
            times[r[0]] = whole + (1 if before + Fraction(r[2], 2) <= extra else 0)
            before += r[2]
    return {s: float(t) for s, t in target.items()}, times


def test_mixture_is_the_water_level(spark):
    from pyspark.sql import functions as F

    from stavework.llm.mixing import mixture

    texts = [(i, _text(rng.randrange(1, 60)) if i % 17 else (None if i % 2 else "  "), None if i % 13 == 0 else f"s{min(i % 10, i % 4)}") for i in range(240)]
    df = spark.createDataFrame(texts, "doc_id long, text string, source string").repartition(3)
    placed = df.select("doc_id", F.xxhash64("doc_id", F.coalesce(F.length("text"), F.lit(-1)), F.lit(17)).alias("h")).collect()
    place = {r.doc_id: (r.h % 1024, r.h, r.doc_id) for r in placed}
    for weights, share in (((5, 2, 1), 1.5), ((1,), 0.4), ((1, 9), 5)):
        target, times = _taken([(i, s, len(_words(t)), place[i]) for i, t, s in texts], weights, share, 2)
        for r in mixture(df, weights=weights, share=share, max_epochs=2).collect():
            assert r.target == pytest.approx(target[r.source]) and r.times == times[r.doc_id] and r.taken == r.size * r.times


def test_licence_headers_wrapped(spark):
    from stavework.llm.licenses import scan

    mit = "The MIT License (MIT)\n\nCopyright (c) 2001 Somebody\n\nPermission is hereby granted, free of charge, to any person\nobtaining a copy of this software and associated documentation\nfiles (the \"Software\"), to deal in the Software without restriction."
    apache = "# Licensed under the Apache License,\n# Version 2.0 (the \"License\");\n# you may not use this file except in\n# compliance with the License."
    gpl2 = " * This program is free software\n * under the GNU General Public\n * License, version 2.\n"
    files = [(1, "m/LICENSE", mit), (2, "m/sub/deep/x.py", "pass"), (3, "a/b.py", apache), (4, "g/h.c", gpl2), (5, "n/none.txt", "the license of the version"), (None, None, None), (None, "m/y", ""), (7, "m/LICENSE", mit)]
    t = spark.createDataFrame([(*f, "clash", 1.0, "t", 3) for f in files], "doc_id long, path string, text string, license string, score double, term string, h int")
    got = sorted((r.path, r.doc_id, r.license, r.origin) for r in scan(t, carry=("doc_id",)).collect() if r.doc_id)
    assert got == [("a/b.py", 3, "Apache-2.0", "notice"), ("g/h.c", 4, "GPL-2.0", "notice"), ("m/LICENSE", 1, "MIT", "notice"), ("m/LICENSE", 7, "MIT", "notice"), ("m/sub/deep/x.py", 2, "MIT", "inherited"), ("n/none.txt", 5, None, "none")]
    assert sorted((r.path, r.origin) for r in scan(t, carry=("doc_id",)).collect() if r.doc_id is None) == [("", "none"), ("m/y", "inherited")]
    assert scan(t.limit(0)).count() == 0


def test_null_ids_and_clashing_columns(spark):
    """Rows without an id are rows, and stay without one."""
    from stavework.llm import bpe, mixing, ngram_join, substring, tokenfile

    text = _text(30)
    rows = [(None, text), (None, None), (3, text), (3, text), (4, text + " more"), (5, "")]
    t = spark.createDataFrame([(*r, "s", "k", 1, 2, "x") for r in rows], "doc_id long, text string, source string, key string, n int, rep int, kept string")
    path = str(public_tokenizers.path("word_bpe_49k.json"))
    got = sorted((r.doc_id or 0, r.component_id or 0) for r in ngram_join.jaccard_classes(t).collect())
    assert got == [(0, 0), (0, 0), (3, 3), (3, 3), (4, 3), (5, 5)]
    assert ngram_join.jaccard_classes(t.limit(0)).count() == 0
    assert sorted((r.doc_id or 0, r.n_removed) for r in substring.remove_repeats(t).collect()) == [(0, 0), (0, 0), (3, 0), (3, 0), (4, 30), (5, 0)]
    assert sorted(r.doc_id or 0 for r in bpe.encode(t, path, decoded=True).collect()) == [0, 0, 3, 3, 4, 5]
    assert sorted(r.doc_id or 0 for r in mixing.mixture(t).collect()) == [0, 0, 3, 3, 4, 5]
    target = tokenfile.new_target(spark)
    tokenfile.write(t, target, str(public_tokenizers.path("byte_bpe_50k.json")))
    back = tokenfile.read(spark, target).collect()
    assert sorted(r.doc_id or 0 for r in back) == [0, 0, 3, 3, 4, 5] and tokenfile.crc32(back[0].ids) == __import__("zlib").crc32(back[0].ids)
    target = tokenfile.new_target(spark)
    tokenfile.write(t.limit(0), target, str(public_tokenizers.path("byte_bpe_50k.json")))
    assert tokenfile.read(spark, target).count() == 0


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """A corpus with exact and near copies, long shared passages, junk, nulls and an extra column."""
    folder = tmp_path_factory.mktemp("corpus")
    passage = _text(70)
    texts = [_text(rng.randrange(30, 90)) for _ in range(80)]
    texts += [texts[0], texts[1] + " tail", texts[2] + " " + passage, passage + " " + texts[3], _text(60) + " " + passage + " " + _text(60), None, "", "!!! ### $$$ " * 30]
    rows = [(i, t, "en", None if i % 9 == 0 else f"s{i % 3}", len(t or ""), "x") for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, rep string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 0 if i == len(texts) - 1 else 1, 0) for i in range(0, len(texts), 2)] + [(len(texts) - 1, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_every_stage_of_the_pipeline(spark, corpus):
    """Each stage on what the one before it kept, against its definition."""
    from tokenizers import Tokenizer

    import corpus_pipeline
    from stavework.llm import fm, mixing

    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    columns, stages = docs.columns, dict(corpus_pipeline.STAGES)
    # quality: the same model, scored by the sum over all pairs
    model = fm.train(docs, spark.read.parquet(f"{corpus}/labels.parquet"), label="quality", metadata=("n_chars",))
    before = {r.doc_id: r for r in docs.collect()}
    keep = set()
    for i, r in before.items():
        dense, *words = fm.features([(r.text or "").encode()])
        out, f, x = model.inputs(np.hstack((dense, [[float(r.n_chars)]])), *words)
        x = x.astype(float)
        v = model.v[f].astype(float) * x[:, None]
        margin = model.b + float((model.w[f] * x).sum()) + sum(float(v[a] @ v[b]) for a in range(len(f)) for b in range(a))
        if 1 / (1 + np.exp(-margin)) >= 0.3:
            keep.add(i)
    one = stages["quality"](spark, docs, corpus)
    assert one.columns == columns and {r.doc_id for r in one.collect()} == keep
    # near copies: the smallest of each class
    ids = sorted(keep)
    _, part = _jaccard_parts([before[i].text for i in ids], 5, 80)
    two = stages["near_duplicates"](spark, one, corpus)
    left = sorted(ids[k] for k, p in enumerate(part) if p == k)
    assert two.columns == columns and sorted(r.doc_id for r in two.collect()) == left and len(left) < len(ids)
    # passages of 50 words that an earlier document holds
    first, text = {}, {}
    for i in left:
        w = _words(before[i].text)
        for k in range(len(w) - 49):
            first.setdefault(tuple(w[k : k + 50]), i)
    for i in left:
        w = _words(before[i].text)
        gone = [False] * len(w)
        for k in range(len(w) - 49):
            if first[tuple(w[k : k + 50])] < i:
                gone[k : k + 50] = [True] * 50
        text[i] = b" ".join(x for x, g in zip(w, gone) if not g).decode() if any(gone) else before[i].text
    three = stages["repeated_passages"](spark, two, corpus)
    got = {r.doc_id: r for r in three.collect()}
    assert three.columns == columns and {i: r.text for i, r in got.items()} == text and any(text[i] != before[i].text for i in left)
    assert all(r.n_chars == (len(text[i]) if text[i] != before[i].text else before[i].n_chars) for i, r in got.items())
    # the mix: every document as often as it is taken
    times = {r.doc_id: r.times for r in mixing.mixture(three, weights=(5, 2, 1), share=1.5, max_epochs=2).collect()}
    four = stages["mixture"](spark, three, corpus)
    assert four.columns == columns and sorted(r.doc_id for r in four.collect()) == sorted(i for i, n in times.items() for _ in range(n))
    # tokens
    tok = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    for r in stages["tokens"](spark, four, corpus).collect():
        assert list(r.ids) == tok.encode(text[r.doc_id] or "", add_special_tokens=False).ids and r.n_tokens == len(r.ids)
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, corpus).collect()) == sorted(r.doc_id for r in four.collect())


def test_stages_take_empty_tables(spark, corpus):
    import corpus_pipeline

    nothing = spark.read.parquet(f"{corpus}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, nothing, corpus)
        assert out.count() == 0 and (name == "tokens" or out.columns == nothing.columns)


def test_tables_are_dropped_when_consumed(spark):
    from stavework.llm import _env, ngram_join

    before = set(_env._live)
    df = spark.createDataFrame([(i, _text(20)) for i in range(30)], "doc_id long, text string")
    ngram_join.jaccard_classes(df).collect()
    assert len(set(_env._live) - before) <= 6


def test_runs_that_share_a_hash_get_their_own_ids(monkeypatch):
    """With a hash of a few values only, almost every run meets another one of its hash."""
    import pyarrow as pa
    from tokenizers import Tokenizer

    from stavework.llm import tokenfile

    path = str(public_tokenizers.path("byte_bpe_50k.json"))
    tok = Tokenizer.from_file(path)
    full = tokenfile.hash_spans
    texts = [_text(n) + " " + "".join(rng.choice("abcxyz") for _ in range(3 * n)) for n in (5, 40, 90, 200)] * 2
    for values in (1, 7, 500):
        monkeypatch.setattr(tokenfile, "hash_spans", lambda buf, a, b: full(buf, a, b) % np.uint64(values) + np.uint64(1))  # noqa: B023
        enc = tokenfile.Encoder(path)
        for k in range(0, len(texts), 2):
            ids, sizes = enc(pa.array(texts[k : k + 2], pa.string()))
            want = [tok.encode(t, add_special_tokens=False).ids for t in texts[k : k + 2]]
            assert sizes.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


def test_stages_take_nulls_and_repeats(spark, corpus):
    import corpus_pipeline

    schema = spark.read.parquet(f"{corpus}/documents.parquet").schema
    text = _text(60)
    rows = [(None, text, None, None, None, None), (None, None, None, None, None, None), (1, text, "en", "a", 5, "x"), (1, text, "en", "a", 5, "x"), (2, text + " tail", None, None, None, None), (3, None, "en", "a", 0, "x"), (4, "", "en", "a", 0, "x")]
    docs = spark.createDataFrame(rows, schema)
    stages = dict(corpus_pipeline.STAGES)
    ids = lambda df: sorted(r.doc_id or 0 for r in df.collect())
    assert set(ids(stages["quality"](spark, docs, corpus))) >= {0}
    assert ids(stages["near_duplicates"](spark, docs, corpus)) == [0, 0, 1, 1, 3, 4]
    cut = stages["repeated_passages"](spark, docs, corpus)
    assert {r.doc_id: r.text for r in cut.where("doc_id > 1").collect()} == {2: "tail", 3: None, 4: ""} and ids(cut) == [0, 0, 1, 1, 2, 3, 4]
    mixed = stages["mixture"](spark, docs, corpus)
    assert mixed.columns == docs.columns and set(ids(mixed)) <= {0, 1, 2, 3, 4}
    assert ids(stages["tokens"](spark, docs, corpus)) == [0, 0, 1, 1, 2, 3, 4]
