"""Every query with SQL against DuckDB on the smallest tables, and the engine's invariants."""

import glob
import math
import os

import duckdb
import pandas as pd
import pytest

from stavework.plans.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


def rows(df):
    df = df[sorted(df.columns)]
    gone = lambda x: x is None or x is pd.NA or (isinstance(x, float) and math.isnan(x))
    return sorted(tuple("~" if gone(x) else f"{x:.6g}" if isinstance(x, float) else str(x) for x in r) for r in df.itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, duck, name):
    got, want = QUERIES[name](spark, SF).toPandas(), duck.execute(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_patterns_are_nested(spark):
    from stavework.operators import patterns
    from stavework.plans.queries import _wins

    w = _wins(spark, SF).selectExpr("count_if(D5 and not D4) a", "count_if(D4 and not (D2 and D3)) b", "count_if(D1 and not D2) c", "count(*) n").first()
    assert (w.a, w.b, w.c, w.n) == (0, 0, 0, 740)
    assert patterns.DEFINITIONS[0] == "D1"


def test_permutation_zero_is_the_observed_count(spark):
    null = QUERIES["permutation_null"](spark, SF).toPandas()
    assert (null.low <= null.high).all() and (null.p > 0).all() and (null.p <= 1).all()


def test_kneser_ney_of_a_repeated_gram_is_its_share(spark):
    from pyspark.sql import functions as F

    from stavework.operators import background as bg

    # one work of one endlessly repeated symbol among rare others
    grams = [(n, [7] * (n - 1), 10_000) for n in (2, 3, 4)] + [(n, [k] * (n - 1), 1) for n in (2, 3, 4) for k in range(20, 30)]
    counts = spark.createDataFrame(grams, "n int, gram array<int>, c long").withColumn("composer", F.lit("a")).withColumn("work_id", F.lit(1))
    p = bg.kneser_ney(counts, spark.createDataFrame([([7, 7, 7],)], "query array<int>"), 3).first()["p"]
    assert p == pytest.approx(10_000 / 10_010, rel=1e-3)


def test_flatten_merges_chords_ties_and_rests(spark):
    from stavework.sources.files import flatten_notes

    rows_ = [("f", 1, 1, 1, 0.0, 1.0, 60, None, 4.0), ("f", 1, 1, 1, 0.0, 1.0, 64, None, 4.0), ("f", 1, 1, 1, 1.0, 1.0, 64, 0, 3.0), ("f", 1, 1, 1, 3.0, 1.0, 62, None, 1.0)]
    out = flatten_notes(spark.createDataFrame(rows_, "file string, staff int, voice int, mc int, onset double, dur double, midi int, tied int, bar_remaining double")).orderBy("pos").collect()
    assert [(r.midi, r.dur, r.from_chord, r.gap_before) for r in out] == [(64, 2.0, 1, 0.0), (62, 1.0, 0, 1.0)]


def test_catalog_functions(spark):
    from pyspark.sql import functions as F

    from stavework.functions import catalog as cat

    t = spark.createDataFrame([("Weber, Carl Maria von", "Sonata Op. 27 No. 2"), ("Wolfgang Amadeus Mozart", "K. 545"), ("Händel, Georg", "HWV 56"), ("Dvořák, Antonín (1841)", "Symphony No. 9"), ("", None)], "name string, title string")
    got = [tuple(r) for r in t.select(cat.composer_id(F.col("name")), cat.catalog_key(F.col("title")), cat.slug(F.col("title"))).collect()]
    assert got == [("weber_cm", "op27/2", "sonata-op-27-no-2"), ("mozart_wa", "k545", "k-545"), ("handel_gf", "hwv56", "hwv-56"), ("dvorak_a", "", "symphony-no-9"), ("unknown", "", None)]


def test_streaming_counts(spark, tmp_path):
    from stavework.sources.notes import table
    from stavework.streaming.sessions import daily_counts

    events = table(spark, SF, "events")
    stream = spark.readStream.schema(events.schema).parquet(f"{SF}/events.parquet*")
    q = daily_counts(stream).writeStream.format("memory").queryName("daily").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path)).start()
    q.awaitTermination(120)
    assert spark.table("daily").agg({"events": "sum"}).first()[0] == events.count()


def test_components_of_a_long_chain(spark):
    from stavework.operators.curves import components

    chain = [(i, i + 1) for i in range(300)] + [(900, 901), (950, 950)]
    got = {r.work_id: r.component for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(301)} | {900: 900, 901: 900, 950: 950}


def test_topics_count_every_word(spark):
    from stavework.operators.similarity import lda_topics

    # 2100 usual words in every row of the first kind; the words of the second kind are rarer than all of them
    usual = [f"u{i}" for i in range(2100)]
    rows = [(usual,)] * 12 + [([f"r{i}" for i in range(6)],)] * 6 + [(None,), ([],)]
    top = lda_topics(spark.createDataFrame(rows, "words array<string>").repartition(2), k=2).collect()
    assert len(top) == 12 and sum(r.term.startswith("r") for r in top) == 6


def test_topics_over_blocks_match_a_plain_loop(spark):
    import numpy as np
    import pyarrow as pa

    from stavework.operators import topics

    pick = np.random.default_rng(7)
    rows = [[f"{'äbc'[kind]}{w}" for w in pick.zipf(1.6, pick.integers(1, 30)) % 50] for kind in range(3) for _ in range(25)]
    rows += [rows[0]] * 3 + [[f"long{i}" for i in range(90)], None, [], [None], [None, "a1", "a1"]]
    vocabulary = sorted({w for r in rows for w in r or [] if w}, key=str.encode)
    k, alpha, eta, steps = 3, 0.5, 0.1, 6
    model = topics.first_weights(topics._keys(pa.array(vocabulary)), k, 42)
    for _ in range(steps):
        beta = np.exp(topics.digamma(model)) / np.exp(topics.digamma(model.sum(axis=1)))[:, None]
        model = np.full(model.shape, eta)
        for r in rows:
            at = [vocabulary.index(w) for w in r or [] if w]
            gamma, last = np.ones(k), np.full(k, 9.0)
            mix = lambda g: np.exp(topics.digamma(g) - topics.digamma(g.sum(keepdims=True)))
            while at and np.abs(gamma - last).mean() > 1e-3:
                gamma, last = alpha + mix(gamma) * (beta[:, at] / (mix(gamma) @ beta[:, at])).sum(axis=1), gamma
            for w in at:
                model[:, w] += mix(gamma) * beta[:, w] / (mix(gamma) @ beta[:, w])
    want = [[(w, x) for x, w in sorted(zip(t / t.sum(), vocabulary), key=lambda x: (-x[0], x[1].encode()))[:6]] for t in model]
    table = spark.createDataFrame([(r,) for r in rows], "words array<string>")
    for parts, sizes in ((3, {"block_words": 40, "range_words": 60}), (1, {})):
        got = topics.top_words(table.repartition(parts), k, steps, 42, alpha, eta, 6, **sizes).collect()
        assert [(r.topic, r["rank"]) for r in got] == [(t, i) for t in range(k) for i in range(1, 7)]
        assert [r.weight for r in got] == pytest.approx([x for t in want for _, x in t], rel=1e-6)
        assert [r.term for r in got] == [w for t in want for w, _ in t]
    assert topics.top_words(table.where("size(words) = 0"), k, steps, 42, alpha, eta, 6).collect() == []


def test_topics_send_no_vocabulary_to_the_driver(spark):
    from pyspark.sql import functions as F

    from stavework.operators.similarity import lda_topics

    sc = spark.sparkContext

    def sent(after: int) -> tuple[int, int]:
        sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        none = sc._gateway.new_array(sc._jvm.double, 0)
        stages = sc._jsc.sc().statusStore().stageList(sc._jvm.java.util.ArrayList(), False, False, none, sc._jvm.java.util.ArrayList())
        new = [s for s in (stages.apply(i) for i in range(stages.size())) if s.stageId() > after]
        return max([s.stageId() for s in new], default=after), sum(s.resultSize() for s in new)

    rows = spark.range(60).select(F.transform(F.sequence(F.lit(0), F.lit(1999)), lambda i: F.concat(F.lit("w"), (F.col("id") * 2000 + i).cast("string"))).alias("words"))
    last, _ = sent(-1)
    assert lda_topics(rows.repartition(4), iterations=3).count() == 24
    assert sent(last)[1] < 2_000_000  # a step over 120,000 words and four topics would be 3.8 MB


def test_kneser_ney_leaves_composers_and_works_out(spark):
    from stavework.operators import background as bg

    rows = lambda composer, work, symbols: [(n, list(symbols[i : i + n - 1]), composer, work, 1) for n in (2, 3, 4) for i in range(len(symbols) - n + 2)]
    kept = rows("a", 1, [1, 2, 3, 1, 2, 4, 1, 3]) + rows("b", 2, [2, 3, 1, 1, 2, 2])
    gone = rows("c", 3, [1, 2, 3, 1, 2, 3, 1, 2, 3, 9, 9]) + rows("b", 4, [1, 2, 3, 3])
    schema = "n int, gram array<int>, composer string, work_id int, c long"
    q = spark.createDataFrame([([1, 2, 3],), ([9, 9, 1],), ([3, 1, 2],)], "query array<int>")
    p = lambda t, **out: {tuple(r.query): r.p for r in bg.kneser_ney(spark.createDataFrame(t, schema), q, 3, **out).collect()}
    assert p(kept + gone, without=("c",), without_works=(4,)) == pytest.approx(p(kept)) != pytest.approx(p(kept + gone))


def test_running_sums_over_ranges(spark):
    from pyspark.sql import functions as F

    from stavework.operators.evaluate import decile_means
    from stavework.operators.running import running

    values = [(i, (i * 37) % 101, 1.5 * i) for i in range(500)]
    df = spark.createDataFrame(values, "id int, key int, v double").repartition(4)
    for descending in (False, True):
        got = {r.id: (r.s, r.n) for r in running(df, F.col("key"), [F.col("id")], {"s": F.col("v"), "n": F.lit(1)}, ranges=8, descending=descending).collect()}
        order = sorted(values, key=lambda x: (-x[1] if descending else x[1], x[0]))
        total = 0.0
        for n, (i, _, v) in enumerate(order, 1):
            total += v
            assert got[i] == (pytest.approx(total), n)
    parts = sorted((r.decile, r.rows) for r in decile_means(df.where("id < 47"), ["key", "id"], "v").collect())
    assert parts == [(d, 5 if d <= 7 else 4) for d in range(1, 11)]


def test_note_tables_and_catalogue_files(spark, tmp_path):
    from pyspark.sql import functions as F

    from stavework.operators import catalogue
    from stavework.sources import files

    (tmp_path / "kern" / "repo").mkdir(parents=True)
    (tmp_path / "kern" / "repo" / "op3n1-2.krn").write_text("!!!OTL: First\n!!!OTL: Second\n!!!ODT: ~1750-1752\n**kern\n4c\n")
    lines = files.read_lines(spark, str(tmp_path / "kern" / "repo"))
    refs = files.reference_records(lines)
    repos = spark.createDataFrame([("repo", "free", "Vivaldi, Antonio", r"^(op\d+n\d+)-(\d+)()$", "{1}", "{2}", "op.{OPS} {1}")], "repo string, license string, composer string, pattern string, work string, movement string, key string")
    u = catalogue.unique_units(catalogue.kern_units(lines.select(F.col("file").alias("path")).distinct(), refs, repos)).first()
    assert (u.work_id, u.title, u.movement, u.composition_year, u.year_certainty, u.composer_id, u.catalog_key) == ("kern-repo-op3n1", "First", "2", 1751, "range", "vivaldi_a", "op3/1")
    (tmp_path / "a.notes.tsv").write_text("quarterbeats\tduration_qb\tmidi\tstaff\tvoice\tmc\tmc_onset\ttied\ttimesig\n0\t1/2\t60\t1\t1\t1\t0\t\t4/4\n1/2\t0.5\t62\t1\t1\t1\t1/8\t\t4/4\nNA\t1\t64\t1\t1\t1\t1/4\t\t4/4\n2\t1\t65\t1\t1\t1\t1/2\t\t4/4\n")
    rows = files.flatten_notes(files.read_notes_tsv(spark, str(tmp_path / "a.notes.tsv"))).orderBy("pos").collect()
    assert [(r.midi, r.dur, r.gap_before, r.bar_remaining) for r in rows] == [(60, 0.5, 0.0, 4.0), (62, 0.5, 0.0, 3.5), (65, 1.0, 1.0, 2.0)]
    merged = files.keep_existing(spark.createDataFrame([("w", "old", None)], "k string, a string, b string"), spark.createDataFrame([("w", "new", "x"), ("z", "new", "y")], "k string, a string, b string"), "k")
    assert sorted(map(tuple, merged.collect())) == [("w", "old", "x"), ("z", "new", "y")]
    files.write_report(merged, f"{tmp_path}/report")
    files.write_json(merged, f"{tmp_path}/json")
    assert spark.read.option("header", True).csv(f"{tmp_path}/report").count() == spark.read.json(f"{tmp_path}/json").count() == 2


def test_stored_notes_and_counts(spark, tmp_path):
    from stavework.sources import files, tables
    from stavework.sources.notes import notes

    n = notes(spark, SF)
    files.write_notes(n.where("work_id < 5"), f"{tmp_path}/notes")
    files.write_notes(n, f"{tmp_path}/notes", existing=spark.read.parquet(f"{tmp_path}/notes"))
    assert spark.read.parquet(f"{tmp_path}/notes").count() == n.count()
    one = tables.load_work(spark, f"{tmp_path}/notes", 3)
    assert one.count() == n.where("work_id = 3").count() and tables.load_work(spark, f"{tmp_path}/notes", -1).count() == 0
    rows = spark.createDataFrame([("a", 2, [1], 3), ("b", 3, [1, 2], 1)], "stratum string, n int, gram array<int>, c int")
    tables.store(tables.union_stratum(rows, ("a", "b"), "both"), f"{tmp_path}/counts", by=("stratum", "n"))
    got = tables.load_counts(spark, f"{tmp_path}/counts", orders=(3,), stratum="both")
    assert [r.c for r in got.collect()] == [1] and "PartitionFilters: [isnotnull" in got._jdf.queryExecution().toString()
    tables.append_report(tables.report(rows, ["n", "c"], [rows.n], title="# T"), f"{tmp_path}/md")
    assert spark.read.text(f"{tmp_path}/md").count() == 6
    works, missing = tables.with_notes(spark.createDataFrame([(3, "x"), (10**6, "y")], "work_id long, title string"), n)
    assert works.select("title").distinct().count() == 1 and [r.title for r in missing.collect()] == ["y"]
    (tmp_path / "r.json").write_text('{"a": 1,\n "b": [2]}')
    assert tables.read_results(spark, f"{tmp_path}/r.json").first().b == [2]
    assert tables.exists(spark, f"{tmp_path}/md") and not tables.exists(spark, f"{tmp_path}/nothing")


def test_document_frequency_of_seen_and_unseen(spark):
    from pyspark.sql import functions as F

    from stavework.operators import background as bg

    rows = [(n, [7] * (n - 1), c, w, 3) for n in (2, 3, 4) for c, w in (("a", 1), ("a", 2), ("b", 3), ("c", 4))] + [(n, [w] * (n - 1), c, w, 1) for n in (2, 3, 4) for c, w in (("a", 1), ("b", 3), ("d", 5), ("e", 6))]
    counts = spark.createDataFrame(rows, "n int, gram array<int>, composer string, work_id int, c long")
    d = bg.discounts(counts).select((F.col("n") - 1).alias("o"), "discount")
    q = spark.createDataFrame([(["a", "b"], [7, 7, 7]), (["a", "b"], [90, 91, 90]), (["c", "d"], [7, 7, 7])], "out array<string>, query array<int>")
    got = {(tuple(r.out), tuple(r["query"])): (r.works, r.df) for r in bg.document_frequency_without(counts, d, q, 3).collect()}
    assert got[("a", "b"), (7, 7, 7)] == (1, pytest.approx(1 / 3)) and got[("c", "d"), (7, 7, 7)] == (3, pytest.approx(3 / 4))
    works, df = got[("a", "b"), (90, 91, 90)]
    assert works == 0 and 0 < df <= 1 / 4


def test_counts_without_units_equal_filtered_counts(spark):
    """Around a middle: grams that survive stand for suffixes that survive."""
    import random

    from pyspark.sql import functions as F

    from stavework.operators import background as bg

    rng = random.Random(5)
    rows = []
    for w in range(12):
        s = [rng.randint(1, 3) for _ in range(14)]
        rows += [(n, s[i : i + n - 1], "abcd"[w % 4], w, 1) for n in (2, 3, 4, 5) for i in range(len(s) - n + 2)]
    counts = spark.createDataFrame(rows, "n int, gram array<int>, composer string, work_id int, c long").groupBy("n", "gram", "composer", "work_id").agg(F.sum("c").alias("c"))
    d = bg.discounts(counts).select((F.col("n") - 1).alias("o"), "discount")
    q = counts.where("n = 5").select(F.col("gram").alias("query")).distinct().withColumn("out", F.array(F.lit("a"), F.lit("c"))).withColumn("g", F.lit("all"))
    all_ = counts.withColumn("g", F.lit("all"))
    fast = {tuple(r["query"]): r.p for r in bg.kneser_ney_without(bg.net_counts(all_, "g", "composer"), d, q, 4).collect()}
    kept = bg.net_counts(all_.where(~F.col("composer").isin("a", "c")), "g", "composer")
    slow = {tuple(r["query"]): r.p for r in bg.kneser_ney_without(kept, d, q.withColumn("out", F.array().cast("array<string>")), 4).collect()}
    assert fast.keys() == slow.keys() and all(fast[k] == pytest.approx(slow[k]) for k in fast)


def test_voices_collapse_in_order(spark):
    from stavework.operators.voices import collapse_voices, kept_voices

    tune = [60, 62, 64, 65, 67, 65, 64]
    other = [50, 50, 55, 53, 52, 55, 50]
    rows = [(1, v, i, m + (12 if v == 3 else 0), 1.0, float(i)) for v, line in ((1, tune), (2, other), (3, tune), (4, tune[:3])) for i, m in enumerate(line)]
    n = spark.createDataFrame(rows, "unit int, voice_id int, pos int, midi int, quarter_length double, offset double")
    got = {r.voice: (r.kept, r.place) for r in kept_voices(n, ["unit"]).collect()}
    assert got == {1: (True, 1), 2: (True, 2), 3: (False, 0), 4: (True, 3)}
    assert collapse_voices(n, ["unit"]).select("voice_id").distinct().count() == 3


def test_permutation_null_against_every_order(spark):
    """Mean of the null against all orders of a small segment, by class too."""
    import itertools

    import numpy as np

    from stavework.operators.patterns import _counted, permutation_null
    from stavework.operators.sequences import segments

    midi, ql = [60, 60, 60, 56, 58], [1.0, 1.0, 1.0, 2.0, 1.0]
    rows = [(w, "x", "s", 0, v, i, m - 12 * v, q, float(i), 0.0, 4.0 - i % 4, 0) for w in range(40) for v in (0, 1) for i, (m, q) in enumerate(zip(midi, ql))]
    n = spark.createDataFrame(rows, "work_id int, composer string, stratum string, movement_idx int, voice_id int, pos int, midi int, quarter_length double, offset double, gap_before double, bar_remaining double, from_chord int")
    out = {(r.grouping, r.stat): r for r in permutation_null(segments(n), 400, min_notes=4, few=50).collect()}
    iv = np.array(list(itertools.permutations(np.diff(midi))))
    d = np.array(list(itertools.permutations(ql)))
    means = {"D2": _counted(iv, np.ones((len(iv), 5)), np.zeros(2))[:, 0].mean(), "D3": _counted(np.ones((len(d), 4)), d, np.zeros(2))[:, 1].mean()}
    for stat, mean in means.items():
        r = out["all", stat]
        assert r.obs == 80 and r.mean == pytest.approx(80 * mean, rel=0.05) and r.low <= r.mean <= r.high and r.permutations == 400
    assert out["composer", "D2"].permutations == 50 and out["all", "D4"].obs == 80
    assert out["all", "D4"].mean == pytest.approx(sum(out["all", f"D4:{c}"].mean for c in ("bass_cad", "bass_other", "other_cad", "other_other")))


def test_forbidden_words_and_double_units_fail(spark):
    from stavework.operators import calibrate, catalogue

    rows = spark.createDataFrame([("p1", "Fine"), ("p2", "Secret Piece")], "pair string, title string")
    assert calibrate.refuse(rows, ["title"], ["nothing"]).count() == 2
    with pytest.raises(Exception, match="forbidden"):
        calibrate.refuse(rows, ["title"], ["secret"]).collect()
    with pytest.raises(Exception, match="twice"):
        catalogue.unique_units(spark.createDataFrame([("u",), ("u",)], "unit_id string")).collect()


def test_parsers_fall_back_and_report(spark):
    from pyspark.sql import functions as F

    from stavework.sources import files

    def lines(content):
        return [(1, float(i), 1.0, int(x)) for i, x in enumerate(content.split())]

    rows = [("a", "plain", b"60 62"), ("b", "plain", b"60 x"), ("c", "other", b""), ("d", "plain", None)]
    t = spark.createDataFrame(rows, "unit_id string, format string, content binary")
    got = sorted((r.unit_id, r.status, r.midi) for r in files.parse_scores(t, {"plain": lines}).collect())
    assert got == [("a", "ok", 60), ("a", "ok", 62), ("b", "fail", None), ("c", "fail", None)]
    assert {r.status for r in files.parse_scores(t, {"plain": lines}, fallback=lambda c: [(1, 0.0, 1.0, 1)]).collect()} == {"ok"}
    shown = spark.createDataFrame([("1 · Aria",), ("Aria",)], "n string").select(files.short_label(F.col("n")).alias("l")).collect()
    assert [r.l for r in shown] == ["Aria", "Aria"]


def test_paths_resolve_by_scheme(spark):
    from pyspark.sql import functions as F

    from stavework.operators.catalogue import resolved

    t = spark.createDataFrame([("a/b.krn",), ("lib:c/d.xml",)], "p string").select(resolved(F.col("p"), "/raw/", {"lib": "/opt/lib"}).alias("f"))
    assert [r.f for r in t.collect()] == ["/raw/a/b.krn", "/opt/lib/c/d.xml"]


def test_streaming_sessions_equal_the_batch(spark, tmp_path):
    from stavework.sources.notes import table
    from stavework.streaming.sessions import event_sessions

    events = table(spark, SF, "events")
    # one late event a year on closes all sessions of the stream
    from pyspark.sql import functions as F

    last = events.orderBy(F.desc("ts")).limit(1).withColumn("ts", F.col("ts") + F.expr("interval 400 days")).withColumn("user_id", F.lit(-1).cast("long"))
    events.write.parquet(f"{tmp_path}/in/a")
    last.write.parquet(f"{tmp_path}/in/b")
    stream = spark.readStream.schema(events.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 100).parquet(f"{tmp_path}/in")
    q = event_sessions(stream).writeStream.format("memory").queryName("sessions").outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/c").start()
    q.awaitTermination(180)
    rows = lambda df: sorted((r.user_id, str(r.start), r.events, round(r.total, 3)) for r in df.where("user_id >= 0").collect())
    got = rows(spark.table("sessions"))
    assert got and set(got) <= set(rows(event_sessions(events)))


def test_models_are_joined_by_sorting_however_small_their_files_look(spark):
    from pyspark.sql import functions as F

    from stavework.operators import background as bg

    rows = [(n, [1] * (n - 1), c, w, 1) for n in (2, 3, 4) for w, c in enumerate("aabb")]
    counts = spark.createDataFrame(rows, "n int, gram array<int>, composer string, work_id int, c long")
    d = bg.discounts(counts).select((F.col("n") - 1).alias("o"), "discount")
    q = spark.createDataFrame([(["a", "b"], [1, 1, 1])], "out array<string>, query array<int>")
    whole = bg.net_counts(counts.withColumn("g", F.lit("all")), "g", "composer")
    for model in (bg.kneser_ney_without(whole, d, q.withColumn("g", F.lit("all")), 3), bg.laplace_without(counts, q, 4), bg.document_frequency_without(counts, d, q, 3)):
        assert "BroadcastHashJoin" not in model._jdf.queryExecution().executedPlan().toString()


def test_titles_are_what_the_sql_reads_with_blanks_and_line_ends(spark, duck, tmp_path):
    pages = [(1, "<html><title>  two blanks </title><p>"), (2, "<html><title>first\nsecond</title>"), (3, "<title>a\rb\u2028c</title><title>later</title>"), (4, "<p>none</p>"), (5, "<html><title>\n</title>"), (6, None)]
    spark.createDataFrame(pages, "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    assert {tuple(r) for r in QUERIES["header_scan"](spark, str(tmp_path)).select("page_id", "title").collect()} == set(con.execute(ORACLE_SQL["header_scan"]).fetchall())


def test_reliability_of_weighted_rows_is_that_of_rows_repeated(spark):
    from pyspark.sql import functions as F

    from stavework.operators import evaluate

    groups = spark.createDataFrame([(3, 1, 0.2), (2, 2, 0.2), (5, 0, 0.01)], "works int, held int, df double")
    each = groups.select("df", F.explode(F.sequence(F.lit(1), F.col("works"))).alias("k"), "held").withColumn("seen", (F.col("k") <= F.col("held")).cast("double"))
    found = evaluate.reliability(groups.withColumn("share", F.col("held") / F.col("works")), "share", "df", [0.1], "works")
    key = lambda r: (r["bin"], r["pairs"], round(r["mean_pred"], 9), round(r["mean_obs"], 9))
    assert {key(r) for r in found.collect()} == {key(r) for r in evaluate.reliability(each, "seen", "df", [0.1]).collect()}


def test_picks_are_not_broadcast_and_lie_in_their_stretch(spark):
    from stavework.operators.calibrate import weighted_picks

    weights = spark.createDataFrame([("a", 3), ("b", 0), ("c", 500), ("d", 1)], "k string, n long")
    found = weighted_picks(weights, "k", "n", spark.range(510).withColumnRenamed("id", "pick"))
    joins = [x for x in found._jdf.queryExecution().executedPlan().toString().splitlines() if "Join" in x]
    assert not any("pick" in x for x in joins if "SortMergeJoin" not in x)
    got = found.collect()
    assert sorted(r.pick for r in got) == list(range(504))
    assert sorted((r.key, r.place) for r in got) == sorted([("a", i) for i in range(3)] + [("c", i) for i in range(500)] + [("d", 0)])


def test_musedata_editions_are_joined_by_sorting(spark):
    assert "BroadcastHashJoin" not in QUERIES["musedata_catalogue"](spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_lambda_calibration_takes_every_window():
    assert "LIMIT" not in ORACLE_SQL["lambda_calibration"] and "LIMIT" in ORACLE_SQL["lambda_of_least_bias"]
