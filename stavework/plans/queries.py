"""Named queries of the engine over the driver's tables, and equivalent SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stavework.functions import catalog as cat
from stavework.functions.symbols import e_value, influence_weight, presence, rhythm_class, symbol_interval, symbol_rhythm
from stavework.operators import background as bg
from stavework.operators import curves, evaluate, patterns, similarity
from stavework.operators.asof import asof_backward
from stavework.operators.asof import bar_remaining as measured
from stavework.operators.sequences import bass_voices, ngrams, segments, symbol_arrays
from stavework.sources import files
from stavework.sources.notes import NOTES_SQL, notes, table
from stavework.streaming import sessions

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

WINDOWS_SQL = (
    NOTES_SQL
    + """,
led AS (SELECT *, lead(midi) OVER s - midi AS i1, lead(midi, 2) OVER s - lead(midi) OVER s AS i2, lead(midi, 3) OVER s - lead(midi, 2) OVER s AS i3, lead(ql) OVER s AS q1, lead(ql, 2) OVER s AS q2, lead(ql, 3) OVER s AS q3,
    lead(bar_rem, 3) OVER s AS last_rem, row_number() OVER s AS seg_pos FROM long WINDOW s AS (PARTITION BY work_id, mov, voice, seg ORDER BY pos)),
flags AS (SELECT *, i1 = 0 AND i2 = 0 AND i3 = -4 AS d1, i1 = 0 AND i2 = 0 AND i3 IN (-4, -3) AS d2, ql > 0 AND q1 > 0 AND q2 > 0 AND abs(ql - q1) <= 1e-6 AND abs(q1 - q2) <= 1e-6 AND q3 >= 2 * q2 - 1e-6 AS d3 FROM led WHERE i3 IS NOT NULL),
win AS (SELECT *, d2 AND d3 AS d4, d2 AND d3 AND (abs(off - round_even(off, 0)) > 1e-6 OR CAST(round_even(off, 0) AS BIGINT) % 2 = 1) AS d5, coalesce(last_rem BETWEEN 0 AND 1 + 1e-6, false) OR seg_pos = seg_len - 3 AS cad FROM flags),
by_work AS (SELECT stratum, composer, work_id, count(*) AS windows, count(*) + 3 * count(*) FILTER (seg_pos = 1) AS notes, count(*) FILTER (d1) AS n1, count(*) FILTER (d2) AS n2, count(*) FILTER (d3) AS n3, count(*) FILTER (d4) AS n4, count(*) FILTER (d5) AS n5 FROM win GROUP BY ALL)"""
)
SYMBOLS_SQL = (
    NOTES_SQL
    + """,
sym0 AS (SELECT composer, stratum, work_id, mov, voice, seg, pos, lead(midi) OVER s - midi AS step, lead(ql) OVER s / ql AS r FROM long WINDOW s AS (PARTITION BY work_id, mov, voice, seg ORDER BY pos)),
sym AS (SELECT *, step + 200 AS iv, (step + 200) * 8 + 2 + CASE WHEN r < 0.4 THEN -2 WHEN r < 0.9 THEN -1 WHEN r <= 1.1 THEN 0 WHEN r <= 2.5 THEN 1 ELSE 2 END AS ivr FROM sym0 WHERE step IS NOT NULL),
arr AS (SELECT composer, stratum, work_id, mov, voice, seg, list(iv ORDER BY pos) AS iv, list(ivr ORDER BY pos) AS ivr FROM sym GROUP BY ALL)"""
)


def _grams_sql(column: str, sizes: str) -> str:
    return f"""{SYMBOLS_SQL},
gram AS (SELECT composer, stratum, work_id, n, unnest(list_transform(range(1, len({column}) - n + 3), lambda i: {column}[i:i+n-2])) AS gram FROM arr, (SELECT unnest([{sizes}]) AS n) WHERE len({column}) >= n - 1)"""


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def _segs(spark, sf_dir):
    return segments(notes(spark, sf_dir))


def _wins(spark, sf_dir):
    return patterns.windows(_segs(spark, sf_dir))


def _grams(spark, sf_dir, column, sizes):
    return ngrams(symbol_arrays(_segs(spark, sf_dir)), column, sizes)


_COUNTS = ", ".join(f"sum(n{k})::BIGINT AS D{k}" for k in range(1, 6))
_RATES = ", ".join(f"round(1e5 * sum(n{k}) / sum(windows), 6) AS D{k}_rate" for k in range(1, 6))
_PREV = ", ".join(f"round(100.0 * count(*) FILTER (n{k} > 0) / count(*), 6) AS D{k}_prevalence" for k in range(1, 6))


@query("base_rates", f"WITH {WINDOWS_SQL} SELECT composer, stratum, count(*) AS works, sum(windows)::BIGINT AS windows, sum(notes)::BIGINT AS notes, {_COUNTS}, {_RATES}, {_PREV} FROM by_work GROUP BY GROUPING SETS ((), (stratum), (composer), (composer, stratum))")
def base_rates(spark, sf_dir):
    works = patterns.by_work(_wins(spark, sf_dir))
    return patterns.rates(works, [(), ("stratum",), ("composer",), ("composer", "stratum")])


@query("notes_view", f"WITH {NOTES_SQL} SELECT work_id, composer, stratum, mov AS movement_idx, voice AS voice_id, pos, midi, ql AS quarter_length, off AS \"offset\", round(gap, 6) AS gap_before, 4 - off % 4 AS bar_remaining FROM notes")
def notes_view(spark, sf_dir):
    return notes(spark, sf_dir).drop("from_chord").withColumn("gap_before", F.round("gap_before", 6)).withColumn("voice_id", F.col("voice_id").cast("long"))


@query("sessionise", f"WITH {NOTES_SQL} SELECT work_id, mov AS movement_idx, voice AS voice_id, seg::BIGINT AS seg, count(*) AS notes, min(pos) AS first_pos FROM long GROUP BY ALL")
def sessionise(spark, sf_dir):
    return _segs(spark, sf_dir).groupBy("work_id", "movement_idx", "voice_id", "seg").agg(F.count("*").alias("notes"), F.min("pos").cast("long").alias("first_pos")).withColumn("voice_id", F.col("voice_id").cast("long"))


@query("bass_voice", f"WITH {NOTES_SQL}, m AS (SELECT work_id, mov, voice, median(midi) AS m FROM long GROUP BY ALL) SELECT work_id, mov AS movement_idx, arg_min(voice, (m, voice)) AS bass FROM m GROUP BY ALL HAVING count(*) > 1")
def bass_voice(spark, sf_dir):
    return bass_voices(_segs(spark, sf_dir)).withColumn("bass", F.col("bass").cast("long"))


@query("pattern_classes", f"WITH {WINDOWS_SQL}, m AS (SELECT work_id, mov, voice, median(midi) AS m FROM long GROUP BY ALL), b AS (SELECT work_id, mov, arg_min(voice, (m, voice)) AS bass FROM m GROUP BY ALL HAVING count(*) > 1), g AS (SELECT CASE WHEN voice = bass THEN 'bass' ELSE 'other' END || CASE WHEN cad THEN '_cad' ELSE '_other' END AS class, count(*) AS windows, count(*) FILTER (d4) AS d4 FROM win LEFT JOIN b USING (work_id, mov) GROUP BY 1) SELECT class, windows, d4, round(d4 / sum(d4) OVER (), 6) AS share FROM g")
def pattern_classes(spark, sf_dir):
    segs = _segs(spark, sf_dir)
    return patterns.classes(patterns.windows(segs), segs)


@query("trigram_ranks", f"WITH {WINDOWS_SQL} SELECT i1, i2, i3, count(*) AS cnt, row_number() OVER (ORDER BY count(*) DESC, i1, i2, i3) AS rank FROM win GROUP BY i1, i2, i3 QUALIFY rank <= 300")
def trigram_ranks(spark, sf_dir):
    return patterns.trigram_ranks(_wins(spark, sf_dir), 300)


@query("trigram_ranks_by_stratum", f"WITH {WINDOWS_SQL} SELECT stratum, i1, i2, i3, count(*) AS cnt, row_number() OVER (PARTITION BY stratum ORDER BY count(*) DESC, i1, i2, i3) AS rank FROM win GROUP BY stratum, i1, i2, i3 QUALIFY rank <= 30")
def trigram_ranks_by_stratum(spark, sf_dir):
    return patterns.trigram_ranks(_wins(spark, sf_dir), 30, ("stratum",))


@query("permutation_null")
def permutation_null(spark, sf_dir):
    out = patterns.permutation_null(_segs(spark, sf_dir), 1000, min_notes=40)
    return out.select("grouping", "name", "stat", "obs", F.round("mean", 6).alias("mean"), "low", "high", F.round("ratio", 6).alias("ratio"), F.round("p", 6).alias("p"), "permutations")


@query("permutation_observed", f"WITH {WINDOWS_SQL}, m AS (SELECT work_id, mov, voice, median(midi) AS m FROM long GROUP BY ALL), b AS (SELECT work_id, mov, arg_min(voice, (m, voice)) AS bass FROM m GROUP BY ALL HAVING count(*) > 1), k AS (SELECT work_id FROM long GROUP BY 1 HAVING count(*) >= 40), w AS (SELECT win.*, CASE WHEN voice = bass THEN 'bass' ELSE 'other' END || CASE WHEN cad THEN '_cad' ELSE '_other' END AS class FROM win LEFT JOIN b USING (work_id, mov) WHERE work_id IN (SELECT work_id FROM k)), c AS (SELECT stratum AS name, s.stat, count(*) FILTER (s.hit) AS obs FROM w, LATERAL (VALUES ('D2', d2), ('D3', d3), ('D4', d4), ('D4:bass_cad', d4 AND class = 'bass_cad'), ('D4:bass_other', d4 AND class = 'bass_other'), ('D4:other_cad', d4 AND class = 'other_cad'), ('D4:other_other', d4 AND class = 'other_other')) s(stat, hit) GROUP BY ALL) SELECT * FROM c")
def permutation_observed(spark, sf_dir):
    """The observed side of the null, over the works that take part in it."""
    out = patterns.permutation_null(_segs(spark, sf_dir), 100, min_notes=40)
    return out.where("grouping = 'stratum'").select("name", "stat", "obs")


@query("excess_by_class")
def excess_by_class(spark, sf_dir):
    out = patterns.excess_shares(patterns.permutation_null(_segs(spark, sf_dir), 1000, min_notes=40))
    return out.select("grouping", "name", "class", F.round("excess", 6).alias("excess"), F.round("share", 6).alias("share"))


_STRATA = (("AFRICA", "south"), ("AMERICA", "west"), ("EUROPE", "west"), ("ASIA", "east"), ("MIDDLE EAST", "east"), ("AMERICA", "all"), ("EUROPE", "all"), ("ASIA", "all"), ("AFRICA", "all"), ("MIDDLE EAST", "all"))


@query("pooled_rates", f"WITH {WINDOWS_SQL}, st(stratum, grp) AS (VALUES {', '.join(map(str, _STRATA))}) SELECT grp AS \"group\", sum(windows)::BIGINT AS windows, {_RATES} FROM by_work JOIN st USING (stratum) GROUP BY grp")
def pooled_rates(spark, sf_dir):
    works = patterns.in_strata(patterns.by_work(_wins(spark, sf_dir)), spark.createDataFrame(list(_STRATA), "stratum string, group string"))
    p = patterns.pooled_rates(works)
    return p.select("group", "windows", *[F.round(f"{d}_rate", 6).alias(f"{d}_rate") for d in patterns.DEFINITIONS])


@query("rates_of_large_composers", f"WITH {WINDOWS_SQL} SELECT composer, count(*) AS works, sum(windows)::BIGINT AS windows, {_RATES} FROM by_work GROUP BY 1 HAVING count(*) >= 6")
def rates_of_large_composers(spark, sf_dir):
    works = patterns.of_large_groups(patterns.by_work(_wins(spark, sf_dir)), "composer", 6)
    return patterns.rates(works, [("composer",)]).select("composer", "works", "windows", *[f"{d}_rate" for d in patterns.DEFINITIONS])


@query("rate_report", f"WITH {WINDOWS_SQL} SELECT composer, sum(windows)::BIGINT AS windows, sum(n3)::BIGINT AS D3 FROM by_work GROUP BY 1 HAVING sum(windows) >= 200 ORDER BY windows DESC, composer LIMIT 12")
def rate_report(spark, sf_dir):
    r = patterns.rates(patterns.by_work(_wins(spark, sf_dir)), [("composer",)])
    return patterns.rate_report(r, "composer", 200, 12).select("composer", "windows", "D3")


def _curve_sql(column: str, sizes: str, by: str) -> str:
    return f"""WITH {_grams_sql(column, sizes)},
pr AS (SELECT {by}, gram, work_id, count(*) AS t FROM gram GROUP BY ALL), ty AS (SELECT {by}, gram, count(*) AS w, sum(t) AS t FROM pr GROUP BY ALL),
hd AS (SELECT {by}, sum(t)::BIGINT AS tokens, count(*) AS types, count(*) FILTER (w = 1) AS unique_types, round(coalesce(sum(t) FILTER (w > 1), 0) / sum(t), 6) AS p_cross FROM ty GROUP BY ALL),
pw AS (SELECT {by}, work_id, sum(pr.t * (w - 1)) AS s, sum(pr.t) AS t FROM pr JOIN ty USING ({by}, gram) GROUP BY ALL),
tl AS (SELECT {by}, count(*) AS works, round(CASE WHEN count(*) > 1 THEN avg(s / t) / (count(*) - 1) END, 6) AS p_pair FROM pw GROUP BY ALL)
SELECT * FROM hd JOIN tl USING ({by})"""


@query("uniqueness_iv", _curve_sql("iv", "3, 4, 5, 6, 7, 8, 9, 10, 11, 12", "n"))
def uniqueness_iv(spark, sf_dir):
    return curves.curve(_grams(spark, sf_dir, "iv", list(range(3, 13))))


@query("uniqueness_ivr", _curve_sql("ivr", "3, 4, 5, 6, 7, 8, 9, 10, 11, 12", "n"))
def uniqueness_ivr(spark, sf_dir):
    return curves.curve(_grams(spark, sf_dir, "ivr", list(range(3, 13))))


@query("uniqueness_by_stratum", _curve_sql("ivr", "3, 4, 5", "stratum, n"))
def uniqueness_by_stratum(spark, sf_dir):
    return curves.curve(_grams(spark, sf_dir, "ivr", [3, 4, 5]), ("stratum", "n"))


@query("incipit_lookup", f"WITH {_grams_sql('iv', '3, 4, 5, 6')} SELECT s.n, count(work_id) AS tokens, count(DISTINCT work_id) AS works FROM (SELECT unnest([3, 4, 5, 6]) AS n) s LEFT JOIN gram ON gram.n = s.n AND gram = [200, 200, 198, 203, 200][1:s.n-1] GROUP BY s.n")
def incipit_lookup(spark, sf_dir):
    return curves.incipits(_grams(spark, sf_dir, "iv", [3, 4, 5, 6]), [200, 200, 198, 203, 200], [3, 4, 5, 6])


@query("symbol_codec", f"WITH {SYMBOLS_SQL} SELECT floor(ivr / 8)::INT - 200 AS interval, ivr % 8 - 2 AS rhythm, count(*) AS cnt FROM sym GROUP BY ALL")
def symbol_codec(spark, sf_dir):
    s = symbol_arrays(_segs(spark, sf_dir)).select(F.explode("ivr").alias("s"))
    return s.groupBy(symbol_interval(F.col("s")).alias("interval"), symbol_rhythm(F.col("s")).alias("rhythm")).agg(F.count("*").alias("cnt"))


@query("motif_occurrences", f"WITH {SYMBOLS_SQL}, o AS (SELECT work_id, i - 1 AS start, iv[i:i+3] AS gram FROM (SELECT work_id, iv, unnest(range(1, len(iv) - 2)) AS i FROM arr WHERE len(iv) >= 4)) SELECT work_id, array_to_string(gram, ' ') AS gram, count(*) AS occurrences, min(start) AS first_start FROM o WHERE gram <> [200, 200, 200, 200] GROUP BY ALL")
def motif_occurrences(spark, sf_dir):
    m = curves.motif_positions(symbol_arrays(_segs(spark, sf_dir)), "iv", 4)
    return m.select("work_id", F.array_join(F.col("gram").cast("array<string>"), " ").alias("gram"), "occurrences", F.col("first_start").cast("long").alias("first_start"))


@query("shared_types", f"WITH {_grams_sql('ivr', '4')}, t AS (SELECT DISTINCT work_id, gram FROM gram), u AS (SELECT gram FROM t GROUP BY gram HAVING count(*) BETWEEN 2 AND 40) SELECT x.work_id AS a, y.work_id AS b, count(*) AS shared FROM t x JOIN u USING (gram) JOIN t y USING (gram) WHERE x.work_id < y.work_id GROUP BY ALL")
def shared_types(spark, sf_dir):
    return curves.shared_types(_grams(spark, sf_dir, "ivr", [4])).select("a", "b", "shared")


_DEDUP_SQL = f"""WITH RECURSIVE {_grams_sql('iv', '5')}, t AS (SELECT DISTINCT composer, work_id, gram FROM gram), u AS (SELECT gram FROM t GROUP BY gram HAVING count(*) BETWEEN 2 AND 40), z AS (SELECT work_id, count(*) AS types FROM t GROUP BY 1),
s AS (SELECT x.work_id AS a, y.work_id AS b, count(*) AS shared FROM t x JOIN u USING (gram) JOIN t y USING (gram) WHERE x.work_id < y.work_id AND x.composer = y.composer GROUP BY ALL),
pairs AS (SELECT a, b, shared, round(shared / least(p.types, q.types), 6) AS containment FROM s JOIN z p ON p.work_id = a JOIN z q ON q.work_id = b WHERE shared >= 3 AND shared / least(p.types, q.types) >= 0.1)"""


@query("sequence_dedup_pairs", _DEDUP_SQL + " SELECT * FROM pairs")
def sequence_dedup_pairs(spark, sf_dir):
    return curves.containment_pairs(_grams(spark, sf_dir, "iv", [5]), min_shared=3, share=0.1)


@query("sequence_dedup_groups", _DEDUP_SQL + ", l AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs), r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a) SELECT a AS work_id, least(a, min(b)) AS component FROM r GROUP BY a")
def sequence_dedup_groups(spark, sf_dir):
    return curves.components(sequence_dedup_pairs(spark, sf_dir))


def _counts(spark, sf_dir, column="ivr", sizes=(4,)):
    return bg.counts_table(_grams(spark, sf_dir, column, list(sizes)))


_BG_SQL = f"WITH {_grams_sql('ivr', '3, 4, 5')}, ty AS (SELECT n, gram, count(*) AS c, count(DISTINCT work_id) AS w, count(DISTINCT composer) AS k, min(composer) AS only FROM gram GROUP BY ALL), st AS (SELECT n, sum(c)::BIGINT AS N_, count(*) AS V, count(*) FILTER (c = 1) AS N1, count(*) FILTER (c = 2) AS N2 FROM ty GROUP BY n)"


@query("background_summary", _BG_SQL + " SELECT n, N_ AS N_tokens, V, N1, round(N1 / (V + 1) * (N_ / greatest(N_ - N1, 1)), 6) AS alpha, round(1 / (N_ + V + 1), 10) AS p_unseen FROM st")
def background_summary(spark, sf_dir):
    return bg.summary(_counts(spark, sf_dir, "ivr", (3, 4, 5))).toDF("n", "N_tokens", "V", "N1", "alpha", "p_unseen")


@query("background_composers", _BG_SQL + " SELECT g.n, g.composer, count(*) AS tokens, count(DISTINCT g.gram) FILTER (k = 1) AS exclusive FROM gram g JOIN ty ON ty.n = g.n AND ty.gram = g.gram GROUP BY ALL")
def background_composers(spark, sf_dir):
    return bg.composer_totals(_counts(spark, sf_dir, "ivr", (3, 4, 5)))


_LAPLACE_SQL = _BG_SQL + ", own AS (SELECT n, composer, gram, count(*) AS own FROM gram GROUP BY ALL), ct AS (SELECT own.n, composer, sum(own) AS t, count(*) FILTER (k = 1) AS e FROM own JOIN ty USING (n, gram) GROUP BY ALL), lp AS (SELECT own.n, composer, gram, ty.c - own AS c, (ty.c - own + 1) / ((N_ - t) + (V - e + 1)) AS p FROM own JOIN ty USING (n, gram) JOIN ct USING (n, composer) JOIN st USING (n))"


@query("laplace_exclusion", _LAPLACE_SQL + " SELECT n, composer, count(*) AS types, sum(c)::BIGINT AS c, round(sum(p), 6) AS mass, round(avg(ln(p)), 6) AS mean_log FROM lp GROUP BY ALL")
def laplace_exclusion(spark, sf_dir):
    p = bg.laplace_excluding(_counts(spark, sf_dir, "ivr", (3, 4, 5)))
    return p.groupBy("n", "composer").agg(F.count("*").alias("types"), F.sum("c").alias("c"), F.round(F.sum("p"), 6).alias("mass"), F.round(F.avg(F.ln("p")), 6).alias("mean_log"))


_SHARES = "0.01, 0.1, 0.5, 0.9, 0.99"


@query("background_percentiles", _LAPLACE_SQL + f", q AS (SELECT n, quantile_cont(log10(p), [{_SHARES}]) AS q, max(log10(p)) AS m FROM lp GROUP BY n) SELECT n, round(q[1], 6) AS p1, round(q[2], 6) AS p10, round(q[3], 6) AS p50, round(q[4], 6) AS p90, round(q[5], 6) AS p99, round(m, 6) AS top FROM q")
def background_percentiles(spark, sf_dir):
    p = bg.laplace_excluding(_counts(spark, sf_dir, "ivr", (3, 4, 5))).withColumn("l", F.log10("p"))
    q = p.groupBy("n").agg(F.percentile("l", F.array(*[F.lit(float(x)) for x in _SHARES.split(", ")])).alias("q"), F.max("l").alias("m"))
    return q.select("n", *[F.round(F.col("q")[i], 6).alias(a) for i, a in enumerate(("p1", "p10", "p50", "p90", "p99"))], F.round("m", 6).alias("top"))


_EV_SQL = _LAPLACE_SQL + ", w AS (SELECT n, composer, count(*) AS windows FROM gram GROUP BY ALL), ev AS (SELECT lp.n, lp.composer, lp.gram, own.own AS obs, windows * p AS e FROM lp JOIN own ON own.n = lp.n AND own.composer = lp.composer AND own.gram = lp.gram JOIN w ON w.n = lp.n AND w.composer = lp.composer WHERE lp.n = 4)"


def _e_values(spark, sf_dir):
    c = _counts(spark, sf_dir, "ivr", (4,))
    p = bg.laplace_excluding(c)
    own = c.groupBy("n", "gram", "composer").agg(F.sum("c").alias("obs"))
    w = c.groupBy("n", "composer").agg(F.sum("c").alias("windows"))
    return p.join(own, ["n", "gram", "composer"]).join(w, ["n", "composer"]).select("composer", "gram", "obs", e_value(F.col("windows"), F.col("p")).alias("e"))


@query("e_values", _EV_SQL + " SELECT composer, count(*) AS types, sum(obs)::BIGINT AS obs, round(sum(e), 6) AS expected, round(sum(1 - exp(-e)), 6) AS presence FROM ev GROUP BY ALL")
def e_values(spark, sf_dir):
    return _e_values(spark, sf_dir).groupBy("composer").agg(F.count("*").alias("types"), F.sum("obs").alias("obs"), F.round(F.sum("e"), 6).alias("expected"), F.round(F.sum(presence(F.col("e"))), 6).alias("presence"))


@query("calibration_metrics", _EV_SQL + ", l AS (SELECT ln(obs + 0.05) AS o, ln(e + 0.05) AS p, obs, e FROM ev) SELECT round(regr_slope(o, p), 6) AS slope, round(avg(abs(o - p)), 6) AS mae, round(avg(p - o), 6) AS bias, round(sum(obs) / sum(e), 6) AS ratio FROM l")
def calibration_metrics(spark, sf_dir):
    m = evaluate.log_metrics(_e_values(spark, sf_dir), "obs", "e")
    return m.select(*[F.round(c, 6).alias(c) for c in m.columns])


@query("reliability_bins", _EV_SQL + " SELECT (e >= 0.05)::INT + (e >= 0.1)::INT + (e >= 0.2)::INT + (e >= 0.5)::INT AS bin, count(*) AS pairs, round(avg(e), 6) AS mean_pred, round(avg(obs), 6) AS mean_obs FROM ev GROUP BY 1")
def reliability_bins(spark, sf_dir):
    r = evaluate.reliability(_e_values(spark, sf_dir), "obs", "e", [0.05, 0.1, 0.2, 0.5])
    return r.select("bin", "pairs", F.round("mean_pred", 6).alias("mean_pred"), F.round("mean_obs", 6).alias("mean_obs"))


@query("document_frequency", _BG_SQL + " SELECT n, w AS works, count(*) AS types, round(w / (SELECT count(DISTINCT work_id) FROM gram g WHERE g.n = ty.n), 8) AS df FROM ty GROUP BY n, w")
def document_frequency(spark, sf_dir):
    return bg.document_frequency(_counts(spark, sf_dir, "ivr", (3, 4, 5))).groupBy("n", "works", F.round("df", 8).alias("df")).agg(F.count("*").alias("types"))


@query("kn_discounts", _BG_SQL + " SELECT n, N_ AS tokens, V AS types, N1 AS n1, N2 AS n2, round(CASE WHEN N1 + 2 * N2 > 0 THEN N1 / (N1 + 2 * N2) ELSE 0.5 END, 8) AS d FROM st")
def kn_discounts(spark, sf_dir):
    return bg.discounts(_counts(spark, sf_dir, "ivr", (3, 4, 5))).toDF("n", "tokens", "types", "n1", "n2", "d").withColumn("d", F.round("d", 8))


_KN_SQL = f"""WITH {_grams_sql('iv', '2, 3, 4')},
t AS (SELECT n - 1 AS o, gram, count(*)::DOUBLE AS c FROM gram GROUP BY ALL),
s AS (SELECT o, sum(c) AS n, count(*)::DOUBLE AS v, CASE WHEN count(*) FILTER (c = 1) + count(*) FILTER (c = 2) > 0 THEN count(*) FILTER (c = 1) / (count(*) FILTER (c = 1) + 2 * count(*) FILTER (c = 2)) ELSE 0.5 END AS d FROM t GROUP BY o),
g AS (SELECT max(n) FILTER (o = 1) AS n1, max(n) FILTER (o = 3) AS n3, max(v) FILTER (o = 1) AS v1, max(v) FILTER (o = 2) AS v2, max(d) FILTER (o = 1) AS d1, max(d) FILTER (o = 2) AS d2, max(d) FILTER (o = 3) AS d3 FROM s),
fol AS (SELECT o, gram[1:o-1] AS k, count(*)::DOUBLE AS x FROM t WHERE o > 1 GROUP BY ALL), con AS (SELECT o - 1 AS o, gram[2:o] AS k, count(*)::DOUBLE AS x FROM t WHERE o > 1 GROUP BY ALL), mid AS (SELECT o - 1 AS o, gram[2:o-1] AS k, count(*)::DOUBLE AS x FROM t WHERE o = 3 GROUP BY ALL),
q AS (SELECT gram AS q, c AS c123 FROM t WHERE o = 3),
h AS (SELECT q.q, c123, a.c AS c1, b.c AS c12, coalesce(f1.x, 0) AS f1, coalesce(f12.x, 0) AS f12, coalesce(s2.x, 0) AS s2, coalesce(s3.x, 0) AS s3, coalesce(s23.x, 0) AS s23, coalesce(m2.x, 0) AS m2, coalesce(f2.x, 0) AS f2 FROM q
  JOIN t a ON a.o = 1 AND a.gram = q.q[1:1] JOIN t b ON b.o = 2 AND b.gram = q.q[1:2] LEFT JOIN fol f1 ON f1.o = 2 AND f1.k = q.q[1:1] LEFT JOIN fol f12 ON f12.o = 3 AND f12.k = q.q[1:2] LEFT JOIN fol f2 ON f2.o = 2 AND f2.k = q.q[2:2]
  LEFT JOIN con s2 ON s2.o = 1 AND s2.k = q.q[2:2] LEFT JOIN con s3 ON s3.o = 1 AND s3.k = q.q[3:3] LEFT JOIN con s23 ON s23.o = 2 AND s23.k = q.q[2:3] LEFT JOIN mid m2 ON m2.o = 2 AND m2.k = q.q[2:2]),
p AS (SELECT q, greatest(c1 - d1, 0) / n1 + d1 * v1 / n1 / (v1 + 1) AS p1,
  greatest(c12 - d2, 0) / c1 + d2 * f1 / c1 * (greatest(s2 - d1, 0) / v2 + d1 * v1 / v2 / (v1 + 1)) AS p2,
  greatest(c123 - d3, 0) / c12 + d3 * f12 / c12 * (CASE WHEN m2 = 0 THEN greatest(s3 - d1, 0) / v2 + d1 * v1 / v2 / (v1 + 1) ELSE greatest(s23 - d2, 0) / m2 + d2 * f2 / m2 * (greatest(s3 - d1, 0) / v2 + d1 * v1 / v2 / (v1 + 1)) END) AS p3, n1 / n3 AS k FROM h, g)
SELECT array_to_string(q, ' ') AS gram, round(ln(p1 * p2 * p3 * k), 6) AS log_p FROM p"""


@query("kneser_ney", _KN_SQL)
def kneser_ney(spark, sf_dir):
    c = _counts(spark, sf_dir, "iv", (2, 3, 4))
    q = c.where("n = 4").select(F.col("gram").alias("query")).distinct()
    return bg.kneser_ney(c, q, 3).select(F.array_join(F.col("query").cast("array<string>"), " ").alias("gram"), F.round(F.ln("p"), 6).alias("log_p"))


def _mixed(spark, sf_dir):
    c = _counts(spark, sf_dir, "ivr", (4,))
    per = c.groupBy("gram", "composer").agg(F.sum("c").alias("own"))
    total = per.groupBy("composer").agg(F.sum("own").alias("own_n"))
    types = per.groupBy("gram").agg(F.sum("own").alias("all"))
    n = types.agg(F.sum("all").alias("all_n"))
    return per.join(total, "composer").join(types, "gram").crossJoin(F.broadcast(n)).select((F.col("own") / F.col("own_n")).alias("pc"), (F.col("all") / F.col("all_n")).alias("ps"))


@query("lambda_grid", f"WITH {_grams_sql('ivr', '4')}, own AS (SELECT gram, composer, count(*) AS own FROM gram GROUP BY ALL), x AS (SELECT own / sum(own) OVER (PARTITION BY composer) AS pc, sum(own) OVER (PARTITION BY gram) / sum(own) OVER () AS ps FROM own) SELECT i / 20 AS lam, round(sum(ln(greatest(i / 20 * pc + (1 - i / 20) * ps, 1e-300))), 4) AS loglik FROM x, range(21) t(i) GROUP BY 1")
def lambda_grid(spark, sf_dir):
    return bg.lambda_grid(_mixed(spark, sf_dir)).select("lam", F.round("loglik", 4).alias("loglik"))


@query("roc_points", "WITH s AS (SELECT n_chars AS score, quality AS y FROM documents JOIN labels USING (doc_id)), g AS (SELECT score, sum(y) AS p, sum(1 - y) AS n FROM s GROUP BY 1) SELECT score, round(sum(n) OVER w / sum(n) OVER (), 6) AS fpr, round(sum(p) OVER w / sum(p) OVER (), 6) AS tpr, round(sum(p) OVER w / (sum(p) OVER w + sum(n) OVER w), 6) AS precision FROM g WINDOW w AS (ORDER BY score DESC)")
def roc_points(spark, sf_dir):
    s = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id")
    r = evaluate.roc_points(s, "n_chars", "quality")
    return r.select("score", *[F.round(c, 6).alias(c) for c in ("fpr", "tpr", "precision")])


@query("roc_auc", "WITH s AS (SELECT n_chars AS score, quality AS y FROM documents JOIN labels USING (doc_id)), g AS (SELECT score, sum(y) AS p, sum(1 - y) AS n FROM s GROUP BY 1), c AS (SELECT score, sum(n) OVER w / sum(n) OVER () AS f, sum(p) OVER w / sum(p) OVER () AS t, sum(p) OVER w / (sum(p) OVER w + sum(n) OVER w) AS pr FROM g WINDOW w AS (ORDER BY score DESC)), d AS (SELECT (f - coalesce(lag(f) OVER o, 0)) * (t + coalesce(lag(t) OVER o, 0)) / 2 AS a, (t - coalesce(lag(t) OVER o, 0)) * pr AS b FROM c WINDOW o AS (ORDER BY score DESC)) SELECT round(sum(a), 6) AS auc, round(sum(b), 6) AS ap FROM d")
def roc_auc(spark, sf_dir):
    s = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id")
    r = evaluate.roc_summary(evaluate.roc_points(s, "n_chars", "quality"))
    return r.select(F.round("auc", 6).alias("auc"), F.round("ap", 6).alias("ap"))


@query("score_threshold", "SELECT round(quantile_cont(n_chars, 0.05), 6) AS threshold FROM documents JOIN labels USING (doc_id) WHERE quality = 0")
def score_threshold(spark, sf_dir):
    s = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id")
    return evaluate.threshold_at(s, "n_chars", "quality", 0.05).select(F.round("threshold", 6).alias("threshold"))


@query("decile_means", "WITH d AS (SELECT value, ntile(10) OVER (ORDER BY ts, event_id) AS decile FROM events) SELECT decile, count(*) AS rows, round(avg(value), 6) AS mean, round(stddev_samp(value) / sqrt(count(*)), 6) AS sem FROM d GROUP BY 1")
def decile_means(spark, sf_dir):
    d = evaluate.decile_means(table(spark, sf_dir, "events").select("ts", "event_id", "value"), ["ts", "event_id"], "value")
    return d.select("decile", "rows", F.round("mean", 6).alias("mean"), F.round("sem", 6).alias("sem"))


@query("spearman", "WITH o AS (SELECT o_totalprice AS a, o_custkey AS b FROM orders), r AS (SELECT rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2 AS x, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2 AS y FROM o) SELECT round(corr(x, y), 6) AS rho FROM r")
def spearman(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_totalprice").alias("a"), F.col("o_custkey").alias("b"))
    return evaluate.spearman(o, "a", "b").select(F.round("rho", 6).alias("rho"))


def _steps(spark, sf_dir):
    w = Window.partitionBy("work_id", "movement_idx", "voice_id", "seg").orderBy("pos")
    return _segs(spark, sf_dir).withColumn("step", F.lead("midi").over(w) - F.col("midi")).where("step is not null")


_HIST_SQL = f"WITH {SYMBOLS_SQL}, c AS (SELECT composer, greatest(-12, least(12, step)) AS step, count(*) AS c FROM sym GROUP BY ALL), h AS (SELECT k.composer, list(coalesce(c.c, 0) / t ORDER BY s) AS h FROM (SELECT composer, sum(c) AS t FROM c GROUP BY 1) k CROSS JOIN range(-12, 13) r(s) LEFT JOIN c ON c.composer = k.composer AND c.step = s GROUP BY 1)"


@query("interval_histogram", _HIST_SQL + " SELECT composer, round(h[9], 6) AS down4, round(h[13], 6) AS same, round(h[17], 6) AS up4 FROM h")
def interval_histogram(spark, sf_dir):
    h = similarity.interval_histogram(_steps(spark, sf_dir), "composer")
    return h.select("composer", *[F.round(F.col("h")[i], 6).alias(a) for i, a in ((8, "down4"), (12, "same"), (16, "up4"))])


@query("js_similarity", _HIST_SQL + ", n AS (SELECT composer, list_transform(h, lambda x: (x + 1e-9) / (list_sum(h) + 25e-9)) AS h FROM h) SELECT x.composer AS a, y.composer AS b, round(1 - sqrt(greatest(0, list_sum(list_transform(range(1, 26), lambda i: x.h[i] * ln(2 * x.h[i] / (x.h[i] + y.h[i])) + y.h[i] * ln(2 * y.h[i] / (x.h[i] + y.h[i])))) / 2)), 6) AS sim FROM n x JOIN n y ON x.composer < y.composer")
def js_similarity(spark, sf_dir):
    h = similarity.interval_histogram(_steps(spark, sf_dir), "composer")
    return similarity.pairs_of(h, "composer", "h", similarity.js_similarity).withColumn("sim", F.round("sim", 6))


@query("pitch_class_profile", f"WITH {NOTES_SQL} SELECT stratum, midi % 12 AS pc, round(sum(ql) / sum(sum(ql)) OVER (PARTITION BY stratum), 6) AS share FROM notes GROUP BY stratum, midi % 12")
def pitch_class_profile(spark, sf_dir):
    return similarity.pitch_classes(notes(spark, sf_dir), "stratum").withColumn("share", F.round("share", 6))


_CENTROID_SQL = "WITH e AS (SELECT label, unnest(range(1, len(embedding) + 1)) AS i, unnest(CAST(embedding AS DOUBLE[])) AS x FROM embeddings), m AS (SELECT label, i, avg(x) + 1e-9 AS x FROM e GROUP BY ALL), s AS (SELECT p.label AS a, q.label AS b, sum(p.x * q.x) / sqrt(sum(p.x * p.x) * sum(q.x * q.x)) AS sim FROM m p JOIN m q ON p.i = q.i AND p.label < q.label GROUP BY ALL)"


def _centroids(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("label", F.posexplode(F.col("embedding").cast("array<double>")).alias("i", "x"))
    m = e.groupBy("label", "i").agg(F.avg("x").alias("x")).groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v"))
    return m.select("label", F.col("v.x").alias("v"))


@query("cosine_similarity", _CENTROID_SQL + " SELECT a, b, round(sim, 6) AS sim FROM s")
def cosine_similarity(spark, sf_dir):
    return similarity.pairs_of(_centroids(spark, sf_dir), "label", "v", similarity.cosine_similarity).withColumn("sim", F.round("sim", 6))


@query("influence_edges", _CENTROID_SQL + ", w AS (SELECT a AS src, b AS dst, round(sim * (0.5 + 0.5 * exp(-((b - a) * 20.0) / 80)), 3) AS w FROM s) SELECT src, dst, w FROM w WHERE w > 0.02")
def influence_edges(spark, sf_dir):
    s = similarity.pairs_of(_centroids(spark, sf_dir), "label", "v", similarity.cosine_similarity)
    w = influence_weight(F.col("sim"), 1700 + F.col("a") * 20, 1700 + F.col("b") * 20)
    return s.select(F.col("a").alias("src"), F.col("b").alias("dst"), w.alias("w")).where("w > 0.02")


@query("running_edge_weight", "WITH RECURSIVE o AS (SELECT o_custkey % 25 AS src, o_orderstatus AS dst, o_totalprice AS x, row_number() OVER (PARTITION BY o_custkey % 25, o_orderstatus ORDER BY o_orderkey) AS k FROM orders), r AS (SELECT src, dst, x AS w, k FROM o WHERE k = 1 UNION ALL SELECT o.src, o.dst, (r.w + o.x) / 2, o.k FROM r JOIN o ON o.src = r.src AND o.dst = r.dst AND o.k = r.k + 1) SELECT src, dst, round(arg_max(w, k), 4) AS w FROM r GROUP BY ALL")
def running_edge_weight(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 25).alias("src"), F.col("o_orderstatus").alias("dst"), F.col("o_orderkey").alias("at"), F.col("o_totalprice").alias("w"))
    return similarity.running_edge_weight(o).withColumn("w", F.round("w", 4))


@query("lda_topics")
def lda_topics(spark, sf_dir):
    words = table(spark, sf_dir, "conversations").select(F.filter(F.split("text", r"\s+"), lambda w: w != "").alias("words"))
    return similarity.lda_topics(words)


@query("catalog_fields", r"""
WITH p AS (SELECT p_partkey, p_name || ' Op. ' || p_size || ' No. ' || (p_partkey % 9 + 1) AS t, 1400 + p_partkey % 520 AS y, p_size AS w FROM part)
SELECT p_partkey, 'op' || w || '/' || (p_partkey % 9 + 1) AS catalog_key, substr(regexp_replace(regexp_replace(lower(t), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 40) AS slug, y AS lo, y + w AS hi,
  CASE WHEN y + w <= 1749 THEN '<1750' WHEN y >= 1750 AND y + w <= 1799 THEN '1750–1800' WHEN y >= 1800 AND y + w <= 1829 THEN '1800–1830' WHEN y >= 1830 AND y + w <= 1899 THEN '1830–1900' WHEN y >= 1900 THEN '>1900' ELSE 'unknown' END AS period,
  CASE WHEN w <> 0 THEN 'range' ELSE 'approx' END AS certainty, CAST(round_even((y + y + w) / 2, 0) AS INT) AS year FROM p""")
def catalog_fields(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.concat_ws(" ", "p_name", F.lit("Op."), F.col("p_size").cast("string"), F.lit("No."), (F.col("p_partkey") % 9 + 1).cast("string")).alias("t"), (1400 + F.col("p_partkey") % 520).alias("y"), "p_size")
    p = p.withColumn("dates", F.concat_ws("///-", F.concat(F.lit("~"), F.col("y").cast("string")), (F.col("y") + F.col("p_size")).cast("string")))
    found = p.withColumn("ys", cat.years(F.col("dates"))).withColumn("lo", F.array_min("ys")).withColumn("hi", F.array_max("ys"))
    sure = cat.certainty(F.col("dates"), F.col("lo"), F.col("hi"))
    return found.select("p_partkey", cat.catalog_key(F.col("t")).alias("catalog_key"), cat.slug(F.col("t")).alias("slug"), F.col("lo").cast("long").alias("lo"), F.col("hi").cast("long").alias("hi"), cat.period_of_range(F.col("lo"), F.col("hi")).alias("period"), sure.alias("certainty"), cat.representative_year(F.col("lo"), F.col("hi"), sure).alias("year"))


@query("composer_ids", "SELECT DISTINCT c_custkey, lower(regexp_extract(c_name, '^([A-Za-z]*)', 1)) || '_lc' AS composer_id FROM customer")
def composer_ids(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return c.select("c_custkey", cat.composer_id(F.concat(F.regexp_extract("c_name", "^([A-Za-z]*)", 1), F.lit(", Ludwig van Carl"))).alias("composer_id")).distinct()


@query("first_row_per_key", "SELECT o_custkey, arg_min(o_orderstatus, o_orderkey) AS status, count(*) AS units FROM orders GROUP BY 1")
def first_row_per_key(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min_by("o_orderstatus", "o_orderkey").alias("status"), F.count("*").alias("units"))


@query("asof_join", "SELECT e.event_id, o.o_orderkey FROM events e ASOF LEFT JOIN (SELECT o_custkey, max(o_orderkey) AS o_orderkey, o_orderdate FROM orders GROUP BY o_custkey, o_orderdate) o ON o.o_custkey = e.user_id AND o.o_orderdate <= e.ts")
def asof_join(spark, sf_dir):
    """The last order of a user not after each event: one sort of the union, no range join."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("k"), F.col("ts").alias("at"), "event_id")
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderdate").cast("timestamp_ntz").alias("at"), "o_orderkey")
    return asof_backward(e, o, ["k"], "at", ["o_orderkey"]).select("event_id", "o_orderkey")


@query("bar_remaining", f"WITH {NOTES_SQL}, m AS (SELECT DISTINCT work_id, floor(off / 3) * 3 AS b, CASE WHEN floor(off / 3) % 2 = 0 THEN 3.0 ELSE 4.0 END AS l FROM notes WHERE voice = 0) SELECT n.work_id, n.mov AS movement_idx, n.voice::BIGINT AS voice_id, n.pos, coalesce(m.b + m.l - n.off, -1) AS left_in_bar FROM notes n ASOF LEFT JOIN m ON m.work_id = n.work_id AND m.b <= n.off + 1e-9")
def bar_remaining(spark, sf_dir):
    """Measures are where the first voice has notes; the other voice's notes follow the last of them."""
    n = notes(spark, sf_dir).withColumn("voice_id", F.col("voice_id").cast("long"))
    b = F.floor(F.col("offset") / 3)
    m = n.where("voice_id = 0").select("work_id", (b * 3).cast("double").alias("bar_offset"), F.when(b % 2 == 0, 3.0).otherwise(4.0).alias("bar_length")).distinct()
    return measured(n, m, ["work_id"]).select("work_id", "movement_idx", "voice_id", "pos", F.col("bar_remaining").alias("left_in_bar"))


@query("unit_work_pivot", "SELECT r_name, count(*) FILTER (c_mktsegment = 'BUILDING') AS building, count(*) FILTER (c_mktsegment = 'MACHINERY') AS machinery, count(*) AS total FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def unit_work_pivot(spark, sf_dir):
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return c.groupBy("r_name").agg(F.count_if(F.col("c_mktsegment") == "BUILDING").alias("building"), F.count_if(F.col("c_mktsegment") == "MACHINERY").alias("machinery"), F.count("*").alias("total"))


@query("header_scan", r"WITH l AS (SELECT page_id, generate_subscripts(s, 1) AS k, unnest(s) AS v FROM (SELECT page_id, string_split(html, '><') AS s FROM pages)) SELECT page_id, arg_min(regexp_extract(v, '<?title>(.*)', 1), k) AS title FROM l WHERE regexp_matches(v, '^<?title>') GROUP BY 1")
def header_scan(spark, sf_dir):
    lines = table(spark, sf_dir, "pages").select(F.col("page_id").alias("file"), F.posexplode(F.split("html", "><")).alias("line_no", "v"))
    marked = lines.where(F.col("v").rlike("^<?title>")).select("file", "line_no", F.lit("title").alias("key"), F.regexp_extract("v", r"<?title>([^\n]*)", 1).alias("text"))
    return files.first_values(marked).select(F.col("file").alias("page_id"), F.col("value").alias("title"))


_CONV = "SELECT conv_id, turn, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM conversations"


@query("gaps_and_islands", f"WITH x AS ({_CONV}), y AS (SELECT *, sum(CASE WHEN prev IS NOT DISTINCT FROM role THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM x) SELECT conv_id, k::BIGINT AS island, any_value(role) AS role, count(*) AS turns, min(turn) AS first_turn FROM y GROUP BY conv_id, k")
def gaps_and_islands(spark, sf_dir):
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = table(spark, sf_dir, "conversations").withColumn("new", F.when(F.lag("role").over(w).eqNullSafe(F.col("role")), 0).otherwise(1)).withColumn("island", F.sum("new").over(w))
    return c.groupBy("conv_id", "island").agg(F.any_value("role").alias("role"), F.count("*").alias("turns"), F.min("turn").alias("first_turn"))


@query("event_sessions", "WITH g AS (SELECT user_id, ts, value, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 72 HOUR THEN 1 ELSE 0 END AS cut FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(cut) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT user_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts) + INTERVAL 72 HOUR) AS end_us, count(*) AS events, round(sum(value), 4) AS total FROM s GROUP BY user_id, k")
def event_sessions(spark, sf_dir):
    s = sessions.event_sessions(table(spark, sf_dir, "events"))
    return s.select("user_id", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "events", F.round("total", 4).alias("total"))


@query("daily_counts", "SELECT epoch_us(date_trunc('day', ts)) AS day_us, event_type, count(*) AS events, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def daily_counts(spark, sf_dir):
    d = sessions.daily_counts(table(spark, sf_dir, "events"))
    return d.select(F.unix_micros("day").alias("day_us"), "event_type", "events", F.round("total", 4).alias("total"))


@query("rhythm_classes", "WITH q AS (SELECT l_orderkey, lag(l_quantity) OVER w AS a, l_quantity AS b FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice)) SELECT CASE WHEN a <= 0 OR b <= 0 THEN 0 WHEN b / a < 0.4 THEN -2 WHEN b / a < 0.9 THEN -1 WHEN b / a <= 1.1 THEN 0 WHEN b / a <= 2.5 THEN 1 ELSE 2 END AS class, count(*) AS cnt FROM q WHERE a IS NOT NULL GROUP BY 1")
def rhythm_classes(spark, sf_dir):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    q = table(spark, sf_dir, "lineitem").select("l_orderkey", F.lag("l_quantity").over(w).alias("a"), F.col("l_quantity").alias("b")).where("a is not null")
    return q.groupBy(rhythm_class(F.col("a"), F.col("b")).alias("class")).agg(F.count("*").alias("cnt"))


from stavework.plans import catalogue as _catalogue  # noqa: E402, F401  registers its queries
from stavework.plans import models as _models  # noqa: E402, F401
from stavework.plans import spaces as _spaces  # noqa: E402, F401
