"""Queries of feature spaces, motifs, voices, samples and logs, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from stavework.operators import calibrate as cal
from stavework.operators import curves, evaluate, similarity, voices
from stavework.operators.sequences import padded_windows, symbol_arrays
from stavework.plans.queries import SYMBOLS_SQL, _segs, _steps, query
from stavework.sources import files
from stavework.sources.notes import NOTES_SQL, notes, table
from stavework.sources.tables import merge_log, pending, report, scratch, store

_TEXT = lambda c: F.array_join(F.col(c).cast("array<string>"), " ")

# -- voices ---------------------------------------------------------------------------------------
_TOKENS = f"""{NOTES_SQL},
nx AS (SELECT work_id, mov, voice, round_even(off, 3) AS onset, lead(midi) OVER w - midi AS step, lead(ql) OVER w / ql AS r FROM notes WINDOW w AS (PARTITION BY work_id, mov, voice ORDER BY pos)),
tk AS (SELECT DISTINCT work_id, mov, voice, onset, step, CASE WHEN r < 0.4 THEN -2 WHEN r < 0.9 THEN -1 WHEN r <= 1.1 THEN 0 WHEN r <= 2.5 THEN 1 ELSE 2 END AS beat FROM nx WHERE step IS NOT NULL)"""


@query("kept_voices", f"WITH {_TOKENS}, tt AS (SELECT DISTINCT work_id, voice, step, beat FROM tk), z AS (SELECT work_id, voice, count(*) AS n FROM tt GROUP BY ALL), s AS (SELECT x.work_id, count(*) AS s FROM tt x JOIN tt y ON x.work_id = y.work_id AND x.step = y.step AND x.beat = y.beat AND x.voice = 0 AND y.voice = 1 GROUP BY 1), v AS (SELECT DISTINCT work_id, voice FROM notes) SELECT v.work_id, v.voice::BIGINT AS voice, v.voice = 0 OR coalesce(NOT (p.n >= 4 AND q.n >= 4 AND s.s / least(p.n, q.n) > 0.6), true) AS kept FROM v LEFT JOIN s USING (work_id) LEFT JOIN z p ON p.work_id = v.work_id AND p.voice = 0 LEFT JOIN z q ON q.work_id = v.work_id AND q.voice = 1")
def kept_voices(spark, sf_dir):
    """The two voices of every work, compared without their times (the synthetic voices never
    sound together), at a share of 0.6."""
    n = notes(spark, sf_dir).withColumn("offset", F.lit(0.0)).withColumn("voice_id", F.col("voice_id").cast("long"))
    tokens = voices.voice_tokens(n, ["work_id", "movement_idx"]).select("work_id", "voice", "at", "step", "beat").distinct()
    all_voices = n.select("work_id", F.col("voice_id").alias("voice")).distinct()
    return voices.greedy(all_voices, tokens, ["work_id"], share=0.6).select("work_id", "voice", "kept")


@query("voice_tokens", f"WITH {_TOKENS} SELECT work_id, mov AS movement_idx, voice::BIGINT AS voice, count(*) AS tokens, sum(step)::BIGINT AS steps, sum(beat)::BIGINT AS beats FROM tk GROUP BY ALL")
def voice_tokens(spark, sf_dir):
    t = voices.voice_tokens(notes(spark, sf_dir), ["work_id", "movement_idx"])
    return t.groupBy("work_id", "movement_idx", F.col("voice").cast("long").alias("voice")).agg(F.count("*").alias("tokens"), F.sum("step").alias("steps"), F.sum("beat").alias("beats"))


# -- feature spaces ---------------------------------------------------------------------------------
_VECTORS = f"""{SYMBOLS_SQL},
pcs AS (SELECT composer, midi % 12 AS k, sum(ql) AS x FROM long GROUP BY ALL), ivs AS (SELECT composer, greatest(-12, least(12, step)) + 12 AS k, count(*)::DOUBLE AS x FROM sym GROUP BY ALL),
rhs AS (SELECT composer, CASE ql WHEN 0.5 THEN 1 WHEN 1 THEN 3 ELSE 5 END AS k, count(*)::DOUBLE AS x FROM long GROUP BY ALL),
cs AS (SELECT DISTINCT composer FROM long),
vec AS (SELECT composer, list(x / t ORDER BY i) AS v FROM (
  SELECT cs.composer, r.k AS i, coalesce(p.x, 0) AS x, sum(p.x) OVER (PARTITION BY cs.composer) AS t FROM cs CROSS JOIN range(12) r(k) LEFT JOIN pcs p ON p.composer = cs.composer AND p.k = r.k
  UNION ALL SELECT cs.composer, 12 + r.k, coalesce(p.x, 0), sum(p.x) OVER (PARTITION BY cs.composer) FROM cs CROSS JOIN range(25) r(k) LEFT JOIN ivs p ON p.composer = cs.composer AND p.k = r.k
  UNION ALL SELECT cs.composer, 37 + r.k, coalesce(p.x, 0), sum(p.x) OVER (PARTITION BY cs.composer) FROM cs CROSS JOIN range(9) r(k) LEFT JOIN rhs p ON p.composer = cs.composer AND p.k = r.k) GROUP BY composer)"""
_JS = "round(1 - sqrt(greatest(0, list_sum(list_transform(range(1, 47), lambda i: {a}[i] * ln(2 * {a}[i] / ({a}[i] + {b}[i])) + {b}[i] * ln(2 * {b}[i] / ({a}[i] + {b}[i])))) / 2)), {d})"
_SMOOTH = "sv AS (SELECT composer, list_transform(v, lambda x: (x + 1e-9) / (list_sum(v) + 46e-9)) AS v FROM vec)"


def _vectors(spark, sf_dir):
    segs = _segs(spark, sf_dir)
    return similarity.feature_vectors(segs, _steps(spark, sf_dir), "composer")


@query("feature_vectors", f"WITH {_VECTORS} SELECT composer, len(v) AS dims, round(list_sum(v), 6) AS total, array_to_string(list_transform(v, lambda x: round(x * 1000)::INT), ' ') AS v FROM vec")
def feature_vectors(spark, sf_dir):
    f = _vectors(spark, sf_dir)
    total = F.aggregate("v", F.lit(0.0), lambda s, x: s + x)
    return f.select("composer", F.size("v").cast("long").alias("dims"), F.round(total, 6).alias("total"), F.array_join(F.transform("v", lambda x: F.round(x * 1000).cast("int").cast("string")), " ").alias("v"))


def _spaces(spark, sf_dir):
    pairs = similarity.pairs_of(_vectors(spark, sf_dir), "composer", "v", similarity.js_similarity)
    h = similarity.pairs_of(similarity.interval_histogram(_steps(spark, sf_dir), "composer"), "composer", "h", similarity.js_similarity)
    cosine = similarity.pairs_of(_vectors(spark, sf_dir), "composer", "v", similarity.cosine_similarity)
    return {"features": pairs, "intervals": h, "cosine": cosine}


_REPORT = f"""{_VECTORS}, {_SMOOTH}, hv AS (SELECT composer, list_transform(v[13:37], lambda x: (x + 1e-9) / (1 + 25e-9)) AS h FROM vec),
rp AS (SELECT x.composer AS a, y.composer AS b, {_JS.format(a='x.v', b='y.v', d=3)} AS features, round(1 - sqrt(greatest(0, list_sum(list_transform(range(1, 26), lambda i: g.h[i] * ln(2 * g.h[i] / (g.h[i] + k.h[i])) + k.h[i] * ln(2 * k.h[i] / (g.h[i] + k.h[i])))) / 2)), 3) AS intervals,
  round(list_cosine_similarity(list_transform(p.v, lambda z: z + 1e-9), list_transform(q.v, lambda z: z + 1e-9)), 3) AS cosine FROM sv x JOIN sv y ON x.composer < y.composer JOIN hv g ON g.composer = x.composer JOIN hv k ON k.composer = y.composer JOIN vec p ON p.composer = x.composer JOIN vec q ON q.composer = y.composer)"""


@query("similarity_report", f"WITH {_REPORT} SELECT * FROM rp")
def similarity_report(spark, sf_dir):
    return similarity.similarity_report(_spaces(spark, sf_dir), "cosine")


@query("agreement_of_spaces", f"WITH {_REPORT}, r AS (SELECT rank() OVER (ORDER BY features) + (count(*) OVER (PARTITION BY features) - 1) / 2 AS x, rank() OVER (ORDER BY intervals) + (count(*) OVER (PARTITION BY intervals) - 1) / 2 AS y FROM rp) SELECT round(corr(x, y), 5) AS rho FROM r")
def agreement_of_spaces(spark, sf_dir):
    return evaluate.spearman(similarity_report(spark, sf_dir), "features", "intervals").select(F.round("rho", 5).alias("rho"))


@query("influence_graph", f"WITH {_VECTORS}, {_SMOOTH}, y AS (SELECT composer, 1700 + 3 * (substr(composer, 8)::INT) AS year, v FROM sv), e AS (SELECT p.composer AS src, q.composer AS dst, round({_JS.format(a='p.v', b='q.v', d=12)} * (0.5 + 0.5 * exp(-(q.year - p.year) / 80.0)), 3) AS w FROM y p JOIN y q ON p.composer <> q.composer AND p.year < q.year) SELECT src, dst, w FROM e WHERE w > 0.55")
def influence_graph(spark, sf_dir):
    """One work per composer here, so every edge has one weight; years follow the nation's number."""
    works = _vectors(spark, sf_dir).select(F.col("composer").alias("name"), "composer", (1700 + 3 * F.substring("composer", 8, 9).cast("int")).alias("year"), "v")
    return similarity.influence_graph(works)


@query("musical_words", f"WITH {NOTES_SQL}, m AS (SELECT composer, 'mel_' || (lead(midi) OVER w - midi) || '_' || (lead(midi, 2) OVER w - lead(midi) OVER w) AS word FROM long WINDOW w AS (PARTITION BY work_id, mov, voice, seg ORDER BY pos)), h AS (SELECT composer, 'harm_' || array_to_string(list_sort(list_distinct(list(midi % 12))), '-') AS word FROM long GROUP BY composer, mov, off HAVING count(DISTINCT midi) > 1) SELECT composer, word, count(*) AS cnt FROM (SELECT * FROM m WHERE word IS NOT NULL UNION ALL SELECT * FROM h) GROUP BY ALL")
def musical_words(spark, sf_dir):
    w = similarity.musical_words(_segs(spark, sf_dir), "composer", ["work_id", "movement_idx", "voice_id", "seg"])
    return w.groupBy("composer", "word").agg(F.count("*").alias("cnt"))


@query("training_windows", f"WITH {NOTES_SQL}, t AS (SELECT work_id, list_concat([50], list((midi % 12) * 4 + CASE ql WHEN 0.5 THEN 0 WHEN 1 THEN 1 ELSE 2 END ORDER BY mov, voice, pos)) AS s FROM notes GROUP BY 1), w AS (SELECT work_id, unnest(range(0, greatest(len(s) - 32, 0) + 1, 8)) AS i, s FROM t) SELECT work_id, (i // 8)::BIGINT AS k, array_to_string(list_resize(s[i+1:i+32], 32, 48), ' ') AS tokens, least(32, len(s) - i)::BIGINT AS filled FROM w")
def training_windows(spark, sf_dir):
    t = similarity.token_sequences(notes(spark, sf_dir), "work_id", ["movement_idx", "voice_id", "pos"])
    w = padded_windows(t, "work_id", "tokens")
    return w.select("work_id", F.col("k").cast("long").alias("k"), _TEXT("tokens").alias("tokens"), F.aggregate("mask", F.lit(0), lambda s, x: s + x).cast("long").alias("filled"))


# -- motifs -----------------------------------------------------------------------------------------
_MOTIFS = f"""{SYMBOLS_SQL},
st AS (SELECT work_id, mov, voice, seg, i - 1 AS start, iv[i:i+2] AS gram FROM (SELECT *, unnest(range(1, len(iv) - 1)) AS i FROM arr WHERE len(iv) >= 3) WHERE iv[i:i+2] <> [200, 200, 200]),
hd AS (SELECT work_id, gram, count(*) AS n, list((mov, voice, seg, start) ORDER BY mov, voice, seg, start) AS p FROM st GROUP BY ALL),
sh AS (SELECT x.work_id AS a, y.work_id AS b, x.gram, x.n AS na, y.n AS nb, x.p AS pa FROM nation JOIN hd x ON x.work_id = n_nationkey JOIN hd y ON y.work_id = n_nationkey + 25 AND y.gram = x.gram),
bd AS (SELECT * FROM sh QUALIFY row_number() OVER (PARTITION BY a, b ORDER BY list_sum(list_transform(gram, lambda z: abs(z - 200))) DESC, gram) = 1)"""


def _shared(spark, sf_dir):
    starts = curves.motif_starts(symbol_arrays(_segs(spark, sf_dir)), "iv", 3)
    k = F.col("n_nationkey").cast("long")
    return curves.shared_motifs(starts, table(spark, sf_dir, "nation").select(k.alias("a"), (k + 25).alias("b")))


@query("shared_motifs", f"WITH {_MOTIFS} SELECT a, b, array_to_string(gram, ' ') AS gram, na AS occ_a, nb AS occ_b, pa[1].start AS first_a FROM (SELECT a, b, gram, na, nb, [{{'start': pa[1][4]}}] AS pa FROM sh)")
def shared_motifs(spark, sf_dir):
    return _shared(spark, sf_dir).select("a", "b", _TEXT("gram").alias("gram"), F.size("starts_a").cast("long").alias("occ_a"), F.size("starts_b").cast("long").alias("occ_b"), F.col("starts_a")[0]["start"].cast("long").alias("first_a"))


@query("motif_highlights", f"WITH {_MOTIFS}, x AS (SELECT a, unnest(pa) AS s FROM bd) SELECT DISTINCT a, s[1] AS movement_idx, s[2]::BIGINT AS voice_id, s[3]::BIGINT AS seg, s[4] + unnest(range(0, 4)) AS note FROM x")
def motif_highlights(spark, sf_dir):
    h = curves.highlights(curves.boldest(_shared(spark, sf_dir)), "starts_a", 3)
    return h.select("a", "movement_idx", F.col("voice_id").cast("long").alias("voice_id"), "seg", F.col("note").cast("long").alias("note"))


# -- samples and logs ---------------------------------------------------------------------------------
@query("weighted_picks", "SELECT o_orderstatus AS key, count(*) AS picks FROM (SELECT o_orderstatus, l_linenumber FROM orders JOIN lineitem ON l_orderkey = o_orderkey) GROUP BY 1")
def weighted_picks(spark, sf_dir):
    """Every line of an order picked once by its place in the running total of lines per status."""
    lines = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    w = store(lines.groupBy("o_orderstatus").agg(F.count("*").alias("n")), scratch(spark, "weights"))
    total = w.agg(F.sum("n").alias("t"))
    step, last = 1 << 16, F.col("t") + 5
    blocks = total.select(F.explode(F.sequence(F.lit(0).cast("long"), last, F.lit(step).cast("long"))).alias("b"), last.alias("last"))
    dealt = blocks.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "b")
    picks = dealt.select(F.explode(F.sequence("b", F.least(F.col("b") + step - 1, "last"))).alias("pick"))
    return cal.weighted_picks(w, "o_orderstatus", "n", picks).groupBy("key").agg(F.count("*").alias("picks"))


def _logs(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("unit_id"), F.col("o_orderstatus").alias("s"), "o_orderkey")
    old = o.where("o_orderkey % 2 = 0").select("unit_id", F.when(F.col("s") == "F", "fail").otherwise("ok").alias("status"), F.lit("old").alias("run"))
    new = o.where("o_orderkey % 3 = 0").select("unit_id", F.when(F.col("s") == "O", "cached").otherwise("ok").alias("status"), F.lit("new").alias("run"))
    return o, old, new


_LOGS = """old AS (SELECT o_orderkey::VARCHAR AS unit_id, CASE WHEN o_orderstatus = 'F' THEN 'fail' ELSE 'ok' END AS status, 'old' AS run FROM orders WHERE o_orderkey % 2 = 0),
new AS (SELECT o_orderkey::VARCHAR AS unit_id, CASE WHEN o_orderstatus = 'O' THEN 'cached' ELSE 'ok' END AS status, 'new' AS run FROM orders WHERE o_orderkey % 3 = 0)"""


@query("merged_log", f"WITH {_LOGS} SELECT * FROM new WHERE status <> 'cached' UNION ALL SELECT * FROM old WHERE unit_id NOT IN (SELECT unit_id FROM new WHERE status <> 'cached') UNION ALL SELECT * FROM new WHERE status = 'cached' AND unit_id NOT IN (SELECT unit_id FROM old)")
def merged_log(spark, sf_dir):
    _, old, new = _logs(spark, sf_dir)
    return merge_log(old, new)


@query("pending_units", f"WITH {_LOGS} SELECT o_orderkey::VARCHAR AS unit_id FROM orders WHERE o_orderkey % 2 = 1 AND o_orderkey::VARCHAR LIKE '1%'")
def pending_units(spark, sf_dir):
    o, old, _ = _logs(spark, sf_dir)
    return pending(o.select("unit_id"), old, only="1").select("unit_id")


@query("report_table", "SELECT line_no::INT AS line_no, line FROM (SELECT -2 AS line_no, '| o_orderstatus | orders |' AS line UNION ALL SELECT -1, '|---|---|' UNION ALL SELECT row_number() OVER (ORDER BY count(*) DESC, o_orderstatus) - 1, '| ' || o_orderstatus || ' | ' || count(*) || ' |' FROM orders GROUP BY o_orderstatus)")
def report_table(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("orders"))
    return report(rows, ["o_orderstatus", "orders"], [F.desc("orders"), F.asc("o_orderstatus")])


@query("regression_check", "SELECT o_orderpriority AS key, 'orders' AS stat, count(*) AS found, (count(*) + o_orderpriority[1]::INT)::BIGINT AS golden, round(-(o_orderpriority[1]::INT) / (count(*) + o_orderpriority[1]::INT), 8) AS deviation, o_orderpriority[1]::INT / (count(*) + o_orderpriority[1]::INT) <= 0.0005 AS ok FROM orders GROUP BY 1")
def regression_check(spark, sf_dir):
    found = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("key")).agg(F.count("*").alias("found")).withColumn("stat", F.lit("orders"))
    golden = found.select("key", "stat", (F.col("found") + F.substring("key", 1, 1).cast("long")).alias("golden"))
    out = evaluate.regression_check(found, golden, tolerance=0.0005)
    return out.withColumn("deviation", F.round("deviation", 8))



@query("work_embeddings")
def work_embeddings(spark, sf_dir):
    t = similarity.token_sequences(notes(spark, sf_dir), "work_id", ["movement_idx", "voice_id", "pos"])
    v = similarity.work_embeddings(t, "work_id", dims=16, steps=1)
    return v.select("work_id", F.size("v").alias("dims"), F.exists("v", lambda x: x != 0).alias("learnt"))


@query("collection_roots", "SELECT split_part(replace(p_type, ' ', '/'), '/', 1) AS root, count(*) AS units FROM part WHERE split_part(replace(p_type, ' ', '/'), '/', 1) IN ('ECONOMY', 'STANDARD', 'PROMO') GROUP BY 1")
def collection_roots(spark, sf_dir):
    u = table(spark, sf_dir, "part").select(F.replace("p_type", F.lit(" "), F.lit("/")).alias("collection"))
    return files.of_collections(u, ["ECONOMY", "STANDARD", "PROMO"]).groupBy(files.collection_root(F.col("collection")).alias("root")).agg(F.count("*").alias("units"))
