"""Feature vectors, Jensen-Shannon and cosine similarity, influence edges, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stavework.functions.symbols import influence_weight, moving_token, nearest
from stavework.operators import topics

EPS = 1e-9
#: Duration levels of the rhythm histogram and of tokens, and their tolerance.
RHYTHM_LEVELS, TOKEN_LEVELS, LEVEL_TOLERANCE = (0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0, 4.0), (0.5, 1.0, 2.0, 4.0), 0.4


def interval_histogram(notes_with_step: DataFrame, by: str, clip: int = 12) -> DataFrame:
    """(by, h): normalised histogram of steps clipped to [-clip, clip], in order."""
    step = F.greatest(F.lit(-clip), F.least(F.lit(clip), F.col("step")))
    counts = notes_with_step.groupBy(by, step.alias("step")).agg(F.count("*").alias("c"))
    maps = counts.groupBy(by).agg(F.map_from_entries(F.collect_list(F.struct("step", "c"))).alias("m"), F.sum("c").alias("t"))
    return maps.select(by, F.transform(F.sequence(F.lit(-clip), F.lit(clip)), lambda s: F.coalesce(F.try_element_at("m", s), F.lit(0)) / F.col("t")).alias("h"))


def pitch_classes(notes: DataFrame, by: str) -> DataFrame:
    """(by, pc, share): pitch classes weighted by duration."""
    per = notes.groupBy(by, F.pmod("midi", F.lit(12)).alias("pc")).agg(F.sum("quarter_length").alias("q"))
    total = per.groupBy(by).agg(F.sum("q").alias("t"))
    return per.join(total, by).select(by, "pc", (F.col("q") / F.col("t")).alias("share"))


def rhythm_histogram(notes: DataFrame, by: str) -> DataFrame:
    """(by, h): normalised histogram of durations on the nearest level, one more bin for those
    further away than the tolerance."""
    q = F.col("quarter_length").cast("double")
    level = nearest(q, list(RHYTHM_LEVELS))
    k = F.array_position(F.array(*map(F.lit, RHYTHM_LEVELS)), level)
    bin_ = F.when(F.abs(level - q) <= LEVEL_TOLERANCE, k).otherwise(len(RHYTHM_LEVELS) + 1)
    counts = notes.groupBy(by, bin_.cast("int").alias("bin")).agg(F.count("*").alias("c"))
    maps = counts.groupBy(by).agg(F.map_from_entries(F.collect_list(F.struct("bin", "c"))).alias("m"), F.sum("c").alias("t"))
    return maps.select(by, F.transform(F.sequence(F.lit(1), F.lit(len(RHYTHM_LEVELS) + 1)), lambda b: F.coalesce(F.try_element_at("m", b), F.lit(0)) / F.col("t")).alias("h"))


def feature_vectors(notes: DataFrame, notes_with_step: DataFrame, by: str) -> DataFrame:
    """(by, v): 12 pitch classes, 25 intervals, 9 durations, each part normalised (zeros where empty)."""
    maps = pitch_classes(notes, by).groupBy(by).agg(F.map_from_entries(F.collect_list(F.struct("pc", "share"))).alias("m"))
    pcs = maps.select(by, F.transform(F.sequence(F.lit(0), F.lit(11)), lambda p: F.coalesce(F.try_element_at("m", p), F.lit(0.0))).alias("p"))
    empty = F.array_repeat(F.lit(0.0), 25)
    rows = pcs.join(interval_histogram(notes_with_step, by).withColumnRenamed("h", "i"), by, "left").join(rhythm_histogram(notes, by).withColumnRenamed("h", "r"), by)
    return rows.select(by, F.concat("p", F.coalesce("i", empty), "r").alias("v"))


def musical_words(notes: DataFrame, by: str, voice: list[str]) -> DataFrame:
    """(by, word): pitch-class sets that sound at one offset of a movement (two notes or more), and
    pairs of neighbouring intervals of a voice."""
    w = Window.partitionBy(*voice).orderBy("pos")
    step = notes.select(by, (F.lead("midi").over(w) - F.col("midi")).alias("a"), (F.lead("midi", 2).over(w) - F.lead("midi").over(w)).alias("b")).where("b is not null")
    melody = step.select(by, F.concat(F.lit("mel_"), F.col("a").cast("string"), F.lit("_"), F.col("b").cast("string")).alias("word"))
    chords = notes.groupBy(by, "movement_idx", "offset").agg(F.array_sort(F.collect_set(F.pmod("midi", F.lit(12)))).alias("pcs"), F.countDistinct("midi").alias("n")).where("n > 1")
    return melody.unionByName(chords.select(by, F.concat(F.lit("harm_"), F.array_join(F.col("pcs").cast("array<string>"), "-")).alias("word")))


def token_sequences(notes: DataFrame, by: str, order: list[str]) -> DataFrame:
    """(by, tokens): pitch class and duration level of every note in order."""
    q = F.col("quarter_length").cast("double")
    level = F.array_position(F.array(*map(F.lit, TOKEN_LEVELS)), nearest(q, list(TOKEN_LEVELS))) - 1
    rows = notes.select(by, F.struct(*order, moving_token(F.col("midi"), level).cast("int").alias("token")).alias("x"))
    return rows.groupBy(by).agg(F.array_sort(F.collect_list("x")).alias("xs")).select(by, F.col("xs.token").alias("tokens"))


def js_similarity(a: Column, b: Column) -> Column:
    """1 - Jensen-Shannon distance (root of the divergence, natural log) of smoothed, normalised vectors; 1 if undefined."""
    norm = lambda v: F.transform(v, lambda x: (x + EPS) / (F.aggregate(v, F.lit(0.0), lambda s, y: s + y) + EPS * F.size(v)))
    pairs = F.zip_with(norm(a), norm(b), lambda p, q: p * F.ln(2 * p / (p + q)) + q * F.ln(2 * q / (p + q)))
    divergence = F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x) / 2
    return F.coalesce(F.nanvl(1 - F.sqrt(F.greatest(divergence, F.lit(0.0))), F.lit(1.0)), F.lit(1.0))


def cosine_similarity(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: (p + EPS) * (q + EPS)), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def pairs_of(groups: DataFrame, key: str, vector: str, measure) -> DataFrame:
    """(a, b, sim) for a < b over a table of groups (composers, labels): a small dimension."""
    a, b = groups.select(F.col(key).alias("a"), F.col(vector).alias("va")), groups.select(F.col(key).alias("b"), F.col(vector).alias("vb"))
    return a.join(b, F.col("a") < F.col("b")).select("a", "b", measure(F.col("va"), F.col("vb")).alias("sim"))


def influence_graph(works: DataFrame, threshold: float = 0.55) -> DataFrame:
    """(src, dst, w) between composers: every older work's influence on a later one of another
    composer above the threshold, folded as (old + new) / 2 in the order of the works' names.

    ``works``: name, composer, year, v (feature vector).
    """
    side = lambda k: works.select(*[F.col(c).alias(f"{c}_{k}") for c in ("name", "composer", "year", "v")])
    pairs = side("a").join(side("b"), (F.col("composer_a") != F.col("composer_b")) & (F.col("year_a") < F.col("year_b")))
    w = influence_weight(js_similarity(F.col("v_a"), F.col("v_b")), F.col("year_a"), F.col("year_b"))
    edges = pairs.select(F.col("composer_a").alias("src"), F.col("composer_b").alias("dst"), F.struct("name_a", "name_b").alias("at"), w.alias("w")).where(F.col("w") > threshold)
    return running_edge_weight(edges)


def similarity_report(spaces: dict[str, DataFrame], order: str, top: int | None = None) -> DataFrame:
    """(a, b, one column per space): pairs of works with their similarity in every space, the most
    similar of one of them first."""
    rows = None
    for name, pairs in spaces.items():
        one = pairs.select("a", "b", F.round("sim", 3).alias(name))
        rows = one if rows is None else rows.join(one, ["a", "b"])
    ranked = rows.orderBy(F.desc(order), "a", "b")
    return ranked.limit(top) if top else ranked


def running_edge_weight(edges: DataFrame) -> DataFrame:
    """(src, dst, w): weights folded as (old + new) / 2 in the order of ``at``."""
    return edges.groupBy("src", "dst").agg(F.array_sort(F.collect_list(F.struct("at", "w"))).alias("ws")).select("src", "dst", F.expr("aggregate(slice(ws, 2, size(ws)), ws[0].w, (s, x) -> (s + x.w) / 2)").alias("w"))


def lda_topics(words: DataFrame, k: int = 4, iterations: int = 50, seed: int = 42) -> DataFrame:
    """(topic, rank, term, weight): top words of topics over column ``words``.

    Every word and every row counts in every step. Rows without words (null or empty) are left
    out; no words at all give an empty table."""
    return topics.top_words(words, k, iterations, seed, alpha=0.5, eta=0.1, top=6)


def work_embeddings(sequences: DataFrame, by: str, dims: int = 64, steps: int = 5, seed: int = 42) -> DataFrame:
    """(by, v): the mean of learnt token vectors of each work (Word2Vec stands in for a masked
    language model). Every token counts; empty sequences have zeros."""
    from pyspark.ml.feature import Word2Vec
    from pyspark.ml.functions import vector_to_array

    rows = sequences.select(by, F.transform(F.coalesce("tokens", F.array().cast("array<int>")), lambda t: t.cast("string")).alias("words"))
    model = Word2Vec(vectorSize=dims, minCount=0, maxIter=steps, seed=seed, numPartitions=1, inputCol="words", outputCol="mean").fit(rows.where(F.size("words") > 0))
    return model.transform(rows).select(by, vector_to_array("mean").alias("v"))
