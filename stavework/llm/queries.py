"""Queries over the synthetic tables for the ten operators, and their SQL where it exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stavework.llm import ann, bpe, fm, katz, licenses, mixing, near_embed, ngram_join, substring, tokenfile


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_embed.near_duplicates(_table(spark, sf_dir, "embeddings"), cosine=0.9)


def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(_table(spark, sf_dir, "embeddings"), "id % 50 = 0", k=5)


def op3_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = bpe.encode(_table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"), decoded=True)
    return done.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = tokenfile.new_target(spark)
    tokenfile.write(_table(spark, sf_dir, "documents"), target, _tokenizer("byte_bpe_50k.json"), end_id=0)
    return tokenfile.read(spark, target).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files ``source/lang/doc_id.txt``; texts of at most 24 tokens that are a
    notice stand for their directory's licence file."""
    docs = _table(spark, sf_dir, "documents").withColumn("path", F.concat_ws("/", "source", "lang", F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("unnamed")), F.lit(".txt"))))
    return licenses.scan(docs, carry=("doc_id",), licence_file="n_tokens <= 24").select("doc_id", "license", "score", "origin", "from_dir")


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_classes(_table(spark, sf_dir, "documents"), words=4, similarity=(85, 100))


def op7_katz_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score_texts(_table(spark, sf_dir, "documents"), folds=10)


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = fm.train(docs, _table(spark, sf_dir, "labels"), label="quality", folds=5, metadata=("n_chars",))
    return fm.classify(docs, model, threshold=0.3, folds=5, metadata=("n_chars",))


def op9_source_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.mixture(_table(spark, sf_dir, "documents"), weights=(5, 2, 1), share=1.5, max_epochs=2)
    return mix.select("doc_id", "size", "source_size", "target", "taken")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substring.remove_repeats(_table(spark, sf_dir, "documents"), width=13)
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_embedding_near_dedup,
        op2_nearest_neighbours,
        op3_bpe_round_trip,
        op4_token_files,
        op5_license_scan,
        op6_ngram_jaccard_join,
        op7_katz_scores,
        op8_quality_classifier,
        op9_source_mixture,
        op10_substring_dedup,
        pipeline,
    )
}

_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
_REACH = """
    reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)"""


def _license_sql() -> str:
    notices = [(k, name, t) for k, (name, t) in enumerate((name, t) for name, texts in licenses.TEMPLATES.items() for t in texts)]
    rows = ", ".join("({}, '{}', '{}')".format(k, name, t.replace("'", "''")) for k, name, t in notices)
    return rf"""
WITH notices(notice, license, body) AS (VALUES {rows}),
terms AS (SELECT notice, license, term, 1 + ln(count(*)) AS tf FROM (SELECT notice, license, unnest(regexp_extract_all(lower(body), '{licenses.TOKEN}')) AS term FROM notices) GROUP BY ALL),
docs AS (SELECT doc_id, concat_ws('/', source, lang) AS dir, text, len(regexp_extract_all(lower(coalesce(text, '')), '{licenses.TOKEN}')) AS n_tokens FROM documents),
df AS (SELECT term, count(*) AS df FROM (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '{licenses.TOKEN}'))) AS term FROM docs) GROUP BY term),
idf AS (SELECT t.term, ln((1 + (SELECT count(*) FROM docs)) / (1 + coalesce(max(df), 0))) + 1 AS idf FROM terms t LEFT JOIN df USING (term) GROUP BY t.term),
vec AS (SELECT notice, license, term, tf * idf AS x FROM terms JOIN idf USING (term)),
unit AS (SELECT notice, license, term, x / sqrt(sum(x * x) OVER (PARTITION BY notice)) AS w FROM vec),
lines AS (SELECT doc_id, generate_subscripts(ls, 1) - 1 AS line, unnest(ls) AS content FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM docs)),
tf AS (SELECT doc_id, line, term, (1 + ln(count(*))) * any_value(idf) AS x FROM (SELECT doc_id, line, unnest(regexp_extract_all(lower(content), '{licenses.TOKEN}')) AS term FROM lines) JOIN idf USING (term) GROUP BY ALL),
sized AS (SELECT *, sqrt(sum(x * x) OVER (PARTITION BY doc_id, line)) AS len FROM tf),
scored AS (SELECT doc_id, line, notice, license, round(sum(x * w) / any_value(len), 6) AS score FROM sized JOIN unit USING (term) GROUP BY ALL),
own AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, line, notice) AS k FROM scored WHERE score >= 0.8) WHERE k = 1),
per_dir AS (SELECT dir, license, count(*) AS n, max(score) AS s FROM own JOIN docs USING (doc_id) WHERE n_tokens <= 24 GROUP BY ALL),
given AS (SELECT dir, license FROM (SELECT *, row_number() OVER (PARTITION BY dir ORDER BY n DESC, s DESC, license) AS k FROM per_dir) WHERE k = 1)
SELECT d.doc_id, coalesce(o.license, g.license) AS license, o.score, CASE WHEN o.license IS NOT NULL THEN 'notice' WHEN g.license IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin, CASE WHEN o.license IS NULL THEN g.dir END AS from_dir
FROM docs d LEFT JOIN own o USING (doc_id) LEFT JOIN given g ON g.dir = d.dir"""


ORACLE_SQL: dict[str, str] = {
    "op1_embedding_near_dedup": f"""
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS MATERIALIZED (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.vec_id <> y.vec_id AND len(x.e) = len(y.e) AND list_cosine_similarity(x.e, y.e) >= 0.9),{_REACH}
SELECT vec_id, (SELECT count(*) FROM links WHERE a = vec_id) AS n_links, least(vec_id, coalesce((SELECT min(b) FROM reach WHERE a = vec_id), vec_id)) AS component_id,
    vec_id = least(vec_id, coalesce((SELECT min(b) FROM reach WHERE a = vec_id), vec_id)) AS kept FROM embeddings""",
    "op5_license_scan": _license_sql(),
    "op6_ngram_jaccard_join": rf"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS ws FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i+3], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
inter AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
links AS MATERIALIZED (SELECT a, b FROM inter JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 85 * (p.n + q.n - c)),{_REACH}
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, least(w.doc_id, coalesce(m.low, w.doc_id)) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a, min(b) AS low FROM reach GROUP BY a) m ON m.a = w.doc_id""",
    "op10_substring_dedup": rf"""
WITH w AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS ws FROM documents),
win AS MATERIALIZED (SELECT doc_id, unnest(range(1, len(ws) - 11)) AS i, array_to_string(ws[i:i+12], ' ') AS g FROM w WHERE len(ws) >= 13),
first AS (SELECT g, min(doc_id) AS f FROM win GROUP BY g),
hit AS (SELECT DISTINCT doc_id, i + k AS p FROM (SELECT doc_id, i FROM win JOIN first USING (g) WHERE doc_id > f), range(13) t(k)),
word AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS p, unnest(ws) AS word FROM w),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS kept, count(*) AS n FROM word ANTI JOIN hit USING (doc_id, p) GROUP BY doc_id)
SELECT w.doc_id, len(ws) AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)""",
}
