"""A training-data pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir), where docs are the rows that the stage before
kept, and returns the next rows; all but the last return the columns of documents.
An empty table passes through every stage as an empty table. A null text counts as an
empty one, and stays null where a stage does not change it. Document ids are expected to
be unique; extra columns, under whatever names, are carried along until the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stavework.llm import bpe, fm, mixing, ngram_join, substring
from stavework.llm._env import write_table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go.

    The text and n_chars (null: a bin of its own) are inputs. A document without an id stays;
    rows that share an id stay or go together. Without labels none goes; labels of one kind
    give every document their smoothed share.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = fm.train(docs, labels, label="quality", metadata=("n_chars",))
    verdict = fm.classify(docs, model, threshold=0.3, metadata=("n_chars",))
    rejected = verdict.where("predicted = 0 and doc_id is not null").select(F.col("doc_id").alias("__id")).distinct()
    return docs.join(rejected, F.col("doc_id") == F.col("__id"), "left_anti")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays (five words, Jaccard 0.8): the one of
    the smallest id, all rows of it. Empty and blank texts are nobody's copies, a row without
    an id stays."""
    classes = ngram_join.jaccard_classes(docs, words=5, similarity=(80, 100))
    copies = classes.where("doc_id <> component_id").select(F.col("doc_id").alias("__id")).distinct()
    return docs.join(copies, F.col("doc_id") == F.col("__id"), "left_anti").select(*docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words and more that a document of a smaller id holds go from the others.

    A changed text is its words joined by one space, n_chars follows it; others stay as they are,
    null and short ones and those without an id too. Repeats within one document stay.
    """
    cut = substring.remove_repeats(docs, width=50).where("n_removed > 0").select(F.col("doc_id").alias("__id"), "kept").dropDuplicates(["__id"])
    changed = docs.join(cut, F.col("doc_id") == F.col("__id"), "left").withColumn("text", F.coalesce("kept", "text"))
    return changed.withColumn("n_chars", F.when(F.col("kept").isNotNull(), F.length("kept").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are mixed to their target weights; a document stands as often as it is taken.

    A null source is a source of its own, the last one. Texts without words weigh nothing and are
    taken as their place in the seeded order says. Reruns agree.
    """
    return mixing.mixed_documents(docs, weights=(5, 2, 1), share=1.5, max_epochs=2)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document of the mix, and the digests of both directions; a document
    that stands twice is encoded twice, a null or blank text has no ids."""
    import public_tokenizers

    done = bpe.encode(docs, str(public_tokenizers.path("word_bpe_49k.json")), decoded=True)
    return done.select("doc_id", "n_tokens", bpe.token_ids("ids").alias("ids"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("mixture", mixture), ("tokens", tokens)]

#: A fitted classifier, a seeded sample and a tokenizer are not SQL; tests/llm compares with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = write_table(docs, f"stage-{name}").df()
    return docs
