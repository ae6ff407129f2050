"""Readers and writers of score catalogues and note tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stavework.functions.catalog import fraction


def first_values(hits: DataFrame) -> DataFrame:
    """(file, key, value): the text of the first line of each key; hits have file, line_no, key, text."""
    return hits.groupBy("file", "key").agg(F.min_by("text", "line_no").alias("value"))


def reference_records(lines: DataFrame) -> DataFrame:
    """(file, key, value): first ``!!!KEY: value`` line of each key; lines have file, line_no, value."""
    hit = lines.where(F.col("value").rlike(r"^!!![^:]+:")).select("file", "line_no", F.regexp_extract("value", r"^!!!([^:]+):", 1).alias("key"), F.trim(F.regexp_extract("value", r"^!!![^:]+:(.*)$", 1)).alias("text"))
    return first_values(hit)


def work_headers(lines: DataFrame, first: int = 60) -> DataFrame:
    """(file, wk, mv, l1, l2, l3) of the first ``WK#:.. MV#:..`` line among a file's first lines."""
    w = Window.partitionBy("file").orderBy("line_no")
    ahead = lines.where(F.col("line_no") < first).select("file", "line_no", "value", *[F.lead("value", k).over(w).alias(f"l{k}") for k in (1, 2, 3)])
    hit = ahead.where(F.col("value").rlike(r"WK#:.*MV#:")).groupBy("file").agg(F.min_by(F.struct("value", "l1", "l2", "l3"), "line_no").alias("h"))
    return hit.select("file", F.trim(F.regexp_extract("h.value", r"WK#:(.*?)MV#:", 1)).alias("wk"), F.trim(F.regexp_extract("h.value", r"MV#:(.*)$", 1)).alias("mv"), "h.l1", "h.l2", "h.l3")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, value) of text files; a file is one row until it is split."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    return whole.select("file", F.posexplode(F.split("value", "\r?\n")).alias("line_no", "value"))


def read_notes_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Rows of note tables as text columns, onset from whichever column there is."""
    raw = spark.read.csv(path, sep="\t", header=True).withColumn("file", F.col("_metadata.file_path"))
    onset = "quarterbeats_all_endings" if "quarterbeats_all_endings" in raw.columns else "quarterbeats"
    num, den = F.split("timesig", "/")[0].try_cast("double"), F.split("timesig", "/")[1].try_cast("double")
    return raw.select("file", F.col("staff").try_cast("int").alias("staff"), F.col("voice").try_cast("int").alias("voice"), F.col("mc").try_cast("int").alias("mc"), fraction(F.col(onset)).alias("onset"), fraction(F.col("duration_qb")).alias("dur"), F.col("midi").try_cast("int").alias("midi"), F.col("tied").try_cast("int").alias("tied"), F.coalesce(4 * num / den - 4 * fraction(F.col("mc_onset")), F.lit(-1.0)).alias("bar_remaining"))


def flatten_notes(rows: DataFrame) -> DataFrame:
    """Events of a part in order: chords keep their top note, tied notes are merged, gaps
    become rests that are added up in the next note's gap_before.

    rows: file, staff, voice, mc, onset, dur, midi, tied, bar_remaining.
    """
    part = ("file", "staff")
    v = Window.partitionBy(*part, "voice").orderBy("onset")
    top = rows.where("onset is not null and midi is not null").groupBy(*part, "voice", "onset").agg(F.max_by(F.struct("midi", "dur", "mc", "tied", "bar_remaining"), F.struct("midi", "dur")).alias("n"), (F.count("*") > 1).cast("int").alias("from_chord"))
    flat = top.select(*part, "voice", "onset", "n.*", "from_chord")
    joins = F.col("tied").isin(0, -1) & (F.lag("midi").over(v) == F.col("midi")) & (F.abs(F.lag(F.col("onset") + F.col("dur")).over(v) - F.col("onset")) < 1e-3)
    island = flat.withColumn("begin", F.when(F.coalesce(joins, F.lit(False)), 0).otherwise(1)).withColumn("k", F.sum("begin").over(v))
    held = island.groupBy(*part, "voice", "k").agg(F.min("onset").alias("onset"), F.min_by(F.struct("midi", "mc", "bar_remaining", "from_chord"), "onset").alias("n"), F.sum("dur").alias("dur"), F.max_by("mc", "onset").alias("last_mc")).select(*part, "voice", "onset", "n.*", "dur", "last_mc")
    past = v.rowsBetween(Window.unboundedPreceding, -1)
    gap = held.withColumn("end", F.max(F.col("onset") + F.col("dur")).over(past)).withColumn("prev_mc", F.lag("last_mc").over(v))
    rest = (F.col("onset") - F.col("end") > 1e-3) & ((F.col("voice") == 1) | (F.col("mc") == F.col("prev_mc")))
    rests = gap.where(rest).select(*part, "voice", F.col("end").alias("onset"), F.lit(None).cast("int").alias("midi"), (F.col("onset") - F.col("end")).alias("dur"), F.lit(0).alias("from_chord"), F.lit(-1.0).alias("bar_remaining"))
    events = held.select(*part, "voice", "onset", "midi", "dur", "from_chord", "bar_remaining").unionByName(rests)
    line = Window.partitionBy(*part).orderBy("onset", "voice", F.col("midi").isNotNull())
    numbered = events.withColumn("note_no", F.count("midi").over(line.rowsBetween(Window.unboundedPreceding, -1)))
    silent = Window.partitionBy(*part, "note_no")
    out = numbered.withColumn("gap_before", F.coalesce(F.sum(F.when(F.col("midi").isNull(), F.col("dur"))).over(silent), F.lit(0.0))).where("midi is not null")
    return out.select(*part, (F.col("note_no") + 1).alias("pos"), "voice", "onset", "midi", "dur", "from_chord", "gap_before", "bar_remaining")


def parse_scores(files: DataFrame, parsers: dict[str, Callable[[bytes], list[tuple]]], fallback: Callable[[bytes], list[tuple]] | None = None) -> DataFrame:
    """Events of score files, by the parser of their format; other formats, and files their parser
    fails on, go to ``fallback``.

    ``files``: unit_id, format, content. A parser turns bytes into rows (voice, onset, dur, midi); it is
    a plain function, since notations need a library of their own. Returns unit_id, status (ok or
    fail), error, voice, onset, dur, midi: a file that nothing can read is one row with its error.
    """

    def read(kind: str, content: bytes) -> tuple[list[tuple], str]:
        error = f"no parser for {kind}"
        for parse in (parsers.get(kind), fallback):
            if parse is not None:
                try:
                    return list(parse(content)), ""
                except Exception as e:  # noqa: BLE001  any fault of a foreign parser is the file's
                    error = f"{type(e).__name__}: {e}"[:200]
        return [], error

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for unit, kind, content in zip(pdf.unit_id, pdf.format, pdf.content):
                rows, error = read(kind, bytes(content or b""))
                events = [(unit, "ok", None, *r) for r in rows] if not error else [(unit, "fail", error, None, None, None, None)]
                yield pd.DataFrame(events, columns=["unit_id", "status", "error", "voice", "onset", "dur", "midi"])

    return files.select("unit_id", "format", "content").mapInPandas(run, "unit_id string, status string, error string, voice int, onset double, dur double, midi int")


def of_collections(units: DataFrame, names: list[str]) -> DataFrame:
    """Units whose collection, or its root (the part before the first slash), is among ``names``."""
    return units.where(F.col("collection").isin(*names) | collection_root(F.col("collection")).isin(*names))


def collection_root(collection: Column) -> Column:
    return F.substring_index(collection, "/", 1)


def short_label(name: Column, separator: str = " · ") -> Column:
    """The second part of a name, or the whole of it."""
    return F.coalesce(F.try_element_at(F.split(name, separator, -1), F.lit(2)), name)


def keep_existing(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Full-outer merge: values already there win, new rows are added."""
    columns = [c for c in new.columns if c != key]
    a, b = old.alias("a"), new.alias("b")
    return a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer").select(F.coalesce(f"a.{key}", f"b.{key}").alias(key), *[F.coalesce(f"a.{c}", f"b.{c}").alias(c) for c in columns])


def write_notes(notes: DataFrame, path: str, existing: DataFrame | None = None) -> None:
    """Append works that are not there yet, compressed, partitioned by composer."""
    fresh = notes if existing is None else notes.join(existing.select("work_id").distinct(), "work_id", "left_anti")
    fresh.write.mode("append").partitionBy("composer").option("compression", "zstd").parquet(path)


def write_report(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)
