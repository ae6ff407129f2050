"""License scan with DataFrame functions only.

Passages of every file are compared with the licence templates by the cosine of
sparse TF-IDF vectors over the templates' terms (document frequencies from the
whole corpus). Passages are the lines, runs of two to four consecutive lines, windows
of as many tokens as a template has (over line ends too), and whole licence files.
A passage without any *distinctive* term cannot reach the threshold: the other terms
of a template carry less than that share of its length, so only passages with one
are scored. A file's notice is its best passage. A licence file gives its licence
to its directory; files without a notice inherit from the nearest ancestor directory
that has one, found by equi-joins on directory paths.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stavework.llm._env import project, write_table

TOKEN = r"[a-z0-9]+(?:[.-][a-z0-9]+)*"

#: Notice texts of common licences.
TEMPLATES = {
    "MIT": ("Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.", "You may not use this file except in compliance with the Apache License."),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3.", "either version 3 of the GNU General Public License, or any later version."),
    "GPL-2.0": ("This program is free software under the GNU General Public License, version 2.",),
    "LGPL-3.0": ("Licensed under the GNU Lesser General Public License, version 3.",),
    "AGPL-3.0": ("Licensed under the GNU Affero General Public License, version 3.",),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",),
    "BSD-3-Clause": ("Redistribution and use in source and binary forms, with or without modification, are permitted.", "Released under the BSD 3-Clause License."),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.",),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC0-1.0": ("Released to the public domain under CC0 1.0 Universal.",),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
}

RUNS = (2, 3, 4)

LICENCE_FILE = r"(?i)(^|/)(licen[cs]e|copying|notice)[^/]*$"


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def template_terms(templates: dict[str, tuple[str, ...]]) -> list[tuple[int, str, str, float]]:
    """(number of the notice, licence, term, damped term frequency), in order."""
    notices = [(name, text) for name, texts in templates.items() for text in texts]
    out = []
    for k, (name, text) in enumerate(notices):
        found = re.findall(TOKEN, text.lower())
        out += [(k, name, t, 1 + math.log(found.count(t))) for t in sorted(set(found))]
    return out


def weights(terms: list[tuple[int, str, str, float]], idf: dict[str, float], threshold: float) -> tuple[list[tuple[int, str, str, float]], list[str]]:
    """Notices' unit vectors, and the terms without which no notice reaches the threshold."""
    length: dict[int, float] = {}
    for k, _, t, tf in terms:
        length[k] = length.get(k, 0.0) + (tf * idf[t]) ** 2
    vectors = [(k, name, t, tf * idf[t] / math.sqrt(length[k])) for k, name, t, tf in terms]
    needed: set[str] = set()
    for k in length:
        rest = 1.0
        for w, t in sorted(((w, t) for j, _, t, w in vectors if j == k), reverse=True):
            if math.sqrt(max(rest, 0.0)) < threshold - 1e-9:
                break
            needed.add(t)
            rest -= w * w
    return vectors, sorted(needed)


def passages(files: DataFrame, whole: DataFrame, vocabulary: list[str], needed: list[str], lengths: list[int]) -> DataFrame:
    """(path, h, line, kind, at, ts): passages of more or less than a line that hold a needed term.

    ``line`` is that of the first template term, ``ts`` are the template terms inside.
    kind r > 1: r consecutive lines from line ``at``; kind -n: n tokens from token ``at``;
    kind 0: the whole text of a file (path, h) of ``whole``.
    """
    likely = F.arrays_overlap("ts", F.array(*[F.lit(t) for t in needed]))
    # one row per different (path, text); line ends are kept as items to count them
    texts = files.select("path", "h", F.regexp_extract_all(F.lower("text"), F.lit(rf"\n|{TOKEN}"), F.lit(0)).alias("ts")).where(likely).dropDuplicates(["path", "h"])
    items = texts.select("path", "h", F.posexplode("ts").alias("p", "term")).where(F.col("term").isin("\n", *vocabulary))
    w = Window.partitionBy("path", "h")
    placed = items.withColumn("line", F.count_if(F.col("term") == "\n").over(w.orderBy("p").rowsBetween(Window.unboundedPreceding, 0)).cast("int")).where(F.col("term") != "\n").withColumn("q", F.col("p") - F.col("line"))
    placed = write_table(placed.select("path", "h", "q", "line", "term"), "license-terms").df()

    runs = placed.select("path", "h", "line", "term", F.explode(F.array(*[F.struct(F.lit(r).alias("kind"), (F.col("line") - j).alias("at")) for r in RUNS for j in range(r)])).alias("x"))
    runs = runs.groupBy("path", "h", "x.kind", "x.at").agg(F.min("line").alias("line"), F.collect_list("term").alias("ts"))
    by_length = placed.select("path", "h", "line", F.col("q").alias("at"), F.array(*[F.struct(F.lit(-n).alias("kind"), F.collect_list("term").over(w.orderBy("q").rangeBetween(0, n - 1)).alias("ts")) for n in lengths]).alias("xs"))
    windows = by_length.select("path", "h", "line", "at", F.inline("xs"))
    entire = placed.join(whole, ["path", "h"], "left_semi").groupBy("path", "h").agg(F.min("line").alias("line"), F.collect_list("term").alias("ts")).withColumns({"kind": F.lit(0), "at": F.lit(0)})
    columns = ["path", "h", "line", "kind", "at", "ts"]
    return runs.select(columns).unionByName(windows.select(columns)).unionByName(entire.select(columns)).where(likely)


def scan(files: DataFrame, *, path: str = "path", text: str = "text", carry: tuple[str, ...] = (), licence_file: str | None = None, templates: dict[str, tuple[str, ...]] = TEMPLATES, threshold: float = 0.8) -> DataFrame:
    """One row per file: path, license, score, origin, from_dir, line (of its notice), and
    the columns ``carry`` of the file as they are.

    origin is 'notice' (its own best passage; ties: the first line, then single lines
    before other passages, then the order of the templates), 'inherited' (from the nearest ancestor directory with a licence
    file; from_dir names it) or 'none'. ``licence_file``: SQL condition on ``path``
    and ``n_tokens`` for further licence files beside those so named. A directory
    with several licences takes the most frequent, then the better scored, then the
    first by name. Null texts have no notice, null paths count as the root's;
    repeated rows are answered alike; an empty table gives an empty result.
    """
    spark = files.sparkSession
    kept = [f"__carry_{k}" for k in range(len(carry))]
    docs = project(files, path=path, text=text, **dict(zip(kept, carry))).select(F.coalesce("path", F.lit("")).alias("path"), "text", *kept).withColumn("h", F.xxhash64("text"))
    terms = template_terms(templates)
    vocabulary = spark.createDataFrame([(t,) for t in sorted({t for _, _, t, _ in terms})], "term string")
    # one row per template term, a fixed number
    seen = docs.select(F.explode(F.array_distinct(tokens(F.col("text")))).alias("term")).join(F.broadcast(vocabulary), "term").groupBy("term").agg(F.count("*").alias("df"))
    df = {r["term"]: r["df"] for r in seen.collect()}
    n = docs.count()
    idf = {t: math.log((1 + n) / (1 + df.get(t, 0))) + 1 for _, _, t, _ in terms}
    vectors, needed = weights(terms, idf, threshold)
    table = spark.createDataFrame([(k, name, t, w, idf[t]) for k, name, t, w in vectors], "notice int, license string, term string, w double, idf double")
    in_vocabulary = spark.createDataFrame(list(idf.items()), "term string, idf double")

    named = F.col("path").rlike(LICENCE_FILE)
    if licence_file:
        with_size = docs.select("path", "h", F.size(tokens(F.coalesce("text", F.lit("")))).alias("n_tokens"))
        named = named | F.expr(licence_file)
    else:
        with_size = docs.select("path", "h")
    licence_files = write_table(with_size.where(named).select("path", "h").distinct(), "license-files").df()

    lines = docs.select("path", "h", F.posexplode(F.split("text", "\n")).alias("line", "content")).select("path", "h", "line", F.lit(1).alias("kind"), F.col("line").alias("at"), tokens(F.col("content")).alias("ts"))
    likely = lines.where(F.arrays_overlap("ts", F.array(*[F.lit(t) for t in needed])))
    lengths = sorted({len(re.findall(TOKEN, text.lower())) for texts in templates.values() for text in texts})
    passage = ["path", "h", "line", "kind", "at"]
    parts = likely.unionByName(passages(docs, licence_files, sorted(idf), needed, lengths))
    counted = parts.select(*passage, F.explode("ts").alias("term")).join(F.broadcast(in_vocabulary), "term").groupBy(*passage, "term", "idf").agg((1 + F.log(F.count("*").cast("double"))).alias("tf"))
    by_part = counted.groupBy(*passage).agg(F.collect_list(F.struct("term", (F.col("tf") * F.col("idf")).alias("x"))).alias("xs"))
    # a passage holds at most one entry per template term
    sized = by_part.withColumn("len", F.expr("sqrt(aggregate(xs, 0D, (a, e) -> a + e.x * e.x))"))
    matched = sized.select(*passage, "len", F.inline("xs")).join(F.broadcast(table), "term").groupBy(*passage, "len", "notice", "license").agg((F.sum(F.col("x") * F.col("w")) / F.col("len")).alias("score"))
    good = matched.withColumn("score", F.round("score", 6)).where(F.col("score") >= threshold)
    best = good.groupBy("path", "h").agg(F.min_by(F.struct("license", "score", "line"), F.struct((-F.col("score")).alias("a"), F.col("line").alias("b"), (F.col("kind") != 1).alias("c"), F.col("notice").alias("d"))).alias("m"))
    own = write_table(best.select("path", "h", "m.license", "m.score", "m.line"), "license-notices").df()

    directory = F.when(F.instr("path", "/") > 0, F.regexp_replace("path", "/[^/]*$", "")).otherwise(F.lit(""))
    marks = own.withColumnsRenamed({"path": "o_path", "h": "o_h"})
    givers = own.join(licence_files, ["path", "h"]).withColumn("dir", directory)
    per_dir = givers.groupBy("dir", "license").agg(F.count("*").alias("n"), F.max("score").alias("s"))
    given = per_dir.groupBy("dir").agg(F.min_by("license", F.struct((-F.col("n")).alias("a"), (-F.col("s")).alias("b"), F.col("license").alias("c"))).alias("given"))
    files_ = docs.select("path", "h", *kept).withColumn("dir", directory)
    # ancestors of each distinct directory: itself, its parents, the root
    ancestors = files_.select("dir").distinct().withColumn("steps", F.when(F.col("dir") == "", F.array().cast("array<string>")).otherwise(F.split("dir", "/")))
    ancestors = ancestors.select("dir", F.explode(F.expr("sequence(0, size(steps))")).alias("depth"), "steps").select("dir", "depth", F.expr("array_join(slice(steps, 1, depth), '/')").alias("up"))
    nearest = ancestors.join(given.withColumnRenamed("dir", "g_dir"), F.col("up") == F.col("g_dir")).groupBy("dir").agg(F.max_by(F.struct("given", F.col("up").alias("from_dir")), "depth").alias("g")).select(F.col("dir").alias("n_dir"), "g.given", "g.from_dir")
    answered = files_.join(marks, (F.col("path") == F.col("o_path")) & F.col("h").eqNullSafe(F.col("o_h")), "left").join(nearest, F.col("dir") == F.col("n_dir"), "left")
    mine = F.col("license").isNotNull()
    return answered.select(
        "path",
        F.coalesce("license", "given").alias("license"),
        "score",
        F.when(mine, "notice").when(F.col("given").isNotNull(), "inherited").otherwise("none").alias("origin"),
        F.when(~mine, F.col("from_dir")).alias("from_dir"),
        F.col("line").cast("int").alias("line"),
        *[F.col(k).alias(c) for k, c in zip(kept, carry)],
    )
