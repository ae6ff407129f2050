"""Catalogue of units (files, movements) and works from heterogeneous sources: readers, dates,
composers, duplicates. Collections are described by tables, not by code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stavework.functions import catalog as cat
from stavework.operators.curves import components
from stavework.sources.tables import merged

DATE_FIELDS = ("year_start", "year_end", "composition_year", "year_source", "year_certainty", "period", "period_source")
UNIT_COLUMNS = ("unit_id", "work_id", "collection", "composer", "composer_id", "title", "movement", *DATE_FIELDS, "format", "path", "license", "catalog_key", "is_target", "in_analysis")
#: Priorities of collections (the first whose name begins the collection's), and of MuseData editions.
PRIORITY = (("dcml", 0), ("musedata", 1), ("kern", 2), ("s3", 3), ("openscore", 4))
EDITIONS = ("md2", "stage2", "stage2s", "stage1")


def as_units(rows: DataFrame, **columns: Column) -> DataFrame:
    """Rows with all columns of a unit; those not given are null, flags 0 and 1."""
    fixed = {"is_target": F.lit(0), "in_analysis": F.lit(1)}
    kinds = {"year_start": "int", "year_end": "int", "composition_year": "int", "is_target": "int", "in_analysis": "int"}
    have = lambda c: columns.get(c, fixed.get(c, F.col(c) if c in rows.columns else F.lit(None)))
    return rows.select(*[have(c).cast(kinds.get(c, "string")).alias(c) for c in UNIT_COLUMNS])


def stem(path: Column) -> Column:
    return F.regexp_replace(F.substring_index(path, "/", -1), r"\.[^.]*$", "")


def first_dated(candidates: list[Column]) -> Column:
    return F.coalesce(*candidates)


def text_date(text: Column, source: str, kind: str | None = None) -> Column:
    """The date fields of the years in a text; null where it names none."""
    ys = cat.years(text)
    lo, hi = F.array_min(ys), F.array_max(ys)
    return cat.dated(lo, hi, F.lit(source), F.lit(kind) if kind else cat.certainty(text, lo, hi))


def kern_units(files: DataFrame, refs: DataFrame, repos: DataFrame) -> DataFrame:
    """Units of Humdrum files.

    ``files``: path (collection folder/.../stem.krn); ``refs``: file, key, value (reference
    records); ``repos``: repo, license, composer, and how its files are read: pattern (over the
    stem, with three groups {1} {2} {3}, empty ones included), work, movement, key (templates over these
    groups, the records and {stem}). A stem the pattern does not match is its own work. Dates: composed, first
    performed, then published (approximate).
    """
    named = files.select("path", F.regexp_extract("path", r"(?:^|/)([^/]+)/[^/]+$", 1).alias("repo"), stem(F.col("path")).alias("stem"))
    records = refs.groupBy(F.col("file").alias("path")).agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("r"))
    rows = named.join(F.broadcast(repos), "repo").join(records, "path", "left")
    ref = lambda k: F.try_element_at("r", F.lit(k))
    hit = F.expr("regexp_like(stem, pattern)")
    values = {str(k): F.when(hit, F.expr(f"regexp_extract(stem, pattern, {k})")) for k in (1, 2, 3)} | {k: ref(k) for k in ("OPS", "ONM", "SCT", "OTL")} | {"stem": F.col("stem")}
    work = F.when(hit, cat.filled(F.col("work"), values)).otherwise(F.col("stem"))
    rows = rows.withColumn("w", work).withColumn("movement", F.when(hit, cat.filled(F.col("movement"), values)).otherwise(""))
    rows = rows.withColumn("work_id", F.concat(F.lit("kern-"), "repo", F.lit("-"), "w")).withColumn("date", first_dated([text_date(ref("ODT"), "kern_ODT"), text_date(ref("MPD"), "kern_MPD"), text_date(ref("PDT"), "kern_PDT_publication", "approx")]))
    return as_units(
        rows, unit_id=F.concat("work_id", F.lit("--"), "stem"), collection=F.concat(F.lit("kern/"), "repo"), composer_id=cat.composer_id(F.col("composer")), title=F.coalesce(F.when(ref("OTL") != "", ref("OTL")), F.col("stem")),
        format=F.lit("kern"), catalog_key=cat.catalog_key(cat.filled(F.col("key"), values)), **{c: F.col(f"date.{c}") for c in DATE_FIELDS},
    )


def dcml_units(metadata: DataFrame, notes: DataFrame, collection: str, license: str = "CC BY-NC-SA 4.0") -> DataFrame:
    """Units of a metadata table (piece, composer, work_number, work_title, movement_number,
    composed_start, composed_end) that have a note table: ``notes`` lists piece, path.

    A work is a work number with movements, else the piece itself. A lone end is a date before
    which (approximate); open ends ('..') are no dates.
    """
    digits = lambda c: F.when(F.col(c).rlike(r"^\d+$"), F.col(c).cast("int"))
    lo, hi = digits("composed_start"), F.coalesce(digits("composed_end"), digits("composed_start"))
    kind = F.when(lo.isNull(), "approx").when(lo == hi, "exact").otherwise("range")
    text = lambda c: F.when(F.trim(c) != "", F.trim(c))
    number, title, movement = text("work_number"), text("work_title"), text("movement_number")
    parted = number.isNotNull() & movement.isNotNull()
    rows = metadata.join(notes.select("piece", "path").dropDuplicates(["piece"]), "piece")
    rows = rows.withColumn("cid", cat.composer_id(F.col("composer"))).withColumn("w", F.when(parted, cat.slug(number, 30)).otherwise(cat.slug(F.col("piece"), 40)))
    rows = rows.withColumn("work_id", F.concat(F.lit(collection.replace("/", "-") + "-"), "w")).withColumn("date", cat.dated(F.coalesce(lo, hi), hi, F.lit("dcml_metadata"), kind))
    return as_units(
        rows, unit_id=F.concat("work_id", F.lit("--"), cat.slug(F.col("piece"), 50)), collection=F.lit(collection), composer_id=F.col("cid"), title=F.coalesce(title, F.when(parted, number), F.col("piece")), movement=F.when(parted, movement).otherwise(F.col("piece")),
        format=F.lit("dcml_tsv"), license=F.lit(license), catalog_key=F.when(parted, cat.catalog_key(number, F.col("cid"))).otherwise(cat.catalog_key(F.coalesce(number, title, F.col("piece")))), **{c: F.col(f"date.{c}") for c in DATE_FIELDS},
    )


def openscore_units(scores: DataFrame, sets: DataFrame, composers: DataFrame, files: DataFrame, collection: str, prefix: str, targets: tuple[str, ...] = ()) -> DataFrame:
    """Units of scores (id, set_id, name, path) that have a file: ``files`` lists paths whose name ends
    in the id. Sets (id, name, composer_id) and composers (id, name, born, died) may lack rows:
    the composer is then the first folder of the path. Columns born and died are added.
    """
    found = files.select(F.regexp_extract("path", r"(\d+)\.mxl$", 1).alias("f_id"), F.col("path").alias("file")).where("f_id <> ''").groupBy("f_id").agg(F.max("file").alias("file"))
    counted = scores.withColumn("per_set", F.count("*").over(Window.partitionBy("set_id")))
    rows = counted.join(found, F.col("id") == F.col("f_id")).join(sets.select(F.col("id").alias("s_id"), F.col("name").alias("set_name"), "composer_id"), F.col("set_id") == F.col("s_id"), "left")
    rows = rows.join(composers.select(F.col("id").alias("c_id"), F.col("name").alias("c_name"), "born", "died"), F.col("composer_id") == F.col("c_id"), "left").drop("composer_id")
    rows = rows.withColumn("composer", F.coalesce("c_name", F.translate(F.substring_index("path", "/", 1), "_", " "))).withColumn("work_id", F.concat(F.lit(f"{prefix}-"), "set_id")).withColumn("cid", cat.composer_id(F.col("composer")))
    key = cat.catalog_key(F.concat(F.coalesce("set_name", F.lit("")), F.lit(" "), "path"), F.col("cid"))
    target = F.col("set_id").isin(*targets).cast("int") if targets else F.lit(0)
    units = as_units(
        rows.withColumn("__key", key), unit_id=F.concat(F.lit(f"{prefix}-"), "id"), collection=F.lit(collection), composer_id=F.col("cid"), title=F.coalesce("set_name", "name"), movement=F.when(F.col("per_set") > 1, F.col("name")).otherwise("all"),
        format=F.lit("musicxml_mxl"), path=F.col("file"), license=F.lit("CC0-1.0"), catalog_key=F.col("__key"), is_target=target,
    )
    return units


def directory_units(files: DataFrame, works: DataFrame, collection: str, license: str, name: str = "sheet.xml") -> DataFrame:
    """Units of folders that hold a file ``name``; the first letters of the folder are the key into
    ``works`` (key, composer, title, number), the rest the movement."""
    folders = files.where(F.substring_index("path", "/", -1) == name).select("path", F.element_at(F.split("path", "/"), -2).alias("folder"))
    rows = folders.join(F.broadcast(works), F.expr("startswith(folder, key)"))
    return as_units(rows, unit_id=F.concat(F.lit(f"{collection}-"), "folder"), work_id=F.concat(F.lit(f"{collection}-"), "key"), collection=F.lit(collection), composer_id=cat.composer_id(F.col("composer")), movement=F.expr("substr(folder, length(key) + 1)"), format=F.lit("musicxml"), license=F.lit(license), catalog_key=cat.catalog_key(F.col("number")))


def musedata_units(files: DataFrame, headers: DataFrame, composer: str, collection: str, license: str = "academic use") -> DataFrame:
    """Units of MuseData folders: of each work folder only the best edition there is.

    ``files``: paths work/.../editions/public/score/name.md2, work/stage2/01 (parts of a single
    movement) or work/stage2/movement/01; ``headers``: file, wk, l2 (title), l3 (movement) of
    their first part. Folders ending in .tst, .old or .bak and those of version control are
    passed over; a stage 1 file's header is not read.
    """
    paths = files.where(~F.col("path").rlike(r"(^|/)\.git/|\.(tst|old|bak)/")).select("path")
    scores = paths.select("path", F.regexp_extract("path", r"^(.*)/editions/public/score/([^/]+)\.md2$", 1).alias("work"), F.regexp_extract("path", r"([^/]+)\.md2$", 1).alias("mov"), F.lit("md2").alias("edition")).where("work <> ''").withColumn("unit", F.col("path"))
    staged = r"^(.*)/(stage2s?|stage1)/(?:([^/]+)/)?(\d+)$"
    parts = paths.select("path", F.regexp_extract("path", staged, 1).alias("work"), F.regexp_extract("path", staged, 2).alias("edition"), F.regexp_extract("path", staged, 3).alias("mov")).where("work <> ''")
    parts = parts.groupBy("work", "edition", "mov").agg(F.min("path").alias("path")).select("path", "work", F.when(F.col("mov") == "", "1").otherwise(F.col("mov")).alias("mov"), "edition", F.regexp_replace("path", "/[^/]*$", "").alias("unit"))
    both = scores.select(parts.columns).unionByName(parts).withColumn("rank", F.array_position(F.array(*map(F.lit, EDITIONS)), F.col("edition")))
    best = both.groupBy("work").agg(F.min("rank").alias("best"))
    rows = both.join(merged(best), "work").where("rank = best").join(merged(headers.select(F.col("file").alias("path"), "wk", "l2", "l3")), "path", "left")
    read = F.col("edition") != "stage1"
    rows = rows.select("work", "mov", "unit", "edition", *[F.when(read, F.trim(F.coalesce(c, F.lit("")))).otherwise("").alias(a) for c, a in (("wk", "wk"), ("l2", "title"), ("l3", "mov_title"))])
    first = rows.groupBy("work").agg(F.min_by(F.struct("title", "wk"), "mov").alias("h"))
    rows = rows.drop("title", "wk").join(merged(first), "work").withColumn("title", F.when(F.col("h.title") != "", F.col("h.title")).otherwise(F.replace("work", F.lit("/"), F.lit(" / "))))
    rows = rows.withColumn("work_id", F.concat(F.lit(f"{collection}-"), F.replace("work", F.lit("/"), F.lit("-")))).withColumn("composer", F.lit(composer))
    return as_units(
        rows, unit_id=F.concat("work_id", F.lit("--"), "mov"), collection=F.lit(collection), composer_id=cat.composer_id(F.col("composer")), movement=F.trim(F.concat("mov", F.lit(" "), "mov_title")), format=F.concat(F.lit("musedata_"), F.regexp_replace("edition", "s$", "")),
        path=F.col("unit"), license=F.lit(license), catalog_key=cat.catalog_key(F.concat_ws(" ", F.substring_index("work", "/", -1), "title", "h.wk")),
    )


def composer_registry(mentions: DataFrame, known: DataFrame) -> DataFrame:
    """(composer_id, name, born, died, n_units, sources) of all mentions.

    ``mentions``: seq (their order), name, born, died, source; ``known``: composer_id, name, born,
    died, which win. Else the first year named counts, and the first name, or the last one
    without a comma after a first one with it.
    """
    m = mentions.withColumn("composer_id", cat.composer_id(F.col("name")))
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("seq")))
    plain = F.when(~F.contains("name", F.lit(",")), F.col("seq"))
    rows = m.groupBy("composer_id").agg(F.min_by("name", "seq").alias("first_name"), F.min_by("name", plain).alias("plain_name"), first("born").alias("m_born"), first("died").alias("m_died"), F.count("*").alias("n_units"), F.array_join(F.array_sort(F.collect_set("source")), ";").alias("sources"))
    k = known.select(F.col("composer_id").alias("k_id"), F.col("name").alias("k_name"), F.col("born").alias("k_born"), F.col("died").alias("k_died"))
    joined = rows.join(k, F.col("composer_id") == F.col("k_id"), "left")
    mine = F.when(F.contains("first_name", F.lit(",")), F.coalesce("plain_name", "first_name")).otherwise(F.col("first_name"))
    return joined.select("composer_id", F.coalesce("k_name", mine).alias("name"), F.coalesce("k_born", "m_born").cast("int").alias("born"), F.coalesce("k_died", "m_died").cast("int").alias("died"), "n_units", "sources")


def finalize_dates(units: DataFrame, manual: DataFrame, composers: DataFrame) -> DataFrame:
    """Units without a date take the work's manual one (work_id, year_start, year_end,
    year_certainty as text), then their composer's active years, then none."""
    hi = cat.tolerant_year(F.col("year_end"))
    lo = F.coalesce(cat.tolerant_year(F.col("year_start")), hi)
    said = F.lower(F.trim(F.col("year_certainty")))
    kind = F.when(said.isin("exact", "approx", "range"), said).when(lo == hi, "exact").otherwise("range")
    by_hand = manual.dropDuplicates(["work_id"]).select("work_id", cat.dated(lo, hi, F.lit("manual"), kind).alias("__manual"))
    lives = composers.select("composer_id", cat.active_span(F.col("born"), F.col("died")).alias("__life"))
    own = F.when(F.col("year_source").isNotNull(), F.struct(*[F.col(c) for c in DATE_FIELDS]))
    rows = units.join(by_hand, "work_id", "left").join(F.broadcast(lives), "composer_id", "left").withColumn("__date", F.coalesce(own, "__manual", "__life", cat.no_date()))
    return rows.select(*[F.col(f"__date.{c}").alias(c) if c in DATE_FIELDS else F.col(c) for c in units.columns])


def manual_template(units: DataFrame, existing: DataFrame, skipped: tuple[str, ...] = ("openscore_lieder", "m21_bach", "dcml")) -> DataFrame:
    """One row per work to be dated by hand; what was filled in before is kept, rows of other
    works too."""
    open_ = units.where(F.col("year_source").isin("missing", "composer_lifespan"))
    for prefix in skipped:
        open_ = open_.where(~F.startswith("collection", F.lit(prefix)))
    works = open_.groupBy("work_id").agg(F.min_by(F.struct("collection", "composer", "title", "catalog_key"), "unit_id").alias("f"), F.count("*").cast("string").alias("n_units")).select("work_id", "f.*", "n_units")
    old = existing.select(*[F.col(c).alias(f"o_{c}") for c in existing.columns])
    both = works.join(old, F.col("work_id") == F.col("o_work_id"), "full_outer")
    new = F.col("o_work_id").isNull()
    year = lambda c: F.coalesce(cat.tolerant_year(F.col(c)).cast("string"), F.lit(""))
    kept = {"year_start": year("o_year_start"), "year_end": year("o_year_end")}
    filled = [F.when(new, "").when(F.col("work_id").isNull(), F.col(f"o_{c}")).otherwise(kept.get(c, F.coalesce(f"o_{c}", F.lit("")))).alias(c) for c in ("year_start", "year_end", "year_certainty", "source", "note")]
    return both.select(F.coalesce("work_id", "o_work_id").alias("work_id"), *[F.coalesce(c, f"o_{c}").alias(c) for c in ("collection", "composer", "title", "catalog_key", "n_units")], *filled)


def priority(collection: Column, order: tuple[tuple[str, int], ...] = PRIORITY) -> Column:
    out = F.lit(5)
    for name, rank in reversed(order):
        out = F.when(F.startswith(collection, F.lit(name)), rank).otherwise(out)
    return out


def key_duplicates(units: DataFrame) -> DataFrame:
    """Units with duplicate_group and is_primary: works of one composer and catalogue key are
    copies, the primary one is of the best collection, then the first path. A work under
    several keys follows the last of its groups by name."""
    works = units.groupBy("work_id").agg(F.min(F.struct(priority(F.col("collection")).alias("p"), "path")).alias("prio"))
    members = units.where("catalog_key <> '' and in_analysis = 1").select("composer_id", "catalog_key", "work_id").distinct().join(works, "work_id")
    groups = members.groupBy("composer_id", "catalog_key").agg(F.min_by("work_id", F.struct("prio", "work_id")).alias("first"), F.count("*").alias("k")).where("k > 1")
    marked = members.join(groups, ["composer_id", "catalog_key"]).select("work_id", F.concat("composer_id", F.lit(":"), "catalog_key").alias("g"), (F.col("work_id") == F.col("first")).cast("int").alias("prim"))
    one = marked.groupBy("work_id").agg(F.max_by("prim", "g").alias("prim"), F.max("g").alias("g"))
    return units.join(one, "work_id", "left").select(*units.columns, F.coalesce("g", F.lit("")).alias("duplicate_group"), F.coalesce("prim", F.lit(1)).alias("is_primary"))


def sequence_duplicates(works: DataFrame, pairs: DataFrame) -> DataFrame:
    """(work_id, primary_work, is_primary) of groups of works that hold each other's sequences.

    ``works``: work_id, collection, path, notes; ``pairs``: a, b (see ``curves.containment_pairs``).
    Pairs within one DCML collection are no copies; the primary work is of the best
    collection, then has most notes, then the first path.
    """
    side = lambda k: works.select(F.col("work_id").alias(k), F.col("collection").alias(f"c{k}"))
    kept = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").where(~((F.col("ca") == F.col("cb")) & F.startswith("ca", F.lit("dcml"))))
    groups = components(kept).join(works, "work_id").withColumn("prio", F.struct(priority(F.col("collection")).alias("p"), (-F.col("notes")).alias("n"), F.col("path").alias("path"), F.col("work_id").alias("w")))
    first = groups.groupBy("component").agg(F.min_by("work_id", "prio").alias("primary_work"))
    return groups.join(first, "component").select("work_id", "primary_work", (F.col("work_id") == F.col("primary_work")).cast("int").alias("is_primary"))


def merge_duplicates(units: DataFrame, groups: DataFrame) -> DataFrame:
    """Units after sequence dedup: the group's name is added, its verdict wins."""
    g = groups.withColumnsRenamed({"is_primary": "__p", "primary_work": "__w"})
    name = F.when(F.col("__w").isNotNull(), F.concat(F.when(F.col("duplicate_group") != "", F.concat("duplicate_group", F.lit(";"))).otherwise(""), F.lit("seq:"), F.col("__w").cast("string"))).otherwise(F.col("duplicate_group"))
    return units.join(g, "work_id", "left").select(*[c for c in units.columns if c not in ("duplicate_group", "is_primary")], name.alias("duplicate_group"), F.coalesce("__p", "is_primary").alias("is_primary"))


def unique_units(units: DataFrame) -> DataFrame:
    """The units as they are; the job fails if an id stands twice."""
    twice = units.groupBy("unit_id").agg(F.count("*").alias("__n"))
    checked = units.join(twice, "unit_id")
    return checked.where(F.when(F.col("__n") > 1, F.raise_error(F.concat(F.lit("unit twice: "), "unit_id"))).otherwise(F.lit(True))).select(*units.columns)


def date_summary(works: DataFrame) -> DataFrame:
    """(collection, undated, with_period, unknown) of the works that no source dates."""
    open_ = works.where(F.col("year_source").isin("missing", "composer_lifespan"))
    return open_.groupBy("collection").agg(F.count("*").alias("undated"), F.count_if(F.col("period") != "unknown").alias("with_period"), F.count_if(F.col("period") == "unknown").alias("unknown"))


def counters(units: DataFrame, by: list[str]) -> DataFrame:
    """(by, units, works) of every combination of ``by``, and of each subset of them from the left."""
    sets = [by[:k] for k in range(len(by) + 1)]
    grouped = units.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in by])
    return grouped.agg(F.count("*").alias("units"), F.countDistinct("work_id").alias("works"))


def units_by_works(units: DataFrame, row: str, column: str, values: list[str]) -> DataFrame:
    """(row, one column per value): 'units (works)' of a catalogue, 0 where there are none."""
    cells = units.groupBy(row, column).agg(F.count("*").alias("u"), F.countDistinct("work_id").alias("w"))
    shown = cells.select(row, column, F.concat(F.col("u").cast("string"), F.lit(" ("), F.col("w").cast("string"), F.lit(")")).alias("c"))
    wide = shown.groupBy(row).pivot(column, values).agg(F.first("c"))
    return wide.select(row, *[F.coalesce(F.col(f"`{v}`"), F.lit("0 (0)")).alias(v) for v in values])


def resolved(path: Column, root: str, schemes: dict[str, str]) -> Column:
    """A catalogue path as a full one: its scheme's folder, or the root."""
    out = F.concat(F.lit(root.rstrip("/") + "/"), path)
    for scheme, folder in schemes.items():
        out = F.when(F.startswith(path, F.lit(scheme + ":")), F.concat(F.lit(folder.rstrip("/") + "/"), F.substring(path, len(scheme) + 2, 10_000))).otherwise(out)
    return out
