"""Catalogue queries: tables of the driver read as score collections, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from stavework.functions import catalog as cat
from stavework.operators import catalogue as units
from stavework.operators import curves
from stavework.plans.queries import _grams, _grams_sql, query
from stavework.sources import files
from stavework.sources.notes import table
from stavework.sources.tables import load_catalog

_PERIOD = "CASE WHEN {0} <= 1749 THEN '<1750' WHEN {0} <= 1799 THEN '1750–1800' WHEN {0} <= 1829 THEN '1800–1830' WHEN {0} <= 1899 THEN '1830–1900' WHEN {0} > 1899 THEN '>1900' ELSE 'unknown' END"

# -- Humdrum files: one per part, two collections ---------------------------------------------
_KERN = """k0 AS (SELECT p_partkey AS i, p_size AS z, p_name AS t, CASE WHEN p_size % 2 = 0 THEN 'even' ELSE 'odd' END AS repo,
  CASE WHEN p_partkey % 2 = 0 THEN 'op' || p_size || 'n' || p_partkey || '-' || (p_partkey % 4 + 1) ELSE 'piece' || p_partkey END AS stem, 1700 + p_partkey % 150 AS y FROM part)"""


def _kern(spark, sf_dir):
    i, z = F.col("p_partkey"), F.col("p_size")
    name = F.when(i % 2 == 0, F.concat(F.lit("op"), z, F.lit("n"), i, F.lit("-"), i % 4 + 1)).otherwise(F.concat(F.lit("piece"), i))
    path = F.concat(F.lit("raw/"), F.when(z % 2 == 0, "even").otherwise("odd"), F.lit("/"), name, F.lit(".krn"))
    y = 1700 + i % 150
    third = F.when(i % 3 == 0, F.concat(F.lit("!!!ODT: "), y, F.lit("///-"), y + z % 3, F.lit("///"))).when(i % 3 == 1, F.concat(F.lit("!!!PDT: ~"), y)).otherwise("!! no date")
    rows = table(spark, sf_dir, "part").select(path.alias("file"), F.posexplode(F.array(F.concat(F.lit("!!!OTL: "), "p_name"), F.concat(F.lit("!!!OPS: "), z), third, F.lit("!!!OTL: second title"), F.lit("**kern"))).alias("line_no", "value"))
    repos = spark.createDataFrame(
        [("even", "CC BY-SA 4.0", "Haydn, Joseph", r"^(op\d+n\d+)-(\d+)()$", "{1}", "{2}", "op.{OPS}"), ("odd", "none", "Scott Joplin", r"^(piece)(\d+)()$", "p-{2}", "{OPS}", "{stem} K.{2}")],
        "repo string, license string, composer string, pattern string, work string, movement string, key string",
    )
    return units.kern_units(rows.select(F.col("file").alias("path")).distinct(), files.reference_records(rows), repos)


_KERN_UNITS = f"""{_KERN}, kern AS (SELECT 'kern-' || repo || '-' || CASE WHEN repo = 'even' AND i % 2 = 0 THEN 'op' || z || 'n' || i WHEN repo = 'odd' AND i % 2 = 1 THEN 'p-' || i ELSE stem END AS work_id, stem, repo, CASE WHEN repo = 'even' THEN 'haydn_fj' ELSE 'joplin_s' END AS composer_id, t AS title,
  CASE WHEN repo = 'even' THEN CASE WHEN i % 2 = 0 THEN (i % 4 + 1)::VARCHAR ELSE '' END ELSE CASE WHEN i % 2 = 1 THEN z::VARCHAR ELSE '' END END AS movement,
  CASE WHEN repo = 'even' THEN 'op' || z WHEN i % 2 = 1 THEN 'k' || i ELSE 'op' || z || '/' || i END AS catalog_key,
  CASE i % 3 WHEN 0 THEN y + CASE z % 3 WHEN 0 THEN 0 WHEN 1 THEN CASE WHEN y % 2 = 0 THEN 0 ELSE 1 END ELSE 1 END WHEN 1 THEN y END AS composition_year,
  CASE i % 3 WHEN 0 THEN 'kern_ODT' WHEN 1 THEN 'kern_PDT_publication' END AS year_source, CASE i % 3 WHEN 0 THEN CASE WHEN z % 3 = 0 THEN 'exact' ELSE 'range' END WHEN 1 THEN 'approx' END AS year_certainty, 'raw/' || repo || '/' || stem || '.krn' AS path FROM k0)"""


@query("kern_catalogue", f"WITH {_KERN_UNITS} SELECT work_id || '--' || stem AS unit_id, work_id, 'kern/' || repo AS collection, composer_id, title, movement, catalog_key, composition_year::INT AS composition_year, year_source, year_certainty, CASE WHEN composition_year IS NOT NULL THEN {_PERIOD.format('composition_year')} END AS period FROM kern")
def kern_catalogue(spark, sf_dir):
    return units.unique_units(_kern(spark, sf_dir)).select("unit_id", "work_id", "collection", "composer_id", "title", "movement", "catalog_key", "composition_year", "year_source", "year_certainty", "period")


# -- metadata tables: one piece per part -----------------------------------------------------------
def _dcml(spark, sf_dir):
    i, z = F.col("p_partkey"), F.col("p_size")
    y = 1750 + i % 60
    rows = table(spark, sf_dir, "part").select(
        F.concat(F.lit("K"), i + 300, F.lit("-"), i % 4 + 1).alias("piece"), F.lit("Wolfgang Amadeus Mozart").alias("composer"), F.when(z % 2 == 0, F.concat(F.lit("K. "), i + 300)).otherwise("").alias("work_number"), F.col("p_name").alias("work_title"),
        (i % 4 + 1).cast("string").alias("movement_number"), F.when(i % 3 == 0, y.cast("string")).when(i % 3 == 1, "..").otherwise("").alias("composed_start"), F.when(i % 3 < 2, (y + z % 2).cast("string")).otherwise("").alias("composed_end"),
    )
    notes = table(spark, sf_dir, "part").where(i % 5 != 0).select(F.concat(F.lit("K"), i + 300, F.lit("-"), i % 4 + 1).alias("piece"), F.concat(F.lit("dcml/m/notes/"), i, F.lit(".notes.tsv")).alias("path"))
    return units.dcml_units(rows, notes, "dcml/m")


_DCML_UNITS = """dcml AS (SELECT 'dcml-m-' || CASE WHEN p_size % 2 = 0 THEN 'k-' || (300 + p_partkey) ELSE 'k' || (300 + p_partkey) || '-' || (p_partkey % 4 + 1) END AS work_id, 'k' || (300 + p_partkey) || '-' || (p_partkey % 4 + 1) AS piece, p_name AS title,
  CASE WHEN p_size % 2 = 0 THEN (p_partkey % 4 + 1)::VARCHAR ELSE 'K' || (300 + p_partkey) || '-' || (p_partkey % 4 + 1) END AS movement, CASE WHEN p_size % 2 = 0 THEN 'k' || (300 + p_partkey) ELSE '' END AS catalog_key,
  CASE WHEN p_partkey % 3 = 0 THEN CASE WHEN p_size % 2 = 0 THEN 1750 + p_partkey % 60 ELSE CAST(round_even((2 * (1750 + p_partkey % 60) + 1) / 2, 0) AS INT) END WHEN p_partkey % 3 = 1 THEN 1750 + p_partkey % 60 + p_size % 2 END AS composition_year,
  CASE WHEN p_partkey % 3 = 0 THEN CASE WHEN p_size % 2 = 0 THEN 'exact' ELSE 'range' END WHEN p_partkey % 3 = 1 THEN 'approx' END AS year_certainty, 'dcml/m/notes/' || p_partkey || '.notes.tsv' AS path FROM part WHERE p_partkey % 5 <> 0)"""


@query("dcml_catalogue", f"WITH {_DCML_UNITS} SELECT work_id || '--' || piece AS unit_id, work_id, title, movement, catalog_key, composition_year, year_certainty, path FROM dcml")
def dcml_catalogue(spark, sf_dir):
    return _dcml(spark, sf_dir).select("unit_id", "work_id", "title", "movement", "catalog_key", "composition_year", "year_certainty", "path")


# -- scores with sets and composers: orders, customers, nations -------------------------------------
def _openscore(spark, sf_dir):
    o, c, n = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    key = F.col("o_orderkey").cast("string")
    scores = o.select(key.alias("id"), F.col("o_custkey").cast("string").alias("set_id"), F.concat(F.lit("No. "), F.col("o_orderkey") % 9).alias("name"), F.concat(F.lit("Doe,_Jane/"), key).alias("path"))
    sets = c.where("c_custkey % 4 <> 0").select(F.col("c_custkey").cast("string").alias("id"), F.concat("c_mktsegment", F.lit(" Op. "), "c_custkey").alias("name"), F.col("c_nationkey").cast("string").alias("composer_id"))
    composers = n.select(F.col("n_nationkey").cast("string").alias("id"), F.concat(F.lit("Nation"), F.translate(F.col("n_nationkey").cast("string"), "0123456789", "abcdefghij"), F.lit(", Anna")).alias("name"), (1700 + F.col("n_nationkey") * 6).alias("born"), (1760 + F.col("n_nationkey") * 6).alias("died"))
    found = o.where("o_orderkey % 7 <> 0").select(F.concat(F.lit("scores/x"), key, F.lit(".mxl")).alias("path"))
    return units.openscore_units(scores, sets, composers, found, "openscore_lieder", "osl", targets=("5",))


_OPEN_UNITS = """os AS (SELECT 'osl-' || o_orderkey AS unit_id, 'osl-' || o_custkey AS work_id, CASE WHEN c_custkey IS NULL THEN 'doe_j' ELSE 'nation' || translate(c_nationkey::VARCHAR, '0123456789', 'abcdefghij') || '_a' END AS composer_id, c_nationkey,
  coalesce(c_mktsegment || ' Op. ' || c_custkey, 'No. ' || (o_orderkey % 9)) AS title, CASE WHEN count(*) OVER (PARTITION BY o_custkey) > 1 THEN 'No. ' || (o_orderkey % 9) ELSE 'all' END AS movement, CASE WHEN c_custkey IS NULL THEN '' ELSE 'op' || c_custkey END AS catalog_key, CASE WHEN o_custkey = 5 THEN 1 ELSE 0 END AS is_target, o_orderkey
  FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 4 <> 0) ON c_custkey = o_custkey QUALIFY o_orderkey % 7 <> 0)"""


@query("openscore_catalogue", f"WITH {_OPEN_UNITS} SELECT unit_id, work_id, composer_id, title, movement, catalog_key, is_target FROM os")
def openscore_catalogue(spark, sf_dir):
    return _openscore(spark, sf_dir).select("unit_id", "work_id", "composer_id", "title", "movement", "catalog_key", "is_target")


# -- folders with editions: parts ----------------------------------------------------------------------
def _musedata(spark, sf_dir):
    i, e = F.col("p_partkey"), F.col("p_size") % 4
    work = F.concat(F.lit("w"), i)
    lists = F.when(e == 0, F.array(F.concat(work, F.lit("/editions/public/score/1.md2")), F.concat(work, F.lit("/stage2/01")))).when(e == 1, F.array(F.concat(work, F.lit("/stage2/01")), F.concat(work, F.lit("/stage2/02")), F.concat(work, F.lit("/stage1/01"))))
    lists = lists.when(e == 2, F.array(F.concat(work, F.lit("/stage2/a/01")), F.concat(work, F.lit("/stage2/b/02")), F.concat(work, F.lit("/stage2/b/03")), F.concat(work, F.lit(".old/stage2/01")))).otherwise(F.array(F.concat(work, F.lit("/stage1/01")), F.concat(work, F.lit("/.git/stage2/01"))))
    paths = table(spark, sf_dir, "part").select(F.col("p_name").alias("t"), i.alias("i"), F.explode(lists).alias("path"))
    lines = paths.select(F.col("path").alias("file"), F.posexplode(F.array(F.lit("head"), F.concat(F.lit("WK#:RV "), "i", F.lit("  MV#:1")), F.lit("edition"), F.col("t"), F.lit("Allegro"))).alias("line_no", "value"))
    return units.musedata_units(paths, files.work_headers(lines), "Antonio Vivaldi", "musedata_vivaldi")


@query(
    "musedata_catalogue",
    """WITH p AS (SELECT 'w' || p_partkey AS w, p_partkey AS i, p_name AS t, p_size % 4 AS e FROM part), u AS (SELECT *, unnest(CASE e WHEN 0 THEN ['1'] WHEN 1 THEN ['1'] WHEN 2 THEN ['a', 'b'] ELSE ['1'] END) AS mov FROM p)
SELECT 'musedata_vivaldi-' || w || '--' || mov AS unit_id, 'vivaldi_a' AS composer_id, CASE WHEN e = 3 THEN w ELSE t END AS title, CASE WHEN e = 3 THEN mov ELSE mov || ' Allegro' END AS movement, CASE e WHEN 0 THEN 'musedata_md2' WHEN 3 THEN 'musedata_stage1' ELSE 'musedata_stage2' END AS format,
  CASE e WHEN 0 THEN w || '/editions/public/score/1.md2' WHEN 1 THEN w || '/stage2' WHEN 2 THEN w || '/stage2/' || mov ELSE w || '/stage1' END AS path, CASE WHEN e = 3 THEN '' ELSE 'rv' || i END AS catalog_key FROM u""",
)
def musedata_catalogue(spark, sf_dir):
    return _musedata(spark, sf_dir).select("unit_id", "composer_id", "title", "movement", "format", "path", "catalog_key")


@query("directory_catalogue", "SELECT 's3-mo' || p_partkey AS unit_id, 's3-mo' AS work_id, 'mozart_wa' AS composer_id, p_partkey::VARCHAR AS movement, 'k551' AS catalog_key FROM part WHERE p_size % 2 = 0")
def directory_catalogue(spark, sf_dir):
    name = F.when(F.col("p_size") % 2 == 0, "sheet.xml").otherwise("notes.txt")
    found = table(spark, sf_dir, "part").select(F.concat(F.lit("set/mo"), "p_partkey", F.lit("/"), name).alias("path"))
    works = spark.createDataFrame([("mo", "Wolfgang Amadeus Mozart", "Symphony No. 41", "K.551")], "key string, composer string, title string, number string")
    return units.directory_units(found, works, "s3", "MIT").select("unit_id", "work_id", "composer_id", "movement", "catalog_key")


# -- composers, dates, duplicates -------------------------------------------------------------------------
def _mentions(spark, sf_dir):
    k = F.col("c_nationkey")
    letters = F.translate(k.cast("string"), "0123456789", "abcdefghij")
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("seq"), F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("Nation"), letters, F.lit(", Anna"))).otherwise(F.concat(F.lit("Anna Nation"), letters)).alias("name"), F.when(F.col("c_custkey") % 3 == 0, 1700 + F.col("c_custkey") % 50).alias("born"), F.when(F.col("c_custkey") % 5 == 0, 1780 + F.col("c_custkey") % 50).alias("died"), F.lower("c_mktsegment").alias("source"))


def _known(spark, sf_dir):
    k = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").where("n_nationkey < 5").select(F.concat(F.lit("nation"), F.translate(k.cast("string"), "0123456789", "abcdefghij"), F.lit("_a")).alias("composer_id"), F.concat(F.lit("Anna of "), "n_name").alias("name"), (1650 + k).alias("born"), (1720 + k).alias("died"))


_REGISTRY = """m AS (SELECT c_custkey AS seq, c_nationkey AS k, 'nation' || translate(c_nationkey::VARCHAR, '0123456789', 'abcdefghij') || '_a' AS composer_id, CASE WHEN c_custkey % 2 = 0 THEN 'Nation' || translate(c_nationkey::VARCHAR, '0123456789', 'abcdefghij') || ', Anna' ELSE 'Anna Nation' || translate(c_nationkey::VARCHAR, '0123456789', 'abcdefghij') END AS name,
  CASE WHEN c_custkey % 3 = 0 THEN 1700 + c_custkey % 50 END AS born, CASE WHEN c_custkey % 5 = 0 THEN 1780 + c_custkey % 50 END AS died, lower(c_mktsegment) AS source FROM customer),
reg AS (SELECT composer_id, CASE WHEN any_value(k) < 5 THEN 'Anna of NATION_' || any_value(k) WHEN arg_min(name, seq) LIKE '%,%' THEN coalesce(arg_min(name, seq) FILTER (name NOT LIKE '%,%'), arg_min(name, seq)) ELSE arg_min(name, seq) END AS name,
  CASE WHEN any_value(k) < 5 THEN 1650 + any_value(k) ELSE arg_min(born, seq) FILTER (born IS NOT NULL) END::INT AS born, CASE WHEN any_value(k) < 5 THEN 1720 + any_value(k) ELSE arg_min(died, seq) FILTER (died IS NOT NULL) END::INT AS died, count(*) AS n_units, string_agg(DISTINCT source, ';' ORDER BY source) AS sources FROM m GROUP BY composer_id)"""


@query("composer_registry", f"WITH {_REGISTRY} SELECT * FROM reg")
def composer_registry(spark, sf_dir):
    return units.composer_registry(_mentions(spark, sf_dir), _known(spark, sf_dir))


def _manual(spark, sf_dir):
    k = F.col("c_custkey")
    years = F.when(k % 3 == 0, F.concat((1750 + k % 100).cast("string"), F.lit(".0"))).when(k % 3 == 1, "").otherwise("soon")
    return table(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(F.concat(F.lit("osl-"), k).alias("work_id"), F.lit("openscore_lieder").alias("collection"), F.lit("").alias("composer"), F.col("c_name").alias("title"), F.lit("").alias("catalog_key"), F.lit("1").alias("n_units"), F.when(k % 9 == 0, F.concat((1745 + k % 100).cast("string"))).otherwise("").alias("year_start"), years.alias("year_end"), F.when(k % 4 == 0, " Approx ").otherwise("").alias("year_certainty"), F.lit("letters").alias("source"), F.lit("").alias("note"))


_DATED = f"""{_REGISTRY}, {_OPEN_UNITS},
man AS (SELECT 'osl-' || c_custkey AS work_id, c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN 1750 + c_custkey % 100 END AS hi, CASE WHEN c_custkey % 9 = 0 THEN 1745 + c_custkey % 100 WHEN c_custkey % 3 = 0 THEN 1750 + c_custkey % 100 END AS lo, CASE WHEN c_custkey % 4 = 0 THEN 'approx' WHEN c_custkey % 9 = 0 THEN 'range' ELSE 'exact' END AS kind FROM customer WHERE c_custkey % 2 = 0),
dt AS (SELECT unit_id, os.work_id, os.composer_id, title, os.catalog_key, CASE WHEN hi IS NOT NULL THEN lo WHEN born IS NOT NULL AND died IS NOT NULL THEN born + 15 END AS year_start, CASE WHEN hi IS NOT NULL THEN hi WHEN born IS NOT NULL AND died IS NOT NULL THEN died - 1 END AS year_end,
  CASE WHEN hi IS NOT NULL THEN CASE WHEN kind = 'range' THEN CAST(round_even((lo + hi) / 2, 0) AS INT) ELSE hi END END AS composition_year, CASE WHEN hi IS NOT NULL THEN 'manual' WHEN born IS NOT NULL AND died IS NOT NULL THEN 'composer_lifespan' ELSE 'missing' END AS year_source, CASE WHEN hi IS NOT NULL THEN kind WHEN born IS NOT NULL AND died IS NOT NULL THEN 'range' ELSE 'unknown' END AS year_certainty,
  CASE WHEN hi IS NOT NULL THEN {_PERIOD.format("CASE WHEN kind = 'range' THEN CAST(round_even((lo + hi) / 2, 0) AS INT) ELSE hi END")} WHEN born IS NULL OR died IS NULL THEN 'unknown' WHEN died - 1 <= 1749 THEN '<1750' WHEN born + 15 >= 1750 AND died - 1 <= 1799 THEN '1750–1800' WHEN born + 15 >= 1800 AND died - 1 <= 1829 THEN '1800–1830' WHEN born + 15 >= 1830 AND died - 1 <= 1899 THEN '1830–1900' WHEN born + 15 >= 1900 THEN '>1900' ELSE 'unknown' END AS period
  FROM os LEFT JOIN man USING (work_id) LEFT JOIN reg ON reg.composer_id = os.composer_id)"""


def _dated(spark, sf_dir):
    return units.finalize_dates(_openscore(spark, sf_dir), _manual(spark, sf_dir), composer_registry(spark, sf_dir))


@query("finalized_dates", f"WITH {_DATED} SELECT unit_id, year_start::INT AS year_start, year_end::INT AS year_end, composition_year::INT AS composition_year, year_source, year_certainty, period FROM dt")
def finalized_dates(spark, sf_dir):
    return _dated(spark, sf_dir).select("unit_id", "year_start", "year_end", "composition_year", "year_source", "year_certainty", "period")


@query("undated_summary", f"WITH {_DATED}, w AS (SELECT work_id, arg_min(year_source, unit_id) AS s, arg_min(period, unit_id) AS p FROM dt GROUP BY 1) SELECT 'openscore_lieder' AS collection, count(*) AS undated, count(*) FILTER (p <> 'unknown') AS with_period, count(*) FILTER (p = 'unknown') AS unknown FROM w WHERE s IN ('missing', 'composer_lifespan')")
def undated_summary(spark, sf_dir):
    works = _dated(spark, sf_dir).groupBy("work_id").agg(F.min_by(F.struct("collection", "year_source", "period"), "unit_id").alias("w")).select("work_id", "w.*")
    return units.date_summary(works)


@query("manual_template", f"WITH {_DATED}, w AS (SELECT work_id, arg_min(title, unit_id) AS title, count(*) AS n FROM dt WHERE year_source IN ('missing', 'composer_lifespan') GROUP BY 1), o AS (SELECT 'osl-' || c_custkey AS work_id, c_name AS title, CASE WHEN c_custkey % 9 = 0 THEN (1745 + c_custkey % 100)::VARCHAR ELSE '' END AS ys, CASE WHEN c_custkey % 3 = 0 THEN (1750 + c_custkey % 100)::VARCHAR ELSE '' END AS ye, CASE WHEN c_custkey % 3 = 0 THEN (1750 + c_custkey % 100) || '.0' WHEN c_custkey % 3 = 1 THEN '' ELSE 'soon' END AS raw FROM customer WHERE c_custkey % 2 = 0) SELECT coalesce(w.work_id, o.work_id) AS work_id, coalesce(w.title, o.title) AS title, coalesce(w.n::VARCHAR, '1') AS n_units, coalesce(o.ys, '') AS year_start, coalesce(CASE WHEN w.work_id IS NULL THEN o.raw ELSE o.ye END, '') AS year_end, CASE WHEN o.work_id IS NULL THEN '' ELSE 'letters' END AS source FROM w FULL JOIN o ON o.work_id = w.work_id")
def manual_template(spark, sf_dir):
    return units.manual_template(_dated(spark, sf_dir), _manual(spark, sf_dir), skipped=("dcml",)).select("work_id", "title", "n_units", "year_start", "year_end", "source")


def _all_units(spark, sf_dir):
    return _kern(spark, sf_dir).unionByName(_dcml(spark, sf_dir)).withColumn("composer_id", F.lit("mozart_wa"))


_MARKED = f"""{_KERN_UNITS}, {_DCML_UNITS},
un AS (SELECT work_id || '--' || stem AS unit_id, work_id, catalog_key, 2 AS p, path FROM kern UNION ALL SELECT work_id || '--' || piece, work_id, catalog_key, 0, path FROM dcml),
wk AS (SELECT work_id, min((p, path)) AS prio FROM un GROUP BY 1), mb AS (SELECT DISTINCT catalog_key, work_id, prio FROM un JOIN wk USING (work_id) WHERE catalog_key <> ''),
gp AS (SELECT catalog_key, arg_min(work_id, (prio, work_id)) AS f FROM mb GROUP BY 1 HAVING count(*) > 1), one AS (SELECT work_id, max(catalog_key) AS g, arg_max((work_id = f)::INT, catalog_key) AS prim FROM mb JOIN gp USING (catalog_key) GROUP BY 1),
mk AS (SELECT unit_id, un.work_id, CASE WHEN g IS NULL THEN '' ELSE 'mozart_wa:' || g END AS duplicate_group, coalesce(prim, 1) AS is_primary, path FROM un LEFT JOIN one USING (work_id))"""


@query("key_duplicates", f"WITH {_MARKED} SELECT unit_id, duplicate_group, is_primary FROM mk")
def key_duplicates(spark, sf_dir):
    return units.key_duplicates(_all_units(spark, sf_dir)).select("unit_id", "duplicate_group", "is_primary")


@query("primary_works", f"WITH {_MARKED} SELECT work_id, arg_min(unit_id, (path, unit_id)) AS first_unit, count(*) AS units FROM mk WHERE is_primary = 1 GROUP BY 1")
def primary_works(spark, sf_dir):
    rows = units.key_duplicates(_all_units(spark, sf_dir)).withColumn("file_order", F.col("path"))
    w = load_catalog(rows, exclude_target=True)
    return w.select("work_id", F.col("units")[0].alias("first_unit"), F.size("units").cast("long").alias("units"))


_SEQ_SQL = f"""WITH RECURSIVE {_grams_sql('iv', '5')}, t AS (SELECT DISTINCT composer, work_id, gram FROM gram), u AS (SELECT gram FROM t GROUP BY gram HAVING count(*) BETWEEN 2 AND 40), z AS (SELECT work_id, count(*) AS types FROM t GROUP BY 1), nt AS (SELECT work_id, count(*) AS n FROM notes GROUP BY 1),
pr AS (SELECT x.work_id AS a, y.work_id AS b FROM t x JOIN u USING (gram) JOIN t y USING (gram) JOIN z p ON p.work_id = x.work_id JOIN z q ON q.work_id = y.work_id WHERE x.work_id < y.work_id AND x.composer = y.composer AND NOT (x.work_id % 3 = 0 AND y.work_id % 3 = 0) GROUP BY x.work_id, y.work_id, p.types, q.types HAVING count(*) >= 3 AND count(*) / least(p.types, q.types) >= 0.1),
l AS (SELECT a, b FROM pr UNION SELECT b, a FROM pr), r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a), c AS (SELECT a AS work_id, least(a, min(b)) AS k FROM r GROUP BY a),
pm AS (SELECT c.*, row_number() OVER (PARTITION BY k ORDER BY CASE work_id % 3 WHEN 0 THEN 0 WHEN 1 THEN 2 ELSE 4 END, n DESC, 'p' || work_id, work_id) AS o FROM c JOIN nt USING (work_id))
SELECT x.work_id, y.work_id AS primary_work, (x.work_id = y.work_id)::INT AS is_primary FROM pm x JOIN pm y ON y.k = x.k AND y.o = 1"""


@query("sequence_duplicates", _SEQ_SQL)
def sequence_duplicates(spark, sf_dir):
    from stavework.sources.notes import notes

    k = F.col("work_id")
    works = notes(spark, sf_dir).groupBy("work_id").agg(F.count("*").alias("notes")).select("work_id", F.when(k % 3 == 0, "dcml/x").when(k % 3 == 1, "kern/y").otherwise("openscore").alias("collection"), F.concat(F.lit("p"), k).alias("path"), "notes")
    return units.sequence_duplicates(works, curves.containment_pairs(_grams(spark, sf_dir, "iv", [5]), min_shared=3, share=0.1))


_TITLES = ("Sonata Op. 27 No. 2", "Op.{}/3", "Opus {}", "BWV {}a", "Trio Hob. XV:{}", "K. {}", "KV{}b", "HWV_{}", "RV {}", "Sonata L {} K {}", "SV {}", "D. {}", "Nocturne")


@query(
    "catalogue_numbers",
    "WITH p AS (SELECT p_partkey AS i, p_partkey % 13 AS k FROM part) SELECT i AS p_partkey, CASE k WHEN 0 THEN 'op27/2' WHEN 1 THEN 'op' || i || '/3' WHEN 2 THEN 'op' || i WHEN 3 THEN 'bwv' || i || 'a' WHEN 4 THEN 'hobxv:' || i WHEN 5 THEN 'k' || i WHEN 6 THEN 'k' || i WHEN 7 THEN 'hwv' || i WHEN 8 THEN 'rv' || i WHEN 9 THEN 'k' || i WHEN 10 THEN 'sv' || i WHEN 11 THEN CASE WHEN i BETWEEN 10 AND 9999 THEN 'd' || i ELSE '' END ELSE '' END AS catalog_key FROM p",
)
def catalogue_numbers(spark, sf_dir):
    i = F.col("p_partkey").cast("string")
    shape = F.element_at(F.array(*map(F.lit, _TITLES)), (F.col("p_partkey") % 13 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", cat.catalog_key(F.replace(shape, F.lit("{}"), i)).alias("catalog_key"))


@query("accents_off", "SELECT doc_id, md5(strip_accents(coalesce(text, ''))) AS plain_md5 FROM documents")
def accents_off(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(cat.plain(F.coalesce("text", F.lit("")))).alias("plain_md5"))


@query("catalogue_counters", f"WITH {_DATED} SELECT year_source, period, count(*) AS units, count(DISTINCT work_id) AS works FROM dt GROUP BY GROUPING SETS ((), (year_source), (year_source, period))")
def catalogue_counters(spark, sf_dir):
    return units.counters(_dated(spark, sf_dir), ["year_source", "period"])


@query("units_and_works", f"WITH {_DATED} SELECT composer_id, count(*) FILTER (year_source = 'manual') || ' (' || count(DISTINCT work_id) FILTER (year_source = 'manual') || ')' AS manual, count(*) FILTER (year_source = 'composer_lifespan') || ' (' || count(DISTINCT work_id) FILTER (year_source = 'composer_lifespan') || ')' AS composer_lifespan, count(*) FILTER (year_source = 'missing') || ' (' || count(DISTINCT work_id) FILTER (year_source = 'missing') || ')' AS missing FROM dt GROUP BY 1")
def units_and_works(spark, sf_dir):
    return units.units_by_works(_dated(spark, sf_dir), "composer_id", "year_source", ["manual", "composer_lifespan", "missing"])
