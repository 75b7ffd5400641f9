"""Registered queries of deletes over references and of catalog writes, with their DuckDB oracles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from examlake.operators import cascade
from examlake.operators import catalog as C
from examlake.operators import knowledge as K
from examlake.sources import tables as src
from examlake.sources.written import written

_TEXT = "string"


def _tables(spark, d) -> dict[str, DataFrame]:
    """The test tables as the stored ones, for two owners with equal ids."""
    r = lambda name: src.read(spark, d, name)
    text = lambda c: F.col(c).cast(_TEXT)
    nation, li = r("nation"), r("lineitem")
    item = F.concat_ws("-", *[F.col(c).cast("long").cast(_TEXT) for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")])
    paper = F.col("l_linestatus") == "F"
    one = {
        "classes": r("region").select(text("r_regionkey").alias("id")),
        "units": nation.select(text("n_nationkey").alias("id"), text("n_regionkey").alias("class_id")),
        "chapters": r("supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(text("s_suppkey").alias("id"), text("s_nationkey").alias("unit_id"), text("n_regionkey").alias("class_id")),
        "materials": r("part").select(text("p_partkey").alias("id"), text("p_size").alias("chapter_id")),
        "question_papers": r("orders").select(text("o_orderkey").alias("id"), (F.col("o_custkey") % 5).cast(_TEXT).alias("class_id")),
        "question_bank": li.select(item.alias("id"), F.when(paper, text("l_orderkey")).alias("question_paper_id"), F.when(~paper, text("l_partkey")).alias("material_id"), text("l_suppkey").alias("chapter_id")).distinct(),
        "syllabus_knowledge": r("customer").select(text("c_custkey").alias("id"), (F.col("c_custkey") % 60).cast(_TEXT).alias("chapter_id"), text("c_custkey").alias("material_id")),
        "chapter_concepts": r("customer").select(F.concat(F.lit("k"), "c_custkey").alias("id"), text("c_custkey").alias("syllabus_knowledge_id")),
        "question_classifications": li.select(item.alias("id"), item.alias("question_id"), (F.col("l_partkey") % 90).cast(_TEXT).alias("chapter_id")).distinct(),
        "extraction_jobs": r("orders").select(text("o_orderkey").alias("id"), text("o_orderkey").alias("question_paper_id")),
        "openai_usage_events": r("events").select(text("event_id").alias("id"), text("event_id").alias("job_id")),
    }
    stored = {n: written(t, n) if n in ("question_bank", "question_classifications") else t for n, t in one.items()}
    return {n: t.crossJoin(F.broadcast(spark.range(2).select(F.concat(F.lit("u"), "id").alias("owner_id")))) for n, t in stored.items()}


def deleted_graph(spark, d):
    """What stays of every table when owner u0 deletes a class, some chapters and some papers: rows, a sum over ids, lost references."""
    t = _tables(spark, d)
    mine = lambda n, test: t[n].where(f"owner_id = 'u0' and {test}").select("owner_id", "id")
    left = cascade.delete_rows(t, {"classes": mine("classes", "id = '1'"), "chapters": mine("chapters", "cast(id as bigint) % 10 = 3"), "question_papers": mine("question_papers", "cast(id as bigint) % 50 = 0")})
    digest = F.sum(F.conv(F.substring(F.md5("id"), 1, 8), 16, 10).cast("long")).alias("id_sum")
    lost = {"syllabus_knowledge": "material_id", "openai_usage_events": "job_id"}
    sums = [x.groupBy("owner_id").agg(F.count(F.lit(1)).alias("n"), digest, F.count_if(F.col(lost[n]).isNull() if n in lost else F.lit(False)).alias("n_lost")).withColumn("table_name", F.lit(n)) for n, x in left.items()]
    return reduce(DataFrame.unionByName, sums)


_ITEM = "concat_ws('-', l_orderkey::BIGINT, l_linenumber::BIGINT, l_partkey::BIGINT, l_suppkey::BIGINT, l_quantity::BIGINT)"
_KEPT = "SELECT '{0}' AS table_name, id, {1} AS lost, id IN (SELECT id FROM g_{0}) AS gone FROM {0}"
GRAPH = f"""WITH classes AS (SELECT r_regionkey::VARCHAR AS id FROM region), units AS (SELECT n_nationkey::VARCHAR AS id, n_regionkey::VARCHAR AS class_id FROM nation),
 chapters AS (SELECT s_suppkey::VARCHAR AS id, s_nationkey::VARCHAR AS unit_id, n_regionkey::VARCHAR AS class_id FROM supplier JOIN nation ON s_nationkey = n_nationkey),
 materials AS (SELECT p_partkey::VARCHAR AS id, p_size::VARCHAR AS chapter_id FROM part), question_papers AS (SELECT o_orderkey::VARCHAR AS id, (o_custkey % 5)::VARCHAR AS class_id FROM orders),
 question_bank AS (SELECT DISTINCT {_ITEM} AS id, CASE WHEN l_linestatus = 'F' THEN l_orderkey END::VARCHAR AS question_paper_id, CASE WHEN l_linestatus <> 'F' THEN l_partkey END::VARCHAR AS material_id, l_suppkey::VARCHAR AS chapter_id FROM lineitem),
 syllabus_knowledge AS (SELECT c_custkey::VARCHAR AS id, (c_custkey % 60)::VARCHAR AS chapter_id, c_custkey::VARCHAR AS material_id FROM customer),
 chapter_concepts AS (SELECT 'k' || c_custkey AS id, c_custkey::VARCHAR AS syllabus_knowledge_id FROM customer),
 question_classifications AS (SELECT DISTINCT {_ITEM} AS id, (l_partkey % 90)::VARCHAR AS chapter_id FROM lineitem),
 extraction_jobs AS (SELECT o_orderkey::VARCHAR AS id FROM orders), openai_usage_events AS (SELECT event_id::VARCHAR AS id FROM events),
 g_classes AS (SELECT '1' AS id), g_units AS (SELECT id FROM units WHERE class_id = '1'),
 g_chapters AS (SELECT id FROM chapters WHERE id::BIGINT % 10 = 3 OR class_id = '1' OR unit_id IN (SELECT id FROM g_units)),
 g_materials AS (SELECT id FROM materials WHERE chapter_id IN (SELECT id FROM g_chapters)),
 g_question_papers AS (SELECT id FROM question_papers WHERE id::BIGINT % 50 = 0 OR class_id = '1'),
 g_question_bank AS (SELECT id FROM question_bank WHERE chapter_id IN (SELECT id FROM g_chapters) OR material_id IN (SELECT id FROM g_materials) OR question_paper_id IN (SELECT id FROM g_question_papers)),
 g_syllabus_knowledge AS (SELECT id FROM syllabus_knowledge WHERE chapter_id IN (SELECT id FROM g_chapters)),
 g_chapter_concepts AS (SELECT id FROM chapter_concepts WHERE syllabus_knowledge_id IN (SELECT id FROM g_syllabus_knowledge)),
 g_question_classifications AS (SELECT id FROM question_classifications WHERE chapter_id IN (SELECT id FROM g_chapters) OR id IN (SELECT id FROM g_question_bank)),
 g_extraction_jobs AS (SELECT id FROM g_question_papers), g_openai_usage_events AS (SELECT '' AS id WHERE false),
 rows AS ({" UNION ALL ".join(_KEPT.format(t, {"syllabus_knowledge": "material_id IN (SELECT id FROM g_materials)", "openai_usage_events": "id IN (SELECT id FROM g_extraction_jobs)"}.get(t, "false")) for t in ("classes", "units", "chapters", "materials", "question_papers", "question_bank", "syllabus_knowledge", "chapter_concepts", "question_classifications", "extraction_jobs", "openai_usage_events"))})
SELECT table_name, owner_id, count(*) AS n, sum(('0x' || substr(md5(id), 1, 8))::BIGINT)::BIGINT AS id_sum, count(*) FILTER (lost AND owner_id = 'u0') AS n_lost
FROM rows, (VALUES ('u0'), ('u1')) o(owner_id) WHERE NOT (gone AND owner_id = 'u0') GROUP BY ALL"""

def _trees(spark, d):
    """Benchmark items as chapters, ten a unit and forty a class, of owners u0 and u1 by class."""
    b = src.read(spark, d, "benchmark").select(F.expr("item_id div 40").alias("cls"), F.expr("item_id div 10").alias("unit"), F.col("item_id").alias("item"))
    name = F.concat(F.lit("Chapter "), F.col("item").cast(_TEXT))
    units = b.groupBy("cls", "unit").agg(F.array_sort(F.collect_list(F.struct("item", name.alias("name")))).alias("c"))
    chapters = F.transform("c", lambda x: F.struct(F.concat(F.lit("ch"), x["item"].cast(_TEXT)).alias("id"), x["name"].alias("name")))
    unit = F.struct("unit", F.struct(F.concat(F.lit("un"), F.col("unit").cast(_TEXT)).alias("id"), F.concat(F.lit("Unit "), F.col("unit").cast(_TEXT)).alias("name"), F.lit(None).cast(_TEXT).alias("title"), F.lit(None).cast("int").alias("marks"), chapters.alias("chapters")).alias("u"))
    tree = units.groupBy("cls").agg(F.transform(F.array_sort(F.collect_list(unit)), lambda x: x["u"]).alias("units"))
    return tree.select(F.concat(F.lit("u"), (F.col("cls") % 2).cast(_TEXT)).alias("owner_id"), F.col("cls").cast("int").alias("position"), F.concat(F.lit("cl"), F.col("cls").cast(_TEXT)).alias("id"), F.concat(F.lit("Class "), F.col("cls").cast(_TEXT)).alias("name"), "units")


def _stored(spark, d):
    """Stored rows of every third id, under old names and one that no tree has, with the time they were made."""
    c = spark.range(0, 600, 3).select(F.col("id").cast(_TEXT).alias("n"), F.concat(F.lit("u"), F.col("id").cast("int") % 2).alias("own"))
    old = [F.lit("old name").alias("name"), F.lit(-1).alias("position"), F.lit("then").alias("made")]
    owners = spark.createDataFrame([("u0",), ("u1",)], "owner_id string")
    of = lambda prefix, *more: c.crossJoin(owners).select("owner_id", F.concat(F.lit(prefix), "n").alias("id"), *more, *old)
    null = lambda x, kind=_TEXT: F.lit(None).cast(kind).alias(x)
    return of("cl"), of("un", null("class_id"), null("title"), null("marks", "int")), of("ch", null("unit_id"), null("class_id"))


def _levels(classes, units, chapters):
    null = F.lit(None).cast(_TEXT)
    part = lambda df, level, up: df.select(F.lit(level).alias("level"), "owner_id", "id", up.alias("parent"), "name", "position", "made")
    return part(classes, "class", null).unionByName(part(units, "unit", F.col("class_id"))).unionByName(part(chapters, "chapter", F.col("unit_id")))


def synced_catalog(spark, d):
    """Whole trees written over stored rows, twice; owner u1's first class is left out."""
    trees = _trees(spark, d)
    only = trees.where("id <> 'cl1'")
    once = C.sync_catalog(*_stored(spark, d), trees, only)
    return _levels(*C.sync_catalog(*once, trees, only))


def ensured_branches(spark, d):
    """Every 17th item's branch is written, with one that no tree has."""
    b = src.read(spark, d, "benchmark").where("item_id % 17 = 0")
    text = lambda prefix, c: F.concat(F.lit(prefix), F.expr(c).cast(_TEXT))
    branches = b.select(F.concat(F.lit("u"), F.expr("(item_id div 40) % 2").cast(_TEXT)).alias("owner_id"), text("cl", "item_id div 40").alias("class_id"), text("un", "item_id div 10 + if(item_id = 0, 1, 0)").alias("unit_id"), text("ch", "item_id").alias("chapter_id"))
    *levels, missing = C.ensure_branches(*_stored(spark, d), _trees(spark, d), branches)
    lost = missing.select(F.lit("missing").alias("level"), "owner_id", F.col("chapter_id").alias("id"), F.col("unit_id").alias("parent"), F.lit(None).cast(_TEXT).alias("name"), F.lit(None).cast("int").alias("position"), F.lit(None).cast(_TEXT).alias("made"))
    return _levels(*levels).unionByName(lost)


_FLAT = """i AS (SELECT item_id AS i, item_id // 10 AS u, item_id // 40 AS c, 'u' || (item_id // 40 % 2) AS owner_id FROM benchmark),
 flat AS (SELECT DISTINCT 'class' AS level, owner_id, 'cl' || c AS id, NULL::VARCHAR AS parent, 'Class ' || c AS name, c::INT AS position, c, u // 100000 AS branch FROM i
  UNION ALL SELECT DISTINCT 'unit', owner_id, 'un' || u, 'cl' || c, 'Unit ' || u, (dense_rank() OVER (PARTITION BY c ORDER BY u) - 1)::INT, c, NULL FROM i
  UNION ALL SELECT 'chapter', owner_id, 'ch' || i, 'un' || u, 'Chapter ' || i, (row_number() OVER (PARTITION BY u ORDER BY i) - 1)::INT, c, NULL FROM i),
 stored AS (SELECT level, o.owner_id, p || n AS id FROM range(0, 600, 3) t(n), (VALUES ('class', 'cl'), ('unit', 'un'), ('chapter', 'ch')) l(level, p), (VALUES ('u0'), ('u1')) o(owner_id))"""
_MERGED = """SELECT level, owner_id, id, n.parent, CASE WHEN n.id IS NULL THEN 'old name' ELSE n.name END AS name, CASE WHEN n.id IS NULL THEN -1 ELSE n.position END AS position, CASE WHEN s.id IS NOT NULL THEN 'then' END AS made
FROM stored s FULL JOIN new n USING (level, owner_id, id)"""
SYNCED = f"WITH {_FLAT}, new AS (SELECT * FROM flat WHERE c <> 1) {_MERGED}"
ENSURED = f"""WITH {_FLAT}, b AS (SELECT * FROM i WHERE i % 17 = 0 AND i > 0), new AS (SELECT * FROM flat WHERE (level, owner_id, id) IN (SELECT ('class', owner_id, 'cl' || c) FROM b UNION SELECT ('unit', owner_id, 'un' || u) FROM b UNION SELECT ('chapter', owner_id, 'ch' || i) FROM b))
{_MERGED} UNION ALL SELECT 'missing', owner_id, 'ch' || i, 'un' || (u + 1), NULL, NULL, NULL FROM i WHERE i = 0"""


def knowledge_states(spark, d):
    """Chapters marked pending, then built: those without a result stay pending, others keep what they had."""
    from examlake.plans import extract_queries as Q

    materials, concepts, vectors = Q.knowledge_inputs(spark, d)
    own = lambda df: df.withColumn("owner_id", F.lit("u0"))
    chapters = own(materials.select("chapter_id", "chapter_name").distinct())
    null = lambda kind: F.lit(None).cast(kind)
    none = {"material_id": null("long"), "unit_id": null(_TEXT), "title_embedding": null(vectors.schema["embedding"].dataType), "summary_embedding": null(vectors.schema["embedding"].dataType), "extract_error": null(_TEXT), "extracted_at": null(_TEXT)}
    stored = chapters.where("chapter_id % 2 = 0").withColumns({"id": F.concat(F.lit("k"), F.col("chapter_id").cast(_TEXT)), "class_id": F.lit("c"), "summary": F.lit("an old summary"), "extract_status": F.lit("complete"), "mismatch_warning": F.lit(True), "concept_count": F.lit(2), **none})
    old = stored.select("owner_id", "chapter_id", F.col("id").alias("syllabus_knowledge_id"), F.lit("old").alias("concept_name"), null(vectors.schema["embedding"].dataType).alias("concept_embedding"), F.lit(0).alias("position"))
    asked = chapters.where("chapter_id % 3 <> 2").withColumns({"class_id": F.lit("c"), "unit_id": null(_TEXT), "material_id": null("long")})
    pending = K.mark_pending(stored, asked)
    built, named = K.build_knowledge(own(materials.where("chapter_id % 3 <> 2 and chapter_id % 5 <> 0")), own(concepts), vectors)
    rows, names = K.finish_builds(pending, old, built, named, F.lit("now"))
    n = names.groupBy("owner_id", "syllabus_knowledge_id").agg(F.count(F.lit(1)).alias("n_concepts")).withColumnRenamed("syllabus_knowledge_id", "id")
    out = rows.join(n, ["owner_id", "id"], "left")
    return out.select("owner_id", "id", "chapter_id", "extract_status", "extract_error", "concept_count", "mismatch_warning", F.col("summary").isNotNull().alias("has_summary"), "extracted_at", F.coalesce("n_concepts", F.lit(0)).alias("n_concepts"))


def _states_sql() -> str:
    from examlake.plans.extract_queries import BUILT

    return f"""WITH b AS ({BUILT}), ch AS (SELECT DISTINCT doc_id // 40 AS chapter_id FROM documents), x AS (SELECT ch.chapter_id, chapter_id % 2 = 0 AS had, chapter_id % 3 <> 2 AS asked, chapter_id % 3 <> 2 AND chapter_id % 5 <> 0 AS done FROM ch)
SELECT 'u0' AS owner_id, CASE WHEN had THEN 'k' || chapter_id ELSE 'u0/' || chapter_id END AS id, chapter_id, CASE WHEN done THEN b.extract_status WHEN asked THEN 'pending' ELSE 'complete' END AS extract_status, CASE WHEN done THEN b.extract_error END AS extract_error,
 CASE WHEN done THEN b.concept_count WHEN asked THEN 0 ELSE 2 END::INT AS concept_count, CASE WHEN done THEN b.mismatch_warning ELSE NOT asked END AS mismatch_warning, CASE WHEN done THEN b.extract_status = 'complete' ELSE NOT asked END AS has_summary,
 CASE WHEN done THEN 'now' END AS extracted_at, CASE WHEN done THEN b.concept_count WHEN had THEN 1 ELSE 0 END::BIGINT AS n_concepts FROM x JOIN b USING (chapter_id) WHERE had OR asked"""


QUERIES = {
    "deleted_graph": (deleted_graph, GRAPH),
    "synced_catalog": (synced_catalog, SYNCED),
    "ensured_branches": (ensured_branches, ENSURED),
    "knowledge_states": (knowledge_states, _states_sql()),
}
