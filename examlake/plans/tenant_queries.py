"""Registered queries over tenants' tables: scans, bank rows, usage, expected counts; each with its DuckDB oracle."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from examlake.functions import text as T
from examlake.operators import expected as X
from examlake.operators import records as R
from examlake.operators import scans as S
from examlake.operators import usage as U
from examlake.plans.bank_queries import _SUMS, PRICED, TEXTS, USAGE
from examlake.sources import tables as src
from examlake.sources.written import written

FULL = """full_bank AS (SELECT 'u' || (o_custkey % 7) AS owner_id, l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || l_quantity::INT || l_linestatus || l_returnflag AS id, CASE WHEN l_linestatus = 'F' THEN 'question_paper' ELSE 'material' END AS origin_type,
 CASE WHEN l_linestatus <> 'F' THEN 'm' || l_suppkey END AS material_id, CASE WHEN l_linestatus = 'F' THEN 'p' || l_orderkey END AS question_paper_id, o_orderstatus AS class_id, l_returnflag AS unit_id, 'c' || (l_partkey % 50) AS chapter_id,
 CASE WHEN l_linenumber < 7 THEN l_linenumber END AS question_no, 'Question ' || repeat('a', (l_suppkey % 9)::INT) AS question_text, l_quantity::DECIMAL(10,2) AS marks, ['Class work', 'Test', 'Final exam', 'Model exam', 'Others'][l_partkey % 5 + 1] AS source,
 CASE WHEN l_orderkey % 11 > 0 THEN year(o_orderdate)::INT END AS year, 't' || (l_suppkey % 3) AS topic FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
MATERIALS = """mat AS (SELECT 'u' || (p_partkey % 7) AS owner_id, p_partkey AS material_id, p_size % 4 AS class_id, p_size % 10 AS unit_id, p_size AS chapter_id, 'Chapter ' || p_size AS chapter_name, ['Question papers', 'Class Notes', 'Syllabus'][p_partkey % 3 + 1] AS material_type,
 ['Class work', 'Test', 'Public exam', NULL][p_partkey % 4 + 1] AS exam_source, p_partkey * 37 % 1000 AS created_at, p_name AS name FROM part)"""


def _tagged(*parts):
    out = None
    for k, p in enumerate(parts):
        p = p.withColumn("search", F.lit(k))
        out = p if out is None else out.unionByName(p)
    return out


def bank_searches(spark, d):
    """Three searches of a tenant's bank: by class, by five filters, by all nine."""
    b = src.full_bank(spark, d)
    parts = [S.search_bank(b, "u3", class_id="F"), S.search_bank(b, "u3", unit_id="N", source="Test", year=1997, origin_type="material", topic="t1"), S.search_bank(b, "u5", class_id="O", unit_id="A", chapter_id="c7", source="Final exam", year=1996, origin_type="question_paper", topic="t2")]
    w = Window.partitionBy("search", "class_id", "year").orderBy(*S.bank_order(), "id")
    return _tagged(*parts).select("search", "owner_id", "id", "class_id", "year", "question_no", F.row_number().over(w).alias("place"))


BANK_SEARCHES = f"""WITH {FULL}, hit AS (SELECT 0 AS search, * FROM full_bank WHERE owner_id = 'u3' AND class_id = 'F' UNION ALL SELECT 1, * FROM full_bank WHERE owner_id = 'u3' AND unit_id = 'N' AND source = 'Test' AND year = 1997 AND origin_type = 'material' AND topic = 't1'
 UNION ALL SELECT 2, * FROM full_bank WHERE owner_id = 'u5' AND class_id = 'O' AND unit_id = 'A' AND chapter_id = 'c7' AND source = 'Final exam' AND year = 1996 AND origin_type = 'question_paper' AND topic = 't2')
SELECT search, owner_id, id, class_id, year, question_no, row_number() OVER (PARTITION BY search, class_id, year ORDER BY year DESC NULLS LAST, question_no NULLS LAST, id)::INT AS place FROM hit"""


def materials_lists(spark, d):
    m = src.materials(spark, d)
    w = Window.partitionBy("search", "class_id").orderBy(F.desc_nulls_last("created_at"), "material_id")
    parts = [S.list_materials(m, "u2"), S.list_materials(m, "u4", class_id=1, material_type="Syllabus"), S.list_materials(m, "u4", unit_id=3, chapter_id=13, exam_source="Test")]
    return _tagged(*parts).select("search", "material_id", "class_id", F.row_number().over(w).alias("place"))


MATERIALS_LISTS = f"""WITH {MATERIALS}, hit AS (SELECT 0 AS search, * FROM mat WHERE owner_id = 'u2' UNION ALL SELECT 1, * FROM mat WHERE owner_id = 'u4' AND class_id = 1 AND material_type = 'Syllabus' UNION ALL SELECT 2, * FROM mat WHERE owner_id = 'u4' AND unit_id = 3 AND chapter_id = 13 AND exam_source = 'Test')
SELECT search, material_id, class_id, row_number() OVER (PARTITION BY search, class_id ORDER BY created_at DESC, material_id)::INT AS place FROM hit"""


def paper_lists(spark, d):
    p = src.papers(spark, d).withColumn("created_at", F.when(F.col("paper_id") % 9 > 0, F.col("stored_at"))).withColumn("stored_at", F.col("created_at"))
    listed = S.list_papers(p, "u1")
    by_year = Window.partitionBy("class_id").orderBy(F.desc_nulls_last("year"), F.desc_nulls_last("created_at"), "paper_id")
    stored = Window.partitionBy("class_id").orderBy(*S.stored_order(), "paper_id")
    return listed.select("paper_id", "class_id", F.row_number().over(by_year).alias("place"), F.row_number().over(stored).alias("stored_place"))


PAPER_LISTS = """SELECT o_orderkey AS paper_id, o_orderstatus AS class_id, row_number() OVER (PARTITION BY o_orderstatus ORDER BY year(o_orderdate) DESC, CASE WHEN o_orderkey % 9 > 0 THEN o_orderdate END DESC NULLS LAST, o_orderkey)::INT AS place,
 row_number() OVER (PARTITION BY o_orderstatus ORDER BY coalesce(CASE WHEN o_orderkey % 9 > 0 THEN o_orderdate END, TIMESTAMP '1970-01-01') DESC, o_orderkey)::INT AS stored_place FROM orders WHERE o_custkey % 7 = 1"""


def catalog_scan(spark, d):
    c = src.read(spark, d, "customer").select(F.concat(F.lit("u"), (F.col("c_custkey") % 7).cast("string")).alias("owner_id"), F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("unit_id"), F.col("c_name").alias("name"), F.when(F.col("c_custkey") % 5 > 0, F.col("c_custkey") % 13).alias("position"))
    w = Window.partitionBy("unit_id").orderBy(F.asc_nulls_last("position"), "id")
    return S.catalog_rows(c, "u6").select("id", "unit_id", "name", F.row_number().over(w).alias("place"))


CATALOG_SCAN = "SELECT c_custkey AS id, c_nationkey AS unit_id, c_name AS name, row_number() OVER (PARTITION BY c_nationkey ORDER BY CASE WHEN c_custkey % 5 > 0 THEN c_custkey % 13 END NULLS LAST, c_custkey)::INT AS place FROM customer WHERE c_custkey % 7 = 6"


def _knowledge(spark, d):
    v = src.read(spark, d, "embeddings")
    i = F.col("vec_id")
    return v.select(F.concat(F.lit("u"), (i % 7).cast("string")).alias("owner_id"), i.alias("chapter_id"), (i % 4).alias("class_id"), (i % 10).alias("unit_id"), F.when(i % 3 == 0, "failed").when(i % 3 == 1, "complete").otherwise("pending").alias("extract_status"), F.col("embedding").alias("title_embedding"), F.col("embedding").alias("summary_embedding"), (i * 31 % 997).alias("extracted_at"))


def knowledge_states(spark, d):
    k = S.knowledge_status(_knowledge(spark, d), "u2")
    w = Window.partitionBy("class_id").orderBy(F.desc_nulls_last("extracted_at"), "chapter_id")
    return k.select("*", F.row_number().over(w).alias("place"))


KNOWLEDGE = "k AS (SELECT 'u' || (vec_id % 7) AS owner_id, vec_id AS chapter_id, vec_id % 4 AS class_id, vec_id % 10 AS unit_id, ['failed', 'complete', 'pending'][vec_id % 3 + 1] AS extract_status, vec_id * 31 % 997 AS extracted_at FROM embeddings)"
KNOWLEDGE_STATES = f"WITH {KNOWLEDGE} SELECT *, row_number() OVER (PARTITION BY class_id ORDER BY extracted_at DESC, chapter_id)::INT AS place FROM k WHERE owner_id = 'u2'"


def concept_lists(spark, d):
    concepts = src.read(spark, d, "documents").select(F.concat(F.lit("u"), (F.col("doc_id") % 7).cast("string")).alias("owner_id"), (F.col("doc_id") % 500).alias("chapter_id"), F.col("doc_id").alias("position"), F.substring("text", 1, 12).alias("name"))
    k = _knowledge(spark, d).drop("title_embedding", "summary_embedding")
    return S.concepts_of(concepts, k, class_id=1).unionByName(S.concepts_of(concepts, k, unit_id=4)).select("owner_id", "chapter_id", "position", "name", "class_id", "unit_id")


CONCEPT_LISTS = f"WITH {KNOWLEDGE}, c AS (SELECT 'u' || (doc_id % 7) AS owner_id, doc_id % 500 AS chapter_id, doc_id AS position, substring(text, 1, 12) AS name FROM documents) SELECT owner_id, chapter_id, position, name, class_id, unit_id FROM c JOIN k USING (owner_id, chapter_id) WHERE class_id = 1 UNION ALL SELECT owner_id, chapter_id, position, name, class_id, unit_id FROM c JOIN k USING (owner_id, chapter_id) WHERE unit_id = 4"


def bank_row_counts(spark, d):
    return S.bank_counts(src.full_bank(spark, d)).select("owner_id", "question_paper_id", "n_rows", F.array_join("ids", ",").alias("ids"))


BANK_ROW_COUNTS = f"WITH {FULL} SELECT owner_id, question_paper_id, count(*) AS n_rows, string_agg(id, ',' ORDER BY coalesce(question_no, 99999), id) AS ids FROM full_bank WHERE question_paper_id IS NOT NULL GROUP BY ALL"


def chapter_questions(spark, d):
    b = src.full_bank(spark, d)
    parts = [S.of_chapter(b, "c3"), S.of_chapter(b, "c4", "material"), S.of_paper_or_material(b, "m12"), S.of_paper_or_material(b, None)]
    return _tagged(*parts).select("search", "id")


CHAPTER_QUESTIONS = f"WITH {FULL} SELECT 0 AS search, id FROM full_bank WHERE chapter_id = 'c3' UNION ALL SELECT 1, id FROM full_bank WHERE chapter_id = 'c4' AND origin_type = 'material' UNION ALL SELECT 2, id FROM full_bank WHERE question_paper_id = 'm12' OR material_id = 'm12'"


def practice_places(spark, d):
    b = src.full_bank(spark, d)
    chapter, paper = Window.partitionBy("owner_id", "chapter_id").orderBy(*S.practice_order(), "id"), S.in_paper("id").orderBy(*S.paper_order(), "id")
    return b.select("id", F.row_number().over(chapter).alias("in_chapter"), F.when(F.col("question_paper_id").isNotNull(), F.row_number().over(paper)).alias("in_paper"))


PRACTICE_PLACES = f"WITH {FULL} SELECT id, row_number() OVER (PARTITION BY owner_id, chapter_id ORDER BY coalesce(question_no, 99999), coalesce(year, 0) DESC, source, id)::INT AS in_chapter, CASE WHEN question_paper_id IS NOT NULL THEN row_number() OVER (PARTITION BY owner_id, question_paper_id ORDER BY coalesce(question_no, 99999), id) END::INT AS in_paper FROM full_bank"


def _sets(spark, d):
    i = F.col("row_order")
    return src.text_bank(spark, d).select("*", F.when(i % 3 > 0, F.concat(F.lit("S"), (i % 2).cast("string"))).alias("series"), F.when(i % 4 > 0, (i % 3).cast("string")).alias("set"), F.lit(None).cast("string").alias("code_no"))


SETS = TEXTS.replace("FROM documents)", ", coalesce(CASE WHEN doc_id % 3 > 0 THEN 'S' || (doc_id % 2) END, '') || ':' || coalesce(CASE WHEN doc_id % 4 > 0 THEN (doc_id % 3)::VARCHAR END, '') || ':' AS sk FROM documents)")


def set_places(spark, d):
    w = Window.partitionBy("paper_id").orderBy(*S.set_order(), "row_order")
    return _sets(spark, d).select("paper_id", "row_order", F.row_number().over(w).alias("place"))


SET_PLACES = f"WITH {SETS} SELECT paper_id, row_order, row_number() OVER (PARTITION BY paper_id ORDER BY sk, question_no, row_order)::INT AS place FROM texts"


def best_per_number(spark, d):
    from examlake.operators.merging import best_per_number as best

    rows = _sets(spark, d).withColumn("question_no", F.when(F.col("question_no") != 5, (F.col("question_no") % 6).cast("int"))).withColumn("marks", F.when(F.col("row_order") % 4 == 0, 2.0))
    return best(rows).select("paper_id", "row_order", "question_no")


BEST_PER_NUMBER = rf"""WITH {SETS}, r AS (SELECT paper_id, row_order, CASE WHEN question_no <> 5 THEN question_no % 6 END AS question_no, sk, length(question_text) + CASE WHEN row_order % 4 = 0 THEN 50 ELSE 0 END + CASE WHEN regexp_matches(question_text, '[^\x20-\x7E\n\r\t\x{{0900}}-\x{{097F}}§©¶]') THEN 10 ELSE 0 END AS score FROM texts)
SELECT paper_id, row_order, question_no FROM r QUALIFY row_number() OVER (PARTITION BY paper_id, sk, question_no ORDER BY score DESC, row_order) = 1"""


def id_union(spark, d):
    n = lambda name, key: src.read(spark, d, name).select(F.col(key).cast("long").alias("id"))
    return S.ids_in_order(n("nation", "n_nationkey"), n("supplier", "s_suppkey"), n("customer", "c_custkey"))


ID_UNION = "SELECT id, min(source)::INT AS source FROM (SELECT n_nationkey::BIGINT AS id, 0 AS source FROM nation UNION ALL SELECT s_suppkey, 1 FROM supplier UNION ALL SELECT c_custkey, 2 FROM customer) GROUP BY id"


def replaced_numbers(spark, d):
    b = src.bank(spark, d).select("paper_id", "question_no", "marks")
    again = src.papers(spark, d).where("paper_id % 4 = 0").select("paper_id", F.lit(2).alias("question_no"), F.lit(1).cast("decimal(10,2)").alias("marks"))
    return S.replace_numbers(b, again)


REPLACED = "SELECT l_orderkey AS paper_id, l_linenumber AS question_no, l_quantity::DECIMAL(10,2) AS marks FROM lineitem WHERE NOT (l_orderkey % 4 = 0 AND l_linenumber = 2 AND l_orderkey IN (SELECT o_orderkey FROM orders)) UNION ALL SELECT o_orderkey, 2, 1::DECIMAL(10,2) FROM orders WHERE o_orderkey % 4 = 0"


# --- usage ------------------------------------------------------------------------------------


def usage_summaries(spark, d):
    s = U.usage_summaries(src.usage_events(spark, d))
    each = s.select("owner_id", "job_id", "pricing_version", F.explode("by_action").alias("action", "b"), "totals")
    return each.select("owner_id", "job_id", "pricing_version", "action", "b.calls", "b.total_tokens", F.col("b.cost").cast("double").alias("cost"), F.col("totals.total_tokens").alias("job_tokens"), F.col("totals.cost").cast("double").alias("job_cost"))


USAGE_SUMMARIES = f"""WITH {USAGE}, {PRICED}, a AS (SELECT owner_id, job_id, action, {_SUMS} FROM priced GROUP BY ALL)
SELECT owner_id, job_id, '2025-07' AS pricing_version, action, calls, total_tokens, cost, (sum(total_tokens) OVER (PARTITION BY owner_id, job_id))::BIGINT AS job_tokens, (SELECT (sum(micros) / 1000000)::DOUBLE FROM priced p WHERE p.owner_id = a.owner_id AND p.job_id = a.job_id) AS job_cost FROM a"""


def usage_by_owner(spark, d):
    """By owner and action: the 30 days to the end of 30 January, and all time."""
    e = src.usage_events(spark, d)
    last = U.usage_by_action(e, now=F.to_timestamp(F.lit("2024-01-31")), days=20).withColumn("span", F.lit("days"))
    out = last.unionByName(U.usage_by_action(e, days=None).withColumn("span", F.lit("all")))
    return out.withColumn("cost", F.col("cost").cast("double"))


USAGE_BY_OWNER = f"WITH {USAGE}, {PRICED} SELECT owner_id, action, {_SUMS}, 'days' AS span FROM priced WHERE created_at > TIMESTAMP '2024-01-31' - INTERVAL 20 DAY GROUP BY ALL UNION ALL SELECT owner_id, action, {_SUMS}, 'all' FROM priced GROUP BY ALL"


def usage_events_to_append(spark, d):
    e = src.usage_events(spark, d)
    own = F.when(F.col("event_id") % 5 == 0, F.create_map(F.lit("pricingVersion"), F.lit("old"), F.lit("k"), F.lit("v"))).when(F.col("event_id") % 5 == 1, F.create_map(F.lit("k"), F.lit("w")))
    rows = U.usage_rows(e.withColumn("owner_id", F.when(F.col("event_id") % 4 > 0, F.col("owner_id"))).withColumn("metadata", own))
    return rows.select("event_id", "owner_id", F.col("metadata")["pricingVersion"].alias("version"), F.col("metadata")["k"].alias("k"))


TO_APPEND = "SELECT event_id, 'u' || (user_id % 7) AS owner_id, CASE WHEN event_id % 5 = 0 THEN 'old' ELSE '2025-07' END AS version, CASE event_id % 5 WHEN 0 THEN 'v' WHEN 1 THEN 'w' END AS k FROM events WHERE event_id % 4 > 0 AND event_type <> ''"


def token_counts(spark, d):
    e = src.read(spark, d, "events")
    n = (F.col("event_id") % 900).cast("string")
    total = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit(', "total_tokens": '), (F.col("event_id") % 50).cast("string"))).otherwise("")
    payload = F.when(F.col("event_id") % 7 == 0, F.col("props")).otherwise(F.concat(F.lit('{"usage": {"prompt_tokens": '), n, F.lit(', "completion_tokens": 7'), total, F.lit("}}")))
    return e.select("event_id", U.token_counts(payload).alias("t")).select("event_id", "t.*")


TOKENS = "SELECT event_id, p::BIGINT AS prompt_tokens, c::BIGINT AS completion_tokens, (CASE WHEN t > 0 THEN t ELSE p + c END)::BIGINT AS total_tokens FROM (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 0 ELSE event_id % 900 END AS p, CASE WHEN event_id % 7 = 0 THEN 0 ELSE 7 END AS c, CASE WHEN event_id % 7 > 0 AND event_id % 3 = 0 THEN event_id % 50 ELSE 0 END AS t FROM events)"


# --- bank rows --------------------------------------------------------------------------------


def _raw_questions(spark, d):
    i = F.col("doc_id")
    own = F.concat(F.lit("u"), (F.expr("doc_id div 40") % 7).cast("string"))
    q = src.read(spark, d, "documents").select(own.alias("owner_id"), F.expr("doc_id div 40").alias("paper_id"), i.alias("row_order"), F.concat(F.lit("q"), i.cast("string")).alias("id"), "text", i)
    return q.select(
        "owner_id", "paper_id", "row_order", "id", F.when(i % 2 == 0, F.col("text")).alias("questionText"), F.when(i % 2 == 1, F.col("text")).alias("question_text"),
        F.when(i % 3 > 0, (i % 40 + 1).cast("string")).alias("questionNo"), F.when(i % 4 == 0, "").when(i % 4 == 1, "two").when(i % 4 == 2, "2.5").otherwise(F.lit(None)).alias("marks"), (i % 5 == 0).alias("hasFigure"), F.when(i % 6 == 0, "optics").alias("topic"),
    )


RAW = r"""raw AS (SELECT 'u' || ((doc_id // 40) % 7) AS owner_id, doc_id // 40 AS paper_id, doc_id AS row_order, 'q' || doc_id AS id, text AS question_text, CASE WHEN doc_id % 3 > 0 THEN (doc_id % 40 + 1)::INT END AS no, (row_number() OVER (PARTITION BY doc_id // 40 ORDER BY doc_id))::INT AS place,
 CASE WHEN doc_id % 4 = 2 THEN 2.5 END::DOUBLE AS marks, doc_id % 5 = 0 AS has_figure, CASE WHEN doc_id % 6 = 0 THEN 'optics' END AS topic FROM documents)"""


def normalized_questions(spark, d):
    out = R.normalized_questions(_raw_questions(spark, d))
    return out.select("owner_id", "paper_id", "row_order", "question_no", "marks", "has_figure", "topic", T.letters(F.col("question_text")).alias("letters"))


NORMALIZED = rf"""WITH {RAW} SELECT owner_id, paper_id, row_order, coalesce(no, place) AS question_no, marks, has_figure, topic, length(regexp_replace(question_text, '[^A-Za-z]', '', 'g'))::INT AS letters FROM raw WHERE regexp_matches(regexp_replace(question_text, '[\x{{0900}}-\x{{097F}}§$©¶|~<>^&•`]', ' ', 'g'), '\S')"""


def _paper_rows(spark, d):
    q = written(R.normalized_questions(_raw_questions(spark, d)), "normalized").select("*", F.concat(F.lit("q"), F.col("row_order").cast("string")).alias("id"), F.when(F.col("row_order") % 3 == 0, "Low").when(F.col("row_order") % 3 == 1, "hard").alias("difficulty_level"), F.create_map(F.lit("totalQuestions"), (F.col("row_order") % 3).cast("string"), F.lit("set"), F.when(F.col("row_order") % 2 == 0, "2").otherwise("")).alias("metadata"))
    labels = F.array(*[F.lit(x) for x in ("Final exam", "Model exam", "Mock", "Others")])
    p = q.select("owner_id", "paper_id").distinct().select("owner_id", "paper_id", (F.col("paper_id") % 4).cast("string").alias("class_id"), F.get(labels, (F.col("paper_id") % 4).cast("int")).alias("paper_source"), (2000 + F.col("paper_id") % 20).alias("year"))
    return R.bank_rows_of_papers(q, p)


def bank_rows_of_papers(spark, d):
    return _paper_rows(spark, d).select("owner_id", "id", "origin_type", "material_id", "question_paper_id", "class_id", "question_no", "marks", "difficulty_level", "source", "year", "topic", "extracted_by", "metadata")


PAPER_ROWS = rf"""WITH {RAW} SELECT owner_id, id, 'question_paper' AS origin_type, NULL::VARCHAR AS material_id, paper_id::VARCHAR AS question_paper_id, (paper_id % 4)::VARCHAR AS class_id, coalesce(no, place) AS question_no, marks::DECIMAL(10,2) AS marks, CASE WHEN row_order % 3 = 0 THEN 'Low' ELSE 'not Rated' END AS difficulty_level,
 ['Final exam', 'Model exam', 'Others', 'Others'][paper_id % 4 + 1] AS source, (2000 + paper_id % 20)::INT AS year, topic, 'manual' AS extracted_by,
 '{{' || concat_ws(',', CASE WHEN row_order % 3 > 0 THEN '"totalQuestions":' || (row_order % 3) END, CASE WHEN row_order % 2 = 0 THEN '"set":"2"' END) || '}}' AS metadata FROM raw WHERE regexp_matches(regexp_replace(question_text, '[\x{{0900}}-\x{{097F}}§$©¶|~<>^&•`]', ' ', 'g'), '\S')"""


def bank_rows_of_materials(spark, d):
    i = F.col("row_order")
    q = R.normalized_questions(_raw_questions(spark, d)).select((i % 50).alias("material_id"), F.concat(F.lit("u"), (i % 50 % 7).cast("string")).alias("owner_id"), "row_order", F.concat(F.lit("q"), i.cast("string")).alias("id"), F.when(i % 2 == 0, F.lit(7)).alias("question_no"), "question_text", "marks", F.when(i % 3 == 0, 40).alias("chapter_confidence"))
    out = R.bank_rows_of_materials(q, src.materials(spark, d))
    return out.select("owner_id", "id", "origin_type", "material_id", "question_paper_id", "class_id", "unit_id", "chapter_id", "chapter_name", "chapter_confidence", "question_no", "source", "year")


MATERIAL_ROWS = rf"""WITH {RAW}, {MATERIALS}, q AS (SELECT *, row_order % 50 AS mid, (row_number() OVER (PARTITION BY row_order % 50 ORDER BY row_order))::INT AS p FROM raw WHERE regexp_matches(regexp_replace(question_text, '[\x{{0900}}-\x{{097F}}§$©¶|~<>^&•`]', ' ', 'g'), '\S'))
SELECT m.owner_id, id, 'material' AS origin_type, mid::VARCHAR AS material_id, NULL::VARCHAR AS question_paper_id, class_id, unit_id, chapter_id, chapter_name, (CASE WHEN row_order % 3 = 0 THEN 40 ELSE 100 END)::INT AS chapter_confidence, CASE WHEN row_order % 2 = 0 THEN 7 ELSE p END::INT AS question_no,
 CASE exam_source WHEN 'Test' THEN 'Test' WHEN 'Public exam' THEN 'Others' ELSE 'Class work' END AS source, NULL::INT AS year FROM q JOIN mat m ON m.material_id = mid AND m.owner_id = 'u' || (mid % 7)"""


def bank_question_shapes(spark, d):
    rows = _paper_rows(spark, d).withColumn("extracted_by", F.when(F.col("question_no") % 2 == 0, "").otherwise(F.col("extracted_by"))).withColumn("metadata", F.when(F.col("question_no") % 3 == 0, "[1]").otherwise(F.col("metadata")))
    out = R.bank_questions(rows)
    return out.select("owner_id", "id", "question_no", "marks", "topic", "solution", "extracted_by", F.col("metadata")["set"].alias("set"))


SHAPES = rf"""WITH {RAW}, q AS (SELECT *, coalesce(no, place) AS question_no FROM raw WHERE regexp_matches(regexp_replace(question_text, '[\x{{0900}}-\x{{097F}}§$©¶|~<>^&•`]', ' ', 'g'), '\S'))
SELECT owner_id, id, question_no, marks, topic, NULL::VARCHAR AS solution, CASE WHEN question_no % 2 = 0 THEN 'existing' ELSE 'manual' END AS extracted_by, CASE WHEN question_no % 3 > 0 AND row_order % 2 = 0 THEN '2' END AS set FROM q"""


def _classified(spark, d):
    i = F.col("doc_id")
    q = src.read(spark, d, "documents").select(F.concat(F.lit("u"), (i % 7).cast("string")).alias("owner_id"), F.when(i % 10 > 0, F.concat(F.lit("q"), i.cast("string"))).alias("question_id"), F.when(i % 4 > 0, F.concat(F.lit("c"), (i % 9).cast("string"))).alias("chapter_id"), F.when(i % 3 == 0, (i % 17) / F.lit(10.0)).alias("confidence"), F.when(i % 5 > 0, (i % 100).cast("int")).alias("chapter_confidence"), F.when(i % 8 == 1, "SUGGEST_REVIEW").alias("review_status"))
    return R.classification_rows(q, F.lit("HEURISTIC_FALLBACK")).drop("alternatives")


def classification_rows(spark, d):
    return _classified(spark, d).withColumn("confidence", F.col("confidence").cast("double"))


CLASSIFIED = """c AS (SELECT 'u' || (doc_id % 7) AS owner_id, 'q' || doc_id AS question_id, 'c' || (doc_id % 9) AS chapter_id, coalesce(CASE WHEN doc_id % 3 = 0 THEN (doc_id % 17) / 10.0::DOUBLE END, CASE WHEN doc_id % 5 > 0 THEN (doc_id % 100) / 100.0::DOUBLE END, 0.5) AS x, doc_id FROM documents WHERE doc_id % 10 > 0 AND doc_id % 4 > 0),
 rows_ AS (SELECT owner_id, question_id, chapter_id, greatest(0, least(1, x))::DECIMAL(4,3)::DOUBLE AS confidence, CASE WHEN doc_id % 8 = 1 THEN 'SUGGEST_REVIEW' WHEN x >= .85 THEN 'AUTO_APPROVED' WHEN x >= .6 THEN 'SUGGEST_REVIEW' ELSE 'MANUAL_REVIEW_REQUIRED' END AS review_status, 'HEURISTIC_FALLBACK' AS classification_source, doc_id FROM c)"""


def upserted_classifications(spark, d):
    rows = _classified(spark, d)
    base = rows.where(F.xxhash64("question_id") % 2 == 0).withColumn("chapter_id", F.lit("old")).unionByName(spark.range(3).select(F.lit("u0").alias("owner_id"), F.concat(F.lit("x"), F.col("id").cast("string")).alias("question_id"), F.lit("kept").alias("chapter_id"), F.lit(0.5).cast("decimal(4,3)").alias("confidence"), F.lit("SUGGEST_REVIEW").alias("review_status"), F.lit("AI_RERANK").alias("classification_source")))
    put = rows.withColumn("confidence", F.col("confidence").cast("double") * 3 - 1)
    return R.upsert_classifications(base, put).withColumn("confidence", F.round(F.col("confidence").cast("double"), 3))


UPSERTED = f"WITH {CLASSIFIED} SELECT owner_id, question_id, chapter_id, round(greatest(0, least(1, confidence * 3 - 1)), 3) AS confidence, review_status, classification_source FROM rows_ UNION ALL SELECT 'u0', 'x' || i, 'kept', 0.5, 'SUGGEST_REVIEW', 'AI_RERANK' FROM range(3) t(i)"


def edited_bank(spark, d):
    """Ratings, a teacher's choice of chapters, and names, put into bank rows and classifications."""
    b = src.full_bank(spark, d).dropDuplicates(["owner_id", "id"]).select("owner_id", "id", "chapter_id", "unit_id", F.lit("not Rated").alias("difficulty_level"), F.lit("Old").alias("chapter_name"), F.lit(10).alias("chapter_confidence"), "question_no", F.col("question_text").alias("name"))
    levels = b.select("owner_id", "id", F.when(F.col("question_no") == 1, "High").otherwise("Extreme").alias("difficulty_level"))
    names = b.where("question_no <= 2").select("owner_id", "id", F.when(F.col("question_no") == 1, "  New name ").otherwise("  ").alias("name"))
    cls = b.where("question_no >= 3").select("owner_id", F.col("id").alias("question_id"), "chapter_id", F.lit(0.4).cast("decimal(4,3)").alias("confidence"), F.array(F.lit("c1")).alias("alternatives"), F.lit("MANUAL_REVIEW_REQUIRED").alias("review_status"), F.lit("AI_RERANK").alias("classification_source"))
    choices = b.where("question_no = 3 or question_no = 2").select("owner_id", F.col("id").alias("question_id"), F.lit("c99").alias("chapter_id"), F.lit("Chosen").alias("chapter_name"), F.lit("n9").alias("unit_id"))
    out, kinds = R.override_chapters(R.rename(R.rate_questions(b, levels), names), cls, choices)
    k = kinds.select("owner_id", F.col("question_id").alias("id"), F.col("confidence").cast("double").alias("confidence"), F.size(F.coalesce("alternatives", F.array())).alias("n_alternatives"), "classification_source")
    return out.join(k, ["owner_id", "id"], "left").select("owner_id", "id", "difficulty_level", "name", "chapter_id", "chapter_name", "unit_id", "chapter_confidence", "confidence", "n_alternatives", "classification_source")


EDITED = f"""WITH {FULL}, b AS (SELECT DISTINCT ON (owner_id, id) * FROM full_bank)
SELECT owner_id, id, CASE WHEN question_no = 1 THEN 'High' ELSE 'not Rated' END AS difficulty_level, CASE WHEN question_no = 1 THEN 'New name' ELSE question_text END AS name, CASE WHEN question_no IN (2, 3) THEN 'c99' ELSE chapter_id END AS chapter_id, CASE WHEN question_no IN (2, 3) THEN 'Chosen' ELSE 'Old' END AS chapter_name, CASE WHEN question_no IN (2, 3) THEN 'n9' ELSE unit_id END AS unit_id,
 CASE WHEN question_no IN (2, 3) THEN 100 ELSE 10 END AS chapter_confidence, CASE WHEN question_no IN (2, 3) THEN 1 WHEN question_no >= 3 THEN 0.4 END::DOUBLE AS confidence, CASE WHEN question_no = 2 THEN 0 WHEN question_no >= 3 THEN 1 END::INT AS n_alternatives, CASE WHEN question_no IN (2, 3) THEN 'MANUAL_OVERRIDE' WHEN question_no >= 3 THEN 'AI_RERANK' END AS classification_source FROM b"""


def persisted_bank(spark, d):
    """A run's bank rows and classifications written: touched papers replaced, vanished rows and their classifications gone."""
    b = src.full_bank(spark, d).where("question_paper_id is not null").select("owner_id", "id", "question_paper_id", "question_no", "topic")
    b = written(b.dropDuplicates(["owner_id", "id"]), "bank")
    cls = b.select("owner_id", F.col("id").alias("question_id"), F.lit("old").alias("chapter_id"), F.lit(0.5).cast("decimal(4,3)").alias("confidence"))
    new = b.where("question_no <= 3 and owner_id in ('u1', 'u2')").withColumn("topic", F.lit("new"))
    rows = new.where("question_no = 1").select("owner_id", F.col("id").alias("question_id"), F.lit("set").alias("chapter_id"), F.lit(0.9).alias("confidence"))
    kept, k = R.persist_bank_rows(b, cls, new, rows)
    k = k.select("owner_id", F.col("question_id").alias("id"), F.col("chapter_id").alias("classified"))
    return kept.join(k, ["owner_id", "id"], "left").select("owner_id", "id", "topic", "classified")


PERSISTED = f"""WITH {FULL}, b AS (SELECT DISTINCT ON (owner_id, id) * FROM full_bank WHERE question_paper_id IS NOT NULL), n AS (SELECT * FROM b WHERE question_no <= 3 AND owner_id IN ('u1', 'u2'))
SELECT owner_id, id, CASE WHEN t THEN 'new' ELSE topic END AS topic, CASE WHEN t AND question_no = 1 THEN 'set' ELSE 'old' END AS classified FROM (SELECT *, (owner_id, question_paper_id) IN (SELECT (owner_id, question_paper_id) FROM n) AS t FROM b) WHERE NOT t OR question_no <= 3"""


def stored_values(spark, d):
    """Embeddings as JSON read back, section rules under several keys, escapes repaired."""
    v = src.read(spark, d, "embeddings")
    i = F.col("vec_id")
    raw = F.when(i % 5 == 0, "[]").when(i % 5 == 1, "no list").when(i % 5 == 2, F.lit(None)).otherwise(F.to_json(F.slice("embedding", 1, 3)))
    n = i.cast("string")
    rules = F.array(F.create_map(F.lit("from"), F.lit("1"), F.lit("to"), (i % 7).cast("string"), F.lit("marks"), F.lit("2"), F.lit("section"), F.lit("A")), F.create_map(F.lit("questionFrom"), F.lit("3"), F.lit("end"), n, F.lit("mark"), F.when(i % 3 == 0, "x").otherwise("1.5")))
    out = v.select("vec_id", F.size(R.parse_embedding(raw)).alias("n_floats"), R.section_rules(rules).alias("rules"), T.repair_escapes(F.concat(F.lit("\\upsilon \\u00e9 \\u12"), n)).alias("escaped"))
    return out.select("vec_id", F.when(F.col("n_floats") > 0, F.col("n_floats")).alias("n_floats"), F.size("rules").alias("n_rules"), F.aggregate("rules", F.lit(0.0), lambda a, r: a + r["marks"]).alias("marks"), F.try_element_at("rules", F.lit(-1))["to"].alias("last_to"), "escaped")


STORED = r"""SELECT vec_id, CASE WHEN vec_id % 5 > 2 THEN 3 END::INT AS n_floats, (a::INT + b::INT)::INT AS n_rules, (CASE WHEN a THEN 2 ELSE 0 END + CASE WHEN b THEN 1.5 ELSE 0 END)::DOUBLE AS marks, CASE WHEN b THEN vec_id WHEN a THEN vec_id % 7 END::INT AS last_to,
 '\\upsilon \u00e9 ' || CASE WHEN regexp_matches('12' || vec_id, '^[0-9]{4}') THEN '\u12' ELSE '\\u12' END || vec_id AS escaped FROM (SELECT vec_id, vec_id % 7 >= 1 AS a, vec_id >= 3 AND vec_id % 3 > 0 AS b FROM embeddings)"""


# --- expected counts --------------------------------------------------------------------------


def _said(spark, d):
    """Texts as questions whose papers say their totals in different ways: in metadata, in instructions, by rules, by marks or not at all."""
    t, i, p = src.text_bank(spark, d), F.col("row_order"), F.col("paper_id") % 8
    n = (20 + F.col("paper_id") % 14).cast("int")
    told = F.when(p == 1, F.concat(F.lit("This question paper contains "), n.cast("string"), F.lit(" questions. Maximum Marks: 70"))).when(p == 2, F.concat(F.lit("There are "), n.cast("string"), F.lit(" questions. Total marks - 80")))
    rules = F.when(p.isin(3, 4), F.array(F.struct(F.lit(1).alias("from"), F.lit(10).alias("to"), F.lit("A").alias("section"), F.lit(1).alias("marks")), F.struct(F.lit(11).alias("from"), F.when(p == 3, 40).otherwise(12).alias("to"), F.lit("B").alias("section"), F.lit(2).alias("marks"))))
    marks = F.when(p == 5, T.default_marks(F.col("question_no"))).when(p == 6, F.lit(3)).cast("double")
    late = i % 40 >= 3
    return t.select(
        "paper_id", "row_order", "question_no", marks.alias("marks"), F.when((p == 0) & late, n).alias("total_questions"), F.when((p == 0) & late & (i % 40 >= 5), F.lit(90)).alias("total_marks"), F.when(late, told).otherwise(F.when(p < 3, "  ")).alias("instructions"),
        F.when(late, rules).alias("rules"),
    )


def expected_counts(spark, d):
    return X.expected_counts(_said(spark, d))


EXPECTED = f"""WITH {TEXTS}, r AS (SELECT *, paper_id % 8 AS p, (20 + paper_id % 14)::INT AS n FROM texts), g AS (SELECT paper_id, p, n, count(*) AS rows_, bool_or(row_order % 40 >= 3) AS late, bool_or(row_order % 40 >= 5) AS later, max(question_no) AS mx, count(DISTINCT question_no) AS nd, count(*) FILTER (question_no <= 33) AS ch FROM r GROUP BY ALL),
e AS (SELECT *, CASE WHEN p <= 2 AND late THEN n WHEN p = 5 AND rows_ >= 16 AND ch >= 15 THEN 33 WHEN p = 6 AND rows_ >= 16 AND ch >= 15 AND (SELECT count(*) FILTER (question_no BETWEEN 22 AND 28) FROM texts t WHERE t.paper_id = g.paper_id) / ch >= .65 THEN 33 WHEN p = 3 AND late AND mx <= 40 THEN 40 WHEN p = 4 AND late AND mx <= 12 THEN 12 WHEN nd >= 16 THEN 33 END::INT AS c FROM g)
SELECT paper_id, c AS expected_count, (CASE WHEN p = 0 AND later THEN 90 WHEN p = 1 AND late THEN 70 WHEN p = 2 AND late THEN 80 WHEN p IN (3, 4) AND late THEN CASE WHEN c <= 40 AND p = 3 THEN least(c, 10) + 2 * greatest(c - 10, 0) WHEN p = 4 AND c <= 12 THEN least(c, 10) + 2 * greatest(c - 10, 0) END WHEN c = 33 THEN 70 END)::DOUBLE AS expected_marks FROM e"""


def last_paper_meta(spark, d):
    m = X.paper_meta(_said(spark, d).withColumn("total_questions", F.when(F.col("row_order") % 3 == 0, F.col("row_order").cast("int"))), last=True)
    return m.select("paper_id", "total_questions", "total_marks", F.length("instructions").alias("n_chars"), F.coalesce(F.size(F.coalesce("rules", F.array().cast("array<struct<from:int,to:int,section:string,marks:int>>"))), F.lit(0)).alias("n_rules"))


LAST_META = f"""WITH {TEXTS}, r AS (SELECT *, paper_id % 8 AS p FROM texts) SELECT paper_id, max(row_order) FILTER (row_order % 3 = 0 AND row_order >= 1)::INT AS total_questions, max(90) FILTER (p = 0 AND row_order % 40 >= 5) AS total_marks,
 CASE WHEN bool_or(row_order % 40 >= 3) THEN CASE p WHEN 1 THEN length('This question paper contains 20 questions. Maximum Marks: 70') WHEN 2 THEN length('There are 20 questions. Total marks - 80') END END::INT AS n_chars, CASE WHEN p IN (3, 4) AND bool_or(row_order % 40 >= 3) THEN 2 ELSE 0 END::INT AS n_rules FROM r GROUP BY paper_id, p"""


def stamped_totals(spark, d):
    rows = _said(spark, d)
    e = src.text_bank(spark, d).select("paper_id").distinct().select("paper_id", F.when(F.col("paper_id") % 3 > 0, (F.col("paper_id") % 3 * 10).cast("int")).otherwise(0).alias("expected_count"))
    return X.stamp_totals(rows, e).select("paper_id", "row_order", "total_questions")


STAMPED = f"WITH {TEXTS} SELECT paper_id, row_order, CASE WHEN paper_id % 3 > 0 THEN paper_id % 3 * 10 WHEN paper_id % 8 = 0 AND row_order % 40 >= 3 THEN 20 + paper_id % 14 END::INT AS total_questions FROM texts"

QUERIES = {
    "bank_searches": (bank_searches, BANK_SEARCHES),
    "materials_lists": (materials_lists, MATERIALS_LISTS),
    "paper_lists": (paper_lists, PAPER_LISTS),
    "catalog_scan": (catalog_scan, CATALOG_SCAN),
    "knowledge_states": (knowledge_states, KNOWLEDGE_STATES),
    "concept_lists": (concept_lists, CONCEPT_LISTS),
    "bank_row_counts": (bank_row_counts, BANK_ROW_COUNTS),
    "chapter_questions": (chapter_questions, CHAPTER_QUESTIONS),
    "practice_places": (practice_places, PRACTICE_PLACES),
    "set_places": (set_places, SET_PLACES),
    "best_per_number": (best_per_number, BEST_PER_NUMBER),
    "id_union": (id_union, ID_UNION),
    "replaced_numbers": (replaced_numbers, REPLACED),
    "usage_summaries": (usage_summaries, USAGE_SUMMARIES),
    "usage_by_owner": (usage_by_owner, USAGE_BY_OWNER),
    "usage_events_to_append": (usage_events_to_append, TO_APPEND),
    "token_counts": (token_counts, TOKENS),
    "normalized_questions": (normalized_questions, NORMALIZED),
    "bank_rows_of_papers": (bank_rows_of_papers, PAPER_ROWS),
    "bank_rows_of_materials": (bank_rows_of_materials, MATERIAL_ROWS),
    "bank_question_shapes": (bank_question_shapes, SHAPES),
    "classification_rows": (classification_rows, f"WITH {CLASSIFIED} SELECT owner_id, question_id, chapter_id, confidence, review_status, classification_source FROM rows_"),
    "upserted_classifications": (upserted_classifications, UPSERTED),
    "edited_bank": (edited_bank, EDITED),
    "persisted_bank": (persisted_bank, PERSISTED),
    "stored_values": (stored_values, STORED),
    "expected_counts": (expected_counts, EXPECTED),
    "last_paper_meta": (last_paper_meta, LAST_META),
    "stamped_totals": (stamped_totals, STAMPED),
}
