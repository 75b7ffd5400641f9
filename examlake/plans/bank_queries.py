"""Registered queries over the question bank, each with its DuckDB oracle."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from examlake.functions import text as T
from examlake.operators import bank as ops
from examlake.operators import catalog, usage, vectors
from examlake.sources import tables as src
from examlake.streaming.usage import daily_usage

PAPERS = "papers AS (SELECT 'u' || (o_custkey % 7) AS owner_id, o_orderkey AS paper_id, o_orderstatus AS class_id, year(o_orderdate) AS year, o_orderpriority AS paper_source, (4 + o_orderkey % 4)::INT AS expected_count, o_orderdate AS stored_at FROM orders)"
BANK = "bank AS (SELECT l_orderkey AS paper_id, l_linenumber AS question_no, l_quantity::DECIMAL(10,2) AS marks, l_partkey AS chapter_id, l_suppkey AS material_id, 'Question ' || repeat('a', (l_suppkey % 9)::INT) AS question_text, l_partkey * 100000 + l_suppkey AS row_order FROM lineitem)"
TEXTS = "texts AS (SELECT doc_id // 40 AS paper_id, doc_id AS row_order, (1 + doc_id * doc_id % 37)::INT AS question_no, text AS question_text FROM documents)"
USAGE = "usage AS (SELECT event_id, 'u' || (user_id % 7) AS owner_id, ['gpt-4o', 'gpt-4o-mini', 'text-embedding-3-small', 'gpt-4o-mini-2024', 'gpt-4o-2024', 'other-embedding', 'unknown'][event_id % 7 + 1] AS model, user_id AS job_id, event_type AS action, floor(abs(value))::BIGINT * 100 AS prompt_tokens, floor(abs(value))::BIGINT AS completion_tokens, ts AS created_at FROM events)"
_RANGES = "coalesce((SELECT string_agg(CASE WHEN a = b THEN a::VARCHAR ELSE a || '-' || b END, ', ' ORDER BY a) FROM (SELECT min(x) AS a, max(x) AS b FROM (SELECT x, x - row_number() OVER (ORDER BY x) AS g FROM (SELECT unnest({}) AS x)) GROUP BY g)), '')"


def _reports(spark, d, bank=None):
    return ops.quality_report(src.papers(spark, d).drop("owner_id"), src.bank(spark, d) if bank is None else bank)


def quality_report(spark, d):
    return _reports(spark, d).drop("expected_marks").withColumn("issues", F.array_join("issues", "; "))


QUALITY = f"""WITH {PAPERS}, {BANK}, best AS (SELECT *, count(*) OVER (PARTITION BY paper_id, question_no) AS n, row_number() OVER (PARTITION BY paper_id, question_no ORDER BY length(trim(question_text)) DESC, row_order, marks DESC) AS rn FROM bank),
per AS (SELECT paper_id, sum(n) AS row_count, list(question_no ORDER BY question_no) FILTER (question_no >= 1) AS numbers, list(question_no ORDER BY question_no) FILTER (question_no >= 1 AND n > 1) AS dup,
  sum(marks) FILTER (question_no >= 1 AND marks > 0) AS ms, count(*) FILTER (question_no >= 1 AND marks > 0) AS wm FROM best WHERE rn = 1 GROUP BY paper_id),
j AS (SELECT p.paper_id, expected_count, coalesce(row_count, 0)::BIGINT AS row_count, coalesce(numbers, []) AS numbers, coalesce(dup, []) AS dup, coalesce(ms, 0)::DECIMAL(20,2) AS ms, coalesce(wm, 0)::INT AS wm FROM papers p LEFT JOIN per USING (paper_id)),
x AS (SELECT *, list_filter(range(1, expected_count + 1), lambda v: NOT list_contains(numbers, v::INT)) AS miss, list_filter(numbers, lambda v: v > expected_count) AS ext FROM j),
runs AS (SELECT paper_id, kind, string_agg(CASE WHEN a = b THEN a::VARCHAR ELSE a || '-' || b END, ', ' ORDER BY a) AS s FROM (
  SELECT paper_id, kind, min(v) AS a, max(v) AS b FROM (SELECT paper_id, kind, v, v - row_number() OVER (PARTITION BY paper_id, kind ORDER BY v) AS g FROM (
    SELECT paper_id, 'm' AS kind, unnest(miss) AS v FROM x UNION ALL SELECT paper_id, 'd', unnest(dup) FROM x UNION ALL SELECT paper_id, 'e', unnest(ext) FROM x)) GROUP BY paper_id, kind, g) GROUP BY paper_id, kind)
SELECT x.paper_id, expected_count, row_count, len(numbers)::INT AS extracted, coalesce(m.s, '') AS missing, coalesce(q.s, '') AS duplicates, coalesce(e.s, '') AS extra, ms AS marks_sum, len(numbers)::INT - wm AS without_marks,
 CASE WHEN row_count = 0 THEN 'no questions yet' ELSE concat_ws('; ', CASE WHEN len(numbers) <> expected_count THEN len(numbers) || ' of ' || expected_count || ' questions found' END, 'missing: ' || m.s, 'repeated: ' || q.s, 'beyond the last number: ' || e.s, CASE WHEN len(numbers) > wm THEN (len(numbers) - wm) || ' without marks' END) END AS issues,
 CASE WHEN row_count = 0 THEN 'Not Extracted' WHEN len(numbers) = 0 THEN 'Failed' WHEN m.s IS NULL AND q.s IS NULL AND e.s IS NULL AND len(numbers) = wm THEN 'Passed' ELSE 'Needs Review' END AS status
FROM x LEFT JOIN runs m ON m.paper_id = x.paper_id AND m.kind = 'm' LEFT JOIN runs q ON q.paper_id = x.paper_id AND q.kind = 'd' LEFT JOIN runs e ON e.paper_id = x.paper_id AND e.kind = 'e'"""


def catalog_index(spark, d):
    r, n, c = (src.read(spark, d, t) for t in ("region", "nation", "customer"))
    units = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("id"), F.col("n_regionkey").alias("class_id"), F.col("r_name").alias("name"), F.col("n_name").alias("title"))
    index = catalog.chapter_index(r.select(F.col("r_regionkey").alias("id")), units, c.select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("unit_id"), F.col("c_name").alias("name")))
    return index.select("chapter_id", "unit_id", "name", "unit_name")


def bank_search(spark, d):
    j = src.bank(spark, d).join(src.papers(spark, d), "paper_id").where("owner_id = 'u3' AND year >= 1995 AND paper_source = '1-URGENT'")
    return j.select("paper_id", "question_no", "year", "marks").orderBy(F.desc_nulls_last("year"), F.asc_nulls_last("question_no"))


def section_marks(spark, d):
    t = src.text_bank(spark, d)
    return t.select("row_order", "question_no", T.default_marks(F.col("question_no")).alias("marks"))


def paper_meta(spark, d):
    t = src.text_bank(spark, d)
    return t.groupBy("paper_id").agg(F.max("question_no").alias("max_no"), F.countDistinct("question_no").alias("distinct_no"), F.count_if(F.col("question_no") > 33).alias("above_33"), F.sum(T.default_marks(F.col("question_no"))).alias("marks_total"))


def longest_per_number(spark, d):
    t = src.text_bank(spark, d).withColumn("n", F.length(F.trim("question_text")))
    w = Window.partitionBy("paper_id", "question_no").orderBy(F.desc("n"), "row_order")
    return t.withColumn("rn", F.row_number().over(w)).where("rn = 1").select("paper_id", "question_no", "row_order", "n")


def english_text(spark, d):
    c = T.english_only(F.col("question_text"))
    return src.text_bank(spark, d).select("row_order", c.alias("clean"), T.letters(c).alias("letters"))


def accepted_text(spark, d):
    t = F.col("question_text")
    return src.text_bank(spark, d).select("row_order", T.accepts_model_text(t).alias("model_ok"), (F.length(F.trim(t)) >= 12).alias("long_enough"), T.accepts_plain_text(t).alias("plain_ok"), T.disallowed(t).alias("n_disallowed"), F.round(T.readability(t), 6).alias("readability"))


def word_sets(spark, d):
    return src.text_bank(spark, d).select("row_order", F.size(T.key_words(F.col("question_text"))).alias("n_words"), F.md5(T.comparable(F.col("question_text"))).alias("norm_md5"))


def near_duplicates_in_papers(spark, d):
    return ops.near_duplicate_pairs(src.text_bank(spark, d))


NEAR = """WITH {texts}, w AS (SELECT paper_id, row_order, list_sort(list_distinct(list_filter(string_split({norm}, ' '), lambda w: length(w) > 3))) AS s FROM texts),
c AS (SELECT *, min(row_order) OVER (PARTITION BY paper_id, s) AS rep FROM w WHERE len(s) > 0), r AS (SELECT * FROM c WHERE row_order = rep)
SELECT paper_id, rep AS row_a, row_order AS row_b, 'copy' AS kind FROM c WHERE row_order > rep
UNION ALL SELECT a.paper_id, a.rep, b.rep, 'like' FROM r a JOIN r b ON a.paper_id = b.paper_id AND a.rep < b.rep WHERE len(list_intersect(a.s, b.s)) >= .72 * (len(a.s) + len(b.s) - len(list_intersect(a.s, b.s)))"""


def usage_rollup(spark, d):
    return usage.usage_rollup(src.usage_events(spark, d))


def usage_by_action_30_days(spark, d):
    e = src.usage_events(spark, d)
    top = e.agg(F.max("created_at").alias("now"))
    return e.join(F.broadcast(top), F.lit(True)).where(F.col("created_at") > F.col("now") - F.expr("interval 30 days")).groupBy("action").agg(F.count(F.lit(1)).alias("calls"), F.sum("prompt_tokens").alias("prompt_tokens")).orderBy(F.desc("prompt_tokens"), "action")


def usage_by_day(spark, d):
    return daily_usage(src.usage_events(spark, d)).select(F.date_format("day", "yyyy-MM-dd").alias("day"), "owner_id", "action", "calls", "prompt_tokens")


def latest_job(spark, d):
    e = src.usage_events(spark, d)
    return ops.latest(e, "job_id", [F.desc("created_at"), F.desc("event_id")]).select("job_id", "event_id", "action")


def papers_to_reprocess(spark, d):
    return ops.papers_to_reprocess(src.papers(spark, d), src.bank(spark, d), 3)


def repair_set(spark, d):
    p = src.papers(spark, d).select("paper_id", F.when(F.col("paper_id") % 6 > 0, F.lit(7)).otherwise(0).alias("expected_count"))
    rows = src.bank(spark, d).withColumn("question_no", F.col("question_no") + F.when(F.col("question_no") == 6, 11).otherwise(0))
    return ops.repair_set(rows.withColumn("question_text", F.repeat("question_text", 60)), p)


def _updates(spark, d):
    return src.papers(spark, d).where("paper_id % 5 = 0").select("paper_id", F.lit("edited").alias("paper_source")).unionByName(spark.range(3).select((-1 - F.col("id")).alias("paper_id"), F.lit("new").alias("paper_source")))


def upsert_papers(spark, d):
    return ops.upsert(src.papers(spark, d).select("paper_id", "paper_source"), _updates(spark, d), ["paper_id"])


def persist_questions(spark, d):
    b = src.bank(spark, d).groupBy("paper_id", "question_no").agg(F.max("marks").alias("marks"))
    new = b.where("paper_id % 3 = 0 AND question_no <= 2").withColumn("marks", F.lit(1).cast("decimal(10,2)"))
    return ops.persist_questions(b, new, "paper_id", ["paper_id", "question_no"])


def cascade_delete(spark, d):
    gone = src.papers(spark, d).where("year < 1995").select("paper_id")
    return ops.cascade_delete(gone, "paper_id", [src.bank(spark, d)])[0].groupBy("paper_id").agg(F.count(F.lit(1)).alias("n"))


def edited_papers(spark, d):
    e = src.papers(spark, d).where("paper_id % 4 = 1").select("paper_id", F.lit("Model exam").alias("paper_source"))
    return ops.apply_edits(src.papers(spark, d).select("paper_id", "paper_source"), e, ["paper_id"], ["paper_source"])


def constraint_audit(spark, d):
    b, p = src.bank(spark, d), src.papers(spark, d)
    orphan = b.join(p, "paper_id", "left_anti").select("paper_id", F.lit("orphan").alias("rule"))
    double = b.groupBy("paper_id", "question_no").count().where("count > 1").select("paper_id", F.lit("duplicate").alias("rule"))
    high = b.where("marks > 49").select("paper_id", F.lit("marks").alias("rule"))
    return orphan.unionByName(double).unionByName(high).groupBy("paper_id", "rule").agg(F.count(F.lit(1)).alias("n"))


def chapter_counts(spark, d):
    return src.bank(spark, d).groupBy("chapter_id").agg(F.count(F.lit(1)).alias("n"))


def papers_by_class(spark, d):
    p = src.papers(spark, d).groupBy("class_id", "paper_source").agg(F.sort_array(F.collect_set("year"), asc=False).alias("y"), F.count(F.lit(1)).alias("n"))
    return p.select("class_id", "paper_source", F.array_join(F.transform("y", lambda x: x.cast("string")), ",").alias("years"), "n")


def running_positions(spark, d):
    c = src.read(spark, d, "conversations")
    w = Window.partitionBy("conv_id").orderBy("turn")
    back = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return c.select("conv_id", "turn", (F.row_number().over(w) - 1).alias("position"), F.length(F.lag("text").over(w)).alias("previous_chars"), F.floor((F.row_number().over(w) - 1) / 3).cast("int").alias("batch"), (F.row_number().over(back) <= 4).alias("in_last_four"))


def attach_files(spark, d):
    b = src.bank(spark, d).select("material_id", "chapter_id", "paper_id").join(src.papers(spark, d).where("class_id = 'F'").select("paper_id"), "paper_id")
    w = Window.partitionBy("material_id").orderBy("chapter_id", "paper_id")
    return b.withColumn("rn", F.row_number().over(w)).where("rn = 1").select("material_id", "chapter_id")


def merged_catalog(spark, d):
    local = src.read(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name")).where("id < 15")
    remote = src.read(spark, d, "nation").where("n_nationkey > 8").select(F.col("n_nationkey").alias("id"), F.lower("n_name").alias("name"))
    return catalog.merge_remote(local, remote, ["id"])


def merged_papers(spark, d):
    """Papers of a device and of the server: the server's fields win, names given on the device stay."""
    p = src.papers(spark, d)
    name = F.concat(F.lit("Paper "), F.col("paper_id").cast("string"))
    local = p.where("paper_id % 3 < 2").select("owner_id", "paper_id", F.lit(1990).alias("year"), F.when(F.col("paper_id") % 5 > 0, name).alias("name"), F.lit("here").alias("device"))
    remote = p.where("paper_id % 3 > 0").select("owner_id", "paper_id", F.when(F.col("paper_id") % 7 > 0, F.col("year")).alias("year"), F.lower(name).alias("name"))
    return catalog.merge_remote(local, remote, ["owner_id", "paper_id"], keep_local=("name",))


MERGED_PAPERS = f"""WITH {PAPERS} SELECT owner_id, paper_id, CASE WHEN paper_id % 3 > 0 AND paper_id % 7 > 0 THEN year WHEN paper_id % 3 < 2 THEN 1990 END::INT AS year,
 CASE WHEN paper_id % 3 < 2 AND paper_id % 5 > 0 THEN 'Paper ' || paper_id WHEN paper_id % 3 > 0 THEN 'paper ' || paper_id END AS name, CASE WHEN paper_id % 3 < 2 THEN 'here' END AS device FROM papers"""


def attached_files(spark, d):
    """Materials at chapters that match in class, unit and chapter; a file listed twice is attached once."""
    m = src.materials(spark, d).select((F.col("material_id") % 400).alias("file_id"), "class_id", "unit_id", "chapter_id", F.col("material_id").alias("row"))
    chapters = src.read(spark, d, "part").where("p_size % 3 > 0").select((F.col("p_size") % 4).alias("class_id"), F.when(F.col("p_size") % 5 > 0, F.col("p_size") % 10).otherwise(99).alias("unit_id"), F.col("p_size").alias("chapter_id"))
    return catalog.attach_files(m, chapters, ["row"])


ATTACHED = "SELECT p_partkey % 400 AS file_id, p_size % 4 AS class_id, p_size % 10 AS unit_id, p_size AS chapter_id, p_partkey AS row FROM part WHERE p_size % 3 > 0 AND p_size % 5 > 0 QUALIFY row_number() OVER (PARTITION BY p_partkey % 400 ORDER BY p_partkey) = 1"


def page_contexts(spark, d):
    """Pages with the page before, in batches of three a paper."""
    c = src.read(spark, d, "conversations").select(F.col("conv_id").alias("paper_id"), F.col("turn").alias("page_no"), "text")
    out = catalog.with_batch_no(catalog.with_previous_page(c), ["paper_id"], ["page_no"], 3)
    return out.select("paper_id", "page_no", F.md5("previous_text").alias("previous"), "batch_no")


CONTEXTS = "SELECT conv_id AS paper_id, turn AS page_no, md5(lag(text) OVER w) AS previous, ((row_number() OVER w - 1) // 3)::INT AS batch_no FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)"


def replaced_children(spark, d):
    """Rows of every fourth paper and of a new one put in place of what those papers had; one paper loses all."""
    b = src.bank(spark, d).select("paper_id", "question_no", "marks")
    p = src.papers(spark, d).where("paper_id % 4 = 0").select("paper_id")
    new = p.where("paper_id > 0").select("paper_id", F.lit(9).alias("question_no"), F.lit(5).cast("decimal(10,2)").alias("marks"))
    return catalog.replace_all(b, [(p, new), (spark.range(1).select(F.lit(1).cast("long").alias("paper_id")), b.limit(0))], ["paper_id"])


CHILDREN = f"WITH {BANK} SELECT paper_id, question_no, marks FROM bank WHERE paper_id <> 1 AND NOT (paper_id % 4 = 0 AND paper_id IN (SELECT o_orderkey FROM orders)) UNION ALL SELECT o_orderkey, 9, 5 FROM orders WHERE o_orderkey % 4 = 0 AND o_orderkey > 0"


def set_operations(spark, d):
    a, b = src.bank(spark, d).where("marks > 40").select("chapter_id"), src.bank(spark, d).where("marks < 5").select("chapter_id")
    return a.intersect(b).select("chapter_id", F.lit("both").alias("kind")).unionByName(a.subtract(b).select("chapter_id", F.lit("first").alias("kind")))


def event_json(spark, d):
    e = src.read(spark, d, "events")
    p = F.try_parse_json("props")
    return e.select("event_id", p.isNotNull().alias("valid"), F.length("props").alias("n"))


def numbered_split(spark, d):
    t = src.read(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("x"))
    composed = F.array_join(F.transform("x", lambda r: F.concat((r["turn"] + 1).cast("string"), F.lit(". "), F.regexp_replace(r["text"], "\n", " "))), "\n")
    parts = F.explode(T.split_numbered(F.lit(1), F.regexp_replace(composed, r"^1\. ", ""))).alias("p")
    return t.select("conv_id", parts).select("conv_id", F.col("p.no").alias("question_no"), F.length("p.text").alias("n"))


def marks_from_text(spark, d):
    t = src.text_bank(spark, d)
    said = F.concat("question_text", F.lit(" ["), F.col("question_no").cast("string"), F.lit(" marks]"))
    return t.select("row_order", T.marks_in_text(said).alias("marks"))


def marks_in_whole_texts(spark, d):
    """Each way of writing marks, and none, behind whole texts."""
    n, way = F.col("question_no").cast("string"), F.col("row_order") % 5
    said = F.when(way == 0, "").when(way == 1, F.concat(F.lit(" ["), n, F.lit(".5 Marks] or so"))).when(way == 2, F.concat(F.lit(" ("), n, F.lit(" mark) [7]"))).when(way == 3, F.concat(F.lit(" "), n, F.lit(" marks\nand a line"))).otherwise(F.concat(F.lit(" ["), n, F.lit("] in all")))
    return src.text_bank(spark, d).select("row_order", T.marks_in_text(F.concat("question_text", said)).alias("marks"))


def review_statuses(spark, d):
    c = T.clamp(F.abs(F.col("value")) / 100, 0, 1)
    return src.read(spark, d, "events").select("event_id", T.review_status(c).alias("status"), T.review_tier(c).alias("tier"), T.percent(c * 100).alias("percent"))


def _classified(v, questions, concepts):
    profiles = v.groupBy("label").agg(F.min_by("e", "vec_id").alias("title_embedding"), F.max_by("e", "vec_id").alias("summary_embedding")).withColumnRenamed("label", "chapter_id")
    rows = questions.select(F.col("vec_id").alias("question_id"), F.col("e").alias("embedding"))
    out = vectors.classify_vector(rows, profiles, scope=[], concept_rows=concepts.select(F.col("label").alias("chapter_id"), F.col("e").alias("concept")))
    return out.select("question_id", "chapter_id", "rank", F.round("confidence", 3).alias("confidence"))


def _vectors(spark, d):
    return src.read(spark, d, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("e"))


def classify_vector(spark, d):
    v = _vectors(spark, d)
    return _classified(v, v, v.where("vec_id % 50 = 0"))


def classify_all_vectors(spark, d):
    """Every embedding, against 30 concepts of each chapter."""
    v = _vectors(spark, d)
    w = Window.partitionBy("label").orderBy("vec_id")
    return _classified(v, v, v.withColumn("n", F.row_number().over(w)).where("n <= 30"))


def classify_in_class(spark, d):
    """Every embedding against the chapters of its class only, the best with its alternatives."""
    v = _vectors(spark, d)
    profiles = v.groupBy("label").agg(F.min_by("e", "vec_id").alias("title_embedding"), F.max_by("e", "vec_id").alias("summary_embedding")).withColumnRenamed("label", "chapter_id").withColumn("class_id", F.col("chapter_id") % 3).withColumn("concepts", F.lit(None).cast("array<array<double>>"))
    rows = v.select(F.col("vec_id").alias("question_id"), (F.col("vec_id") % 3).cast("int").alias("class_id"), F.col("e").alias("embedding"))
    out = ops.best_with_alternatives(vectors.classify_vector(rows, profiles))
    return out.select("question_id", "chapter_id", F.round("confidence", 3).alias("confidence"), "review_status", F.array_join(F.transform("alternatives", lambda a: a["chapter_id"].cast("string")), ",").alias("others"))


IN_CLASS = """WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), p AS (SELECT label, label % 3 AS cls, arg_min(e, vec_id) AS te, arg_max(e, vec_id) AS se FROM v GROUP BY label),
b AS (SELECT q.vec_id AS question_id, p.label AS chapter_id, .15 / .5 * list_cosine_similarity(q.e, te) + .35 / .5 * list_cosine_similarity(q.e, se) AS score FROM v q JOIN p ON q.vec_id % 3 = cls),
r AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chapter_id) AS rank FROM b), k AS (SELECT *, exp((score - max(score) OVER (PARTITION BY question_id)) / .06) AS x FROM r WHERE rank <= 3),
c AS (SELECT *, x / sum(x) OVER (PARTITION BY question_id) AS c FROM k)
SELECT question_id, max(chapter_id) FILTER (rank = 1) AS chapter_id, round(max(c) FILTER (rank = 1), 3) AS confidence, CASE WHEN max(c) FILTER (rank = 1) >= .85 THEN 'AUTO_APPROVED' WHEN max(c) FILTER (rank = 1) >= .6 THEN 'SUGGEST_REVIEW' ELSE 'MANUAL_REVIEW_REQUIRED' END AS review_status,
 coalesce(string_agg(chapter_id::VARCHAR, ',' ORDER BY rank) FILTER (rank > 1), '') AS others FROM c GROUP BY question_id"""
VECTOR = """WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
p AS (SELECT label, arg_min(e, vec_id) AS te, arg_max(e, vec_id) AS se, list(e) FILTER (vec_id % 50 = 0) AS cs FROM v GROUP BY label),
s AS (SELECT q.vec_id AS question_id, p.label AS chapter_id, list_cosine_similarity(q.e, te) AS t, list_cosine_similarity(q.e, se) AS s, list_max(list_transform(cs, lambda c: list_cosine_similarity(q.e, c))) AS c FROM v q, p),
b AS (SELECT *, CASE WHEN c IS NULL THEN .15 / .5 * t + .35 / .5 * s ELSE greatest(.15 * t + .35 * s + .5 * c, .85 * c + .15 * t) END AS score FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chapter_id) AS rank FROM b),
k AS (SELECT *, exp((score - max(score) OVER (PARTITION BY question_id)) / .06) AS x FROM r WHERE rank <= 3)
SELECT question_id, chapter_id, rank::INT AS rank, round(x / sum(x) OVER (PARTITION BY question_id), 3) AS confidence FROM k"""
ALL_VECTORS = VECTOR.replace("FILTER (vec_id % 50 = 0)", "FILTER (n <= 30)").replace(" AS e FROM embeddings", " AS e, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS n FROM embeddings")


def compared_reports(spark, d):
    return ops.compare_reports(_reports(spark, d), _reports(spark, d, src.bank(spark, d).where("question_no <> 3")))


def _report_of(bank: str) -> str:
    inner = QUALITY.replace(BANK, bank, 1)
    return f"SELECT *, NULL AS e FROM ({inner})"


COMPARED = f"""WITH a AS ({_report_of(BANK)}), b AS ({_report_of(BANK.replace("FROM lineitem", "FROM lineitem WHERE l_linenumber <> 3"))})
SELECT paper_id, concat_ws(',', CASE WHEN a.extracted <> b.extracted THEN 'extracted' END, CASE WHEN a.missing <> b.missing THEN 'missing' END, CASE WHEN a.duplicates <> b.duplicates THEN 'duplicates' END, CASE WHEN a.extra <> b.extra THEN 'extra' END,
 CASE WHEN a.marks_sum <> b.marks_sum THEN 'marks_sum' END, CASE WHEN a.status <> b.status THEN 'status' END) AS differs, a.status <> b.status AS status_differs, abs(a.extracted - b.extracted) <= 1 AS acceptable FROM a JOIN b USING (paper_id)"""


def storage_paths(spark, d):
    p = src.read(spark, d, "part")
    return p.select("p_partkey", catalog.storage_path(F.col("p_name"), F.col("p_brand"), id_=F.col("p_partkey")).alias("path"))


def owned_paths(spark, d):
    """Stored paths of all owners, those outside their owner's folder left out."""
    p = src.read(spark, d, "part")
    owner = F.concat(F.lit("u"), (F.col("p_partkey") % 7).cast("string"))
    folder = F.when(F.col("p_partkey") % 5 == 0, "u0").otherwise(owner)
    path = catalog.storage_path(F.concat("p_name", F.lit(" (é).pdf")), folder, (F.col("p_size") % 4).cast("string"), (F.col("p_size") % 10).cast("string"), F.col("p_size").cast("string"), id_=F.col("p_partkey"))
    return catalog.owned_files(p.select(owner.alias("owner_id"), path.alias("path")))


OWNED = "SELECT 'u' || (p_partkey % 7) AS owner_id, 'u' || (p_partkey % 7) || '/' || (p_size % 4) || '/' || (p_size % 10) || '/' || p_size || '/' || p_partkey || '-' || substr(regexp_replace(p_name || ' (é).pdf', '[^a-zA-Z0-9._-]+', '_', 'g'), 1, 80) AS path FROM part WHERE p_partkey % 5 > 0 OR p_partkey % 7 = 0"


_EDGE = "[\\s\\x0b\\x{00a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x{feff}]"
_CLEAN = "list_filter(list_transform(string_split(regexp_replace(regexp_replace(question_text, '[\\x{0900}-\\x{097F}]+', ' ', 'g'), '[§$©¶|~<>^&•`]', ' ', 'g'), chr(10)), lambda x: regexp_replace(regexp_replace(x, '^" + _EDGE + "+|" + _EDGE + "+$', '', 'g'), '[ \\t]+', ' ', 'g')), lambda x: x <> '')"
_NORM = "trim(regexp_replace(regexp_replace(lower(question_text), '[\\s\\x{00a0}\\x{feff}]+', ' ', 'g'), '[^a-z0-9_ ]', '', 'g'))"
_SOLID = "length(regexp_replace(question_text, '[\\s\\x{00a0}\\x{feff}]', '', 'g'))"
_LETTERS = "length(regexp_replace(question_text, '[^A-Za-z]', '', 'g'))"

#: Signs beyond ASCII are notation, except Devanagari and four misread glyphs; those are disallowed. DuckDB's \\s lacks the no-break space.
ACCEPTED = rf"""WITH {TEXTS}, f AS (SELECT row_order, question_text AS t, {_LETTERS} AS l, {_SOLID} AS solid, regexp_matches(question_text, '[^\x20-\x7E\n\r\t\x{{0900}}-\x{{097F}}§©¶]') AS math,
 len(regexp_extract_all(question_text, '[\x{{0900}}-\x{{097F}}§©¶]'))::INT AS n_disallowed, len(regexp_extract_all(question_text, '[A-Za-z]{{2,}}')) AS two, len(regexp_extract_all(question_text, '[A-Za-z]{{3,}}')) AS three,
 len(regexp_extract_all(question_text, '[§$©¶|~<>^&•`]')) AS weird FROM texts), r AS (SELECT *, CASE WHEN solid > 0 THEN l / solid ELSE 0 END AS ratio FROM f), s AS (SELECT *, three * 12 + ratio * 40 - weird * 8 AS score FROM r)
SELECT row_order, length(t) >= 10 AND n_disallowed = 0 AND ratio >= (CASE WHEN math THEN .30 ELSE .45 END) AND two >= 2 AS model_ok, length(trim(t)) >= 12 AS long_enough,
 length(t) >= 12 AND n_disallowed = 0 AND weird = 0 AND ratio >= (CASE WHEN math THEN .35 ELSE .55 END) AND (math OR three >= 2) AND (math OR score >= 18) AS plain_ok, n_disallowed, round(score, 6) AS readability FROM s"""
#: Rates in dollars a million tokens by model; a cost is rounded to six places for each event.
PRICED = """priced AS (SELECT *, round(prompt_tokens::DECIMAL(18,0) * i + completion_tokens::DECIMAL(18,0) * o, 0) AS micros FROM (SELECT *,
 (CASE WHEN model IN ('gpt-4o', 'gpt-4o-2024') THEN 2.5 WHEN model IN ('gpt-4o-mini', 'gpt-4o-mini-2024') THEN 0.15 WHEN model LIKE '%embedding%' THEN 0.02 ELSE 0 END)::DECIMAL(6,2) AS i,
 (CASE WHEN model IN ('gpt-4o', 'gpt-4o-2024') THEN 10 WHEN model IN ('gpt-4o-mini', 'gpt-4o-mini-2024') THEN 0.6 ELSE 0 END)::DECIMAL(6,2) AS o FROM usage))"""
_SUMS = "count(*) AS calls, sum(prompt_tokens)::BIGINT AS prompt_tokens, sum(completion_tokens)::BIGINT AS completion_tokens, sum(prompt_tokens + completion_tokens)::BIGINT AS total_tokens, (sum(micros) / 1000000)::DOUBLE AS cost"
ROLLUP = f"WITH {USAGE}, {PRICED} SELECT owner_id, job_id, action, {_SUMS}, grouping(action) = 1 AS is_total FROM priced GROUP BY GROUPING SETS ((owner_id, job_id, action), (owner_id, job_id))"

MARKS = rf"""WITH {TEXTS}, s AS (SELECT row_order, question_text || CASE row_order % 5 WHEN 0 THEN '' WHEN 1 THEN ' [' || question_no || '.5 Marks] or so' WHEN 2 THEN ' (' || question_no || ' mark) [7]' WHEN 3 THEN ' ' || question_no || ' marks' || chr(10) || 'and a line' ELSE ' [' || question_no || '] in all' END AS t FROM texts)
SELECT row_order, coalesce(
  nullif(regexp_extract(t, '\[(\d+(\.\d+)?)[\s\x0b]*[Mm][Aa][Rr][Kk][Ss]?\]', 1), ''), nullif(regexp_extract(t, '\((\d+(\.\d+)?)[\s\x0b]*[Mm][Aa][Rr][Kk][Ss]?\)', 1), ''),
  nullif(regexp_extract(t, '(\d+)[\s\x0b]*[Mm][Aa][Rr][Kk][Ss]?[\s\x0b]*(\n|$)', 1), ''), nullif(regexp_extract(t, '\[(\d+(\.\d+)?)\]', 1), ''))::DOUBLE AS marks FROM s"""

#: A turn opens a part if its text begins with A-Z, a quote or a bracket; others stay behind the turn before them, number and all.
NUMBERED = r"""WITH t AS (SELECT conv_id, turn, replace(text, chr(10), ' ') AS t FROM conversations WHERE text IS NOT NULL),
 s AS (SELECT *, turn > 0 AND regexp_matches(t, '^[\s\x0b]*[A-Z"(]') AS opens FROM t), g AS (SELECT *, sum(opens::INT) OVER (PARTITION BY conv_id ORDER BY turn) AS seg FROM s),
 p AS (SELECT conv_id, seg, min(turn) + 1 AS question_no, regexp_replace(string_agg(CASE WHEN opens OR turn = 0 THEN t ELSE (turn + 1) || '. ' || t END, chr(10) ORDER BY turn), '^[\s\x0b]+|[\s\x0b]+$', '', 'g') AS part FROM g GROUP BY ALL)
SELECT conv_id, question_no::INT AS question_no, length(part)::INT AS n FROM p WHERE length(part) > 8 OR (SELECT count(*) FROM p q WHERE q.conv_id = p.conv_id) = 1"""

QUERIES = {
    "quality_report": (quality_report, QUALITY),
    "catalog_index": (catalog_index, "SELECT c_custkey AS chapter_id, n_nationkey AS unit_id, c_name AS name, r_name || ' — ' || n_name AS unit_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"),
    "bank_search": (bank_search, f"WITH {PAPERS}, {BANK} SELECT paper_id, question_no, year::INT AS year, marks FROM bank JOIN papers USING (paper_id) WHERE owner_id = 'u3' AND year >= 1995 AND paper_source = '1-URGENT'"),
    "section_marks": (section_marks, f"WITH {TEXTS} SELECT row_order, question_no, (CASE WHEN question_no <= 16 THEN 1 WHEN question_no <= 21 THEN 2 WHEN question_no <= 28 THEN 3 WHEN question_no <= 30 THEN 4 WHEN question_no <= 33 THEN 5 END)::INT AS marks FROM texts"),
    "paper_meta": (paper_meta, f"WITH {TEXTS} SELECT paper_id, max(question_no) AS max_no, count(DISTINCT question_no) AS distinct_no, count(*) FILTER (question_no > 33) AS above_33, sum(CASE WHEN question_no <= 16 THEN 1 WHEN question_no <= 21 THEN 2 WHEN question_no <= 28 THEN 3 WHEN question_no <= 30 THEN 4 WHEN question_no <= 33 THEN 5 END)::BIGINT AS marks_total FROM texts GROUP BY paper_id"),
    "longest_per_number": (longest_per_number, f"WITH {TEXTS} SELECT paper_id, question_no, row_order, n::INT AS n FROM (SELECT *, length(trim(question_text)) AS n, row_number() OVER (PARTITION BY paper_id, question_no ORDER BY length(trim(question_text)) DESC, row_order) AS rn FROM texts) WHERE rn = 1"),
    "english_text": (english_text, f"WITH {TEXTS}, c AS (SELECT row_order, array_to_string({_CLEAN}, chr(10)) AS clean FROM texts) SELECT row_order, clean, length(regexp_replace(clean, '[^A-Za-z]', '', 'g'))::INT AS letters FROM c"),
    "accepted_text": (accepted_text, ACCEPTED),
    "word_sets": (word_sets, f"WITH {TEXTS} SELECT row_order, len(list_distinct(list_filter(string_split({_NORM}, ' '), lambda w: length(w) > 3)))::INT AS n_words, md5({_NORM}) AS norm_md5 FROM texts"),
    "near_duplicates_in_papers": (near_duplicates_in_papers, NEAR.format(texts=TEXTS, norm=_NORM)),
    "usage_rollup": (usage_rollup, ROLLUP),
    "usage_by_action_30_days": (usage_by_action_30_days, f"WITH {USAGE} SELECT action, count(*) AS calls, sum(prompt_tokens)::BIGINT AS prompt_tokens FROM usage WHERE created_at > (SELECT max(created_at) FROM usage) - INTERVAL 30 DAY GROUP BY action"),
    "usage_by_day": (usage_by_day, f"WITH {USAGE} SELECT strftime(created_at, '%Y-%m-%d') AS day, owner_id, action, count(*) AS calls, sum(prompt_tokens)::BIGINT AS prompt_tokens FROM usage GROUP BY 1, 2, 3"),
    "latest_job": (latest_job, f"WITH {USAGE} SELECT job_id, event_id, action FROM usage QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY created_at DESC, event_id DESC) = 1"),
    "papers_to_reprocess": (papers_to_reprocess, f"WITH {PAPERS}, {BANK} SELECT paper_id, count(question_no) AS n_rows FROM papers LEFT JOIN bank USING (paper_id) GROUP BY paper_id HAVING count(question_no) < 3"),
    "repair_set": (repair_set, f"WITH {BANK}, n AS (SELECT paper_id, CASE WHEN question_no = 6 THEN 17 ELSE question_no END AS question_no, count(*) AS n, max(length(question_text)) * 60 - CASE WHEN max(length(question_text)) = 9 THEN 1 ELSE 0 END AS size FROM bank GROUP BY ALL), p AS (SELECT DISTINCT paper_id FROM bank WHERE paper_id IN (SELECT o_orderkey FROM orders)), g AS (SELECT paper_id, x.no FROM p CROSS JOIN (SELECT unnest(range(1, 8)) AS no) x WHERE paper_id % 6 > 0 AND NOT EXISTS (SELECT 1 FROM n WHERE n.paper_id = p.paper_id AND n.question_no = x.no) UNION ALL SELECT paper_id, question_no FROM n WHERE n > 1 OR (size >= 850 AND question_no BETWEEN 17 AND 28)) SELECT b.paper_id, coalesce(string_agg(no::VARCHAR, ',' ORDER BY no), '') AS numbers FROM (SELECT DISTINCT paper_id FROM bank) b LEFT JOIN g USING (paper_id) GROUP BY b.paper_id"),
    "upsert_papers": (upsert_papers, f"WITH {PAPERS} SELECT paper_id, CASE WHEN paper_id % 5 = 0 THEN 'edited' ELSE paper_source END AS paper_source FROM papers UNION ALL SELECT -1 - i, 'new' FROM range(3) t(i)"),
    "persist_questions": (persist_questions, f"WITH {BANK}, b AS (SELECT paper_id, question_no, max(marks) AS marks FROM bank GROUP BY ALL), t AS (SELECT DISTINCT paper_id FROM b WHERE paper_id % 3 = 0 AND question_no <= 2) SELECT paper_id, question_no, (CASE WHEN paper_id IN (SELECT paper_id FROM t) THEN 1 ELSE marks END)::DECIMAL(10,2) AS marks FROM b WHERE paper_id NOT IN (SELECT paper_id FROM t) OR question_no <= 2"),
    "cascade_delete": (cascade_delete, f"WITH {PAPERS}, {BANK} SELECT paper_id, count(*) AS n FROM bank WHERE paper_id NOT IN (SELECT paper_id FROM papers WHERE year < 1995) GROUP BY paper_id"),
    "edited_papers": (edited_papers, f"WITH {PAPERS} SELECT paper_id, CASE WHEN paper_id % 4 = 1 THEN 'Model exam' ELSE paper_source END AS paper_source FROM papers"),
    "constraint_audit": (constraint_audit, f"WITH {PAPERS}, {BANK} SELECT paper_id, rule, count(*) AS n FROM (SELECT paper_id, 'orphan' AS rule FROM bank WHERE paper_id NOT IN (SELECT paper_id FROM papers) UNION ALL SELECT paper_id, 'duplicate' FROM (SELECT paper_id, question_no FROM bank GROUP BY ALL HAVING count(*) > 1) UNION ALL SELECT paper_id, 'marks' FROM bank WHERE marks > 49) GROUP BY ALL"),
    "chapter_counts": (chapter_counts, f"WITH {BANK} SELECT chapter_id, count(*) AS n FROM bank GROUP BY chapter_id"),
    "papers_by_class": (papers_by_class, f"WITH {PAPERS} SELECT class_id, paper_source, string_agg(DISTINCT year::VARCHAR, ',' ORDER BY year::VARCHAR DESC) AS years, count(*) AS n FROM papers GROUP BY ALL"),
    "running_positions": (running_positions, "SELECT conv_id, turn, (row_number() OVER w - 1)::INT AS position, length(lag(text) OVER w)::INT AS previous_chars, ((row_number() OVER w - 1) // 3)::INT AS batch, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 4 AS in_last_four FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)"),
    "attach_files": (attach_files, f"WITH {PAPERS}, {BANK} SELECT material_id, chapter_id FROM bank JOIN papers USING (paper_id) WHERE class_id = 'F' QUALIFY row_number() OVER (PARTITION BY material_id ORDER BY chapter_id, paper_id) = 1"),
    "merged_catalog": (merged_catalog, "SELECT n_nationkey AS id, CASE WHEN n_nationkey > 8 THEN lower(n_name) ELSE n_name END AS name FROM nation"),
    "merged_papers": (merged_papers, MERGED_PAPERS),
    "attached_files": (attached_files, ATTACHED),
    "page_contexts": (page_contexts, CONTEXTS),
    "replaced_children": (replaced_children, CHILDREN),
    "owned_paths": (owned_paths, OWNED),
    "set_operations": (set_operations, f"WITH {BANK}, a AS (SELECT DISTINCT chapter_id FROM bank WHERE marks > 40), b AS (SELECT DISTINCT chapter_id FROM bank WHERE marks < 5) SELECT chapter_id, CASE WHEN chapter_id IN (SELECT chapter_id FROM b) THEN 'both' ELSE 'first' END AS kind FROM a"),
    "event_json": (event_json, "SELECT event_id, coalesce(json_valid(props), false) AS valid, length(props)::INT AS n FROM events"),
    "numbered_split": (numbered_split, NUMBERED),
    "marks_from_text": (marks_from_text, f"WITH {TEXTS} SELECT row_order, question_no::DOUBLE AS marks FROM texts"),
    "marks_in_whole_texts": (marks_in_whole_texts, MARKS),
    "review_statuses": (review_statuses, "WITH c AS (SELECT event_id, CASE WHEN value IS NOT NULL THEN greatest(0, least(1, abs(value) / 100)) END AS c FROM events) SELECT event_id, CASE WHEN c >= .85 THEN 'AUTO_APPROVED' WHEN c >= .6 THEN 'SUGGEST_REVIEW' ELSE 'MANUAL_REVIEW_REQUIRED' END AS status, CASE WHEN c >= .85 THEN 'high' WHEN c >= .6 THEN 'medium' ELSE 'low' END AS tier, coalesce(floor(least(100, c * 100) + .5), 0)::INT AS percent FROM c"),
    "classify_vector": (classify_vector, VECTOR),
    "classify_in_class": (classify_in_class, IN_CLASS),
    "classify_all_vectors": (classify_all_vectors, ALL_VECTORS),
    "compared_reports": (compared_reports, COMPARED),
    "storage_paths": (storage_paths, "SELECT p_partkey, p_brand || '/' || p_partkey || '-' || substr(regexp_replace(p_name, '[^a-zA-Z0-9._-]+', '_', 'g'), 1, 80) AS path FROM part"),
}
