"""Registered queries of whole extraction jobs over orders and line items, with their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from examlake.operators import jobs as J
from examlake.operators import provider as P
from examlake.operators.records import BANK_COLUMNS
from examlake.operators.rereading import table_reader
from examlake.sources import tables as src
from examlake.sources.written import written

TOPICS = ("optics", "magnetism", "gravitation", "thermodynamics", "electrostatics")
NOW = "2024-05-01 00:00:00"


def _texts(spark, d):
    """Line items as questions of their orders; those of each fourth part are left to the pages that are read again."""
    li, o = src.read(spark, d, "lineitem"), src.read(spark, d, "orders")
    j = li.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    k, n = F.col("l_orderkey"), F.col("l_linenumber").cast("int")
    topic = F.coalesce(F.get(F.array(*map(F.lit, TOPICS)), ((k + n) % 7).cast("int")), F.lit("nothing else"))
    text = F.concat(F.lit("Question "), k.cast("string"), F.lit(" of number "), n.cast("string"), F.lit(" asks you to explain "), topic, F.lit(" in words."))
    return j.select(
        F.concat(F.lit("u"), (F.col("o_custkey") % 7).cast("string")).alias("owner_id"), k.alias("paper_id"), ((F.col("l_partkey") * 100_000 + F.col("l_suppkey")) * 10 + n).alias("row_order"), n.alias("question_no"), text.alias("question_text"), F.lit(None).cast("double").alias("marks"), F.lit(False).alias("has_figure"),
        F.when(k % 2 == 0, "ai").otherwise("heuristic").alias("extracted_by"), (4 + k % 4).cast("int").alias("total_questions"), (F.col("l_partkey") % 4 == 0).alias("withheld"), (1 + F.col("l_suppkey") % 4).cast("int").alias("page_no"), F.col("l_suppkey").alias("pos"),
    )


def _run(spark, d) -> J.Run:
    texts, o = _texts(spark, d), src.read(spark, d, "orders")
    owner, k = F.concat(F.lit("u"), (F.col("o_custkey") % 7).cast("string")).alias("owner_id"), F.col("o_orderkey")
    none = lambda kind: F.lit(None).cast(kind)
    papers = o.select(owner, k.alias("paper_id"), F.concat(F.lit("c"), (k % 3).cast("string")).alias("class_id"), F.lit("Final exam").alias("paper_source"), F.year("o_orderdate").alias("year"), (1 + k % 3).cast("int").alias("n_pages"), none("string").alias("last_quality_report"), none("string").alias("last_extraction_job_id"))
    jobs = o.where("o_orderkey % 10 < 8").select(owner, F.concat(F.lit("j"), k.cast("string")).alias("job_id"), k.alias("paper_id"), F.lit("queued").alias("status"), F.lit("queued").alias("phase"), none("long").alias("question_count"), none("string").alias("error"), F.lit("p1").alias("prompt_version"), F.lit(NOW).cast("timestamp").alias("updated_at"))
    chapters = spark.range(3).select(F.concat(F.lit("c"), "id").alias("class_id"), F.posexplode(F.array(*map(F.lit, TOPICS))).alias("chapter_pos", "topic"))
    chapters = chapters.select("class_id", "chapter_pos", F.concat_ws("-", "class_id", F.col("chapter_pos").cast("string")).alias("chapter_id"), F.lit("un1").alias("unit_id"), F.concat(F.lit("Chapter "), (F.col("chapter_pos") + 1).cast("string"), F.lit(": "), "topic").alias("name"))
    overrides = o.where("o_orderkey % 6 = 0").select(owner, k.alias("paper_id"), F.lit(2).alias("question_no"), F.concat(F.lit("c"), (k % 3).cast("string"), F.lit("-"), (k % 8).cast("string")).alias("chapter_id"), F.lit(0.9).alias("confidence"))
    old = o.where("o_orderkey % 10 in (0, 9)").select(owner, F.explode(F.array(F.lit(1), F.lit(9))).alias("no"), k.alias("paper"))
    kinds = {"chapter_confidence": "int", "question_no": "int", "marks": "decimal(10,2)", "year": "int"}
    held = {"owner_id": F.col("owner_id"), "id": F.concat_ws("-", F.col("paper").cast("string"), F.col("no").cast("string")), "question_paper_id": F.col("paper").cast("string"), "question_no": F.col("no"), "question_text": F.lit("an old question"), "source": F.lit("Others")}
    bank = old.select(*[held.get(c, none(kinds.get(c, "string"))).alias(c) for c in BANK_COLUMNS])
    classifications = bank.select("owner_id", F.col("id").alias("question_id"), F.lit("old").alias("chapter_id"), F.lit(0.5).cast("decimal(4,3)").alias("confidence"), none("array<struct<chapter_id:string,chapter_name:string,score:double>>").alias("alternatives"), F.lit("MANUAL_REVIEW_REQUIRED").alias("review_status"), F.lit("VECTOR").alias("classification_source"))
    usage = o.select(owner, F.concat(F.lit("j"), k.cast("string")).alias("job_id"), F.lit("extract.vision").alias("action"), F.lit("gpt-4o").alias("model"), (k % 1000 * 10).alias("prompt_tokens"), (k % 100).alias("completion_tokens"))
    extracted = texts.where("not withheld").drop("withheld", "page_no", "pos")
    readings = written(texts.where("withheld").drop("withheld", "row_order"), "readings")  # each page looks them up
    return J.run_jobs(jobs, papers, extracted, bank, classifications, chapters, overrides, usage, F.lit(NOW).cast("timestamp"), reader=table_reader(readings), rounds=2)


def job_bank(spark, d):
    """The bank after every job: rows of papers without a job, or whose job failed, stay."""
    b = _run(spark, d).bank
    return b.select("owner_id", "id", "question_paper_id", "question_no", F.col("marks").cast("double").alias("marks"), "chapter_id", "chapter_confidence", "source", "extracted_by", F.get_json_object("metadata", "$.totalQuestions").cast("int").alias("total"), F.md5("question_text").alias("text_md5"))


def job_rows(spark, d):
    j = _run(spark, d).jobs
    at = lambda column, path: F.get_json_object(column, path)
    return j.select("owner_id", "job_id", "status", "phase", "question_count", "error", "extracted_by", "classified_by", at("quality_report", "$.extracted").cast("int").alias("extracted"), at("quality_report", "$.status").alias("report"), at("usage_summary", "$.totals.prompt_tokens").cast("long").alias("prompt_tokens"))


def job_classifications(spark, d):
    c = _run(spark, d).classifications
    return c.select("owner_id", "question_id", "chapter_id", F.col("confidence").cast("double").alias("confidence"), "review_status", "classification_source")


def provided_answers(spark, d):
    """Every turn asked for, answers of even ones looked up in a table."""
    c = src.read(spark, d, "conversations").select(F.col("conv_id").alias("paper_id"), F.col("turn").alias("answer_no"), "text")
    provider = P.from_table(c.where("answer_no % 2 = 0").withColumnRenamed("text", "answer"), ["paper_id", "answer_no"])
    return provider(c.drop("text")).select("paper_id", "answer_no", F.md5("answer").alias("answer_md5"), "attempts", "error")


PROVIDED = f"""SELECT conv_id AS paper_id, turn AS answer_no, CASE WHEN turn % 2 = 0 THEN md5(text) END AS answer_md5, 1 AS attempts, CASE WHEN turn % 2 <> 0 THEN '{P.NO_ANSWER}' END AS error FROM conversations"""

#: Numbers that a paper has in the end: extracted ones, and those on pages that it has, up to its count; none if nothing was extracted.
JOBS = """o AS (SELECT 'u' || (o_custkey % 7) AS owner_id, o_orderkey AS k, 4 + o_orderkey % 4 AS total, 1 + o_orderkey % 3 AS n_pages, o_orderkey % 10 < 8 AS has_job, year(o_orderdate) AS y FROM orders),
 l AS (SELECT l_orderkey AS k, l_linenumber AS no, bool_or(l_partkey % 4 <> 0) AS extracted, min(CASE WHEN l_partkey % 4 = 0 THEN 1 + l_suppkey % 4 END) AS page FROM lineitem GROUP BY ALL),
 begun AS (SELECT DISTINCT k FROM l WHERE extracted),
 q AS (SELECT o.owner_id, o.k, l.no, o.total, 'Question ' || o.k || ' of number ' || l.no || ' asks you to explain ' || coalesce(['optics', 'magnetism', 'gravitation', 'thermodynamics', 'electrostatics'][(o.k + l.no) % 7 + 1], 'nothing else') || ' in words.' AS text,
  CASE WHEN (o.k + l.no) % 7 < 5 THEN 'c' || (o.k % 3) || '-' || ((o.k + l.no) % 7) END AS topic FROM o JOIN l USING (k) JOIN begun USING (k) WHERE has_job AND l.no <= o.total AND (l.extracted OR l.page <= o.n_pages)),
 route AS (SELECT k, CASE WHEN count(topic) > 0 THEN 'heuristic' ELSE 'none' END AS route FROM q GROUP BY ALL),
 c AS (SELECT q.*, route, CASE WHEN k % 6 = 0 AND no = 2 AND k % 8 < 5 THEN 'c' || (k % 3) || '-' || (k % 8) ELSE topic END AS chapter_id, k % 6 = 0 AND no = 2 AND k % 8 < 5 AS manual FROM q JOIN route USING (k)),
 old AS (SELECT owner_id, k, unnest([1, 9]) AS no FROM o WHERE k % 10 IN (0, 9)), kept AS (SELECT * FROM old WHERE k NOT IN (SELECT k FROM q))"""

BANK_AFTER = f"""WITH {JOBS} SELECT owner_id, k || '-' || no AS id, k::VARCHAR AS question_paper_id, no::INT AS question_no, 1.0::DOUBLE AS marks, chapter_id, CASE WHEN manual THEN 90 WHEN chapter_id IS NOT NULL THEN 83 END::INT AS chapter_confidence,
 'Final exam' AS source, CASE WHEN k % 2 = 0 THEN 'ai' ELSE 'heuristic' END AS extracted_by, total::INT AS total, md5(text) AS text_md5 FROM c
 UNION ALL SELECT owner_id, k || '-' || no, k::VARCHAR, no, NULL, NULL, NULL, 'Others', NULL, NULL, md5('an old question') FROM kept"""

JOB_ROWS = f"""WITH {JOBS}, n AS (SELECT k, count(*) AS n FROM q GROUP BY ALL)
SELECT owner_id, 'j' || k AS job_id, CASE WHEN n > 0 THEN 'completed' ELSE 'failed' END AS status, CASE WHEN n > 0 THEN 'completed' ELSE 'failed' END AS phase, n AS question_count, CASE WHEN n IS NULL THEN '{J.NOTHING}' END AS error,
 CASE WHEN n > 0 THEN CASE WHEN k % 2 = 0 THEN 'ai' ELSE 'heuristic' END END AS extracted_by, route AS classified_by, n::INT AS extracted, CASE WHEN n = total THEN 'Passed' WHEN n > 0 THEN 'Needs Review' END AS report, CASE WHEN n > 0 THEN k % 1000 * 10 END::BIGINT AS prompt_tokens
FROM o LEFT JOIN n USING (k) LEFT JOIN route USING (k) WHERE has_job"""

CLASSIFIED = f"""WITH {JOBS}, new AS (SELECT owner_id, k || '-' || no AS question_id, chapter_id, CASE WHEN manual THEN 0.9 ELSE 83 / 100.0 END::DOUBLE AS confidence, CASE WHEN manual THEN 'MANUAL_OVERRIDE' ELSE 'HEURISTIC_FALLBACK' END AS classification_source FROM c WHERE chapter_id IS NOT NULL),
 stay AS (SELECT owner_id, k || '-' || no AS question_id FROM kept UNION SELECT c.owner_id, c.k || '-' || c.no FROM c JOIN old USING (k, no))
SELECT owner_id, question_id, chapter_id, confidence, CASE WHEN confidence >= .85 THEN 'AUTO_APPROVED' WHEN confidence >= .6 THEN 'SUGGEST_REVIEW' ELSE 'MANUAL_REVIEW_REQUIRED' END AS review_status, classification_source FROM new
UNION ALL SELECT owner_id, question_id, 'old', 0.5, 'MANUAL_REVIEW_REQUIRED', 'VECTOR' FROM stay ANTI JOIN new USING (owner_id, question_id)"""

QUERIES = {
    "job_bank": (job_bank, BANK_AFTER),
    "job_rows": (job_rows, JOB_ROWS),
    "job_classifications": (job_classifications, CLASSIFIED),
    "provided_answers": (provided_answers, PROVIDED),
}
