"""Registered queries that check papers and give their questions chapters, each with its DuckDB oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from examlake.operators import classify as C
from examlake.operators import papers as P
from examlake.sources import tables as src

CHAPTERS = r"chapters AS (SELECT item_id % 4 AS class_id, item_id AS pos, 'ch' || item_id AS cid, 'u' || (item_id // 10) AS uid, 'Chapter ' || (item_id + 1) || ': ' || array_to_string(list_slice(regexp_split_to_array(text, '\s+'), 1, 3), ' ') AS name FROM benchmark)"
QUESTIONS = "q AS (SELECT doc_id // 40 AS paper_id, doc_id AS row_order, (1 + doc_id * doc_id % 37)::INT AS question_no, text AS question_text, (doc_id // 40) % 4 AS class_id, CASE WHEN doc_id % 3 = 0 THEN 'old' END AS chapter_id, NULL::VARCHAR AS unit_id, CASE WHEN doc_id % 3 = 0 THEN 'Old' END AS chapter_name, CASE WHEN doc_id % 3 = 0 THEN 50 END AS chapter_confidence FROM documents)"
GIVEN = "given AS (SELECT doc_id // 40 AS paper_id, (1 + (doc_id * 7) % 37)::INT AS question_no, doc_id AS pos, CASE WHEN doc_id % 5 = 0 THEN 'ch' || (doc_id % 60) END AS aid, CASE WHEN doc_id % 5 > 0 THEN 'chapter-' || (doc_id % 50) END AS aname, (doc_id % 130)::DOUBLE AS conf FROM documents)"
_OUT = ["row_order", "chapter_id", "unit_id", "chapter_name", "chapter_confidence"]


def _questions(spark, d):
    old = F.col("row_order") % 3 == 0
    t = src.text_bank(spark, d).withColumn("class_id", F.col("paper_id") % 4)
    return t.select("*", F.when(old, "old").alias("chapter_id"), F.lit(None).cast("string").alias("unit_id"), F.when(old, "Old").alias("chapter_name"), F.when(old, 50).alias("chapter_confidence"))


def _given(spark, d):
    i = F.col("doc_id")
    t = src.read(spark, d, "documents")
    return t.select(F.expr("doc_id div 40").alias("paper_id"), (1 + (i * 7) % 37).cast("int").alias("question_no"), i.alias("pos"), F.when(i % 5 == 0, F.concat(F.lit("ch"), (i % 60).cast("string"))).alias("chapter_id"), F.when(i % 5 > 0, F.concat(F.lit("chapter-"), (i % 50).cast("string"))).alias("chapter_name"), (i % 130).cast("double").alias("confidence"))


def classify_keyword(spark, d):
    return C.classify_keyword(_questions(spark, d), src.chapters(spark, d)).select(*_OUT)


KEYED = rf"""keyed AS (SELECT *, trim(regexp_replace(trim(list_last(string_split(lower(name), ':'))), '^chapter[-\s]*\d+[:.\s]*', '')) AS key FROM chapters),
 scored AS (SELECT row_order, pos, cid, uid, name, CASE WHEN length(key) >= 4 AND contains(lower(question_text), key) THEN length(key) + 40
   WHEN ws >= 10 THEN ws ELSE 0 END AS score FROM (SELECT q.*, k.pos, k.cid, k.uid, k.name, k.key,
   coalesce(list_sum([length(w) FOR w IN regexp_split_to_array(k.key, '\W+') IF length(w) > 3 AND contains(lower(q.question_text), w)]), 0) AS ws FROM q JOIN keyed k USING (class_id))),
 best AS (SELECT * FROM scored WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY row_order ORDER BY score DESC, pos) = 1)"""
KEYWORD = f"""WITH {CHAPTERS}, {QUESTIONS}, {KEYED}
SELECT q.row_order, b.cid AS chapter_id, b.uid AS unit_id, b.name AS chapter_name, CASE WHEN b.cid IS NOT NULL THEN least(88, floor(35 + least(score, 40) * 1.2::DOUBLE + 0.5))::INT END AS chapter_confidence
FROM q LEFT JOIN best b USING (row_order)"""


def apply_assignments(spark, d):
    return C.apply_assignments(_questions(spark, d), _given(spark, d), src.chapters(spark, d)).select(*_OUT)


ASSIGNED = rf"""WITH {CHAPTERS}, {QUESTIONS}, {GIVEN},
 one AS (SELECT *, coalesce(lower(trim(aname)), '') AS raw, TRY_CAST(regexp_extract(coalesce(aname, ''), '(?i)chapter[-\s]*(\d+)', 1) AS BIGINT) AS num FROM given QUALIFY row_number() OVER (PARTITION BY paper_id, question_no ORDER BY pos DESC) = 1),
 meant AS (SELECT q.row_order, c.* FROM q JOIN one o USING (paper_id, question_no) JOIN chapters c ON c.class_id = q.class_id,
  LATERAL (SELECT CASE WHEN c.cid = o.aid THEN 1 WHEN raw <> '' AND lower(c.name) = raw THEN 2 WHEN raw <> '' AND (contains(lower(c.name), raw) OR contains(raw, lower(c.name))) THEN 3
   WHEN TRY_CAST(regexp_extract(c.name, '(?i)chapter[-\s]*(\d+)', 1) AS BIGINT) = o.num THEN 4 END AS prio) p
  WHERE prio IS NOT NULL QUALIFY row_number() OVER (PARTITION BY q.row_order ORDER BY prio, c.pos) = 1)
SELECT q.row_order, CASE WHEN o.pos IS NULL THEN q.chapter_id ELSE m.cid END AS chapter_id, CASE WHEN o.pos IS NULL THEN q.unit_id ELSE m.uid END AS unit_id,
 CASE WHEN o.pos IS NULL THEN q.chapter_name WHEN m.cid IS NOT NULL THEN coalesce(o.aname, m.name) END AS chapter_name,
 CASE WHEN o.pos IS NULL THEN q.chapter_confidence WHEN m.cid IS NOT NULL THEN greatest(0, least(100, floor(o.conf + 0.5)))::INT END AS chapter_confidence
FROM q LEFT JOIN one o USING (paper_id, question_no) LEFT JOIN meant m ON m.row_order = q.row_order"""


def _overrides(spark, d):
    given = _given(spark, d).groupBy("paper_id", "question_no").agg(F.max("pos").alias("pos"))
    return given.select("paper_id", "question_no", F.concat(F.lit("ch"), (F.col("pos") % 60).cast("string")).alias("chapter_id"), (F.col("pos") % 11 / F.lit(10.0)).alias("confidence"))


def apply_overrides(spark, d):
    return C.apply_overrides(_questions(spark, d), _overrides(spark, d), src.chapters(spark, d)).select(*_OUT)


OVERRIDDEN = f"""WITH {CHAPTERS}, {QUESTIONS}, {GIVEN}, o AS (SELECT paper_id, question_no, 'ch' || (max(pos) % 60) AS oid, (max(pos) % 11) / 10.0::DOUBLE AS conf FROM given GROUP BY ALL)
SELECT row_order, CASE WHEN c.cid IS NULL THEN chapter_id ELSE c.cid END AS chapter_id, CASE WHEN c.cid IS NULL THEN unit_id ELSE c.uid END AS unit_id,
 CASE WHEN c.cid IS NULL THEN chapter_name ELSE c.name END AS chapter_name, CASE WHEN c.cid IS NULL THEN chapter_confidence ELSE greatest(0, least(100, floor(conf * 100 + 0.5)))::INT END AS chapter_confidence
FROM q LEFT JOIN o USING (paper_id, question_no) LEFT JOIN chapters c ON c.class_id = q.class_id AND c.cid = o.oid"""


def reclassify_unassigned(spark, d):
    q = _questions(spark, d)
    return C.reclassify(q, C.classify_keyword(q, src.chapters(spark, d)), "row_order").select(*_OUT)


RECLASSIFIED = f"""WITH {CHAPTERS}, {QUESTIONS}, {KEYED}
SELECT q.row_order, coalesce(q.chapter_id, b.cid) AS chapter_id, CASE WHEN q.chapter_id IS NULL THEN b.uid ELSE q.unit_id END AS unit_id, coalesce(q.chapter_name, b.name) AS chapter_name,
 CASE WHEN q.chapter_id IS NOT NULL THEN q.chapter_confidence WHEN b.cid IS NOT NULL THEN least(88, floor(35 + least(score, 40) * 1.2::DOUBLE + 0.5))::INT END AS chapter_confidence
FROM q LEFT JOIN best b USING (row_order)"""


def _expected(spark, d):
    p = src.text_bank(spark, d).select("paper_id").distinct()
    return p.select("paper_id", F.when(F.col("paper_id") % 5 > 0, (20 + F.col("paper_id") % 14).cast("int")).alias("expected_count"))


def validated_questions(spark, d):
    return P.validated_questions(src.text_bank(spark, d), _expected(spark, d)).select("paper_id", "question_no", "row_order")


VALID = rf"""expected AS (SELECT DISTINCT doc_id // 40 AS paper_id, CASE WHEN (doc_id // 40) % 5 > 0 THEN (20 + (doc_id // 40) % 14)::INT END AS expected_count FROM documents),
 valid AS (SELECT q.paper_id, question_no, row_order FROM q JOIN expected USING (paper_id) WHERE question_no BETWEEN 1 AND coalesce(expected_count, 500)
  AND length(trim(question_text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) >= 12 AND NOT regexp_matches(question_text, '(?im)General Instructions|All questions are compulsory|contains \d+ questions|Read the following instructions|SECTION\s*[-–—]\s*[A-E]\s*$')
  QUALIFY row_number() OVER (PARTITION BY paper_id, question_no ORDER BY length(question_text) DESC, row_order) = 1)"""


def validation_report(spark, d):
    r = P.validation_report(src.text_bank(spark, d), _expected(spark, d))
    return r.withColumn("missing", F.array_join("missing", ",")).withColumn("extra", F.array_join("extra", ","))


def confirmed_numbering(spark, d):
    """All rows' numbers against the expected counts, repeated and too large ones included."""
    r = P.confirm_numbering(src.text_bank(spark, d), _expected(spark, d))
    return r.withColumn("missing", F.array_join("missing", ",")).withColumn("extra", F.array_join("extra", ","))


NUMBERING = rf"""WITH expected AS (SELECT DISTINCT doc_id // 40 AS paper_id, CASE WHEN (doc_id // 40) % 5 > 0 THEN (20 + (doc_id // 40) % 14)::INT END AS expected_count FROM documents),
 q AS (SELECT doc_id // 40 AS paper_id, (1 + doc_id * doc_id % 37)::INT AS no FROM documents), p AS (SELECT paper_id, count(*) AS n, list_sort(list_distinct(list(no))) AS nos FROM q GROUP BY ALL),
 r AS (SELECT paper_id, expected_count, n AS actual_count, CASE WHEN expected_count > 0 THEN [i FOR i IN range(1, expected_count + 1) IF NOT list_contains(nos, i)] ELSE [] END AS missing,
  CASE WHEN expected_count > 0 THEN [i FOR i IN nos IF i < 1 OR i > expected_count] ELSE [] END AS extra FROM expected JOIN p USING (paper_id))
SELECT paper_id, expected_count, actual_count, array_to_string(missing, ',') AS missing, array_to_string(extra, ',') AS extra,
 CASE WHEN expected_count > 0 THEN len(missing) = 0 AND len(extra) = 0 AND actual_count = expected_count END AS confirmed FROM r"""


REPORT = f"""WITH {QUESTIONS}, {VALID}, n AS (SELECT paper_id, count(*) AS n_read FROM q GROUP BY ALL), p AS (SELECT paper_id, list(question_no) AS present FROM valid GROUP BY ALL),
 r AS (SELECT e.paper_id, expected_count, coalesce(len(present), 0) AS actual_count, n_read, CASE WHEN expected_count IS NULL THEN [] ELSE [i FOR i IN range(1, expected_count + 1) IF NOT list_contains(coalesce(present, []), i)] END AS missing
  FROM expected e JOIN n USING (paper_id) LEFT JOIN p USING (paper_id))
SELECT paper_id, expected_count, actual_count, n_read - actual_count AS dropped, array_to_string(missing, ',') AS missing, '' AS extra, CASE WHEN expected_count IS NOT NULL THEN len(missing) = 0 AND actual_count = expected_count END AS confirmed FROM r"""


def apply_continuations(spark, d):
    first = P.validated_questions(src.text_bank(spark, d), _expected(spark, d))
    more = src.read(spark, d, "conversations").select(F.expr("conv_id div 10").alias("paper_id"), (F.col("turn") + 1).cast("int").alias("question_no"), (F.col("conv_id") * 100 + F.col("turn")).alias("pos"), F.col("text").alias("append_text"))
    return P.apply_continuations(first, more).select("paper_id", "question_no", F.length("question_text").cast("long").alias("n_chars"), F.md5("question_text").alias("text_md5"))


CONTINUED = rf"""WITH {QUESTIONS}, {VALID}, base AS (SELECT v.paper_id, v.question_no, q.question_text FROM valid v JOIN q USING (row_order)),
 more AS (SELECT conv_id // 10 AS paper_id, (turn + 1)::INT AS question_no, string_agg(trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), chr(10) ORDER BY conv_id, turn) AS more FROM conversations WHERE regexp_matches(text, '\S') GROUP BY ALL),
 out AS (SELECT paper_id, question_no, concat_ws(chr(10), nullif(question_text, ''), more) AS t FROM base FULL JOIN more USING (paper_id, question_no))
SELECT paper_id, question_no, length(t) AS n_chars, md5(t) AS text_md5 FROM out"""


def document_text(spark, d):
    t = P.document_text(src.text_bank(spark, d).select("paper_id", F.col("row_order").alias("page_no"), F.col("question_text").alias("text")))
    return t.select("paper_id", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("text_md5"))


PAGES = rf"""SELECT doc_id // 40 AS paper_id, length(t) AS n_chars, md5(t) AS text_md5 FROM (SELECT doc_id // 40 * 40 AS doc_id,
 string_agg(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'), ' '), e'\n\n---PAGE---\n\n' ORDER BY documents.doc_id) AS t FROM documents GROUP BY doc_id // 40)"""

QUERIES = {
    "classify_keyword": (classify_keyword, KEYWORD),
    "apply_assignments": (apply_assignments, ASSIGNED),
    "apply_overrides": (apply_overrides, OVERRIDDEN),
    "reclassify_unassigned": (reclassify_unassigned, RECLASSIFIED),
    "validated_questions": (validated_questions, f"WITH {QUESTIONS}, {VALID} SELECT * FROM valid"),
    "validation_report": (validation_report, REPORT),
    "confirmed_numbering": (confirmed_numbering, NUMBERING),
    "apply_continuations": (apply_continuations, CONTINUED),
    "document_text": (document_text, PAGES),
}
