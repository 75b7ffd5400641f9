"""Registered queries of extraction, merging, knowledge and whole runs; DuckDB oracles where SQL can say them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from examlake.functions import text as T
from examlake.operators import catalog as C
from examlake.operators import extraction as E
from examlake.operators import knowledge as K
from examlake.operators import merging as M
from examlake.operators import papers as P
from examlake.operators import workflow as W
from examlake.plans.bank_queries import BANK, PAPERS
from examlake.plans.paper_queries import ASSIGNED, CHAPTERS, GIVEN, KEYWORD, QUESTIONS, _expected, _given, _overrides, _questions
from examlake.sources import tables as src

_SHOWN = ["paper_id", "question_no", "row_order"]


def _rows(spark, d):
    return src.text_bank(spark, d).select("*", F.when(F.col("row_order") % 4 == 0, 2.0).alias("marks"), F.lit(False).alias("has_figure"))


def _instructions(spark, d):
    """Printed instructions of each order's paper: two sections with ends and marks of its own."""
    k = F.col("paper_id") % 5
    text = F.concat(F.lit("Section A - Questions 1 to "), (k + 1).cast("string"), F.lit(" carries 1 mark. Section B - Questions no. "), (k + 2).cast("string"), F.lit(" to 6 carry, that is, each carries "), (k + 2).cast("string"), F.lit(" marks."))
    return src.papers(spark, d).select("paper_id", text.alias("instructions"))


def merged_questions(spark, d):
    return _digest(M.merge_questions(_rows(spark, d)))


def _digest(df, *more):
    return df.select(*_SHOWN, "marks", *more, F.length("question_text").cast("long").alias("n_chars"), F.md5("question_text").alias("text_md5"))


def distinct_questions(spark, d):
    return M.drop_near_copies(_rows(spark, d)).select(*_SHOWN)


def finalized_questions(spark, d):
    papers = src.text_bank(spark, d).select("paper_id").distinct().withColumn("instructions", F.lit(None).cast("string"))
    return _digest(M.finalize_questions(_rows(spark, d), papers), "marks_inferred")


def text_questions(spark, d):
    docs = src.read(spark, d, "documents").select(F.col("doc_id").alias("paper_id"), "text")
    return _digest(E.text_questions(docs))


def question_table(spark, d):
    """Chunks of every document by the table function, from SQL."""
    from examlake.functions.tables import register

    register(spark)
    src.read(spark, d, "documents").createOrReplaceTempView("question_table_documents")
    return spark.sql("SELECT doc_id AS paper_id, q.pos, q.question_no, length(q.chunk) AS n_chars, md5(q.chunk) AS text_md5 FROM question_table_documents, LATERAL question_chunks(text) q")


def text_chunks(spark, d):
    pages = src.text_bank(spark, d).select("paper_id", F.col("row_order").alias("page_no"), F.col("question_text").alias("text"))
    return E.text_chunks(pages).select("paper_id", "chunk_no", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("text_md5"))


def _items(spark, d):
    """Conversations set as pages: eight words a line, a numbered start at each turn, a mark at its margin."""
    c = src.read(spark, d, "conversations").select(F.col("conv_id").cast("long").alias("paper_id"), F.col("turn").cast("long").alias("page_no"), "text")
    w = c.select("paper_id", "page_no", F.posexplode(F.split(F.coalesce("text", F.lit("")), r"\s+")).alias("i", "s"))
    lead = F.when(F.col("i") == 0, F.concat((F.col("page_no") + 1).cast("string"), F.lit(". "))).otherwise("")
    words = w.select("paper_id", "page_no", F.concat(lead, F.col("s")).alias("str"), (40 + F.col("i") % 8 * 45.0).alias("x"), (800 - F.floor(F.col("i") / 8) * 12.0 + F.col("i") % 3).alias("y"))
    marks = c.select("paper_id", "page_no", (F.col("page_no") % 5 + 1).cast("string").alias("str"), F.lit(560.0).alias("x"), F.lit(801.0).alias("y"))
    return words.unionByName(marks).withColumn("page_width", F.lit(600.0))


def layout_lines(spark, d):
    out = E.lines_of_items(_items(spark, d))
    return out.groupBy("paper_id", "page_no").agg(F.count(F.lit(1)).alias("n_lines"), F.max("margin_mark").alias("mark"))


LINES = r"""SELECT conv_id::BIGINT AS paper_id, turn::BIGINT AS page_no, greatest(1, ceil(max(i) / 8.0))::BIGINT AS n_lines, (turn % 5 + 1)::DOUBLE AS mark
FROM (SELECT conv_id, turn, 1 AS i FROM conversations UNION ALL SELECT conv_id, turn, unnest(range(1, len(s) + 1)) AS i FROM (SELECT conv_id, turn, regexp_split_to_array(coalesce(text, ''), '\s+') AS s FROM conversations)
  WHERE len(s) > 0 AND s[-1] <> '' UNION ALL SELECT conv_id, turn, len(s) - 1 FROM (SELECT conv_id, turn, regexp_split_to_array(coalesce(text, ''), '\s+') AS s FROM conversations) WHERE s[-1] = '' AND len(s) > 1) GROUP BY conv_id, turn"""


def layout_questions(spark, d):
    return _digest(E.layout_questions(_items(spark, d)))


def model_answers(spark, d):
    c = src.read(spark, d, "conversations")
    q = F.struct((F.col("turn") + 1).cast("string").alias("questionNo"), F.col("text").alias("questionText"))
    a = c.groupBy(F.col("conv_id").cast("long").alias("paper_id")).agg(F.array_sort(F.collect_list(F.struct("turn", q.alias("q")))).alias("qs"))
    answer = F.to_json(F.struct(F.lit("33").alias("totalQuestions"), F.transform("qs", lambda x: x["q"]).alias("questions")))
    out = E.flatten_model_answers(a.select("paper_id", F.lit(0).alias("answer_no"), answer.alias("answer")))
    return _digest(out, "total_questions", "marks_inferred")


def chosen_extraction(spark, d):
    rows = _rows(spark, d)
    return E.choose_extraction(("layout", rows.where("paper_id % 3 = 0")), ("text", rows)).select(*_SHOWN, "extracted_by")


CHOSEN = f"WITH {QUESTIONS} SELECT paper_id, question_no, row_order, CASE WHEN paper_id % 3 = 0 THEN 'layout' ELSE 'text' END AS extracted_by FROM q"


def inferred_marks(spark, d):
    bank = src.bank(spark, d).withColumn("marks", F.when(F.col("marks") > 25, F.col("marks").cast("double")))
    rows = bank.join(_instructions(spark, d).select("paper_id", T.section_rules(F.col("instructions")).alias("rules")), "paper_id")
    return M.infer_marks(rows, F.col("rules")).select("paper_id", "question_no", "marks", "marks_inferred")


INFERRED = f"""WITH {BANK}, m AS (SELECT *, CASE WHEN marks > 25 THEN marks::DOUBLE END AS given,
 (CASE WHEN question_no <= paper_id % 5 + 1 THEN 1 WHEN question_no BETWEEN least(paper_id % 5 + 2, 6) AND greatest(paper_id % 5 + 2, 6) THEN paper_id % 5 + 2 END)::DOUBLE AS ruled FROM bank)
SELECT paper_id, question_no, coalesce(given, ruled) AS marks, given IS NULL AND ruled IS NOT NULL AS marks_inferred FROM m"""


def unfinished_questions(spark, d):
    w = Window.partitionBy("paper_id").orderBy(F.desc("row_order"))
    rows = src.text_bank(spark, d).withColumn("rn", F.row_number().over(w)).where("rn <= 4")
    rows = rows.where(T.looks_unfinished(F.col("question_no"), F.col("question_text")))
    return rows.select(*_SHOWN, F.regexp_replace(F.substring(T.strip(F.col("question_text")), 1, 80), "\n", " ").alias("snippet"))


def extracted_so_far(spark, d):
    out = E.extracted_so_far(src.text_bank(spark, d), _expected(spark, d))
    said = F.transform("unfinished", lambda q: F.concat_ws(": ", q["question_no"].cast("string"), q["ends"]))
    return out.select("paper_id", F.array_join("numbers", ",").alias("numbers"), "expected_count", F.array_join(said, "|").alias("unfinished"))


UNFINISHED = rf"""WITH {QUESTIONS}, l AS (SELECT *, trim(question_text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS t FROM q QUALIFY row_number() OVER (PARTITION BY paper_id ORDER BY row_order DESC) <= 4)
SELECT paper_id, question_no, row_order, replace(substring(t, 1, 80), chr(10), ' ') AS snippet FROM l
WHERE (regexp_matches(question_text, '(?i)\([ia]\)\s') AND NOT regexp_matches(question_text, '(?i)\((iii|iv|v|vi|vii|viii|ix|x)\)\s'))
 OR (regexp_matches(question_text, '(?i)\(a\)\s') AND NOT regexp_matches(question_text, '(?i)\(b\)\s'))
 OR (length(question_text) > 200 AND NOT regexp_matches(t, '[.?:]$') AND question_no >= 29)"""


SO_FAR = rf"""WITH u AS ({UNFINISHED}), n AS (SELECT doc_id // 40 AS paper_id, list_sort(list_distinct(list((1 + doc_id * doc_id % 37)::INT))) AS nos FROM documents GROUP BY ALL),
 s AS (SELECT paper_id, string_agg(question_no || ': ' || snippet, '|' ORDER BY row_order) AS said FROM u GROUP BY ALL)
SELECT paper_id, array_to_string(nos, ',') AS numbers, CASE WHEN paper_id % 5 > 0 THEN (20 + paper_id % 14)::INT END AS expected_count, coalesce(said, '') AS unfinished FROM n LEFT JOIN s USING (paper_id)"""


def continued_questions(spark, d):
    first = P.validated_questions(src.text_bank(spark, d), _expected(spark, d))
    more = src.read(spark, d, "conversations").select(F.expr("conv_id div 10").alias("paper_id"), (F.col("turn") + 1).cast("int").alias("question_no"), (F.col("conv_id") * 100 + F.col("turn")).alias("pos"), F.col("text").alias("append_text"))
    return M.continue_questions(first, more).select("paper_id", "question_no", F.length("question_text").cast("long").alias("n_chars"), F.md5("question_text").alias("text_md5"))


def notation_counts(spark, d):
    c = src.read(spark, d, "conversations")
    text = F.concat_ws(" ", F.lit("E0 = 5 and A → = B, î + j^"), "text", F.lit("R/(μ-1)"))
    return c.select("conv_id", "turn", F.md5(T.notation(text)).alias("text_md5"), F.regexp_count(T.notation(text), F.lit(r"\\(vec|hat|frac)\{")).alias("n_signs"))


def _concepts(spark, d):
    name = F.array_join(F.slice(F.split("text", " "), 1, 2), " ")
    return src.read(spark, d, "documents").select(F.expr("doc_id div 40").alias("chapter_id"), F.col("doc_id").alias("pos"), name.alias("name"))


def concept_names(spark, d):
    return K.concept_names(_concepts(spark, d))


CONCEPTS = r"""named AS (SELECT doc_id // 40 AS chapter_id, doc_id AS pos, array_to_string(list_slice(string_split(text, ' '), 1, 2), ' ') AS name FROM documents),
 k AS (SELECT *, trim(regexp_replace(regexp_replace(lower(name), '[^a-z0-9_\s]', ' ', 'g'), '\s+', ' ', 'g')) AS key FROM named),
 f AS (SELECT * FROM k WHERE key <> '' QUALIFY row_number() OVER (PARTITION BY chapter_id, key ORDER BY pos) = 1),
 concepts AS (SELECT chapter_id, (row_number() OVER (PARTITION BY chapter_id ORDER BY pos) - 1)::INT AS position, trim(name, ' ') AS concept_name FROM f QUALIFY row_number() OVER (PARTITION BY chapter_id ORDER BY pos) <= 30)"""


def knowledge_inputs(spark, d):
    """Materials, concepts and vectors of chapters of forty documents."""
    doc = src.read(spark, d, "documents")
    i = F.col("doc_id")
    materials = doc.select(
        F.expr("doc_id div 40").alias("chapter_id"), F.concat(F.lit("v"), F.expr("doc_id div 40").cast("string")).alias("chapter_name"), i.alias("material_id"), (i % 7).alias("created_at"),
        F.when(i % 11 > 0, F.when(i % 13 == 0, "").otherwise(F.col("text"))).alias("text"), F.concat(F.lit("v"), i.cast("string")).alias("summary"), (i % 2 == 0).alias("matches_chapter"), F.when(i % 17 == 0, "timeout").alias("error"),
    )
    vectors = src.read(spark, d, "embeddings").select(F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("input"), "embedding")
    return materials, _concepts(spark, d), vectors


def built_knowledge(spark, d):
    knowledge, concepts = K.build_knowledge(*knowledge_inputs(spark, d))
    profiles = K.chapter_profiles(knowledge, concepts).select("chapter_id", F.lit(True).alias("has_profile"))
    out = knowledge.join(profiles, "chapter_id", "left")
    return out.select("chapter_id", "material_id", "extract_status", "extract_error", "mismatch_warning", "concept_count", F.col("title_embedding").isNotNull().alias("has_title"), F.col("summary_embedding").isNotNull().alias("has_summary"), F.coalesce("has_profile", F.lit(False)).alias("has_profile"))


BUILT = rf"""WITH {CONCEPTS}, n AS (SELECT chapter_id, count(*)::INT AS found FROM concepts GROUP BY ALL),
 m AS (SELECT doc_id // 40 AS chapter_id, doc_id, CASE WHEN doc_id % 11 > 0 THEN CASE WHEN doc_id % 13 = 0 THEN '' ELSE text END END AS text FROM documents QUALIFY row_number() OVER (PARTITION BY doc_id // 40 ORDER BY doc_id % 7 DESC, doc_id DESC) = 1),
 w AS (SELECT m.*, coalesce(found, 0) AS found, CASE WHEN text IS NULL THEN '{K.NO_FILE}' WHEN NOT regexp_matches(text, '\S') THEN '{K.NO_TEXT}' WHEN doc_id % 17 = 0 THEN 'timeout' WHEN found IS NULL THEN '{K.NO_CONCEPTS}' END AS why FROM m LEFT JOIN n USING (chapter_id)),
 r AS (SELECT *, chapter_id IN (SELECT vec_id FROM embeddings) AND (why IS NULL OR why IN ('{K.NO_TEXT}', '{K.NO_CONCEPTS}')) AS t, why IS NULL AND doc_id IN (SELECT vec_id FROM embeddings) AS s FROM w)
SELECT chapter_id, doc_id AS material_id, CASE WHEN why IS NULL THEN 'complete' ELSE 'failed' END AS extract_status, why AS extract_error, why IS NULL AND doc_id % 2 = 1 AS mismatch_warning,
 CASE WHEN why IS NULL THEN found ELSE 0 END AS concept_count, t AS has_title, s AS has_summary, t OR s AS has_profile FROM r"""


def classified_papers(spark, d):
    q = _questions(spark, d).withColumns({"unit_id": F.lit(None).cast("string"), "chapter_id": F.lit(None).cast("string"), "chapter_name": F.lit(None).cast("string"), "chapter_confidence": F.lit(None).cast("int")})
    out = W.classify(q, src.chapters(spark, d), assignments=_given(spark, d).where("paper_id % 2 = 0"))
    return out.select("row_order", "classified_by", "chapter_id", "chapter_confidence")


def processed_papers(spark, d):
    q = _questions(spark, d).withColumn("marks", F.lit(1.0))
    bank = q.select("paper_id", "question_no", "question_text", "marks", "chapter_id", "unit_id", "chapter_name", "chapter_confidence").where("question_no = 1").dropDuplicates(["paper_id", "question_no"])
    papers = _expected(spark, d).select("*", (F.col("paper_id") % 4).alias("class_id"), F.lit(None).cast("string").alias("instructions"))
    out, _ = W.process_papers(bank, _rows(spark, d), papers, src.chapters(spark, d), _overrides(spark, d))
    return out.select("paper_id", "question_no", "marks", "chapter_id", "chapter_confidence", F.md5("question_text").alias("text_md5"))


def library_view(spark, d):
    q = _questions(spark, d).drop("question_text")
    p = q.select("paper_id").distinct().select("paper_id", (2000 + F.col("paper_id") % 20).cast("int").alias("year"))
    mine = q.withColumn("chapter_id", F.concat(F.lit("ch"), (F.col("row_order") % 60).cast("string")))
    c = _overrides(spark, d).select("paper_id", "question_no", "confidence", T.review_status(F.col("confidence")).alias("review_status"))
    out = W.library_view(src.chapters(spark, d), p, mine, c)
    return out.select("row_order", "year", "chapter_id", "chapter_name", "unit_id", "chapter_confidence", "review_status")


VIEW = f"""WITH {CHAPTERS}, {QUESTIONS}, {GIVEN}, o AS (SELECT paper_id, question_no, (max(pos) % 11) / 10.0::DOUBLE AS conf FROM given GROUP BY ALL)
SELECT row_order, (2000 + q.paper_id % 20)::INT AS year, 'ch' || (row_order % 60) AS chapter_id, c.name AS chapter_name, c.uid AS unit_id, coalesce(floor(conf * 100 + 0.5)::INT, chapter_confidence) AS chapter_confidence,
 CASE WHEN conf >= .85 THEN 'AUTO_APPROVED' WHEN conf >= .6 THEN 'SUGGEST_REVIEW' WHEN conf IS NOT NULL THEN 'MANUAL_REVIEW_REQUIRED' END AS review_status
FROM q LEFT JOIN chapters c ON c.cid = 'ch' || (row_order % 60) LEFT JOIN o USING (paper_id, question_no)"""

def catalog_chapters(spark, d):
    """Benchmark items as chapters, ten a unit, forty a class."""
    i = F.col("item_id")
    b = src.read(spark, d, "benchmark").select(F.expr("item_id div 40").alias("cls"), F.expr("item_id div 10").alias("unit"), i.alias("id"), F.substring("text", 1, 20).alias("name"))
    units = b.groupBy("cls", "unit").agg(F.array_sort(F.collect_list(F.struct("id", "name"))).alias("chapters"))
    unit = F.struct(F.col("unit").alias("id"), F.col("unit").cast("string").alias("name"), F.lit(None).cast("string").alias("title"), F.lit(None).cast("int").alias("marks"), "chapters")
    tree = units.groupBy(F.lit("u1").alias("owner_id"), F.col("cls").alias("position"), F.col("cls").alias("id"), F.col("cls").cast("string").alias("name")).agg(F.array_sort(F.collect_list(unit)).alias("units"))
    return C.flatten_catalog(tree)[2]


CATALOG = """SELECT 'u1' AS owner_id, item_id AS id, item_id // 10 AS unit_id, item_id // 40 AS class_id, substring(text, 1, 20) AS name,
 (row_number() OVER (PARTITION BY item_id // 10 ORDER BY item_id) - 1)::INT AS position FROM benchmark"""


def failure_reasons(spark, d):
    e = src.read(spark, d, "documents")
    i = F.col("doc_id")
    runs = e.select("doc_id", (i % 5 > 0).alias("model_configured"), F.when(i % 7 == 0, "timeout").alias("model_error"), (i % 3 == 0).alias("images_tried"), (i % 4).alias("images_read"), (i % 2).alias("image_batches"), T.letters(F.col("text")).alias("english_letters"))
    return C.failure_reasons(runs).select("doc_id", "reason")


REASONS = r"""SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'No model is configured.' WHEN doc_id % 7 = 0 THEN 'timeout' WHEN doc_id % 3 = 0 AND doc_id % 4 = 0 THEN 'No page could be rendered as an image.'
 WHEN doc_id % 3 = 0 THEN (doc_id % 4) || ' page image(s) in ' || (doc_id % 2) || ' batch(es) were read, but none held a valid question.'
 WHEN coalesce(length(regexp_replace(text, '[^A-Za-z]', '', 'g')), 0) < 25 THEN 'The file has no selectable text, and no page image was read.' ELSE 'The model returned no valid question.' END AS reason FROM documents"""

DISTINCT = rf"""WITH RECURSIVE t AS (SELECT doc_id // 40 AS paper_id, doc_id AS row_order, (1 + doc_id * doc_id % 37)::INT AS question_no, text, list_distinct(list_filter(string_split(trim(regexp_replace(regexp_replace(lower(text), '[\s\x{{00a0}}\x{{feff}}]+', ' ', 'g'), '[^a-z0-9_ ]', '', 'g')), ' '), lambda w: length(w) > 3)) AS s FROM documents),
 best AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY paper_id, question_no ORDER BY length(text) + CASE WHEN row_order % 4 = 0 THEN 50 ELSE 0 END + CASE WHEN regexp_matches(text, '[^\x20-\x7E\n\r\t\x{{0900}}-\x{{097F}}§©¶]') THEN 10 ELSE 0 END DESC, row_order) = 1),
 p AS (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY question_no, row_order) AS place FROM best),
 l AS (SELECT b.paper_id, b.place, list(a.place) FILTER (len(a.s) > 0 AND len(b.s) > 0 AND len(list_intersect(a.s, b.s)) >= .72 * (len(a.s) + len(b.s) - len(list_intersect(a.s, b.s)))) AS likes, any_value(b.row_order) AS row_order, any_value(b.question_no) AS question_no FROM p b LEFT JOIN p a ON a.paper_id = b.paper_id AND a.place < b.place GROUP BY ALL),
 g AS (SELECT paper_id, place, [place] AS kept FROM l WHERE place = 1 UNION ALL SELECT l.paper_id, l.place, CASE WHEN list_has_any(g.kept, coalesce(l.likes, [])) THEN g.kept ELSE list_append(g.kept, l.place) END FROM g JOIN l ON l.paper_id = g.paper_id AND l.place = g.place + 1)
SELECT l.paper_id, l.question_no, l.row_order FROM g JOIN l USING (paper_id, place) WHERE list_contains(g.kept, g.place)"""

CHUNKS = r"""WITH RECURSIVE t AS (SELECT doc_id // 40 AS paper_id, doc_id, trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS t FROM documents WHERE regexp_matches(text, '\S')), p AS (SELECT *, length(t) AS n, row_number() OVER (PARTITION BY paper_id ORDER BY doc_id) AS rn FROM t),
 g AS (SELECT paper_id, rn, 0 AS chunk_no, n AS size FROM p WHERE rn = 1 UNION ALL SELECT p.paper_id, p.rn, CASE WHEN g.size + p.n + 14 > 28000 THEN chunk_no + 1 ELSE chunk_no END, CASE WHEN g.size + p.n + 14 > 28000 THEN p.n ELSE g.size + p.n + 14 END FROM g JOIN p ON p.paper_id = g.paper_id AND p.rn = g.rn + 1),
 c AS (SELECT paper_id, chunk_no, string_agg(t, e'\n\n---PAGE---\n\n' ORDER BY rn) AS text FROM g JOIN p USING (paper_id, rn) GROUP BY ALL)
SELECT paper_id, chunk_no::INT AS chunk_no, length(text) AS n_chars, md5(text) AS text_md5 FROM c"""

_BARE = QUESTIONS.replace("CASE WHEN doc_id % 3 = 0 THEN 'old' END AS chapter_id", "NULL::VARCHAR AS chapter_id").replace("CASE WHEN doc_id % 3 = 0 THEN 'Old' END AS chapter_name", "NULL::VARCHAR AS chapter_name").replace("CASE WHEN doc_id % 3 = 0 THEN 50 END AS chapter_confidence", "NULL::INT AS chapter_confidence")
ROUTED = f"""WITH a AS ({ASSIGNED.replace(QUESTIONS, _BARE).replace(GIVEN, GIVEN.replace("FROM documents", "FROM documents WHERE (doc_id // 40) % 2 = 0"))}), k AS ({KEYWORD.replace(QUESTIONS, _BARE)}),
 r AS (SELECT row_order // 40 AS paper_id, 0 AS rank, 'assignments' AS classified_by, * FROM a UNION ALL SELECT row_order // 40, 1, 'keyword', * FROM k), u AS (SELECT paper_id, min(rank) AS rank FROM r WHERE chapter_id IS NOT NULL GROUP BY ALL)
SELECT d.doc_id AS row_order, coalesce(classified_by, 'none') AS classified_by, chapter_id, chapter_confidence FROM documents d LEFT JOIN (SELECT r.* FROM r JOIN u USING (paper_id, rank)) x ON x.row_order = d.doc_id"""

QUERIES = {
    "catalog_chapters": (catalog_chapters, CATALOG),
    "failure_reasons": (failure_reasons, REASONS),
    "merged_questions": (merged_questions, None),
    "distinct_questions": (distinct_questions, DISTINCT),
    "finalized_questions": (finalized_questions, None),
    "text_questions": (text_questions, None),
    "text_chunks": (text_chunks, CHUNKS),
    "layout_lines": (layout_lines, LINES),
    "layout_questions": (layout_questions, None),
    "model_answers": (model_answers, None),
    "chosen_extraction": (chosen_extraction, CHOSEN),
    "inferred_marks": (inferred_marks, INFERRED),
    "continued_questions": (continued_questions, None),
    "unfinished_questions": (unfinished_questions, UNFINISHED),
    "extracted_so_far": (extracted_so_far, SO_FAR),
    "question_table": (question_table, None),
    "notation_counts": (notation_counts, None),
    "concept_names": (concept_names, f"WITH {CONCEPTS} SELECT * FROM concepts"),
    "built_knowledge": (built_knowledge, BUILT),
    "classified_papers": (classified_papers, ROUTED),
    "processed_papers": (processed_papers, None),
    "library_view": (library_view, VIEW),
}
