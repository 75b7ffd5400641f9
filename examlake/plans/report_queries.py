"""Registered queries of reports, labels, routes and jobs, each with its DuckDB oracle."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from examlake.functions import text as T
from examlake.operators import reports as R
from examlake.plans.bank_queries import _LETTERS, _SOLID, BANK, PAPERS, QUALITY, TEXTS, _reports
from examlake.plans.paper_queries import QUESTIONS, VALID, _expected
from examlake.plans.tenant_queries import FULL
from examlake.sources import tables as src
from examlake.sources.written import written


def quality_rates(spark, d):
    t = src.text_bank(spark, d).withColumn("marks", F.when(F.col("row_order") % 4 == 0, 2.0))
    return R.rates_text(R.quality_rates(t)).select("paper_id", "total", "with_marks", F.round("marks_rate", 6).alias("marks_rate"), F.round("english_rate", 6).alias("english_rate"), "message")


RATES = rf"""WITH {TEXTS}, f AS (SELECT paper_id, row_order % 4 = 0 AS m, length(question_text) >= 10 AND NOT regexp_matches(question_text, '[\x{{0900}}-\x{{097F}}§©¶]') AND (CASE WHEN {_SOLID} > 0 THEN {_LETTERS} / {_SOLID} ELSE 0 END) >= (CASE WHEN regexp_matches(question_text, '[^\x20-\x7E\n\r\t\x{{0900}}-\x{{097F}}§©¶]') THEN .30 ELSE .45 END)
 AND len(regexp_extract_all(question_text, '[A-Za-z]{{2,}}')) >= 2 AS e FROM texts), g AS (SELECT paper_id, count(*) AS total, count(*) FILTER (m) AS with_marks, avg(m::INT) AS a, avg(e::INT) AS b FROM f GROUP BY ALL)
SELECT paper_id, total, with_marks, round(a, 6) AS marks_rate, round(b, 6) AS english_rate, floor(a * 100 + .5)::INT || '% of rows have marks; ' || floor(b * 100 + .5)::INT || '% read as English.' AS message FROM g"""


def validation_warnings(spark, d):
    """Warnings of a check of question sets, with gaps that a report found taken in."""
    from examlake.operators.papers import validation_report

    v = written(validation_report(src.text_bank(spark, d), _expected(spark, d)), "report")
    told = v.select("paper_id", F.array(F.lit(2), F.lit(50)).alias("missing")).where("paper_id % 2 = 0")
    both = R.with_validation_missing(v.select("paper_id", "missing"), told)
    return R.count_warning(v).select("paper_id", "warning").join(both.select("paper_id", F.array_join("missing", ",").alias("missing")), "paper_id")


WARNINGS = f"""WITH {QUESTIONS}, {VALID}, n AS (SELECT paper_id, count(*) AS n_read FROM q GROUP BY ALL), p AS (SELECT paper_id, list(question_no) AS present FROM valid GROUP BY ALL),
 r AS (SELECT e.paper_id, expected_count AS n, coalesce(len(present), 0) AS a, n_read, CASE WHEN expected_count IS NULL THEN [] ELSE [i FOR i IN range(1, expected_count + 1) IF NOT list_contains(coalesce(present, []), i)] END AS m FROM expected e JOIN n USING (paper_id) LEFT JOIN p USING (paper_id))
SELECT paper_id, CASE WHEN n IS NOT NULL AND NOT (len(m) = 0 AND a = n) THEN concat_ws(' ', CASE WHEN a <> n THEN a || ' of ' || n || ' questions were found.' END, CASE WHEN len(m) > 0 THEN 'Not found: ' || array_to_string(m[1:10], ', ') || CASE WHEN len(m) > 10 THEN ' and ' || (len(m) - 10) || ' more' ELSE '' END || '.' END,
 CASE WHEN m[1] <= 20 THEN 'Numbers after ' || m[1] || ' may be off by one.' END, CASE WHEN n_read - a > 0 THEN (n_read - a) || ' repeated or unfit rows were left out.' END, CASE WHEN a < n * .5 AND len(m) = 0 THEN 'Read the paper again, or a clearer copy of it.' END) END AS warning,
 array_to_string(list_sort(list_distinct(list_concat(m, CASE WHEN paper_id % 2 = 0 THEN [2, 50] ELSE [] END))), ',') AS missing FROM r"""


def report_texts(spark, d):
    return R.report_texts(_reports(spark, d)).select("paper_id", "summary", "details")


REPORT_TEXTS = f"""WITH q AS ({QUALITY}), c AS (SELECT *, extracted || ' of ' || expected_count || ' questions' AS n FROM q)
SELECT paper_id, CASE WHEN status = 'Not Extracted' THEN '' ELSE concat_ws('; ', n, CASE WHEN status = 'Passed' THEN 'all checks passed' WHEN issues <> '' THEN lower(status) || ': ' || string_split(issues, '; ')[1] END) END AS summary,
 CASE WHEN status = 'Not Extracted' THEN '' ELSE 'Found: ' || n || chr(10) || 'Missing: ' || coalesce(nullif(missing, ''), 'none') || chr(10) || 'Repeated: ' || coalesce(nullif(duplicates, ''), 'none') END AS details FROM c"""


def bank_labels(spark, d):
    b = src.full_bank(spark, d)
    n = F.col("question_no")
    label = R.source_label(F.when(n != 2, F.col("source")), F.col("year"), F.when(n == 1, "S1"), F.when(n == 3, ""), F.when(n <= 2, n))
    q = R.question_label(n, F.col("year"), F.when(n != 4, F.col("source")), F.when(F.col("question_paper_id").isNotNull(), F.concat(F.lit("Paper "), "question_paper_id")), F.repeat(F.concat("question_text", F.lit("  \n")), 5))
    return b.select("id", label.alias("label"), q.alias("q")).select("id", "label", "q.head", "q.snippet")


LABELS = rf"""WITH {FULL} SELECT id, coalesce(nullif(concat_ws(' · ', CASE WHEN question_no <> 2 THEN source END, year, CASE WHEN question_no = 1 THEN 'S1' END, CASE WHEN question_no <= 2 THEN 'Code ' || question_no END), ''), '—') AS label,
 coalesce(nullif(concat_ws(' · ', 'Q' || question_no, year, CASE WHEN question_no <> 4 THEN source END, 'Paper ' || question_paper_id), ''), 'Exam question') AS head,
 CASE WHEN length(t) > 72 THEN substring(t, 1, 72) || '…' ELSE t END AS snippet FROM (SELECT *, trim(regexp_replace(repeat(question_text || e'  \n', 5), '\s+', ' ', 'g')) AS t FROM full_bank)"""


def file_labels(spark, d):
    p = src.read(spark, d, "part")
    k = (F.col("p_partkey") % 9).cast("int")
    mimes = F.array(*[F.lit(m) for m in ("image/jpeg", "application/pdf", "application/msword", "text/plain", "image/png", "", "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "application/json")], F.lit(None).cast("string"))
    ends = F.array(*[F.lit(e) for e in (".PDF", ".docx", ".gdoc", ".md", "", ".csv", ".png")])
    name = F.concat("p_name", F.get(ends, (F.col("p_partkey") % 7).cast("int")))
    mime = F.get(mimes, k)
    url = F.when(k % 3 == 0, F.concat(F.lit("https://drive.example/file/d/f"), F.col("p_partkey").cast("string"), F.lit("/view?x=1"))).when(k % 3 == 1, F.concat(F.lit("https://drive.example/open?a=b&id=g"), F.col("p_partkey").cast("string"))).otherwise("no link")
    kind = R.file_category(mime, name)
    return p.select("p_partkey", kind.alias("category"), R.file_extension(mime).alias("extension"), R.is_text_file(kind, mime, name).alias("is_text"), R.shared_file_id(url).alias("file_id"))


FILE_LABELS = r"""WITH f AS (SELECT p_partkey, lower(coalesce(['image/jpeg', 'application/pdf', 'application/msword', 'text/plain', 'image/png', '', 'application/vnd.openxmlformats-officedocument.wordprocessingml.document', 'application/json', NULL][p_partkey % 9 + 1], '')) AS m,
 lower(p_name || ['.PDF', '.docx', '.gdoc', '.md', '', '.csv', '.png'][p_partkey % 7 + 1]) AS n FROM part), c AS (SELECT *, CASE WHEN starts_with(m, 'image/') THEN 'Image' WHEN m = 'application/pdf' OR n LIKE '%.pdf' THEN 'PDF' WHEN m LIKE '%word%' OR m LIKE '%officedocument%' OR n LIKE '%.doc' OR n LIKE '%.docx' THEN 'Microsoft Document' WHEN n LIKE '%.gdoc' THEN 'Google Doc' WHEN starts_with(m, 'text/') THEN 'Text' ELSE 'Microsoft Document' END AS category FROM f)
SELECT p_partkey, category, CASE WHEN m = 'application/pdf' THEN 'pdf' WHEN m = 'image/jpeg' THEN 'jpg' WHEN m = 'image/png' THEN 'png' WHEN starts_with(m, 'text/') THEN 'txt' WHEN m LIKE '%wordprocessingml%' OR m LIKE '%msword%' THEN 'docx' ELSE 'bin' END AS extension,
 category = 'Text' OR starts_with(m, 'text/') OR m = 'application/json' OR n LIKE '%.md' OR n LIKE '%.csv' OR n LIKE '%.txt' AS is_text, CASE p_partkey % 9 % 3 WHEN 0 THEN 'f' || p_partkey WHEN 1 THEN 'g' || p_partkey END AS file_id FROM c"""


def syllabus_texts(spark, d):
    i = F.col("doc_id")
    kinds = F.array(F.lit("Syllabus"), F.lit("Others"), F.lit(None).cast("string"), F.lit("Class Notes"))
    f = src.read(spark, d, "documents").select(F.concat(F.lit("u"), (i % 7).cast("string")).alias("owner_id"), (i % 12).alias("class_id"), (i % 5).alias("unit_pos"), (i % 3).alias("chapter_pos"), i.alias("file_pos"), (i % 15).alias("chapter_id"), F.concat(F.lit("Ch "), (i % 15).cast("string")).alias("chapter_name"), F.get(kinds, (i % 4).cast("int")).alias("category"), F.when(i % 10 > 0, F.col("text")).otherwise(" ").alias("text"))
    return R.syllabus_texts(f).select("owner_id", "class_id", F.length("text").alias("n"), F.md5("text").alias("text_md5"))


SYLLABUS = r"""WITH f AS (SELECT 'u' || (doc_id % 7) AS owner_id, doc_id % 12 AS class_id, doc_id % 5 AS up, doc_id % 3 AS cp, doc_id, trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS t FROM documents WHERE doc_id % 10 > 0 AND doc_id % 4 < 3 AND regexp_matches(text, '\S')),
 g AS (SELECT owner_id, class_id, substring(string_agg('## Ch ' || (doc_id % 15) || ' (chapterId: ' || (doc_id % 15) || e')\n' || substring(t, 1, 6000), e'\n\n' ORDER BY up, cp, doc_id), 1, 40000) AS text FROM f GROUP BY ALL)
SELECT owner_id, class_id, length(text)::INT AS n, md5(text) AS text_md5 FROM g"""


def text_routes(spark, d):
    i = F.col("doc_id")
    t = src.read(spark, d, "documents").select("doc_id", (i % 2 == 0).alias("is_pdf"), F.when(i % 5 == 0, "").when(i % 7 == 0, F.regexp_replace("text", "[a-m]", "1")).otherwise(F.col("text")).alias("layout_text"), F.when(i % 3 == 0, " \n").otherwise(F.col("text")).alias("raw_text"))
    return R.text_route(t).select("doc_id", F.length("text").alias("n"), "by_text")


TEXT_ROUTES = r"""WITH t AS (SELECT doc_id, doc_id % 2 = 0 AS pdf, CASE WHEN doc_id % 5 = 0 THEN '' WHEN doc_id % 7 = 0 THEN regexp_replace(text, '[a-m]', '1', 'g') ELSE text END AS a, CASE WHEN doc_id % 3 = 0 THEN ' ' || chr(10) ELSE text END AS b FROM documents),
 n AS (SELECT *, length(regexp_replace(a, '[^A-Za-z]', '', 'g')) AS la, length(regexp_replace(b, '[^A-Za-z]', '', 'g')) AS lb, regexp_matches(a, '\S') AS sa, regexp_matches(b, '\S') AS sb FROM t),
 c AS (SELECT *, CASE WHEN sa AND (NOT sb OR la >= lb) THEN a WHEN sb THEN b ELSE '' END AS text FROM n)
SELECT doc_id, length(text)::INT AS n, (length(regexp_replace(text, '[^A-Za-z]', '', 'g')) >= 25 OR length(regexp_replace(text, '\s', '', 'g')) >= 120) AND (NOT pdf OR la >= 80) AS by_text FROM c"""


def split_solutions(spark, d):
    i = F.col("row_order")
    t = src.text_bank(spark, d).select("row_order", F.concat("question_text", F.when(i % 3 == 0, "\nSolution: as shown\nabove").when(i % 3 == 1, "\nANSWER - x").otherwise(" the answer is")).alias("t"))
    s = R.split_solution(F.col("t"), enabled=True)
    return t.select("row_order", s["solution"].alias("solution"), F.length(s["question_text"]).alias("n"), F.length(R.split_solution(F.col("t"))["question_text"]).alias("whole"))


SOLUTIONS = rf"""WITH {TEXTS}, t AS (SELECT row_order, trim(question_text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS head, trim(question_text || CASE row_order % 3 WHEN 0 THEN e'\nSolution: as shown\nabove' WHEN 1 THEN e'\nANSWER - x' ELSE ' the answer is' END, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS whole FROM texts)
SELECT row_order, CASE row_order % 3 WHEN 0 THEN e'as shown\nabove' WHEN 1 THEN 'x' END AS solution, length(CASE WHEN row_order % 3 < 2 THEN head ELSE whole END)::INT AS n, length(whole)::INT AS whole FROM t"""


def notation_tokens(spark, d):
    i = F.col("row_order")
    t = src.text_bank(spark, d).select("row_order", F.concat(F.when(i % 2 == 0, "\\vec{E}"), "question_text", F.lit("\\frac{1}{2x}\\hat{i}"), F.when(i % 3 == 0, "[Figure: a lens]").otherwise(" end")).alias("t")).unionByName(src.text_bank(spark, d).where("row_order % 2 = 1").select((-F.col("row_order")).alias("row_order"), F.concat("question_text", F.lit(" plain")).alias("t")))
    x = t.select("row_order", F.posexplode(R.notation_tokens(F.col("t"))).alias("place", "x"))
    return x.select("row_order", "place", "x.kind", "x.value", "x.below")


TOKENS = rf"""WITH {TEXTS}, s AS (SELECT row_order, question_text AS h FROM texts), k AS (SELECT row_order, [{{'kind': 'vec', 'value': 'E', 'below': NULL::VARCHAR}}, {{'kind': 'text', 'value': h, 'below': NULL}}, {{'kind': 'frac', 'value': '1', 'below': '2x'}}, {{'kind': 'hat', 'value': 'i', 'below': NULL}},
 CASE WHEN row_order % 3 = 0 THEN {{'kind': 'figure', 'value': '[Figure: a lens]', 'below': NULL::VARCHAR}} ELSE {{'kind': 'text', 'value': ' end', 'below': NULL::VARCHAR}} END] AS x FROM s WHERE row_order % 2 = 0
 UNION ALL SELECT -row_order, [{{'kind': 'text', 'value': h || ' plain', 'below': NULL::VARCHAR}}] FROM s WHERE row_order % 2 = 1), u AS (SELECT row_order, unnest(list_filter(x, lambda t: t.value <> '')) AS t, unnest(range(len(list_filter(x, lambda t: t.value <> '')))) AS place FROM k)
SELECT row_order, place::INT AS place, t.kind AS kind, t.value AS value, t.below AS below FROM u"""


def build_totals(spark, d):
    v = src.read(spark, d, "embeddings")
    i = F.col("vec_id")
    return R.build_totals(v.select(F.concat(F.lit("u"), (i % 7).cast("string")).alias("owner_id"), (i % 4).alias("class_id"), F.when(i % 3 == 0, "failed").when(i % 3 == 1, "complete").otherwise("pending").alias("extract_status")))


BUILD_TOTALS = "SELECT 'u' || (vec_id % 7) AS owner_id, vec_id % 4 AS class_id, count(*) FILTER (vec_id % 3 = 1) AS complete, count(*) FILTER (vec_id % 3 = 0) AS failed FROM embeddings GROUP BY ALL"


def job_states(spark, d):
    """Queued jobs of all papers with the latest of their changes put in, and the reports stamped on the papers."""
    p = src.papers(spark, d).select("owner_id", "paper_id", F.concat(F.lit("j"), F.col("paper_id").cast("string")).alias("job_id"), F.lit("v3").alias("prompt_version"))
    jobs = R.queued_jobs(p, F.to_timestamp(F.lit("2024-01-01")))
    li = src.read(spark, d, "lineitem")
    at = F.timestamp_seconds(F.lit(1_704_067_200) + F.col("l_linenumber") * 60)
    states = F.array(F.lit("running"), F.lit("completed"), F.lit("failed"))
    ch = li.dropDuplicates(["l_orderkey", "l_linenumber"]).select(F.concat(F.lit("j"), F.col("l_orderkey").cast("string")).alias("job_id"), F.get(states, F.col("l_linenumber") % 3).alias("status"), F.concat(F.lit("step "), F.col("l_linenumber").cast("string")).alias("phase"), F.when(F.col("l_linenumber") % 3 == 1, F.col("l_linenumber").cast("long")).alias("question_count"), F.when(F.col("l_linenumber") % 3 == 2, "timeout").alias("error"), at.alias("updated_at"))
    ch = ch.join(p.select("owner_id", "job_id"), "job_id")
    out = R.apply_job_changes(jobs, ch)
    stamped = R.stamp_reports(src.papers(spark, d).select("owner_id", "paper_id", F.lit(None).cast("string").alias("last_quality_report"), F.lit(None).cast("string").alias("last_extraction_job_id")), out.where("status = 'completed'").select("owner_id", "paper_id", F.to_json(F.struct("question_count")).alias("last_quality_report"), F.col("job_id").alias("last_extraction_job_id")))
    return out.drop("updated_at").join(stamped, ["owner_id", "paper_id"]).select("owner_id", "paper_id", "job_id", "status", "phase", "question_count", "error", "prompt_version", "last_quality_report", "last_extraction_job_id")


JOB_STATES = f"""WITH {PAPERS}, last AS (SELECT l_orderkey AS paper_id, max(l_linenumber) AS n, max(l_linenumber) FILTER (l_linenumber % 3 = 1) AS c FROM lineitem GROUP BY ALL)
SELECT owner_id, p.paper_id, 'j' || p.paper_id AS job_id, CASE n % 3 WHEN 0 THEN 'running' WHEN 1 THEN 'completed' WHEN 2 THEN 'failed' ELSE 'queued' END AS status, CASE WHEN n IS NULL THEN 'queued' ELSE 'step ' || n END AS phase, c::BIGINT AS question_count, CASE WHEN n % 3 = 2 THEN 'timeout' END AS error, 'v3' AS prompt_version,
 CASE WHEN n % 3 = 1 THEN '{{"question_count":' || n || '}}' END AS last_quality_report, CASE WHEN n % 3 = 1 THEN 'j' || p.paper_id END AS last_extraction_job_id FROM papers p LEFT JOIN last USING (paper_id)"""


def class_progress(spark, d):
    b, p = src.bank(spark, d), src.papers(spark, d).select("owner_id", "class_id", "paper_id")
    routes = F.array(F.lit("vector"), F.lit("keyword"), F.lit("none"))
    q = b.join(p, "paper_id").select("owner_id", "class_id", "paper_id", F.when(F.col("question_no") % 2 == 0, F.col("chapter_id")).alias("chapter_id"), F.get(routes, (F.col("paper_id") % 3).cast("int")).alias("classified_by"), F.when(F.col("paper_id") % 5 == 0, F.concat(F.lit("e"), F.col("paper_id").cast("string"))).alias("error"), F.col("paper_id").alias("finished_at"))
    return R.class_progress(q)


PROGRESS = f"""WITH {PAPERS}, {BANK}, q AS (SELECT owner_id, class_id, paper_id, question_no % 2 = 0 AS a, ['vector', 'keyword', 'none'][paper_id % 3 + 1] AS r, CASE WHEN paper_id % 5 = 0 THEN 'e' || paper_id END AS e FROM bank JOIN papers USING (paper_id))
SELECT owner_id, class_id, paper_id, count(*) AS total, count(*) FILTER (a) AS assigned, arg_max(r, paper_id) FILTER (r <> 'none') AS classified_by, arg_max(e, paper_id) FILTER (e IS NOT NULL) AS error, false AS is_class FROM q GROUP BY ALL
UNION ALL SELECT owner_id, class_id, NULL, count(*), count(*) FILTER (a), arg_max(r, paper_id) FILTER (r <> 'none'), arg_max(e, paper_id) FILTER (e IS NOT NULL), true FROM q GROUP BY owner_id, class_id"""


def papers_grouped(spark, d):
    """Each class's papers under their sources in the fixed order, newest first."""
    from examlake.operators.bank import papers_of_classes

    p = src.papers(spark, d).withColumn("paper_source", F.when(F.col("paper_id") % 4 == 0, "Final exam").when(F.col("paper_id") % 4 == 1, "Model exam").when(F.col("paper_id") % 4 == 2, "Others").otherwise("Mock"))
    return papers_of_classes(p).select("owner_id", "class_id", F.explode("sources").alias("s")).select("owner_id", "class_id", "s.source", F.size("s.papers").alias("n"), F.array_join(F.transform(F.slice("s.papers", 1, 5), lambda x: x["paper_id"].cast("string")), ",").alias("newest"))


GROUPED = f"""WITH {PAPERS}, p AS (SELECT *, ['Final exam', 'Model exam', 'Others'][paper_id % 4 + 1] AS s FROM papers WHERE paper_id % 4 < 3)
SELECT owner_id, class_id, s AS source, count(*)::INT AS n, array_to_string(list_slice(list(paper_id ORDER BY year DESC, paper_id), 1, 5), ',') AS newest FROM p GROUP BY ALL"""


def constraint_violations(spark, d):
    from examlake.operators.audit import violations

    b = src.full_bank(spark, d).withColumn("difficulty_level", F.when(F.col("question_no") == 1, "Extreme").otherwise("Low")).withColumn("chapter_confidence", (F.col("marks") * 3).cast("int")).withColumn("material_id", F.when(F.col("question_no") == 2, F.lit("m0")).otherwise(F.col("material_id")))
    parents = src.full_bank(spark, d).select("owner_id", F.col("question_paper_id").alias("id")).where("id is not null and owner_id <> 'u6'").distinct()
    v = violations(b, "question_bank", ["owner_id", "id"], parents={"question_paper_id": parents})
    return v.groupBy("table", "rule").agg(F.count(F.lit(1)).alias("n"))


VIOLATIONS = f"""WITH {FULL}, b AS (SELECT * REPLACE (CASE WHEN question_no = 2 THEN 'm0' ELSE material_id END AS material_id), (marks * 3)::INT AS cc FROM full_bank), v AS (SELECT 'difficulty_level' AS rule FROM b WHERE question_no = 1
 UNION ALL SELECT 'chapter_confidence' FROM b WHERE cc NOT BETWEEN 0 AND 100 UNION ALL SELECT 'one origin' FROM b WHERE (material_id IS NULL) = (question_paper_id IS NULL) UNION ALL SELECT 'key' FROM (SELECT owner_id, id FROM b GROUP BY ALL HAVING count(*) > 1)
 UNION ALL SELECT 'question_paper_id' FROM b WHERE owner_id = 'u6' AND question_paper_id IS NOT NULL) SELECT 'question_bank' AS "table", rule, count(*) AS n FROM v GROUP BY ALL"""

QUERIES = {
    "quality_rates": (quality_rates, RATES),
    "validation_warnings": (validation_warnings, WARNINGS),
    "report_texts": (report_texts, REPORT_TEXTS),
    "bank_labels": (bank_labels, LABELS),
    "file_labels": (file_labels, FILE_LABELS),
    "syllabus_texts": (syllabus_texts, SYLLABUS),
    "text_routes": (text_routes, TEXT_ROUTES),
    "split_solutions": (split_solutions, SOLUTIONS),
    "notation_tokens": (notation_tokens, TOKENS),
    "build_totals": (build_totals, BUILD_TOTALS),
    "job_states": (job_states, JOB_STATES),
    "class_progress": (class_progress, PROGRESS),
    "papers_grouped": (papers_grouped, GROUPED),
    "constraint_violations": (constraint_violations, VIOLATIONS),
}
