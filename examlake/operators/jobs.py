"""Whole runs of extraction jobs: every table that a run of a paper leaves behind, for all papers at once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from examlake.functions import text as T
from examlake.operators.bank import quality_report
from examlake.operators.classify import ASSIGNED, apply_overrides
from examlake.operators.expected import META, expected_counts, paper_meta
from examlake.operators.merging import finalize_questions
from examlake.operators.papers import is_question
from examlake.operators.provider import Provider, vectors_of
from examlake.operators.records import classification_rows, paper_bank_rows, persist_bank_rows
from examlake.operators.reports import split_solution, stamp_reports
from examlake.operators.rereading import Reader, reread
from examlake.operators.usage import usage_summaries
from examlake.operators.workflow import classify
from examlake.options import Options
from examlake.sources.written import written

#: Routes as jobs and classifications name them.
JOB_ROUTES = {"vector": "vector", "assignments": "ai", "keyword": "heuristic", "none": "none"}
ROUTE_SOURCES = {"vector": "VECTOR", "assignments": "AI_RERANK", "keyword": "HEURISTIC_FALLBACK"}
RULES = "array<struct<section:string,from:int,to:int,marks:double>>"
META_KINDS = {"total_questions": "int", "total_marks": "double", "instructions": "string", "rules": RULES}
NOTHING = "No question could be extracted."
KEYS = ["owner_id", "paper_id"]


@dataclass(frozen=True)
class Run:
    """The tables after a run, and its questions and reports."""

    bank: DataFrame
    classifications: DataFrame
    jobs: DataFrame
    papers: DataFrame
    questions: DataFrame
    reports: DataFrame


def as_told(rows: DataFrame, options: Options) -> DataFrame:
    """Extracted rows with doubtful fractions rewritten too, where options do not ask for the text as it stands, and with solutions split off where they do."""
    if not options.strict_verbatim:
        rows = rows.withColumn("question_text", T.notation(F.col("question_text"), strict=False))
    if options.extract_solutions:
        parts = T.worked_out(rows, __parts=split_solution(F.col("question_text"), enabled=True))
        told = F.col("__parts.solution")
        kept = F.coalesce("solution", told) if "solution" in rows.columns else told
        rows = parts.withColumn("question_text", F.col("__parts.question_text")).withColumn("solution", kept).drop("__parts")
    return rows


def _named(column: str, names: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for name, put in names.items():
        out = F.when(F.col(column) == name, put).otherwise(out)
    return out


def run_jobs(
    jobs: DataFrame, papers: DataFrame, extracted: DataFrame, bank: DataFrame, classifications: DataFrame, chapters: DataFrame, overrides: DataFrame, usage: DataFrame, now: Column,
    reader: Reader | None = None, rounds: int = 1, assignments: DataFrame | None = None, profiles: DataFrame | None = None, embedder: Provider | None = None, failures: DataFrame | None = None, options: Options = Options(),
) -> Run:
    """Everything that the jobs' papers come to, out of one written extraction.

    Extracted rows are merged, numbers that lack or look merged are read again (with a reader), the
    paper's expected count is worked out, rows are checked, counted and reported on, get chapters by
    vectors, assignments or key words and teachers' choices over them; bank, classifications, jobs and
    papers are written by key. A job without a question fails with its reason (failures: owner_id,
    paper_id, reason) and leaves its paper's bank rows; jobs of other papers stay as they are.

    jobs: owner_id, job_id, paper_id, status, phase, question_count, error, updated_at, ..., one a paper;
    papers: owner_id, paper_id, class_id, paper_source, year, n_pages, last_quality_report,
    last_extraction_job_id; extracted: owner_id, paper_id, row_order, question_no, question_text, marks,
    has_figure, extracted_by and, where rows say them, total_questions, total_marks, instructions, rules;
    usage: events with owner_id and job_id. With options.persist off bank and classifications stay; with
    extract_solutions a number's first solution goes to the bank, with strict_verbatim off doubtful
    fractions are rewritten.
    """
    mine = papers.join(jobs.select(*KEYS), KEYS, "left_semi")
    mine = written(mine.select(*KEYS, "class_id", "paper_source", "year", "n_pages"), "papers")
    said = [c for c in META if c in extracted.columns]
    rows = written(as_told(extracted.join(mine.select(*KEYS), KEYS, "left_semi"), options), "extracted")
    meta = written(paper_meta(rows), "meta")
    meta = meta.select(*KEYS, *[F.col(c) if c in said else F.lit(None).cast(META_KINDS[c]).alias(c) for c in META])
    rows = rows.drop(*META)
    told = mine.select(*KEYS, "n_pages")
    if "instructions" in said:
        told = told.join(meta.select(*KEYS, "instructions"), KEYS, "left")
    final = finalize_questions(rows, told, hold=True)
    if reader is not None:
        known = written(told.join(expected_counts(final, meta).select(*KEYS, "expected_count"), KEYS, "left"), "expected")
        rows, final = reread(rows, known, reader, rounds, final)
    by = rows.select(*KEYS, "extracted_by").repartition(*KEYS).distinct().groupBy(*KEYS).agg(F.min("extracted_by").alias("extracted_by"))
    known = written(mine.drop("n_pages").join(expected_counts(final, meta), KEYS, "left").join(by, KEYS, "left"), "expected")
    # final has one row a number, so checked rows have no copies to be met
    questions = final.join(known.drop("expected_marks"), KEYS).where(is_question(F.col("question_no"), F.col("question_text"), F.col("expected_count")))
    questions = questions.withColumn("question_id", F.concat_ws("-", F.col("paper_id").cast("string"), F.col("question_no").cast("string")))
    questions = questions.withColumn("total_questions", F.when(F.col("expected_count") >= 1, F.col("expected_count"))).drop("expected_count")
    for c in ASSIGNED:
        questions = questions.withColumn(c, F.lit(None).cast("int" if c == "chapter_confidence" else "string"))
    questions = _classified(questions, chapters, overrides, assignments, profiles, embedder, options)
    if "solution" in rows.columns:
        told = rows.where("question_no is not null").groupBy(*KEYS, "question_no").agg(F.min_by("solution", F.when(F.col("solution").isNotNull(), F.col("row_order"))).alias("solution"))
        questions = questions.join(told, [*KEYS, "question_no"], "left")
    questions = written(questions, "classified")
    reports = quality_report(known.select(*KEYS, "expected_count", "expected_marks"), questions, single=True)
    if options.persist:
        facts = F.create_map(F.lit("totalQuestions"), F.col("total_questions").cast("string"), F.lit("marksInferred"), F.when(F.col("marks_inferred"), "true"), F.lit("hasFigure"), F.when(F.col("has_figure"), "true"))
        new = paper_bank_rows(questions.withColumn("id", F.col("question_id")).withColumn("metadata", facts))
        bank, classifications = persist_bank_rows(bank, classifications, new, classification_rows(questions, _named("classified_by", ROUTE_SOURCES)), hold=False)
    questions = questions.drop("paper_source", "year")
    done = _job_rows(jobs, questions, reports, usage, failures, now)
    stamped = done.where("status = 'completed'").select(*KEYS, F.col("quality_report").alias("last_quality_report"), F.col("job_id").alias("last_extraction_job_id"))
    # every job has its row in done, so nothing of the old ones is left to be looked up
    done = done.select(*jobs.columns, *[c for c in done.columns if c not in jobs.columns])
    return Run(bank, classifications, done, stamp_reports(papers, stamped), questions, reports)


def _classified(questions: DataFrame, chapters: DataFrame, overrides: DataFrame, assignments: DataFrame | None, profiles: DataFrame | None, embedder: Provider | None, options: Options) -> DataFrame:
    if not options.classify:
        return questions.withColumn("classified_by", F.lit("none")).withColumn("classification_source", F.lit(None).cast("string"))
    vectors = profiles if options.use_vectors and embedder is not None else None
    if vectors is not None:
        known = written(vectors_of(questions.select(F.col("question_text").alias("input")), embedder), "vectors").select("input", "embedding")
        questions = questions.withColumn("input", T.strip(F.col("question_text"))).join(known, "input", "left").drop("input")
    if vectors is not None or assignments is not None:
        questions = written(questions, "checked")  # read by each route
    found = classify(questions, chapters, vectors, assignments).drop("embedding")
    return apply_overrides(found, overrides, chapters, source="classification_source")


def _job_rows(jobs: DataFrame, questions: DataFrame, reports: DataFrame, usage: DataFrame, failures: DataFrame | None, now: Column) -> DataFrame:
    """The jobs' final rows: state, routes, counts, report and usage as JSON, error; a paper's questions have one extracted_by and one classified_by."""
    per = questions.groupBy(*KEYS, F.col("extracted_by").alias("__extracted"), F.col("classified_by").alias("__route")).agg(F.count(F.lit(1)).alias("n"))
    told = reports.select(*KEYS, F.to_json(F.struct(*[c for c in reports.columns if c not in KEYS])).alias("__report"))
    used = usage_summaries(usage).select("owner_id", "job_id", F.to_json(F.struct("pricing_version", "by_action", "totals")).alias("__usage"))
    rows = jobs.join(per, KEYS, "left").join(told, KEYS, "left").join(used, ["owner_id", "job_id"], "left")
    rows = rows.withColumn("__why", F.lit(None).cast("string")) if failures is None else rows.join(failures.select(*KEYS, F.col("reason").alias("__why")), KEYS, "left")
    good = F.col("n") > 0
    put = {
        "status": F.when(good, "completed").otherwise("failed"), "phase": F.when(good, "completed").otherwise("failed"),
        "question_count": F.when(good, F.col("n")).otherwise(F.col("question_count")).cast("long"), "error": F.when(~F.coalesce(good, F.lit(False)), F.coalesce("__why", F.lit(NOTHING))),
        "extracted_by": F.when(good, F.coalesce("__extracted", F.lit("none"))), "classified_by": F.when(good, _named("__route", JOB_ROUTES)),
        "quality_report": F.when(good, F.col("__report")), "usage_summary": F.when(good, F.col("__usage")), "finished_at": now, "updated_at": now,
    }
    return rows.select(*[c for c in jobs.columns if c not in put], *[c.alias(k) for k, c in put.items()])
