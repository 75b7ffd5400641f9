"""Whole runs over all papers: classify, extract to bank rows, the library view."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from examlake.operators.bank import persist_questions
from examlake.operators.classify import ASSIGNED, apply_assignments, apply_overrides, classify_keyword
from examlake.operators.merging import finalize_questions
from examlake.operators.papers import validated_questions, validation_report
from examlake.operators.rereading import Reader, reread
from examlake.operators.scans import keys_of
from examlake.operators.vectors import classify_vector
from examlake.options import Options
from examlake.sources.written import written


def classify(questions: DataFrame, chapters: DataFrame, profiles: DataFrame | None = None, assignments: DataFrame | None = None) -> DataFrame:
    """questions with chapters by the first route that assigns any question of the paper: vectors, assignments, key words.

    questions need paper_id, row_order, class_id and the ASSIGNED columns, and for vectors question_id
    (unique with owner_id) and embedding. Vectors meet the chapters of their owner and class only; a
    best chapter that the class's index lacks gives none. classified_by names the paper's route, 'none' where no route assigned a question.
    """
    routes = []
    if profiles is not None:
        owner = keys_of(questions, profiles, keys=())
        inside = [*owner, *(["class_id"] if "class_id" in profiles.columns else [])]
        top = classify_vector(questions.where(F.col("embedding").isNotNull()).select(*inside, "question_id", "embedding"), profiles, scope=inside).where("rank = 1")
        of_class = keys_of(questions, chapters, keys=("class_id",))
        index = chapters.select(*of_class, "chapter_id", F.col("unit_id").alias("__unit"), F.col("name").alias("__name"))
        asked = questions.select(*keys_of(questions, keys=("class_id", "question_id")))
        best = top.select(*owner, "question_id", "chapter_id", F.col("confidence").alias("__c")).join(asked, [*owner, "question_id"]).join(index, [*of_class, "chapter_id"])
        best = best.select(*owner, "question_id", "chapter_id", "__c", "__unit", "__name")
        found = questions.drop(*ASSIGNED).join(best, [*owner, "question_id"], "left")
        sure = F.floor(F.col("__c") * 100 + 0.5).cast("int")
        routes.append(("vector", found.withColumn("unit_id", F.col("__unit")).withColumn("chapter_name", F.col("__name")).withColumn("chapter_confidence", sure).drop("__c", "__unit", "__name")))
    if assignments is not None:
        bare = questions
        for c in ASSIGNED:
            bare = bare.withColumn(c, F.lit(None).cast(questions.schema[c].dataType))
        routes.append(("assignments", apply_assignments(bare, assignments, chapters)))
    routes.append(("keyword", classify_keyword(questions, chapters)))
    keys = keys_of(questions, keys=("paper_id", "row_order"))
    papers = keys[:-1]
    rest = [c for c in questions.columns if c not in ASSIGNED]
    if len(routes) == 1:
        # the only route is every paper's in which it assigns a question; the others' chapters are null already
        assigned = F.max(F.col("chapter_id").isNotNull()).over(Window.partitionBy(*papers))
        return routes[0][1].select(*rest, *ASSIGNED, F.when(assigned, routes[0][0]).otherwise("none").alias("classified_by"))
    every = None
    for rank, (name, found) in enumerate(routes):
        part = found.select(*keys, F.struct(*[F.col(c) for c in ASSIGNED]).alias("__found"), F.lit(rank).alias("__rank"), F.lit(name).alias("classified_by"))
        every = part if every is None else every.unionByName(part)
    every = written(every, "routes")
    used = every.where(F.col("__found.chapter_id").isNotNull()).groupBy(*papers).agg(F.min("__rank").alias("__rank"))
    chosen = every.join(used, [*papers, "__rank"]).drop("__rank")
    rows = questions.join(chosen, keys, "left")
    return rows.select(*rest, *[F.col(f"__found.{c}").alias(c) for c in ASSIGNED], F.coalesce("classified_by", F.lit("none")).alias("classified_by"))


def process_papers(bank: DataFrame, extracted: DataFrame, papers: DataFrame, chapters: DataFrame, overrides: DataFrame, assignments: DataFrame | None = None, profiles: DataFrame | None = None, options: Options = Options(), reader: Reader | None = None, rounds: int = 1) -> tuple[DataFrame, DataFrame]:
    """(bank, reports) after a run: questions finalised, checked, classified, overridden and persisted.

    extracted: rows for merge_questions; papers: paper keys, class_id, expected_count, instructions;
    bank: paper keys, question_no, question_text, marks and the ASSIGNED columns. Chapters come by
    vectors (if profiles are given and extracted has embeddings), assignments or key words. Papers
    without a question keep their bank rows; options may leave out classification or the write. With a
    reader, numbers that lack or look merged are read again first (papers then need n_pages); `jobs.run_jobs`
    is the run with all its tables.
    """
    keys = keys_of(extracted, papers)
    expected = papers.select(*keys, "expected_count")
    final = finalize_questions(extracted, papers) if reader is None else reread(extracted, papers, reader, rounds)[1]
    rows = validated_questions(final, expected).join(papers.select(*keys, "class_id"), keys)
    for c in ASSIGNED:
        rows = rows.withColumn(c, F.lit(None).cast(bank.schema[c].dataType))
    if options.classify:
        vectors = profiles if options.use_vectors and "embedding" in rows.columns else None
        rows = classify(rows, chapters, vectors, assignments).drop("classified_by")
    rows = apply_overrides(rows, overrides, chapters)
    reports = validation_report(final, expected)
    if not options.persist:
        return bank, reports
    paper = F.struct(*keys)
    new = rows.select(*bank.columns)
    kept = persist_questions(bank.withColumn("__paper", paper), new.withColumn("__paper", paper), "__paper", [*keys, "question_no"])
    return kept.drop("__paper"), reports


def library_view(chapters: DataFrame, papers: DataFrame, bank: DataFrame, classifications: DataFrame) -> DataFrame:
    """Bank rows with their paper, chapter and unit names and the confidence shown: the classification's, else the row's."""
    of_chapter, of_paper, of_question = keys_of(bank, chapters, keys=("chapter_id",)), keys_of(bank, papers), keys_of(bank, classifications, keys=("paper_id", "question_no"))
    index = chapters.select(*of_chapter, "unit_id", F.col("name").alias("chapter_name"))
    sure = F.floor(F.col("confidence") * 100 + 0.5).cast("int")
    shown = classifications.select(*of_question, sure.alias("__sure"), "review_status")
    rows = bank.drop("unit_id", "chapter_name").join(papers.drop("class_id"), of_paper).join(index, of_chapter, "left")
    rows = rows.join(shown, of_question, "left")
    return rows.withColumn("chapter_confidence", F.coalesce("__sure", "chapter_confidence")).drop("__sure")
