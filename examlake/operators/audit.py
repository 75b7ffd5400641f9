"""Constraint audit: rows that break the rules of the stored tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from examlake.sources.written import written

#: The values that columns may hold, by table.
ALLOWED = {
    "materials": {"material_type": ("Question papers", "Class Notes", "Syllabus"), "source_kind": ("local", "drive", "other"), "exam_source": ("Class work", "Test")},
    "question_papers": {"paper_source": ("Final exam", "Model exam", "Others")},
    "question_bank": {"origin_type": ("material", "question_paper"), "difficulty_level": ("not Rated", "Low", "Medium", "High"), "source": ("Class work", "Test", "Final exam", "Model exam", "Others")},
    "syllabus_knowledge": {"extract_status": ("pending", "complete", "failed")},
    "extraction_jobs": {
        "status": ("queued", "running", "completed", "failed"),
        "phase": ("queued", "downloading", "extracting", "classifying", "validating", "saving", "completed", "failed"),
        "extracted_by": ("ai", "heuristic", "none"),
        "classified_by": ("vector", "ai", "heuristic", "none"),
    },
    "openai_usage_events": {"action": ("extract.text", "extract.vision", "classify.vector", "classify.llm", "syllabus.concepts", "syllabus.embed")},
    "question_classifications": {
        "review_status": ("AUTO_APPROVED", "SUGGEST_REVIEW", "MANUAL_REVIEW_REQUIRED"),
        "classification_source": ("VECTOR", "AI_RERANK", "HEURISTIC_FALLBACK", "MANUAL_OVERRIDE"),
    },
}
#: numbers' least and greatest values, and columns that may not be null, by table.
RANGES = {"question_bank": {"chapter_confidence": (0, 100)}, "question_classifications": {"confidence": (0, 1)}}
NEEDED = {
    "question_bank": ("owner_id", "id", "origin_type", "class_id", "question_text", "source"),
    "question_classifications": ("owner_id", "question_id", "chapter_id"),
    "question_papers": ("owner_id", "id", "class_id", "name", "year"),
    "materials": ("owner_id", "id", "chapter_id", "name", "material_type"),
}
#: Fixed value: about as many rows a task groups or joins at once, however large the table is.
ROWS = 500_000


def row_rules(table: str, columns: list[str]) -> dict[str, Column]:
    """{rule: True where a row breaks it} for the rules of a table whose columns are there; nulls break needed columns only."""
    rules = {c: ~F.col(c).isin(*values) for c, values in ALLOWED.get(table, {}).items() if c in columns}
    rules |= {c: ~F.col(c).between(*ends) for c, ends in RANGES.get(table, {}).items() if c in columns}
    rules |= {f"{c} is needed": F.col(c).isNull() for c in NEEDED.get(table, ()) if c in columns}
    if table == "question_bank" and {"material_id", "question_paper_id"} <= set(columns):
        rules["one origin"] = F.col("material_id").isNull() == F.col("question_paper_id").isNull()
    return rules


def violations(rows: DataFrame, table: str, keys: list[str], parents: dict[str, DataFrame] | None = None) -> DataFrame:
    """table, key, rule: a row for each rule that a row breaks, for each repeated key, and for each reference without a parent.

    parents: {column: table of (owner_id, id)}. The row rules are one pass without a shuffle; what it
    finds is written once with the keys and references, and these are dealt to tasks by their number, so
    that no task's memory grows with the table.
    """
    broken = F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in row_rules(table, rows.columns).items()]))
    links = ["owner_id", *parents] if parents else []
    rows = written(rows.select(*dict.fromkeys([*keys, *links]), broken.alias("__broken")), "audited")
    tasks = -(-rows.count() // ROWS) or 1
    key = F.concat_ws("/", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]).alias("key")
    found = [rows.select(key, F.explode("__broken").alias("rule"))]
    found.append(rows.select(*keys).repartition(tasks, *keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(key, F.lit("key").alias("rule")))
    for column, parent in (parents or {}).items():
        known = parent.select("owner_id", F.col("id").alias(column)).repartition(tasks, "owner_id", column)
        referring = rows.where(F.col(column).isNotNull()).select(*dict.fromkeys([*keys, "owner_id", column])).repartition(tasks, "owner_id", column)
        found.append(referring.join(known, ["owner_id", column], "left_anti").select(key, F.lit(column).alias("rule")))
    return reduce(DataFrame.unionByName, found).select(F.lit(table).alias("table"), "key", "rule")
