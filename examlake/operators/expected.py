"""How many questions and marks a paper should have, from what its rows and instructions say."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from examlake.functions import text as T
from examlake.operators.scans import keys_of

#: How instructions state totals, in the order in which they are believed.
TOTAL_QUESTIONS = [
    r"(?i)(?:question\s+paper\s+)?contains?\s+(\d{1,3})\s+questions?",
    r"(?i)(?:there\s+are|consists?\s+of)\s+(\d{1,3})\s+questions?",
    r"(?i)(?:total\s+of\s+)?(\d{1,3})\s+questions?\s+(?:in\s+all|altogether)",
    r"(?i)(\d{1,3})\s+questions?\s+in\s+all",
]
TOTAL_MARKS = [
    r"(?i)maximum\s+marks?\s*[:\-–—]?\s*(\d{1,3})",
    r"(?i)total\s+marks?\s*[:\-–—]?\s*(\d{1,3})",
    r"(?i)(?:paper|examination)\s+(?:is\s+of|carries?)\s+(\d{1,3})\s+marks?",
    r"(?i)(\d{1,3})\s+marks?\s*(?:in\s+all|total|maximum)",
]
#: The usual paper's questions; the most questions a paper may have; rows, checked rows and share of a match of marks.
USUAL, MOST = 33, 500
LEAST_ROWS, LEAST_CHECKED, MATCH = 16, 15, 0.65
META = ("total_questions", "total_marks", "instructions", "rules")


def stated_questions(instructions: Column) -> Column:
    return T.stated_total(instructions, TOTAL_QUESTIONS)


def stated_marks(instructions: Column) -> Column:
    return T.stated_total(instructions, TOTAL_MARKS)


def _held() -> dict[str, Column]:
    """The metadata of a row that count as said: totals from 1 on, a text that is not blank, rules if there are any."""
    return {
        "total_questions": F.when(F.col("total_questions") >= 1, F.col("total_questions")),
        "total_marks": F.when(F.col("total_marks") >= 1, F.col("total_marks")),
        "instructions": F.nullif(T.strip(F.col("instructions")), F.lit("")),
        "rules": F.when(F.size("rules") > 0, F.col("rules")),
    }


def paper_meta(rows: DataFrame, last: bool = False) -> DataFrame:
    """Each paper's first (or last) said total_questions, total_marks, instructions and rules, as far as rows have them, by row_order."""
    pick = F.max_by if last else F.min_by
    keys = keys_of(rows)
    return rows.groupBy(*keys).agg(*[pick(v, F.when(v.isNotNull(), F.col("row_order"))).alias(c) for c, v in _held().items() if c in rows.columns])


def rules_end(rules: Column) -> Column:
    """The last number that section rules speak of; null without rules."""
    return F.array_max(F.transform(rules, lambda r: r["to"]))


def total_marks(rules: Column, n: Column) -> Column:
    """Marks of the numbers 1 to n by section rules; null if a number has no rule, or there are none."""
    each = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda no: T.marks_by_rules(no, rules).cast("double"))
    whole = ~F.exists(each, lambda m: m.isNull())
    return F.when((n >= 1) & (F.size(rules) > 0) & whole, F.aggregate(each, F.lit(0.0), lambda a, m: a + m))


def expected_counts(rows: DataFrame, meta: DataFrame | None = None) -> DataFrame:
    """paper keys, expected_count, expected_marks of every paper that rows speak of.

    rows: paper keys, row_order, question_no, marks and META columns (rules: from, to, section, marks).
    With meta (`paper_meta`, one row a paper) rows need no META columns and have one row a number.
    The count is, in this order: the first total said by a row; the first that instructions state;
    the first total, or total stated in instructions, of any row in turn; 33 where the marks of 16
    rows or more match the usual sections; the end of the section rules, unless a higher number is
    there; 33 where 16 different numbers are; else unknown. Marks are the stated total, else the sum
    by the rules (said, or read off the instructions, or the usual ones for 33 questions).
    """
    keys = keys_of(rows)
    held, no = _held(), F.col("question_no")
    said = F.when(F.col("total_questions").between(1, MOST), F.col("total_questions"))
    row_total = F.coalesce(said, stated_questions(F.col("instructions")))
    usual = T.default_marks(no)
    checked = no.between(1, 40) & usual.isNotNull()
    counts = [F.count(F.lit(1)).alias("n"), F.count_if(checked).alias("n_checked"), F.count_if(checked & (F.col("marks") == usual)).alias("n_match"), F.max(F.when(no >= 1, no)).alias("max_no")]
    if meta is None:
        aggs = [F.min_by(v, F.when(v.isNotNull(), F.col("row_order"))).alias(c) for c, v in held.items()]
        per = rows.groupBy(*keys).agg(*aggs, F.min_by(row_total, F.when(row_total.isNotNull(), F.col("row_order"))).alias("by_row"), *counts, F.count_distinct(F.when(no >= 1, no)).alias("n_numbers"))
    else:
        per = rows.groupBy(*keys).agg(*counts, F.count_if(no >= 1).alias("n_numbers")).join(meta, keys, "left").withColumn("by_row", row_total)
    pattern = (F.col("n") >= LEAST_ROWS) & (F.col("n_checked") >= LEAST_CHECKED) & (F.col("n_match") / F.nullif(F.col("n_checked"), F.lit(0)) >= MATCH)
    end = rules_end(F.col("rules"))
    count = F.coalesce(
        F.when(F.col("total_questions").between(1, MOST), F.col("total_questions")), stated_questions(F.col("instructions")), F.col("by_row"), F.when(pattern, USUAL),
        F.when(F.col("max_no").isNull() | (end >= F.col("max_no")), end), F.when(F.col("n_numbers") >= 16, USUAL),
    ).cast("int")
    per = per.withColumn("expected_count", count)
    n = F.coalesce("total_questions", "expected_count").cast("int")
    read = T.section_rules(F.col("instructions"))
    own = F.transform("rules", lambda r: F.struct(r["from"].alias("from"), r["to"].alias("to"), r["section"].alias("section"), r["marks"].cast("int").alias("marks")))
    rules = F.coalesce(own, F.when(F.size(read) > 0, read))
    summed = F.when(rules.isNotNull(), total_marks(rules, n)).when(n == USUAL, F.lit(float(sum(m * k for m, k in ((1, 16), (2, 5), (3, 7), (4, 2), (5, 3))))))
    marks = F.coalesce(F.col("total_marks").cast("double"), stated_marks(F.col("instructions")).cast("double"), F.when(n.isNotNull(), summed))
    return per.select(*keys, "expected_count", marks.alias("expected_marks"))


def stamp_totals(rows: DataFrame, expected: DataFrame) -> DataFrame:
    """rows whose paper's count is known get it as total_questions; the others stay as they are."""
    keys = keys_of(rows, expected)
    joined = rows.join(expected.select(*keys, F.col("expected_count").alias("__total")), keys, "left")
    known = F.col("__total") >= 1
    return joined.withColumn("total_questions", F.when(known, F.col("__total")).otherwise(F.col("total_questions"))).drop("__total")
