"""Question sets of whole papers: checks, continuations, page texts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from examlake.operators.merging import merge_rows
from examlake.operators.scans import keys_of, set_key

#: What marks a row as printed instructions, the most a number may be where no total is known, the page mark.
INSTRUCTIONS = r"(?im)General Instructions|All questions are compulsory|contains \d+ questions|Read the following instructions|SECTION\s*[-–—]\s*[A-E]\s*$"
MOST_NUMBERS = 500
#: One of these is in every text that INSTRUCTIONS finds, in lower case; most texts hold none.
_TOLD_BY = ("general instructions", "all questions are compulsory", "contains ", "read the following instructions", "section")
PAGE_BREAK = "\n\n---PAGE---\n\n"


def is_question(no: Column, text: Column, most: Column) -> Column:
    """True for a row with a possible number and a text of 12 characters or more that is not an instruction."""
    text = F.coalesce(text, F.lit(""))
    t = F.regexp_replace(text, r"^\s+|\s+$", "")
    maybe = reduce(Column.__or__, [F.contains(F.lower(text), F.lit(x)) for x in _TOLD_BY])
    return F.coalesce(no.between(1, F.coalesce(most, F.lit(MOST_NUMBERS))), F.lit(False)) & (F.length(text) >= 12) & (F.length(t) >= 12) & ~F.when(maybe, t.rlike(INSTRUCTIONS)).otherwise(False)


def validated_questions(questions: DataFrame, expected: DataFrame) -> DataFrame:
    """One valid row for each paper, set (series:set:code, where questions have them) and number: its rows met pairwise by row_order.

    `expected` has the paper keys and expected_count (null: unknown). Null numbers are dropped. The row
    whose text stands gives the other columns (see `merging.met`).
    """
    keys = keys_of(questions, expected)
    rows = questions.join(expected.select(*keys, "expected_count"), keys, "left")
    rows = rows.where(is_question(F.col("question_no"), F.col("question_text"), F.col("expected_count")))
    sets = {"series", "set", "code_no"} <= set(questions.columns)
    rows = rows.withColumn("set_key", set_key() if sets else F.lit(""))
    return merge_rows(rows, [*keys, "set_key", "question_no"]).drop("set_key")


def confirm_numbering(questions: DataFrame, expected: DataFrame) -> DataFrame:
    """Paper keys, expected_count, actual_count, missing, extra (both ascending), confirmed of question sets as they are.

    extra are numbers below 1 or above the count; confirmed asks for none missing, none extra and as
    many rows as expected. Where no count (or 0) is known, nothing is missing or extra and confirmed is
    null. Papers of `expected` without rows are in the result.
    """
    keys = keys_of(questions, expected)
    none, total = F.array().cast("array<int>"), F.col("expected_count")
    per = questions.groupBy(*keys).agg(F.sort_array(F.collect_set(F.col("question_no").cast("int"))).alias("present"), F.count(F.lit(1)).alias("n"))
    rows = expected.select(*keys, "expected_count").join(per, keys, "left").withColumn("present", F.coalesce("present", none))
    known = F.coalesce(total > 0, F.lit(False))
    missing = F.when(known, F.array_except(F.sequence(F.lit(1), total), "present")).otherwise(none)
    extra = F.when(known, F.filter("present", lambda n: (n < 1) | (n > total))).otherwise(none)
    rows = rows.withColumn("missing", missing).withColumn("extra", extra)
    n = F.coalesce("n", F.lit(0))
    return rows.select(*keys, F.when(known, total).alias("expected_count"), n.alias("actual_count"), "missing", "extra", F.when(known, (F.size("missing") == 0) & (F.size("extra") == 0) & (n == total)).alias("confirmed"))


def validation_report(questions: DataFrame, expected: DataFrame) -> DataFrame:
    """Paper keys, expected_count, actual_count, dropped, missing and extra (ascending), confirmed; papers of `expected` without rows too.

    actual_count counts the rows kept, of all sets. confirmed is null where no total is known.
    """
    keys = keys_of(questions, expected)
    kept = validated_questions(questions, expected)
    known = F.coalesce(F.col("expected_count") > 0, F.lit(False))
    kept = kept.where(~known | (F.col("question_no") <= F.col("expected_count")))
    read = questions.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_read"))
    rows = confirm_numbering(kept.drop("expected_count"), expected).join(read, keys, "left")
    return rows.select(*keys, "expected_count", "actual_count", (F.coalesce("n_read", F.lit(0)) - F.col("actual_count")).alias("dropped"), "missing", "extra", "confirmed")


def apply_continuations(questions: DataFrame, continuations: DataFrame) -> DataFrame:
    """Paper keys, question_no, question_text, with the paper's continuation texts put behind, in order of pos.

    Needs one row a paper and number. A number that the paper lacks becomes a row of its own. Blank
    texts and null numbers among the continuations are passed over.
    """
    more = continuations.where(F.col("question_no").isNotNull() & F.col("append_text").rlike(r"\S"))
    part = F.struct("pos", F.regexp_replace("append_text", r"^\s+|\s+$", "").alias("t"))
    keys = [*keys_of(questions, continuations), "question_no"]
    more = more.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda p: p["t"]), "\n").alias("more"))
    rows = questions.select(*keys, "question_text").join(more, keys, "full_outer")
    return rows.select(*keys, F.concat_ws("\n", F.when(F.col("question_text") != "", F.col("question_text")), "more").alias("question_text"))


def document_text(pages: DataFrame) -> DataFrame:
    """Paper keys, text: the paper's pages (paper keys, page_no, text) in order, white space inside a page as one space."""
    clean = F.regexp_replace(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " "), "^ | $", "")
    one = F.struct("page_no", clean.alias("text"))
    return pages.groupBy(*keys_of(pages)).agg(F.array_join(F.transform(F.array_sort(F.collect_list(one)), lambda p: p["text"]), PAGE_BREAK).alias("text"))
