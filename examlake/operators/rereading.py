"""The repair round: numbers that a paper lacks, or that look merged, are read again page by page and put in."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from examlake.functions import text as T
from examlake.operators.bank import FIGURES, LONG_TEXT
from examlake.operators.merging import finalize_questions
from examlake.operators.scans import keys_of, replace_numbers
from examlake.sources.written import written

#: Pages of a paper that are read again, numbers asked for on a page.
MOST_PAGES, MOST_NUMBERS = 28, 8
#: Fixed value: a question's number inside another's text.
EMBEDDED = r"\n\d{1,2}\.\s+[A-Z\"(]"
Reader = Callable[[DataFrame], DataFrame]


def numbers_to_read(rows: DataFrame, expected: DataFrame) -> DataFrame:
    """Paper keys, question_no: missing up to expected_count, repeated, or with a text that seems to hold another question.

    Texts of 850 characters or more seem so for numbers 17 to 28, and any with a number at a line's
    start. Papers of `expected` without a row are in the result; expected_count null or below 1: nothing is missing.
    """
    return _numbers(rows, expected).select(*keys_of(rows, expected), F.explode("numbers").alias("question_no"))


def _numbers(rows: DataFrame, expected: DataFrame) -> DataFrame:
    """Paper keys, numbers: `numbers_to_read` as one ascending array a paper; papers without any are left out."""
    keys, text, no = keys_of(rows, expected), F.col("question_text"), F.col("question_no")
    long = no.between(*FIGURES) & F.when(F.length(text) >= LONG_TEXT, F.length(T.strip(text)) >= LONG_TEXT).otherwise(False)
    merged = F.coalesce(long | text.rlike(EMBEDDED), F.lit(False))
    told = rows.where("question_no is not null").select(*keys, no.cast("int").alias("no"), merged.alias("merged"), F.lit(None).cast("int").alias("n"))
    counts = expected.where("expected_count >= 1").select(*keys, F.lit(None).cast("int").alias("no"), F.lit(False).alias("merged"), F.col("expected_count").cast("int").alias("n"))
    by_no = told.unionByName(counts).repartition(*keys).groupBy(*keys, "no").agg(((F.count(F.lit(1)) > 1) | F.max("merged")).alias("again"), F.max("n").alias("n"))
    # a count's own rows have no number, so the arrays pass them over
    per = by_no.groupBy(*keys).agg(F.collect_list("no").alias("have"), F.collect_list(F.when(F.col("again"), F.col("no"))).alias("again"), F.max("n").alias("n"))
    missing = F.when(F.col("n") >= 1, F.array_except(F.sequence(F.lit(1), F.col("n")), F.col("have"))).otherwise(F.array().cast("array<int>"))
    return T.worked_out(per, numbers=F.sort_array(F.concat(missing, "again"))).where(F.size("numbers") > 0).select(*keys, "numbers")


def read_again(pending: DataFrame, pages: DataFrame, reader: Reader, most: int = MOST_NUMBERS, most_pages: int = MOST_PAGES) -> DataFrame | None:
    """Rows that a reader finds of the pending numbers (paper keys, question_no), with page_no; None if there are none.

    pages: paper keys, n_pages. Page by page, the reader gets requests (paper keys, page_no, numbers: the
    first `most` that are still pending, ascending) of all papers at once and gives rows (paper keys,
    question_no, pos, question_text, ...). A pending number that comes is found, its first row by pos
    stands; numbers that are not pending are passed over. It ends after `most_pages` pages, the
    longest paper's last, or when nothing is pending.
    """
    keys = keys_of(pending, pages)
    return _read(pending.groupBy(*keys).agg(F.array_sort(F.collect_set(F.col("question_no").cast("int"))).alias("numbers")), pages, reader, most, most_pages)


def _read(asked: DataFrame, pages: DataFrame, reader: Reader, most: int = MOST_NUMBERS, most_pages: int = MOST_PAGES) -> DataFrame | None:
    """`read_again` of pending numbers that come as one ascending array a paper, and stay so from page to page."""
    keys = keys_of(asked, pages)
    places = pages.select(*keys, F.least("n_pages", F.lit(most_pages)).alias("__pages"))
    pending = written(asked.join(places, keys).where("__pages >= 1"), "pending")
    last, found = pending.agg(F.max("__pages")).first()[0] or 0, None
    first = Window.partitionBy(*keys, "question_no").orderBy("pos", "question_text")
    for page in range(1, last + 1):
        requests = pending.select(*keys, F.slice("numbers", 1, most).alias("numbers"), F.lit(page).alias("page_no"))
        some = reader(requests).join(pending.select(*keys, F.col("numbers").alias("__pending")), keys).where(F.array_contains("__pending", F.col("question_no"))).drop("__pending")
        some = written(some.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n").withColumn("page_no", F.lit(page)), "read_again")
        found = some if found is None else found.unionByName(some)
        if page == last:
            break
        got = some.groupBy(*keys).agg(F.collect_set(F.col("question_no").cast("int")).alias("__got"))
        left = F.when(F.col("__got").isNull(), F.col("numbers")).otherwise(F.array_except("numbers", "__got"))
        rest = T.worked_out(pending.where(F.col("__pages") > page).join(got, keys, "left"), numbers=left).select(*keys, "numbers", "__pages")
        pending = written(rest.where(F.size("numbers") > 0), "pending")
        if pending.isEmpty():
            break
    return found


def reread(rows: DataFrame, papers: DataFrame, reader: Reader, rounds: int = 1, final: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, questions): extracted rows with what was read again in place of the old, and finalize_questions of them, written.

    papers: paper keys, expected_count, n_pages, instructions. Each round asks for `numbers_to_read` of
    the finalised questions (final, where they are known) and, from the second on, only of papers whose
    set has shrunk; it ends early when there are none or the reader finds nothing. Only papers of which
    something was found are written and finalised anew.
    """
    keys = keys_of(rows, papers)
    final, before = written(finalize_questions(rows, papers), "questions") if final is None else final, None
    for _ in range(rounds):
        if before is None:
            asked = need = written(_numbers(final, papers.select(*keys, "expected_count")), "numbers")
        else:
            # the set of a paper of which nothing was found is as it was
            mine = [t.join(changed, keys, "left_semi") for t in (final, papers.select(*keys, "expected_count"))]
            need = written(_numbers(*mine), "numbers")
            earlier = before.select(*keys, F.size("numbers").alias("__before"))
            asked = need.join(earlier, keys).where(F.size("numbers") < F.col("__before")).drop("__before")
        found = _read(asked, papers, reader)
        if found is None or found.isEmpty():
            break
        changed = written(found.select(*keys).distinct(), "changed")
        own = rows.join(changed, keys, "left_semi")
        behind = own.groupBy(*keys).agg(F.max("row_order").alias("__last"))
        place = F.row_number().over(Window.partitionBy(*keys).orderBy("page_no", "pos", "question_no"))
        put = found.join(behind, keys, "left").withColumn("row_order", (F.coalesce("__last", F.lit(-1)) + place).cast("long"))
        put = put.select(*[(F.col(c) if c in put.columns else F.lit(None)).cast(rows.schema[c].dataType).alias(c) for c in rows.columns])
        new = written(replace_numbers(own, put), "rows")
        rows = rows.join(changed, keys, "left_anti").unionByName(new)
        final, before = written(final.join(changed, keys, "left_anti").unionByName(finalize_questions(new, papers)), "questions"), need
    return rows, final


def table_reader(readings: DataFrame) -> Reader:
    """A reader that looks pages up in a table (paper keys, page_no, pos, question_no, question_text, ...)."""

    def read(requests: DataFrame) -> DataFrame:
        keys = [*keys_of(requests, readings), "page_no"]
        return readings.join(requests.select(*keys, "numbers"), keys).where(F.array_contains("numbers", F.col("question_no"))).drop("numbers", "page_no")

    return read
