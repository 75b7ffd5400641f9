"""Questions out of model answers, positioned text items and plain text, for all papers at once."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from examlake.functions import text as T
from examlake.operators.folds import Fold, fold_sorted, typed
from examlake.operators.merging import drop_near_copies, infer_marks
from examlake.operators.provider import Provider
from examlake.operators.scans import keys_of
from examlake.sources.written import written

#: Line tolerance, margin and column shares of the page width, shortest body, most questions a paper, chunk size.
LINE_TOLERANCE, MARGIN, ENGLISH_BAND = 4.0, 0.68, 0.42
SHORTEST, MOST_QUESTIONS, CHUNK = 15, 300, 28_000
#: Rows of a paper that may go on on the next page, characters shown of them.
LAST_ROWS, SNIPPET = 4, 80
HEADER_LINE = r"(?i)^SECTION\s*[-–—]|^Page\s+\d+|^P\.T\.O\."
OPTION_LINE = r"(?i)^\(\s*[A-D]\s*\)|^[A-D][).:\s]"
ANSWER = (
    "array<struct<question_no:string,questionNo:string,question_text:string,questionText:string,text:string,marks:string,hasFigure:boolean>>"
)
PAPER = f"struct<totalQuestions:string,total_questions:string,generalInstructions:string,general_instructions:string,questions:{ANSWER},continuations:array<struct<questionNo:string,question_no:string,appendText:string,append_text:string,questionText:string>>>"
QUESTION_COLUMNS = ["row_order", "question_no", "question_text", "marks", "has_figure"]


def _with_line_no(rows: DataFrame, page: list[str]) -> DataFrame:
    """rows with line_no: a page's items are read from the top, and a new line starts beyond the tolerance from the line's first item.

    Sorted pages stream through Arrow batches; only the keys and places are looked at one by one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, line, top = None, -1, 0.0
        for batch in batches:
            numbers = []
            for *key, y in zip(*[batch.column(c).to_pylist() for c in (*page, "y")], strict=True):
                if key != at:
                    at, line, top = key, 0, y
                elif abs(y - top) > LINE_TOLERANCE:
                    line, top = line + 1, y
                numbers.append(line)
            yield batch.append_column("line_no", pa.array(numbers, pa.int32()))

    dealt = rows.repartition(*page).sortWithinPartitions(*page, F.desc("y"), "x", "str")
    return dealt.mapInArrow(run, typed(rows, rows.columns, "line_no int"))


def lines_of_items(items: DataFrame) -> DataFrame:
    """Paper keys, page_no, line_no, body, margin_mark of positioned items (paper keys, page_no, page_width, str, x, y).

    body is the most readable of the right half, the English column and the left half; a number at the
    far right is the line's mark. Blank items are dropped, null places count as 0.
    """
    page, place = [*keys_of(items), "page_no"], [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in "xy"]
    rows = items.where(F.col("str").rlike(r"\S")).select(*page, F.col("page_width").cast("double").alias("page_width"), *place, "str")
    numbered = _with_line_no(rows, page)
    w = F.col("page_width")
    one = F.struct("x", F.col("str").alias("s"))
    lines = numbered.groupBy(*page, "line_no", "page_width").agg(F.array_sort(F.collect_list(one)).alias("items"))

    def text_of(keep) -> Column:
        part = F.array_join(F.transform(F.filter("items", lambda i: (i["x"] < w * MARGIN) & keep(i)), lambda i: i["s"]), " ")
        return T.strip(F.regexp_replace(part, r"\s+", " "))

    lines = T.worked_out(lines, left=text_of(lambda i: i["x"] < w * 0.5), right=text_of(lambda i: i["x"] >= w * 0.5), band=text_of(lambda i: i["x"] >= w * ENGLISH_BAND), all=text_of(lambda i: F.lit(True)))
    lines = T.worked_out(lines, a=T.readability(F.col("right")), b=T.readability(F.col("band")), c=T.readability(F.col("left")))
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    best = F.when((a >= c) & (a >= b) & (a > 0), F.col("right")).when((b >= c) & (b > 0), F.col("band")).when(c > 0, F.col("left")).otherwise(F.col("all"))
    marks = F.filter("items", lambda i: (i["x"] >= w * MARGIN) & F.trim(i["s"]).rlike(r"^\d{1,2}(\.\d+)?$"))
    lines = T.worked_out(lines, body=T.english_only(best), margin_mark=F.trim(F.try_element_at(marks, F.lit(-1))["s"]).cast("double"))
    return lines.select(*page, "line_no", "body", "margin_mark")


def layout_questions(items: DataFrame, most: int = MOST_QUESTIONS) -> DataFrame:
    """Questions of positioned items: a line `n. ...` starts one, readable lines and options go on with it.

    Lines before a paper's first start, headers and unreadable lines are dropped; of copies the first
    stays; the first `most` a paper (300) do too.
    """
    lines = lines_of_items(items).where((F.col("body") != "") & ~F.col("body").rlike(HEADER_LINE))
    rest = T.strip(F.regexp_extract("body", r"(?s)^\d{1,2}\.(?!\d)\s*(.*)$", 1))
    lines = T.worked_out(lines, __rest=rest)
    rest = F.col("__rest")
    starts = F.col("body").rlike(r"^\d{1,2}\.(?!\d)") & ((rest == "") | (~rest.rlike(r"^\d") & ((T.readability(rest) >= 8) | rest.rlike(r"(?i)^\(?[A-D]\)?[).:\s]"))))
    lines = T.worked_out(lines, __starts=starts, __goes_on=F.col("body").rlike(OPTION_LINE) | T.accepts_plain_text(F.col("body")))
    keys = keys_of(items)
    w = Window.partitionBy(*keys).orderBy("page_no", "line_no")
    lines = lines.withColumn("__seg", F.sum(F.col("__starts").cast("int")).over(w)).where("__seg > 0")
    lines = lines.where(F.col("__starts") | F.col("__goes_on"))
    one = F.struct("page_no", "line_no", F.when(F.col("__starts"), F.col("__rest")).otherwise(F.col("body")).alias("t"), F.col("margin_mark").alias("m"))
    first = F.when(F.col("__starts"), F.regexp_extract("body", r"^(\d{1,2})\.", 1).cast("int"))
    found = lines.groupBy(*keys, F.col("__seg").alias("row_order")).agg(F.max(first).alias("question_no"), F.array_sort(F.collect_list(one)).alias("lines"))
    body = T.strip(F.array_join(F.filter(F.transform("lines", lambda x: x["t"]), lambda t: t != ""), "\n"))
    margin = F.try_element_at(F.filter(F.transform("lines", lambda x: x["m"]), lambda m: m > 0), F.lit(1))
    found = T.worked_out(found, __body=body, __margin=margin)
    found = T.worked_out(found, question_text=T.notation(F.col("__body")), marks=F.coalesce(F.col("__margin"), T.marks_in_text(F.col("__body")).cast("double")))
    found = found.where((F.length("question_text") >= SHORTEST) & T.accepts_plain_text(F.col("question_text")))
    return _capped(drop_near_copies(found.withColumn("has_figure", F.lit(False)).select(*keys, *QUESTION_COLUMNS)), most)


def _capped(questions: DataFrame, most: int) -> DataFrame:
    w = Window.partitionBy(*keys_of(questions)).orderBy("row_order")
    return questions.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= most).drop("__n")


def text_questions(documents: DataFrame, most: int = MOST_QUESTIONS) -> DataFrame:
    """Questions of plain texts (paper keys, text): chunks of 15 characters or more with their number and marks.

    The number is the one that a chunk starts with, else its position. The first `most` a paper (300) stay.
    """
    keys = keys_of(documents)
    cut = documents.select(*keys, F.posexplode(T.question_chunks(F.col("text"))).alias("pos", "chunk"))
    rows = cut.where(F.length("chunk") >= SHORTEST)
    rows = T.worked_out(rows, question_text=T.notation(T.english_only(F.col("chunk"))))
    out = rows.select(*keys, F.col("pos").cast("long").alias("row_order"), T.chunk_number(F.col("chunk"), F.col("pos")).alias("question_no"), "question_text", T.marks_in_text(F.col("chunk")).cast("double").alias("marks"), F.lit(False).alias("has_figure"))
    return _capped(out.where(F.col("question_text") != ""), most)


class _Chunks(Fold):
    """Numbers pages by chunk: a page that would make the chunk too long starts the next."""

    def __init__(self) -> None:
        self.chunk, self.size = 0, 0

    def feed(self, row) -> list[tuple]:
        more = row.n_chars + (len(T.PAGE_MARK) if self.size else 0)
        if self.size and self.size + more > CHUNK:
            self.chunk, self.size, more = self.chunk + 1, 0, row.n_chars
        self.size += more
        return [(*row[:-1], self.chunk)]


def text_chunks(pages: DataFrame) -> DataFrame:
    """Paper keys, chunk_no, text: pages (paper keys, page_no, text) joined by the page mark to 28,000 characters at most.

    A longer page is a chunk of its own. Blank pages are dropped.
    """
    rows = pages.where(F.col("text").rlike(r"\S")).withColumn("text", T.strip(F.col("text")))
    keys = keys_of(pages)
    sizes = rows.select(*keys, "page_no", F.length("text").alias("n_chars"))
    placed = fold_sorted(sizes, keys, ["page_no"], typed(sizes, [*keys, "page_no"], "chunk_no int"), _Chunks)
    one = F.struct("page_no", "text")
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(one)), lambda p: p["text"]), T.PAGE_MARK)
    return rows.join(placed, [*keys, "page_no"]).groupBy(*keys, "chunk_no").agg(whole.alias("text"))


def flatten_model_answers(answers: DataFrame, provider: Provider | None = None) -> DataFrame:
    """Questions, and their paper's metadata, of model answers (paper keys, answer_no, answer as JSON text).

    An answer is an array of questions, {questions: [...]} or {papers: [{questions: [...]}]}. Text that
    is not JSON gives no rows; entries without an acceptable text are dropped; a missing number is the
    entry's position; marks are filled by the rules in the paper's instructions. With a provider,
    `answers` are its requests (paper keys, answer_no, and what is asked); those that fail give no rows.
    """
    if provider is not None:
        answers = written(provider(answers), "answers")
    raw, keys = F.col("answer"), keys_of(answers)
    listed = F.from_json(raw, ANSWER)
    held = F.from_json(raw, f"struct<papers:array<{PAPER}>,{PAPER[7:]}")
    whole = F.struct(*[held[c].alias(c) for c in ("totalQuestions", "total_questions", "generalInstructions", "general_instructions", "questions", "continuations")])
    one = F.when(F.size(held["papers"]) > 0, held["papers"]).otherwise(F.array(whole))
    lists = F.when(F.ltrim(raw).startswith("["), F.array(listed)).otherwise(F.transform(one, lambda p: p["questions"]))
    metas = F.when(F.ltrim(raw).startswith("["), F.expr("cast(array() as array<struct<total:int,instructions:string>>)")).otherwise(
        F.transform(one, lambda p: F.struct(F.coalesce(p["totalQuestions"], p["total_questions"], held["totalQuestions"]).try_cast("int").alias("total"), F.coalesce(p["generalInstructions"], p["general_instructions"], held["generalInstructions"]).alias("instructions")))
    )
    rows = answers.where(F.try_parse_json(raw).isNotNull()).select(*keys, "answer_no", lists.alias("lists"), metas.alias("metas"))
    rows = rows.select(*keys, "answer_no", "metas", F.posexplode("lists").alias("__i", "list"))
    rows = rows.select(*keys, "answer_no", "__i", F.try_element_at("metas", F.col("__i") + 1).alias("__meta"), F.posexplode("list").alias("__j", "q"))
    text = T.notation(T.english_only(T.strip(F.coalesce("q.questionText", "q.question_text", "q.text"))))
    no = F.coalesce(F.coalesce("q.questionNo", "q.question_no").try_cast("int"), F.col("__j") + 1)
    order = F.row_number().over(Window.partitionBy(*keys).orderBy("answer_no", "__i", "__j")).cast("long")
    rows = T.worked_out(rows, question_text=text).where(T.accepts_model_text(F.col("question_text")))
    rows = rows.select(*keys, order.alias("row_order"), no.alias("question_no"), "question_text", F.col("q.marks").try_cast("double").alias("marks"), F.coalesce("q.hasFigure", F.lit(False)).alias("has_figure"), F.when(F.col("__meta.total") >= 1, F.col("__meta.total")).alias("total_questions"), F.col("__meta.instructions").alias("instructions"))
    return infer_marks(rows, T.section_rules(F.col("instructions")))


def extracted_so_far(questions: DataFrame, expected: DataFrame | None = None, last: int = LAST_ROWS) -> DataFrame:
    """Paper keys, numbers (ascending, different, from 1 on), expected_count, unfinished of questions already read.

    unfinished: array<struct<question_no, ends>> of those among a paper's last four rows that seem to go on
    on the next page, with the first 80 characters of their text on one line. It is what a reader of
    the next page is told; expected is null where no count is known.
    """
    keys = keys_of(questions) if expected is None else keys_of(questions, expected)
    w = Window.partitionBy(*keys).orderBy(F.desc("row_order"))
    rows = questions.select(*keys, "row_order", "question_no", "question_text").withColumn("__last", F.row_number().over(w) <= last)
    goes_on = F.col("__last") & T.looks_unfinished(F.col("question_no"), F.col("question_text"))
    ends = F.regexp_replace(F.substring(T.strip(F.col("question_text")), 1, SNIPPET), "\n", " ")
    one = F.when(goes_on, F.struct("row_order", F.struct("question_no", ends.alias("ends")).alias("q")))
    numbers = F.array_sort(F.collect_set(F.when(F.col("question_no") >= 1, F.col("question_no"))))
    out = rows.groupBy(*keys).agg(numbers.alias("numbers"), F.transform(F.array_sort(F.collect_list(one)), lambda x: x["q"]).alias("unfinished"))
    if expected is None:
        return out.withColumn("expected_count", F.lit(None).cast("int"))
    return out.join(expected.select(*keys, F.when(F.col("expected_count") >= 1, F.col("expected_count")).alias("expected_count")), keys, "left")


def choose_extraction(*routes: tuple[str, DataFrame]) -> DataFrame:
    """Each paper's questions by the first route, in the order given, that found any; extracted_by names it."""
    every, keys = None, keys_of(*[found for _, found in routes])
    for rank, (name, found) in enumerate(routes):
        part = found.select(*keys, *QUESTION_COLUMNS, F.lit(name).alias("extracted_by"), F.lit(rank).alias("__rank"))
        every = part if every is None else every.unionByName(part)
    best = every.groupBy(*keys).agg(F.min("__rank").alias("__rank"))
    return every.join(best, [*keys, "__rank"]).drop("__rank")
