"""Fixed cases of the classification and paper operators."""

from pyspark.sql import functions as F

from examlake.operators import classify as C
from examlake.operators import papers as P

CHAPTERS = "class_id int, chapter_pos int, chapter_id string, unit_id string, name string"
QUESTIONS = "class_id int, paper_id int, question_no int, question_text string, chapter_id string, unit_id string, chapter_name string, chapter_confidence int"


def _chapters(spark):
    return spark.createDataFrame([(1, 0, "electric", "u1", "Chapter 12: Electric Charges and Fields"), (1, 1, "magnet", "u1", "Chapter 13: Moving Charges and Magnetism")], CHAPTERS)


def _questions(spark):
    texts = {1: "State Coulomb's law for electric charges and fields.", 2: "Unrelated generic text with no chapter keywords.", 3: None}
    rows = [(1, 7, n, t, None, None, None, None) for n, t in texts.items()] + [(2, 8, 1, "Electric charges and fields", None, None, None, None)]
    return spark.createDataFrame(rows, QUESTIONS)


def _found(df):
    return {(r.paper_id, r.question_no): (r.chapter_id, r.chapter_confidence) for r in df.collect()}


def test_keywords_and_overrides(spark):
    got = C.classify_keyword(_questions(spark), _chapters(spark))
    assert _found(got) == {(7, 1): ("electric", 83), (7, 2): (None, None), (7, 3): (None, None), (8, 1): (None, None)}
    put = spark.createDataFrame([(7, 1, "magnet", 1.0), (7, 2, "gone", 1.0)], "paper_id int, question_no int, chapter_id string, confidence double")
    assert _found(C.apply_overrides(got, put, _chapters(spark)))[7, 1] == ("magnet", 100)
    assert _found(C.apply_overrides(got, put, _chapters(spark)))[7, 2] == (None, None)


def test_assignments(spark):
    given = [(7, 1, 0, "magnet", None, 84.5), (7, 2, 0, None, "chapter 13: moving charges AND magnetism", 101.0), (7, 3, 0, "electric", None, 5.0), (7, 3, 1, None, "see Chapter-12", None)]
    given = spark.createDataFrame(given, "paper_id int, question_no int, pos int, chapter_id string, chapter_name string, confidence double")
    got = _found(C.apply_assignments(_questions(spark), given, _chapters(spark)))
    assert got == {(7, 1): ("magnet", 85), (7, 2): ("magnet", 100), (7, 3): ("electric", None), (8, 1): (None, None)}
    none = C.apply_assignments(_questions(spark).limit(0), given, _chapters(spark))
    assert none.count() == 0


def test_validation(spark):
    rows = [(1, 1, 0, "State the first law."), (1, 1, 1, "State the first law of motion."), (1, 2, 2, "short"), (1, 9, 3, "Number beyond the total"), (1, None, 4, "No number in this row"), (1, 3, 5, "General Instructions: read all"), (2, 400, 6, "No total is known here")]
    q = spark.createDataFrame(rows, "paper_id int, question_no int, row_order int, question_text string")
    expected = spark.createDataFrame([(1, 3), (2, None), (3, 2)], "paper_id int, expected_count int")
    assert sorted((r.paper_id, r.row_order) for r in P.validated_questions(q, expected).collect()) == [(1, 1), (2, 6)]
    got = {r.paper_id: (r.actual_count, r.dropped, r.missing, r.confirmed) for r in P.validation_report(q, expected).collect()}
    assert got == {1: (1, 5, [2, 3], False), 2: (1, 0, [], None), 3: (0, 0, [1, 2], False)}


def test_continuations_and_pages(spark):
    q = spark.createDataFrame([(1, 1, "Answer:"), (1, 2, None)], "paper_id int, question_no int, question_text string")
    more = spark.createDataFrame([(1, 1, 1, "(b) second"), (1, 1, 0, " (a) first "), (1, 3, 0, "new"), (1, 2, 0, "  "), (1, None, 0, "x")], "paper_id int, question_no int, pos int, append_text string")
    got = {r.question_no: r.question_text for r in P.apply_continuations(q, more).collect()}
    assert got == {1: "Answer:\n(a) first\n(b) second", 2: "", 3: "new"}
    pages = spark.createDataFrame([(1, 2, "b\n c"), (1, 1, " a "), (1, 3, None)], "paper_id int, page_no int, text string")
    assert P.document_text(pages).select(F.split("text", P.PAGE_BREAK).alias("t")).first().t == ["a", "b c", ""]
