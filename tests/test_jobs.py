"""Reading again page by page, and rounds of it."""

from examlake.operators import rereading as R
from examlake.operators import workflow as W

KEYS = "owner_id string, paper_id string, "
ROWS = KEYS + "row_order long, question_no int, question_text string, marks double, has_figure boolean"
READINGS = KEYS + "page_no int, pos int, question_no int, question_text string, marks double, has_figure boolean"


def _text(no):
    return f"Explain in your own words the law that number {no} of this paper asks for"


def test_the_first_eight_are_asked_for_page_by_page(spark):
    pending = spark.createDataFrame([("a", "p", n) for n in range(1, 13)] + [("b", "p", 2)], KEYS + "question_no int")
    pages = spark.createDataFrame([("a", "p", 3), ("b", "p", 0)], KEYS + "n_pages int")
    asked = []

    def reader(requests):
        rows = requests.collect()
        asked.append({(r.owner_id, r.page_no): list(r.numbers) for r in rows})
        found = [("a", "p", 0, n, f"{page}/{n}") for (_, page), ns in asked[-1].items() for n in ns if n % 2 == page % 2] + [("a", "p", 1, ns[1], "later") for ns in asked[-1].values()] + [("a", "p", 0, 99, "not asked for")]
        return spark.createDataFrame(found, KEYS + "pos int, question_no int, question_text string")

    got = {(r.owner_id, r.question_no): (r.page_no, r.question_text) for r in R.read_again(pending, pages, reader).collect()}
    assert asked == [{("a", 1): [1, 2, 3, 4, 5, 6, 7, 8]}, {("a", 2): [4, 6, 8, 9, 10, 11, 12]}, {("a", 3): [9, 11]}]
    assert got[("a", 2)] == (1, "later") and got[("a", 6)] == (2, "2/6") and got[("a", 9)] == (3, "3/9")
    assert {n for _, n in got} == set(range(1, 13))


def test_a_second_round_reads_what_the_first_brought_up(spark):
    """Number 2 is read with 5 inside it; 5 then stands twice and is read once more, as is 7, which is on no page."""
    rows = spark.createDataFrame([("a", "p", i, n, _text(n), None, False) for i, n in enumerate((1, 3, 4, 5, 6))], ROWS)
    readings = spark.createDataFrame([("a", "p", 1, 0, 2, f"{_text(2)}\n5. Derive the lens formula from the start", None, False), ("a", "p", 1, 1, 5, _text(5) + " once more", None, False)], READINGS)
    papers = spark.createDataFrame([("a", "p", 7, 2, None)], KEYS + "expected_count int, n_pages int, instructions string")
    once = {r.question_no: r.question_text for r in R.reread(rows, papers, R.table_reader(readings), 1)[1].collect()}
    assert sorted(once) == [1, 2, 3, 4, 5, 6] and once[2] == _text(2)
    again = {r.question_no: r.question_text for r in R.reread(rows, papers, R.table_reader(readings), 5)[1].collect()}
    assert sorted(again) == [1, 2, 3, 4, 5, 6]
    assert R.reread(rows.limit(0), papers.limit(0), R.table_reader(readings), 2)[1].count() == 0


def test_process_papers_with_a_reader(spark):
    rows = spark.createDataFrame([("a", "p", 0, 1, _text(1), None, False)], ROWS)
    readings = spark.createDataFrame([("a", "p", 2, 0, 2, _text(2), 4.0, False)], READINGS)
    papers = spark.createDataFrame([("a", "p", "c", 2, 2, None), ("b", "p", "c", 2, 2, None)], KEYS + "class_id string, expected_count int, n_pages int, instructions string")
    chapters = spark.createDataFrame([], "owner_id string, class_id string, chapter_pos long, chapter_id string, unit_id string, name string")
    overrides = spark.createDataFrame([], KEYS + "question_no int, chapter_id string, confidence double")
    bank = spark.createDataFrame([("b", "p", 1, "kept", 1.0, None, None, None, None)], KEYS + "question_no int, question_text string, marks double, chapter_id string, unit_id string, chapter_name string, chapter_confidence int")
    kept, reports = W.process_papers(bank, rows, papers, chapters, overrides, reader=R.table_reader(readings))
    assert sorted((r.owner_id, r.question_no, r.marks) for r in kept.collect()) == [("a", 1, 1.0), ("a", 2, 4.0), ("b", 1, 1.0)]
    assert {(r.owner_id, r.confirmed) for r in reports.collect()} == {("a", True), ("b", False)}
