"""Extraction, merging and knowledge on small fixtures, and against plain Python."""

import pytest
from pyspark.sql import functions as F

from examlake.functions import text as T
from examlake.operators import extraction as E
from examlake.operators import knowledge as K
from examlake.operators import merging as M
from examlake.plans import extract_queries as Q
from examlake.sources import files
from examlake.sources import tables as src

ROWS = "paper_id long, row_order long, question_no int, question_text string, marks double, has_figure boolean"
STEM = "Explain why the electric field inside a hollow conductor vanishes everywhere"
OPTIONS = "(A) zero\n(B) one\n(C) two\n(D) three"


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("given, want", [
    ("E0 = 5", "E₀ = 5"), ("E → = 2", r"\vec{E} = 2"), ("î + ĵ", r"\hat{i} + \hat{j}"), ("K hat", r"\hat{k}"),
    ("R/(μ-1)", r"\frac{R}{μ−1}"), ("plain", "plain"), ("a\r\nb", "a\nb"),
])
def test_notation(spark, given, want):
    assert value(spark, T.notation(F.lit(given))) == want


def test_doubtful_fractions_stay_when_strict(spark):
    assert value(spark, T.notation(F.lit("(A) R - 1/μ"))) == "(A) R - 1/μ"
    assert value(spark, T.notation(F.lit("(A) R - 1/μ"), strict=False)) == r"(A) \frac{R}{μ−1}"


def test_section_rules(spark):
    text = "Section A - Questions no. 1 to 16 carries 1 mark. Section B - Questions 21 to 17 carries 2 marks."
    got = value(spark, T.section_rules(F.lit(text)))
    assert [(r["section"], r["from"], r["to"], r["marks"]) for r in got] == [("A", 1, 16, 1), ("B", 17, 21, 2)]
    assert value(spark, T.section_rules(F.lit("nothing"))) == []


@pytest.mark.parametrize("given, want", [
    ("1. What is it here?\n2. Why is it there?", ["1. What is it here?", "2. Why is it there?"]),
    ("one line\n\nnext line", ["one line", "next line"]), ("only this", ["only this"]), ("", []), ("  \n ", []),
])
def test_question_chunks(spark, given, want):
    assert value(spark, T.question_chunks(F.lit(given))) == want


def test_sub_parts_go_to_the_question_before(spark):
    rows = [(1, 0, 5, STEM, None, False), (1, 1, 9, "(ii) and on its surface?", 3.0, True), (1, 2, 6, "State the second law of motion in words", None, False)]
    got = {r.question_no: r for r in M.merge_questions(spark.createDataFrame(rows, ROWS)).collect()}
    assert sorted(got) == [5, 6]
    assert got[5].question_text == f"{STEM}\n(ii) and on its surface?"
    assert (got[5].marks, got[5].has_figure) == (3.0, True)


def test_first_row_and_copies(spark):
    rows = [(1, 0, 2, "(b) a part that comes first", None, False), (1, 1, 3, STEM, None, False), (1, 2, 3, STEM + " today", 2.0, False), (1, 3, None, "Text that has no number at all", None, False), (1, 4, 7, "  ", None, False)]
    got = {r.question_no: r.question_text for r in M.merge_questions(spark.createDataFrame(rows, ROWS)).collect()}
    assert got == {2: "(b) a part that comes first", 3: STEM + " today", None: "Text that has no number at all"}


def test_repeated_blocks():
    once = f"{STEM}?\n{OPTIONS}"
    assert M.without_repeats(f"{once}\n\n{once}") == once
    assert M.without_repeats(f"{once}\n{STEM}?\n{OPTIONS}") == once
    assert M.without_repeats("a short text") == "a short text"
    assert M.without_repeats("  ") == ""


def test_long_row_is_split(spark):
    text = f"17. {STEM} {'very ' * 90}\n18. {STEM} {'much ' * 90}"
    rows = spark.createDataFrame([(1, 0, 17, text, None, False), (1, 1, 2, "short", None, False)], ROWS)
    assert sorted(r.question_no for r in M.split_long_rows(rows).collect()) == [2, 17, 18]


def test_greedy_copies_against_brute_force(spark, sf):
    """The best row of each number, then by number, each kept unless it is like one kept before."""
    bank = src.text_bank(spark, sf)
    best: dict = {}
    for r in sorted(bank.select("*", T.key_words(F.col("question_text")).alias("w"), F.col("question_text").rlike(T.NOTATION).alias("n")).collect(), key=lambda r: r.row_order):
        score = len(r.question_text or "") + 50 * (r.row_order % 4 == 0) + 10 * bool(r.n)
        held = best.get((r.paper_id, r.question_no))
        if held is None or score > held[0]:
            best[r.paper_id, r.question_no] = (score, r.row_order, set(r.w or ()))
    kept: dict = {}
    for (paper, _), (_, order, words) in sorted(best.items(), key=lambda x: (x[0], x[1][1])):
        mine = kept.setdefault(paper, [])
        if not any(words and w and len(words & w) >= 0.72 * len(words | w) for _, w in mine):
            mine.append((order, words))
    assert {r.row_order for r in Q.distinct_questions(spark, sf).collect()} == {o for v in kept.values() for o, _ in v}


def test_chunks_against_brute_force(spark, sf):
    want: dict = {}
    pages = sorted((r.paper_id, r.row_order, r.question_text) for r in src.text_bank(spark, sf).collect() if r.question_text and r.question_text.split())
    for paper, _, text in pages:
        mine, text = want.setdefault(paper, []), text.strip(" \t\n\r\f\v")
        if mine and len(mine[-1]) + len(T.PAGE_MARK) + len(text) <= E.CHUNK:
            mine[-1] += T.PAGE_MARK + text
        else:
            mine.append(text)
    got = {(r.paper_id, r.chunk_no): r.n_chars for r in Q.text_chunks(spark, sf).collect()}
    assert got == {(p, i): len(t) for p, ts in want.items() for i, t in enumerate(ts)}


ITEMS = "paper_id long, page_no long, page_width double, str string, x double, y double"


def test_layout(spark):
    items = [
        (1, 1, 600.0, "SECTION - A", 300.0, 790.0), (1, 1, 600.0, "1. Explain why metals conduct heat", 300.0, 700.0), (1, 1, 600.0, "3", 560.0, 702.0),
        (1, 1, 600.0, "better than most gases do", 300.0, 680.0), (1, 1, 600.0, "2. Derive the formula for kinetic energy", 300.0, 600.0), (1, 1, 600.0, "  ", 1.0, 1.0),
    ]
    got = sorted((r.question_no, r.question_text, r.marks) for r in E.layout_questions(spark.createDataFrame(items, ITEMS)).collect())
    assert got == [(1, "Explain why metals conduct heat\nbetter than most gases do", 3.0), (2, "Derive the formula for kinetic energy", None)]
    assert E.layout_questions(spark.createDataFrame([], ITEMS)).count() == 0


def test_model_answers(spark):
    ask = '{"questionNo": "%s", "questionText": "What is the speed of light in vacuum"%s}'
    answers = [
        (1, 0, '{"papers":[{"totalQuestions":33,"questions":[%s,%s]}]}' % (ask % (1, ""), ask % (2, ', "marks": 4'))),
        (2, 0, "[%s]" % (ask % ("x", ""))), (3, 0, "{not json"), (4, 0, '{"questions":[{"questionText":"no"}]}'),
    ]
    df = spark.createDataFrame(answers, "paper_id long, answer_no int, answer string")
    got = sorted((r.paper_id, r.question_no, r.marks, r.total_questions) for r in E.flatten_model_answers(df).collect())
    assert got == [(1, 1, 1.0, 33), (1, 2, 4.0, 33), (2, 1, 1.0, None)]


def test_continuations(spark):
    base = spark.createDataFrame([(1, 4, STEM), (1, 5, None), (1, 6, "untouched")], "paper_id long, question_no int, question_text string")
    more = [(1, 4, 1, "(b) and outside it"), (1, 5, 1, "late text"), (1, 9, 1, " stub "), (1, None, 1, "x"), (1, 6, 1, "  "), (1, 4, 2, STEM)]
    got = M.continue_questions(base, spark.createDataFrame(more, "paper_id long, question_no int, pos long, append_text string"))
    assert {r.question_no: r.question_text for r in got.collect()} == {4: f"{STEM}\n(b) and outside it", 5: "late text", 6: "untouched", 9: "stub"}


def test_file_kinds(spark, tmp_path):
    (tmp_path / "a.txt").write_text("héllo")
    (tmp_path / "b.bin").write_bytes(b"%PDF-1.7")
    (tmp_path / "c.bin").write_bytes(b"\x00\x01")
    got = {r.path[-5:]: (r.kind, r.text) for r in files.raw_files(spark, str(tmp_path)).collect()}
    assert got == {"a.txt": ("text", "héllo"), "b.bin": ("pdf", None), "c.bin": ("other", None)}


def test_middle_out(spark):
    assert value(spark, K.middle_out(F.lit("abcdefgh"), 4)) == "ab\n\n[…]\n\ngh"


@pytest.mark.parametrize("name", [n for n, (_, sql) in Q.QUERIES.items() if sql is None])
def test_queries_without_oracle_return_rows(spark, sf, name):
    assert Q.QUERIES[name][0](spark, sf).count() > 0
