"""Reading against plain loops over the whole tables of its queries."""

import hashlib
from collections import defaultdict

from examlake.plans import extract_queries as Q
from examlake.sources import tables as src

from . import plain


def _md5(text):
    return hashlib.md5(text.encode()).hexdigest()


def test_whole_table_of_plain_texts(spark, sf):
    got = {(r.paper_id, r.row_order): (r.question_no, r.marks, r.text_md5) for r in Q.text_questions(spark, sf).collect()}
    want = {(d.doc_id, i): (no, marks, _md5(text)) for d in src.read(spark, sf, "documents").collect() for i, no, text, marks in plain.text_questions(d.text)}
    assert got == want


def test_whole_table_of_layouts(spark, sf):
    pages = defaultdict(lambda: defaultdict(list))
    for r in Q._items(spark, sf).collect():
        pages[r.paper_id][r.page_no].append((r.x, r.y, r.str))
    want = {(p, r["order"]): (r["no"], r["marks"], _md5(r["text"])) for p, own in pages.items() for r in plain.without_copies(plain.layout_questions([own[n] for n in sorted(own)]))}
    assert {(r.paper_id, r.row_order): (r.question_no, r.marks, r.text_md5) for r in Q.layout_questions(spark, sf).collect()} == want


def test_whole_table_of_model_answers(spark, sf):
    turns = defaultdict(list)
    for r in sorted(src.read(spark, sf, "conversations").collect(), key=lambda r: (r.conv_id, r.turn)):
        text = plain.notation(plain.english((r.text or "").strip(" \t\n\r\f\v")))
        if plain.accepts_model(text):
            turns[r.conv_id].append((r.turn + 1, text))
    want = {(c, n): (plain.default_marks(n), _md5(t), 33) for c, own in turns.items() for n, t in own}
    got = {(r.paper_id, r.question_no): (r.marks, r.text_md5, r.total_questions) for r in Q.model_answers(spark, sf).collect()}
    assert got == want


def test_whole_table_of_notation(spark, sf):
    said = src.read(spark, sf, "conversations").collect()
    want = {(r.conv_id, r.turn): _md5(plain.notation(" ".join(x for x in ("E0 = 5 and A → = B, î + j^", r.text, "R/(μ-1)") if x is not None))) for r in said}
    assert {(r.conv_id, r.turn): r.text_md5 for r in Q.notation_counts(spark, sf).collect()} == want
