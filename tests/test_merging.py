"""Merging against plain loops: orders of small sets of rows, and the whole tables of its queries."""

import hashlib
import itertools
from collections import defaultdict
from types import SimpleNamespace

import pytest

from examlake.operators import merging as M
from examlake.plans import extract_queries as Q
from examlake.sources import tables as src

from . import plain

STEM = "Explain why the electric field inside a hollow conductor vanishes everywhere"
OPTIONS = "(A) zero\n(B) one\n(C) two\n(D) three"
TEXTS = [
    (1, STEM, None), (1, STEM + " today", 2.0), (2, "(ii) and on its outer surface, what is the field there?", 1.0), (1, "(b) Define the flux through a closed surface", None),
    (2, "State the second law of motion in words of your own", 0.0), (1, "(iii) and on its outer surface, what is the field there?", 3.0), (1, f"{STEM}?\n{OPTIONS}\n{STEM}?\n{OPTIONS}", None), (2, "... the field there goes on", None),
]
ROWS = "paper_id long, row_order long, question_no int, question_text string, marks double, has_figure boolean"


def _plain(rows):
    papers = defaultdict(list)
    for r in rows:
        papers[r.paper_id].append({"no": r.question_no, "text": r.question_text, "marks": r.marks, "figure": bool(r.has_figure), "order": r.row_order})
    return papers


def test_rows_in_every_order(spark):
    """All orders of every 3 of the texts, and of four 5s, as papers of one table."""
    sets = [p for c in itertools.combinations(TEXTS, 3) for p in itertools.permutations(c)] + [p for c in list(itertools.combinations(TEXTS, 5))[::15] for p in itertools.permutations(c)]
    rows = [(i, k, no, text, marks, k == 2) for i, s in enumerate(sets) for k, (no, text, marks) in enumerate(s)]
    df = spark.createDataFrame(rows, ROWS)
    got = {(r.paper_id, r.question_no): (r.question_text, r.marks, r.has_figure) for r in M.merge_questions(df).collect()}
    want = {(p, no): (r["text"], r["marks"], r["figure"]) for p, mine in _plain(df.collect()).items() for no, r in plain.merge(mine).items()}
    assert got == want


def test_a_part_goes_behind_its_question_and_marks_of_the_earlier_stand(spark):
    rows = [(1, 0, 3, "Answer the following:", None, False), (1, 1, 3, "(ii) Define flux.", None, False), (2, 0, 4, "Write a short note on lenses", 1.0, False), (2, 1, 4, "Write all that is known to you of optical instruments and of their use", 2.0, False)]
    got = {r.paper_id: (r.question_text, r.marks) for r in M.merge_questions(spark.createDataFrame(rows, ROWS)).collect()}
    assert got == {1: ("Answer the following:\n(ii) Define flux.", None), 2: (rows[3][3], 1.0)}


def test_copies_finalized(spark):
    """Papers of copies, with other rows, and all pairs of them with marks, cuts, sections, parts and odd ends."""
    texts = [
        STEM, STEM + " ", "\u00a0" + STEM, STEM + "\u2003", f"(D) {STEM}", f"{STEM}\n(D) {STEM}", "(ii) and on its outer surface?", f" (b) {STEM}", f"{STEM}\n3. Define flux in words", f"{STEM}\n\n{STEM}",
        f"{STEM}\n... goes on", "\u00bd (i) of it", STEM + "\n" + "word " * 180 + "\n22. Name the law", "Define it",
    ]
    pairs = [(a, b, m, n) for a, b in itertools.combinations_with_replacement(texts, 2) for m, n in ((None, None), (None, 2.0), (2.0, None), (2.0, 2.0), (0.0, None), (0.0, 2.0), (1.0, 2.0))]
    rows = []
    for i, (a, b, m, n) in enumerate(pairs):
        rows += [(i, 0, 21, a, m, False), (i, 1, 21, b, n, True), (i, 2, 4, a.strip(), None, False), (i, 3, None, STEM, None, False)]
    df = spark.createDataFrame(rows, ROWS)
    got = {(r.paper_id, r.question_no): (r.question_text, r.marks, r.has_figure, r.row_order) for r in M.finalize_questions(df, df.select("paper_id").distinct()).collect()}
    want = {(p, no): (r["text"], r["marks"], r["figure"], r["order"]) for p, mine in _plain(df.collect()).items() for no, r in plain.finalize(mine).items()}
    assert got == want


@pytest.fixture(scope="module")
def papers(spark, sf):
    return _plain(Q._rows(spark, sf).collect())


def _md5(text):
    return hashlib.md5(text.encode()).hexdigest()


def test_whole_table_merged(spark, sf, papers):
    got = {(r.paper_id, r.question_no): (r.marks, r.text_md5) for r in Q.merged_questions(spark, sf).collect()}
    assert got == {(p, no): (r["marks"], _md5(r["text"])) for p, mine in papers.items() for no, r in plain.merge(mine).items()}


def test_whole_table_finalized(spark, sf, papers):
    got = {(r.paper_id, r.question_no): (r.marks, r.marks_inferred, r.text_md5) for r in Q.finalized_questions(spark, sf).collect()}
    assert got == {(p, no): (r["marks"], r["inferred"], _md5(r["text"])) for p, mine in papers.items() for no, r in plain.finalize(mine).items()}


def test_whole_table_continued(spark, sf):
    from examlake.operators import papers as P

    first = {(r.paper_id, r.question_no): r.question_text for r in P.validated_questions(src.text_bank(spark, sf), Q._expected(spark, sf)).collect()}
    more = defaultdict(list)
    for r in sorted(src.read(spark, sf, "conversations").collect(), key=lambda r: (r.conv_id, r.turn)):
        if r.text and r.text.strip():
            more[r.conv_id // 10, r.turn + 1].append(r.text)
    want = {k: _md5(plain.continued(first.get(k), more.get(k, []))) for k in {*first, *more}}
    assert {(r.paper_id, r.question_no): r.text_md5 for r in Q.continued_questions(spark, sf).collect()} == want


@pytest.mark.parametrize("text, want", [
    ("21. First part here\n22. (a) Derive the lens formula", [(21, "First part here"), (22, "(a) Derive the lens formula")]),
    ("First part here\n23.  Explain total reflection\n24. \"What is light?\"", [(21, "First part here"), (23, "Explain total reflection"), (24, "\"What is light?\"")]),
    ("First part here\n22. écrire ceci", [(21, "First part here\n22. écrire ceci")]), ("21. Alone it stays", [(21, "21. Alone it stays")]),
])
def test_embedded_numbers(spark, text, want):
    got = M.split_long_rows(spark.createDataFrame([(1, 0, 21, text, None, False)], ROWS)).collect()
    assert [(r.question_no, r.question_text) for r in got] == want
    assert [(p["no"], p["text"]) for p in plain.split({"no": 21, "text": text})] == want


def test_long_rows_are_cut_before_lines_that_start_a_question(spark):
    body = "what is asked here of you is long " * 13
    text = f"a line before\n17. why {body}\n 18. (ii) {body}\n19) {body}\n41. {body}\n20. how {body}"
    got = [(r.question_no, r.question_text) for r in M.split_long_rows(spark.createDataFrame([(1, 0, 17, text, None, False)], ROWS)).collect()]
    assert got == [(p["no"], p["text"]) for p in plain.split({"no": 17, "text": text})]
    assert [no for no, _ in got] == [17, 20]


def test_sections_are_looked_at_once(monkeypatch):
    """A long text of many options and stems, and one of many unlike sections: the work grows with the text, not with its square."""
    looked, compared = [], []
    of, share = M.Telling.of, M.Telling.share
    monkeypatch.setattr(M.Telling, "of", staticmethod(lambda text, marks=None: looked.append(len(text)) or of(text, marks)))
    monkeypatch.setattr(M.Telling, "share", lambda self, other: compared.append(1) or share(self, other))
    stems = "\n".join(f"What is the name of planet number{i} in the long list of them?" for i in range(300))
    assert M.without_repeats(f"{stems}\n(D) none") == f"{stems}\n(D) none"
    assert sum(looked) < 3 * len(stems)
    unlike = [f"solar{i} lunar{i} comet{i} orbit{i}" for i in range(300)]
    assert M.without_repeats("\n\n".join([*unlike, unlike[7] + " and pluto with all of its own moons"])).startswith(unlike[7] + " and")
    assert len(compared) < 400


def test_folds_hold_few_rows_as_values_and_keep_kinds(spark, monkeypatch):
    """Rows of a large batch become Python values a slice at a time; whole numbers, nulls and arrays pass a fold as they are."""
    from examlake.operators import folds

    class Seen(folds.Fold):
        def feed(self, row):
            return [(row.k, row.n, row.d, row.a, type(row.n).__name__)]

    df = spark.range(3000, numPartitions=1).selectExpr("id % 7 AS k", "CASE WHEN id % 3 > 0 THEN cast(id AS int) END AS n", "CASE WHEN id % 5 = 0 THEN double('NaN') ELSE id / 2 END AS d", "array(id, null) AS a")
    out = folds.fold_sorted(df, ["k"], ["n"], folds.typed(df, df.columns, "kind string"), Seen)
    assert out.count() == 3000
    assert {r.kind for r in out.select("kind").distinct().collect()} == {"int", "NoneType"}
    assert out.where("n is not null").select("k", "n", "a").exceptAll(df.where("n is not null").select("k", "n", "a")).count() == 0
    assert out.where("d is null").count() == 600


def test_whole_questions_are_met_without_their_words():
    """Two whole questions leave the better whatever words they share, so no word set is made for them; sub-parts need theirs."""
    row = lambda text: SimpleNamespace(question_text=text, marks=None, has_figure=False)
    a, b, part = (M.Standing.of(row(t)) for t in ("State the law of induction.", "State the law of induction in your own words.", "(ii) Give one use of it."))
    now = M.met(a, b)
    assert now.told.text == b.told.text and not any("words" in vars(s.told) for s in (a, b, now))
    assert M.met(now, part).told.text == f"{b.told.text}\n{part.told.text}" and "words" in vars(part.told)
