"""Costly expressions are worked out once a row, and what is read twice is written once."""

from examlake.operators import classify as C
from examlake.operators import workflow as W
from examlake.plans import graph_queries as G
from examlake.plans import paper_queries as Q
from examlake.sources import tables as src


def _plan(df, capsys) -> str:
    capsys.readouterr()
    df.explain(True)
    return capsys.readouterr().out.split("== Optimized Logical Plan ==")[1].split("== Physical Plan ==")[0]


def test_a_text_is_lowered_once_for_all_chapters(spark, sf, capsys):
    plan = _plan(Q.classify_keyword(spark, sf), capsys)
    assert plan.count("lower(coalesce(question_text") + plan.count("lower(coalesce(text") == 1
    assert plan.count("array_max(") == 1


def test_routes_are_worked_out_once(spark, sf, capsys):
    q = Q._questions(spark, sf)
    for c in C.ASSIGNED:
        q = q.withColumn(c, Q.F.lit(None).cast(q.schema[c].dataType))
    plan = _plan(W.classify(q, src.chapters(spark, sf), assignments=Q._given(spark, sf)), capsys)
    assert "array_max(" not in plan


def test_tables_of_the_delete_graph_are_derived_once(spark, sf, capsys):
    """They are read by each of their references and for what stays: their different rows are found once."""
    tables = G._tables(spark, sf)
    assert not [n for n, t in tables.items() if "Aggregate" in _plan(t, capsys)]


def test_papers_without_new_readings_are_not_finalised_again(spark, monkeypatch):
    from examlake.operators import rereading as R

    text = lambda p, n: f"Explain in words why the planet {p} has {n} moons of its own"
    rows = spark.createDataFrame([(p, n, n, text(p, n), 1.0, False) for p in range(4) for n in (1, 3)], "paper_id long, row_order long, question_no int, question_text string, marks double, has_figure boolean")
    papers = spark.createDataFrame([(p, 3, 1, None) for p in range(4)], "paper_id long, expected_count int, n_pages int, instructions string")
    pages = spark.createDataFrame([(2, 1, 0, 2, text(2, 2))], "paper_id long, page_no int, pos int, question_no int, question_text string")
    sizes, finalize = [], R.finalize_questions
    monkeypatch.setattr(R, "finalize_questions", lambda some, p: sizes.append(some.count()) or finalize(some, p))
    _, final = R.reread(rows, papers, R.table_reader(pages), 2)
    assert sorted((r.paper_id, r.question_no) for r in final.collect()) == sorted([(p, n) for p in range(4) for n in (1, 3)] + [(2, 2)])
    assert sizes == [8, 3]


def test_word_sets_are_worked_out_once_a_text(spark):
    """Pairs of like questions read word sets that are written: no reader of them takes the texts apart again."""
    from examlake.operators.bank import near_duplicate_pairs

    rows = spark.createDataFrame([(1, 1, "state the second law of motion"), (1, 2, "State the second law of motion!")], "paper_id int, row_order int, question_text string")
    pairs = near_duplicate_pairs(rows)
    assert "regexp_replace" not in pairs._jdf.queryExecution().optimizedPlan().toString()
    assert [(r.row_a, r.row_b, r.kind) for r in pairs.collect()] == [(1, 2, "copy")]


def test_a_text_is_looked_through_once_for_each_thing_asked(spark, capsys):
    """Whether a text reads as English: its words are looked for once."""
    from pyspark.sql import functions as F

    from examlake.functions import text as T

    texts = spark.createDataFrame([("State the law of motion.",), ("x",), (None,)], "t string").repartition(1)
    read = texts.select(T.accepts_plain_text(F.col("t")).alias("a"))
    assert _plan(read, capsys).count("[A-Za-z]{3,}") == 1
    assert [r.a for r in read.collect()].count(True) == 1


def test_signs_are_told_apart_as_written_out(spark):
    """The classes that fail early for letters hold the same signs as those they stand for, over the whole basic plane and beyond."""
    from pyspark.sql import functions as F

    from examlake.functions import text as T

    every = spark.range(0x10000).where("id < 55296 or id > 57343").select(F.udf(chr, "string")(F.col("id").cast("int")).alias("c"))
    every = every.unionByName(spark.createDataFrame([("\U0001f600",), ("\U00010348",)], "c string"))
    same = [(T.NOTATION, r"[^\x20-\x7E\n\r\t\x{0900}-\x{097F}§©¶]"), (f"^{T.LAST_SPACE}$", f"^{T.ANY_SPACE}$")]
    for new, plain in same:
        assert every.where(F.col("c").rlike(new) != F.col("c").rlike(plain)).count() == 0
    low = F.lower("c")
    assert every.where(F.regexp_replace(low, r"[^\w ]+", "") != F.regexp_replace(low, "[^a-z0-9_ ]", "")).count() == 0
    assert every.where(T.letters(F.col("c")) != F.regexp_count("c", F.lit("[A-Za-z]"))).count() == 0
    signs = r"[\r→\x{20D7}îĵ\x{0302}^]|[A-Za-zμελρσπ]0|\b[ijkIJK]\s*(?i:hat)|R/\(μ"
    around = every.select(F.explode(F.array("c", F.concat("c", F.lit("0")), F.concat("c", F.lit(" hat")), F.concat(F.lit("R/("), "c"))).alias("c"))
    assert around.where(F.col("c").rlike(T.ANY_SIGN) != F.col("c").rlike(signs)).count() == 0


def test_only_long_texts_of_figure_numbers_are_measured(spark, capsys):
    """Numbers to read again: a text is stripped, to be measured, only where its number and its whole length ask for it."""
    from examlake.operators.bank import repair_set

    rows = spark.createDataFrame([(1, 1, "x" * 900), (1, 17, "x" * 900), (1, 18, " " * 900 + "x"), (1, 19, None), (1, None, "x" * 900)], "paper_id long, question_no int, question_text string")
    out = repair_set(rows, spark.createDataFrame([(1, 0)], "paper_id long, expected_count int"))
    strip = next(x for x in _plan(out, capsys).splitlines() if "regexp_replace" in x).split("regexp_replace")[0]
    assert "CASE WHEN" in strip and ">= 850" in strip
    assert [r.numbers for r in out.collect()] == ["17"]


def test_rows_without_a_paper_are_not_gathered(spark):
    """Places in papers: rows without one are dealt apart, so that they are no group of an owner's."""
    from examlake.operators import scans as S

    rows = spark.range(1000).selectExpr("'u1' AS owner_id", "CASE WHEN id < 3 THEN 'p' END AS question_paper_id", "id", "3 - id AS question_no")
    placed = rows.withColumn("n", Q.F.row_number().over(S.in_paper("id").orderBy(*S.paper_order(), "id")))
    assert {(r.id, r.n) for r in placed.where("question_paper_id is not null").collect()} == {(2, 1), (1, 2), (0, 3)}
    assert placed.where("question_paper_id is null and n > 1").count() == 0


def test_bank_rows_are_written_once(spark, sf, capsys):
    """Rows that are kept or normalized are read by several: none works them out again."""
    from examlake.plans import tenant_queries as N

    plan = _plan(N.persisted_bank(spark, sf), capsys)
    assert "Join" in plan and "o_custkey" not in plan
    assert "regexp_replace(" not in _plan(N._paper_rows(spark, sf).select("id", "year"), capsys)


def test_keys_and_references_are_dealt_by_their_number(spark, monkeypatch):
    """An audit's keys and references go to as many tasks as their number asks for; the rows they come from are worked out once."""
    from examlake.operators import audit as A

    monkeypatch.setattr(A, "ROWS", 100)
    rows = spark.range(950).selectExpr("'u1' AS owner_id", "id div 2 AS id", "'p1' AS question_paper_id", "'m' AS material_id")
    parents = {"question_paper_id": spark.createDataFrame([("u1", "p1")], "owner_id string, id string")}
    found = A.violations(rows, "question_bank", ["owner_id", "id"], parents)
    assert "RepartitionByExpression" in (plan := found._jdf.queryExecution().optimizedPlan().toString()) and "], 10" in plan and "Range" not in plan
    assert {(r.rule, r["count"]) for r in found.groupBy("rule").count().collect()} == {("key", 475), ("one origin", 950)}


def test_copies_are_dropped_without_a_fold(spark, monkeypatch):
    """A number whose rows have one text and one value of marks leaves its first row, with a figure if any copy has one."""
    from examlake.operators import merging as M

    def fold(*_):
        raise AssertionError("rows were sent to Python")

    monkeypatch.setattr(M, "fold_sorted", fold)
    rows = [(1, 0, 1, " State the law of lenses ", None, False), (1, 1, 1, " State the law of lenses ", None, True), (1, 2, 2, "Define\nthe flux", 2.0, None), (1, 3, None, "Of no number", None, False)]
    df = spark.createDataFrame(rows, "paper_id long, row_order long, question_no int, question_text string, marks double, has_figure boolean")
    got = M.finalize_questions(df, df.select("paper_id").distinct())
    assert sorted((r.question_no, r.question_text, r.marks, r.has_figure, r.row_order) for r in got.collect()) == [(1, "State the law of lenses", 1.0, True, 0), (2, "Define\nthe flux", 2.0, False, 2)]


def test_a_run_finalises_a_paper_once_before_it_is_read_again(spark, sf, monkeypatch):
    from examlake.operators import jobs as J
    from examlake.operators import rereading as R
    from examlake.plans import job_queries as Q

    sizes = []
    for module in (J, R):
        finalize = module.finalize_questions
        monkeypatch.setattr(module, "finalize_questions", lambda some, p, f=finalize, **more: sizes.append(some.select("paper_id").distinct().count()) or f(some, p, **more))
    Q._run(spark, sf)
    assert len(sizes) > 1 and sum(sizes[1:]) < sizes[0]


def test_pages_are_looked_up_in_a_written_table(spark, sf, monkeypatch):
    """The readings of a run are joined once, not anew for each page."""
    from examlake.plans import job_queries as Q

    plans, reader = [], Q.table_reader
    monkeypatch.setattr(Q, "table_reader", lambda t: plans.append(t._jdf.queryExecution().optimizedPlan().toString()) or reader(t))
    Q._run(spark, sf)
    assert len(plans) == 1 and "Join" not in plans[0]


def test_the_only_route_is_not_joined_to_its_questions(spark, sf, capsys):
    """With key words alone a question's row goes through once: only the class's chapters are joined to it."""
    q = Q._questions(spark, sf)
    for c in C.ASSIGNED:
        q = q.withColumn(c, Q.F.lit(None).cast(q.schema[c].dataType))
    assert _plan(W.classify(q, src.chapters(spark, sf)), capsys).count("Join ") == _plan(C.classify_keyword(q, src.chapters(spark, sf)), capsys).count("Join ")


def test_a_runs_reports_and_jobs_are_counted_once_a_paper(spark, sf, capsys):
    """Its questions are one a number, and every job ends in a row: nothing is grouped by number, and no old job is looked up."""
    from examlake.plans import job_queries as Q

    run = Q._run(spark, sf)
    assert "max(struct" not in _plan(run.reports, capsys)
    assert "LeftAnti" not in _plan(run.jobs, capsys)


def test_a_metadata_map_is_built_and_read_once(spark, capsys):
    from examlake.operators import records as R

    rows = spark.createDataFrame([(12, "A"), (0, None), (None, r"a\u12")], "n int, s string")
    facts = Q.F.create_map(Q.F.lit("totalQuestions"), Q.F.col("n").cast("string"), Q.F.lit("set"), Q.F.col("s"))
    df = rows.withColumn("m", facts).select(R.compact_metadata(Q.F.col("m")).alias("j"))
    plan = _plan(df, capsys)
    assert plan.count("map(totalQuestions") == 1 and plan.count("element_at(") <= 18
    assert [r.j for r in df.collect()] == ['{"totalQuestions":12,"set":"A"}', "{}", '{"set":"a' + r"\\\\" + 'u12"}']


def test_a_later_round_counts_the_numbers_of_changed_papers_only(spark, monkeypatch):
    from examlake.operators import rereading as R

    text = lambda p, n: f"Explain in words why the planet {p} has {n} moons of its own"
    rows = spark.createDataFrame([(p, n, n, text(p, n), 1.0, False) for p in range(4) for n in (1, 3)], "paper_id long, row_order long, question_no int, question_text string, marks double, has_figure boolean")
    papers = spark.createDataFrame([(p, 5, 1, None) for p in range(4)], "paper_id long, expected_count int, n_pages int, instructions string")
    pages = spark.createDataFrame([(2, 1, 0, 2, text(2, 2))], "paper_id long, page_no int, pos int, question_no int, question_text string")
    asked, need, reader = [], [], R.table_reader(pages)
    held = R.written
    monkeypatch.setattr(R, "written", lambda df, name: need.append(sorted(r.paper_id for r in df.collect())) or held(df, name) if name == "numbers" else held(df, name))
    R.reread(rows, papers, lambda requests: asked.append(sorted((r.paper_id, list(r.numbers)) for r in requests.collect())) or reader(requests), 3)
    assert need == [[0, 1, 2, 3], [2]]
    assert asked == [[(0, [2, 4, 5]), (1, [2, 4, 5]), (2, [2, 4, 5]), (3, [2, 4, 5])], [(2, [4, 5])]]
