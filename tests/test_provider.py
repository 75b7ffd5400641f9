"""Providers: calls in batches, retries, errors as rows, tables of answers."""

import json

from pyspark.sql import functions as F

from examlake.operators import extraction as E
from examlake.operators import knowledge as K
from examlake.operators import provider as P

STEM = "Explain why the electric field inside a hollow conductor vanishes everywhere"


def test_only_asked_retries():
    waits, calls = [], []

    def flaky(rows):
        calls.append(len(rows))
        if len(calls) < 3:
            raise P.TryAgain("busy", 7.0 if len(calls) == 2 else None)
        return [{"answer": r["x"]} for r in rows]

    assert P.ask(flaky, [{"x": 1}, {"x": 2}], wait=5.0, sleep=waits.append) == ([{"answer": 1}, {"answer": 2}], 3, None)
    assert (calls, waits) == ([2, 2, 2], [5.0, 7.0])

    def busy(rows):
        raise P.TryAgain("busy")

    assert P.ask(busy, [{}], sleep=waits.append) == ([{}], 3, "busy")
    assert waits == [5.0, 7.0, 15.0, 30.0]  # no wait after the last

    def broken(rows):
        raise KeyError("x" * 500)

    assert P.ask(broken, [{}], sleep=waits.append)[1:] == (1, ("'" + "x" * 500)[:200])
    assert P.ask(lambda rows: [{}], [{}, {}]) == ([{}, {}], 1, "2 asked, 1 answered.")


def _model(rows):
    assert len(rows) <= 2 and len({r["paper_id"] for r in rows}) == 1
    if rows[0]["paper_id"] == "p3":
        raise RuntimeError("no such model")
    return [{"answer": json.dumps({"questions": [{"questionNo": str(r["answer_no"] + 1), "questionText": r["text"]}]}), "model": "gpt-4o", "prompt_tokens": 100, "completion_tokens": 10} for r in rows]


def test_model_answers_by_a_function(spark):
    rows = [(p, i, f"{STEM} {p} {i}") for p in ("p1", "p2", "p3") for i in range(3)]
    asked = spark.createDataFrame(rows, "paper_id string, answer_no int, text string")
    provider = P.from_function(_model, "answer string", ["paper_id", "answer_no"], group=["paper_id"], size=2, wait=0.0)
    answers = provider(asked)
    assert {(r.paper_id, r.answer_no): r.error for r in answers.collect()} == {(p, i): "no such model" if p == "p3" else None for p, i, _ in rows}
    got = sorted((r.paper_id, r.question_no, r.question_text) for r in E.flatten_model_answers(asked, provider).collect())
    assert got == [(p, i + 1, t) for p, i, t in rows if p != "p3"]
    used = P.usage_of(answers, "extract.text", "paper_id").groupBy("paper_id", "action").agg(F.sum("prompt_tokens").alias("n")).collect()
    assert sorted(map(tuple, used)) == [("p1", "extract.text", 300), ("p2", "extract.text", 300)]


def _embed(rows):
    return [{"embedding": [float(len(r["input"])), 1.0]} if r["input"] != "Flux" else {"error": "not this one"} for r in rows]


def test_knowledge_by_a_function_equals_the_table(spark):
    materials = spark.createDataFrame([("k1", "Electric charges", "m1", 1, "text", "about charges", True, None), ("k2", "Optics", "m2", 1, " ", "about light", True, None)], "chapter_id string, chapter_name string, material_id string, created_at long, text string, summary string, matches_chapter boolean, error string")
    concepts = spark.createDataFrame([("k1", 0, "Gauss law"), ("k1", 1, "Flux")], "chapter_id string, pos int, name string")
    provider = P.from_function(_embed, "embedding array<double>", ["input"], size=P.TEXTS)
    table = spark.createDataFrame([(t, [float(len(t)), 1.0]) for t in ("Electric charges", "about charges", "Optics", "about light", "Gauss law")], "input string, embedding array<double>")
    show = lambda found: [sorted(map(str, df.collect())) for df in found]
    assert show(K.build_knowledge(materials, concepts, provider)) == show(K.build_knowledge(materials, concepts, table))


def test_table_of_answers(spark):
    asked = spark.createDataFrame([("p1", 0, "a"), ("p2", 0, "b")], "paper_id string, answer_no int, text string")
    table = spark.createDataFrame([("p1", 0, "[]")], "paper_id string, answer_no int, answer string")
    got = {r.paper_id: (r.answer, r.error) for r in P.from_table(table, ["paper_id", "answer_no"])(asked).collect()}
    assert got == {"p1": ("[]", None), "p2": (None, P.NO_ANSWER)}
