"""The table function against the column form; options of a run; cleaned bank rows."""

from pyspark.sql import functions as F

from examlake.functions import text as T
from examlake.functions.tables import register
from examlake.operators import jobs as J
from examlake.operators import records as R
from examlake.options import Options
from examlake.sources import tables as src

TEXTS = [
    "1. What is it here?\n2. Why is it there?", "one line\n\nnext line", "only this", "", "  \n ", None, "Q1: first thing asked\nQ2: second thing asked", "(3) State the law\n(4) Derive the form",
    "1. A page of questions begins here\n\n---PAGE---\n\n2. and one more of them ends it here, as it does", "a\r\nb\r\n\r\nc", "intro \t\n7. Explain it\n8) \"Quote it\"\nQuestion 9 goes on", "12.5 is no start\n13.6 nor this one",
]


def test_lateral_chunks_equal_the_column_form(spark, sf):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "id long, text string").unionByName(src.read(spark, sf, "documents").select((F.col("doc_id") + 1000).alias("id"), "text"))
    docs.createOrReplaceTempView("papers_of_texts")
    register(spark)
    got = spark.sql("SELECT id, q.pos, q.question_no, q.chunk FROM papers_of_texts, LATERAL question_chunks(text) q")
    cut = docs.select("id", F.posexplode(T.question_chunks(F.col("text"))).alias("pos", "chunk"))
    want = cut.select("id", "pos", T.chunk_number(F.col("chunk"), F.col("pos")).alias("question_no"), "chunk")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_options_of_a_run(spark):
    rows = spark.createDataFrame([("What is R - 1/μ here? (A) R - 1/μ\nSolution: none",)], "question_text string")
    assert J.as_told(rows, Options()).collect() == rows.collect()
    got = J.as_told(rows, Options(extract_solutions=True, strict_verbatim=False)).first()
    assert (got.question_text, got.solution) == ("What is R - 1/μ here? (A) \\frac{R}{μ−1}", "none")


def test_bank_questions_cleaned(spark):
    stem = "Explain why the electric field inside a hollow conductor vanishes everywhere?"
    once = f"{stem}\n(A) zero\n(B) one\n(C) two\n(D) three"
    cols = {c: F.lit(None).cast("string").alias(c) for c in R.BANK_COLUMNS}
    bank = spark.createDataFrame([("a", f"{once}\n\n{once}"), ("b", "  §plain   text\xa0"), ("c", None)], "id string, t string").select(*[F.col("id") if c == "id" else F.col("t").alias(c) if c == "question_text" else x for c, x in cols.items()])
    assert {r.id: r.question_text for r in R.bank_questions(bank, clean=True).collect()} == {"a": once, "b": "plain text", "c": ""}
    assert {r.id: r.question_text for r in R.bank_questions(bank).collect()}["b"] == "  §plain   text\xa0"
