"""Order-dependent rules, streaming and fixtures."""

import datetime

from pyspark.sql import functions as F

from examlake.functions import text as T
from examlake.operators import bank as ops
from examlake.operators import usage
from examlake.operators import vectors as V
from examlake.streaming.store import read_store
from examlake.streaming.usage import daily_usage, latest_jobs, persist_stream


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first()["x"]


def test_text_columns(spark):
    assert one(spark, T.ranges(F.array_sort("n")), n=[22, 23, 24, 25, 31]) == "22-25, 31"
    assert one(spark, T.ranges(F.array_sort("n")), n=[3, 5, 7]) == "3, 5, 7"
    assert one(spark, T.percent(F.lit(84.5)), n=1) == 85
    parts = one(spark, T.split_numbered(F.lit(21), F.col("t")), t="State Ohm's law.\n22. Derive the lens formula.\n23. Explain total reflection.")
    assert [(p["no"], p["text"]) for p in parts] == [(21, "State Ohm's law."), (22, "Derive the lens formula."), (23, "Explain total reflection.")]
    assert one(spark, T.repair_escapes(F.col("t")), t="\\upsilon \\u00e9") == "\\\\upsilon \\u00e9"
    assert one(spark, T.marks_in_text(F.col("t")), t="Find x. [3 marks]") == 3
    assert one(spark, T.stated_total(F.col("t"), [r"(?i)maximum marks:?\s*(\d+)"]), t="Maximum Marks: 70") == 70
    assert one(spark, T.cosine(F.col("a"), F.col("b")), a=[1.0, 0.0], b=[0.0]) == 0.0


def test_persist_is_idempotent(spark):
    base = spark.createDataFrame([("p", "a"), ("p", "b"), ("p", "c"), ("q", "z")], "paper string, id string")
    new = spark.createDataFrame([("p", "b"), ("p", "d")], "paper string, id string")
    once = ops.persist_questions(base, new, "paper", ["id"])
    rows = sorted(map(tuple, once.collect()))
    assert rows == [("p", "b"), ("p", "d"), ("q", "z")]
    assert sorted(map(tuple, ops.persist_questions(once, new, "paper", ["id"]).collect())) == rows
    assert ops.persist_questions(base, new.limit(0), "paper", ["id"]).count() == 4


def test_streams(spark, tmp_path):
    at = datetime.datetime(2024, 1, 1, 12)
    rows = [(1, "a", at, 5), (1, "b", at + datetime.timedelta(days=1), 7), (2, "a", at + datetime.timedelta(days=9), 1)]
    df = spark.createDataFrame(rows, "job_id long, action string, created_at timestamp, prompt_tokens long")
    df.write.parquet(str(tmp_path / "in"))
    stream = daily_usage(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("daily").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.table("daily").collect())) == sorted(map(tuple, daily_usage(df).collect()))
    changes = df.select("job_id", F.col("action").alias("status"), F.col("created_at").alias("updated_at"))
    changes.write.parquet(str(tmp_path / "jobs"))
    q = latest_jobs(spark.readStream.schema(changes.schema).parquet(str(tmp_path / "jobs")), str(tmp_path / "store"), str(tmp_path / "cp"))
    q.awaitTermination()
    assert {(r["job_id"], r["status"]) for r in read_store(spark, str(tmp_path / "store"), changes.schema).collect()} == {(1, "b"), (2, "a")}


def test_every_vector_is_classified(spark, sf):
    from examlake.plans import registry

    want = {r["vec_id"] for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    assert {r["question_id"] for r in registry.queries()["classify_all_vectors"](spark, sf).collect()} == want


def test_concepts_in_blocks_are_not_broadcast_by_hint(spark):
    vectors = [(i, i % 3, [float(i % 7), float(i % 11), 1.0]) for i in range(4000)]
    v = spark.createDataFrame(vectors, "question_id long, chapter_id long, embedding array<double>")
    profiles = v.groupBy("chapter_id").agg(F.min_by("embedding", "question_id").alias("title_embedding"), F.max_by("embedding", "question_id").alias("summary_embedding"))
    whole = v.groupBy("chapter_id").agg(F.collect_list("embedding").alias("concepts"))
    few = v.where("question_id < 50").select("question_id", "embedding")
    want = V.classify_vector(few, profiles.join(whole, "chapter_id"), scope=[])
    got = V.classify_vector(few, profiles, scope=[], concept_rows=v.select("chapter_id", F.col("embedding").alias("concept")))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert "broadcast" not in got._jdf.queryExecution().analyzed().toString().lower()


def test_marks_behind_long_texts(spark, tmp_path):
    from examlake.plans import registry

    long = "Find the focal length of the given lens. " * 5
    rows = [(i, long + end) for i, end in enumerate(["(4 marks) is said.", "x", "x", "x", "x"])]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    q = registry.queries()
    got = {r["row_order"]: r["marks"] for r in q["marks_in_whole_texts"](spark, str(tmp_path)).collect()}
    assert got == {0: 4, 1: 2.5, 2: 5, 3: 10, 4: 17}
    assert q["marks_from_text"](spark, str(tmp_path)).where("row_order = 3").first()["marks"] == 10


def test_expected_zero_is_unknown(spark):
    papers = spark.createDataFrame([(1, 0), (2, None), (3, 2), (4, 3)], "paper_id long, expected_count int")
    bank = spark.createDataFrame([(1, 1, "a", 1.0, 1), (2, 2, "b", 1.0, 1), (3, 1, "short", 9.0, 1), (3, 1, "the longer text", 2.0, 2), (3, 2, "x", None, 3)], "paper_id long, question_no int, question_text string, marks double, row_order long")
    got = {r["paper_id"]: r for r in ops.quality_report(papers, bank).collect()}
    assert (got[1]["missing"], got[1]["extra"], got[1]["status"]) == ("", "", "Needs Review") == (got[2]["missing"], got[2]["extra"], got[2]["status"])
    assert (float(got[3]["marks_sum"]), got[3]["without_marks"], got[3]["duplicates"]) == (2.0, 1, "1")
    assert got[3]["issues"] == ["repeated: 1", "1 without marks"] and got[4]["issues"] == ["no questions yet"]


def test_tenants_stay_apart(spark):
    papers = spark.createDataFrame([("a", 1, 1), ("b", 1, 2)], "owner_id string, paper_id long, expected_count int")
    bank = spark.createDataFrame([("a", 1, 1, "q", 1.0, 1), ("b", 1, 1, "q", 1.0, 1), ("b", 1, 2, "q", 1.0, 2)], "owner_id string, paper_id long, question_no int, question_text string, marks double, row_order long")
    assert {(r["owner_id"], r["extracted"], r["status"]) for r in ops.quality_report(papers, bank).collect()} == {("a", 1, "Passed"), ("b", 2, "Passed")}
    pairs = ops.near_duplicate_pairs(bank.withColumn("question_text", F.lit("several longer words here")))
    assert {(r["owner_id"], r["row_a"], r["row_b"], r["kind"]) for r in pairs.collect()} == {("b", 1, 2, "copy")}


def test_price_overrides():
    assert usage.price_overrides('{"m": {"inputPerMillion": 3}}') == {"m": (3.0, 0.0)}
    assert usage.price_overrides("no json") == usage.price_overrides(None) == usage.price_overrides("[1]") == {}


def test_costs(spark):
    rows = [("gpt-4o", 420_000, 12_000), (" gpt-4o-mini-x ", 1_000_000, 1_000_000), ("my-embedding", 1_000_000, 5), ("other", 5, 5), ("m", 1, 0), (None, 1, 1)]
    df = spark.createDataFrame(rows, "model string, p long, c long")
    got = [float(r["x"]) for r in df.select(usage.cost_usd(F.col("model"), F.col("p"), F.col("c"), {"m": (3.0, 0.0)}).alias("x")).collect()]
    assert got == [1.17, 0.75, 0.02, 0.0, 0.000003, 0.0]


BANK = "owner_id string, paper_id long, question_no int, question_text string"


def test_questions_are_persisted_once(spark, tmp_path):
    raw = [("a", 1, 0, "What is the speed of light in vacuum", "1"), ("a", 1, 1, "What is the speed of light in vacuum today", "1"), ("a", 1, 2, "short", "2"), ("b", 1, 0, "State the second law of motion", None)]
    df = spark.createDataFrame(raw, "owner_id string, paper_id long, row_order long, question_text string, questionNo string")
    df.write.parquet(str(tmp_path / "in"))
    for checkpoint in ("one", "two"):  # the second reads everything anew
        q = persist_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), str(tmp_path / "bank"), str(tmp_path / checkpoint))
        q.awaitTermination()
        got = {(r["owner_id"], r["paper_id"], r["question_no"], r["question_text"]) for r in read_store(spark, str(tmp_path / "bank"), BANK).collect()}
        assert got == {("a", 1, 1, raw[1][3]), ("b", 1, 1, raw[3][3])}
    assert read_store(spark, str(tmp_path / "bank"), BANK).count() == 2


def test_last_years(spark):
    got = one(spark, usage.last_years(3), n=1)
    assert got == [datetime.date.today().year - k for k in range(3)]
