
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{str(sf_dir).rstrip('/')}/{name}.parquet")
    return dealt_round(df) if name == "documents" else df


def dealt_round(df: DataFrame) -> DataFrame:
    """df, its rows dealt to as many tasks as there are cores where its files give fewer: a file of one row group is one task's, however long its texts are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def papers(spark, sf_dir) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    return o.select(F.concat(F.lit("u"), (F.col("o_custkey") % 7).cast("string")).alias("owner_id"), F.col("o_orderkey").alias("paper_id"), F.col("o_orderstatus").alias("class_id"), F.year("o_orderdate").alias("year"), F.col("o_orderpriority").alias("paper_source"), (4 + F.col("o_orderkey") % 4).cast("int").alias("expected_count"), F.col("o_orderdate").alias("stored_at"))


def bank(spark, sf_dir) -> DataFrame:
    li = read(spark, sf_dir, "lineitem")
    text = F.concat(F.lit("Question "), F.repeat(F.lit("a"), (F.col("l_suppkey") % 9).cast("int")))
    return li.select(F.col("l_orderkey").alias("paper_id"), F.col("l_linenumber").alias("question_no"), F.col("l_quantity").cast("decimal(10,2)").alias("marks"), F.col("l_partkey").alias("chapter_id"), F.col("l_suppkey").alias("material_id"), text.alias("question_text"), (F.col("l_partkey") * 100_000 + F.col("l_suppkey")).alias("row_order"))


def full_bank(spark, sf_dir) -> DataFrame:
    """Line items as bank rows of their orders' owners."""
    li, o = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "orders")
    j = li.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    text = lambda *c: F.concat_ws("-", *[F.col(x).cast("string") for x in c])
    paper = F.col("l_linestatus") == "F"
    labels = F.array(*[F.lit(x) for x in ("Class work", "Test", "Final exam", "Model exam", "Others")])
    return j.select(
        F.concat(F.lit("u"), (F.col("o_custkey") % 7).cast("string")).alias("owner_id"), F.concat(text("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), F.lit("-"), F.col("l_quantity").cast("int").cast("string"), "l_linestatus", "l_returnflag").alias("id"),
        F.when(paper, "question_paper").otherwise("material").alias("origin_type"), F.when(~paper, F.concat(F.lit("m"), F.col("l_suppkey").cast("string"))).alias("material_id"),
        F.when(paper, F.concat(F.lit("p"), F.col("l_orderkey").cast("string"))).alias("question_paper_id"), F.col("o_orderstatus").alias("class_id"), F.col("l_returnflag").alias("unit_id"),
        F.concat(F.lit("c"), (F.col("l_partkey") % 50).cast("string")).alias("chapter_id"), F.when(F.col("l_linenumber") < 7, F.col("l_linenumber")).alias("question_no"),
        F.concat(F.lit("Question "), F.repeat(F.lit("a"), (F.col("l_suppkey") % 9).cast("int"))).alias("question_text"), F.col("l_quantity").cast("decimal(10,2)").alias("marks"),
        F.get(labels, (F.col("l_partkey") % 5).cast("int")).alias("source"), F.when(F.col("l_orderkey") % 11 > 0, F.year("o_orderdate")).alias("year"), F.concat(F.lit("t"), (F.col("l_suppkey") % 3).cast("string")).alias("topic"),
    )


def materials(spark, sf_dir) -> DataFrame:
    k = F.col("p_partkey")
    kinds = F.array(*[F.lit(x) for x in ("Question papers", "Class Notes", "Syllabus")])
    exams = F.array(F.lit("Class work"), F.lit("Test"), F.lit("Public exam"), F.lit(None).cast("string"))
    return read(spark, sf_dir, "part").select(F.concat(F.lit("u"), (k % 7).cast("string")).alias("owner_id"), k.alias("material_id"), (F.col("p_size") % 4).alias("class_id"), (F.col("p_size") % 10).alias("unit_id"), F.col("p_size").alias("chapter_id"), F.concat(F.lit("Chapter "), F.col("p_size").cast("string")).alias("chapter_name"), F.get(kinds, (k % 3).cast("int")).alias("material_type"), F.get(exams, (k % 4).cast("int")).alias("exam_source"), (k * 37 % 1000).alias("created_at"), F.col("p_name").alias("name"))


def text_bank(spark, sf_dir) -> DataFrame:
    d = read(spark, sf_dir, "documents")
    return d.select(F.expr("doc_id div 40").alias("paper_id"), F.col("doc_id").alias("row_order"), (1 + F.col("doc_id") * F.col("doc_id") % 37).cast("int").alias("question_no"), F.col("text").alias("question_text"))


def usage_events(spark, sf_dir) -> DataFrame:
    e = read(spark, sf_dir, "events")
    tokens = F.floor(F.abs("value")).cast("long")
    models = F.array(*[F.lit(m) for m in ("gpt-4o", "gpt-4o-mini", "text-embedding-3-small", "gpt-4o-mini-2024", "gpt-4o-2024", "other-embedding", "unknown")])
    owner = F.concat(F.lit("u"), (F.col("user_id") % 7).cast("string"))
    return e.select(F.col("event_id"), owner.alias("owner_id"), F.get(models, (F.col("event_id") % 7).cast("int")).alias("model"), F.col("user_id").alias("job_id"), F.col("event_type").alias("action"), (tokens * 100).alias("prompt_tokens"), tokens.alias("completion_tokens"), F.col("ts").cast("timestamp").alias("created_at"))


def chapters(spark, sf_dir) -> DataFrame:
    b = read(spark, sf_dir, "benchmark")
    i = F.col("item_id")
    head = F.array_join(F.slice(F.split("text", r"\s+"), 1, 3), " ")
    name = F.concat(F.lit("Chapter "), (i + 1).cast("string"), F.lit(": "), head)
    return b.select((i % 4).alias("class_id"), i.alias("chapter_pos"), F.concat(F.lit("ch"), i.cast("string")).alias("chapter_id"), F.concat(F.lit("u"), F.expr("item_id div 10").cast("string")).alias("unit_id"), name.alias("name"))
