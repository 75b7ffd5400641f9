"""Queries of the training-data operators; each applies one to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from examlake.llm import chat, decontaminate, extraction, language_model, mixing, packing, quality, repair, repetition, simhash, substring, toxicity, trie
from examlake.llm.common import materialize, table

SIZE = 4096


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.repeated_spans(table(spark, sf_dir, "documents")).drop("row_key")


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    out = chat.format_trees(chat.conversation_nodes(rows.unionByName(extra)))
    turns = chat.read_back(F.col("formatted"))
    flat = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    out = out.select(F.col("tree_id").alias("conv_id"), turns.alias("turns"), chat.loss_text(F.col("segments")).alias("loss"), F.length("formatted").cast("long").alias("formatted_chars"))
    return out.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(flat, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("row_key")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.main_text(table(spark, sf_dir, "pages"))


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.scores(table(spark, sf_dir, "documents")).drop("row_key")


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("row_key")


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path(), SIZE)


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.repetition_rules(table(spark, sf_dir, "documents"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = table(spark, sf_dir, "conversations")
    report, turns = repair.repair(repair.damaged(said))
    digests = repair.turn_digests(turns).select("conv_id", F.col("sha256").alias("repaired_sha256"))
    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    every = said.select("conv_id").distinct()
    same = F.col("conv_id").eqNullSafe(F.col("c"))
    out = every.join(report.withColumnRenamed("conv_id", "c"), same, "left").drop("c").join(digests.withColumnRenamed("conv_id", "c"), same, "left").drop("c")
    filled = [F.coalesce(k, F.lit(0)).cast("long").alias(k) for k in numbers]
    return out.select("conv_id", *filled, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def op12_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = mixing.sized(table(spark, sf_dir, "documents")).select("doc_id", "source", "size")
    return mixing.with_copies(materialize(sized, "sizes")).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = materialize(trie.numbered(table(spark, sf_dir, "conversations")), "turns")
    nodes, ends = trie.prefix_trie(*trie.rebuilt(turns))
    out = nodes.join(ends, "node", "left")
    sha = F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", sha)


OPERATORS = (op1_substring_dedup, op2_chat_formatting, op3_benchmark_decontamination, op4_toxicity, op5_html_extraction, op6_lm_scoring, op7_quality_classifier, op8_best_fit_packing, op9_simhash_near_dedup, op10_quality_rules, op11_conversation_repair, op12_source_mixing, op13_prefix_trie)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in OPERATORS}


def oracle_sql() -> dict[str, str]:
    from examlake.llm.oracles import ORACLES

    return dict(ORACLES)
