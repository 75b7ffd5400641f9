"""Files of papers and materials, read as binary rows and labelled by kind."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def file_kind(path: Column, mime: Column, content: Column) -> Column:
    """'text', 'pdf' or 'other', by MIME type, then extension, then the first bytes."""
    name, kind = F.lower(F.coalesce(path, F.lit(""))), F.coalesce(mime, F.lit(""))
    pdf = (kind == "application/pdf") | name.endswith(".pdf") | F.coalesce(F.substring(content, 1, 4) == F.lit(b"%PDF"), F.lit(False))
    return F.when(kind.startswith("text/") | name.endswith(".txt"), "text").when(pdf, "pdf").otherwise("other")


def raw_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, length, modificationTime, kind, text (null unless kind is text) of all files under path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    files = files.withColumn("kind", file_kind(F.col("path"), F.lit(None).cast("string"), F.col("content")))
    return files.select("path", "length", "modificationTime", "kind", F.when(F.col("kind") == "text", F.decode("content", "UTF-8")).alias("text"))


def text_items(spark: SparkSession, path: str) -> DataFrame:
    """Positioned text items kept as Parquet: paper_id, page_no, page_width, str, x, y."""
    return spark.read.parquet(path).select("paper_id", "page_no", "page_width", "str", "x", "y")
