"""Shared helpers of the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{str(sf_dir).rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir.

    Where that is unset, a local session gets a temporary one; on a cluster it is an error, as
    executors would write where the driver can't read.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df once as a table in the shared folder and read it back; this cuts its lineage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def row_key():
    """A hash of doc_id and text, which tells rows apart where doc_id is null or repeated."""
    return F.xxhash64("doc_id", "text")


def fresh_name(df: DataFrame, name: str) -> str:
    """name, with underscores put behind until no column of df is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def rows_by_key(docs: DataFrame, keys: DataFrame, how: str, one_each: bool = False) -> DataFrame:
    """Rows of docs whose row_key is ('left_semi') or isn't ('left_anti') in the table of one column, keys; `one_each` row_key."""
    own, other = fresh_name(docs, "__own_key"), fresh_name(docs, "__other_key")
    kept = docs.withColumn(own, row_key()).join(keys.toDF(other), F.col(own) == F.col(other), how)
    return (kept.dropDuplicates([own]) if one_each else kept).drop(own)


def join_by_key(big: DataFrame, small: DataFrame, keys: list[str], most: int = 10_000) -> DataFrame:
    """Inner join on long keys with a written table of one row a key, `n` of them being how many rows of big have the key.

    Keys that hold more than one part in `most` of all rows are `most` at most, so they are broadcast,
    and their rows pass the shuffle of the rest under keys drawn from the row, dealt evenly. `n` is left out.
    """
    total = small.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = F.col("n") > F.lit(max(1000, total // most))
    values = F.struct(*[c for c in small.columns if c not in (*keys, "n")])
    frequent = F.broadcast(small.where(hot).select(*[F.col(k).alias(f"__hot_{k}") for k in keys], values.alias("__hot")))
    rare = small.where(~hot).select(*[F.col(k).alias(f"__rare_{k}") for k in keys], values.alias("__rare"))
    same = [F.col(k) == F.col(f"__hot_{k}") for k in keys]
    rows = big.join(frequent, reduce(lambda a, b: a & b, same), "left")
    spread = [F.when(F.col("__hot").isNull(), F.col(k)).otherwise(F.xxhash64(F.lit(i), *big.columns)) == F.col(f"__rare_{k}") for i, k in enumerate(keys)]
    rows = rows.join(rare, reduce(lambda a, b: a & b, [*spread, F.col("__hot").isNull()]), "left")
    found = F.coalesce("__hot", "__rare")
    return rows.where(found.isNotNull()).select(*big.columns, found.alias("__found")).select(*big.columns, "__found.*")


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def slices(texts: Sequence[str], budget: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about `budget` characters in all, one row at least: bounds numpy's memory."""
    start = size = 0
    for i, t in enumerate(texts):
        if i > start and size + len(t) > budget:
            yield start, i
            start, size = i, 0
        size += len(t)
    if len(texts) > start:
        yield start, len(texts)


def words_of(text: str, lower: bool = True) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ as UTF-8; `lower` changes A-Z only."""
    raw = text.encode()
    return (raw.lower() if lower else raw).split()


def kth_largest(df: DataFrame, column: str, k: int, bins: int = 4096) -> float | None:
    """The k-th largest value of a double column, by counting into ever finer bins.

    Each pass collects at most `bins` counts, never rows; it ends when a bin holds one value.
    None if there are fewer than k rows (everything is in) or k is below 1 (+inf: nothing is in).
    """
    if k < 1:
        return float("inf")
    low, high, n = df.agg(F.min(column), F.max(column), F.count(column)).first()
    if n < k:
        return None
    rank = k
    while low < high:
        width = (high - low) / bins
        if width <= 0 or low + width == low:
            break
        inside = df.where((F.col(column) >= low) & (F.col(column) <= high))
        b = F.least(F.floor((F.col(column) - F.lit(low)) / F.lit(width)), F.lit(bins - 1)).alias("b")
        counts = inside.groupBy(b).agg(F.count(F.lit(1)).alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi")).collect()
        for row in sorted(counts, key=lambda r: -r["b"]):
            if rank <= row["n"]:
                if (row["lo"], row["hi"]) == (low, high):
                    return low
                low, high = row["lo"], row["hi"]
                break
            rank -= row["n"]
    return low
