"""Tables of many tenants in folders by owner and class."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from examlake.operators.bank import upsert
from examlake.sources.written import written

BY = ("owner_id", "class_id")


def write_tenants(df: DataFrame, path: str, by: tuple[str, ...] = BY) -> None:
    """df as a Parquet table in folders by owner and class, each folder's rows gathered into few files; a table that is there is replaced."""
    df.repartition(*by, _spread(df, by)).write.mode("overwrite").partitionBy(*by).parquet(path)


def _spread(df: DataFrame, by: tuple[str, ...]):
    """A hash of the rest of a row, in 8 parts, so that a tenant that holds a third of all rows is written by several tasks."""
    return F.pmod(F.xxhash64(*[c for c in df.columns if c not in by]), F.lit(8))


def read_tenants(spark: SparkSession, path: str) -> DataFrame:
    """The table; owner_id and class_id are read off the folders as text, so filters on them leave other folders out."""
    return spark.read.option("inferSchema", "false").parquet(path)


def upsert_tenants(updates: DataFrame, path: str, keys: list[str], by: tuple[str, ...] = BY) -> None:
    """Rows of updates in place of rows with equal keys, within the folders of the owners that updates name.

    keys hold owner_id. Only these owners' folders are read (the join with the owners prunes the others
    while the query runs) and only those whose rows change place or content are written; a row that
    moves to another class leaves its old folder, and a folder without rows is removed. One writer at a
    time. A crash while folders are swapped can leave the touched owners half written; running the
    same updates again puts that right, as the new rows are kept in the shared folder until the end.
    """
    spark = updates.sparkSession
    updates = written(updates, "updates")
    owners = updates.select("owner_id").distinct()
    old = read_tenants(spark, path).join(owners, ["owner_id"], "left_semi")
    touched = old.join(updates.select(*keys), keys, "left_semi").select(*by).unionByName(updates.select(*by)).distinct()
    touched = written(touched, "touched")
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by]
    inside = old.join(touched.toDF(*[f"__{c}" for c in by]), on=_all(same), how="left_semi")
    new = written(upsert(inside, updates.select(*inside.columns), keys), "tenants")
    new.repartition(*by, _spread(new, by)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)
    for row in touched.join(new.select(*by).distinct(), list(by), "left_anti").toLocalIterator():
        _remove(spark, "/".join([path.rstrip("/"), *[f"{c}={row[c]}" for c in by]]))


def _all(tests):
    out = tests[0]
    for t in tests[1:]:
        out = out & t
    return out


def _remove(spark: SparkSession, folder: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
