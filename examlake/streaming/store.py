"""A Parquet table in buckets of its key, of which a micro-batch rewrites only those that it touches.

Every rewrite goes to a new folder; a pointer file then names the folder of each bucket. Readers take
the newest pointer, so a crash at any moment leaves either the table before the batch or the one
after it, and what a pointer names is never written again.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKETS = 64
#: Pointers kept, and with them the folders that only they name, for readers that are under way.
KEPT = 3


class Store:
    """The table at `path`, of any file system that Spark writes to."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm
        self._file = jvm.org.apache.hadoop.fs.Path
        self._fs = self._file(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _pointers(self) -> list[int]:
        folder = self._file(f"{self.path}/_pointers")
        if not self._fs.exists(folder):
            return []
        names = [f.getPath().getName() for f in self._fs.listStatus(folder)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def _read_pointer(self, number: int) -> dict[str, str]:
        stream = self._fs.open(self._file(f"{self.path}/_pointers/{number}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def folders(self) -> dict[str, str]:
        """The folder of each bucket; empty before the first batch."""
        numbers = self._pointers()
        return self._read_pointer(numbers[-1]) if numbers else {}

    def read(self, schema: StructType | str, buckets: list[int] | None = None) -> DataFrame:
        """Rows of all, or of some, buckets, without the bucket's number."""
        found = [f"{self.path}/{f}" for b, f in self.folders().items() if buckets is None or int(b) in buckets]
        return self.spark.read.schema(schema).parquet(*found) if found else self.spark.createDataFrame([], schema)

    def put(self, rows: DataFrame, touched: list[int]) -> None:
        """rows, with their `bucket`, in place of the touched buckets."""
        before, numbers = self.folders(), self._pointers()
        folder = f"data/{uuid.uuid4().hex}"
        rows.write.partitionBy("bucket").parquet(f"{self.path}/{folder}")
        made = {f.getPath().getName().split("=")[1] for f in self._fs.listStatus(self._file(f"{self.path}/{folder}")) if "=" in f.getPath().getName()}
        after = {b: f for b, f in before.items() if int(b) not in touched} | {b: f"{folder}/bucket={b}" for b in made}
        number = numbers[-1] + 1 if numbers else 0
        whole, part = self._file(f"{self.path}/_pointers/{number}.json"), self._file(f"{self.path}/_pointers/{number}.{uuid.uuid4().hex}.part")
        stream = self._fs.create(part, True)
        stream.write(json.dumps(after).encode())
        stream.close()
        if not self._fs.rename(part, whole):
            raise RuntimeError(f"pointer {number} of {self.path} is there already: another writer is at work")
        self._drop_old([*numbers, number])

    def _drop_old(self, numbers: list[int]) -> None:
        named = {f.split("/bucket=")[0] for n in numbers[-KEPT:] for f in self._read_pointer(n).values()}
        for n in numbers[:-KEPT]:
            for folder in {f.split("/bucket=")[0] for f in self._read_pointer(n).values()} - named:
                self._fs.delete(self._file(f"{self.path}/{folder}"), True)
            self._fs.delete(self._file(f"{self.path}/_pointers/{n}.json"), False)


def read_store(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    return Store(spark, path).read(schema)


def rewrite_buckets(batch: DataFrame, store: str, key: list[str], merge: Callable[[DataFrame, DataFrame], DataFrame], buckets: int = BUCKETS) -> None:
    """Puts merge(old, batch) in place of the buckets that the batch's keys fall into; other buckets are not read.

    merge must give the same rows when a batch comes twice, as it may after a failure.
    """
    table = Store(batch.sparkSession, store)
    number = F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")
    touched = [r["bucket"] for r in batch.select(number.alias("bucket")).distinct().collect()]
    if touched:
        table.put(merge(table.read(batch.schema, touched), batch).withColumn("bucket", number), touched)
