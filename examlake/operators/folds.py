"""Ordered folds over groups of any size: sorted partitions are streamed, one group's state is held."""

from __future__ import annotations

from collections import namedtuple
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: rows that a task holds as Python values at a time.
SLICE = 512


class Fold:
    """State of one group: `feed` takes its rows in order, `end` follows the last; both return rows."""

    def feed(self, row) -> list[tuple]:
        raise NotImplementedError

    def end(self) -> list[tuple]:
        return []


def typed(df: DataFrame, columns: list[str], more: str = "") -> str:
    """DDL of some of df's columns, of `more` behind them."""
    own = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns)
    return ", ".join(x for x in (own, more) if x)


def fold_sorted(df: DataFrame, keys: list[str], order: list[str], schema: str, fold: Callable[[], Fold]) -> DataFrame:
    """Rows that a new fold() returns for every group of keys, fed in `order`.

    A group is never held whole: rows stream through Arrow batches, SLICE of them as Python values at a
    time, and Spark's sort may spill. Output rows follow `schema`; NaN is fed as None.
    """
    spark = df.sparkSession
    none = spark.range(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in spark.createDataFrame([], schema).schema])
    out_schema = none.limit(0).toArrow().schema
    row_of = namedtuple("Row", df.columns, rename=True)
    floats = [f.name for f in df.schema if f.dataType.typeName() in ("double", "float")]

    def values(part: pa.RecordBatch, name: str) -> list:
        found = part.column(name).to_pylist()
        return [None if x != x else x for x in found] if name in floats else found

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True) if rows else [()] * len(out_schema)
        return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, out_schema, strict=True)], schema=out_schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state, out = None, None, []
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                part = batch.slice(start, SLICE)
                rows = map(row_of, *[values(part, c) for c in part.schema.names])
                for key, row in zip(zip(*[values(part, k) for k in keys], strict=True), rows, strict=True):
                    if state is None or key != at:
                        out += state.end() if state else []
                        at, state = key, fold()
                    out += state.feed(row)
                if len(out) >= SLICE:
                    yield batch_of(out)
                    out = []
        out += state.end() if state else []
        yield batch_of(out)

    dealt = df.repartition(*keys).sortWithinPartitions(*keys, *[F.col(o).asc_nulls_first() for o in order])
    return dealt.mapInArrow(run, schema)
