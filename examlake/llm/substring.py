"""Substring dedup by content-defined chunking (operator 1)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from examlake.llm.common import fresh_name, join_by_key, materialize, row_key, text_or_empty

CHUNKS = "hi long, lo long, doc_id long, row_key long, start long, stop long"
#: A random 32-bit number for each byte value, made by rule.
GEAR = np.array([xxhash.xxh64_intdigest(bytes([i]), 7) & 0xFFFFFFFF for i in range(256)], np.uint32)
WINDOW = 16
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def boundaries(raw: bytes, bits: int = 5, least: int = 24, most: int = 192) -> list[int]:
    """Chunk ends of a UTF-8 text, the last one its length.

    A cut falls where `bits` bits of the gear hash of the last 16 bytes are zero, moved on to the
    next word's start (within 64 bytes, else to the next character). So cuts depend on the text
    around them only, and an insertion changes the chunks it touches. A chunk has `least` bytes
    at least; after `most` without a cut one is forced.
    """
    n = len(raw)
    if n <= least:
        return [n] if n else []
    b = np.frombuffer(raw, np.uint8)
    h = GEAR[b]
    for k in (1, 2, 4, 8):  # h[i] = sum of gear[b[i-j]] << j over a doubling window
        h = np.concatenate((h[:k], h[k:] + (h[:-k] << np.uint32(k))))
    found = np.flatnonzero((h & np.uint32(((1 << bits) - 1) << (WINDOW - 1))) == 0) + 1
    spaces = np.flatnonzero(_SPACE[b])
    at = np.searchsorted(spaces, found - 1)
    word = np.append(spaces + 1, n + 65)[at]
    found = np.unique(np.where(word - found <= 64, word, found))
    cuts, last = [], 0
    for p in [*found.tolist(), n]:
        while p - last > most:
            q = last + most
            while q < n and raw[q] & 0xC0 == 0x80:
                q += 1
            if q >= n:
                break
            cuts.append(q)
            last = q
        if p < n and p - last >= least and raw[p] & 0xC0 != 0x80:
            cuts.append(p)
            last = p
    cuts.append(n)
    return cuts


def chunks(docs: DataFrame, bits: int = 5, least: int = 24, most: int = 192) -> DataFrame:
    """CHUNKS of all texts: 128-bit digest, byte range. Rows with a null doc_id give none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, names = xxhash.xxh3_128_digest, [f.split()[0] for f in CHUNKS.split(", ")]

        def batch_of(found, rows, stops):
            pairs = np.frombuffer(b"".join(found), "<i8").reshape(-1, 2)
            n = np.array([len(x) for x in stops], np.int64)
            ids, keys = (np.repeat(np.array([r[i] for r in rows], np.int64), n) for i in (0, 1))
            stop = np.concatenate([np.asarray(x, np.int64) for x in stops]) if stops else np.zeros(0, np.int64)
            start = np.concatenate([np.asarray([0, *x[:-1]], np.int64) for x in stops]) if stops else stop
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (pairs[:, 0], pairs[:, 1], ids, keys, start, stop)], names)

        for batch in batches:
            found, rows, stops = [], [], []
            for doc_id, key, text in zip(*(c.to_pylist() for c in batch.columns[:2]), batch.columns[2], strict=True):
                raw, last = text.as_py().encode(), 0
                if cuts := boundaries(raw, bits, least, most):
                    for cut in cuts:
                        found.append(digest(raw[last:cut].strip()))
                        last = cut
                    rows.append((doc_id, key))
                    stops.append(cuts)
                if len(found) > 50_000:
                    yield batch_of(found, rows, stops)
                    found, rows, stops = [], [], []
            yield batch_of(found, rows, stops)

    named = docs.where(F.col("doc_id").isNotNull())
    return named.select(F.col("doc_id").cast("long"), row_key().alias("row_key"), text_or_empty().alias("text")).mapInArrow(run, CHUNKS)


def repeated_runs(docs: DataFrame, bits: int = 5, least: int = 24, most: int = 192, within: bool = False) -> DataFrame:
    """Runs of neighbouring chunks that stand side by side in an earlier document too (by doc_id, row_key), or `within` the same one further up.

    doc_id, row_key, run, start, stop, n_chunks, first_doc_id; the earliest places of the first chunk
    (left_key, left_at: where it starts) and of the last one (right_key, right_at: where it ends).
    """
    pieces = chunks(docs, bits, least, most)
    place = F.struct("doc_id", "row_key", "start", "stop")
    shared = pieces.groupBy("hi", "lo").agg(F.min(place).alias("first"), F.max(F.struct("doc_id", "row_key", "start")).alias("last"), F.count(F.lit(1)).alias("n"))
    at = ["doc_id", "row_key", "start"] if within else ["doc_id", "row_key"]
    shared = materialize(shared.where(F.struct(*[f"first.{c}" for c in at]) < F.struct(*[f"last.{c}" for c in at])).select("hi", "lo", "n", F.col("first.doc_id").alias("first_doc_id"), F.col("first.row_key").alias("first_key"), F.col("first.start").alias("first_start"), F.col("first.stop").alias("first_stop")), "shared_chunks")
    again = join_by_key(pieces, shared, ["hi", "lo"]).drop("hi", "lo").where(F.struct("first_doc_id", "first_key", *["first_start"] * within) < F.struct(*at))
    # a document's chunks meet once; repeated rows are one document
    again = again.repartition("row_key").dropDuplicates(["row_key", "start"])
    order = Window.partitionBy("row_key").orderBy("start")
    shift = F.col("start") - F.col("first_start")
    goes_on = (F.lag("stop").over(order) == F.col("start")) & (F.lag("first_key").over(order) == F.col("first_key")) & (F.lag(shift).over(order) == shift)
    again = again.withColumn("fresh", F.coalesce((~goes_on).cast("int"), F.lit(1))).withColumn("run", F.sum("fresh").over(order)).drop("fresh")
    head, tail = F.min(F.struct("start", "first_key", F.col("first_start").alias("at"))), F.max(F.struct("stop", "first_key", F.col("first_stop").alias("at")))
    runs = again.groupBy("row_key", "run").agg(F.min("doc_id").alias("doc_id"), head.alias("head"), tail.alias("tail"), F.count(F.lit(1)).alias("n_chunks"), F.min("first_doc_id").alias("first_doc_id"))
    return runs.select("doc_id", "row_key", "run", "head.start", "tail.stop", "n_chunks", "first_doc_id", F.col("head.first_key").alias("left_key"), F.col("head.at").alias("left_at"), F.col("tail.first_key").alias("right_key"), F.col("tail.at").alias("right_at"))


def surroundings(docs: DataFrame, places: DataFrame, reach: int) -> DataFrame:
    """place, around: up to `reach` bytes before (even code) or after (odd) each asked place of a text.

    places: row_key, code (2 * byte position + side), repeats allowed; `place` names (row_key, code).
    """
    asked = places.groupBy("row_key").agg(F.collect_set("code").alias("codes")).withColumnRenamed("row_key", "asked_key")
    texts = docs.where(F.col("doc_id").isNotNull()).select(row_key().alias("row_key"), text_or_empty().alias("text"))
    found = texts.join(asked, F.col("row_key") == F.col("asked_key")).select("row_key", "codes", "text").dropDuplicates(["row_key"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.binary()))], ["row_key", "code", "around"])

        for batch in batches:
            rows: list[tuple] = []
            for i in range(batch.num_rows):  # one text at a time, and few surroundings
                key, codes, text = (c[i].as_py() for c in batch.columns)
                raw = text.encode()
                for c in codes:
                    rows.append((key, c, raw[c // 2 : c // 2 + reach] if c % 2 else raw[max(0, c // 2 - reach) : c // 2]))
                    if len(rows) >= 20_000:
                        yield batch_of(rows)
                        rows = []
            yield batch_of(rows)

    return found.mapInArrow(run, "row_key long, code long, around binary").select(F.xxhash64("row_key", "code").alias("place"), "around")


def shared_words(own: bytes, other: bytes, after: bool, reach: int) -> int:
    """Bytes of whole words in which two surroundings agree, from the place outward.

    A word is whole if white space or the text's end bounds it in both; a surrounding shorter than
    `reach` ends with its text.
    """
    if not after:
        own, other = own[::-1], other[::-1]
    n = min(len(own), len(other))
    a, b = (np.frombuffer(x, np.uint8, n) for x in (own, other))
    differ = np.flatnonzero(a != b)
    same = int(differ[0]) if len(differ) else n
    ends = lambda x: bool(_SPACE[x[same]]) if same < len(x) else len(x) < reach
    if ends(own) and ends(other):
        return same
    spaces = np.flatnonzero(_SPACE[a[:same]])
    return int(spaces[-1]) + 1 if len(spaces) else 0


def repeated_spans(docs: DataFrame, min_bytes: int = 200, bits: int = 5, least: int = 24, most: int = 192, within: bool = True) -> DataFrame:
    """Byte ranges that repeat a passage of an earlier document, or, if `within` (the default), of the same one further up.

    doc_id, row_key, start, n_bytes, n_chunks, first_doc_id (the smallest doc_id that holds one of
    its chunks). Chunks are grouped by digest with map-side combining; of a digest's places the
    first by doc_id, row_key and position keeps it. Repeated chunks that are neighbours in both places
    join to a run, and each run is extended on both sides, byte by byte against that place and as far
    as whole words agree (the longest chunk's length), since the chunk in progress at a passage's edge
    never matches. Runs under `min_bytes` are left alone then; of the others, those that meet are one
    span. Frequent digests are broadcast (see `join_by_key`), so a passage in a third of all rows
    is spread over tasks. row_key tells different texts under one doc_id apart; repeated rows are
    one document. Null and empty texts have no chunks, rows with a null doc_id are not read. An
    empty table gives no rows.
    """
    reach = most + 64
    runs = materialize(repeated_runs(docs, bits, least, most, within), "repeated_runs")
    left = runs.select("row_key", "run", F.lit(0).alias("side"), (F.col("start") * 2).alias("code"), F.col("left_key").alias("first_key"), (F.col("left_at") * 2).alias("first_code"))
    right = runs.select("row_key", "run", F.lit(1).alias("side"), (F.col("stop") * 2 + 1).alias("code"), F.col("right_key").alias("first_key"), (F.col("right_at") * 2 + 1).alias("first_code"))
    edges = left.unionByName(right)
    asked = edges.select("row_key", "code").unionByName(edges.select(F.col("first_key").alias("row_key"), F.col("first_code").alias("code")))
    around = materialize(surroundings(docs, asked, reach), "surroundings")
    edges = edges.select("row_key", "run", "side", F.xxhash64("row_key", "code").alias("place"), F.xxhash64("first_key", "first_code").alias("first_place"))
    uses = edges.groupBy("first_place").agg(F.count(F.lit(1)).alias("n"))
    firsts = materialize(uses.join(around, F.col("first_place") == F.col("place")).select("first_place", "n", F.col("around").alias("other")), "first_surroundings")
    both = join_by_key(edges.join(around, "place").drop("place"), firsts, ["first_place"])

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            more = [shared_words(a, b, side == 1, reach) for side, a, b in zip(*(c.to_pylist() for c in batch.columns[2:]), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(more, pa.int64())], ["row_key", "run", "side", "more"])

    grown = both.select("row_key", "run", "side", "around", "other").mapInArrow(extend, "row_key long, run long, side int, more long")
    grown = grown.groupBy("row_key", "run").agg(F.sum(F.when(F.col("side") == 0, F.col("more"))).alias("before"), F.sum(F.when(F.col("side") == 1, F.col("more"))).alias("after"))
    spans = runs.join(grown, ["row_key", "run"]).select("doc_id", "row_key", (F.col("start") - F.col("before")).alias("start"), (F.col("stop") + F.col("after")).alias("stop"), "n_chunks", "first_doc_id")
    spans = spans.where(F.col("stop") - F.col("start") >= min_bytes)
    order = Window.partitionBy("row_key").orderBy("start", "stop")
    reached = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.withColumn("fresh", F.coalesce((reached < F.col("start")).cast("int"), F.lit(1))).withColumn("span", F.sum("fresh").over(order))
    spans = spans.groupBy("row_key", "span").agg(F.min("doc_id").alias("doc_id"), F.min("start").alias("start"), (F.max("stop") - F.min("start")).alias("n_bytes"), F.sum("n_chunks").alias("n_chunks"), F.min("first_doc_id").alias("first_doc_id"))
    return spans.select("doc_id", "row_key", "start", "n_bytes", "n_chunks", "first_doc_id")


@F.pandas_udf(StringType())
def _without(texts: pd.Series, spans: pd.Series) -> pd.Series:
    out = []
    for text, cut in zip(texts, spans, strict=True):
        if text is not None and cut is not None and len(cut):
            raw, last, kept = text.encode(), 0, []
            for s in sorted(cut, key=lambda x: x["start"]):
                kept.append(raw[last : s["start"]])
                last = s["start"] + s["n_bytes"]
            text = b"".join([*kept, raw[last:]]).decode("utf-8", "ignore")
        out.append(text)
    return pd.Series(out, dtype=object)


def remove_repeats(docs: DataFrame, **options) -> DataFrame:
    """docs with repeated spans cut from `text`, and `n_chars`, if there, set to the new length.

    Every row stays, also one whose text is wholly repeated (its text becomes empty). Rows without
    a repeated span, and rows with a null doc_id or text, are unchanged.
    """
    own, other, cut = (fresh_name(docs, n) for n in ("__own_key", "__other_key", "__cut"))
    spans = repeated_spans(docs, **options).groupBy("row_key").agg(F.collect_list(F.struct("start", "n_bytes")).alias("spans")).toDF(other, cut)
    joined = docs.withColumn(own, F.when(F.col("doc_id").isNotNull(), row_key())).join(spans, F.col(own) == F.col(other), "left")
    joined = joined.withColumn("text", F.when(F.col(cut).isNull(), F.col("text")).otherwise(_without("text", cut)))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        joined = joined.withColumn("n_chars", F.when(F.col(cut).isNull(), F.col("n_chars")).otherwise(F.length("text").cast(kind)))
    return joined.select(*docs.columns)
