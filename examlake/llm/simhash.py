"""SimHash near-duplicates by covering locality-sensitive hashing (operator 9)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from examlake.llm.common import join_by_key, materialize, row_key, rows_by_key, text_or_empty, words_of
from examlake.llm.components import connected_components

BITS = 64
_KEEP_BLOCK = 2_000


def fingerprint(text: str, width: int = 3, seed: int = 42) -> int:
    """Unsigned 64-bit SimHash of the text's lower-cased `width`-word shingles."""
    words = words_of(text)
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = ends[width - 1 :] if len(words) >= width else ends[-1:]
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(joined[a:b], seed) for a, b in zip(starts[: len(last)].tolist(), last.tolist(), strict=True)], "<u8")
    set_bits = np.zeros(BITS, np.int64)
    for k in range(0, len(h), 65_536):
        part = h[k : k + 65_536]
        set_bits += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * set_bits > len(h), bitorder="little").view("<u8")[0])


def masks(radius: int) -> list[int]:
    """2^(radius+1) - 1 masks such that any two values at most `radius` bits apart agree under one of them.

    Bit i has a nonzero code m(i) of radius+1 bits; mask v holds the bits whose m(i) . v is odd. The
    differing bits' codes span at most `radius` dimensions, so some nonzero v is orthogonal to all.
    """
    n = 2 ** (radius + 1) - 1
    return [sum(1 << i for i in range(BITS) if ((1 + i % n) & v).bit_count() % 2) for v in range(1, n + 1)]


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """doc_id, row_key, fp (the fingerprint as a signed long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t, width) for t in batch.column(2).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps.view(np.int64))], ["doc_id", "row_key", "fp"])

    return docs.select(F.col("doc_id").cast("long"), row_key().alias("row_key"), text_or_empty().alias("text")).mapInArrow(run, "doc_id long, row_key long, fp long")


def _links(fps: np.ndarray, radius: int, free: list[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Star edges that join exactly what is within the radius, step by step, inside one bucket.

    A large bucket is split further by the pigeonhole rule over the bits the mask leaves free; the
    last search walks each component and drops its members, so it emits under one edge a value.
    """
    if len(fps) < 2:
        return []
    if len(fps) > _KEEP_BLOCK and len(free) >= 4 * (radius + 1):
        out = []
        for g in range(radius + 1):
            part = free[g :: radius + 1]
            mask = np.uint64(sum(1 << b for b in part))
            rest = [b for b in free if b not in part]
            key = fps & mask
            order = np.argsort(key, kind="stable")
            cuts = np.flatnonzero(np.diff(key[order])) + 1
            for run in np.split(order, cuts):
                if len(run) > 1:
                    out += _links(fps[run], radius, rest)
        return out
    out, rest = [], fps
    while len(rest) > 1:
        root, rest, frontier = rest[0], rest[1:], [rest[0]]
        while frontier and len(rest):
            near = np.bitwise_count(rest ^ frontier.pop()) <= radius
            if near.any():
                found = rest[near]
                out.append((found, np.full(len(found), root)))
                frontier.extend(found)
                rest = rest[~near]
    return out


def fingerprint_links(distinct: DataFrame, radius: int = 3) -> DataFrame:
    """Edges (a, b) over a table of distinct fingerprints `fp`, enough to connect all pairs within the radius."""
    tables = masks(radius)
    signed = [m - 2**64 if m >= 2**63 else m for m in tables]
    keys = F.array(*[F.struct(F.lit(v).alias("v"), F.col("fp").bitwiseAND(F.lit(m)).alias("k")) for v, m in enumerate(signed)])
    rows = distinct.select("fp", F.explode(keys).alias("x")).select(F.col("x.v").alias("v"), F.col("x.k").alias("k"), "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []  # parts of the bucket in progress, joined once it ends

        def buckets(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            cuts = np.flatnonzero((np.diff(rows[0]) != 0) | (np.diff(rows[1]) != 0)) + 1
            edges = np.concatenate(([0], cuts, [rows.shape[1]]))
            for i in np.flatnonzero(np.diff(edges) > 1):
                part = rows[:, edges[i] : edges[i + 1]]
                mask = tables[int(part[0, 0])]
                free = [b for b in range(BITS) if not mask >> b & 1]
                if found := _links(part[2].view(np.uint64), radius, free):
                    a, b = (np.concatenate(x).view(np.int64) for x in zip(*found, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            rows = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns])
            if not rows.shape[1]:
                continue
            last = int(np.flatnonzero((rows[0] == rows[0, -1]) & (rows[1] == rows[1, -1]))[0])
            if last or (held and (held[0][:2, 0] != rows[:2, 0]).any()):
                yield from buckets(np.concatenate([*held, rows[:, :last]], axis=1))
                held = []
            held.append(rows[:, last:])
        if held:
            yield from buckets(np.concatenate(held, axis=1))

    return rows.repartition("v", "k").sortWithinPartitions("v", "k", "fp").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, radius: int = 3, width: int = 3) -> DataFrame:
    """doc_id, row_key, fp, root (a fingerprint that names the group), component_id for each row of docs.

    Equal fingerprints are one node with its smallest doc_id, so copies never make pairs. A null or
    empty text has fingerprint zero and is linked like any other. Repeated rows give a row each;
    row_key tells rows of one doc_id apart. A null doc_id keeps its row; component_id is the
    smallest id that is not null, or null.
    """
    fps = materialize(fingerprints(docs, width), "fingerprints")
    nodes = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n")), "fingerprint_nodes")
    links = materialize(fingerprint_links(nodes.select("fp"), radius).distinct(), "fingerprint_links")
    linked = connected_components(links)
    comp = nodes.join(linked.select(F.col("node").alias("fp"), "root"), "fp", "inner")
    ids = comp.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = comp.join(ids, "root").select("fp", "root", "component_id")
    label = nodes.join(named, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), F.coalesce("component_id", "first_id").alias("component_id"), "n")
    return join_by_key(fps, materialize(label, "fingerprint_labels"), ["fp"]).select("doc_id", "row_key", "fp", "root", "component_id")


def keep_one(docs: DataFrame, radius: int = 3, width: int = 3) -> DataFrame:
    """docs with one row of each group of near-duplicates: the smallest doc_id's (null last).

    Of different texts under that doc_id in one group the one with the smaller row_key stays, of
    rows with equal doc_id and text any one. Rows of one doc_id in different groups are different
    documents. Columns stay as they are.
    """
    first = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row_key")
    keep = near_duplicates(docs, radius, width).groupBy("root").agg(F.min(first).alias("first")).select("first.row_key")
    return rows_by_key(docs, keep, "left_semi", one_each=True)
