"""Quality classifier by importance resampling (operator 7)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from examlake.llm.common import kth_largest, materialize, row_key, rows_by_key, slices, text_or_empty

BUCKETS = 1 << 15
SCORES = "doc_id long, row_key long, n_grams long, log_ratio double"


class Hasher:
    """Bucket numbers of a text's words and word pairs, case kept; the cache of words is bounded."""

    def __init__(self, buckets: int = BUCKETS, most: int = 500_000):
        self.buckets, self.most, self.known = buckets, most, {}

    def grams(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All buckets, and how many each text has; a text of n words has n + n - 1."""
        if len(self.known) > self.most:
            self.known = {}
        known, digest = self.known, xxhash.xxh64_intdigest
        words = [t.encode().split() for t in texts]
        for ws in words:
            for w in ws:
                if w not in known:
                    known[w] = digest(w)
        n = np.array([len(ws) for ws in words], np.int64)
        h = np.fromiter((known[w] for ws in words for w in ws), np.uint64, int(n.sum()))
        doc = np.repeat(np.arange(len(texts)), n)
        pair = (h[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ (h[1:] + np.uint64(1))
        inside = np.flatnonzero(doc[:-1] == doc[1:])
        both, owner = np.concatenate((h, pair[inside])), np.concatenate((doc, doc[inside]))
        order = np.argsort(owner, kind="stable")
        mixed = both[order]
        mixed ^= mixed >> np.uint64(32)
        return (mixed % np.uint64(self.buckets)).astype(np.int64), np.bincount(owner, minlength=len(texts))


def _counts(docs: DataFrame, buckets: int) -> DataFrame:
    """bucket, raw, target: n-grams of all rows and of those marked `is_target`, one table per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, raw, target = Hasher(buckets), np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for batch in batches:
            texts, mark = batch.column(0).to_pylist(), batch.column(1).to_numpy(zero_copy_only=False)
            for a, b in slices(texts):
                grams, n = hasher.grams(texts[a:b])
                raw += np.bincount(grams, minlength=buckets)
                target += np.bincount(grams[np.repeat(mark[a:b].astype(bool), n)], minlength=buckets)
        some = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(raw[some]), pa.array(target[some])], ["bucket", "raw", "target"])

    rows = docs.select(text_or_empty().alias("text"), "is_target").mapInArrow(run, "bucket long, raw long, target long")
    return rows.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def fit(docs: DataFrame, target_ids: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """log(p/q) for each bucket: p from the target documents, q from every document of `docs`.

    `target_ids` is a bounded table of doc_ids. One row for each bucket reaches the driver.
    """
    texts = docs.select(F.col("doc_id").alias("doc"), "text")  # no other column can clash with the mark's
    mark = target_ids.select(F.col("doc_id").alias("target")).distinct()
    marked = texts.join(F.broadcast(mark), F.col("doc") == F.col("target"), "left").select("text", F.col("target").isNotNull().alias("is_target"))
    found = _counts(marked, buckets).toArrow()
    raw, target = np.zeros(buckets), np.zeros(buckets)
    at = found.column("bucket").to_numpy()
    raw[at], target[at] = found.column("raw").to_numpy(), found.column("target").to_numpy()
    q = (raw + 1) / (raw.sum() + buckets)
    p = (target + buckets * q) / (target.sum() + buckets)  # unseen buckets fall back on the raw model
    return np.log(p / q)


def score(docs: DataFrame, log_ratio: np.ndarray) -> DataFrame:
    """SCORES of each row: the sum of its n-grams' log(p/q); row_key tells rows of one doc_id apart."""
    shared = docs.sparkSession.sparkContext.broadcast(log_ratio)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, ratio = Hasher(len(shared.value)), shared.value
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for a, b in slices(texts):
                grams, n = hasher.grams(texts[a:b])
                total = np.bincount(np.repeat(np.arange(b - a), n), weights=ratio[grams], minlength=b - a).astype(float)  # whole numbers where no row has a word
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], batch.column(1)[a:b], pa.array(n.astype(np.int64)), pa.array(total)], [f.split()[0] for f in SCORES.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), row_key().alias("row_key"), text_or_empty().alias("text")).mapInArrow(run, SCORES)


def share_of_targets(labels: DataFrame, z: float) -> float:
    """Upper limit (Wilson's, z standard errors) of the share of target documents that labels show; 1 if none is labelled or none is a target."""
    found = labels.groupBy("doc_id").agg(F.min("quality").alias("q")).agg(F.count("q"), F.sum((F.col("q") == 1).cast("long"))).first()
    n, good = found[0], found[1] or 0
    if not n or not good:
        return 1.0
    p = good / n
    return min(1.0, (p + z * z / (2 * n) + z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n))


def draw_keys(weighted: DataFrame, temperature: float, seed: int) -> DataFrame:
    """Adds sort_key = log weight / temperature + Gumbel noise drawn from the hash of the row."""
    u = (F.pmod(F.xxhash64("row_key", F.lit(seed)), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))
    return weighted.withColumn("sort_key", F.col("log_ratio") / F.lit(float(temperature)) - F.log(-F.log(u)))


def draw(weighted: DataFrame, k: int, temperature: float = 1.0, seed: int = 11) -> DataFrame:
    """Adds sort_key, threshold and kept: k rows without replacement, each draw in proportion to weight ** (1 / temperature)."""
    keyed = draw_keys(weighted, temperature, seed)
    least = kth_largest(keyed, "sort_key", k)
    least = float("-inf") if least is None else least
    return keyed.withColumn("threshold", F.lit(least)).withColumn("kept", F.col("sort_key") >= F.lit(least))


def resample(docs: DataFrame, labels: DataFrame, sample: int = 20_000, keep: int | None = None, temperature: float = 1.0, z: float = 3.0, seed: int = 11, buckets: int = BUCKETS) -> DataFrame:
    """SCORES with `sort_key`, `threshold` and `kept` for each row: importance resampling by Gumbel top-k.

    A row's weight is p(text) / q(text), the product of its n-grams' ratios. The target model p
    learns from up to `sample` labelled documents of quality 1 (the bound, chosen by the hash of
    doc_id; of a document labelled twice the lower quality counts), the raw model q from all
    documents. k rows are drawn without replacement in proportion to weight ** (1 / temperature).
    k is `keep`, or else the share of target documents among the labelled ones, taken `z` standard
    errors up so that documents like the target are not crowded out, times the rows. With no
    target label every row is kept. Rows at the k-th key all stay. A null or empty text has weight
    1. Repeated rows draw the same noise and share their fate. Other columns are not read.
    """
    lab = labels.where("doc_id is not null and quality is not null").select("doc_id", "quality")
    good = lab.groupBy("doc_id").agg(F.min("quality").alias("q")).where("q = 1").select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    scored = materialize(score(docs, fit(docs, materialize(good, "targets"), buckets)), "weights")
    k = math.ceil(share_of_targets(lab, z) * scored.count()) if keep is None else keep
    return draw(scored, k, temperature, seed)


def keep_sampled(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of docs that `resample` keeps, with their columns as they are."""
    return rows_by_key(docs, resample(docs, labels, **options).where("kept").select("row_key").distinct(), "left_semi")
