"""Quality rules by repetition coverage (operator 10)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from examlake.llm.common import slices, text_or_empty

SYMBOLS = "#*$%&|<>"
#: Largest share of a text's characters that may lie inside duplicated n-grams (by n) or lines. Three words
#: catch runs of one word or pair, which hold few different 5-word windows.
NGRAM_LIMITS = {3: 0.30, 5: 0.25, 6: 0.24, 7: 0.23, 8: 0.22, 9: 0.21, 10: 0.20}
LINE_LIMIT = 0.30
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, dup_line_share double, dup_ngram_share double, base_failed boolean, kept boolean"
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def _covered(ids: np.ndarray, hashes: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Mask of the words inside n-word windows that occur twice or more in their own text."""
    mask = np.zeros(len(ids), bool)
    m = len(ids) - n + 1
    if m < 2:
        return mask
    rolled = np.zeros(m, np.uint64)
    for j in range(n):  # polynomial rolling hash of the n words from each place, all places at once
        rolled = rolled * _BASE + hashes[j : j + m]
    inside = np.flatnonzero(doc[:m] == doc[n - 1 :])
    order = inside[np.lexsort((rolled[inside], doc[inside]))]
    a, b = order[:-1], order[1:]
    hit = np.flatnonzero((rolled[a] == rolled[b]) & (doc[a] == doc[b]))
    a, b = a[hit], b[hit]
    for j in range(n):  # equal hashes are compared word by word
        same = ids[a + j] == ids[b + j]
        a, b = a[same], b[same]
    starts = np.union1d(a, b)
    step = np.zeros(len(ids) + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + n, -1)
    return np.cumsum(step[:-1]) > 0


def measure(texts: list[str], limits: dict[int, float] | None = None, line_limit: float = LINE_LIMIT) -> list[tuple]:
    """One tuple of SCHEMA's columns after doc_id for each text."""
    limits = NGRAM_LIMITS if limits is None else limits
    words = [t.encode().split() for t in texts]
    counts = np.array([len(w) for w in words], np.int64)
    flat = [w for ws in words for w in ws]
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in flat), np.int64, len(flat))
    sums = np.array([xxhash.xxh64_intdigest(w) for w in known], np.uint64)
    points = np.array([len(w.decode("utf-8", "replace")) for w in known], np.int64)
    hashes, chars = (sums[ids], points[ids]) if len(known) else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    doc = np.repeat(np.arange(len(texts)), counts)

    def per_doc(values: np.ndarray) -> np.ndarray:
        return np.bincount(doc, weights=values, minlength=len(texts)).astype(np.int64)

    word_chars = per_doc(chars)
    masks = {n: _covered(ids, hashes, doc, n) for n in sorted({5, *limits})}
    repeat_words = per_doc(masks[5])
    in_ngrams = {n: per_doc(chars * masks[n]) for n in limits}
    out = []
    for i, t in enumerate(texts):
        seen: set[str] = set()
        dup_lines = dup_chars = 0
        for line in t.split("\n"):
            if bare := line.encode().split():
                if line in seen:
                    dup_lines += 1
                    dup_chars += sum(len(w.decode("utf-8", "replace")) for w in bare)
                seen.add(line)
        n, c, r = int(counts[i]), int(word_chars[i]), int(repeat_words[i])
        failed = n < 10 or 100 * r > 20 * n
        line_share = dup_chars / c if c else 0.0
        shares = {k: int(in_ngrams[k][i]) / c if c else 0.0 for k in limits}
        kept = not failed and line_share <= line_limit and all(shares[k] <= limits[k] for k in limits)
        out.append((n, c, sum(map(t.count, SYMBOLS)), dup_lines, r, line_share, max(shares.values(), default=0.0), failed, kept))
    return out


def repetition_rules(docs: DataFrame, limits: dict[int, float] | None = None, line_limit: float = LINE_LIMIT) -> DataFrame:
    """Repetition figures and a verdict for each document, without a shuffle.

    For each n-gram length a polynomial hash rolls over a batch's word hashes in numpy; windows
    with equal hashes in one text are compared word by word, and the characters of the words they
    cover are counted once. A null or empty text has no words: all zero, base_failed true, kept
    false. Repeated rows give a row each; a null doc_id stays null; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for a, b in slices(texts):
                columns = list(zip(*measure(texts[a:b], limits, line_limit), strict=True))
                kinds = [pa.int64()] * 5 + [pa.float64()] * 2 + [pa.bool_()] * 2
                arrays = [ids[a:b], *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))]
                yield pa.RecordBatch.from_arrays(arrays, [f.split()[0] for f in SCHEMA.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")).mapInArrow(run, SCHEMA)
