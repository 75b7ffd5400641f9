"""Benchmark decontamination with a block-max BM25 index (operator 3)."""

from __future__ import annotations

import math
import pickle
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from examlake.llm.common import materialize, row_key, rows_by_key, slices, text_or_empty

LEAKS = "doc_id long, row_key long, item_id long, start_word long, score double, question_overlap double, answer_overlap double"
K1, B = 1.2, 0.75
#: What is cut off words' ends: every ASCII sign but digits and small letters.
EDGE = bytes(b for b in range(128) if not chr(b).isdigit() and not "a" <= chr(b) <= "z")
_SENTENCE = re.compile(r"(?<=[.?!])\s+|\n+")


def terms(text: str) -> list[bytes]:
    """Lower-cased words without outer punctuation; words of punctuation only are left out."""
    return [w for w in (x.strip(EDGE) for x in text.encode().lower().split()) if w]


def question_and_answer(text: str) -> tuple[list[bytes], list[bytes]]:
    """An item's answer is its last sentence or line, its question all before; one sentence is all question."""
    parts = [p for p in (terms(s) for s in _SENTENCE.split(text)) if p]
    if len(parts) < 2:
        return [w for p in parts for w in p], []
    return [w for p in parts[:-1] for w in p], parts[-1]


@dataclass
class Index:
    """Inverted index of item passages; impacts are BM25 shares of the passage's score for its own words.

    Both levels are sparse: a term has its postings, and the largest impact in each block of
    passages that it occurs in.
    """

    items: list = field(default_factory=list)  # (item_id, question, answer)
    owner: list = field(default_factory=list)  # passage -> item
    vocabulary: dict = field(default_factory=dict)
    starts: np.ndarray | None = None  # term -> its first posting; the postings' passages and impacts follow
    passages: np.ndarray | None = None
    impacts: np.ndarray | None = None
    block_starts: np.ndarray | None = None  # term -> its first block; the blocks and their maxima follow
    blocks: np.ndarray | None = None
    block_max: np.ndarray | None = None
    term_max: np.ndarray | None = None
    block: int = 8

    @property
    def n_blocks(self) -> int:
        return -(-len(self.owner) // self.block)


def passages_of(text: str, words: int = 64) -> tuple[list[bytes], list[bytes], list[list[bytes]]]:
    """An item's question, answer and passages of about `words` words."""
    q, a = question_and_answer(text)
    both = q + a
    return q, a, [[both[i] for i in part] for part in np.array_split(np.arange(len(both)), max(1, round(len(both) / words)))] if q else []


def build_index(rows: list[tuple[int, str]], df: dict | None = None, n: int | None = None, mean: float | None = None, block: int = 8) -> Index:
    """The index of some items; df, n and mean are the counts of all items' passages, by default of these."""
    index, passages = Index(block=block), []
    for item_id, text in sorted(rows):
        q, a, parts = passages_of(text)
        if parts:
            index.items.append((item_id, q, a))
            passages += parts
            index.owner += [len(index.items) - 1] * len(parts)
    df = Counter(t for p in passages for t in set(p)) if df is None else df
    n = len(passages) if n is None else n
    mean = sum(map(len, passages)) / max(1, len(passages)) if mean is None else mean
    index.vocabulary = {t: i for i, t in enumerate(sorted({t for p in passages for t in p}))}
    term, at, impact = [], [], []
    for k, p in enumerate(passages):
        raw = {t: math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * m * (K1 + 1) / (m + K1 * (1 - B + B * len(p) / mean)) for t, m in Counter(p).items()}
        own = sum(raw.values())
        term += [index.vocabulary[t] for t in raw]
        at += [k] * len(raw)
        impact += [x / own for x in raw.values()]
    term, at, impact = np.array(term, np.int64), np.array(at, np.int64), np.array(impact)
    order = np.lexsort((at, term))
    term, index.passages, index.impacts = term[order], at[order], impact[order]
    index.starts = np.searchsorted(term, np.arange(len(index.vocabulary) + 1))
    first = np.flatnonzero(np.diff(term * (index.n_blocks + 1) + index.passages // block, prepend=-1))
    index.blocks = index.passages[first] // block
    index.block_max = np.maximum.reduceat(index.impacts, first) if len(first) else np.zeros(0)
    index.block_starts = np.searchsorted(term[first], np.arange(len(index.vocabulary) + 1))
    index.term_max = np.maximum.reduceat(index.impacts, index.starts[:-1]) if len(first) else np.zeros(0)
    return index


def _shingles(words: list[bytes], n: int) -> set[tuple]:
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


def overlap(part: list[bytes], region: list[bytes], n: int = 3) -> float:
    """Share of the part's word n-grams found in the region; 1 for an empty part."""
    if not part:
        return 1.0
    n = min(n, len(part))
    own = _shingles(part, n)
    return len(own & _shingles(region, n)) / len(own)


def _expand(starts: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the runs starts[i]:starts[i + 1] for each i of at, end to end, and each place's number in at."""
    first = starts[at]
    size = starts[at + 1] - first
    ends = np.cumsum(size)
    return np.repeat(first - ends + size, size) + np.arange(ends[-1] if len(ends) else 0), np.repeat(np.arange(len(at)), size)


def windows_of(terms_: np.ndarray, doc: np.ndarray, none: int, window: int, stride: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(window, term) of the distinct known terms of every window, and each window's document and first word.

    doc is ascending; a document of n words has a window at every `stride` until one reaches its end.
    """
    docs, begin, size = np.unique(doc, return_index=True, return_counts=True)
    cells, per = -(-size // stride), window // stride
    n_windows = np.maximum(1, cells - per + 1)
    first = np.concatenate(([0], np.cumsum(n_windows)))
    place = np.flatnonzero(terms_ < none)
    own = np.searchsorted(docs, doc[place])
    cell = (place - begin[own]) // stride
    keys = []
    for k in range(per):
        w = cell - k
        inside = (w >= 0) & (w < n_windows[own])
        keys.append((first[own] + w)[inside] * none + terms_[place][inside])
    pairs = np.unique(np.concatenate(keys))
    owner = np.repeat(np.arange(len(docs)), n_windows)
    return pairs // none, pairs % none, docs[owner], (np.arange(first[-1]) - first[owner]) * stride


def retrieve(index: Index, win: np.ndarray, term: np.ndarray, threshold: float, room: int = 4_000_000) -> Iterator[tuple[int, int, float]]:
    """(window, passage, BM25 share) of every pair that reaches the threshold: block-max WAND, many windows at a time.

    A window is passed over if its terms' largest impacts together miss the threshold, a block of
    passages if its block maxima do; postings are read for the blocks that are left only. `room`
    bounds the cells and the postings held at once.
    """
    low, none = threshold - 1e-9, len(index.term_max)
    if not len(win) or not none:
        return
    edge = np.flatnonzero(np.diff(win, prepend=-1))
    keep = np.repeat(np.add.reduceat(index.term_max[term], edge) >= low, np.diff(edge, append=len(win)))
    win, term = win[keep], term[keep]
    edge = np.flatnonzero(np.diff(win, prepend=-1))
    nb, np_ = index.n_blocks, len(index.owner)
    work = np.cumsum(np.add.reduceat(index.starts[term + 1] - index.starts[term], edge) + np_) if len(edge) else np.zeros(0)
    a = 0
    while a < len(edge):
        b = max(a + 1, int(np.searchsorted(work, (work[a - 1] if a else 0) + room, side="right")))
        part = slice(edge[a], edge[b] if b < len(edge) else len(win))
        names, local = np.unique(win[part], return_inverse=True)
        own = term[part]
        at, k = _expand(index.block_starts, own)
        upper = np.bincount(local[k] * nb + index.blocks[at], weights=index.block_max[at], minlength=len(names) * nb)
        live = upper.reshape(-1, nb) >= low
        some = live.any(axis=1)[local]
        local, own = local[some], own[some]
        at, k = _expand(index.starts, own)
        row = local[k]
        open_ = live[row, index.passages[at] // index.block]
        at, row = at[open_], row[open_]
        scores = np.bincount(row * np_ + index.passages[at], weights=index.impacts[at])
        for x in np.flatnonzero(scores >= low).tolist():
            yield int(names[x // np_]), x % np_, float(scores[x])
        a = b


def leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.5, least: float = 0.5, window: int = 96, stride: int = 48, shard_words: int = 400_000) -> DataFrame:
    """LEAKS: one row for each document row and benchmark item whose text it holds.

    Every window of `window` words (each `stride`, which divides it) of every document is a query against all items;
    a passage is retrieved if its BM25 score is at least `threshold` of what its own words score, and
    kept if a share of `least` of the question's word 3-grams and of the answer's (an item's last
    sentence) stand near the window; an item of one sentence has no answer to find. Items are indexed
    in shards of about `shard_words` words, built in tasks with the counts of all items, which bounds
    the broadcast (one longer item is a shard of its own); each shard is one pass over docs. There is
    no shuffle of docs. Null or empty texts and items match nothing; an empty benchmark gives no
    rows. Repeated rows give the same rows each, different texts under one item_id are items of
    their own. row_key tells rows apart where doc_id is null or repeated.
    """
    rows = docs.select(F.col("doc_id").cast("long"), row_key().alias("row_key"), text_or_empty().alias("text"))
    found = None
    for index in indexes(benchmark, shard_words):
        part = _pass(rows, index, threshold, least, window, stride)
        found = part if found is None else found.unionByName(part)
    return docs.sparkSession.createDataFrame([], LEAKS) if found is None else found


def indexes(benchmark: DataFrame, shard_words: int) -> Iterator[bytes]:
    """The pickled index of each shard of items, one at a time."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shard, term, words, n = [], [], [], []
            for s, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for p in passages_of(text)[2]:
                    own = set(p)
                    shard += [s] * len(own)
                    term += own
                    words += [len(p), *[0] * (len(own) - 1)]
                    n += [1, *[0] * (len(own) - 1)]
            yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), pa.array(term, pa.binary()), pa.array(words, pa.int64()), pa.array(n, pa.int64())], ["shard", "term", "words", "n"])

    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long"), F.col("text").cast("string")).dropDuplicates()
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    items = items.withColumn("shard", F.pmod(F.xxhash64("item_id", "text"), F.lit(max(1, -(-size // (6 * shard_words))))).cast("int"))
    items = materialize(items, "items")
    seen = materialize(items.select("shard", "text").mapInArrow(count, "shard int, term binary, words long, n long"), "item_terms")
    words, n = seen.agg(F.sum("words"), F.sum("n")).first()
    if not n:
        return
    df = seen.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    by_shard = seen.select("shard", "term").distinct().join(df, "term")

    def build(key, texts: pd.DataFrame, terms_: pd.DataFrame) -> pd.DataFrame:
        known = dict(zip(map(bytes, terms_["term"]), terms_["df"], strict=True))
        index = build_index(list(zip(texts["item_id"], texts["text"], strict=True)), known, n, words / n)
        return pd.DataFrame({"shard": [key[0]], "made": [pickle.dumps(index)]})

    made = materialize(items.groupBy("shard").cogroup(by_shard.groupBy("shard")).applyInPandas(build, "shard int, made binary"), "item_indexes")
    for row in made.select("shard").orderBy("shard").collect():
        yield bytes(made.where(F.col("shard") == row["shard"]).first()["made"])


def _pass(rows: DataFrame, index: bytes, threshold: float, least: float, window: int, stride: int) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix: Index = pickle.loads(shared.value)
        none, known = len(ix.vocabulary), {}
        for batch in batches:
            ids, keys, texts = (c.to_pylist() for c in batch.columns)
            for a, b in slices(texts):
                if len(known) > 500_000:
                    known.clear()
                raw = [t.encode().lower().split() for t in texts[a:b]]
                for w in {w for ws in raw for w in ws}.difference(known):
                    known[w] = ix.vocabulary.get(w.strip(EDGE), none)
                n = [len(ws) for ws in raw]
                words = np.fromiter((known[w] for ws in raw for w in ws), np.int64, sum(n))
                if not len(words):
                    continue
                win, term, doc, start = windows_of(words, np.repeat(np.arange(b - a), n), none, window, stride)
                best: dict[tuple, tuple] = {}
                for w, passage, score in retrieve(ix, win, term, threshold):
                    d, s, item = int(doc[w]), int(start[w]), ix.owner[passage]
                    _, q, an = ix.items[item]
                    wide = len(q) + len(an)
                    region = _Names(raw[d])[max(0, s - wide) : s + window + wide]
                    both = overlap(q, region), overlap(an, region)
                    if min(both) >= least and ((d, item) not in best or (score, -s) > (best[d, item][1], -best[d, item][0])):
                        best[d, item] = (s, score, *both)
                if best:
                    out = [(ids[a + d], keys[a + d], ix.items[item][0], *x) for (d, item), x in sorted(best.items())]
                    kinds = [pa.int64()] * 4 + [pa.float64()] * 3
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], [f.split()[0] for f in LEAKS.split(", ")])

    return rows.mapInArrow(run, LEAKS)


class _Names:
    """The words of a document, without outer punctuation, cut out on demand."""

    def __init__(self, raw: list[bytes]):
        self.raw = raw

    def __getitem__(self, where: slice) -> list[bytes]:
        return [w for w in (x.strip(EDGE) for x in self.raw[where]) if w]


def remove_leaks(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """docs without the rows that hold a benchmark item; columns as they are."""
    return rows_by_key(docs, leaks(docs, benchmark, **options).select("row_key").distinct(), "left_anti")
