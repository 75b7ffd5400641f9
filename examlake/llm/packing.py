"""Best-fit packing of tokenized documents (operator 8)."""

from __future__ import annotations

import gc
import json
import re
import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from examlake.llm.common import materialize, slices, text_or_empty

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = f"{PIECES}, sequence_id long, offset long"
#: Texts with other characters, or with what may be a special token, are encoded whole.
_UNUSUAL = re.compile(r"[^\t\n\r\x20-\x7e\u00a0-\u012f\u0131-\u024f]|<\|")
#: ASCII signs that are neither letters nor digits nor apostrophes.
_CLOSING = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


#: What a tokenizer must do for words' ids to be cached: fold case, part words at white space, letters, digits and signs, mark words' ends.
_NORMALIZERS = ["NFC", "Replace", "Lowercase"]
_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def caches_words(spec: dict) -> bool:
    """True for a tokenizer (its JSON) by whose rules `WordCache` may look words up; texts for any other are encoded whole."""
    steps = [n.get("type") for n in (spec.get("normalizer") or {}).get("normalizers", [])]
    parts = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    splits = [p.get("pattern", {}).get("Regex") for p in parts if p.get("type") == "Split"]
    return steps == _NORMALIZERS and splits == [_WORDS] and spec["model"].get("end_of_word_suffix") == "</w>"


class _Ragged:
    """Strings to runs of ids, the runs end to end in one array."""

    def __init__(self):
        self.at: dict[str, int] = {}
        self.starts, self.ids = np.zeros(1, np.int64), np.zeros(0, "<u4")

    def add(self, names: list[str], ids, lengths) -> None:
        self.at.update(zip(names, range(len(self.at), len(self.at) + len(names)), strict=True))
        self.starts = np.append(self.starts, self.starts[-1] + np.cumsum(np.asarray(lengths, np.int64)))
        self.ids = np.append(self.ids, np.asarray(ids, "<u4"))

    def find(self, names: list[str]) -> np.ndarray:
        """The names' numbers; -1 for an unknown one."""
        return np.fromiter(map(self.at.get, names, repeat(-1)), np.int64, len(names))

    def runs(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The numbered runs end to end, and where each begins (and the last ends)."""
        starts, lengths = self.starts[at], self.starts[at + 1] - self.starts[at]
        ends = np.concatenate(([0], np.cumsum(lengths)))
        return self.ids[np.repeat(starts - ends[:-1], lengths) + np.arange(ends[-1])], ends


class WordCache:
    """Ids of texts through bounded caches: no token spans white space, so a word's ids do not depend on its neighbours.

    Case does not matter to the tokenizer, and a run of closing signs is a token run of its own, so
    new words are cut into a stem and its closing signs. New stems are encoded together, parted by
    spaces; the marks of words' ends, or offsets, tell which ids are whose.
    """

    def __init__(self, path: str, most: int = 600_000):
        from tokenizers import Tokenizer

        self.whole, self.most = Tokenizer.from_file(path), most
        spec = json.loads(self.whole.to_str())
        self.by_words = caches_words(spec)
        if not self.by_words:
            return
        bare = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
        spec |= {"normalizer": None, "added_tokens": [], "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, bare]}}
        self.letters = Tokenizer.from_str(json.dumps(spec))
        vocab = self.whole.get_vocab()
        self.ends_word = np.zeros(max(vocab.values()) + 1, bool)
        self.ends_word[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.forget()

    def forget(self) -> None:
        self.words, self.parts = _Ragged(), _Ragged()

    def _learn_letters(self, new: list[str]) -> None:
        """Lower-case words of letters alone need no normalizing; the last id of each is marked as a word's end."""
        ids = np.array(self.letters.encode_batch_fast([" ".join(new)], add_special_tokens=False)[0].ids, "<u4")
        last = np.flatnonzero(self.ends_word[ids]) + 1
        self.parts.add(new, ids, np.diff(last, prepend=0))

    def _learn_other(self, new: list[str]) -> None:
        joined = self.whole.encode(" ".join(new), add_special_tokens=False)
        lengths = np.fromiter(map(len, new), np.int64, len(new))
        starts = np.concatenate(([0], np.cumsum(lengths[:-1] + 1)))
        at = np.fromiter((a for a, _ in joined.offsets), np.int64, len(joined.ids))
        self.parts.add(new, joined.ids, np.bincount(np.searchsorted(starts, at, side="right") - 1, minlength=len(new)))

    def _learn(self, new: list[str]) -> None:
        stems = [w.rstrip(_CLOSING) for w in new]
        stems = [s if not s or s[-1].isalnum() else w for s, w in zip(stems, new, strict=True)]
        pairs = [(s, w[len(s) :]) for s, w in zip(stems, new, strict=True)]
        flat = [p for pair in pairs for p in pair if p]
        fresh = set(flat).difference(self.parts.at)
        if letters := [p for p in fresh if p.isalpha()]:
            self._learn_letters(letters)
        if other := [p for p in fresh if not p.isalpha()]:
            self._learn_other(other)
        ids, ends = self.parts.runs(self.parts.find(flat))
        last = np.cumsum(np.fromiter(((s != "") + (t != "") for s, t in pairs), np.int64, len(pairs)))
        self.words.add(new, ids, np.diff(ends[np.concatenate(([0], last))]))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if not self.by_words:
            return [np.array(self.whole.encode(t, add_special_tokens=False).ids, "<u4") for t in texts]
        usual = [i for i, t in enumerate(texts) if not _UNUSUAL.search(t)]
        words = [texts[i].lower().split() for i in usual]
        flat = [w for ws in words for w in ws]
        if max(len(self.words.at), len(self.parts.at)) > self.most:
            self.forget()
        at = self.words.find(flat)
        missing = np.flatnonzero(at < 0)
        if len(missing):
            found = [flat[i] for i in missing.tolist()]
            self._learn(list(set(found)))
            at[missing] = self.words.find(found)
        all_ids, ends = self.words.runs(at)
        cuts = ends[np.concatenate(([0], np.cumsum([len(ws) for ws in words], dtype=np.int64)))] if words else [0]
        out: list = [None] * len(texts)
        for k, i in enumerate(usual):
            out[i] = all_ids[cuts[k] : cuts[k + 1]]
        for i, t in enumerate(texts):
            if out[i] is None:
                out[i] = np.array(self.whole.encode(t, add_special_tokens=False).ids, "<u4")
        return out


_CACHES: dict[str, WordCache] = {}


def _cache(path: str) -> WordCache:
    """One cache a Python worker, kept from task to task."""
    if path not in _CACHES:
        _CACHES.clear()
        _CACHES[path] = WordCache(path)
    return _CACHES[path]


def tokenize(docs: DataFrame, tokenizer: str, end_id: int = 1, size: int = 4096) -> DataFrame:
    """PIECES of each document: its ids and end_id, cut every `size` ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, collecting = _cache(tokenizer), gc.isenabled()
        gc.disable()  # many small lists, none in cycles
        try:
            for batch in batches:
                doc_ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                for a, b in slices(texts):
                    rows = []
                    for doc_id, ids in zip(doc_ids[a:b], cache.encode(texts[a:b]), strict=True):
                        ids = np.append(ids, np.array([end_id], "<u4")).astype("<u4")
                        for k in range(0, len(ids), size):
                            piece = ids[k : k + size]
                            rows.append((doc_id, k // size, k, len(piece), zlib.crc32(piece.tobytes())))
                    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], [f.split()[0] for f in PIECES.split(", ")])
        finally:
            if collecting:
                gc.enable()

    return docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")).mapInArrow(run, PIECES)


class OpenBins:
    """Open bins in a bitset keyed by free space: bit f is set while some bin has f places free."""

    def __init__(self, size: int, most: int):
        self.size, self.most, self.bits, self.open, self.at = size, most, 0, 0, {}

    def _take(self, free: int) -> int:
        stack = self.at[free]
        bin_id = stack.pop()
        if not stack:
            del self.at[free]
            self.bits &= ~(1 << free)
        self.open -= 1
        return bin_id

    def place(self, length: int, new_id: int) -> tuple[int, int]:
        """(bin, offset) for an item: the open bin with the least free space that fits it, else a new one."""
        above = self.bits >> length
        if above:
            free = length + (above & -above).bit_length() - 1
            bin_id = self._take(free)
        else:
            free, bin_id = self.size, new_id
            if self.open >= self.most:
                self._take((self.bits & -self.bits).bit_length() - 1)  # the fullest closes
        left = free - length
        if left:
            self.at.setdefault(left, []).append(bin_id)
            self.bits |= 1 << left
            self.open += 1
        return bin_id, self.size - free


def pack(pieces: DataFrame, size: int = 4096, open_bins: int = 4096, per_task: int = 400_000) -> DataFrame:
    """Assign pieces to sequences by bounded-space online best-fit, one independent stream a task.

    `pieces` are metadata only (about 40 bytes a piece). They are dealt by hash to one stream for
    each `per_task` pieces, in an order fixed by a hash, so that a recomputed task gives the same
    result; each stream leaves at most a few sequences part-filled. Sequence numbers hold the
    stream in their high bits.
    """
    n = pieces.count()
    key = F.xxhash64("doc_id", "piece", "ids_crc32")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        new = TaskContext.get().partitionId() << 40
        bins = OpenBins(size, open_bins)
        for batch in batches:
            seq, off = [], []
            for length in batch.column(3).to_pylist():
                bin_id, at = bins.place(length, new)
                new += bin_id == new
                seq.append(bin_id)
                off.append(at)
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(seq, pa.int64()), pa.array(off, pa.int64())], [f.split()[0] for f in PACKED.split(", ")])

    dealt = pieces.withColumn("k", key).repartition(max(1, -(-n // per_task)), "k")
    return dealt.sortWithinPartitions("k", "doc_id", "piece", "ids_crc32").drop("k").mapInArrow(run, PACKED)


def pack_documents(docs: DataFrame, tokenizer: str, size: int = 4096, end_id: int = 1, open_bins: int = 4096, per_task: int = 400_000) -> DataFrame:
    """PACKED rows of all documents.

    A null or empty text is the end id alone. Repeated rows are packed once each; a null doc_id
    stays null. An empty table gives no rows. Other columns are not read.
    """
    return pack(materialize(tokenize(docs, tokenizer, end_id, size), "pieces"), size, open_bins, per_task)
