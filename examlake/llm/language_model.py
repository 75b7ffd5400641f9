"""Language-model scoring by a hashed maximum-entropy model (operator 6)."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from examlake.llm.common import materialize, row_key, slices, text_or_empty, words_of

END = b""  # words are never empty
WIDTH = 64  # classes, and leaves in a class, of the smallest model
NARROW = 16  # branches of a softmax of larger ones
LEAVES = WIDTH * WIDTH  # at least
FREQUENT = LEAVES // 2  # words with a leaf of their own, at least; the rest share leaves by their ending
STEP = 16384  # tokens in a numpy batch
MOST_WEIGHT = np.float32(8)
SCORES = "doc_id long, row_key long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


@dataclass(frozen=True)
class Shape:
    """Sizes of a model: the softmaxes' widths and their rows of weights."""

    widths: tuple
    rows: tuple

    @property
    def leaves(self) -> int:
        return int(np.prod(self.widths))

    def branches(self, k: int) -> int:
        """Branches that lead to softmax k."""
        return int(np.prod(self.widths[:k], dtype=np.int64))

    def features(self, k: int) -> int:
        """Rows of weights of a token at softmax k: four at the first two, two at others and at the last."""
        return 4 if k < min(2, len(self.widths) - 1) else 2

    def below(self, k: int) -> int:
        """Leaves under one branch of softmax k."""
        return int(np.prod(self.widths[k + 1 :], dtype=np.int64))


def shape_for(types: int) -> Shape:
    """Powers of two by the counted types V: a leaf for each 16 types, a first row for each 128.

    4,096 to 262,144 leaves, half of them for one frequent word each; 8,192 to 65,536 rows of the first
    softmax. With 4,096 leaves there are two softmaxes of 64, the second of twice the rows. More leaves lie
    below softmaxes of 16, the first one taking what is over (8 to 64), each of eight times the first's
    rows, 262,144 at most and twice that for the second. So weights take 84 MB at most, and a training task
    holds three times that (weights, observed and expected counts).
    """
    power = lambda x: 1 << max(0, x - 1).bit_length()
    more = min(WIDTH, power(-(-types // (16 * LEAVES))))
    rows = min(1 << 16, max(1 << 13, power(-(-types // 128))))
    if more == 1:
        return Shape((WIDTH, WIDTH), (rows, 2 * rows))
    widths = (more, NARROW, NARROW, NARROW) if more > 4 else (more * NARROW, NARROW, NARROW)
    later = min(1 << 18, 8 * rows)
    return Shape(widths, (rows, min(1 << 19, 8 * rows)) + (later,) * (len(widths) - 2))


LEAST = shape_for(0)


@dataclass
class Vocabulary:
    """What tasks get of the training counts; beyond the size limit, `digests` and `counts` are empty and `known` holds frequent words' counts."""

    tokens: int  # N
    types: int  # V
    frequent: dict  # word -> leaf, for half of the leaves
    leaf_mass: np.ndarray  # sum of count + 1 over a leaf's words
    digests: np.ndarray  # sorted XXH64 of all words
    counts: np.ndarray
    whole: bool
    shape: Shape = LEAST
    known: dict = field(default_factory=dict)


def held_out():
    """crc32 of the doc_id as text, mod 7, is 2; a null doc_id is not held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False))


def words_in(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The words of `words_of`, by Arrow: different ones, every word's place among them, and how many words each text has."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    coded = lists.flatten().dictionary_encode()
    code, sizes = coded.indices.to_numpy(), pc.list_value_length(lists).to_numpy()
    blank = np.flatnonzero(pc.binary_length(coded.dictionary).to_numpy() == 0)  # white space at an end leaves an empty word there
    if len(blank):
        kept = code != blank[0]
        sizes = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[kept], minlength=len(sizes))
        code = code[kept]
    return coded.dictionary, code, sizes


def word_counts(docs: DataFrame) -> DataFrame:
    """word, c over all texts of docs, each with one end token (the empty word); summed in slices of tasks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(0).to_pylist(), 8_000_000):
                words, code, _ = words_in(batch.column(0)[a:b])
                n = np.bincount(code, minlength=len(words))
                used = np.flatnonzero(n)
                words = pa.concat_arrays([words.take(pa.array(used)).cast(pa.string()), pa.array([END.decode()])])
                yield pa.RecordBatch.from_arrays([words, pa.array(np.append(n[used], b - a), pa.int64())], ["word", "c"])

    return docs.select(text_or_empty().alias("text")).mapInArrow(run, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


def nth_leaf(i: int, shape: Shape) -> int:
    """The i-th leaf to be given out: the first 4,096 differ in the first two softmaxes already."""
    return i % LEAVES * (shape.leaves // LEAVES) + i // LEAVES


def leaf_of(word: bytes, frequent: dict, tails: dict, shape: Shape) -> int:
    """A frequent word's own leaf, else that of its last three characters; `tails` remembers those."""
    found = frequent.get(word)
    if found is None:
        tail = word[-3:] if word.isascii() else word.decode()[-3:].encode()
        found = tails.get(tail)
        if found is None:
            own = shape.leaves // 2
            found = tails[tail] = nth_leaf(own + xxhash.xxh64_intdigest(tail, 42) % own, shape)
    return found


def build_vocabulary(counts: DataFrame, limit: int) -> Vocabulary:
    """counts: the written word counts. More than `limit` types stay in the table (see `scores`)."""
    n, v, h = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1)), F.countDistinct(F.xxhash64("word"))).first()
    shape = shape_for(v)
    top = counts.orderBy(F.desc("c"), "word").limit(shape.leaves // 2).toArrow()
    often = [w.encode() for w in top.column("word").to_pylist()]
    frequent = {w: nth_leaf(i, shape) for i, w in enumerate(often)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mass, tails = np.zeros(shape.leaves, np.int64), {}
        for batch in batches:
            leaves = [leaf_of(w.encode(), frequent, tails, shape) for w in batch.column(0).to_pylist()]
            mass += np.bincount(leaves, weights=batch.column(1).to_numpy() + 1, minlength=shape.leaves).astype(np.int64)
        some = np.flatnonzero(mass)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(mass[some])], ["leaf", "mass"])

    leaf_mass = np.zeros(shape.leaves, np.int64)
    found = counts.mapInArrow(run, "leaf long, mass long").groupBy("leaf").agg(F.sum("mass").alias("mass")).toArrow()
    leaf_mass[found.column("leaf").to_numpy()] = found.column("mass").to_numpy()
    whole = v <= limit and h == v  # equal digests of two words: keep to the table
    digests, values = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if whole and v:
        got = counts.select(F.xxhash64("word").alias("h"), "c").toArrow()
        digests, values = got.column("h").to_numpy().view(np.uint64), got.column("c").to_numpy()
        order = np.argsort(digests)
        digests, values = digests[order], values[order].astype(np.int64)
    known = {} if whole else dict(zip(often, top.column("c").to_pylist(), strict=True))
    return Vocabulary(int(n), int(v), frequent, leaf_mass, digests, values, whole, shape, known)


class Encoder:
    """Texts to leaves and training counts of their tokens; each different word of a slice is looked up once."""

    def __init__(self, vocabulary: Vocabulary, most: int = 400_000):
        self.v, self.most = vocabulary, most
        self.tails: dict[bytes, int] = {}

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(leaf, count) of every token, the end tokens included, and how many tokens each text has."""
        different, code, sizes = words_in(texts)
        words = [*(w.encode() for w in different.to_pylist()), END]
        if len(self.tails) > self.most:
            self.tails.clear()
        leaves = np.array([leaf_of(w, self.v.frequent, self.tails, self.v.shape) for w in words], np.int64)
        counts = np.zeros(len(words), np.int64)
        if len(self.v.digests):
            h = np.array([xxhash.xxh64_intdigest(w, 42) for w in words], np.uint64)
            at = np.minimum(np.searchsorted(self.v.digests, h), len(self.v.digests) - 1)
            counts = np.where(self.v.digests[at] == h, self.v.counts[at], 0)
        elif self.v.known:
            counts = np.array([self.v.known.get(w, 0) for w in words], np.int64)
        sizes = sizes + 1
        at = np.full(int(sizes.sum()), len(words) - 1)
        inside = np.ones(len(at), bool)
        inside[np.cumsum(sizes) - 1] = False
        at[inside] = code
        return leaves[at], counts[at], sizes


class Model:
    """P(leaf | history) is a product of softmaxes, each of which chooses among the branches below the last one's.

    Features, all hashed to rows of weights: the last word (n-gram), the last two (n-gram), the one before
    the last and the one before that (skips); lower softmaxes take the last word and the one before only
    (see `Shape.features`). But for the first, the rows also depend on the branch taken so far. Log shares
    of the leaves' counts stand in as fixed biases, so a model without weights is the base model over leaves.
    """

    def __init__(self, leaf_mass: np.ndarray, shape: Shape = LEAST):
        self.shape, self.bias = shape, []
        for k, width in enumerate(shape.widths):
            mass = (leaf_mass + 1.0).reshape(-1, width, shape.below(k)).sum(axis=2)
            self.bias.append(np.log(mass / mass.sum(axis=1, keepdims=True)).astype(np.float32))
        self.w = [np.zeros(size, np.float32) for size in zip(shape.rows, shape.widths, strict=True)]

    @staticmethod
    def rows(leaf: np.ndarray, doc: np.ndarray, shape: Shape = LEAST) -> list[np.ndarray]:
        """Weight rows of each token: [feature, token] for each softmax."""
        past = []
        for k in (1, 2, 3):
            p = np.full(len(leaf), shape.leaves, np.uint64)  # the leaf that stands before a text
            if len(leaf) > k:
                same = doc[k:] == doc[:-k]
                p[k:][same] = leaf[:-k][same].astype(np.uint64)
            past.append(p)
        one, two, three = past
        mix = lambda x, kind: (x * np.uint64(8) + np.uint64(kind)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)
        pair = one * np.uint64(shape.leaves + 1) + two
        out = [np.stack([mix(one, 0), mix(two, 1), mix(three, 2), mix(pair, 3)])]
        for k in range(1, len(shape.widths)):
            own, branches = (leaf // shape.below(k - 1)).astype(np.uint64), np.uint64(shape.branches(k))
            out.append(np.stack([mix(x * branches + own, 4 + i) for i, x in enumerate((one, two, three, pair)[: shape.features(k)])]))
        return [(x & np.uint64(n - 1)).view(np.int64) for x, n in zip(out, shape.rows, strict=True)]

    @staticmethod
    def blocks(leaf: np.ndarray, doc: np.ndarray, shape: Shape, size: int = STEP) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
        """Stretches of `size` tokens and their rows, which see the three tokens before the stretch too."""
        for a in range(0, len(leaf), size):
            back = min(a, 3)
            near = slice(a - back, a + size)
            yield leaf[a : a + size], [x[:, back:] for x in Model.rows(leaf[near], doc[near], shape)]

    def targets(self, leaf: np.ndarray) -> list[np.ndarray]:
        """The branch that each softmax is to choose."""
        return [leaf // self.shape.below(k) % width for k, width in enumerate(self.shape.widths)]

    def logits(self, k: int, leaf: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """[token, branch] of softmax k. Weights stay within MOST_WEIGHT, so their exp needs no shift."""
        out = np.take(self.w[k], rows[0], axis=0)
        for r in rows[1:]:
            out += np.take(self.w[k], r, axis=0)
        bias = self.bias[k]
        out += bias[0] if len(bias) == 1 else np.take(bias, leaf // (self.shape.below(k) * self.shape.widths[k]), axis=0)
        return out

    def probabilities(self, k: int, leaf: np.ndarray, rows: np.ndarray) -> np.ndarray:
        out = self.logits(k, leaf, rows)
        np.exp(out, out=out)
        out /= (out @ np.ones(out.shape[1], np.float32))[:, None]
        return out

    def log10(self, leaf: np.ndarray, doc: np.ndarray, block: int = STEP) -> np.ndarray:
        """log10 P(leaf | history) of every token."""
        out, a = np.zeros(len(leaf)), 0
        for part, rows in self.blocks(leaf, doc, self.shape, block):
            at, b = np.arange(len(part)), a + len(part)
            for k, target in enumerate(self.targets(part)):
                logits = self.logits(k, part, rows[k])
                chosen = logits[at, target].astype(float)
                np.exp(logits, out=logits)
                out[a:b] += chosen - np.log(logits @ np.ones(logits.shape[1], np.float32))
            a = b
        return out / np.log(10)


def add_rows(total: np.ndarray, values: np.ndarray, rows: np.ndarray) -> None:
    """total[rows[i]] += values[i], two neighbouring 32-bit floats at a time as one complex number."""
    pairs = total.shape[1] // 2
    at = (rows * pairs)[:, None] + np.arange(pairs)
    np.add.at(total.view(np.complex64).reshape(-1), at.reshape(-1), values.view(np.complex64).reshape(-1))


class Gradient:
    """Observed and expected counts of every (row, branch) under one model: the two parts of its gradient.

    While no weight is set, a token's probabilities are the biases of its branch, so expected counts
    follow from how often each row meets each branch, without a softmax for each token.
    """

    def __init__(self, model: Model):
        self.model, self.fresh = model, not any(w.any() for w in model.w)
        self.observed = [np.zeros_like(w) for w in model.w]
        self.expected = [np.zeros_like(w) for w in model.w]
        self.met = np.zeros(len(model.w[0]), np.int64)  # uses of the class rows while fresh

    def add(self, leaf: np.ndarray, rows: list) -> None:
        for k, target in enumerate(self.model.targets(leaf)):
            width, bias = self.model.shape.widths[k], self.model.bias[k]
            probs = None if self.fresh else self.model.probabilities(k, leaf, rows[k])
            own = leaf // (self.model.shape.below(k) * width)
            for r in rows[k]:
                np.add.at(self.observed[k].reshape(-1), r * width + target, np.float32(1))
                if self.fresh and k == 0:  # one branch: every row expects the same shares
                    self.met += np.bincount(r, minlength=len(self.met))
                elif self.fresh:
                    pairs = np.sort((r * len(bias) + own).astype(np.uint32))
                    at = np.flatnonzero(np.diff(pairs, prepend=-1)) if len(pairs) else np.zeros(0, np.int64)
                    n = np.diff(at, append=len(pairs)).astype(np.float32)
                    met = pairs[at].astype(np.int64)
                    add_rows(self.expected[k], n[:, None] * np.exp(bias[met % len(bias)]), met // len(bias))
                else:
                    add_rows(self.expected[k], probs, r)

    def finish(self) -> None:
        self.expected[0] += self.met[:, None] * np.exp(self.model.bias[0][0])
        self.met[:] = 0

    def blocks(self, size: int = 32_768) -> Iterator[tuple[int, int, bytes, bytes]]:
        """(softmax, first row, observed, expected) of each block of about `size` weights that was used; see `packed`."""
        self.finish()
        for k, (o, e) in enumerate(zip(self.observed, self.expected, strict=True)):
            n = size // o.shape[1]
            for a in range(0, len(o), n):
                if o[a : a + n].any():
                    yield k, a, packed(o[a : a + n]), packed(e[a : a + n])


def packed(counts: np.ndarray) -> bytes:
    """Counts as 16-bit floats of their roots, to about one part in 2,000 from 4e-9 to 4e9."""
    return np.sqrt(counts).astype(np.float16).tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.float16).astype(np.float64) ** 2


def step(observed: np.ndarray, expected: np.ndarray, features: int, prior: float) -> np.ndarray:
    """Iterative scaling: each of a token's `features` weights takes its share of log(observed / expected)."""
    return (np.log((observed + prior) / (expected + prior)) / features).astype(np.float32)


def encode(rows: DataFrame, shared) -> DataFrame:
    """Each text's leaves as bytes, and what its counts give, so that words are looked up once."""
    schema = "doc_id long, row_key long, held_out boolean, n_tokens long, n_known long, own double, leaves binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        code = leaf_code(shared.value.shape)
        for batch in batches:
            for a, b in slices(batch.column(3).to_pylist(), 4_000_000):
                leaf, c, sizes = encoder.encode(batch.column(3)[a:b])
                ends, doc = np.cumsum(sizes), np.repeat(np.arange(b - a), sizes)
                packed = [x.tobytes() for x in np.split(leaf.astype(code), ends[:-1])]
                known, own = (np.bincount(doc, weights=x, minlength=b - a) for x in (c > 0, np.log10(c + 1.0)))
                yield pa.RecordBatch.from_arrays([*(x[a:b] for x in batch.columns[:3]), pa.array(sizes.astype(np.int64)), pa.array(known.astype(np.int64)), pa.array(own), pa.array(packed, pa.binary())], [f.split()[0] for f in schema.split(", ")])

    return rows.select("doc_id", row_key().alias("row_key"), "held_out", "text").mapInArrow(run, schema)


def leaf_code(shape: Shape) -> np.dtype:
    return np.dtype("<u2" if shape.leaves <= 1 << 16 else "<u4")


def _joined(column: pa.Array, code: np.dtype, most: int = 500_000) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, leaves, text number) of stretches of a column of packed texts."""
    packed = column.to_pylist()
    sizes = np.array([len(x) // code.itemsize for x in packed])
    for a, b in slices(packed, code.itemsize * most):
        yield a, b, np.frombuffer(b"".join(packed[a:b]), code).astype(np.int64), np.repeat(np.arange(b - a), sizes[a:b])


def train_round(coded: DataFrame, model: Model, tokens: int, prior: float = 2.0) -> None:
    """One distributed gradient update over encoded texts of about `tokens` tokens; changes `model`.

    Tasks sum observed and expected counts under the shared weights, other tasks add them by blocks
    of rows and turn them into changes of weights. So the update does not depend on how the rows are
    dealt. A task hands on as much as the model is large, so there is one for half as many tokens as
    the model has weights: what is exchanged grows with the texts and a task's work stays the same.
    """
    shared = coded.sparkSession.sparkContext.broadcast(model)
    schema, shape = "k int, first int, observed binary, expected binary", model.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gradient = Gradient(shared.value)
        for batch in batches:
            for _, _, leaf, doc in _joined(batch.column(0), leaf_code(shape)):
                for part, rows in Model.blocks(leaf, doc, shape, 8 * STEP if gradient.fresh else STEP):
                    gradient.add(part, rows)
        for k, first, observed, expected in gradient.blocks():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([first], pa.int32()), pa.array([observed], pa.binary()), pa.array([expected], pa.binary())], ["k", "first", "observed", "expected"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple, list] = {}
        for batch in batches:
            for k, first, *counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                values = [unpacked(x) for x in counts]
                total[k, first] = [a + b for a, b in zip(total[k, first], values, strict=True)] if (k, first) in total else values
        for (k, first), (observed, expected) in total.items():
            change = step(observed, expected, shape.features(k), prior)
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([first], pa.int32()), pa.array([change.tobytes()], pa.binary())], ["k", "first", "change"])

    tasks = max(1, -(-2 * tokens // sum(w.size for w in model.w)))
    counts = coded.select("leaves").coalesce(tasks).mapInArrow(run, schema)
    for r in counts.repartition(12, "k", "first").mapInArrow(add, "k int, first int, change binary").toLocalIterator(prefetchPartitions=True):
        w = model.w[r["k"]]
        change = np.frombuffer(r["change"], np.float32).reshape(-1, w.shape[1])
        part = w[r["first"] : r["first"] + len(change)]
        np.clip(part + change, -MOST_WEIGHT, MOST_WEIGHT, out=part)
    shared.destroy()


def scores(docs: DataFrame, rounds: int = 4, limit: int = 4_000_000) -> DataFrame:
    """SCORES of each row, learned from the rows that are not held out.

    Word counts cover every training text. Up to `limit` types (12 bytes each) go to the tasks as
    sorted digests, and the model's size follows the number of types (`shape_for`); beyond it words
    stay in the table and each text's rarer words are joined with it, to the same scores. Training
    takes `rounds` distributed gradient updates, each over its own part of all training texts, so
    every text is used once; how rows are dealt to tasks does not matter. A token's probability is its leaf's times
    its share (count+1) of the leaf; a word not seen counts as one more of its leaf. A null or
    empty text is one end token. With no training rows N = V = 0 and the model is uniform over
    leaves. Repeated rows are scored alike, and count as often in training.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text"), held_out().alias("held_out"))
    training = rows.where("not held_out")
    counts = materialize(word_counts(training), "words")
    vocabulary = build_vocabulary(counts, limit)
    shared = spark.sparkContext.broadcast(vocabulary)
    model = Model(vocabulary.leaf_mass, vocabulary.shape)
    coded = materialize(encode(rows, shared), "leaves")
    for k in range(rounds):
        part = coded.where("not held_out").where(F.pmod(F.xxhash64("row_key", F.lit(17)), F.lit(rounds)) == k)
        train_round(part, model, vocabulary.tokens // rounds)
    trained = spark.sparkContext.broadcast(model)
    room = np.log10(vocabulary.leaf_mass + 1.0)
    n, v = vocabulary.tokens, vocabulary.types

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, leaf, doc in _joined(batch.column(6), leaf_code(trained.value.shape)):
                score = np.bincount(doc, weights=trained.value.log10(leaf, doc) - room[leaf], minlength=b - a)
                tokens, own = batch.column(3)[a:b].to_numpy(), batch.column(5)[a:b].to_numpy()
                yield pa.RecordBatch.from_arrays([*(x[a:b] for x in batch.columns[:5]), pa.array(np.full(b - a, n, np.int64)), pa.array(own - tokens * np.log10(n + v + 1)), pa.array(score + own)], [f.split()[0] for f in SCORES.split(", ")])

    scored = coded.mapInArrow(run, SCORES)
    if vocabulary.whole or not vocabulary.types:
        return scored
    return _with_rare(scored, rows.select(row_key().alias("row_key"), "text"), counts, shared)


def _with_rare(scored: DataFrame, keyed: DataFrame, counts: DataFrame, shared) -> DataFrame:
    """Adds what rare words' counts give, by a join of each text's words with the table of counts.

    Frequent words are in the tasks' vocabulary already, so no word that is left is a hot key.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = shared.value.known
        for batch in batches:
            key, word, n = [], [], []
            for k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = {w: m for w, m in Counter(words_of(text)).items() if w not in frequent}
                key += [k] * len(own)
                word += [w.decode() for w in own]
                n += own.values()
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(word, pa.string()), pa.array(n, pa.int64())], ["k", "word", "n"])

    words = keyed.dropDuplicates(["row_key"]).mapInArrow(run, "k long, word string, n long")
    found = words.join(counts, "word").groupBy("k").agg(F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("own"), F.sum("n").alias("seen"))
    joined = scored.join(found, scored["row_key"] == found["k"], "left")
    own = F.coalesce("own", F.lit(0.0))
    return joined.select("doc_id", "row_key", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("seen", F.lit(0))).alias("n_known"), "train_tokens", (F.col("base_score") + own).alias("base_score"), (F.col("score") + own).alias("score"))
