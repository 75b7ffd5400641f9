"""What the language model's features see of a text."""

import numpy as np
import pyarrow as pa
import xxhash

from examlake.llm import language_model as lm
from examlake.llm.common import words_of


def test_features_reach_three_words_back():
    leaf = np.array([5, 6, 7, 8, 9], np.int64)
    in_class, in_leaf = lm.Model.rows(leaf, np.zeros(5, np.int64))
    for back, classes, leaves in ((1, {0, 3}, {0}), (2, {1, 3}, {1}), (3, {2}, set())):
        other = leaf.copy()
        other[4 - back] = 1000
        a, b = lm.Model.rows(other, np.zeros(5, np.int64))
        assert set(np.flatnonzero(a[:, 4] != in_class[:, 4])) == classes
        assert set(np.flatnonzero(b[:, 4] != in_leaf[:, 4])) == leaves


def test_words_with_a_leaf_of_their_own():
    assert (lm.FREQUENT, lm.LEAVES) == (2048, 4096)


def test_sizes_follow_the_vocabulary():
    sizes = [(s.leaves, s.rows[0]) for s in map(lm.shape_for, (0, 1 << 16, 1 << 18, 1 << 20, 1 << 22))]
    assert sizes == [(1 << 12, 1 << 13), (1 << 12, 1 << 13), (1 << 14, 1 << 13), (1 << 16, 1 << 13), (1 << 18, 1 << 15)]
    top = lm.shape_for(1 << 40)
    assert sum(4 * r * w for r, w in zip(top.rows, top.widths, strict=True)) < 85e6


def test_three_softmaxes_are_one_distribution():
    shape = lm.shape_for(1 << 17)
    assert len({lm.nth_leaf(i, shape) for i in range(shape.leaves)}) == shape.leaves == 8192
    rng = np.random.default_rng(3)
    model = lm.Model(rng.integers(0, 50, shape.leaves), shape)
    for w in model.w:
        w += rng.normal(size=w.shape).astype(np.float32)
    leaf = np.tile(np.array([[5], [6], [7], [0]]), shape.leaves)
    leaf[3] = np.arange(shape.leaves)
    doc = np.repeat(np.arange(shape.leaves), 4)
    last = model.log10(leaf.T.ravel(), doc)[3::4]
    assert abs((10**last).sum() - 1) < 1e-4


def test_vocabulary_of_many_words(spark):
    rows = [(i, " ".join(f"w{k}x" for k in range(i % 2 * 70_000, 140_000))) for i in range(4)]
    counts = lm.word_counts(spark.createDataFrame(rows, "doc_id long, text string")).cache()
    v = lm.build_vocabulary(counts, 4_000_000)
    assert v.shape.leaves == 16384 and len(v.frequent) == 8192 and v.leaf_mass.sum() == v.tokens + v.types


def test_rows_are_summed_by_runs():
    rng = np.random.default_rng(1)
    rows, values = rng.zipf(1.3, 3000) % 500, rng.random((3000, 8), np.float32)
    got, want = np.zeros((500, 8), np.float32), np.zeros((500, 8))
    lm.add_rows(got, values, rows)
    np.add.at(want, rows, values)
    assert np.allclose(got, want, atol=1e-3)


def test_gradient_is_observed_minus_expected():
    rng = np.random.default_rng(2)
    leaf, doc = rng.integers(0, lm.LEAST.leaves, 300), np.repeat([0, 1], 150)
    model = lm.Model(rng.integers(0, 50, lm.LEAST.leaves))
    for w in model.w:
        w += rng.normal(size=w.shape).astype(np.float32) * 0.3
    rows, gradient = lm.Model.rows(leaf, doc), lm.Gradient(model)
    gradient.add(leaf, rows)
    k, row, branch = 1, int(rows[1][0, 7]), int(leaf[7] % lm.WIDTH)
    log = lambda: model.log10(leaf, doc).sum() * np.log(10)
    eps = np.float32(0.05)
    model.w[k][row, branch] += eps
    up = log()
    model.w[k][row, branch] -= 2 * eps
    slope = (up - log()) / (2 * float(eps))
    assert abs(slope - (gradient.observed[k][row, branch] - gradient.expected[k][row, branch])) < 1e-2


def test_scores_do_not_depend_on_partitions(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    one, many = ({r["doc_id"]: r for r in lm.scores(docs.repartition(n)).collect()} for n in (1, 13))
    for i, r in one.items():
        assert abs(r["score"] - many[i]["score"]) < 1e-4 * max(1, abs(r["score"])), i
    held = [r for r in one.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held) + 0.1 * sum(r["n_tokens"] for r in held)


def test_words_share_their_leaf(spark, sf):
    """Each leaf's words, and one unknown word, share its probability, so all words and leaves make up 1."""
    counts = lm.word_counts(spark.read.parquet(f"{sf}/documents.parquet")).cache()
    v = lm.build_vocabulary(counts, 4_000_000)
    mass, tails = np.zeros(v.shape.leaves), {}
    for r in counts.collect():
        mass[lm.leaf_of(r["word"].encode(), v.frequent, tails, v.shape)] += (r["c"] + 1) / (v.leaf_mass[lm.leaf_of(r["word"].encode(), v.frequent, tails, v.shape)] + 1)
    assert np.allclose(mass + 1 / (v.leaf_mass + 1), 1)


def test_first_gradient_needs_no_softmax():
    rng = np.random.default_rng(4)
    shape = lm.shape_for(1 << 17)
    leaf, doc = rng.zipf(1.2, 2000) % shape.leaves, np.repeat(np.arange(20), 100)
    model = lm.Model(rng.integers(0, 50, shape.leaves), shape)
    rows, plain = lm.Model.rows(leaf, doc, shape), lm.Gradient(model)
    plain.fresh = False
    quick = lm.Gradient(model)
    assert quick.fresh
    for g in (plain, quick):
        g.add(leaf, rows)
        g.finish()
    for a, b in zip(plain.expected + plain.observed, quick.expected + quick.observed, strict=True):
        assert np.allclose(a, b, atol=1e-3)


def test_words_by_arrow_are_those_of_the_texts():
    texts = [" a  b ", "", "  ", "a\x1cB\x85c\xa0d\x0be\x0cf\x00g", "\n", "ÄB\tb a\r\n", "x" * 70 + " B", "\x1f \v"]
    for part in (texts, texts[:1], texts[1:3], ["b", "a b"], []):
        for kind in (pa.string(), pa.large_string()):
            words, code, sizes = lm.words_in(pa.array(part, kind))
            found = [w.encode() for w in words.take(pa.array(code)).to_pylist()]
            assert found == [w for t in part for w in words_of(t)] and sizes.tolist() == [len(words_of(t)) for t in part]


def test_tokens_of_a_slice():
    frequent = {b"a": 3, lm.END: 5}
    h = np.array([xxhash.xxh64_intdigest(w, 42) for w in (b"a", b"zebra")], np.uint64)
    order = np.argsort(h)
    v = lm.Vocabulary(9, 2, frequent, np.zeros(lm.LEAVES, np.int64), h[order], np.array([7, 2])[order], True)
    leaf, count, sizes = lm.Encoder(v).encode(pa.array(["A zebra", "", " a"]))
    assert sizes.tolist() == [3, 1, 2] and count.tolist() == [7, 2, 0, 0, 7, 0]
    assert leaf.tolist() == [3, lm.leaf_of(b"zebra", frequent, {}, v.shape), 5, 5, 3, 5]


def test_stretches_have_the_rows_of_the_whole():
    rng = np.random.default_rng(5)
    shape = lm.shape_for(1 << 22)
    leaf, doc = rng.integers(0, shape.leaves, 100), np.sort(rng.integers(0, 9, 100))
    whole = lm.Model.rows(leaf, doc, shape)
    for size in (1, 2, 7, 200):
        parts = list(lm.Model.blocks(leaf, doc, shape, size))
        assert np.array_equal(np.concatenate([p for p, _ in parts]), leaf)
        for k, want in enumerate(whole):
            assert np.array_equal(np.concatenate([r[k] for _, r in parts], axis=1), want)


def test_a_token_meets_few_branches():
    """Work per token: branches over all softmaxes, which were 192 for the largest model."""
    for types in (1 << 17, 1 << 18, 1 << 19, 1 << 20, 1 << 22, 1 << 40):
        shape = lm.shape_for(types)
        assert sum(shape.widths) <= 112 and all(r & (r - 1) == 0 for r in shape.rows)
        assert shape.leaves == min(1 << 18, types // 16)
