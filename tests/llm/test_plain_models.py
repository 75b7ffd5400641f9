"""Learned operators against dense and enumerated versions on small data; bins and clashing names."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from examlake.llm import extraction, packing, quality, substring, toxicity
from examlake.llm.common import row_key

WORDS = "you are a very silly and nasty person but the weather is fine today we like to walk along rivers".split()


def _dense_train(rows, earlier, y, epochs=6, alpha=0.3, l2=0.1, seed=5):
    """Follow-the-regularized-leader over whole vectors."""
    extra = earlier.shape[1] + 1
    size = toxicity.DIM + extra
    l1 = np.where(np.arange(size) < toxicity.DIM, min(12.0, max(0.5, 0.018 * y.sum())), 0.0)
    z, n, rng = np.zeros(size), np.zeros(size), np.random.default_rng(seed)
    weigh = max(1.0, min(20.0, (len(y) - y.sum()) / max(1, y.sum()))) ** 0.5
    weights = lambda: np.where(np.abs(z) > l1, -(z - np.sign(z) * l1) / ((1 + np.sqrt(n)) / alpha + l2), 0.0)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            x = np.concatenate((np.log2(1 + np.bincount(rows[i], minlength=toxicity.DIM)), earlier[i], (1.0,)))
            w = weights()
            g = (1 / (1 + math.exp(-max(-30, min(30, w @ x)))) - y[i]) * x * (weigh if y[i] else 1)
            z += g - (np.sqrt(n + g * g) - np.sqrt(n)) / alpha * w
            n += g * g
    return weights()


def _examples(k):
    rng = np.random.default_rng(k)
    texts = [" ".join(rng.choice(WORDS[:8] if i % 3 == 0 else WORDS[8:], 6)) for i in range(k)]
    return texts, np.array([float(i % 3 == 0) for i in range(k)])


def test_chain_against_dense_models(spark):
    """Weights, out-of-fold probabilities and thresholds of both models of a chain."""
    texts, toxic = _examples(18)
    low = np.array([float(i % 2) for i in range(18)])
    df = spark.createDataFrame([(i, t, int(a), int(b)) for i, (t, a, b) in enumerate(zip(texts, low, toxic))], "doc_id long, text string, low_quality int, toxic int")
    models = toxicity.fit_chain(df, ("low_quality", "toxic"), folds=3)
    keys = {r.doc_id: r.k for r in df.select("doc_id", F.xxhash64("doc_id", "text").alias("k")).collect()}
    order = sorted(range(18), key=keys.get)
    rows, earlier = [toxicity.doc_features(texts[i]) for i in order], np.zeros((18, 0))
    for model, y in zip(models, (low[order], toxic[order])):
        w = _dense_train(rows, earlier, y)
        assert np.allclose(model["weights"], w.astype("<f4"), atol=1e-5) and w.any()
        fold, p = np.array([keys[i] % 3 for i in order]), np.zeros(18)
        for f in range(3):
            part = _dense_train([r for r, k in zip(rows, fold) if k != f], earlier[fold != f], y[fold != f])
            for i in np.flatnonzero(fold == f):
                x = np.concatenate((np.log2(1 + np.bincount(rows[i], minlength=toxicity.DIM)), earlier[i], (1.0,)))
                p[i] = 1 / (1 + math.exp(-max(-30, min(30, part @ x))))
        assert abs(model["threshold"] - toxicity.best_threshold(p, y)) < 1e-6
        earlier = np.column_stack((earlier, toxicity.logit(p)))


def test_best_threshold_against_every_cut():
    rng = np.random.default_rng(1)
    for _ in range(20):
        p, y = np.round(rng.random(15), 1), (rng.random(15) < 0.4).astype(float)
        f1 = lambda t: 2 * (y[p >= t]).sum() / ((p >= t).sum() + y.sum()) if y.sum() else 0  # noqa: B023, E731
        if 0 < y.sum() < 15:
            assert f1(toxicity.best_threshold(p, y)) == pytest.approx(max(f1(t) for t in set(p)))


def _log_scores(model, page):
    """Log score of every labelling of a chain."""
    e = [sum(model["w"][i] for i in ids) for ids in page]
    return {y: sum(s for s, v in zip(e, y) if v) + sum(model["move"][a][b] for a, b in zip(y, y[1:])) for y in itertools.product((0, 1), repeat=len(page))}


def test_viterbi_against_every_labelling():
    rng = np.random.default_rng(2)
    for n in range(7):
        for _ in range(20):
            model = {"w": rng.normal(size=12), "move": rng.normal(size=(2, 2))}
            page = [rng.integers(0, 12, 3).tolist() for _ in range(n)]
            scores = _log_scores(model, page)
            got = tuple(extraction.viterbi(model, page))
            assert len(got) == n and scores[got] == pytest.approx(max(scores.values()))
    assert extraction.viterbi({"w": np.zeros(4), "move": np.zeros((2, 2))}, [[1], [2]]) == [0, 0]


def test_crf_reaches_the_likelihoods_top():
    """After training, the penalized likelihood, by enumeration of labellings, has no slope."""
    rng, l2 = np.random.default_rng(7), 0.05
    pages = [([rng.integers(0, 5, 2).tolist() for _ in range(n)], rng.integers(0, 2, n).tolist()) for n in (1, 2, 3, 4, 4, 3, 2, 4)]
    model = extraction.train_crf(pages, steps=3000, l2=l2)

    def value(w, move):
        total = 0.0
        for page, y in pages:
            scores = _log_scores({"w": w, "move": move}, page)
            total += scores[tuple(y)] - np.logaddexp.reduce(list(scores.values()))
        return total / len(pages) - l2 / 2 * (w @ w)

    w, move, h = model["w"][:5], model["move"], 1e-5
    assert not model["w"][5:].any()
    slopes = [(value(w + h * np.eye(5)[i], move) - value(w - h * np.eye(5)[i], move)) / (2 * h) for i in range(5)]
    for a, b in itertools.product((0, 1), repeat=2):
        d = np.zeros((2, 2))
        d[a, b] = h
        slopes.append((value(w, move + d) - value(w, move - d)) / (2 * h))
    assert max(map(abs, slopes)) < 1e-3


@pytest.mark.parametrize("most", [1, 3, 50])
def test_bins_against_a_plain_best_fit(most):
    """Few open bins: the fullest closes when a new one is opened."""
    rng, size = np.random.default_rng(most), 64
    bins, new, open_, where = packing.OpenBins(size, most), 0, {}, {}
    for length in rng.integers(1, size + 1, 3000).tolist():
        got, at = bins.place(length, new)
        fits = [b for b, free in open_.items() if free >= length]
        if fits:
            least = min(open_[b] for b in fits)
            assert got in {b for b in fits if open_[b] == least}
        else:
            assert got == new
            if len(open_) >= most:
                fullest = min(open_.values())
                gone = next(b for b in reversed(list(where)) if open_.get(b) == fullest)
                open_ = {b: f for b, f in open_.items() if b != gone} if most == 1 else open_
                if most > 1:  # any of the fullest may close: follow the operator's choice
                    left = [b for stack in bins.at.values() for b in stack]
                    open_ = {b: f for b, f in open_.items() if b in left}
            open_[got] = size
            new += 1
        assert at == size - open_[got]
        where[got] = True
        open_[got] -= length
        if not open_[got]:
            del open_[got]
        assert {b: size - f for f, stack in bins.at.items() for b in stack} == {b: size - f for b, f in open_.items()} and len(open_) <= most


def test_columns_named_like_a_mark(spark):
    docs = spark.createDataFrame([(i, f"some words of document {i}", 1, "x", 2) for i in range(20)], "doc_id long, text string, __target_id long, target string, doc long")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(20)], "doc_id long, quality int, toxic int")
    assert quality.resample(docs, labels).count() == 20
    assert quality.keep_sampled(docs, labels).columns == docs.columns


def test_repeats_inside_a_document_are_cut(spark):
    passage = " ".join(f"word{i}" for i in range(60))
    text = f"{passage} then {passage} and {passage} end"
    docs = spark.createDataFrame([(1, text), (2, "nothing of the kind here")], "doc_id long, text string")
    spans = substring.repeated_spans(docs).collect()
    assert len(spans) == 2 and all(s.doc_id == s.first_doc_id == 1 and s.start > 0 for s in spans)
    left = {r.doc_id: r.text for r in substring.remove_repeats(docs).collect()}
    assert left[2] == "nothing of the kind here" and left[1].count("word59") == 1 and left[1].startswith(passage)
    assert docs.select(row_key()).distinct().count() == 2
