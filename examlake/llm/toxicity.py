"""Toxicity by a classifier chain (operator 4)."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from examlake.llm.common import materialize, text_or_empty

DIM = 1 << 18
_EDGE = re.compile(r"^\W+|\W+$")
PREFIXES = (4, 5, 6, 7, 8)


def word_features(word: str, dim: int = DIM) -> list[int]:
    """Hashed features of a lower-cased word: itself and its beginnings."""
    names = [f"w{word}", *(f"p{word[:k]}" for k in PREFIXES if len(word) > k)]
    return [xxhash.xxh32_intdigest(n.encode()) % dim for n in names]


def distinct_words(text: str) -> set[str]:
    return {w for w in (_EDGE.sub("", x) for x in set(text.lower().split())) if w}


def doc_features(text: str) -> np.ndarray:
    """A feature's value is how many of the text's different words have it; repeated in the array."""
    return np.array([f for w in sorted(distinct_words(text)) for f in word_features(w)], np.int32)


def logit(p):
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def train(rows: list[np.ndarray], earlier: np.ndarray, y: np.ndarray, epochs: int = 6, alpha: float = 0.3, l1: float | None = None, l2: float = 0.1, seed: int = 5) -> np.ndarray:
    """Logistic regression by follow-the-regularized-leader; most weights end at zero.

    l1 grows with the positive examples by default, from 0.5 to 12, so that what is common to a few
    of many examples is not learned. The weights of the DIM hashed features, then one for each earlier category's logit, then the bias.
    """
    extra = earlier.shape[1] + 1
    l1 = float(np.clip(0.018 * y.sum(), 0.5, 12)) if l1 is None else l1
    z, n = np.zeros(DIM + extra), np.zeros(DIM + extra)
    tail = np.arange(DIM, DIM + extra)
    rng = np.random.default_rng(seed)
    prepared = [np.unique(r, return_counts=True) for r in rows]
    positive = max(1.0, min(20.0, (len(y) - y.sum()) / max(1, y.sum()))) ** 0.5
    for _ in range(epochs):
        for i in rng.permutation(len(prepared)):
            idx, x = prepared[i]
            idx = np.concatenate((idx, tail))
            x = np.concatenate((np.log2(1.0 + x), earlier[i], (1.0,)))
            zi, ni = z[idx], n[idx]
            reg = np.where(idx < DIM, l1, 0.0)
            w = np.where(np.abs(zi) > reg, -(zi - np.sign(zi) * reg) / ((1.0 + np.sqrt(ni)) / alpha + l2), 0.0)
            p = 1 / (1 + np.exp(-np.clip(w @ x, -30, 30)))
            g = (p - y[i]) * x * (positive if y[i] else 1.0)
            z[idx] += g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha * w
            n[idx] += g * g
    reg = np.where(np.arange(DIM + extra) < DIM, l1, 0.0)
    return np.where(np.abs(z) > reg, -(z - np.sign(z) * reg) / ((1.0 + np.sqrt(n)) / alpha + l2), 0.0)


def predict(w: np.ndarray, rows: list[np.ndarray], earlier: np.ndarray) -> np.ndarray:
    out = np.empty(len(rows))
    for i, r in enumerate(rows):
        idx, x = np.unique(r, return_counts=True)
        out[i] = w[idx] @ np.log2(1.0 + x) + earlier[i] @ w[DIM:-1] + w[-1]
    return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The probability at which F1 is best, midway to the next lower one; 0.5 if there is one class only."""
    if not len(y) or y.min() == y.max():
        return 0.5
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    last = np.flatnonzero(np.append(np.diff(p[order]) != 0, True))
    k = last[np.argmax(f1[last])]
    lower = p[order][k + 1] if k + 1 < len(p) else 0.0
    return float((p[order][k] + lower) / 2)


def fit_chain(examples: DataFrame, categories: tuple[str, ...], folds: int = 4) -> list[dict]:
    """One model for each category in turn: {category, weights, threshold}.

    examples: text and a 0/1 column for each category, bounded by the caller. Each fold's model is
    a task of its own; a row's probability for the next model comes from the model that did not
    see the row. Thresholds come from the same out-of-fold probabilities.
    """

    def featurize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([doc_features(t) for t in batch.column(1).to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), found, *batch.columns[2:]], ["row_id", "features", *categories])

    labels = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in categories]
    rows = examples.select(F.xxhash64("doc_id", "text").alias("row_id"), text_or_empty().alias("text"), *labels).dropDuplicates(["row_id"])
    rows = materialize(rows.mapInArrow(featurize, f"row_id long, features array<int>, {', '.join(f'{c} double' for c in categories)}"), "examples")
    models, chain = [], rows.withColumn("earlier", F.array().cast("array<double>"))
    for category in categories:

        def fit_one(key, pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("row_id")
            held = (pdf["row_id"] % folds == key[0]).to_numpy()  # the last fit holds nothing out
            x = [np.asarray(f, np.int32) for f in pdf["features"]]
            earlier = np.array([list(e) for e in pdf["earlier"]], float).reshape(len(pdf), -1)
            y = pdf["label"].to_numpy()
            w = train([x[i] for i in np.flatnonzero(~held)], earlier[~held], y[~held])
            if key[0] == folds:
                return pd.DataFrame({"row_id": [0], "p": [0.0], "y": [0.0], "weights": [w.astype("<f4").tobytes()]})
            at = np.flatnonzero(held)
            return pd.DataFrame({"row_id": pdf["row_id"].to_numpy()[at], "p": predict(w, [x[i] for i in at], earlier[at]), "y": y[at], "weights": None})

        fits = chain.select("row_id", "features", "earlier", F.col(category).alias("label"), F.explode(F.array(*map(F.lit, range(folds + 1)))).alias("fit"))
        done = materialize(fits.groupBy("fit").applyInPandas(fit_one, "row_id long, p double, y double, weights binary"), "fits")
        weights = [np.frombuffer(r["weights"], "<f4").astype(float) for r in done.where("weights is not null").collect()]
        oof = done.where("weights is null").select("row_id", "p", "y")
        seen = oof.toPandas()
        w = weights[0] if weights else np.zeros(DIM + len(models) + 1)
        models.append({"category": category, "weights": w, "threshold": best_threshold(seen["p"].to_numpy(), seen["y"].to_numpy())})
        p = F.least(F.greatest(F.col("p"), F.lit(1e-4)), F.lit(1 - 1e-4))
        chain = chain.join(oof.select("row_id", F.log(p / (1 - p)).alias("l")), "row_id").withColumn("earlier", F.concat("earlier", F.array("l"))).drop("l")
    return models


def score_chain(docs: DataFrame, models: list[dict]) -> DataFrame:
    """doc_id, then <category>_prob and <category> (boolean) for each category of the chain."""
    shared = docs.sparkSession.sparkContext.broadcast(models)
    fields = [f"{m['category']}_prob double, {m['category']} boolean" for m in models]
    schema = ", ".join(["doc_id long", *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain, known = shared.value, {}
        for batch in batches:
            probs = [[] for _ in chain]
            for text in batch.column(1).to_pylist():
                if len(known) > 300_000:
                    known.clear()
                parts = []
                for w in distinct_words(text):
                    f = known.get(w)
                    if f is None:
                        f = known[w] = np.array(word_features(w), np.int32)
                    parts.append(f)
                idx, x = np.unique(np.concatenate(parts), return_counts=True) if parts else (np.zeros(0, int), np.zeros(0))
                x, earlier = np.log2(1.0 + x), []
                for m, out in zip(chain, probs, strict=True):
                    w = m["weights"]
                    p = 1 / (1 + np.exp(-np.clip(w[idx] @ x + sum(a * b for a, b in zip(earlier, w[DIM:-1])) + w[-1], -30, 30)))
                    earlier.append(float(logit(p)))
                    out.append(float(p))
            columns = [c for m, out in zip(chain, probs, strict=True) for c in (pa.array(out, pa.float64()), pa.array([p >= m["threshold"] for p in out], pa.bool_()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], [f.split()[0] for f in schema.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")).mapInArrow(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = 6000) -> DataFrame:
    """Probabilities and flags of the chain low_quality -> toxic for every document.

    Models learn from up to `sample` labelled documents (the bound, chosen by the hash of doc_id);
    labels hold two categories, quality = 0 and toxic = 1. A null label counts as 0. A null or
    empty text gets the probability of no words. Repeated rows give a row each; of a repeated label
    one stands. With no labels all probabilities are 0.5 and only ties with 0.5 are flagged: none
    is toxic then, as an untrained model flags nothing. A null doc_id stays null.
    """
    lab = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("__quality"), F.max("toxic").alias("__toxic"))
    lab = lab.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).withColumnRenamed("doc_id", "__lab_id")
    rows = docs.select("doc_id", "text").join(F.broadcast(lab), F.col("doc_id") == F.col("__lab_id"))
    examples = rows.select("doc_id", "text", (F.col("__quality") == 0).cast("int").alias("low_quality"), (F.col("__toxic") == 1).cast("int").alias("toxic"))
    models = fit_chain(examples, ("low_quality", "toxic"))
    for m in models:
        if not m["weights"].any():
            m["threshold"] = 2.0
    return score_chain(docs, models)
