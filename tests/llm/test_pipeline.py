"""The pipeline's stages, each on what its predecessor kept, against plain recomputations."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from examlake.llm import decontaminate, quality
from examlake.llm.common import materialize, table
from examlake.llm.registry import tokenizer_path
from .test_against_brute_force import _fingerprint


@pytest.fixture(scope="module")
def steps(spark, sf):
    docs = [table(spark, sf, "documents")]
    for name, stage in corpus_pipeline.STAGES:
        docs.append(materialize(stage(spark, docs[-1], sf), name))
    return docs


def _rows(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_stages_keep_columns_and_rows(steps):
    for before, after in zip(steps[:4], steps[1:5], strict=True):
        assert after.columns == before.columns
        a, b = _rows(before), _rows(after)
        assert len(b) == after.count() and set(b) <= set(a)


def test_quality_draws_the_heaviest(spark, sf, steps):
    before, after = _rows(steps[0]), _rows(steps[1])
    labels = {r["doc_id"]: r["quality"] for r in table(spark, sf, "labels").collect()}
    good = {i for i, q in labels.items() if q == 1}
    hasher, ids = quality.Hasher(), sorted(before)
    grams = {i: hasher.grams([before[i]["text"] or ""])[0] for i in ids}
    raw, target = (np.bincount(np.concatenate([grams[i] for i in some]), minlength=quality.BUCKETS) for some in (ids, [i for i in ids if i in good]))
    q = (raw + 1) / (raw.sum() + quality.BUCKETS)
    ratio = np.log((target + quality.BUCKETS * q) / (target.sum() + quality.BUCKETS) / q)
    drawn = {r["doc_id"]: r for r in quality.resample(steps[0], table(spark, sf, "labels")).collect()}
    assert all(abs(drawn[i]["log_ratio"] - ratio[grams[i]].sum()) < 1e-6 * max(1, abs(drawn[i]["log_ratio"])) for i in ids)
    n, p = len(labels), len(good) / len(labels)
    upper = (p + 9 / (2 * n) + 3 * (p * (1 - p) / n + 9 / (4 * n * n)) ** 0.5) / (1 + 9 / n)
    k = int(np.ceil(min(1, upper) * len(ids)))
    least = sorted((r["sort_key"] for r in drawn.values()), reverse=True)[k - 1]
    assert set(after) == {i for i, r in drawn.items() if r["sort_key"] >= least}


def test_near_dedup_keeps_the_smallest_of_each_group(steps):
    before, after = _rows(steps[1]), _rows(steps[2])
    ids = sorted(before)
    fp = np.array([_fingerprint(before[i]["text"] or "") for i in ids], np.uint64)
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(ids)):
        for b in np.flatnonzero(np.bitwise_count(fp[a] ^ fp[a + 1 :]) <= 3) + a + 1:
            x, y = sorted((find(a), find(int(b))))
            root[y] = x
    assert set(after) == {ids[find(a)] for a in range(len(ids))}
    assert all(after[i] == before[i] for i in after)


def test_substring_dedup_takes_only_repeats(steps):
    before, after = _rows(steps[2]), _rows(steps[3])
    assert set(before) == set(after)
    changed = [i for i in before if before[i]["text"] != after[i]["text"]]
    for i in changed:
        left, text = after[i]["text"].split(), before[i]["text"].split()
        assert after[i]["n_chars"] == len(after[i]["text"])
        gone = Counter(text) - Counter(left)
        earlier = Counter(w for j in before if j < i for w in (before[j]["text"] or "").split()) + Counter(text)
        assert not gone - earlier and sum(gone.values()) >= 20


def test_decontamination_drops_holders_of_items(spark, sf, steps):
    before, after = _rows(steps[3]), _rows(steps[4])
    items = [decontaminate.terms(r["text"]) for r in table(spark, sf, "benchmark").collect()]
    own = {i: b" ".join([b"", *decontaminate.terms(r["text"] or ""), b""]) for i, r in before.items()}
    holders = {i for i, t in own.items() if any(b" ".join([b"", *w, b""]) in t for w in items)}
    assert not holders & set(after)
    gone = set(before) - set(after)
    grams = [{tuple(w[j : j + 3]) for j in range(len(w) - 2)} for w in items]
    for i in gone - holders:
        mine = own[i].split()
        have = {tuple(mine[j : j + 3]) for j in range(len(mine) - 2)}
        assert max(len(g & have) / len(g) for g in grams if g) >= 0.4


def test_packing_holds_every_token(steps):
    from tokenizers import Tokenizer

    tk, docs = Tokenizer.from_file(tokenizer_path()), _rows(steps[4])
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in steps[5].collect():
        pieces[r["doc_id"]].append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, r in docs.items():
        ids = np.array([*tk.encode(r["text"] or "", add_special_tokens=False).ids, 1], "<u4")
        want = [(k // 4096, k, len(ids[k : k + 4096]), zlib.crc32(ids[k : k + 4096].tobytes())) for k in range(0, len(ids), 4096)]
        assert sorted(pieces[i]) == want
    assert set(pieces) == set(docs)
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096


def test_run_is_its_stages_in_turn(spark, sf, steps):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "simhash_near_dedup", "substring_dedup", "benchmark_decontamination", "best_fit_packing"]
    assert Counter(map(tuple, corpus_pipeline.run(spark, sf).collect())) == Counter(map(tuple, steps[5].collect()))
