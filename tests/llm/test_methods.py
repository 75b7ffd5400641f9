"""Methods against plain versions of them: BM25 retrieval, planted passages, unseen labelled rows."""

import math
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from examlake.llm import decontaminate, packing, quality, repetition, substring, toxicity
from examlake.llm.common import table


def _plain_scores(passages, window):
    """BM25 share of every passage for one window of terms."""
    n, mean = len(passages), sum(map(len, passages)) / len(passages)
    df = Counter(t for p in passages for t in set(p))
    out = []
    for p in passages:
        tf = Counter(p)
        raw = {t: math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * m * 2.2 / (m + 1.2 * (0.25 + 0.75 * len(p) / mean)) for t, m in tf.items()}
        out.append(sum(x for t, x in raw.items() if t in window) / sum(raw.values()))
    return out


def test_retrieval_is_exhaustive_bm25(spark, sf):
    """Every (window, passage) that plain BM25 puts over the threshold is retrieved, and no other: recall 1."""
    items = [(r["item_id"], r["text"]) for r in table(spark, sf, "benchmark").collect()]
    docs = [r["text"].encode().lower().split() for r in table(spark, sf, "documents").orderBy("doc_id").limit(60).collect()]
    passages = [p for _, t in sorted(items) for p in decontaminate.passages_of(t)[2]]
    index = decontaminate.build_index(items)
    none = len(index.vocabulary)
    words = np.array([index.vocabulary.get(w.strip(decontaminate.EDGE), none) for ws in docs for w in ws])
    for threshold in (0.2, 0.5):
        win, term, doc, start = decontaminate.windows_of(words, np.repeat(np.arange(len(docs)), [len(d) for d in docs]), none, 96, 48)
        got = {(w, p): s for w, p, s in decontaminate.retrieve(index, win, term, threshold, room=20_000)}
        want = {}
        for w, (d, s) in enumerate(zip(doc.tolist(), start.tolist(), strict=True)):
            terms = {x.strip(decontaminate.EDGE) for x in docs[d][s : s + 96]}
            want |= {(w, p): x for p, x in enumerate(_plain_scores(passages, terms)) if x >= threshold}
        assert got.keys() == want.keys() and want
        assert all(abs(got[k] - x) < 1e-9 for k, x in want.items())


def test_windows_cover_every_word():
    doc = np.repeat([0, 1, 2, 4], [5, 96, 97, 500])
    _, _, owner, start = decontaminate.windows_of(np.zeros(len(doc), np.int64), doc, 1, 96, 48)
    assert [(int(a), int(b)) for a, b in zip(owner, start, strict=True)] == [(0, 0), (1, 0), (2, 0), (2, 48), *[(4, 48 * k) for k in range(10)]]


def test_sharded_index_gives_the_same_leaks(spark, sf):
    docs, items = table(spark, sf, "documents"), table(spark, sf, "benchmark")
    one, many = (sorted(map(tuple, decontaminate.leaks(docs, items, shard_words=n).collect())) for n in (400_000, 300))
    assert one and [x[:4] for x in one] == [x[:4] for x in many]
    assert all(abs(a[4] - b[4]) < 1e-9 for a, b in zip(one, many, strict=True))


def test_question_and_answer_must_both_be_there(spark):
    rng = random.Random(3)
    w = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n))
    q, a, noise = w(40), w(12), w(200)
    docs = spark.createDataFrame([(1, f"{noise} {q}. {a} {noise}"), (2, f"{noise} {q}. {w(12)} {noise}"), (3, f"{noise} {a} {noise}"), (4, noise)], "doc_id long, text string")
    found = decontaminate.leaks(docs, spark.createDataFrame([(9, f"{q}. {a}")], "item_id long, text string"))
    assert [(r["doc_id"], r["item_id"]) for r in found.collect()] == [(1, 9)]


def _words(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnopqrst") for _ in range(rng.randint(2, 9))) for _ in range(n))


def test_planted_passages_are_found_whole(spark):
    """Passages of 51 to 80 words in contexts of their own: each is found in all documents but the first, to the byte."""
    rng = random.Random(11)
    rows, want, doc_id = [], {}, 0
    for k in range(400):
        passage = _words(rng, rng.choice((51, 55, 60, 80)))
        first = doc_id
        for copy in range(3):
            before, after = _words(rng, rng.randint(0, 60)), _words(rng, rng.randint(0, 60))
            text = f"{before} {passage} {after}".strip()
            rows.append((doc_id, text))
            if copy:
                want[doc_id] = (len(before) + 1 if before else 0, len(passage), first)
            doc_id += 1
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    got = {r["doc_id"]: (r["start"], r["n_bytes"], r["first_doc_id"]) for r in substring.repeated_spans(docs).collect()}
    assert not got.keys() - want.keys()
    assert len(got) >= 0.995 * len(want)
    exact = sum(abs(got[i][0] - s) <= 1 and abs(got[i][1] - n) <= 2 and got[i][2] == f for i, (s, n, f) in want.items() if i in got)
    assert exact >= 0.995 * len(got)
    cut = {r["doc_id"]: r["text"] for r in substring.remove_repeats(docs).collect()}
    texts = dict(rows)
    assert all(len(cut[i]) == len(texts[i].encode()) - got.get(i, (0, 0))[1] for i in texts)


def test_spans_against_a_plain_search(spark):
    """Every span stands in an earlier document byte for byte, or in the same one further up; whole words only."""
    rng = random.Random(5)
    base = [_words(rng, 90) for _ in range(6)]
    rows = [(i, "\n".join(rng.choice(base) if rng.random() < 0.4 else _words(rng, 40) for _ in range(4))) for i in range(60)]
    rows += [(100, "\n".join([base[0], base[0]])), (101, f"{base[1]} {base[1]}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    texts = dict(rows)
    spans = substring.repeated_spans(docs, within=True).collect()
    cut = {}
    for r in spans:
        cut.setdefault(r["doc_id"], []).append((r["start"], r["start"] + r["n_bytes"]))
    for i, parts in cut.items():
        for a, b in parts:
            # runs from different places may meet: each byte must be in a stretch of 24 bytes that stands earlier
            text, held = texts[i].encode(), set()
            for at in range(a, b - 23):
                piece = text[at : at + 24]
                if any(piece in texts[j].encode() for j in texts if j < i) or text.find(piece) < at:
                    held.update(range(at, at + 24))
            assert not bytes(text[k] for k in range(a, b) if k not in held).strip(), (i, a, b)
    missed = 0
    for i, text in rows:
        for p in base:
            at = text.find(p)
            while at >= 0:
                earlier = any(p in texts[j] for j in texts if j < i) or text.find(p) < at
                covered = any(a <= at + 1 and at + len(p) - 1 <= b for a, b in cut.get(i, ()))
                missed += earlier and not covered
                at = text.find(p, at + 1)
    assert missed == 0


def test_toxicity_on_rows_not_trained_on(spark):
    """Half of the labelled documents train, the other half is judged."""
    d = "/root/testdata/sf0.1"
    labels = table(spark, d, "labels").withColumn("half", F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(2)))
    seen = {r["doc_id"]: r["toxic"] for r in labels.where("half = 1").collect()}
    docs = table(spark, d, "documents").join(labels.select("doc_id"), "doc_id")
    got = {r["doc_id"]: r["toxic"] for r in toxicity.toxicity(docs, labels.where("half = 0")).collect()}
    hits = sum(got[i] and seen[i] == 1 for i in seen if i in got)
    assert hits / sum(x == 1 for x in seen.values()) > 0.9
    assert hits / max(1, sum(got[i] for i in seen if i in got)) > 0.9


def test_quality_on_rows_not_trained_on(spark):
    d = "/root/testdata/sf0.1"
    labels = table(spark, d, "labels").withColumn("half", F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(2)))
    unseen = {r["doc_id"]: r["quality"] for r in labels.where("half = 1").collect()}
    got = {r["doc_id"]: r["kept"] for r in quality.resample(table(spark, d, "documents"), labels.where("half = 0")).collect()}
    assert np.mean([got[i] for i, q in unseen.items() if q == 1]) > 0.99
    assert np.mean([got[i] for i, q in unseen.items() if q == 0]) < 0.3


def test_verdict_follows_the_limits(spark, sf):
    """kept is the base rule and every share of characters within its limit, recomputed by plain loops, on both sides of the limits."""
    limits = repetition.NGRAM_LIMITS
    few = " ".join(f"{chr(97 + i % 26)}{i}" for i in range(90))
    made = [(-1, f"{few} {'the same ' * 30}"), (-2, f"{few} one pair here one pair there"), (-3, "\n".join([few, *["a line that comes again and again"] * 2, few[::-1]])), (-4, "\n".join(f"{i} b{i} c{i} repeated words of line" for i in range(60))), (-5, few)]
    docs = table(spark, sf, "documents").select("doc_id", "text").unionByName(spark.createDataFrame(made, "doc_id long, text string"))
    rows = {r["doc_id"]: r for r in repetition.repetition_rules(docs).collect()}
    beyond_base = 0
    for r in docs.collect():
        ws = [w.decode() for w in (r["text"] or "").encode().split()]
        chars = sum(map(len, ws))
        kept = not rows[r["doc_id"]]["base_failed"]
        for n, limit in limits.items():
            grams = Counter(tuple(ws[j : j + n]) for j in range(len(ws) - n + 1))
            hit = {j + k for j in range(len(ws) - n + 1) if grams[tuple(ws[j : j + n])] > 1 for k in range(n)}
            kept &= not chars or sum(len(ws[j]) for j in hit) / chars <= limit
        lines, again = set(), 0
        for line in (r["text"] or "").split("\n"):
            bare = line.encode().split()
            again += sum(len(w.decode()) for w in bare) if line in lines else 0
            lines |= {line} if bare else set()
        kept &= not chars or again / chars <= repetition.LINE_LIMIT
        assert rows[r["doc_id"]]["kept"] == kept, r["doc_id"]
        beyond_base += not kept and not rows[r["doc_id"]]["base_failed"]
    assert rows[-5]["kept"] and rows[-2]["kept"] and not rows[-1]["kept"] and beyond_base


def test_other_tokenizers_encode_whole_texts():
    import public_tokenizers
    from tokenizers import Tokenizer

    texts = ["Hello  World's café, 12!", "", "a</s>b <|endoftext|>", "ÀÉ\u0130 x" * 3]
    for name, cached in (("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)):
        cache, plain = packing.WordCache(public_tokenizers.path(name)), Tokenizer.from_file(public_tokenizers.path(name))
        assert cache.by_words is cached
        assert [x.tolist() for x in cache.encode(texts)] == [plain.encode(t, add_special_tokens=False).ids for t in texts]
