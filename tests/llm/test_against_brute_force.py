"""Each operator's query on whole tables against a plain re-computation."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash

from examlake.llm import registry
from examlake.llm.common import kth_largest, table

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def docs(spark, sf):
    return {r["doc_id"]: r["text"] or "" for r in table(spark, sf, "documents").collect()}


def test_repetition(spark, sf, docs):
    got = {r["doc_id"]: r for r in registry.op10_quality_rules(spark, sf).collect()}
    assert set(got) == set(docs)
    for i, t in docs.items():
        ws = WORD.findall(t)
        grams = Counter(tuple(ws[j : j + 5]) for j in range(len(ws) - 4))
        hit = {j + k for j in range(len(ws) - 4) if grams[tuple(ws[j : j + 5])] > 1 for k in range(5)}
        seen, dup = set(), 0
        for line in t.split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        failed = len(ws) < 10 or 100 * len(hit) > 20 * len(ws)
        want = (len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(hit), failed)
        r = got[i]
        assert want == (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]), i
        assert not (failed and r["kept"])


def _fingerprint(t):
    ws = WORD.findall(t.translate(LOWER))
    if not ws:
        return 0
    sh = [" ".join(ws[j : j + 3]) for j in range(len(ws) - 2)] or [" ".join(ws)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(spark, sf, docs):
    fp = {i: _fingerprint(t) for i, t in docs.items()}
    ids = sorted(fp)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    v = np.array([fp[i] for i in ids], np.uint64)
    for a in range(len(ids)):
        for b in np.flatnonzero(np.bitwise_count(v[a] ^ v[a + 1 :]) <= 3) + a + 1:
            x, y = sorted((find(ids[a]), find(ids[b])))
            root[y] = x
    got = registry.op9_simhash_near_dedup(spark, sf).collect()
    assert {(r["doc_id"], r["fingerprint"], r["component_id"]) for r in got} == {(i, f"{fp[i]:016x}", find(i)) for i in ids}
    assert len(got) == len(ids)


def test_packing(spark, sf, docs):
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(registry.tokenizer_path())
    got = registry.op8_best_fit_packing(spark, sf).collect()
    rows = defaultdict(list)
    for r in got:
        rows[r["doc_id"]].append(r)
    total = 0
    for i, t in docs.items():
        ids = np.array([*tk.encode(t, add_special_tokens=False).ids, 1], "<u4")
        total += len(ids)
        want = [(k // 4096, k, len(ids[k : k + 4096]), zlib.crc32(ids[k : k + 4096].tobytes())) for k in range(0, len(ids), 4096)]
        assert sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows[i]) == want
    seqs = defaultdict(list)
    for r in got:
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in seqs.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 4096
    assert len(seqs) <= 1.03 * total / 4096 + 1


def test_chat(spark, sf):
    con = duckdb.connect()
    con.execute("set threads=4")
    con.execute(f"create view conversations as select * from '{sf}/conversations.parquet'")
    from examlake.llm.oracles import CHAT

    want = {tuple(r) for r in con.sql(CHAT).fetchall()}
    got = {tuple(r) for r in registry.op2_chat_formatting(spark, sf).collect()}
    assert got == want
    said = "</s>[INST] ok [/INST]"
    own = hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest()
    assert next(r for r in got if r[0] == -1)[1:5] == (2, own, len(said), hashlib.sha256(said.encode()).hexdigest())


def test_extraction(spark, sf):
    import html

    got = {r["page_id"]: r for r in registry.op5_html_extraction(spark, sf).collect()}
    pages = table(spark, sf, "pages").collect()
    assert len(got) == len(pages)
    wrong = 0
    for p in pages:
        inside = re.search(r"<article>(.*?)(?:</article>|\Z)", p["html"], re.S)
        parts = re.split(r"</?(?:p|h1|article)\b[^>]*>", inside[1]) if inside else []
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*(>|\Z)", "", re.sub(r"<br>", " ", x))).split()) for x in parts]
        want = "\n".join(x for x in parts if x)
        r = got[p["page_id"]]
        assert r["n_chars"] == len(r["text"])
        wrong += r["text"] != want
    assert wrong == 0


def test_language_model(spark, sf, docs):
    words = {i: [*WORD.findall(t.translate(LOWER)), None] for i, t in docs.items()}
    held = {i for i in docs if zlib.crc32(str(i).encode()) % 7 == 2}
    c = Counter(w for i, ws in words.items() if i not in held for w in ws)
    n, v = sum(c.values()), len(c)
    got = {r["doc_id"]: r for r in registry.op6_lm_scoring(spark, sf).collect()}
    assert set(got) == set(docs)
    score = base = 0.0
    for i, ws in words.items():
        r = got[i]
        want = sum(np.log10((c[w] + 1) / (n + v + 1)) for w in ws)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (i in held, len(ws), sum(c[w] > 0 for w in ws), n)
        assert abs(r["base_score"] - want) < 1e-6 * max(1, abs(want))
        assert r["score"] < 0
        if i in held:
            score, base = score + r["score"], base + r["base_score"]
    assert score > base


def test_language_model_beyond_the_limit(spark, sf):
    from examlake.llm.language_model import scores

    d = table(spark, sf, "documents")
    a = {r["doc_id"]: r for r in scores(d, rounds=1).collect()}
    b = {r["doc_id"]: r for r in scores(d, rounds=1, limit=10).collect()}
    for i, r in a.items():
        assert (r["n_known"], r["n_tokens"]) == (b[i]["n_known"], b[i]["n_tokens"])
        assert abs(r["base_score"] - b[i]["base_score"]) < 1e-6 * max(1, abs(r["base_score"]))
        assert abs(r["score"] - b[i]["score"]) < 1e-3 * max(1, abs(r["score"]))


def test_decontamination(spark, sf, docs):
    from examlake.llm.decontaminate import terms

    got = {(r["doc_id"], r["item_id"]) for r in registry.op3_benchmark_decontamination(spark, sf).collect()}
    items = {r["item_id"]: terms(r["text"]) for r in table(spark, sf, "benchmark").collect()}
    whole = {(i, k) for i, t in docs.items() for k, ws in items.items() if f" {' '.join(w.decode() for w in ws)} " in f" {' '.join(w.decode() for w in terms(t))} "}
    assert whole and whole <= got
    grams = {k: {tuple(ws[j : j + 5]) for j in range(len(ws) - 4)} for k, ws in items.items()}
    for i, k in got - whole:
        own = terms(docs[i])
        assert grams[k] & {tuple(own[j : j + 5]) for j in range(len(own) - 4)}


def test_substring(spark, sf, docs):
    spans = registry.op1_substring_dedup(spark, sf).collect()
    assert spans
    for r in spans:
        own = docs[r["doc_id"]].encode()
        raw = own[r["start"] : r["start"] + r["n_bytes"]]
        part, head = raw.decode().strip(), raw.strip()[:60]
        assert r["first_doc_id"] <= r["doc_id"]
        further_up = own.find(head) < own.find(raw.strip(), r["start"])  # in the same document
        elsewhere = any(part in t or part[:60] in t for i, t in docs.items() if i != r["doc_id"])
        assert further_up or (elsewhere and r["first_doc_id"] < r["doc_id"])


def test_toxicity(spark):
    rows = registry.op4_toxicity(spark, "/root/testdata/sf0.01").collect()
    labels = {r["doc_id"]: r["toxic"] for r in table(spark, "/root/testdata/sf0.01", "labels").collect()}
    flagged = [r["doc_id"] for r in rows if r["toxic"] and r["doc_id"] in labels]
    assert flagged and np.mean([labels[i] for i in flagged]) > 0.8


def test_quality(spark):
    """At sf0.1: how many rows are drawn follows the labels' share of good rows, which 87 labels can't tell closely enough."""
    sf = "/root/testdata/sf0.1"
    rows = {r["doc_id"]: r for r in registry.op7_quality_classifier(spark, sf).collect()}
    labels = {r["doc_id"]: r["quality"] for r in table(spark, sf, "labels").collect()}
    good = [rows[i]["kept"] for i, q in labels.items() if q == 1 and i in rows]
    bad = [rows[i]["kept"] for i, q in labels.items() if q == 0 and i in rows]
    assert np.mean(good) > 0.95 and np.mean(bad) < 0.2


def test_kth_largest(spark):
    values = [float(x) for x in np.random.default_rng(1).normal(size=500).round(2)] + [1.0] * 40
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for k in (1, 7, 40, 300, 540):
        assert kth_largest(df, "v", k) == sorted(values, reverse=True)[k - 1]
    assert kth_largest(df, "v", 541) is None and kth_largest(df, "v", 0) == float("inf")
