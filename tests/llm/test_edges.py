"""Every operator and pipeline stage on nulls, empty and very long texts, ties, repeated rows and ids, clashing columns, empty tables."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from examlake.llm import chat, common, decontaminate, extraction, language_model, packing, quality, repetition, simhash, substring, toxicity
from examlake.llm.registry import tokenizer_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long, __spans string, __row_key long, run long, row_key long"
LABELS = "doc_id long, quality int, toxic int"


def _words(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(n))


COPY = _words(1, 120)
TEXTS = [
    (1, COPY), (2, COPY), (3, _words(3, 200)), (4, COPY + " tail"), (4, _words(4, 90)), (5, None), (6, ""), (7, " \t\n "), (None, _words(7, 50)), (None, None),
    (8, _words(8, 120_000)), (9, _words(3, 200)), (9, _words(3, 200)), (10, "é" * 40), (11, _words(11, 60) + "\n" + _words(12, 60)),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", None if t is None else len(t), "x", 5, 6, 7) for i, t in TEXTS]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (3, 1, 0), (3, 0, 0), (9, 1, None), (10, 0, 1), (None, 1, 1), (5, None, None)], LABELS)


@pytest.fixture(scope="module")
def benchmark(spark):
    rows = [(1, _words(3, 40) + ". " + _words(21, 8)), (1, _words(22, 30)), (2, None), (None, "a b c"), (3, ""), (4, "..."), (5, _words(11, 60) + "\n" + _words(12, 60))]
    return spark.createDataFrame(rows, "item_id long, text string")


def _ids(df):
    return Counter(r["doc_id"] for r in df.collect())


OPERATORS = {
    "substring": lambda d, lab, b: substring.repeated_spans(d),
    "decontaminate": lambda d, lab, b: decontaminate.leaks(d, b),
    "toxicity": lambda d, lab, b: toxicity.toxicity(d, lab),
    "language_model": lambda d, lab, b: language_model.scores(d),
    "quality": lambda d, lab, b: quality.resample(d, lab),
    "packing": lambda d, lab, b: packing.pack_documents(d, tokenizer_path()),
    "simhash": lambda d, lab, b: simhash.near_duplicates(d),
    "repetition": lambda d, lab, b: repetition.repetition_rules(d),
}
STAGES = {
    "keep_sampled": lambda d, lab, b: quality.keep_sampled(d, lab),
    "keep_one": lambda d, lab, b: simhash.keep_one(d),
    "remove_repeats": lambda d, lab, b: substring.remove_repeats(d),
    "remove_leaks": lambda d, lab, b: decontaminate.remove_leaks(d, b),
}
ROW_EACH = ("toxicity", "language_model", "quality", "simhash", "repetition")


@pytest.mark.parametrize("name", [*OPERATORS, *STAGES])
def test_empty_tables(spark, docs, labels, benchmark, name):
    run = {**OPERATORS, **STAGES}[name]
    assert run(docs.limit(0), labels, benchmark).collect() == []
    bare = run(docs, labels.limit(0), benchmark.limit(0))
    if name in ROW_EACH or name == "keep_sampled":
        assert _ids(bare) == Counter(i for i, _ in TEXTS)


@pytest.mark.parametrize("name", ROW_EACH)
def test_a_row_for_each_row(docs, labels, benchmark, name):
    assert _ids(OPERATORS[name](docs, labels, benchmark)) == Counter(i for i, _ in TEXTS)


@pytest.mark.parametrize("name", ROW_EACH)
def test_batches_without_a_word(spark, labels, benchmark, name):
    blank = spark.createDataFrame([(1, None), (2, ""), (3, " ")], "doc_id long, text string").repartition(1)
    assert _ids(OPERATORS[name](blank, labels, benchmark)) == Counter([1, 2, 3])


def test_same_result_twice(docs, labels, benchmark):
    for name in ("quality", "simhash", "substring", "repetition"):
        a, b = (Counter(map(tuple, OPERATORS[name](d, labels, benchmark).collect())) for d in (docs, docs.repartition(5)))
        assert a == b, name


def test_keep_sampled_keeps_columns_and_rows(docs, labels):
    kept = quality.keep_sampled(docs, labels, keep=4)
    assert kept.columns == docs.columns
    assert 4 <= kept.count() <= 6  # repeated rows share their fate


def test_keep_one(docs):
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    got = Counter((r["doc_id"], r["text"]) for r in kept.collect())
    texts = dict.fromkeys(TEXTS)
    want = {(1, COPY), (3, TEXTS[2][1]), (4, TEXTS[4][1]), (8, TEXTS[10][1]), (None, TEXTS[8][1]), (10, TEXTS[13][1]), (11, TEXTS[14][1]), (5, None)}
    assert set(got) == want and all(k in texts and n == 1 for k, n in got.items())


def test_remove_repeats_keeps_other_texts_of_an_id(docs):
    out = substring.remove_repeats(docs)
    assert out.columns == docs.columns
    got = Counter((r["doc_id"], (r["text"] or "").strip()) for r in out.collect())
    assert sum(got.values()) == len(TEXTS)
    assert got[(4, TEXTS[4][1])] == 1 and got[(4, "tail")] == 1 and got[(2, "")] == 1 and got[(1, COPY)] == 1
    assert got[(3, TEXTS[2][1])] == 1 and got[(9, "")] == 2 and got[(8, TEXTS[10][1])] == 1


def test_remove_leaks(docs, benchmark):
    out = decontaminate.remove_leaks(docs, benchmark)
    assert out.columns == docs.columns
    gone = Counter(i for i, _ in TEXTS) - _ids(out)
    assert gone == Counter({11: 1})  # the others hold an item's question but not its answer


def test_packing_pieces(docs):
    rows = packing.pack_documents(docs, tokenizer_path()).collect()
    assert Counter(r["doc_id"] for r in rows if r["piece"] == 0) == Counter(i for i, _ in TEXTS)
    assert min(r["length"] for r in rows) == 1 and max(r["length"] for r in rows) == 4096


def test_repeated_keys_are_joined_whole(spark):
    big = spark.range(9000).select(F.when(F.col("id") < 6000, F.lit(1)).otherwise(F.col("id")).alias("k"), "id")
    small = big.groupBy("k").agg(F.count(F.lit(1)).alias("n")).withColumn("v", F.col("k") * 2)
    got = common.join_by_key(big, small, ["k"], most=10)
    assert got.count() == 9000 and got.where("v <> 2 * k").count() == 0 and got.select("id").distinct().count() == 9000


def test_large_buckets_of_fingerprints():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 62, 40, np.uint64)
    mask = simhash.masks(3)[0]
    free = [b for b in range(64) if not mask >> b & 1]
    values = {int(b) & mask ^ sum(1 << int(f) for f in rng.choice(free, rng.integers(0, 5), False)) for b in base[:1].repeat(6000)}
    values = np.array(sorted(values), np.uint64)
    assert len(values) > simhash._KEEP_BLOCK
    near = {i: i for i in range(len(values))}

    def find(i):
        while near[i] != i:
            near[i] = near[near[i]]
            i = near[i]
        return i

    for i in range(len(values)):
        for j in np.flatnonzero(np.bitwise_count(values[i] ^ values[i + 1 :]) <= 3) + i + 1:
            near[find(int(j))] = find(i)
    plain = len({find(i) for i in near})
    at = {int(v): i for i, v in enumerate(values)}
    near = {i: i for i in range(len(values))}
    for a, b in simhash._links(values, 3, free):
        for x, y in zip(a.tolist(), np.broadcast_to(b, a.shape).tolist(), strict=True):
            near[find(at[x])] = find(at[y])
    assert len({find(i) for i in near}) == plain


NODES = "tree_id long, node_id long, parent_id long, role string, text string, score double, extra string"


def _formatted(spark, rows, **options):
    out = chat.format_trees(spark.createDataFrame(rows, NODES), **options)
    return sorted(((r["tree_id"], r["branch"], [(t["role"], t["text"]) for t in r["turns"]], r["loss"]) for r in out.select("tree_id", "branch", chat.read_back(F.col("formatted")).alias("turns"), chat.loss_text(F.col("segments")).alias("loss")).collect()), key=str)


def test_chat_nulls_cycles_and_repeats(spark):
    rows = [
        (1, 1, None, "user", "hi", None, "x"), (1, 2, 1, "assistant", None, 1.0, "x"), (1, 2, 1, "assistant", None, 1.0, "x"),
        (2, 1, 3, "a", "one", 0.0, "x"), (2, 2, 1, "b", "two", 0.0, "x"), (2, 3, 2, "c", "three", 0.0, "x"), (2, 4, 3, "assistant", "four", 0.0, "x"),
        (3, 1, 99, None, "<|turn|>\\</s>", None, "x"), (4, 5, 5, "u", "self", None, "x"),
        (5, 1, None, "us\ner~1\\", "a\n<|text|>\nb", None, "x"), (5, 2, 1, "assistant", "<|end|>\n", None, "x"), (None, 1, None, "user", "no tree", None, "x"),
    ]
    got = {k: (turns, loss) for k, b, turns, loss in _formatted(spark, rows) if b == 1}
    assert got == {
        1: ([("user", "hi"), ("assistant", "")], ""), 2: ([("a", "one"), ("b", "two"), ("c", "three"), ("assistant", "four")], "four"), 3: ([("", "<|turn|>\\</s>")], ""),
        4: ([("u", "self")], ""), 5: ([("us\ner~1\\", "a\n<|text|>\nb"), ("assistant", "<|end|>\n")], "<|end|>\n"), None: ([("user", "no tree")], ""),
    }
    assert _formatted(spark, []) == []


def test_chat_branches_against_a_plain_search(spark):
    rng = random.Random(2)
    rows = []
    for tree in range(12):
        for node in range(1, rng.randint(2, 25)):
            rows.append((tree, node, rng.randint(1, node - 1) if node > 1 and rng.random() < 0.95 else None, rng.choice(("user", "assistant")), f"t{node} </s>", rng.randint(0, 3) * 0.5, "x"))
    want = []
    for tree in range(12):
        own = {r[1]: r for r in rows if r[0] == tree}
        ranked = []
        for leaf in set(own) - {r[2] for r in own.values()}:
            path, at = [], leaf
            while at is not None:
                path.append(own[at])
                at = own[at][2]
            ranked.append((-sum(r[5] for r in path) / len(path), -len(path), leaf, path[::-1]))
        for k, (*_, path) in enumerate(sorted(ranked, key=lambda x: x[:3])[:3]):
            want.append((tree, k + 1, [(r[3], r[4]) for r in path], "".join(r[4] for r in path if r[3] == "assistant")))
    assert _formatted(spark, rows, per_tree=3) == sorted(want, key=str)


def test_pages(spark):
    article = [f"{_words(40 + k, 30).capitalize()}. {_words(80 + k, 12).capitalize()}." for k in range(4)]
    side = "<div class='sidebar'><ul><li><a href='/a'>more</a></li><li><a href='/b'>less</a></li></ul></div><div class='footer'><p>all rights</p></div>"
    plain = [(k, f"u{k}", "<html><body><div class='menu'><a href='/'>home</a></div><div class='content'>" + "".join(f"<p>{a}</p>" for a in article) + f"<p>{_words(k, 25).capitalize()}.</p></div>{side}</body></html>") for k in range(20)]
    rows = [*plain, (30, "n", None), (31, None, ""), (None, "x", "<p"), (32, "d", plain[0][2]), (32, "d", plain[0][2]), (33, "long", "<html><body><article>" + "<p>One more sentence here.</p>" * 30_000 + "</article></body></html>")]
    df = spark.createDataFrame([(*r, "z", 1) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    out = {r["page_id"]: r for r in extraction.main_text(df).collect()}
    assert len(out) == 25
    for k in range(20):
        assert article[0] in out[k]["text"] and "home" not in out[k]["text"] and "all rights" not in out[k]["text"], k
    assert out[30]["text"] == out[31]["text"] == "" and out[33]["text"].count("\n") == 29_999
    unmarked = {r["page_id"]: r["text"] for r in extraction.main_text(df.where("page_id < 20")).collect()}
    assert all(article[0] in t and article[3] in t and "all rights" not in t for t in unmarked.values())
    assert extraction.main_text(df.limit(0)).collect() == []


def test_draws_follow_the_weights(spark):
    weight = {1: 1.0, 2: 2.0, 3: 4.0, 4: 0.5}
    rows = spark.createDataFrame([(s * 10 + i, s, float(np.log(w))) for s in range(4000) for i, w in weight.items()], "row_key long, run long, log_ratio double")
    keyed = quality.draw_keys(rows, 1.0, 3).withColumn("item", F.col("row_key") % 10).collect()
    runs = {}
    for r in keyed:
        runs.setdefault(r["run"], []).append((r["sort_key"], r["item"]))
    pairs = Counter(tuple(i for _, i in sorted(x, reverse=True)[:2]) for x in runs.values())
    total = sum(weight.values())
    for a in weight:
        for b in weight:
            if a != b:
                exact = weight[a] / total * weight[b] / (total - weight[a])
                assert abs(pairs[(a, b)] / 4000 - exact) < 4 * (exact * (1 - exact) / 4000) ** 0.5 + 1e-3, (a, b)


def test_the_kth_key_is_the_threshold(spark, docs, labels):
    for k in (1, 3, 8):
        rows = quality.resample(docs, labels, keep=k).collect()
        keys = sorted((r["sort_key"] for r in rows), reverse=True)
        assert {r["threshold"] for r in rows} == {keys[k - 1]}
        assert sum(r["kept"] for r in rows) == sum(x >= keys[k - 1] for x in keys)
