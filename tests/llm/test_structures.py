"""Repair grammar, mixing and prefix trie (operators 11 to 13) against plain versions."""

import hashlib
import itertools
import random
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from examlake.llm import mixing, registry, repair, trie
from examlake.llm.common import materialize

TURNS = "conv_id long, turn long, role string, text string"


def _rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("name", ["op11_conversation_repair", "op12_source_mixing", "op13_prefix_trie"])
def test_queries_against_their_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    df = registry.queries()[name](spark, sf)
    rel = con.sql(registry.oracle_sql()[name])
    assert sorted(rel.columns) == sorted(df.columns)
    assert _rows(df.select(*sorted(df.columns))) == sorted((tuple(r) for r in rel.project(",".join(sorted(df.columns))).fetchall()), key=str)


# --- operator 11 ---


def _step(state, initial):
    """The state behind a row, None if it may not stand there; by a table written out by hand."""
    return {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}.get((state, initial))


def _plain_repair(symbols):
    """(cost, audit) by trying every edit of every row and one insertion at a time, row by row, all kept."""
    def inserted(states):
        states = dict(states)
        for _ in range(3):
            for (state, (cost, audit)), initial in itertools.product(list(states.items()), "ua"):
                if (to := _step(state, initial)) is not None:
                    states[to] = min(states.get(to, (10**9, "")), (cost + 2, audit + "I"))
        return states

    states = inserted({"": (0, "")})
    for x in symbols:
        more, initial, after = int(x.isupper()), x.lower(), {}
        for state, (cost, audit) in states.items():
            ways = [(state, cost + 3, "D")]
            if initial != "x":
                ways += [(_step(state, initial), cost + more, "K")] + [(_step(state, i), cost + 2 + more, "R") for i in "ua"]
            for to, c, letter in ways:
                if to is not None:
                    after[to] = min(after.get(to, (10**9, "")), (c, audit + letter))
        states = inserted(after)
    return min(states[s] for s in ("", "a") if s in states)


def _tried_repair(symbols):
    """(cost, audit) out of every string of edits, insertions of up to two rows at each place."""
    best = None
    for edits in itertools.product(*[("D",) if x == "x" else ("D", "K", "Ru", "Ra") for x in symbols]):
        for gaps in itertools.product((0, 1, 2), repeat=len(symbols) + 1):
            inserts = sum(gaps)
            for roles in itertools.product("ua", repeat=inserts):
                it, state, cost, audit = iter(roles), "", 2 * inserts, ""
                for i in range(len(symbols) + 1):
                    for _ in range(gaps[i]):
                        state, audit = state is not None and _step(state, next(it)) or None, audit + "I"
                    if i < len(symbols):
                        e, x = edits[i], symbols[i]
                        audit += e[0]
                        cost += {"D": 3, "K": 0, "R": 2}[e[0]] + (e != "D" and x.isupper())
                        if e != "D" and state is not None:
                            state = _step(state, x.lower() if e == "K" else e[1])
                    if state is None:
                        break
                if state in ("", "a") and (best is None or (cost, audit) < best):
                    best = (cost, audit)
    return best


def test_chart_against_every_edit():
    random.seed(3)
    some = [""] + ["".join(p) for p in itertools.product("suaoxUA", repeat=2)] + ["".join(random.choice("suaoxSUAO") for _ in range(3)) for _ in range(12)]
    for symbols in some:
        assert repair.cheapest(repair.chart(symbols)) == _plain_repair(symbols) == _tried_repair(symbols)


def test_chart_of_longer_rows():
    random.seed(4)
    for n in (5, 8, 13, 20):
        for _ in range(8):
            symbols = "".join(random.choice("suaoxSUAO") for _ in range(n))
            whole = repair.chart(symbols)
            assert repair.cheapest(whole) == _plain_repair(symbols)
            k = random.randrange(n + 1)
            assert repair.combine(repair.chart(symbols[:k]), repair.chart(symbols[k:])) == whole  # any split


def test_long_conversations_join_their_charts(spark, monkeypatch):
    random.seed(6)
    monkeypatch.setattr(repair, "BLOCK", 4)
    said = [(c, t, random.choice(["user", "assistant", "system", "tool"]), random.choice(["Yes.", "No", "", f"So {t}."])) for c, n in ((1, 75), (2, 4), (3, 5), (4, 1)) for t in range(n)]
    rows = materialize(repair.with_faults(spark.createDataFrame(said, TURNS)), "rows")
    symbols = defaultdict(str)
    for r in sorted(rows.collect(), key=lambda r: (r.conv_id, r.pos)):
        symbols[r.conv_id] += r.symbol
    assert {r.conv_id: (r.cost, r.audit) for r in repair.parsed(rows).collect()} == {c: _plain_repair(s) for c, s in symbols.items()}


def test_repair_edges(spark):
    said = [
        (1, 0, "user", "Hello."), (1, 0, "user", "Hello."), (1, None, "system", "Be kind."), (1, 1, "assistant", "Hi"), (1, 5, None, "x."), (1, 6, "user", None),
        (None, 0, "assistant", "Alone."), (2, 0, "user", " \n"), (3, None, "user", "A?"), (3, None, "user", "B?"), (4, 0, "user", "a" * 300_000 + "."), (4, 1, "assistant", "b!"),
    ]
    df = spark.createDataFrame([(*r, "x", 1) for r in said], TURNS + ", pos string, seen int")
    report, turns = repair.repair(df)
    got = {r.conv_id: tuple(r)[1:] for r in report.collect()}
    text = defaultdict(list)
    for r in turns.collect():
        text[r.conv_id].append((r.role, r.text, r.edit))
    # after Be kind., Hello., its copy and Hi come a row of no speaker, which goes, and a blank
    assert got[1] == (3, 1, 1, 1, 3, 10, "KKDKDD") and _plain_repair("suxAox") == (10, "KKDKDD")
    assert text[1][:3] == [("system", "Be kind.", "K"), ("user", "Hello.", "K"), ("assistant", "Hi", "K")]
    assert got[None] == (0, 0, 0, 0, 0, 2, "IK") and text[None] == [("user", "", "I"), ("assistant", "Alone.", "K")]
    assert got[2] == (0, 1, 0, 0, 0, 3, "D") and 2 not in text
    assert got[3] == (0, 0, 0, 0, 1, 2, "KR") and text[3] == [("user", "A?", "K"), ("assistant", "B?", "R")]
    assert got[4] == (0, 0, 0, 0, 0, 0, "KK")
    empty_report, empty_turns = repair.repair(df.limit(0))
    assert empty_report.count() == empty_turns.count() == 0
    shas = {r.conv_id: r.sha256 for r in repair.turn_digests(turns).collect()}
    assert shas == {c: hashlib.sha256("\n".join(f"{a}:{b}" for a, b, _ in ts).encode()).hexdigest() for c, ts in text.items()}


def test_damage(spark):
    import zlib

    said = [(c, t, "assistant", "One. Two!") for c in range(40) for t in range(6)] + [(None, None, None, None)]
    got = defaultdict(list)
    for r in repair.damaged(spark.createDataFrame(said, TURNS)).collect():
        got[r.conv_id, r.turn].append((r.role, r.text))
    for c, t, role, text in said:
        fate = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = role or " ", text or " "
        want = {0: [], 1: [(role, "")], 2: [(role, text.replace(".", "").replace("!", ""))], 3: [(role, text)] * 2, 4: [("user", text)]}.get(fate, [(role, text)])
        assert got[c, t] == want


# --- operator 12 ---


def _shared(sizes, weights=(5, 2, 1), most=3):
    """Targets by resharing the excess, round after round."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, full = float(sum(sizes.values())), set()
    while True:
        free = [s for s in names if s not in full]
        left = total - sum(most * sizes[s] for s in full)
        target = {s: most * sizes[s] if s in full else w[s] * left / sum(w[x] for x in free) for s in names}
        above = {s for s in free if target[s] > most * sizes[s]}
        if not above:
            return target
        full |= above


def test_targets_against_rounds(spark):
    random.seed(9)
    for _ in range(6):
        sizes = {f"s{i:02d}{'é' * (i % 2)}": random.choice([0, 1, 10, 1000, 50_000]) + random.randrange(9) for i in range(random.randrange(1, 12))}
        if random.random() < 0.5:
            sizes[None] = 77
        df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        got = {r.source: r.target for r in mixing.targets(df).collect()}
        want = _shared(sizes)
        assert set(got) == set(want) and all(abs(got[s] - want[s]) <= 1e-9 * max(1, want[s]) for s in want)


def test_mix_comes_near_its_targets(spark):
    rows = [(i, f"s{i % 4}" if i % 7 else None, "w " * (1 + i * 37 % 50), "c") for i in range(8000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, rate string")
    found = mixing.with_copies(mixing.sized(docs))
    sums = {r.source: r for r in found.groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("taken"), F.max("target").alias("target"), F.max("copies").alias("most"), F.max("rate").alias("rate"), F.max("source_size").alias("size")).collect()}
    for r in sums.values():
        assert abs(r.taken - r.target) <= 0.05 * r.target and r.most <= 3 and abs(r.rate * r.size - r.target) < 1e-6 * r.target
    assert _rows(found) == _rows(mixing.with_copies(mixing.sized(docs.repartition(7))))  # reruns agree
    whole = mixing.mix(docs)
    assert whole.columns == docs.columns
    assert {r.doc_id: r.n for r in whole.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).collect()} == {r.doc_id: r.copies for r in found.where("copies > 0").collect()}


def test_mixing_edges(spark):
    same = [(1, "hot", "one two three")] * 600  # rows that repeat are drawn one by one
    rows = [*same, (None, "hot", None), (2, None, "a b"), (3, "", " \t\n "), (4, "hot", "x"), (5, "long", "w " * 120_000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    found = mixing.with_copies(mixing.sized(docs)).collect()
    assert len(found) == len(rows) and {r.size for r in found if r.doc_id == 1} == {3}
    assert [r.size for r in found if r.doc_id in (None, 3)] == [0, 0] and [r.size for r in found if r.doc_id == 5] == [120_000]
    assert [(r.target, r.copies) for r in found if r.source == ""] == [(0.0, 0)]
    hot = [r for r in found if r.source == "hot"]
    assert hot[0].target == min(3 * hot[0].source_size, hot[0].target) and max(r.copies for r in found) <= 3
    assert mixing.with_copies(mixing.sized(docs.limit(0))).count() == 0
    words = spark.createDataFrame([("a b c",), ("\x0ba\x0c b\x1cc",), ("",), (None,)], "t string").select(mixing.words(F.col("t"))).collect()
    assert [r[0] for r in words] == [2, 2, 0, 0]


# --- operator 13 ---


def test_findclose_against_a_stack():
    random.seed(12)
    for n, block in ((1, 4), (3, 4), (40, 4), (300, 8), (3000, 64)):
        bits, opened = [], 0
        while len(bits) < 2 * n:
            up = opened == 0 or (bits.count(1) < n and random.random() < (0.5 if n < 100 else 0.9 if len(bits) % 400 < 250 else 0.1)) if sum(bits) < n else False
            bits.append(int(up))
            opened += 1 if up else -1
        tree, stack, want = trie.Parentheses(np.array(bits, bool), block), [], {}
        for i, b in enumerate(bits):
            if b:
                stack.append(i)
            else:
                want[stack.pop()] = i
        at = np.flatnonzero(bits)
        assert tree.findclose(at).tolist() == [want[i] for i in at]
        assert tree.rank(at).tolist() == list(range(1, n + 1))
        pairs = [sum(bits[k] == 1 and bits[k + 1] == 0 for k in range(i, want[i])) for i in at]
        assert tree.leaf_pairs(at, tree.findclose(at)).tolist() == pairs


def _plain_trie(convs):
    """{beginning: (conv_id, parent's, n_convs, n_children, n_leaves, saved, sha)} of {conv_id: [(role, text)]}."""
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    out = {}
    for node, mine in members.items():
        under = [x for x in members if x[: len(node)] == node]
        children = [x for x in under if len(x) == len(node) + 1]
        leaves = [x for x in under if not any(len(y) == len(x) + 1 and y[: len(x)] == x for y in under)]
        saved = sum((len(members[x]) - 1) * len(x[-1][1]) for x in under if x)
        ends = ",".join(str(c) for c in sorted(c for c in mine if len(convs[c]) == len(node)))
        out[node] = (min(mine), len(node), min(members[node[:-1]]) if node else None, len(mine), len(children), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest())
    return sorted(out.values(), key=str)


def _trie(spark, convs, shard_size):
    rows = [(c, t, *turn) for c, turns in convs.items() for t, turn in enumerate(turns)]
    turns = trie.numbered(spark.createDataFrame(rows, TURNS))
    ids = spark.createDataFrame([(c,) for c in convs], "conv_id long")
    nodes, ends = trie.prefix_trie(turns, ids, shard_size)
    out = nodes.join(ends, "node", "left").withColumn("sha", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)))
    return _rows(out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "sha"))


@pytest.mark.parametrize("shard_size", [2, 7, 1000])
def test_trie_in_shards_of_every_size(spark, shard_size):
    """Copies, beginnings of others, turnless and negative ids; small shards share most of their nodes."""
    random.seed(shard_size)
    said = [("user", "hi"), ("assistant", "yes"), ("user", "élan"), ("a", "b"), ("ab", "")]
    convs = {i - 3: [random.choice(said[: 2 + k % 4]) for k in range(random.choice((0, 1, 2, 4, 6)))] for i in range(60)}
    convs |= {1000 + i: convs[5] for i in range(25)}
    assert _trie(spark, convs, shard_size) == _plain_trie(convs)


def test_trie_edges(spark):
    rows = [(1, None, None, None), (1, 0, "user", "x"), (None, 0, "user", "lost"), (2, 0, "user", "a" * 200_000)] + [(3, 7, "user", "same")] * 3
    df = spark.createDataFrame([(*r, 5) for r in rows], TURNS + ", d int")
    nodes, _ = trie.prefix_trie(trie.numbered(df))
    got = sorted((r.conv_id, r.depth, r.n_convs, r.saved_tokens) for r in nodes.collect())
    assert got == [(1, 0, 3, 0), (1, 1, 1, 0), (1, 2, 1, 0), (2, 1, 1, 0), (3, 1, 1, 0), (3, 2, 1, 0), (3, 3, 1, 0)]
    nodes, ends = trie.prefix_trie(trie.numbered(df.limit(0)))
    assert nodes.count() == ends.count() == 0


def test_rebuilt_conversations(spark):
    import zlib

    convs = {c: [("user", f"{c}/{t}") for t in range(c % 5)] for c in (100, 102, 103, 104, 150, 199, 203, -101, 7, 12)}
    convs = {c: t for c, t in convs.items() if t}
    rows = [(c, t, *turn) for c, turns in convs.items() for t, turn in enumerate(turns)]
    turns = materialize(trie.numbered(spark.createDataFrame(rows, TURNS)), "turns")
    made, ids = trie.rebuilt(turns)
    got = {r.conv_id: len(r.chars) for r in trie.keys_of(made, ids).collect()}
    want = {}
    for c, own in convs.items():
        h, base = zlib.crc32(str(c).encode()) % 6, convs.get(c - int(np.fmod(c, 100)), [])
        want[c] = len(base[:h]) + len(own[h:])
    assert got == want
