"""Prefix trie of conversations in balanced parentheses, one part a shard (operator 13).

Conversations are sorted by their turns' digests and dealt to shards by ranges of that order. A
shard writes its trie as a row of opening and closing parentheses in depth-first order: `findclose`
delimits a node's subtree, the rank of "()" pairs counts its leaves, and cumulative arrays in
preorder give its members and its savings. What two shards share lies on the paths of their first
and last conversations, the spines; those nodes are merged afterwards.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from examlake.llm.common import join_by_key, materialize

#: Hex digits of a turn's digest in a conversation's key.
WIDTH = 32
#: Parentheses of one block whose least and greatest excess are kept.
BLOCK = 64
#: A shard is closed when it holds so many nodes; spines join it to the next.
SHARD_NODES = 262_144
ROOT = hashlib.sha256(b"").digest()[:16]


class Parentheses:
    """A row of balanced parentheses (1 opens) with the least and greatest excess of each block, in a tree of doubled spans."""

    def __init__(self, bits: np.ndarray, block: int = BLOCK):
        self.bits, self.block = bits, block
        self.excess = np.cumsum(np.where(bits, 1, -1))
        blocks = max(1, -(-len(bits) // block))
        size = 1 << (blocks - 1).bit_length()
        filled = np.full(size * block, np.iinfo(np.int64).max // 2)
        filled[: len(bits)] = self.excess
        self.padded = filled.reshape(size, block)
        self.least, self.most = [self.padded.min(axis=1)], [np.where(self.padded > len(bits), -1, self.padded).max(axis=1)]
        while len(self.least[-1]) > 1:
            self.least.append(self.least[-1].reshape(-1, 2).min(axis=1))
            self.most.append(self.most[-1].reshape(-1, 2).max(axis=1))
        self.opens = np.cumsum(bits)
        leaf = np.zeros(len(bits), np.int64)
        leaf[:-1] = bits[:-1] & ~bits[1:]
        self.leaves = np.cumsum(leaf)

    def findclose(self, at: np.ndarray) -> np.ndarray:
        """Places of the parentheses that close those at `at`: the first places behind where the excess is one less."""
        at = np.asarray(at, np.int64)
        want, out = self.excess[at] - 1, np.full(len(at), -1)
        block, inside = at // self.block, at % self.block
        todo = np.arange(len(at))
        # within the own block
        for k in range(1, self.block):
            todo = todo[inside[todo] + k < self.block]
            hit = self.padded[block[todo], inside[todo] + k] == want[todo]
            out[todo[hit]] = at[todo[hit]] + k
            todo = todo[~hit]
            if not len(todo):
                break
        todo = np.flatnonzero(out < 0)
        if not len(todo):
            return out
        # up the tree to a span behind whose least excess reaches the aim, then down to its first block
        node, level = block[todo].copy(), 0
        found = np.zeros(len(todo), bool)
        levels = np.zeros(len(todo), np.int64)
        going = np.ones(len(todo), bool)
        while going.any() and level < len(self.least) - 1:
            left = going & (node % 2 == 0)
            reach = np.zeros(len(todo), bool)
            reach[left] = self.least[level][node[left] + 1] <= want[todo[left]]
            node[reach] += 1
            levels[reach], found[reach] = level, True
            going &= ~reach
            node[going] //= 2
            level += 1
        assert found.all(), "the parentheses are not balanced"
        for level in range(int(levels.max()), 0, -1):
            down = levels >= level
            child = node[down] * 2
            node[down] = np.where(self.least[level - 1][child] <= want[todo[down]], child, child + 1)
        hit = self.padded[node] <= want[todo][:, None]
        out[todo] = node * self.block + hit.argmax(axis=1)
        return out

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Opening parentheses up to `at`, included."""
        return self.opens[at]

    def leaf_pairs(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Pairs "()" whose opening lies from start to end."""
        return self.leaves[end] - np.where(start > 0, self.leaves[start - 1], 0)


NODES = "shard string, node binary, parent binary, conv_id long, depth long, chars long, n_convs long, n_children long, n_leaves long, saved_tokens long, first boolean, last boolean, ends array<long>"


class _Shard:
    """Collects sorted conversations into one trie."""

    def __init__(self, name: str):
        self.name, self.bits = name, bytearray()
        self.node, self.parent, self.depth, self.chars = [], [], [], []
        self.path: list[int] = []
        self.key = None
        self.convs: list[int] = []
        self.ends: list[int] = []

    def add(self, conv_id: int, key: str, chars: list[int]) -> None:
        deep, shared = len(chars), 0
        if self.key is None:
            self._open(ROOT, -1, 0, 0)
        else:
            most = min(len(key), len(self.key)) // WIDTH
            while shared < most and key[shared * WIDTH : (shared + 1) * WIDTH] == self.key[shared * WIDTH : (shared + 1) * WIDTH]:
                shared += 1
            while len(self.path) > shared + 1:
                self.path.pop()
                self.bits.append(0)
        for d in range(shared, deep):
            above = self.path[-1]
            node = hashlib.sha256(self.node[above] + key[d * WIDTH : (d + 1) * WIDTH].encode()).digest()[:16]
            self._open(node, above, d + 1, chars[d])
        self.key = key
        self.convs.append(conv_id)
        self.ends.append(self.path[-1])

    def _open(self, node: bytes, above: int, depth: int, chars: int) -> None:
        self.path.append(len(self.node))
        self.bits.append(1)
        self.node.append(node)
        self.parent.append(above)
        self.depth.append(depth)
        self.chars.append(chars)

    def rows(self) -> Iterator[pa.RecordBatch]:
        n, last_path = len(self.node), set(self.path)
        first_path = set()
        at = self.ends[0]
        while at >= 0:
            first_path.add(at)
            at = self.parent[at]
        bits = np.frombuffer(bytes(self.bits) + bytes(len(self.path)), np.uint8).astype(bool)
        tree = Parentheses(bits)
        opening = np.flatnonzero(bits)
        closing = tree.findclose(opening)
        pre, end = tree.rank(opening) - 1, tree.rank(closing)  # a subtree is pre .. end - 1 in preorder
        parent, chars, ends, convs = np.array(self.parent), np.array(self.chars, np.int64), np.array(self.ends), np.array(self.convs, np.int64)
        stop = np.concatenate(([0], np.cumsum(np.bincount(ends, minlength=n))))
        n_convs = stop[end] - stop[pre]
        saved = np.concatenate(([0], np.cumsum((n_convs - 1) * chars)))
        # conversations stand in preorder of their ends, so a node's members are a range of them
        padded = np.append(convs, np.iinfo(np.int64).max)
        smallest = np.minimum.reduceat(padded, np.column_stack((stop[pre], stop[end])).ravel())[::2]
        children = np.bincount(parent[1:], minlength=n)
        flags = [np.isin(np.arange(n), list(p)) for p in (first_path, last_path)]
        columns = [smallest, np.array(self.depth, np.int64), chars, n_convs, children, tree.leaf_pairs(opening, closing), saved[end] - saved[pre], *flags]
        lists = pa.ListArray.from_arrays(pa.array(stop.astype(np.int32)), pa.array(convs))
        above = [None if p < 0 else self.node[p] for p in self.parent]
        table = pa.Table.from_arrays([pa.array([self.name] * n), pa.array(self.node, pa.binary()), pa.array(above, pa.binary()), *[pa.array(c) for c in columns], lists], [c.split()[0] for c in NODES.split(", ")])
        yield from table.to_batches(max_chunksize=20_000)


def shard_nodes(keys: DataFrame, shard_size: int = SHARD_NODES) -> DataFrame:
    """Nodes of each shard's trie (columns NODES) from conv_id, key, chars, dealt in ranges of key and conv_id.

    A shard's counts are of its own conversations; ends holds conv_ids that end at the node, ascending.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number, shard = TaskContext.get().partitionId(), 0, None
        for batch in batches:
            for conv_id, key, chars in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
                shard = shard or _Shard(f"{part:06d}-{number:06d}")
                shard.add(conv_id, key, chars)
                if len(shard.node) + len(shard.convs) >= shard_size:
                    yield from shard.rows()
                    shard, number = None, number + 1
        if shard:
            yield from shard.rows()

    return keys.select("conv_id", "key", "chars").repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id").mapInArrow(run, NODES)


def _halves(node: str) -> list[Column]:
    """The first 60 bits of each half of a node's 16 bytes, as two longs."""
    return [F.conv(F.substring(F.hex(node), 16 * k + 1, 15), 16, 10).cast("long").alias(f"k{k}") for k in (0, 1)]


def merged(nodes: DataFrame) -> DataFrame:
    """Nodes of all shards as one trie; nodes: as `shard_nodes` gives them, written.

    Off the spines a node is whole in its shard. On them, counts of conversations add up; a child or
    a leaf that k shards hold counts once, and a node's saving was taken with one copy too many for
    each shard but one. These corrections hold for all ancestors, which stand on the same spine: they
    are summed from the end of a path to the root, each node on the first path that has it.
    """
    spine = nodes.where("first or last")
    one = spine.groupBy("node").agg(
        *[F.first(c).alias(c) for c in ("parent", "depth", "chars")], F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("shards"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")], F.sum((F.col("n_children") == 0).cast("long")).alias("leaf_shards"),
    )
    one = materialize(one, "spine")
    twice = one.where("parent is not null").groupBy(F.col("parent").alias("above")).agg(F.sum(F.col("shards") - 1).alias("twice"))
    one = one.join(twice, F.col("node") == F.col("above"), "left").withColumn("n_children", F.col("n_children") - F.coalesce("twice", F.lit(0))).drop("above", "twice")
    leaf = (F.col("n_children") == 0).cast("long") - F.col("leaf_shards")
    one = materialize(one.withColumn("more_leaves", leaf).withColumn("more_saved", F.col("chars") * (F.col("shards") - 1)), "spine")
    sides = F.explode(F.filter(F.array(*[F.when(F.col(c), F.concat("shard", F.lit(f"-{c}"))) for c in ("first", "last")]), lambda x: x.isNotNull()))
    paths = spine.select("node", "depth", sides.alias("path"))
    least = paths.groupBy("node").agg(F.min("path").alias("own"))
    fixes = one.select("node", "more_leaves", "more_saved").join(least, "node")
    mine = (F.col("path") == F.col("own")).cast("long")
    below = Window.partitionBy("path").orderBy(F.desc("depth"))
    sums = paths.join(fixes, "node").select("node", *[F.sum(F.col(c) * mine).over(below).alias(c) for c in ("more_leaves", "more_saved")])
    sums = sums.groupBy("node").agg(*[F.sum(c).alias(c) for c in ("more_leaves", "more_saved")])
    fixed = one.drop("more_leaves", "more_saved").join(sums, "node").withColumns({"n_leaves": F.col("n_leaves") + F.col("more_leaves"), "saved_tokens": F.col("saved_tokens") + F.col("more_saved")})
    columns = ["node", "parent", "conv_id", "depth", "chars", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    return fixed.select(*columns).unionByName(nodes.where("not (first or last)").select(*columns))


def with_parents(trie: DataFrame) -> DataFrame:
    """Adds parent_conv_id, the parent's smallest member (null: the root); trie: a written table of `merged`."""
    above = materialize(trie.where("n_children > 0").select(*_halves("node"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("n")), "parents")
    found = join_by_key(trie.where("parent is not null").select("*", *_halves("parent")), above, ["k0", "k1"]).drop("k0", "k1")
    return found.unionByName(trie.where("parent is null").withColumn("parent_conv_id", F.lit(None).cast("long")))


def end_digests(nodes: DataFrame) -> DataFrame:
    """node, n_ends, ends_sha256: conv_ids that end at a node, ascending, joined by commas.

    Each node's ids pass one task in order and are hashed as they come.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, now, n = None, None, 0
        for batch in batches:
            out = []
            for key, conv_id in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if key != node:
                    if now:
                        out.append((node, n, now.hexdigest()))
                    node, now, n = key, hashlib.sha256(), 0
                now.update(f",{conv_id}".encode() if n else str(conv_id).encode())
                n += 1
            yield _ends(out)
        if now:
            yield _ends([(node, n, now.hexdigest())])

    rows = nodes.where(F.size("ends") > 0).select("node", F.explode("ends").alias("conv_id"))
    return rows.repartition("node").sortWithinPartitions("node", "conv_id").mapInArrow(run, "node binary, n_ends long, ends_sha256 string")


def _ends(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.binary(), pa.int64(), pa.string()))], ["node", "n_ends", "ends_sha256"])


def numbered(conversations: DataFrame) -> DataFrame:
    """conv_id, d (from 1), digest, chars of every turn; only digests of texts go on from here.

    Rows go by turn (null first), then role and text; null role or text reads as empty. Rows without
    conv_id belong to no conversation.
    """
    said = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")]
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), *said)
    rows = rows.withColumn("d", F.row_number().over(order).cast("long"))
    digest = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    return rows.select("conv_id", "d", F.substring(digest, 1, WIDTH).alias("digest"), F.length("text").cast("long").alias("chars"))


def keys_of(turns: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """conv_id, key (its turns' digests in a row), chars; ids may name conversations without a turn."""
    some = turns.select("conv_id", F.struct("d", "digest", "chars").alias("turn"))
    if ids is not None:
        some = some.unionByName(ids.select("conv_id", F.lit(None).cast(some.schema["turn"].dataType).alias("turn")))
    grouped = some.groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    return grouped.select("conv_id", F.array_join(F.transform("turns", lambda t: t["digest"]), "").alias("key"), F.transform("turns", lambda t: t["chars"]).alias("chars"))


def prefix_trie(turns: DataFrame, ids: DataFrame | None = None, shard_size: int = SHARD_NODES) -> tuple[DataFrame, DataFrame]:
    """(trie, ends) of conversations given as `numbered` turns; ids may name turnless ones.

    trie: node, parent, conv_id (the smallest member's), depth, chars, n_convs, n_children, n_leaves,
    saved_tokens, parent_conv_id, one row for each distinct beginning of a conversation, the empty
    one (the root) included. ends: as `end_digests`. Equal conversations end at one node; ties need no
    order. An empty table gives empty ones. A task holds one shard (`shard_size` nodes and
    conversations, or one longer conversation) and 40 bytes for each turn of a conversation, no text.
    """
    nodes = materialize(shard_nodes(keys_of(turns, ids), shard_size), "nodes")
    trie = materialize(merged(nodes), "trie")
    return with_parents(trie), end_digests(nodes)


def rebuilt(turns: DataFrame, most: int = 6, group: int = 100) -> tuple[DataFrame, DataFrame]:
    """(turns, ids): every conversation c begins with the first h turns of conversation c - c % group.

    h = crc32(c as text) % most; own turns after the first h follow. turns: as `numbered`, written.
    No base has more than 2 * group - 1 takers, each of most - 1 turns at most.
    """
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    ids = turns.select("conv_id").distinct().withColumn("h", h).withColumn("base", F.col("conv_id") - F.col("conv_id") % group)
    ids = materialize(ids, "ids")
    heads = turns.where(F.col("d") < most).select(F.col("conv_id").alias("base"), "d", "digest", "chars")
    taken = ids.where("h > 0").join(heads, "base").where("d <= h").select("conv_id", "d", "digest", "chars")
    own = turns.withColumn("h", h).where("d > h").drop("h")
    return own.unionByName(taken), ids.select("conv_id")
