"""Chat formatting of reply trees (operator 2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from examlake.llm.common import materialize

#: The template's own marks, then common chat control strings, which texts may hold.
TURN, BODY, END = "<|turn|>", "<|text|>", "<|end|>"
CONTROLS = (TURN, BODY, END, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|startoftext|>")
_ANY = "|".join("\\Q" + c + "\\E" for c in CONTROLS)
ESCAPE = rf"(\\*)({_ANY})"
UNESCAPE = rf"\\(\\*(?:{_ANY}))"


def escape(text):
    """A backslash before each control string and its own backslashes; `unescape` takes it off again."""
    return F.regexp_replace(text, F.lit(ESCAPE), F.lit(r"\\$1$2"))


def unescape(text):
    return F.regexp_replace(text, F.lit(UNESCAPE), F.lit("$1"))


def escape_role(role):
    """A role on one line: ~ becomes ~0 and a line break ~1, then as `escape`."""
    return escape(F.regexp_replace(F.regexp_replace(role, "~", "~0"), "\n", "~1"))


def unescape_role(role):
    return F.regexp_replace(F.regexp_replace(unescape(role), "~1", "\n"), "~0", "~")


def _rounds(nodes: DataFrame) -> int:
    """Doublings of reach that pass every chain of a tree: log2 of the most nodes in one tree."""
    most = nodes.groupBy("tree_id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
    return (most or 0).bit_length()


def without_cycles(nodes: DataFrame) -> DataFrame:
    """nodes (tree_id, node_id, parent_id, score) with each cycle of replies cut above its smallest node_id, which becomes a root.

    Pointers are doubled as in `with_depth`, with the smallest node passed on the way; what has not
    reached a root after log2 of the tree's nodes never will, and then points into its cycle.
    """
    at = nodes.where("parent_id is not null").select("tree_id", "node_id", F.col("parent_id").alias("up"), F.col("node_id").alias("least"))
    for _ in range(_rounds(nodes)):
        at = materialize(at, "cycles")
        far = at.select(F.col("tree_id").alias("t"), F.col("node_id").alias("n"), F.col("up").alias("up2"), F.col("least").alias("l2"))
        at = at.join(far, F.col("tree_id").eqNullSafe(F.col("t")) & (F.col("up") == F.col("n"))).select("tree_id", "node_id", F.col("up2").alias("up"), F.least("least", "l2").alias("least"))
    at = materialize(at, "cycles")
    inside = at.select(F.col("tree_id").alias("t"), F.col("up").alias("n")).distinct()
    roots = at.join(inside, F.col("tree_id").eqNullSafe(F.col("t")) & (F.col("node_id") == F.col("n")), "left_semi").where("node_id = least").select(F.col("tree_id").alias("t"), F.col("node_id").alias("root"))
    cut = nodes.join(roots, F.col("tree_id").eqNullSafe(F.col("t")) & (F.col("node_id") == F.col("root")), "left")
    return cut.select("tree_id", "node_id", F.when(F.col("root").isNull(), F.col("parent_id")).alias("parent_id"), "score")


def with_depth(nodes: DataFrame) -> DataFrame | None:
    """Adds `depth` (nodes from the root) and `total` (their scores' sum), by pointer jumping.

    nodes: tree_id, node_id, parent_id, score. Each round joins every node with the node its
    pointer reaches and doubles the reach, so a chain of n turns takes log2(n) joins. None if some
    pointers never end, as replies go round in a cycle.
    """
    at = nodes.select("tree_id", "node_id", F.col("parent_id").alias("up"), F.lit(1).cast("long").alias("depth"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("total"))
    at, rounds = materialize(at, "tree"), _rounds(nodes)
    while at.where("up is not null").limit(1).count():
        if rounds < 0:
            return None
        rounds -= 1
        far = at.select(F.col("tree_id").alias("t"), F.col("node_id").alias("n"), F.col("up").alias("up2"), F.col("depth").alias("d2"), F.col("total").alias("s2"))
        moved = at.where("up is not null").join(far, F.col("tree_id").eqNullSafe(F.col("t")) & (F.col("up") == F.col("n")), "left")
        moved = moved.select("tree_id", "node_id", F.col("up2").alias("up"), (F.col("depth") + F.coalesce("d2", F.lit(0))).alias("depth"), (F.col("total") + F.coalesce("s2", F.lit(0.0))).alias("total"))
        at = materialize(moved.unionByName(at.where("up is null")), "tree")
    return at.drop("up")


def ranked_leaves(nodes: DataFrame, at: DataFrame, per_tree: int = 1) -> DataFrame:
    """tree_id, leaf, branch (rank from 1), depth: leaves by mean path score, then depth, then id; `at` is `with_depth` of nodes."""
    parents = nodes.where("parent_id is not null").select(F.col("tree_id").alias("t"), F.col("parent_id").alias("p")).distinct()
    leaves = at.join(parents, F.col("tree_id").eqNullSafe(F.col("t")) & (F.col("node_id") == F.col("p")), "left_anti")
    order = Window.partitionBy("tree_id").orderBy(F.desc(F.col("total") / F.col("depth")), F.desc("depth"), "node_id")
    ranked = leaves.withColumn("branch", F.row_number().over(order)).where(F.col("branch") <= per_tree)
    return ranked.select("tree_id", F.col("node_id").alias("leaf"), "branch", "depth")


def path_nodes(nodes: DataFrame, leaves: DataFrame) -> DataFrame:
    """tree_id, branch, node_id, up_from_leaf for every node on the chosen root-to-leaf paths.

    Jump tables reach 1, 2, 4, ... parents up; taking them from the longest down doubles the set
    of path nodes each time, so the joins number log2 of the depth here too.
    """
    jump = nodes.where("parent_id is not null").select("tree_id", "node_id", F.col("parent_id").alias("up"))
    jumps = []
    while True:
        jump = materialize(jump, "jump")
        if not jump.limit(1).count():
            break
        jumps.append(jump)
        far = jump.select(F.col("tree_id").alias("t"), F.col("node_id").alias("n"), F.col("up").alias("up2"))
        jump = jump.join(far, F.col("tree_id").eqNullSafe(F.col("t")) & (F.col("up") == F.col("n"))).select("tree_id", "node_id", F.col("up2").alias("up"))
    path = leaves.select("tree_id", "branch", F.col("leaf").alias("node_id"), F.lit(0).cast("long").alias("up_from_leaf"))
    for k, table in reversed(list(enumerate(jumps))):
        path = materialize(path, "path")
        far = table.select(F.col("tree_id").alias("t"), F.col("node_id").alias("n"), "up")
        more = path.join(far, F.col("tree_id").eqNullSafe(F.col("t")) & (F.col("node_id") == F.col("n")))
        path = path.unionByName(more.select("tree_id", "branch", F.col("up").alias("node_id"), (F.col("up_from_leaf") + F.lit(1 << k)).alias("up_from_leaf")))
    return path


def format_paths(nodes: DataFrame, path: DataFrame) -> DataFrame:
    """One conversation for each (tree_id, branch): `segments` (text, loss) and `formatted`.

    Each turn is TURN role NEWLINE BODY NEWLINE text NEWLINE END NEWLINE, with control strings in
    role and text escaped; line breaks part text from marks, so no mark can form across a seam.
    The loss mask is the segments flagged `loss`: assistants' texts.
    """
    said = nodes.select(F.col("tree_id").alias("t"), F.col("node_id").alias("n"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = path.join(said, F.col("tree_id").eqNullSafe(F.col("t")) & F.col("node_id").eqNullSafe(F.col("n")))
    head = F.concat(F.lit(TURN), escape_role(F.col("role")), F.lit(f"\n{BODY}\n"))
    parts = F.array(F.struct(head.alias("text"), F.lit(False).alias("loss")), F.struct(escape(F.col("text")).alias("text"), (F.col("role") == "assistant").alias("loss")), F.struct(F.lit(f"\n{END}\n").alias("text"), F.lit(False).alias("loss")))
    turns = turns.select("tree_id", "branch", F.struct((-F.col("up_from_leaf")).alias("at"), parts.alias("parts")).alias("turn"))
    grouped = turns.groupBy("tree_id", "branch").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    segments = F.flatten(F.transform("turns", lambda t: t["parts"]))
    out = grouped.select("tree_id", "branch", segments.alias("segments"))
    return out.withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def read_back(formatted):
    """array<struct<role, text>> of the turns of a formatted conversation."""
    turns = F.filter(F.split(formatted, r"(?<!\\)\Q" + TURN + r"\E"), lambda x: x != "")
    body = f"\n{BODY}\n"

    def turn(x):
        at = F.instr(x, body)
        role = F.substr(x, F.lit(1), at - 1)
        rest = F.substr(x, at + F.lit(len(body)))
        return F.struct(unescape_role(role).alias("role"), unescape(F.substr(rest, F.lit(1), F.length(rest) - F.lit(len(f"\n{END}\n")))).alias("text"))

    return F.transform(turns, turn)


def loss_text(segments):
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")


def format_trees(nodes: DataFrame, per_tree: int = 1) -> DataFrame:
    """The best `per_tree` branches of each reply tree, each as one formatted conversation.

    nodes: tree_id, node_id, parent_id (null: a root), role, text, score. Null role or text counts
    as empty, a null score as 0; a parent_id that no row has ends the path there, and a cycle of
    replies is cut above its smallest node_id. Of rows with equal tree_id and node_id the first by
    parent_id, role, text and score stands; a null node_id is one node that no reply names. A null
    tree_id is a tree of its own. Branches are ranked by mean score, then depth, then the leaf's id.
    An empty table gives no rows; other columns are not read.
    """
    one = nodes.groupBy("tree_id", "node_id").agg(F.min(F.struct("parent_id", "role", "text", "score")).alias("x"))
    nodes = materialize(one.select("tree_id", "node_id", "x.parent_id", "x.role", "x.text", "x.score"), "nodes")
    known = nodes.select(F.col("tree_id").alias("t"), F.col("node_id").alias("n"))
    links = nodes.select("tree_id", "node_id", "parent_id", "score").join(known, F.col("tree_id").eqNullSafe(F.col("t")) & (F.col("parent_id") == F.col("n")), "left")
    links = materialize(links.select("tree_id", "node_id", F.col("n").alias("parent_id"), "score"), "links")
    if (at := with_depth(links)) is None:
        links = materialize(without_cycles(links), "links")
        at = with_depth(links)
    return format_paths(nodes, path_nodes(links, ranked_leaves(links, at, per_tree)))


def conversation_nodes(conversations: DataFrame) -> DataFrame:
    """Linear conversations as reply trees: each row answers the one before it by turn.

    Rows with the same turn follow each other by role and text; repeated rows are turns of their own.
    """
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), F.asc_nulls_first("role"), F.asc_nulls_first("text"))
    numbered = conversations.select("conv_id", "role", "text", F.row_number().over(order).cast("long").alias("node_id"))
    parent = F.when(F.col("node_id") > 1, F.col("node_id") - 1)
    return numbered.select(F.col("conv_id").alias("tree_id"), "node_id", parent.alias("parent_id"), "role", "text", F.length("text").cast("double").alias("score"))
