"""Conversation structure repair by weighted interval parsing (operator 11).

A repaired conversation reads (s?(ua)+)? in role initials. The states below follow that language;
nonterminal (p, q) derives a span of rows that leads from state p to state q. The rules
(p, q) -> (p, r) (r, q) are in Chomsky normal form, rows and their edits are the terminals, and what
the empty span derives by insertions alone is closed into every single row. A cell holds the least
(cost, audit) of its nonterminal over its span. Audits of one span and one cost are never proper
prefixes of each other (more letters would be insertions, which cost), so least cells make least
concatenations and the order is exact.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from examlake.llm.common import materialize

KEEP, REROLE, DELETE, INSERT = ("K", 0), ("R", 2), ("D", 3), ("I", 2)
TRUNCATED = 1
#: Rows of one chart; longer conversations join the charts' cells at spans of doubled length.
BLOCK = 32
START, SYSTEM, USER, REPLY = range(4)
#: Steps of the language: role initial -> (from, to).
STEPS = {"s": ((START, SYSTEM),), "u": ((START, USER), (SYSTEM, USER), (REPLY, USER)), "a": ((USER, REPLY),)}
PAIRS = ((START, START), (START, SYSTEM), (START, USER), (START, REPLY), (SYSTEM, SYSTEM), (SYSTEM, USER), (SYSTEM, REPLY), (USER, USER), (USER, REPLY), (REPLY, USER), (REPLY, REPLY))
RULES = [[(PAIRS.index((p, r)), PAIRS.index((r, q))) for r in range(4) if (p, r) in PAIRS and (r, q) in PAIRS] for p, q in PAIRS]
SPACE = " \t\n\x0b\f\r"
Cell = tuple[int, str] | None


def combine(left: list[Cell], right: list[Cell], out: list[Cell] | None = None) -> list[Cell]:
    """Cells of a span from those of its two parts; `out` holds the best of other splits."""
    out = [None] * len(PAIRS) if out is None else out
    for head, rules in enumerate(RULES):
        now = out[head]
        for x, y in rules:
            a, b = left[x], right[y]
            if a is None or b is None:
                continue
            cost = a[0] + b[0]
            if now is None or cost < now[0] or cost == now[0] and a[1] + b[1] < now[1]:
                now = (cost, a[1] + b[1])
        out[head] = now
    return out


def _insertions() -> list[Cell]:
    """The closure over the empty span: the cheapest insertions that lead from one state to another."""
    cells: list[Cell] = [(0, "") if p == q else None for p, q in PAIRS]
    for role in "ua":
        for step in STEPS[role]:
            cells[PAIRS.index(step)] = (INSERT[1], INSERT[0])
    for _ in PAIRS:
        cells = combine(cells, cells, list(cells))
    return cells


EMPTY = _insertions()


@functools.cache
def leaf(symbol: str) -> list[Cell]:
    """Cells of one row: x must go; s, u, a, o (another role) as they stand, upper case if truncated."""
    edits: list[Cell] = [(DELETE[1], DELETE[0]) if p == q else None for p, q in PAIRS]
    if symbol != "x":
        more = TRUNCATED * symbol.isupper()
        moves = [(step, REROLE) for role in "ua" for step in STEPS[role]] + [(step, KEEP) for step in STEPS.get(symbol.lower(), ())]
        for step, (letter, cost) in moves:
            at = PAIRS.index(step)
            edits[at] = min(x for x in (edits[at], (cost + more, letter)) if x)
    return combine(combine(EMPTY, edits), EMPTY)


def chart(symbols: str) -> list[Cell]:
    """Cells of the whole span: every span by length, over every split."""
    n = len(symbols)
    cells = {(i, i + 1): leaf(x) for i, x in enumerate(symbols)}
    for length in range(2, n + 1):
        for i in range(n - length + 1):
            best: list[Cell] = [None] * len(PAIRS)
            for k in range(i + 1, i + length):
                best = combine(cells[i, k], cells[k, i + length], best)
            cells[i, i + length] = best
    return cells[0, n] if n else EMPTY


def cheapest(cells: list[Cell]) -> tuple[int, str]:
    """(cost, audit) of the spans that read (s?(ua)+)?."""
    return min(x for x in (cells[PAIRS.index((START, START))], cells[PAIRS.index((START, REPLY))]) if x)


CELL_ROWS = "conv_id {id}, block long, last boolean, costs array<long>, audits array<string>"


def _pack(cells: list[Cell]) -> tuple[list, list]:
    return [c and c[0] for c in cells], [c and c[1] for c in cells]


def _unpack(part: dict) -> list[Cell]:
    return [None if a is None else (c, a) for c, a in zip(part["costs"], part["audits"], strict=True)]


def _cells_of(ids: pa.Array, blocks: pa.Array, last: pa.Array, cells: list[list[Cell]]) -> pa.RecordBatch:
    packed = [_pack(c) for c in cells]
    return pa.RecordBatch.from_arrays([ids, blocks, last, pa.array([c for c, _ in packed], pa.list_(pa.int64())), pa.array([a for _, a in packed], pa.list_(pa.string()))], ["conv_id", "block", "last", "costs", "audits"])


def _parse_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen = functools.lru_cache(100_000)(chart)
    for b in batches:
        yield _cells_of(b.column(0), b.column(1), b.column(2), [seen(s) for s in b.column(3).to_pylist()])


def _join_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield _cells_of(b.column(0), b.column(1), b.column(2), [functools.reduce(combine, map(_unpack, parts)) for parts in b.column(3).to_pylist()])


def with_faults(rows: DataFrame) -> DataFrame:
    """conv_id, pos (from 0), turn, role, text, fault, symbol, and flags new_turn, illegal and last.

    Rows go by turn (null first), then role and text; null role or text reads as one space. fault is
    the first of blank (no character but space), duplicate (role and text stand earlier) and
    truncated (the last such character is none of .!?), else null.
    """
    rows = rows.select("conv_id", F.col("turn").cast("long"), *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")])
    rows = rows.repartition("conv_id")
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text", "seen")
    same = Window.partitionBy("conv_id", "role", "text").orderBy(F.asc_nulls_first("turn"))
    rows = rows.withColumn("seen", F.row_number().over(same) > 1)
    bare = F.rtrim("text", F.lit(SPACE))
    fault = F.when(bare == "", "blank").when(F.col("seen"), "duplicate").when(~F.substring(bare, -1, 1).isin(".", "!", "?"), "truncated")
    initial = F.substring("role", 1, 1)
    kind = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    rows = rows.withColumn("fault", fault).withColumn("initial", initial)
    symbol = F.when(F.col("fault").isin("blank", "duplicate"), "x").when(F.col("fault") == "truncated", F.upper(kind)).otherwise(kind)
    pair = F.concat(F.lag("initial").over(order), F.col("initial"))
    earlier = F.lag(F.struct("turn")).over(order)
    new_turn = F.col("turn").isNotNull() & (earlier.isNull() | ~earlier["turn"].eqNullSafe(F.col("turn")))
    flags = {"new_turn": new_turn, "illegal": F.coalesce(~pair.isin("su", "ua", "au"), F.lit(False)), "last": F.lead(F.lit(True), 1, False).over(order) == F.lit(False)}
    pos = (F.row_number().over(order) - 1).cast("long")
    return rows.select("conv_id", pos.alias("pos"), "turn", "role", "text", "fault", symbol.alias("symbol"), *[f.alias(k) for k, f in flags.items()])


def parsed(rows: DataFrame) -> DataFrame:
    """conv_id, cost, audit of the cheapest repair of each conversation; rows as `with_faults` gives them, written.

    Blocks of up to 32 rows are parsed in one chart each; then neighbours are joined in rounds, the
    span doubling each time. One split a span is enough there: a derivation passes every place in
    some state, so all splits of a span have the same least cell.
    """
    kind = rows.schema["conv_id"].dataType.simpleString()
    blocks = rows.groupBy("conv_id", F.floor(F.col("pos") / BLOCK).alias("block")).agg(F.max("last").alias("last"), F.array_sort(F.collect_list(F.struct("pos", "symbol"))).alias("x"))
    blocks = blocks.select("conv_id", "block", "last", F.array_join(F.transform("x", lambda r: r["symbol"]), "").alias("symbols"))
    # few bytes and much work: dealt to a given number of tasks, which the optimizer does not join
    blocks = blocks.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("conv_id", "block"))
    cells, done = materialize(blocks.mapInArrow(_parse_blocks, CELL_ROWS.format(id=kind)), "cells"), []
    whole = (F.col("block") == 0) & F.col("last")
    while True:
        done.append(cells.where(whole))
        cells = cells.where(~whole)
        if not cells.limit(1).count():
            break
        pairs = cells.groupBy("conv_id", F.floor(F.col("block") / 2).alias("block")).agg(F.max("last").alias("last"), F.array_sort(F.collect_list(F.struct("block", "costs", "audits"))).alias("parts"))
        cells = materialize(pairs.mapInArrow(_join_pairs, CELL_ROWS.format(id=kind)), "cells")
    found = functools.reduce(DataFrame.unionByName, done)
    ends = [F.struct(F.col("costs")[i].alias("cost"), F.col("audits")[i].alias("audit")) for i in (PAIRS.index((START, START)), PAIRS.index((START, REPLY)))]
    best = F.array_min(F.filter(F.array(*ends), lambda x: x["cost"].isNotNull()))
    return found.select("conv_id", best.alias("best")).select("conv_id", "best.cost", "best.audit")


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of repaired conversations; each conversation's audit comes before its rows, in order."""
    conv, letters, at, state, place, kind = None, "", 0, START, 0, pa.null()
    out: list[tuple] = []

    def put(letter: str, role: str | None, text: str) -> None:
        nonlocal state, place
        if letter == "K" and role[0] == "s":
            state = SYSTEM
        else:
            state = REPLY if state == USER else USER
        role = role if letter == "K" else "assistant" if state == REPLY else "user"
        out.append((conv, place, role, text, letter))
        place += 1

    def insertions() -> None:
        nonlocal at
        while at < len(letters) and letters[at] == "I":
            put("I", None, "")
            at += 1

    for batch in batches:
        kind = batch.schema.field(0).type
        for conv_id, pos, role, text in zip(*[batch.column(i).to_pylist() for i in range(4)], strict=True):
            if pos < 0:
                insertions()
                conv, letters, at, state, place = conv_id, text, 0, START, 0
                continue
            insertions()
            letter = letters[at]
            at += 1
            if letter != "D":
                put(letter, role, text)
        yield _turns(out, kind)
        out.clear()
    insertions()
    if out:
        yield _turns(out, kind)


def _turns(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    kinds = (kind, pa.int64(), pa.string(), pa.string(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["conv_id", "place", "role", "text", "edit"])


def repaired(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """conv_id, place (from 0), role, text, edit (K, R or I) of each repaired turn.

    A conversation's rows follow its audit through one task, one at a time; its turns come out in
    order, in one partition.
    """
    kind = rows.schema["conv_id"].dataType.simpleString()
    first = audits.select("conv_id", F.lit(-1).cast("long").alias("pos"), F.lit("").alias("role"), F.col("audit").alias("text"))
    stream = first.unionByName(rows.select("conv_id", "pos", "role", "text")).repartition("conv_id").sortWithinPartitions("conv_id", "pos")
    return stream.mapInArrow(_apply, f"conv_id {kind}, place long, role string, text string, edit string")


def turn_digests(turns: DataFrame) -> DataFrame:
    """conv_id, sha256 (hex digest of `role:text`, joined by line breaks) of turns as `repaired` gives them."""
    kind = turns.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, now, type_ = None, None, pa.null()
        for batch in batches:
            ids, out, type_ = [], [], batch.schema.field(0).type
            for conv_id, place, role, text in zip(*[batch.column(i).to_pylist() for i in range(4)], strict=True):
                if place == 0:
                    if now:
                        ids.append(conv)
                        out.append(now.hexdigest())
                    conv, now = conv_id, hashlib.sha256()
                else:
                    now.update(b"\n")
                now.update(f"{role}:{text}".encode())
            yield pa.RecordBatch.from_arrays([pa.array(ids, type_), pa.array(out, pa.string())], ["conv_id", "sha256"])
        if now:
            yield pa.RecordBatch.from_arrays([pa.array([conv], type_), pa.array([now.hexdigest()], pa.string())], ["conv_id", "sha256"])

    return turns.select("conv_id", "place", "role", "text").mapInArrow(run, f"conv_id {kind}, sha256 string")


def counts(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal of rows as `with_faults` gives them."""
    of = [F.sum((F.col("fault") == k).cast("long")).alias(k) for k in ("blank", "duplicate", "truncated")]
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.sum(F.col("new_turn").cast("long")), F.lit(0)).cast("long")
    found = rows.groupBy("conv_id").agg(gaps.alias("gaps"), *of, F.sum(F.col("illegal").cast("long")).alias("illegal"))
    return found.select("conv_id", "gaps", *[F.coalesce(k, F.lit(0).cast("long")).alias(k) for k in ("blank", "duplicate", "truncated")], "illegal")


def repair(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(report, turns) of conversations (conv_id, turn, role, text; other columns are not read).

    report: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit; turns: as `repaired`.
    A null conv_id is a conversation. A null turn goes first, null role or text is one space (so such
    a text is blank and such a role no speaker's). Rows of one turn go by role and text. Repeated rows
    are duplicates, and a conversation all of whose rows must go is left without turns. An empty
    table gives empty tables. A conversation passes one task row by row, so its texts are never held
    together; one letter and some forty bytes a row are.
    """
    rows = materialize(with_faults(conversations), "rows")
    audits = materialize(parsed(rows), "audits")
    joined = counts(rows).join(audits.withColumnRenamed("conv_id", "__conv"), F.col("conv_id").eqNullSafe(F.col("__conv"))).drop("__conv")
    return joined, repaired(rows, audits)


def damaged(conversations: DataFrame) -> DataFrame:
    """conversations with every row's fate drawn from crc32(`conv_id:turn`) % 20, null as one space.

    0 drops the row, 1 empties its text, 2 takes its [.!?] out, 3 repeats it, 4 makes its role user.
    """
    space = F.lit(" ")
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), space) for c in ("conv_id", "turn")])
    fate = F.crc32(key.cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", fate.alias("fate"), F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text")).where("fate <> 0")
    text = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times = F.explode(F.when(F.col("fate") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", F.when(F.col("fate") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), times.alias("copy")).drop("copy")
