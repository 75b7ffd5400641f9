"""Mixing of sources to target weights (operator 12), with DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from examlake.llm.common import fresh_name, join_by_key, materialize

#: Weights of the sources in their order, repeating; how often a document may be taken at most.
WEIGHTS, MOST = (5, 2, 1), 3
SPACE = " \t\n\x0b\f\r"


def words(text: Column) -> Column:
    """Number of words [^\\x20\\x09-\\x0D]+; null counts as 0. Each word becomes one character with the space behind it."""
    marks = F.regexp_replace(F.ltrim(text, F.lit(SPACE)), r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*", "x")
    return F.coalesce(F.length(marks), F.lit(0)).cast("long")


def sized(docs: DataFrame) -> DataFrame:
    """docs with `size`, the words of `text`; a column of that name is replaced."""
    return docs.withColumn("size", words(F.col("text").cast("string")))


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST) -> DataFrame:
    """Adds `weight` and `target` to a table of one row a source: source, source_size.

    Sources in order of code point, null last, get the weights in turn. Targets share the sum of all
    sizes by weight; none goes beyond `most` times its source's size, and what is above is shared
    again by weight. This ends where target = min(cap, weight * level): sources sorted by
    cap / weight are capped as long as the level of those not yet capped reaches their cap, so two
    windows over the sources find it. They hold one row a source, whatever the number of documents.
    """
    place = F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1
    cycle = F.array(*[F.lit(w) for w in weights])
    rows = sizes.withColumn("weight", F.element_at(cycle, (place % len(weights) + 1).cast("int")).cast("long"))
    rows = rows.withColumn("__cap", F.col("source_size") * most).withColumn("__all", F.sum("source_size").over(Window.partitionBy())).withColumn("__weights", F.sum("weight").over(Window.partitionBy()))
    before = Window.orderBy(F.col("__cap") / F.col("weight"), F.asc_nulls_last("source")).rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("__all") - F.coalesce(F.sum("__cap").over(before), F.lit(0))
    weight_left = F.col("__weights") - F.coalesce(F.sum("weight").over(before), F.lit(0))
    rows = rows.withColumn("__capped", F.col("__cap").cast("double") * weight_left <= left.cast("double") * F.col("weight"))
    taken = [F.sum(F.when(F.col("__capped"), F.col(c)).otherwise(0)).over(Window.partitionBy()) for c in ("__cap", "weight")]
    level = F.try_divide((F.col("__all") - taken[0]).cast("double"), (F.col("__weights") - taken[1]).cast("double"))
    target = F.when(F.col("__capped"), F.col("__cap").cast("double")).otherwise(F.col("weight") * level)
    return rows.withColumn("target", target).drop("__cap", "__all", "__weights", "__capped")


def chance(*parts: Column | str) -> Column:
    """A number in [0, 1) drawn from the MD5 of the parts, joined by colons; null reads as 'null'."""
    key = F.concat_ws(":", *[F.coalesce(F.col(p).cast("string") if isinstance(p, str) else p.cast("string"), F.lit("null")) for p in parts])
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def with_copies(rows: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST, seed: int = 12) -> DataFrame:
    """Adds source_size, target, rate and copies (how often the mix takes the row) to rows of doc_id, source, size.

    rate is target / source_size; a row is taken floor(rate) times and once more with a probability
    of the fraction, drawn from a hash of seed, doc_id and the row's number among those of its
    doc_id, so reruns agree and repeated rows are drawn each on its own. A null doc_id is an id, a
    null source a source (the last one). A source without a word has target 0 and copies 0. Columns
    of rows that are called as the new ones are replaced; an empty table gives an empty one.

    Sources' sums are taken before anything is shuffled by source; sources that hold many rows are
    joined by broadcast (10,000 at most, by arithmetic), others by a shuffle.
    """
    made = ("source_size", "target", "rate", "copies")
    rows = rows.drop(*[c for c in rows.columns if c.lower() in made])
    own = rows.columns
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.asc_nulls_last("source"), "size", F.xxhash64(*own)))
    u = fresh_name(rows, "__chance")
    drawn = rows.withColumn(u, number)
    drawn = drawn.withColumn(u, chance(F.lit(seed), "doc_id", u))
    keys = [F.xxhash64(F.lit(k), F.col("source").isNull(), "source") for k in (1, 2)]
    sums = rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("source_size"))
    known = targets(sums, weights, most).select(keys[0].alias("k0"), keys[1].alias("k1"), "n", "source_size", "target")
    known = materialize(known, "sources")
    big = drawn.select(F.struct(*own, u).alias("row"), keys[0].alias("k0"), keys[1].alias("k1"))
    found = join_by_key(big, known, ["k0", "k1"]).select(*[F.col("row")[c].alias(c) for c in (*own, u)], "source_size", "target")
    rate = F.coalesce(F.try_divide(F.col("target"), F.col("source_size").cast("double")), F.lit(0.0))
    found = found.withColumn("rate", rate)
    whole = F.floor("rate")
    return found.withColumn("copies", whole + (F.col(u) < F.col("rate") - whole).cast("long")).drop(u)


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST, seed: int = 12) -> DataFrame:
    """Each document as often as `with_copies` takes it, with the columns of docs only; null text has no words."""
    given, inside = fresh_name(docs, "__given"), fresh_name(docs, "__copy")
    rows = docs.select(F.struct(*docs.columns).alias(given), *[F.col(c) for c in ("doc_id", "source")], words(F.col("text").cast("string")).alias("size"))
    times = F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias(inside)
    return with_copies(rows, weights, most, seed).where("copies > 0").select(given, times).select(f"{given}.*")
