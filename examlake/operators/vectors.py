"""Chapters of questions by their vectors: products of blocks of both, in Arrow tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from examlake.functions import text as T
from examlake.operators.folds import typed

#: Vectors of one block: of questions, and of chapters with their titles, summaries and concepts.
QUESTION_BLOCK, CHAPTER_BLOCK = 1024, 1024
#: Weights of title, summary and concept; of the concept and the title where those tell more; the softmax's temperature.
TITLE, SUMMARY, CONCEPT = 0.15, 0.35, 0.5
STRONG_CONCEPT, TEMPERATURE = 0.85, 0.06


def unit_rows(vectors: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(rows of length 1, padded with zeros; their own lengths). A null, an empty or a zero vector, and one with a null in it, is a zero row of length -1."""
    flat = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    sizes = pc.fill_null(pc.list_value_length(flat), 0).to_numpy().astype(np.int64)
    values = pc.cast(flat.flatten(), pa.float64()).to_numpy(zero_copy_only=False)
    out = np.zeros((len(sizes), int(sizes.max(initial=0))))
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    norm = np.sqrt((out * out).sum(axis=1))
    known = np.isfinite(norm) & (norm > 0)
    out[~known] = 0
    out[known] /= norm[known, None]
    return out, np.where(known, sizes, -1)


def cosines(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Cosine of every row of a with every row of b; 0 where lengths differ or a vector is none."""
    width = min(a[0].shape[1], b[0].shape[1])
    same = (a[1][:, None] == b[1][None, :]) & (a[1][:, None] > 0)
    return np.where(same, a[0][:, :width] @ b[0][:, :width].T, 0.0)


def combined(t: np.ndarray, s: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Scores of title, summary and best concept; c is NaN for a chapter without concepts."""
    with_all = np.maximum(TITLE * t + SUMMARY * s + CONCEPT * c, STRONG_CONCEPT * c + (1 - STRONG_CONCEPT) * t)
    return np.where(np.isnan(c), (TITLE * t + SUMMARY * s) / (TITLE + SUMMARY), with_all)


def chapter_scores(questions: DataFrame, profiles: DataFrame, scope: list[str], k: int, concept_rows: DataFrame | None = None) -> DataFrame:
    """Scope, question_id, chapter_id, t, s, c: cosines of each question with its scope's likely chapters.

    Questions and chapters of one scope are dealt to blocks by hashes of their ids, as many as their
    numbers ask for; each task multiplies one block of questions with one of chapters and passes on
    the best k of each question, by score and chapter_id. A chapter with more concepts than a block
    holds is spread over blocks; all its partial cosines are passed on and the greatest counts.
    """
    keys = [*scope, "chapter_id"]
    concepts = profiles.select(*keys, F.explode("concepts").alias("concept")) if concept_rows is None else concept_rows.select(*keys, "concept")
    piece = F.pmod(F.xxhash64("concept"), F.greatest(F.ceil(F.col("n") / CHAPTER_BLOCK), F.lit(1)))
    counted = concepts.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    lists = concepts.join(counted, keys).withColumn("piece", piece).groupBy(*keys, "piece").agg(F.collect_list("concept").alias("concepts"), F.first("n").alias("n"))
    chapters = profiles.select(*keys, "title_embedding", "summary_embedding").join(lists, keys, "left").withColumn("n", F.coalesce("n", F.lit(0))).withColumn("piece", F.coalesce("piece", F.lit(0).cast("long")))
    deal = scope or ["__all"]
    if not scope:
        questions, chapters = questions.withColumn("__all", F.lit(1)), chapters.withColumn("__all", F.lit(1))
    known = lambda df: df.where(" and ".join(f"`{c}` is not null" for c in deal))
    questions, chapters = known(questions), known(chapters)
    weight = F.sum(F.lit(2) + F.size(F.coalesce("concepts", F.array().cast(chapters.schema["concepts"].dataType))))
    blocks = questions.groupBy(*deal).agg(F.ceil(F.count(F.lit(1)) / QUESTION_BLOCK).alias("q_blocks")).join(chapters.groupBy(*deal).agg(F.ceil(weight / CHAPTER_BLOCK).alias("c_blocks")), deal)
    q = questions.select(*deal, "question_id", "embedding").join(blocks, deal).withColumn("qb", F.pmod(F.xxhash64("question_id"), "q_blocks")).withColumn("cb", F.explode(F.sequence(F.lit(0).cast("long"), F.col("c_blocks") - 1))).drop("q_blocks", "c_blocks")
    c = chapters.join(blocks, deal).withColumn("cb", F.pmod(F.xxhash64("chapter_id", "piece"), "c_blocks")).withColumn("qb", F.explode(F.sequence(F.lit(0).cast("long"), F.col("q_blocks") - 1))).drop("q_blocks", "c_blocks")
    at = [*deal, "qb", "cb"]
    names = [*deal, "question_id", "chapter_id", "t", "s", "c"]

    def multiply(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        found = _best(left, right, k)
        own = [pa.array([v.as_py()] * len(found[0]), v.type) for v in key[: len(deal)]]
        return pa.Table.from_arrays([*own, *found], names)

    schema = ", ".join([typed(q, [*deal, "question_id"]), typed(c, ["chapter_id"]), "t double, s double, c double"])
    out = q.groupBy(*at).cogroup(c.groupBy(*at)).applyInArrow(multiply, schema)
    out = out.groupBy(*scope, "question_id", "chapter_id").agg(*[F.max(x).alias(x) for x in "tsc"])
    return out


def _best(left: pa.Table, right: pa.Table, k: int) -> list[pa.Array]:
    """question_id, chapter_id, t, s, c of each question's best k chapters of a block, and of every chapter that is spread over blocks."""
    ids, chapters = left.column("question_id").combine_chunks(), right.column("chapter_id").combine_chunks()
    if not len(ids) or not len(chapters):
        return [ids.slice(0, 0), chapters.slice(0, 0), *[pa.array([], pa.float64())] * 3]
    asked = unit_rows(left.column("embedding"))
    t, s = (cosines(asked, unit_rows(right.column(x))) for x in ("title_embedding", "summary_embedding"))
    lists = right.column("concepts").combine_chunks()
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy().astype(np.int64)
    c = np.full(t.shape, np.nan)
    if sizes.sum():
        each = cosines(asked, unit_rows(lists.flatten()))
        some = np.flatnonzero(sizes)
        c[:, some] = np.maximum.reduceat(each, (np.cumsum(sizes) - sizes)[some], axis=1)
    score = combined(t, s, c)
    spread = right.column("n").to_numpy() > CHAPTER_BLOCK
    by_name = np.argsort(pc.rank(chapters, tiebreaker="dense").to_numpy())
    whole = by_name[~spread[by_name]]
    best = whole[np.argsort(-score[:, whole], axis=1, kind="stable")[:, :k]]
    kept = np.concatenate([best, np.tile(np.flatnonzero(spread), (len(ids), 1))], axis=1)
    row = np.repeat(np.arange(len(ids)), kept.shape[1])
    column = kept.ravel()
    values = [x[row, column] for x in (t, s, c)]
    return [ids.take(pa.array(row)), chapters.take(pa.array(column)), *[pa.array(v, from_pandas=True) for v in values]]


def classify_vector(questions: DataFrame, profiles: DataFrame, k: int = 3, temperature: float = TEMPERATURE, concept_rows: DataFrame | None = None, scope: list[str] | None = None) -> DataFrame:
    """Top-k chapters of each question by cosine, their softmax, and a review status.

    A question meets the chapters of its owner and class: the columns of `scope`, by default those of
    owner_id and class_id that both tables have. Where they have neither, the caller must say
    scope=[] for every question to meet every chapter. questions: question_id, embedding; profiles:
    chapter_id, title_embedding, summary_embedding, concepts (array of vectors), or concept_rows
    (chapter_id, scope, concept) where they are many. owner_id, where it is in scope, comes first in the
    result. Questions without a chapter in scope give no rows; a missing vector scores 0.
    """
    if scope is None:
        scope = [c for c in ("owner_id", "class_id") if c in questions.columns and c in profiles.columns]
        if not scope:
            raise ValueError("no owner_id or class_id in both tables; scope=[] lets every question meet every chapter")
    scored = chapter_scores(questions, profiles, scope, k, concept_rows)
    t, s, c = (F.col(x) for x in "tsc")
    with_all = F.greatest(TITLE * t + SUMMARY * s + CONCEPT * c, STRONG_CONCEPT * c + (1 - STRONG_CONCEPT) * t)
    scored = scored.withColumn("score", F.when(c.isNull(), (TITLE * t + SUMMARY * s) / (TITLE + SUMMARY)).otherwise(with_all))
    key = [*scope, "question_id"]
    order = Window.partitionBy(*key).orderBy(F.desc("score"), "chapter_id")
    top = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    whole = Window.partitionBy(*key)
    e = F.exp((F.col("score") - F.max("score").over(whole)) / temperature)
    top = top.withColumn("e", e).withColumn("confidence", F.col("e") / F.sum("e").over(whole))
    owner = [c for c in scope if c == "owner_id"]
    return top.select(*owner, "question_id", "chapter_id", "rank", "confidence", T.review_status(F.col("confidence")).alias("review_status"))
