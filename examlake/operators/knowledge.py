"""Syllabus knowledge: concept names, build results, chapter profiles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from examlake.functions import text as T
from examlake.operators.catalog import merge_by_key
from examlake.operators.provider import Provider, vectors_of
from examlake.operators.scans import keys_of
from examlake.sources.written import written

#: Fixed value: most concepts a chapter.
MOST_CONCEPTS = 30
#: Why a build failed.
NO_FILE = "The syllabus file is not in storage."
NO_TEXT = "No text was found in the syllabus file."
NO_CONCEPTS = "The syllabus gave no concepts."


def concept_key(name: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(name), r"[^a-z0-9_\s]", " "), r"\s+", " "))


def concept_names(concepts: DataFrame) -> DataFrame:
    """Chapter keys, position from 0, concept_name: the first spelling of each concept (chapter keys, pos, name), 30 at most.

    Names that are null or have no letter, digit or underscore are dropped.
    """
    rows = concepts.withColumn("__key", concept_key(F.col("name"))).where(F.col("__key") != "")
    keys = keys_of(concepts, keys=("chapter_id",))
    first = rows.groupBy(*keys, "__key").agg(F.min(F.struct("pos", "name")).alias("f"))
    w = Window.partitionBy(*keys).orderBy("f.pos", "f.name")
    placed = first.select(*keys, (F.row_number().over(w) - 1).alias("position"), F.trim(F.col("f.name")).alias("concept_name"))
    return placed.where(F.col("position") < MOST_CONCEPTS)


def build_knowledge(materials: DataFrame, concepts: DataFrame, vectors: DataFrame | Provider) -> tuple[DataFrame, DataFrame]:
    """(knowledge, chapter_concepts) of every chapter with a syllabus, by its newest file.

    materials: chapter_id, chapter_name, material_id, created_at, text (null: the file can't be had),
    summary, matches_chapter, error; concepts: chapter_id, pos, name; vectors: input, embedding, unique
    on input, looked up by chapter name, summary and concept name, or a provider that is asked for them
    once each. A chapter is `complete`, or `failed`
    with the reason; a failure without text or concepts still keeps the title's vector.
    """
    keys = keys_of(materials, concepts, keys=("chapter_id",))
    newest = materials.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in materials.columns if c not in keys]), F.struct("created_at", "material_id")).alias("m")).select(*keys, "m.*")
    named = concept_names(concepts.select(*keys, "pos", "name"))
    if callable(vectors):
        texts = [newest.select(F.col(c).alias("input")) for c in ("chapter_name", "summary")] + [named.select(F.col("concept_name").alias("input"))]
        vectors = written(vectors_of(reduce(DataFrame.unionByName, texts), vectors), "vectors")
    counts = named.groupBy(*keys).agg(F.count(F.lit(1)).alias("found"))
    rows = newest.join(counts, keys, "left")
    blank = ~F.coalesce(F.col("text").rlike(r"\S"), F.lit(False))
    reason = F.when(F.col("text").isNull(), NO_FILE).when(blank, NO_TEXT).when(F.col("error").isNotNull(), F.col("error")).when(F.coalesce("found", F.lit(0)) == 0, NO_CONCEPTS)
    rows = rows.withColumn("__why", reason)
    done = F.col("__why").isNull()
    keeps_title = done | (F.col("text").isNotNull() & (F.col("error").isNull() | blank))
    title = vectors.select(F.col("input").alias("chapter_name"), F.col("embedding").alias("__title"))
    summary = vectors.select(F.col("input").alias("summary"), F.col("embedding").alias("__summary"))
    rows = rows.join(title, "chapter_name", "left").join(summary, "summary", "left")
    off = done & ~F.coalesce("matches_chapter", F.lit(True))
    knowledge = rows.select(
        *keys, "material_id", "chapter_name",
        F.when(done, F.col("summary")).alias("summary"),
        F.when(keeps_title, F.col("__title")).alias("title_embedding"),
        F.when(done, F.col("__summary")).alias("summary_embedding"),
        F.when(done, "complete").otherwise("failed").alias("extract_status"),
        F.col("__why").alias("extract_error"), off.alias("mismatch_warning"),
        F.when(done, F.col("found")).otherwise(0).cast("int").alias("concept_count"),
    )
    built = named.join(knowledge.where("extract_status = 'complete'").select(*keys), keys, "left_semi")
    by_name = vectors.select(F.col("input").alias("concept_name"), F.col("embedding").alias("concept_embedding"))
    return knowledge, built.join(by_name, "concept_name", "left").select(*keys, "position", "concept_name", "concept_embedding")


def chapter_profiles(knowledge: DataFrame, concepts: DataFrame) -> DataFrame:
    """Chapter keys, title_embedding, summary_embedding, concepts (vectors by position); chapters with no vector are left out."""
    keys = keys_of(knowledge, concepts, keys=("chapter_id",))
    scope = [c for c in ("class_id",) if c in knowledge.columns]
    per = concepts.where(F.col("concept_embedding").isNotNull()).groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "concept_embedding"))), lambda c: c["concept_embedding"]).alias("concepts"))
    rows = knowledge.select(*keys, *scope, "title_embedding", "summary_embedding").join(per, keys, "left")
    return rows.where(F.coalesce("title_embedding", "summary_embedding").isNotNull() | F.col("concepts").isNotNull())


def middle_out(text: Column, most: int = 12_000) -> Column:
    """Head and tail of a text longer than `most` characters, with a mark between."""
    t = T.strip(text)
    half = most // 2
    return F.when(F.length(t) <= most, t).otherwise(F.concat(F.substring(t, 1, half), F.lit("\n\n[…]\n\n"), F.right(t, F.lit(half))))


#: What a build leaves in a row of stored knowledge.
PAYLOAD = ("summary", "title_embedding", "summary_embedding", "extract_error", "extracted_at")


def mark_pending(stored: DataFrame, chapters: DataFrame) -> DataFrame:
    """stored knowledge with the chapters to be built pending: payload and counts reset, by (owner_id, chapter_id).

    chapters: owner_id, chapter_id, class_id, unit_id, material_id, chapter_name; those without a row get
    one, with the id owner_id/chapter_id. Other rows stay.
    """
    null = {c: F.lit(None).cast(stored.schema[c].dataType) for c in PAYLOAD}
    rows = chapters.withColumns({**null, "extract_status": F.lit("pending"), "mismatch_warning": F.lit(False), "concept_count": F.lit(0)})
    return _with_ids(merge_by_key(stored, rows, ["owner_id", "chapter_id"]))


def finish_builds(stored: DataFrame, concepts: DataFrame, built: DataFrame, named: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(stored, concepts) with results of `build_knowledge` put in by (owner_id, chapter_id), and the built chapters' concepts replaced.

    concepts: owner_id, chapter_id, syllabus_knowledge_id, concept_name, concept_embedding, position. A
    failed build leaves its chapter without concepts. Chapters without a result stay as they are,
    pending ones too; running it twice changes nothing.
    """
    keys = ["owner_id", "chapter_id"]
    rows = _with_ids(merge_by_key(stored, built.withColumn("extracted_at", now), keys))
    ids = rows.select(*keys, F.col("id").alias("syllabus_knowledge_id"))
    clean = named.withColumn("concept_name", T.repair_escapes(F.col("concept_name"))).join(ids, keys)
    return rows, concepts.join(built.select(*keys).distinct(), keys, "left_anti").unionByName(clean.select(*concepts.columns))


def _with_ids(stored: DataFrame) -> DataFrame:
    return stored.withColumn("id", F.coalesce("id", F.concat_ws("/", F.col("owner_id").cast("string"), F.col("chapter_id").cast("string"))))
