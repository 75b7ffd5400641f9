"""Chapters for questions: by key words, by given assignments, by teachers' overrides.

A class's chapters ride as one array a class (a syllabus has tens of chapters), so a question stays one
row: nothing is multiplied by the number of chapters and the only shuffles are on class or paper.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from examlake.functions import text as T
from examlake.operators.scans import keys_of

ASSIGNED = ["chapter_id", "unit_id", "chapter_name", "chapter_confidence"]
_CHAPTER_NO = r"(?i)chapter[-\s]*(\d+)"


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def _last_part(c: Column, separator: str) -> Column:
    part = _strip(F.element_at(F.split(c, separator), -1))
    return F.when(part != "", part).otherwise(c)


def chapter_key(name: Column) -> Column:
    """The telling part of a chapter's name: `Chapter 12: Electric Charges` -> `electric charges`."""
    part = _last_part(_last_part(F.lower(F.coalesce(name, F.lit(""))), ":"), " - ")
    return _strip(F.regexp_replace(part, r"^chapter[-\s]*\d+[:.\s]*", ""))


def chapter_number(label: Column) -> Column:
    """The number behind `chapter`, null where there is none."""
    return F.regexp_extract(label, _CHAPTER_NO, 1).try_cast("long")


def chapters_by_class(chapters: DataFrame) -> DataFrame:
    """class_id (and owner_id, where chapters have it), chapters: the class's chapters in their order, with key, key words and probes.

    A text that holds none of a chapter's probes (its words, else its key) scores nothing for it.
    """
    key = chapter_key(F.col("name"))
    words = F.filter(F.split(key, r"\W+"), lambda w: F.length(w) > 3)
    one = F.struct("chapter_pos", "chapter_id", "unit_id", "name", key.alias("key"), words.alias("words"), F.when(F.size(words) > 0, words).otherwise(F.array(key)).alias("probes"), F.lower("name").alias("low"), chapter_number(F.col("name")).alias("number"))
    return chapters.groupBy(*keys_of(chapters, keys=("class_id",))).agg(F.array_sort(F.collect_list(one)).alias("chapters"))


def _keyword_score(text: Column, c: Column) -> Column:
    hit = (F.length(c["key"]) >= 4) & F.contains(text, c["key"])
    by_words = F.aggregate(c["words"], F.lit(0), lambda n, w: n + F.when(F.contains(text, w), F.length(w)).otherwise(0), lambda n: F.when(n >= 10, n).otherwise(0))
    return F.when(hit, F.length(c["key"]) + 40).otherwise(by_words)


def classify_keyword(questions: DataFrame, chapters: DataFrame) -> DataFrame:
    """questions with the chapter whose name the text holds, or whose words it holds most of; ties: the first.

    Needs class_id and question_text. No match, a null text or a class without chapters: nulls.
    """
    of_class = keys_of(questions, chapters, keys=("class_id",))
    rows = T.worked_out(questions.drop(*ASSIGNED), __text=F.lower(F.coalesce("question_text", F.lit("")))).join(chapters_by_class(chapters), of_class, "left")
    text = F.col("__text")
    some = F.filter("chapters", lambda c: F.exists(c["probes"], lambda w: F.contains(text, w)))
    scored = F.transform(some, lambda c: F.struct(_keyword_score(text, c).alias("score"), (-c["chapter_pos"]).alias("early"), c["chapter_id"].alias("chapter_id"), c["unit_id"].alias("unit_id"), c["name"].alias("name")))
    rows = T.worked_out(rows, __best=F.array_max(scored)).drop("chapters", "__text")
    best, found = F.col("__best"), F.col("__best.score") > 0
    sure = F.least(F.lit(88), F.floor(35 + F.least(best["score"], F.lit(40)) * F.lit(1.2) + 0.5)).cast("int")
    put = {"chapter_id": best["chapter_id"], "unit_id": best["unit_id"], "chapter_name": best["name"], "chapter_confidence": sure}
    return rows.select("*", *[F.when(found, c).alias(k) for k, c in put.items()]).drop("__best")


def resolve_chapter(chapters: Column, chapter_id: Column, chapter_name: Column) -> Column:
    """The chapter meant: by id, by equal name, by a name inside the other, by number; null if none."""
    raw = F.lower(_strip(F.coalesce(chapter_name, F.lit(""))))
    number = F.coalesce(chapter_number(raw), chapter_number(F.coalesce(chapter_id, F.lit(""))))

    def first(test) -> Column:
        return F.get(F.filter(chapters, test), 0)

    def meant(told: Column) -> Column:
        raw, number = told["raw"], told["number"]
        return F.coalesce(
            first(lambda c: c["chapter_id"] == chapter_id),
            first(lambda c: (raw != "") & (c["low"] == raw)),
            first(lambda c: (raw != "") & (F.contains(c["low"], raw) | F.contains(raw, c["low"]))),
            first(lambda c: c["number"] == number),
        )

    return T.once(F.struct(raw.alias("raw"), number.alias("number")), meant)


def _chosen(changed: Column, values: dict[str, Column], rest: list[str]) -> list[Column]:
    return [F.col(c) for c in rest] + [F.when(changed, v).otherwise(F.col(c)).alias(c) for c, v in values.items()]


def apply_assignments(questions: DataFrame, assignments: DataFrame, chapters: DataFrame) -> DataFrame:
    """questions with the chapters that `assignments` (paper_id, question_no, pos, chapter_id, chapter_name, confidence) give.

    Of several for one number the last by pos counts. One that names no known chapter clears the
    question's chapter; a question without any keeps what it has.
    """
    last = F.max_by(F.struct("chapter_id", "chapter_name", "confidence"), "pos").alias("given")
    keys = keys_of(questions, assignments, keys=("paper_id", "question_no"))
    given = assignments.where("question_no is not null").groupBy(*keys).agg(last)
    rows = questions.join(given, keys, "left").join(chapters_by_class(chapters), keys_of(questions, chapters, keys=("class_id",)), "left")
    rows = T.worked_out(rows, meant=resolve_chapter(F.col("chapters"), F.col("given.chapter_id"), F.col("given.chapter_name")))
    known = F.col("meant").isNotNull()
    sure = F.when(F.col("given.confidence").isNotNull() & ~F.isnan(F.col("given.confidence")), T.clamp(F.floor(F.col("given.confidence") + 0.5), 0, 100)).cast("int")
    values = {
        "chapter_id": F.col("meant.chapter_id"),
        "unit_id": F.col("meant.unit_id"),
        "chapter_name": F.when(known, F.coalesce("given.chapter_name", "meant.name")),
        "chapter_confidence": F.when(known, sure),
    }
    return rows.select(*_chosen(F.col("given").isNotNull(), values, [c for c in questions.columns if c not in ASSIGNED]))


def apply_overrides(questions: DataFrame, overrides: DataFrame, chapters: DataFrame, source: str | None = None) -> DataFrame:
    """questions with teachers' choices (paper_id, question_no, chapter_id, confidence 0-1) put over theirs.

    A choice whose chapter the class no longer has is passed over. Unique on (paper_id, question_no).
    source names a column that is added: MANUAL_OVERRIDE for questions with a choice that counts, else null.
    """
    keys = keys_of(questions, overrides, keys=("paper_id", "question_no"))
    of_class = keys_of(questions, chapters, keys=("class_id",))
    put = overrides.select(*keys, F.col("chapter_id").alias("put_id"), F.col("confidence").alias("put_confidence"))
    index = chapters.select(*of_class, F.col("chapter_id").alias("put_id"), F.col("unit_id").alias("put_unit"), F.col("name").alias("put_name"), F.lit("MANUAL_OVERRIDE").alias("put_source"))
    rows = questions.join(put, keys, "left").join(index, [*of_class, "put_id"], "left")
    sure = T.clamp(F.floor(F.coalesce("put_confidence", F.lit(0.0)) * 100 + 0.5), 0, 100).cast("int")
    values = {"chapter_id": F.col("put_id"), "unit_id": F.col("put_unit"), "chapter_name": F.col("put_name"), "chapter_confidence": sure}
    return rows.select(*_chosen(F.col("put_name").isNotNull(), values, [c for c in questions.columns if c not in ASSIGNED]), *([F.col("put_source").alias(source)] if source else []))


def reclassify(bank: DataFrame, classified: DataFrame, key: str, only_unassigned: bool = True) -> DataFrame:
    """bank with the chapters of `classified` (unique on key); with only_unassigned, assigned rows keep theirs."""
    new = classified.select(key, F.struct(*ASSIGNED).alias("new"))
    take = F.col("new").isNotNull() & (F.col("chapter_id").isNull() | F.lit(not only_unassigned))
    rows = bank.join(new, key, "left")
    return rows.select(*_chosen(take, {c: F.col(f"new.{c}") for c in ASSIGNED}, [c for c in bank.columns if c not in ASSIGNED]))
