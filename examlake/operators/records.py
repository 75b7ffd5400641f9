"""Rows of the question bank and of classifications, built from extracted questions; values in their stored form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from examlake.functions import text as T
from examlake.operators.bank import apply_edits, persist_questions, upsert
from examlake.operators.merging import without_repeats_column as without_repeats
from examlake.operators.scans import keys_of
from examlake.sources.written import written

#: The labels that columns may hold.
SOURCES = ("Class work", "Test", "Final exam", "Model exam", "Others")
RATED = ("Low", "Medium", "High")
NOT_RATED = "not Rated"
RULES = "array<struct<section:string,from:int,to:int,marks:double>>"
BANK_COLUMNS = (
    "owner_id id origin_type material_id question_paper_id class_id unit_id chapter_id chapter_name chapter_confidence question_no question_text marks solution difficulty_level source year topic extracted_by metadata".split()
)


def paper_source(label: Column) -> Column:
    """An exam paper's source as the bank has it; unknown labels are Others."""
    return F.when(label.isin(*SOURCES), label).otherwise("Others")


def material_source(label: Column) -> Column:
    """A material's exam source as the bank has it, old labels too; unknown ones are Class work."""
    return F.when(label.isin("Class work", "Test"), label).when(label == "Public exam", "Others").otherwise("Class work")


def exam_source(label: Column) -> Column:
    """A material's exam source in today's labels; old and unknown ones are Class work."""
    return F.when(label == "Test", label).otherwise("Class work")


def difficulty(level: Column) -> Column:
    return F.when(level.isin(*RATED), level).otherwise(NOT_RATED)


def material_category(label: Column) -> Column:
    """Syllabus for a missing label and for Others."""
    return F.when(F.coalesce(label, F.lit("")).isin("", "Others"), "Syllabus").otherwise(label)


def first_of(df: DataFrame, *names: str, kind: str = "string") -> Column:
    """The first of the columns that df has and that is not null."""
    found = [F.col(n).try_cast(kind) for n in names if n in df.columns]
    return F.coalesce(*found, F.lit(None).cast(kind))


def finite(x: Column) -> Column:
    """A number, or null for what is none: text, NaN, infinity."""
    n = x.try_cast("double")
    return F.when(~F.isnan(n) & (F.abs(n) != float("inf")), n)


def section_rules(rules: Column) -> Column:
    """Rules array<map<string,string>> under any of their usual keys as RULES; rules without numbers, or that run backward, are dropped."""
    pick = lambda r, *keys: F.coalesce(*[F.try_element_at(r, F.lit(k)) for k in keys])

    def one(r: Column) -> Column:
        ends = [finite(pick(r, *keys)).cast("int") for keys in (("from", "questionFrom", "question_from", "start"), ("to", "questionTo", "question_to", "end"))]
        return F.struct(pick(r, "section", "sectionId").alias("section"), ends[0].alias("from"), ends[1].alias("to"), finite(pick(r, "marks", "mark")).alias("marks"))

    return F.filter(F.transform(rules, one), lambda r: (r["from"] <= r["to"]) & r["marks"].isNotNull())


def compact_metadata(m: Column, rules: Column | None = None) -> Column:
    """The few values of a metadata map (string to string) that are stored, as JSON; unset ones are left out.

    The total counts from 1 on. `rules`: section rules in RULES form.
    """
    texts = ("set", "series", "marksInferred", "marksSource", "hasFigure")

    def read(m: Column) -> Column:
        at = lambda *keys: F.coalesce(*[F.nullif(F.try_element_at(m, F.lit(k)), F.lit("")) for k in keys])
        return F.struct(at("totalQuestions", "total_questions").alias("total"), *[at(k).alias(k) for k in texts], at("codeNo", "code_no").alias("codeNo"))

    def held(v: Column) -> Column:
        total = finite(v["total"])
        out = [F.when(total >= 1, total.cast("int")).alias("totalQuestions")]
        if rules is not None:
            out.append(F.when(F.size(rules) > 0, rules).alias("sectionMarkRules"))
        return F.struct(*out, *[T.repair_escapes(v[k]).alias(k) for k in (*texts, "codeNo")])

    return F.to_json(T.once(T.once(m, read), held))


def parse_embedding(raw: Column) -> Column:
    """array<float> of a JSON list; null for anything else and for an empty list."""
    found = F.from_json(raw, "array<float>")
    return F.when(F.size(found) > 0, F.when(~F.exists(found, lambda x: x.isNull()), found))


def normalized_questions(raw: DataFrame, strict: bool = True, solutions: bool = False) -> DataFrame:
    """Raw questions in one form: paper keys, row_order, question_no, question_text, marks, has_figure, topic, solution.

    Text, number and marks come under any of their usual names; the text is cut down to English and
    one notation, marks that are no number become null, a missing number is the row's place in its
    paper. Rows without text are dropped.
    """
    keys = keys_of(raw)
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("row_order"))
    told = T.english_only(T.strip(first_of(raw, "solution", "answer"))) if solutions else F.lit(None).cast("string")
    marks = finite(F.nullif(first_of(raw, "marks", "mark"), F.lit("")))
    plain = T.worked_out(raw, __plain=T.english_only(T.strip(first_of(raw, "questionText", "question_text", "text"))))
    raw = T.worked_out(plain, __text=T.notation(F.col("__plain"), strict))
    rows = raw.select(*keys, "row_order", F.coalesce(finite(first_of(raw, "questionNo", "question_no")).cast("int"), place).alias("question_no"), F.col("__text").alias("question_text"), marks.alias("marks"), F.coalesce(first_of(raw, "hasFigure", "has_figure", kind="boolean"), F.lit(False)).alias("has_figure"), first_of(raw, "topic").alias("topic"), F.nullif(told, F.lit("")).alias("solution"))
    return rows.where("question_text <> ''")


def _bank_rows(rows: DataFrame, **put: Column) -> DataFrame:
    stored = lambda c: T.repair_escapes(first_of(rows, c))
    out = {
        "owner_id": F.col("owner_id"), "id": first_of(rows, "id"), "unit_id": first_of(rows, "unit_id"), "chapter_id": first_of(rows, "chapter_id"), "chapter_name": first_of(rows, "chapter_name"),
        "chapter_confidence": first_of(rows, "chapter_confidence", kind="int"), "question_text": F.coalesce(stored("question_text"), F.lit("")), "marks": first_of(rows, "marks", kind="decimal(10,2)"),
        "solution": F.nullif(stored("solution"), F.lit("")), "difficulty_level": difficulty(first_of(rows, "difficulty_level")), "topic": F.nullif(stored("topic"), F.lit("")),
        "extracted_by": F.coalesce(first_of(rows, "extracted_by"), F.lit("manual")), "metadata": compact_metadata(F.col("metadata") if "metadata" in rows.columns else F.create_map().cast("map<string,string>")),
    } | put
    return rows.select(*[out[c].alias(c) for c in BANK_COLUMNS])


def bank_rows_of_papers(questions: DataFrame, papers: DataFrame) -> DataFrame:
    """BANK_COLUMNS of exam papers' questions (owner_id, paper_id, row_order, ...); papers: owner_id, paper_id, class_id, paper_source, year.

    A missing number is the question's place in its paper.
    """
    paper = papers.select("owner_id", "paper_id", F.col("class_id").alias("__class"), F.col("paper_source").alias("__source"), F.col("year").alias("__year"))
    place = F.row_number().over(Window.partitionBy("owner_id", "paper_id").orderBy("row_order"))
    rows = questions.withColumn("question_no", F.coalesce("question_no", place)).join(paper, ["owner_id", "paper_id"])
    return paper_bank_rows(rows.drop("class_id", "paper_source", "year").withColumnsRenamed({"__class": "class_id", "__source": "paper_source", "__year": "year"}))


def paper_bank_rows(questions: DataFrame) -> DataFrame:
    """BANK_COLUMNS of exam papers' numbered questions that carry their paper's class_id, paper_source and year."""
    none = F.lit(None).cast("string")
    return _bank_rows(questions, origin_type=F.lit("question_paper"), material_id=none, question_paper_id=F.col("paper_id").cast("string"), class_id=F.col("class_id"), question_no=F.col("question_no"), source=paper_source(F.col("paper_source")), year=F.col("year").cast("int"))


def bank_rows_of_materials(questions: DataFrame, materials: DataFrame) -> DataFrame:
    """BANK_COLUMNS of chapter materials' questions (owner_id, material_id, row_order, ...); the chapter is the material's.

    materials: owner_id, material_id, class_id, unit_id, chapter_id, chapter_name, exam_source.
    """
    of = materials.select("owner_id", "material_id", *[F.col(c).alias(f"__{c}") for c in ("class_id", "unit_id", "chapter_id", "chapter_name", "exam_source")])
    place = F.row_number().over(Window.partitionBy("owner_id", "material_id").orderBy("row_order"))
    rows = questions.withColumn("question_no", F.coalesce("question_no", place)).join(of, ["owner_id", "material_id"])
    none = F.lit(None).cast("string")
    put = {c: F.col(f"__{c}") for c in ("class_id", "unit_id", "chapter_id", "chapter_name")}
    return _bank_rows(rows, **put, origin_type=F.lit("material"), material_id=F.col("material_id").cast("string"), question_paper_id=none, chapter_confidence=F.coalesce(first_of(rows, "chapter_confidence", kind="int"), F.lit(100)), question_no=F.col("question_no"), source=material_source(F.col("__exam_source")), year=F.lit(None).cast("int"))


def bank_questions(bank: DataFrame, clean: bool = False) -> DataFrame:
    """Bank rows as questions: numbers cast, unset values null, metadata as a map (empty if it is no JSON object), unknown extractor `existing`.

    `clean` cuts texts down to English and takes out what is written twice in them.
    """
    if clean:
        bank = bank.withColumn("question_text", without_repeats(T.english_only(F.col("question_text"))))
    meta = F.coalesce(F.from_json(F.col("metadata"), "map<string,string>"), F.create_map().cast("map<string,string>"))
    blank = lambda c: F.nullif(F.col(c), F.lit(""))
    return bank.select("owner_id", "id", "question_no", F.coalesce("question_text", F.lit("")).alias("question_text"), F.col("marks").cast("double").alias("marks"), blank("solution").alias("solution"), blank("topic").alias("topic"), "chapter_id", "chapter_name", F.col("chapter_confidence").cast("double").alias("chapter_confidence"), "unit_id", F.coalesce(blank("extracted_by"), F.lit("existing")).alias("extracted_by"), meta.alias("metadata"))


def classification_rows(questions: DataFrame, source: Column) -> DataFrame:
    """owner_id, question_id, chapter_id, confidence (0 to 1), alternatives, review_status, classification_source of assigned questions.

    The confidence is the classifier's own (confidence), else the percent shown over 100, else a half;
    status, alternatives and source are the classifier's where it gave them. Rows without an id or a
    chapter give none.
    """
    rows = questions.where("question_id is not null and chapter_id is not null")
    sure = F.coalesce(first_of(rows, "confidence", kind="double"), first_of(rows, "chapter_confidence", kind="double") / 100, F.lit(0.5))
    other = F.col("alternatives") if "alternatives" in rows.columns else F.lit(None).cast("array<struct<chapter_id:string,chapter_name:string,score:double>>")
    return rows.select("owner_id", "question_id", "chapter_id", T.clamp(sure, 0, 1).cast("decimal(4,3)").alias("confidence"), other.alias("alternatives"), F.coalesce(first_of(rows, "review_status"), T.review_status(sure)).alias("review_status"), F.coalesce(first_of(rows, "classification_source"), source).alias("classification_source"))


def upsert_classifications(base: DataFrame, rows: DataFrame) -> DataFrame:
    """Keyed write on (owner_id, question_id); confidences are held to 0..1, null is 0."""
    held = rows.withColumn("confidence", F.coalesce(T.clamp(F.col("confidence").cast("double"), 0, 1), F.lit(0.0)).cast("decimal(4,3)"))
    return upsert(base, held, ["owner_id", "question_id"])


def rate_questions(bank: DataFrame, levels: DataFrame) -> DataFrame:
    """bank with difficulty_level set by levels (owner_id, id, difficulty_level); levels that are none are passed over."""
    return apply_edits(bank, levels.where(F.col("difficulty_level").isin(*RATED)), ["owner_id", "id"], ["difficulty_level"])


def rename(rows: DataFrame, names: DataFrame) -> DataFrame:
    """rows with `name` set by names (owner_id, id, name), trimmed; blank names are passed over."""
    told = names.withColumn("name", T.strip(F.col("name"))).where("name <> ''")
    return apply_edits(rows, told, ["owner_id", "id"], ["name"])


def override_chapters(bank: DataFrame, classifications: DataFrame, choices: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(bank, classifications) with teachers' choices (owner_id, question_id, chapter_id, chapter_name, unit_id) put in, fully sure.

    A classification keeps its alternatives.
    """
    keys = ["owner_id", "question_id"]
    put = choices.withColumnRenamed("question_id", "id").withColumn("chapter_confidence", F.lit(100))
    edited = apply_edits(bank, put, ["owner_id", "id"], ["chapter_id", "chapter_name", "unit_id", "chapter_confidence"])
    old = classifications.select(*keys, "alternatives")
    rows = choices.select(*keys, "chapter_id").join(old, keys, "left").select(*keys, "chapter_id", F.lit(1.0).alias("confidence"), "alternatives", F.lit("AUTO_APPROVED").alias("review_status"), F.lit("MANUAL_OVERRIDE").alias("classification_source"))
    return edited, upsert_classifications(classifications, rows)


def persist_bank_rows(bank: DataFrame, classifications: DataFrame, new: DataFrame, rows: DataFrame, hold: bool = True) -> tuple[DataFrame, DataFrame]:
    """(bank, classifications) after a run: rows of the touched papers replaced, then classifications written, those of vanished rows dropped.

    Papers without new rows stay untouched. The bank is written once for both, unless `hold` is off: new is
    then a plain projection of a written table, of which classifications need the ids only, and every row
    of `rows` is of a question in it, so that only old ones may have lost theirs.
    """
    # a paper belongs to its owner: both name it
    keyed = lambda df: df.withColumn("__paper", F.struct("owner_id", "question_paper_id"))
    kept = persist_questions(keyed(bank), keyed(new), "__paper", ["owner_id", "id"]).drop("__paper")
    kept = written(kept, "kept") if hold else kept
    of_bank = lambda df: df.join(kept.select("owner_id", F.col("id").alias("question_id")), ["owner_id", "question_id"], "left_semi")
    return kept, of_bank(upsert_classifications(classifications, rows)) if hold else upsert_classifications(of_bank(classifications), rows)
