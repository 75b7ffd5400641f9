"""Reports in words, rates, job states and labels for what users see."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from examlake.functions import text as T
from examlake.operators.bank import apply_edits, upsert
from examlake.operators.records import material_category
from examlake.operators.scans import keys_of

#: Missing numbers shown, characters of a snippet, of a file and of a class's syllabus text; letters that make a text readable.
SHOWN, SNIPPET, FILE_CHARS, CLASS_CHARS = 10, 72, 6000, 40_000
LEAST_LETTERS, LEAST_SOLID, LAYOUT_LETTERS = 25, 120, 80
SOLUTION = r"(?is)(?:^|\n)(?:Solution|Answer)\s*[:.\-]\s*(.+)$"
SIGNS = r"\\vec\{[^}]+\}|\\hat\{[A-Za-z]\}|\\frac\{[^{}]+\}\{[^{}]+\}|\[Figure:[^\]]+\]"


def quality_rates(rows: DataFrame) -> DataFrame:
    """Paper keys, total, with_marks, marks_rate, english_rate of each paper's rows."""
    marked, english = F.coalesce(F.col("marks") > 0, F.lit(False)), F.coalesce(T.accepts_model_text(F.col("question_text")), F.lit(False))
    share = lambda c: F.avg(c.cast("double"))
    return rows.groupBy(*keys_of(rows)).agg(F.count(F.lit(1)).alias("total"), F.count_if(marked).alias("with_marks"), share(marked).alias("marks_rate"), share(english).alias("english_rate"))


def rates_text(rates: DataFrame) -> DataFrame:
    """rates with a `message` in whole percents, halves up."""
    p = lambda c: F.floor(F.col(c) * 100 + 0.5).cast("int")
    return rates.withColumn("message", F.format_string("%d%% of rows have marks; %d%% read as English.", p("marks_rate"), p("english_rate")))


def with_validation_missing(reports: DataFrame, validation: DataFrame) -> DataFrame:
    """reports whose `missing` (array) takes in what a validation found missing, ascending."""
    keys = keys_of(reports, validation)
    none = F.array().cast("array<int>")
    joined = reports.join(validation.select(*keys, F.col("missing").alias("__more")), keys, "left")
    return joined.withColumn("missing", F.array_sort(F.array_union(F.coalesce("missing", none), F.coalesce("__more", none)))).drop("__more")


def count_warning(v: DataFrame) -> DataFrame:
    """v (expected_count, actual_count, missing, dropped, confirmed) with `warning`; null where nothing is expected or all is there."""
    n, miss = F.col("expected_count"), F.col("missing")
    first = F.try_element_at(miss, F.lit(1))
    shown = F.array_join(F.transform(F.slice(miss, 1, SHOWN), lambda x: x.cast("string")), ", ")
    parts = [
        F.when(F.col("actual_count") != n, F.format_string("%d of %d questions were found.", F.col("actual_count").cast("int"), n)),
        F.when(F.size(miss) > 0, F.concat(F.lit("Not found: "), shown, F.when(F.size(miss) > SHOWN, F.format_string(" and %d more", F.size(miss) - SHOWN)).otherwise(""), F.lit("."))),
        F.when(first <= 20, F.format_string("Numbers after %d may be off by one.", first)),
        F.when(F.col("dropped") > 0, F.format_string("%d repeated or unfit rows were left out.", F.col("dropped").cast("int"))),
        F.when((F.col("actual_count") < n * 0.5) & (F.size(miss) == 0), F.lit("Read the paper again, or a clearer copy of it.")),
    ]
    return v.withColumn("warning", F.when((n >= 1) & ~F.coalesce("confirmed", F.lit(False)), F.concat_ws(" ", *parts)))


def report_texts(reports: DataFrame) -> DataFrame:
    """reports (extracted, expected_count, missing, duplicates, status, issues) with `summary` and `details`, one line each."""
    n = F.col("expected_count")
    count = F.when(n >= 1, F.format_string("%d of %d questions", F.col("extracted").cast("int"), n)).otherwise(F.format_string("%d questions", F.col("extracted").cast("int")))
    told = F.when(F.col("status") == "Passed", F.lit("all checks passed")).when(F.size("issues") > 0, F.concat(F.lower("status"), F.lit(": "), F.try_element_at("issues", F.lit(1))))
    lines = [F.concat(F.lit("Found: "), count), F.when(n >= 1, F.concat(F.lit("Missing: "), F.coalesce(F.nullif(F.col("missing"), F.lit("")), F.lit("none")))), F.concat(F.lit("Repeated: "), F.coalesce(F.nullif(F.col("duplicates"), F.lit("")), F.lit("none")))]
    shown = F.col("status") != "Not Extracted"
    return reports.withColumn("summary", F.when(shown, F.concat_ws("; ", count, told)).otherwise("")).withColumn("details", F.when(shown, F.concat_ws("\n", *lines)).otherwise(""))


def source_label(source: Column, year: Column, series: Column, set_: Column, code_no: Column) -> Column:
    """`source · year · series · set · Code n` of what is known; a dash if nothing is."""
    blank = lambda c: F.nullif(c.cast("string"), F.lit(""))
    label = F.concat_ws(" · ", blank(source), F.when(year != 0, year.cast("string")), blank(series), blank(set_), F.concat(F.lit("Code "), blank(code_no)))
    return F.when(label == "", "—").otherwise(label)


def question_label(no: Column, year: Column, source: Column, paper: Column, text: Column) -> Column:
    """struct<head, snippet>: number, year, source and paper; the text on one line, cut after 72 characters."""
    head = F.concat_ws(" · ", F.concat(F.lit("Q"), no.cast("string")), F.when(year != 0, year.cast("string")), F.nullif(source, F.lit("")), F.nullif(paper, F.lit("")))
    line = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    snippet = F.when(F.length(line) > SNIPPET, F.concat(F.substring(line, 1, SNIPPET), F.lit("…"))).otherwise(line)
    return F.struct(F.when(head == "", "Exam question").otherwise(head).alias("head"), snippet.alias("snippet"))


def file_category(mime: Column, name: Column) -> Column:
    m, n = F.lower(F.coalesce(mime, F.lit(""))), F.lower(F.coalesce(name, F.lit("")))
    word = F.contains(m, F.lit("word")) | F.contains(m, F.lit("officedocument")) | n.endswith(".doc") | n.endswith(".docx")
    return (
        F.when(m.startswith("image/"), "Image").when((m == "application/pdf") | n.endswith(".pdf"), "PDF").when(word, "Microsoft Document")
        .when(n.endswith(".gdoc"), "Google Doc").when(m.startswith("text/"), "Text").otherwise("Microsoft Document")
    )


def file_extension(mime: Column) -> Column:
    m = F.lower(F.coalesce(mime, F.lit("")))
    image = F.split_part(m, F.lit("/"), F.lit(2))
    word = F.contains(m, F.lit("wordprocessingml")) | F.contains(m, F.lit("msword"))
    return F.when(m == "application/pdf", "pdf").when(m.startswith("image/"), F.when(image == "jpeg", "jpg").when(image == "", "img").otherwise(image)).when(m.startswith("text/"), "txt").when(word, "docx").otherwise("bin")


def is_text_file(category: Column, mime: Column, name: Column) -> Column:
    m, n = F.lower(F.coalesce(mime, F.lit(""))), F.lower(F.coalesce(name, F.lit("")))
    return F.coalesce(category == "Text", F.lit(False)) | m.startswith("text/") | m.isin("application/json", "application/javascript") | n.rlike(r"\.(txt|md|csv)$")


def shared_file_id(url: Column) -> Column:
    """The file id in a share link: behind /file/d/, else the id parameter; null for other text."""
    path = F.regexp_extract(F.try_parse_url(url, F.lit("PATH")), r"/file/d/([^/]+)", 1)
    return F.coalesce(F.nullif(path, F.lit("")), F.nullif(F.try_parse_url(url, F.lit("QUERY"), F.lit("id")), F.lit("")))


def syllabus_texts(files: DataFrame) -> DataFrame:
    """owner_id, class_id, text: headed texts of a class's syllabus files in the order of units, chapters and files.

    files: owner_id, class_id, unit_pos, chapter_pos, file_pos, chapter_id, chapter_name, category, text.
    6,000 characters a file, 40,000 a class; blank files are left out.
    """
    body = T.strip(F.col("text"))
    rows = files.where((material_category(F.col("category")) == "Syllabus") & (body != ""))
    part = F.concat(F.lit("## "), F.coalesce("chapter_name", F.lit("")), F.lit(" (chapterId: "), F.col("chapter_id").cast("string"), F.lit(")\n"), F.substring(body, 1, FILE_CHARS))
    each = F.struct("unit_pos", "chapter_pos", "file_pos", part.alias("t"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(each)), lambda x: x["t"]), "\n\n")
    return rows.groupBy("owner_id", "class_id").agg(F.substring(joined, 1, CLASS_CHARS).alias("text"))


def one_line(text: Column) -> Column:
    """A text without page marks, white space as single blanks."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), "---PAGE---", " "), r"\s+", " "))


def can_be_read(text: Column) -> Column:
    """True for a text with 25 English letters or 120 other signs."""
    line = one_line(text)
    return (T.letters(line) >= LEAST_LETTERS) | (F.length(F.regexp_replace(line, " ", "")) >= LEAST_SOLID)


def best_text(*candidates: Column) -> Column:
    """The text with the most English letters, the first of equals; empty if all are blank."""
    rows = [F.struct(T.letters(c).alias("n"), F.lit(-k).alias("k"), c.alias("t")) for k, c in enumerate(candidates)]
    some = F.filter(F.array(*rows), lambda r: F.coalesce(r["t"].rlike(r"\S"), F.lit(False)))
    return F.coalesce(F.array_max(some)["t"], F.lit(""))


def text_route(files: DataFrame) -> DataFrame:
    """files (is_pdf, layout_text, raw_text) with `text`, the best of both, and `by_text`: whether it is to be read as text.

    A PDF is, if its layout gave 80 letters and the raw text did not have to stand in.
    """
    layout, raw = F.coalesce("layout_text", F.lit("")), F.coalesce("raw_text", F.lit(""))
    rows = files.withColumn("text", best_text(layout, raw))
    few = T.letters(one_line(layout)) < LAYOUT_LETTERS
    stand_in = (F.col("text") == raw) & (T.letters(layout) < LAYOUT_LETTERS)
    return rows.withColumn("by_text", can_be_read(F.col("text")) & (~F.col("is_pdf") | (~few & ~stand_in)))


def split_solution(text: Column, enabled: bool = False) -> Column:
    """struct<question_text, solution>: cut before the line that begins with Solution: or Answer:, if enabled."""
    whole = T.strip(text)
    told = F.regexp_extract(whole, SOLUTION, 1)
    if not enabled:
        return F.struct(whole.alias("question_text"), F.lit(None).cast("string").alias("solution"))
    return F.struct(F.when(told == "", whole).otherwise(T.strip(F.regexp_replace(whole, SOLUTION, ""))).alias("question_text"), F.nullif(T.strip(told), F.lit("")).alias("solution"))


def notation_tokens(text: Column) -> Column:
    """array<struct<kind, value, below>>: the text's signs and the plain text between them, in order."""
    signs = F.regexp_extract_all(text, F.lit(SIGNS), F.lit(0))
    plain = F.split(text, SIGNS)

    def of_sign(s: Column) -> Column:
        kind = F.when(s.startswith("\\vec"), "vec").when(s.startswith("\\hat"), "hat").when(s.startswith("\\frac"), "frac").otherwise("figure")
        inner = F.when(kind == "figure", s).otherwise(F.regexp_extract(s, r"\{([^{}]+)\}", 1))
        return F.struct(kind.alias("kind"), inner.alias("value"), F.when(kind == "frac", F.regexp_extract(s, r"\}\{([^{}]+)\}", 1)).alias("below"))

    of_text = lambda t: F.struct(F.lit("text").alias("kind"), t.alias("value"), F.lit(None).cast("string").alias("below"))
    both = F.flatten(F.transform(plain, lambda t, i: F.when(i < F.size(signs), F.array(of_text(t), of_sign(F.get(signs, i)))).otherwise(F.array(of_text(t)))))
    return F.filter(both, lambda x: x["value"] != "")


def build_totals(knowledge: DataFrame) -> DataFrame:
    """owner_id, class_id, complete, failed."""
    return knowledge.groupBy("owner_id", "class_id").agg(F.count_if(F.col("extract_status") == "complete").alias("complete"), F.count_if(F.col("extract_status") == "failed").alias("failed"))


# --- jobs -------------------------------------------------------------------------------------


def queued_jobs(papers: DataFrame, now: Column | None = None) -> DataFrame:
    """A queued job of each paper (owner_id, paper_id, job_id, prompt_version)."""
    null = lambda kind: F.lit(None).cast(kind)
    return papers.select("owner_id", "job_id", "paper_id", F.lit("queued").alias("status"), F.lit("queued").alias("phase"), null("long").alias("question_count"), null("string").alias("error"), "prompt_version", (F.current_timestamp() if now is None else now).alias("updated_at"))


def apply_job_changes(jobs: DataFrame, changes: DataFrame) -> DataFrame:
    """jobs with the latest change (owner_id, job_id, status, phase, question_count, error, updated_at) of each put in.

    A change tells the whole state but for its count: the latest that is known stands, so a failed job
    keeps the count it had. Of changes at one time the one with the greater status, then error, counts.
    """
    keys = ["owner_id", "job_id"]
    count = F.max_by("question_count", F.when(F.col("question_count").isNotNull(), F.struct("updated_at", "question_count")))
    last = changes.groupBy(*keys).agg(F.max_by(F.struct("status", "phase", "error", "updated_at"), F.struct("updated_at", "status", "error")).alias("__c"), count.alias("__n"))
    new = F.col("__c").isNotNull()
    put = {c: F.col(f"__c.{c}") for c in ("status", "phase", "error", "updated_at")} | {"question_count": F.coalesce("__n", "question_count")}
    return jobs.join(last, keys, "left").select(*[F.when(new, put[c]).otherwise(F.col(c)).alias(c) if c in put else F.col(c) for c in jobs.columns])


def stamp_reports(papers: DataFrame, reports: DataFrame) -> DataFrame:
    """papers with last_quality_report (JSON) and last_extraction_job_id of the papers that were reported."""
    keys = keys_of(papers, reports)
    return apply_edits(papers, reports, keys, ["last_quality_report", "last_extraction_job_id"])


def class_progress(questions: DataFrame) -> DataFrame:
    """owner_id, class_id, paper_id, total, assigned, classified_by, error, and the same sums of each class (paper_id null, is_class true).

    classified_by: the last route by finished_at that assigned any; error: the last one. questions carry
    their paper's route, error and finished_at.
    """
    route, failed = F.col("classified_by").isNotNull() & (F.col("classified_by") != "none"), F.col("error").isNotNull()
    pick = lambda c, keep: F.max_by(c, F.when(keep, F.struct("finished_at", c))).alias(c)
    out = questions.groupingSets([["owner_id", "class_id", "paper_id"], ["owner_id", "class_id"]], "owner_id", "class_id", "paper_id")
    return out.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("chapter_id").isNotNull()).alias("assigned"), pick("classified_by", route), pick("error", failed), (F.grouping("paper_id") == 1).alias("is_class"))


def upsert_jobs(base: DataFrame, jobs: DataFrame) -> DataFrame:
    return upsert(base, jobs, ["owner_id", "job_id"])
