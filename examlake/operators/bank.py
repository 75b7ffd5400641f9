"""Reports over the question bank and keyed writes, for all papers and tenants at once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from examlake.functions import text as T
from examlake.operators.scans import keys_of
from examlake.sources.written import written


def quality_report(papers: DataFrame, bank: DataFrame, single: bool = False) -> DataFrame:
    """One row for each paper: counts, missing, duplicate and extra numbers, marks, issues, status.

    papers: paper keys, expected_count and, if known, expected_marks; bank: paper keys, question_no,
    question_text, marks, row_order. Rows are counted first by paper and number, so the per-paper
    arrays hold distinct numbers only; a number's marks are those of its longest trimmed text, the
    first by row_order of equals. An expected count below 1 counts as unknown: nothing is missing or
    extra then, and the paper is to be reviewed. A paper without rows is 'Not Extracted'; 'Failed'
    means no valid number. `single`: bank has one row a number, which is counted as it stands.
    """
    keys = keys_of(papers, bank)
    size = F.length(T.strip(F.coalesce("question_text", F.lit(""))))
    longest = F.max(F.struct(size.alias("size"), (-F.col("row_order")).alias("early"), "marks"))["marks"]
    by_no = bank.select(*keys, "question_no", F.lit(1).cast("long").alias("n"), "marks") if single else bank.groupBy(*keys, "question_no").agg(F.count(F.lit(1)).alias("n"), longest.alias("marks"))
    valid, marked = F.col("question_no") >= 1, F.col("marks") > 0
    per = by_no.groupBy(*keys).agg(
        F.sum("n").alias("row_count"), F.sort_array(F.collect_list(F.when(valid, F.col("question_no")))).alias("numbers"),
        F.sort_array(F.collect_list(F.when(valid & (F.col("n") > 1), F.col("question_no")))).alias("repeated"),
        F.sum(F.when(valid & marked, F.col("marks"))).alias("marks_sum"), F.count_if(valid & marked).alias("with_marks"),
    )
    if "expected_marks" not in papers.columns:
        papers = papers.withColumn("expected_marks", F.lit(None).cast("double"))
    none = F.array().cast("array<int>")
    known = F.col("expected_count") >= 1
    wanted = F.when(known, F.sequence(F.lit(1), F.col("expected_count")))
    rows = papers.select(*keys, "expected_count", "expected_marks").join(per, keys, "left").withColumns({"numbers": F.coalesce("numbers", none), "repeated": F.coalesce("repeated", none)})
    rows = rows.withColumns({"gaps": F.when(known, F.array_except(wanted, "numbers")).otherwise(none), "beyond": F.when(known, F.filter("numbers", lambda x: x > F.col("expected_count"))).otherwise(none)})
    n, total = F.size("numbers"), F.coalesce("marks_sum", F.lit(0)).cast("decimal(20,2)")
    unmarked = n - F.coalesce("with_marks", F.lit(0)).cast("int")
    off = (F.col("with_marks") > 0) & (total.cast("double") != F.col("expected_marks"))
    told = lambda c: F.when(F.size(c) > 0, T.ranges(F.col(c))).otherwise("")
    has_rows = F.col("row_count") > 0
    counted = [
        F.when(known & (n != F.col("expected_count")), F.format_string("%d of %d questions found", n, F.col("expected_count"))),
        F.when(~F.coalesce(known, F.lit(False)) & (n > 0), F.lit("the number of questions is not known")),
        F.when(F.size("gaps") > 0, F.concat(F.lit("missing: "), told("gaps"))), F.when(F.size("repeated") > 0, F.concat(F.lit("repeated: "), told("repeated"))),
        F.when(F.size("beyond") > 0, F.concat(F.lit("beyond the last number: "), told("beyond"))),
        F.when(off, F.concat(F.lit("marks: "), total.cast("string"), F.lit(" of "), F.col("expected_marks").cast("decimal(20,2)").cast("string"))).when(unmarked > 0, F.format_string("%d without marks", unmarked)),
    ]
    issues = F.when(has_rows, F.array_compact(F.array(*counted))).otherwise(F.array(F.lit("no questions yet")))
    clean = F.coalesce(known, F.lit(False)) & (F.size("gaps") == 0) & (F.size("repeated") == 0) & (F.size("beyond") == 0)
    status = F.when(~F.coalesce(has_rows, F.lit(False)), "Not Extracted").when(n == 0, "Failed").when(clean & (F.size("issues") == 0), "Passed").otherwise("Needs Review")
    out = rows.withColumn("issues", issues)
    return out.select(
        *keys, "expected_count", F.coalesce("row_count", F.lit(0)).alias("row_count"), n.alias("extracted"), told("gaps").alias("missing"), told("repeated").alias("duplicates"), told("beyond").alias("extra"),
        total.alias("marks_sum"), "expected_marks", unmarked.alias("without_marks"), "issues", status.alias("status"),
    )


def upsert(base: DataFrame, updates: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of updates replace rows of base with equal keys; the rest is added. Running it twice changes nothing."""
    out = base.join(updates.select(*keys).distinct(), keys, "left_anti").unionByName(updates, allowMissingColumns=True)
    return out.select(*base.columns, *[c for c in updates.columns if c not in base.columns])


def replace_children(base: DataFrame, parents: DataFrame, children: DataFrame, on: list[str]) -> DataFrame:
    return base.join(parents.select(*on).distinct(), on, "left_anti").unionByName(children)


def persist_questions(base: DataFrame, new: DataFrame, paper: str, keys: list[str]) -> DataFrame:
    """Upsert, then drop rows of the touched papers that the new set lacks; papers without new rows stay."""
    touched = new.select(paper).distinct()
    untouched = base.join(touched, [paper], "left_anti")
    return upsert(untouched, new, keys)


def apply_edits(base: DataFrame, edits: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    renamed = edits.select(*keys, *[F.col(c).alias(f"__{c}") for c in columns])
    joined = base.join(renamed, keys, "left")
    return reduce(lambda d, c: d.withColumn(c, F.coalesce(f"__{c}", c)).drop(f"__{c}"), columns, joined)


def cascade_delete(gone: DataFrame, key: str, tables: list[DataFrame]) -> list[DataFrame]:
    ids = gone.select(key).distinct()
    return [t.join(ids, [key], "left_anti") for t in tables]


def latest(df: DataFrame, key: str, order: list) -> DataFrame:
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def papers_to_reprocess(papers: DataFrame, bank: DataFrame, least: int = 10, force_all: bool = False) -> DataFrame:
    """Papers with fewer than `least` rows, those without any too; all papers if forced."""
    keys = keys_of(papers, bank)
    counts = bank.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    joined = papers.select(*keys).join(counts, keys, "left").select(*keys, F.coalesce("n", F.lit(0)).alias("n_rows"))
    return joined if force_all else joined.where(F.col("n_rows") < least)


#: The length from which a text seems to hold two questions, and the numbers of which that is said.
LONG_TEXT, FIGURES = 850, (17, 28)


def repair_set(rows: DataFrame, expected: DataFrame, long: int = LONG_TEXT, figures: tuple[int, int] = FIGURES) -> DataFrame:
    """Numbers to read again for each paper, sorted: missing, repeated, and those (17 to 28) with a text of 850 characters or more.

    expected: paper keys, expected_count; below 1 or unknown, nothing is missing. Only long texts of
    those numbers are stripped to be measured.
    """
    keys = keys_of(rows, expected)
    text = F.col("question_text")
    bloated = F.max(F.when(F.col("question_no").between(*figures) & (F.length(text) >= long), F.length(T.strip(text)))) >= long
    n = rows.groupBy(*keys, "question_no").agg(F.count(F.lit(1)).alias("n"), bloated.alias("bloated"))
    again = (F.col("n") > 1) | F.coalesce("bloated", F.lit(False))
    per = n.groupBy(*keys).agg(F.collect_list("question_no").alias("have"), F.collect_list(F.when(again & F.col("question_no").isNotNull(), F.col("question_no"))).alias("again"))
    joined = per.join(expected.select(*keys, "expected_count"), keys, "left")
    missing = F.when(F.col("expected_count") >= 1, F.array_except(F.sequence(F.lit(1), F.col("expected_count")), F.col("have"))).otherwise(F.array().cast("array<int>"))
    return joined.select(*keys, F.array_join(F.array_sort(F.array_distinct(F.concat(missing, "again"))).cast("array<string>"), ",").alias("numbers"))


def near_duplicate_pairs(rows: DataFrame, threshold: float = 0.72, most: int = 10_000) -> DataFrame:
    """paper keys, row_a, row_b, kind of each paper's rows with like word sets (Jaccard of `threshold` or more).

    Rows with the same word set are one class, named by its first row: kind 'copy' ties each other row
    (row_b) to it (row_a). Kind 'like' ties two classes. Copies are never paired with each other, so a
    group of n costs n rows. Two sets that similar share a word of each one's first (1 - threshold) of
    words in any one order (prefix filtering); here rare words come first: those in more than one part
    in `most` of all sets' words are `most` at most and are broadcast with their counts. Sets whose
    sizes differ too much never meet. Words are compared by 64-bit hashes.
    """
    keys = keys_of(rows)
    words = F.array_sort(F.transform(T.key_words(F.col("question_text")), lambda w: F.xxhash64(w)))
    keyed = T.worked_out(rows.select(*keys, "row_order", "question_text"), words=words).drop("question_text").where(F.size("words") > 0).withColumn("word_set", F.xxhash64("words", F.size("words")))
    keyed = written(keyed, "word_sets").repartition(*keys)
    sets = keyed.groupBy(*keys, "word_set").agg(F.min("row_order").alias("row"), F.max("words").alias("words"))
    copies = keyed.select(*keys, "word_set", "row_order").join(sets.select(*keys, "word_set", "row"), [*keys, "word_set"]).where("row_order > row")
    copies = copies.select(*keys, F.col("row").alias("row_a"), F.col("row_order").alias("row_b"), F.lit("copy").alias("kind"))
    each = sets.select(*keys, "row", F.size("words").alias("size"), F.explode("words").alias("w"))
    seen = each.groupBy("w").agg(F.count(F.lit(1)).alias("df"))
    least = seen.agg((F.sum("df") / most).alias("least"))
    frequent = seen.join(F.broadcast(least), F.col("df") > F.greatest(F.col("least"), F.lit(100)))
    ranked = each.join(F.broadcast(frequent.select("w", "df")), "w", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    order = Window.partitionBy(*keys, "row").orderBy("df", "w")
    prefix = ranked.withColumn("k", F.row_number().over(order)).where(F.col("k") <= F.col("size") - F.ceil(F.col("size") * threshold).cast("int") + 1)
    a = prefix.select(*keys, "w", F.col("row").alias("row_a"), F.col("size").alias("size_a"))
    b = prefix.select(*keys, "w", F.col("row").alias("row_b"), F.col("size").alias("size_b"))
    near = (F.col("row_a") < F.col("row_b")) & (F.col("size_a") >= F.col("size_b") * threshold) & (F.col("size_b") >= F.col("size_a") * threshold)
    pairs = a.join(b, [*keys, "w"]).where(near).select(*keys, "row_a", "row_b").distinct()
    side = lambda n: sets.select(*keys, F.col("row").alias(f"row_{n}"), F.col("words").alias(f"words_{n}"))
    scored = pairs.join(side("a"), [*keys, "row_a"]).join(side("b"), [*keys, "row_b"])
    like = scored.where(T.jaccard(F.col("words_a"), F.col("words_b")) >= threshold).select(*keys, "row_a", "row_b", F.lit("like").alias("kind"))
    return like.unionByName(copies)


def compare_reports(a: DataFrame, b: DataFrame) -> DataFrame:
    """Full outer difference of two report sets: which fields differ, and whether the run is acceptable.

    Acceptable are counts within one and an equal expectation.
    """
    keys = keys_of(a, b)
    fields = [c for c in ("expected_count", "extracted", "missing", "duplicates", "extra", "marks_sum", "status") if c in a.columns and c in b.columns]
    j = a.select(*keys, *[F.col(c).alias(f"{c}_a") for c in fields], F.lit(True).alias("in_a")).join(b.select(*keys, *[F.col(c).alias(f"{c}_b") for c in fields], F.lit(True).alias("in_b")), keys, "full_outer")
    differs = F.array_compact(F.array(*[F.when(~F.col(f"{c}_a").eqNullSafe(F.col(f"{c}_b")), F.lit(c)) for c in fields]))
    ok = F.col("in_a") & F.col("in_b") & (F.abs(F.col("extracted_a") - F.col("extracted_b")) <= 1) & F.col("expected_count_a").eqNullSafe(F.col("expected_count_b"))
    return j.select(*keys, F.array_join(differs, ",").alias("differs"), (~F.col("status_a").eqNullSafe(F.col("status_b"))).alias("status_differs"), F.coalesce(ok, F.lit(False)).alias("acceptable"))


def best_with_alternatives(top: DataFrame) -> DataFrame:
    """question_id, chapter_id, confidence, review_status of the best chapter, alternatives: array<struct<chapter_id, score>>, scores to three places, halves up."""
    other = F.when(F.col("rank") > 1, F.struct("rank", "chapter_id", (F.floor(F.col("confidence") * 1000 + 0.5) / 1000).alias("score")))
    rest = F.transform(F.array_sort(F.collect_list(other)), lambda x: F.struct(x["chapter_id"].alias("chapter_id"), x["score"].alias("score")))
    first = F.max(F.when(F.col("rank") == 1, F.struct("chapter_id", "confidence", "review_status")))
    return top.groupBy("question_id").agg(first.alias("b"), rest.alias("alternatives")).select("question_id", "b.*", "alternatives")


#: Fixed value: the order in which a class's papers are listed by source.
PAPER_SOURCES = ("Final exam", "Model exam", "Others")


def papers_of_classes(papers: DataFrame) -> DataFrame:
    """owner_id, class_id, sources: array<struct<source, papers>> of a class's papers, newest first, in the fixed order of sources.

    Sources without papers, and papers of other sources, are left out.
    """
    one = F.struct((-F.col("year")).alias("down"), "paper_id", "year")
    per = papers.where(F.col("paper_source").isin(*PAPER_SOURCES)).groupBy("owner_id", "class_id", "paper_source").agg(F.array_sort(F.collect_list(one)).alias("papers"))
    place = F.array_position(F.array(*map(F.lit, PAPER_SOURCES)), F.col("paper_source"))
    shown = F.transform("papers", lambda p: F.struct(p["paper_id"].alias("paper_id"), p["year"].alias("year")))
    listed = F.array_sort(F.collect_list(F.struct(place.alias("place"), F.col("paper_source").alias("source"), shown.alias("papers"))))
    return per.groupBy("owner_id", "class_id").agg(F.transform(listed, lambda s: F.struct(s["source"].alias("source"), s["papers"].alias("papers"))).alias("sources"))
