"""Scans of one tenant's tables: optional filters, the orders in which lists are shown, narrow projections.

Filters are equalities on plain columns, so they reach the Parquet scan; with tables partitioned by
owner_id and class_id they prune folders. Orders are lists of sort columns, for orderBy over one
tenant's rows or for a window over each paper's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

BANK_FILTERS = ("class_id", "unit_id", "chapter_id", "source", "year", "origin_type", "material_id", "question_paper_id", "topic")
MATERIAL_FILTERS = ("class_id", "unit_id", "chapter_id", "material_type", "exam_source")
UNNUMBERED = 99_999


def for_owner(df: DataFrame, owner: str) -> DataFrame:
    """The tenant's rows; a null owner_id belongs to nobody."""
    return df.where(F.col("owner_id") == owner)


def keys_of(*tables: DataFrame, keys: tuple[str, ...] = ("paper_id",)) -> list[str]:
    """Join keys that keep tenants apart: owner_id, where all tables have it, and `keys`."""
    return [*(["owner_id"] if all("owner_id" in t.columns for t in tables) else []), *keys]


def matching(df: DataFrame, allowed: tuple[str, ...], **filters) -> DataFrame:
    """Rows equal to every filter that is not None."""
    if unknown := set(filters) - set(allowed):
        raise ValueError(f"no such filter: {sorted(unknown)}")
    for column, value in filters.items():
        if value is not None:
            df = df.where(F.col(column) == value)
    return df


def bank_order() -> list[Column]:
    return [F.desc_nulls_last("year"), F.asc_nulls_last("question_no")]


def search_bank(bank: DataFrame, owner: str, **filters) -> DataFrame:
    """A tenant's questions by up to nine equalities (BANK_FILTERS), newest year first, then by number."""
    return matching(for_owner(bank, owner), BANK_FILTERS, **filters).orderBy(*bank_order())


def list_materials(materials: DataFrame, owner: str, **filters) -> DataFrame:
    """A tenant's materials by up to five equalities (MATERIAL_FILTERS), newest first."""
    return matching(for_owner(materials, owner), MATERIAL_FILTERS, **filters).orderBy(F.desc_nulls_last("created_at"))


def catalog_rows(table: DataFrame, owner: str) -> DataFrame:
    """A tenant's classes, units or chapters by position."""
    return for_owner(table, owner).orderBy(F.asc_nulls_last("position"))


def list_papers(papers: DataFrame, owner: str) -> DataFrame:
    return for_owner(papers, owner).orderBy(F.desc_nulls_last("year"), F.desc_nulls_last("created_at"))


def knowledge_status(knowledge: DataFrame, owner: str) -> DataFrame:
    """Build states without the vectors, which are not read, newest first."""
    kept = [c for c in knowledge.columns if not c.endswith("_embedding")]
    return for_owner(knowledge, owner).select(*kept).orderBy(F.desc_nulls_last("extracted_at"))


def bank_counts(bank: DataFrame) -> DataFrame:
    """owner_id, question_paper_id, n_rows, ids (in the order of the bank's numbers) of every paper."""
    rows = bank.where(F.col("question_paper_id").isNotNull())
    by_no = F.struct(F.coalesce("question_no", F.lit(UNNUMBERED)).alias("no"), "id")
    ids = F.transform(F.array_sort(F.collect_list(by_no)), lambda x: x["id"])
    return rows.groupBy("owner_id", "question_paper_id").agg(F.count(F.lit(1)).alias("n_rows"), ids.alias("ids"))


def of_chapter(bank: DataFrame, chapter_id, origin_type: str | None = None) -> DataFrame:
    return matching(bank, BANK_FILTERS, chapter_id=chapter_id, origin_type=origin_type)


def of_paper_or_material(bank: DataFrame, source_id) -> DataFrame:
    """Questions of a paper or a material; none for a null id."""
    return bank.where((F.col("question_paper_id") == source_id) | (F.col("material_id") == source_id))


def paper_order() -> list[Column]:
    """By number, unnumbered last."""
    return [F.coalesce("question_no", F.lit(UNNUMBERED))]


def in_paper(row: str) -> WindowSpec:
    """A window over each paper's rows; rows without a paper, which have no place in one, are dealt by `row` and not gathered as one group."""
    return Window.partitionBy("owner_id", "question_paper_id", F.when(F.col("question_paper_id").isNull(), F.col(row)))


def practice_order() -> list[Column]:
    """By number, unnumbered last; then the newest year, unknown as 0; then the source."""
    return [*paper_order(), F.desc(F.coalesce("year", F.lit(0))), F.coalesce("source", F.lit(""))]


def set_key() -> Column:
    """series:set:code of a question, missing parts empty: questions of different sets never meet."""
    return F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("series", "set", "code_no")])


def set_order() -> list[Column]:
    return [set_key(), *paper_order()]


def stored_order() -> list[Column]:
    """Newest first; what was never stored comes last."""
    return [F.desc(F.coalesce(F.col("stored_at").cast("timestamp"), F.timestamp_seconds(F.lit(0))))]


def concepts_of(concepts: DataFrame, knowledge: DataFrame, class_id=None, unit_id=None) -> DataFrame:
    """Concepts of the chapters whose knowledge lies in a class or unit, with both ids, by position."""
    known = matching(knowledge, ("class_id", "unit_id"), class_id=class_id, unit_id=unit_id)
    keys = keys_of(concepts, known, keys=("chapter_id",))
    return concepts.join(known.select(*keys, "class_id", "unit_id"), keys).orderBy(*keys, "position")


def ids_in_order(first: DataFrame, *more: DataFrame) -> DataFrame:
    """id, source: the distinct ids of several tables, each under the first table that has it."""
    every = None
    for k, t in enumerate((first, *more)):
        part = t.select("id", F.lit(k).alias("source"))
        every = part if every is None else every.unionByName(part)
    return every.where("id is not null").groupBy("id").agg(F.min("source").alias("source"))


def replace_numbers(rows: DataFrame, retried: DataFrame) -> DataFrame:
    """rows with the numbers that were read again taken from `retried`; others stay."""
    keys = keys_of(rows, retried, keys=("paper_id", "question_no"))
    return rows.join(retried.select(*keys).distinct(), keys, "left_anti").unionByName(retried)
