"""Class trees to flat tables, and why an extraction found nothing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from examlake.operators.scans import keys_of

#: Fixed value: fewer English letters than this in a text mean that it can't be read as text.
LEAST_LETTERS = 25


def flatten_catalog(catalog: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(classes, units, chapters) of class trees, one row a class, ready for keyed upserts.

    catalog: owner_id, position, id, name, units: array<struct<id, name, title, marks, chapters:
    array<struct<id, name>>>>. Positions below the class are array indexes; null or empty arrays give
    no rows.
    """
    classes = catalog.select("owner_id", "id", "name", "position")
    units = catalog.select("owner_id", F.col("id").alias("class_id"), F.posexplode("units").alias("position", "u"))
    flat = units.select("owner_id", F.col("u.id").alias("id"), "class_id", "u.name", "u.title", "u.marks", "position")
    chapters = units.select("owner_id", "class_id", F.col("u.id").alias("unit_id"), F.posexplode("u.chapters").alias("position", "c"))
    return classes, flat, chapters.select("owner_id", F.col("c.id").alias("id"), "unit_id", "class_id", "c.name", "position")


def failure_reasons(runs: DataFrame) -> DataFrame:
    """runs with `reason`, the first that holds, for papers whose extraction found no question.

    runs: model_configured, model_error, images_tried, images_read, image_batches, english_letters.
    Null flags count as false, null numbers as 0.
    """
    n = {c: F.coalesce(F.col(c), F.lit(0)) for c in ("images_read", "image_batches", "english_letters")}
    tried = F.coalesce("images_tried", F.lit(False))
    reason = (
        F.when(~F.coalesce("model_configured", F.lit(False)), "No model is configured.")
        .when(F.col("model_error") != "", F.col("model_error"))
        .when(tried & (n["images_read"] == 0), "No page could be rendered as an image.")
        .when(tried, F.format_string("%d page image(s) in %d batch(es) were read, but none held a valid question.", n["images_read"].cast("int"), n["image_batches"].cast("int")))
        .when(n["english_letters"] < LEAST_LETTERS, "The file has no selectable text, and no page image was read.")
        .otherwise("The model returned no valid question.")
    )
    return runs.withColumn("reason", reason)


def chapter_index(classes: DataFrame, units: DataFrame, chapters: DataFrame) -> DataFrame:
    """owner_id (where all have it), class_id, unit_id, chapter_id, name, unit_name (`name — title`) of every chapter in its unit and class."""
    owner = keys_of(classes, units, chapters, keys=())
    c = classes.select(*owner, F.col("id").alias("class_id"))
    u = units.select(*owner, "class_id", F.col("id").alias("unit_id"), F.concat_ws(" — ", "name", F.nullif(F.col("title"), F.lit(""))).alias("unit_name"))
    inside = u.join(c, [*owner, "class_id"])
    return chapters.select(*owner, "unit_id", F.col("id").alias("chapter_id"), "name").join(inside, [*owner, "unit_id"]).select(*owner, "class_id", "unit_id", "chapter_id", "name", "unit_name")


def attach_files(files: DataFrame, chapters: DataFrame, order: list) -> DataFrame:
    """files whose class, unit and chapter are all one chapter's; of rows with one file_id the first by `order`."""
    owner = keys_of(files, chapters, keys=())
    keys = [*owner, "class_id", "unit_id", "chapter_id"]
    first = Window.partitionBy(*owner, "file_id").orderBy(*order)
    fitting = files.join(chapters.select(*keys).distinct(), keys, "left_semi")
    return fitting.withColumn("__rn", F.row_number().over(first)).where("__rn = 1").drop("__rn")


def merge_remote(local: DataFrame, remote: DataFrame, keys: list[str], keep_local: tuple[str, ...] = ()) -> DataFrame:
    """Rows of both by key: the remote value where there is one, else the local; in `keep_local` columns the other way round."""
    columns = [c for c in dict.fromkeys([*local.columns, *remote.columns]) if c not in keys]
    a = local.select(*keys, *[F.col(c).alias(f"__l_{c}") for c in columns if c in local.columns])
    b = remote.select(*keys, *[F.col(c).alias(f"__r_{c}") for c in columns if c in remote.columns])

    def value(c: str) -> Column:
        sides = [f"__r_{c}"] * (c in remote.columns) + [f"__l_{c}"] * (c in local.columns)
        return F.coalesce(*(reversed(sides) if c in keep_local else sides)).alias(c)

    return a.join(b, keys, "full_outer").select(*keys, *[value(c) for c in columns])


def with_previous_page(pages: DataFrame) -> DataFrame:
    """pages (paper keys, page_no, text) with previous_text, the page before it; null for the first."""
    w = Window.partitionBy(*keys_of(pages)).orderBy("page_no")
    return pages.withColumn("previous_text", F.lag("text").over(w))


def with_batch_no(rows: DataFrame, group: list[str], order: list, size: int) -> DataFrame:
    """rows with batch_no from 0: `size` rows of a group each, in `order`."""
    place = F.row_number().over(Window.partitionBy(*group).orderBy(*order)) - 1
    return rows.withColumn("batch_no", F.floor(place / size).cast("int"))


def storage_path(name: Column, *folders: Column, id_: Column) -> Column:
    """folder/.../id-name: the name's unsafe signs as underscores, 80 characters of it."""
    safe = F.substring(F.regexp_replace(name, "[^a-zA-Z0-9._-]+", "_"), 1, 80)
    return F.concat_ws("/", *folders, F.concat(id_.cast("string"), F.lit("-"), safe))


def path_owner(path: Column) -> Column:
    """The first folder of a stored path: whoever owns it."""
    return F.split_part(path, F.lit("/"), F.lit(1))


def owned_files(files: DataFrame) -> DataFrame:
    """files whose path lies in their owner's folder."""
    return files.where(path_owner(F.col("path")) == F.col("owner_id"))


def replace_all(base: DataFrame, parents: list[tuple[DataFrame, DataFrame]], on: list[str]) -> DataFrame:
    """base after several replacements (parents, their new children) in turn: a parent's children are all replaced, none stays."""
    from examlake.operators.bank import replace_children

    return reduce(lambda rows, x: replace_children(rows, x[0], x[1], on), parents, base)


def merge_by_key(base: DataFrame, updates: DataFrame, keys: list[str]) -> DataFrame:
    """base with the columns of updates (unique on keys) put in, nulls too; its other columns stay, new rows have them null."""
    put = [c for c in updates.columns if c not in keys]
    new = updates.select(*keys, F.struct(F.lit(True).alias("there"), *put).alias("__new"))
    rows = base.withColumn("__old", F.lit(True)).join(new, keys, "full_outer")
    known = F.col("__new").isNotNull()
    return rows.select(*[F.when(known, F.col(f"__new.{c}")).otherwise(F.col(c)).cast(base.schema[c].dataType).alias(c) if c in put else F.col(c) for c in base.columns])


def sync_catalog(classes: DataFrame, units: DataFrame, chapters: DataFrame, catalog: DataFrame, only: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(classes, units, chapters) with whole class trees written by (owner_id, id), positions as in the trees; nothing is deleted.

    catalog: as for `flatten_catalog`; only: owner_id, id of the classes to write, all if None. Columns that
    trees lack keep their values. Running it twice changes nothing.
    """
    trees = catalog if only is None else catalog.join(only.select("owner_id", "id").distinct(), ["owner_id", "id"], "left_semi")
    flat = flatten_catalog(trees)
    return tuple(merge_by_key(base, rows, ["owner_id", "id"]) for base, rows in zip((classes, units, chapters), flat, strict=True))


def ensure_branches(classes: DataFrame, units: DataFrame, chapters: DataFrame, catalog: DataFrame, branches: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(classes, units, chapters, missing) with only the class, unit and chapter of each branch written from the trees.

    branches: owner_id, class_id, unit_id, chapter_id. A branch that the trees don't have as a whole
    writes nothing and is in `missing`.
    """
    keys = ["owner_id", "class_id", "unit_id", "chapter_id"]
    flat = flatten_catalog(catalog)
    paths = flat[2].select("owner_id", "class_id", "unit_id", F.col("id").alias("chapter_id"))
    wanted = branches.select(*keys).distinct()
    found = wanted.join(paths, keys, "left_semi")
    out = []
    for base, rows, column in zip((classes, units, chapters), flat, keys[1:], strict=True):
        ids = found.select("owner_id", F.col(column).alias("id")).distinct()
        out.append(merge_by_key(base, rows.join(ids, ["owner_id", "id"], "left_semi"), ["owner_id", "id"]))
    return (*out, wanted.join(paths, keys, "left_anti"))
