"""Deletes over the graph of references between the stored tables."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from graphlib import TopologicalSorter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from examlake.sources.written import written


@dataclass(frozen=True)
class Edge:
    """child.column names a row of parent by its id: the child's row goes with it, or loses the reference (`nulls`)."""

    child: str
    column: str
    parent: str
    nulls: bool = False


def _edges(child: str, **parents: str) -> list[Edge]:
    return [Edge(child, column, parent) for column, parent in parents.items()]


_PLACE = {"class_id": "classes", "unit_id": "units", "chapter_id": "chapters"}
#: The references between the stored tables.
EDGES = (
    *_edges("units", class_id="classes"),
    *_edges("chapters", class_id="classes", unit_id="units"),
    *_edges("materials", **_PLACE),
    *_edges("question_papers", class_id="classes"),
    *_edges("question_bank", **_PLACE, material_id="materials", question_paper_id="question_papers"),
    *_edges("syllabus_knowledge", **_PLACE), Edge("syllabus_knowledge", "material_id", "materials", nulls=True),
    *_edges("chapter_concepts", chapter_id="chapters", syllabus_knowledge_id="syllabus_knowledge"),
    *_edges("question_classifications", chapter_id="chapters", question_id="question_bank"),
    *_edges("extraction_jobs", question_paper_id="question_papers"),
    Edge("openai_usage_events", "job_id", "extraction_jobs", nulls=True),
)


def delete_rows(tables: dict[str, DataFrame], gone: dict[str, DataFrame], edges: tuple[Edge, ...] = EDGES) -> dict[str, DataFrame]:
    """tables after the rows of `gone` ({table: owner_id, id}) are deleted, with all that refers to them.

    Tables have owner_id and id, unique together, and the columns of their edges; edges of a missing
    table or column are passed over. They are walked parents first: each is joined once with the ids
    that go in each of its parents, and its own are written for its children. A null reference names
    nothing; rows of other owners stay. Circles of deleting edges are an error.
    """
    edges = [e for e in edges if e.child in tables and e.parent in tables and e.column in tables[e.child].columns]
    order = TopologicalSorter({t: [e.parent for e in edges if e.child == t and not e.nulls] for t in tables}).static_order()
    doomed: dict[str, DataFrame] = {}
    for name in order:
        ids = [gone[name].select("owner_id", "id")] if name in gone else []
        for e in (e for e in edges if e.child == name and not e.nulls and e.parent in doomed):
            above = doomed[e.parent].withColumnRenamed("id", e.column)
            ids.append(tables[name].select("owner_id", "id", e.column).join(above, ["owner_id", e.column], "left_semi").select("owner_id", "id"))
        if ids:
            doomed[name] = written(reduce(DataFrame.unionByName, ids).where("owner_id is not null and id is not null").distinct(), f"gone-{name}")
    out = {}
    for name, table in tables.items():
        kept = table.join(doomed[name], ["owner_id", "id"], "left_anti") if name in doomed else table
        for e in (e for e in edges if e.child == name and e.nulls and e.parent in doomed):
            lost = doomed[e.parent].select("owner_id", F.col("id").alias(e.column), F.lit(True).alias("__lost"))
            kept = kept.join(lost, ["owner_id", e.column], "left").withColumn(e.column, F.when(F.col("__lost").isNull(), F.col(e.column))).drop("__lost")
        out[name] = kept.select(*table.columns)
    return out
