"""Tables in folders by owner and class: pruned scans, keyed writes that touch one owner's folders."""

import os

from examlake.operators import scans
from examlake.sources.layout import read_tenants, upsert_tenants, write_tenants

BANK = "owner_id string, class_id string, id string, question_no int, year int, question_text string"
ROWS = [(f"u{o}", f"c{c}", f"{o}-{c}-{i}", i, 2000 + i, "text") for o in range(4) for c in range(3) for i in range(5)]


def _files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_a_search_prunes_folders_and_pushes_filters(spark, tmp_path):
    write_tenants(spark.createDataFrame(ROWS, BANK), str(tmp_path / "bank"))
    found = scans.search_bank(read_tenants(spark, str(tmp_path / "bank")), "u1", class_id="c2", year=2003)
    assert [(r.id, r.question_no) for r in found.collect()] == [("1-2-3", 3)]
    plan = found._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    filters = next(line for line in plan.split("\n") if "PartitionFilters" in line)
    assert "u1" in filters and "c2" in filters and "year" in next(line for line in plan.split("\n") if "PushedFilters" in line)


def test_an_upsert_touches_one_owner(spark, tmp_path):
    path = str(tmp_path / "bank")
    write_tenants(spark.createDataFrame(ROWS, BANK), path)
    before = _files(path)
    new = [("u1", "c0", "1-0-0", 0, 1999, "changed"), ("u1", "c9", "1-1-4", 4, 2004, "moved"), *[("u1", "c0", f"1-2-{i}", i, 2000 + i, "moved all") for i in range(5)], ("u1", "c0", "1-0-x", 7, 2007, "new")]
    upsert_tenants(spark.createDataFrame(new, BANK), path, ["owner_id", "id"])
    want = {(o, i): (c, n, y, t) for o, c, i, n, y, t in [*ROWS, *new]}
    show = lambda: {(r.owner_id, r.id): (r.class_id, r.question_no, r.year, r.question_text) for r in read_tenants(spark, path).collect()}
    assert show() == want and read_tenants(spark, path).count() == len(want)
    after = _files(path)
    changed = {f for f in {*before, *after} if before.get(f) != after.get(f)}
    assert changed and all("owner_id=u1" in f for f in changed) and not os.path.exists(f"{path}/owner_id=u1/class_id=c2")
    upsert_tenants(spark.createDataFrame(new, BANK), path, ["owner_id", "id"])
    assert show() == want
