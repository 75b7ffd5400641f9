"""Streams: job states with timers, closed days with a watermark, a store that survives a crash."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from examlake.operators import reports
from examlake.streaming.store import KEPT, Store, read_store, rewrite_buckets
from examlake.streaming.usage import closed_days, daily_usage, job_states

CHANGES = "owner_id string, job_id string, status string, phase string, question_count long, error string, updated_at timestamp"
AT = datetime.datetime(2024, 3, 1, 8)


def _feed(df, path, batches):
    for rows in batches:
        df.sparkSession.createDataFrame(rows, df.schema).coalesce(1).write.mode("append").parquet(path)


def _latest(rows):
    """Each job's last row in the order in which the stream gave them."""
    out = {}
    for batch in rows:
        for r in batch:
            out[r.owner_id, r.job_id] = (r.status, r.phase, r.question_count, r.error, r.updated_at)
    return out


def _run(spark, path, checkpoint, seen, **options):
    stream = job_states(spark.readStream.schema(CHANGES).parquet(path), **options)
    q = stream.writeStream.outputMode("update").foreachBatch(lambda df, _: seen.append(df.collect())).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def test_job_states_equal_the_batch_form(spark, tmp_path):
    """Out of order, repeated, in several batches and over a restart."""
    random.seed(5)
    steps = [("running", "extracting", 5, None), ("running", "saving", 7, None), ("failed", "failed", None, "timeout"), ("completed", "completed", 9, None)]
    rows = [(o, f"j{j}", *steps[k % 4], AT + datetime.timedelta(minutes=(j * 7 + k * 11) % 50)) for o in "ab" for j in range(12) for k in range(1 + j % 4)]
    rows += rows[::3]
    random.shuffle(rows)
    df = spark.createDataFrame(rows, CHANGES)
    seen: list = []
    for part in (rows[:20], rows[20:45], rows[45:]):
        _feed(df, str(tmp_path / "in"), [part])
        _run(spark, str(tmp_path / "in"), str(tmp_path / "cp"), seen)
    jobs = df.select("owner_id", "job_id").distinct().select("*", *[F.lit(None).cast(k).alias(c) for c, k in (("status", "string"), ("phase", "string"), ("question_count", "long"), ("error", "string"), ("updated_at", "timestamp"))])
    want = {(r.owner_id, r.job_id): (r.status, r.phase, r.question_count, r.error, r.updated_at) for r in reports.apply_job_changes(jobs, df).collect()}
    assert _latest(seen) == want
    before = len([r for b in seen for r in b])
    _run(spark, str(tmp_path / "in"), str(tmp_path / "cp"), seen)  # nothing new: nothing comes
    assert len([r for b in seen for r in b]) == before


def test_finished_jobs_are_let_go_and_late_changes_dropped(spark, tmp_path):
    change = lambda job, status, hours: ("a", job, status, status, 1, None, AT + datetime.timedelta(hours=hours))
    df, seen = spark.createDataFrame([], CHANGES), []
    for part in ([change("x", "completed", 0), change("y", "running", 0)], [change("z", "running", 100)], [change("z", "running", 101), change("y", "completed", 1)], [change("x", "running", 100), change("y", "completed", 102)]):
        _feed(df, str(tmp_path / "in"), [part])
        _run(spark, str(tmp_path / "in"), str(tmp_path / "cp"), seen, watermark="2 hours", keep="1 hour")
    rows = [(r.job_id, r.status, r.updated_at) for b in seen for r in b]
    assert ("y", "completed", AT + datetime.timedelta(hours=1)) not in rows  # later than the watermark
    assert rows.count(("x", "running", AT + datetime.timedelta(hours=100))) == 1  # x's state was gone: this opens it anew
    assert _latest(seen)["a", "y"][0] == "completed"


def test_closed_days_in_files(spark, tmp_path):
    schema = "owner_id string, action string, created_at timestamp, prompt_tokens long"
    event = lambda day, hour, n: ("a", "extract.text", datetime.datetime(2024, 3, day, hour), n)
    df = spark.createDataFrame([], schema)
    first, second, late, last = [event(1, 9, 5), event(1, 10, 6)], [event(3, 9, 7), event(1, 23, 1)], [event(1, 11, 100), event(3, 12, 2)], [event(6, 1, 9)]
    path = str(tmp_path / "out")
    for part in (first, second, late, last, []):
        if part:
            _feed(df, str(tmp_path / "in"), [part])
        q = closed_days(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), path, str(tmp_path / "cp"), watermark="6 hours")
        q.awaitTermination()
    got = sorted((r.day.day, r.calls, r.prompt_tokens) for r in spark.read.parquet(path).collect())
    # all but the row that came after its day was closed, and the day that is still open
    kept = spark.createDataFrame([*first, *second, late[1]], schema)
    assert got == sorted((r.day.day, r.calls, r.prompt_tokens) for r in daily_usage(kept).collect()) == [(1, 3, 12), (3, 2, 9)]


def test_a_crash_leaves_the_store_as_it_was(spark, tmp_path, monkeypatch):
    path, schema = str(tmp_path / "store"), "id long, v long"
    put = lambda old, new: old.join(new.select("id"), "id", "left_anti").unionByName(new)
    batch = lambda *rows: spark.createDataFrame(rows, schema)
    show = lambda: sorted(map(tuple, read_store(spark, path, schema).collect()))
    assert show() == []
    rewrite_buckets(batch((1, 1), (2, 2)), path, ["id"], put, 4)
    whole = Store.put

    def crash(self, rows, touched):
        monkeypatch.setattr(Store, "_drop_old", lambda *_: (_ for _ in ()).throw(RuntimeError("after the pointer")))
        rows.write.partitionBy("bucket").parquet(f"{self.path}/data/half")
        raise RuntimeError("before the pointer")

    monkeypatch.setattr(Store, "put", crash)
    with pytest.raises(RuntimeError, match="before"):
        rewrite_buckets(batch((1, 9), (3, 3)), path, ["id"], put, 4)
    assert show() == [(1, 1), (2, 2)]
    monkeypatch.setattr(Store, "put", whole)
    with pytest.raises(RuntimeError, match="after"):
        rewrite_buckets(batch((1, 9), (3, 3)), path, ["id"], put, 4)
    assert show() == [(1, 9), (2, 2), (3, 3)]
    monkeypatch.undo()
    for k in range(KEPT + 2):  # replays and further batches
        rewrite_buckets(batch((1, 9), (3, 3), (4 + k, k)), path, ["id"], put, 4)
    assert show() == [(1, 9), (2, 2), (3, 3), *[(4 + k, k) for k in range(KEPT + 2)]]
    assert len(Store(spark, path)._pointers()) == KEPT
