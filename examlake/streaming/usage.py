"""Usage roll-up, job states and extracted questions as Structured Streaming jobs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from examlake.operators.bank import persist_questions
from examlake.operators.papers import is_question
from examlake.operators.records import normalized_questions
from examlake.operators.scans import keys_of
from examlake.streaming.store import rewrite_buckets


def daily_usage(events: DataFrame, watermark: str = "1 day") -> DataFrame:
    """Calls and tokens by owner (where events have one), action and day; a batch, or a stream that drops rows later than the watermark."""
    e = events.withWatermark("created_at", watermark) if events.isStreaming else events
    owner = ["owner_id"] if "owner_id" in events.columns else []
    out = e.groupBy(F.window("created_at", "1 day").alias("w"), *owner, "action").agg(F.count(F.lit(1)).alias("calls"), F.sum("prompt_tokens").alias("prompt_tokens"))
    return out.select(F.col("w.start").alias("day"), *owner, "action", "calls", "prompt_tokens")


def closed_days(events: DataFrame, path: str, checkpoint: str, watermark: str = "1 day"):
    """Appends each day's sums to the Parquet files at `path` once the watermark has passed its end.

    A row that comes later than that is dropped. The file sink's log makes every day's rows come once,
    also after a restart; read the files by Spark (spark.read.parquet(path)), which follows that log.
    """
    days = daily_usage(events, watermark)
    return days.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: States in which a job ends.
FINISHED = ("completed", "failed")
STATE = "status string, phase string, question_count long, error string, updated_at timestamp"
_HELD = "status string, phase string, error string, updated_at long, question_count long, counted_at long"


def job_states(changes: DataFrame, watermark: str = "1 day", keep: str = "1 hour") -> DataFrame:
    """A stream of changes (owner_id, job_id, STATE) as a stream of the jobs' states, one row for each that differs from the one before.

    State is kept for each job, not for the whole table: the latest change by updated_at, of equals the
    one with the greater status and error, with the latest count that is known, as
    `reports.apply_job_changes` has it. Repeated changes, and older ones without a count, give no row.
    Changes later than the watermark are dropped; the state of a finished job is let go `keep` after
    that, so what is held follows the jobs that are open or new. A job's last row is its state
    (output mode update).
    """
    keep_ms = int(pd.Timedelta(keep).total_seconds() * 1000)
    names = ["status", "phase", "error", "updated_at", "question_count"]

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = tuple(state.get) if state.exists else None
        now = held or (None, None, None, None, None, None)
        for batch in batches:
            part = batch[names].astype(object)
            for status, phase, error, at, count in part.where(part.notna(), None).itertuples(index=False, name=None):
                at = int(at.value // 1000)
                if now[3] is None or _order(at, status, error) > _order(now[3], now[0], now[2]):
                    now = (status, phase, error, at, *now[4:])
                if count is not None and (now[5] is None or (at, count) > (now[5], now[4])):
                    now = (*now[:4], int(count), at)
        if now == held:
            return
        state.update(now)
        if now[0] in FINISHED:
            state.setTimeoutTimestamp(max(now[3] // 1000, state.getCurrentWatermarkMs()) + keep_ms)
        yield pd.DataFrame([[*key, now[0], now[1], now[4], now[2], pd.Timestamp(now[3], unit="us")]], columns=["owner_id", "job_id", "status", "phase", "question_count", "error", "updated_at"])

    keyed = changes.select("owner_id", "job_id", *names).withWatermark("updated_at", watermark).groupBy("owner_id", "job_id")
    kinds = [changes.schema[c].dataType.simpleString() for c in ("owner_id", "job_id")]
    return keyed.applyInPandasWithState(step, f"owner_id {kinds[0]}, job_id {kinds[1]}, {STATE}", _HELD, "update", "EventTimeTimeout")


def _order(at: int, status: str | None, error: str | None) -> tuple:
    """By time, then status and error, null first."""
    return (at, status is not None, status or "", error is not None, error or "")


def _latest(rows: DataFrame) -> DataFrame:
    key = keys_of(rows, keys=("job_id",))
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct("updated_at", "status")).alias("s")).select(*key, "s.*")


def latest_jobs(changes: DataFrame, store: str, checkpoint: str):
    """Keeps the last state of each job in a bucketed table at `store` (`store.read_store`); replays change nothing."""

    def merge(batch: DataFrame, _: int) -> None:
        rewrite_buckets(_latest(batch), store, keys_of(batch, keys=("job_id",)), lambda old, new: _latest(old.unionByName(new)))

    return changes.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def persist_stream(extracted: DataFrame, store: str, checkpoint: str):
    """Writes newly extracted questions to the bank at `store`, paper by paper: checked, then put in place of the paper's rows.

    extracted: a stream for `normalized_questions`. Of a number's rows the longest text stands, of equals
    the first. A paper without a fit question keeps its rows. A batch that comes twice changes nothing.
    """

    def merge(batch: DataFrame, _: int) -> None:
        rows = normalized_questions(batch)
        key = keys_of(rows)
        fit = rows.where(is_question(F.col("question_no"), F.col("question_text"), F.lit(None).cast("int")))
        rest = [c for c in fit.columns if c not in (*key, "question_no")]
        first = fit.groupBy(*key, "question_no").agg(F.max_by(F.struct(*rest), F.struct(F.length("question_text"), -F.col("row_order"))).alias("s")).select(*key, "question_no", "s.*")
        paper = F.struct(*key)

        def put(old: DataFrame, new: DataFrame) -> DataFrame:
            return persist_questions(old.withColumn("__paper", paper), new.withColumn("__paper", paper), "__paper", [*key, "question_no"]).drop("__paper")

        rewrite_buckets(first, store, key, put)

    return extracted.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
