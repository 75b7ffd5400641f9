"""Answers from outside: a model or service that the user supplies as a function, or a table of answers.

A provider is a function of a table of requests (the key columns, and what is asked) to a table of
the keys, the answer's columns, model, prompt_tokens, completion_tokens, attempts and error, one row
a request. Operators that need answers take one; whoever reads the result twice writes it first
(`sources.written`), as each reading asks again.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from examlake.operators.folds import typed

#: Questions and texts of one request, tries in all, seconds to wait after the first (twice that after the second), characters of an error kept.
QUESTIONS, TEXTS = 15, 20
TRIES, WAIT, ERROR_CHARS = 3, 15.0, 200
COUNTED = "model string, prompt_tokens long, completion_tokens long, attempts int, error string"
NO_ANSWER = "There is no answer."
Provider = Callable[[DataFrame], DataFrame]


class TryAgain(Exception):
    """Raised by a call that may succeed later; `after` says in how many seconds."""

    def __init__(self, message: str = "", after: float | None = None):
        super().__init__(message)
        self.after = after


def ask(call: Callable[[list[dict]], list[dict]], requests: list[dict], tries: int = TRIES, wait: float = WAIT, sleep: Callable[[float], None] = time.sleep) -> tuple[list[dict], int, str | None]:
    """(answers, attempts, error) of one call; answers are as many as requests, empty ones where it failed.

    A call that raises TryAgain is repeated, `tries` times in all; other errors and a wrong number of
    answers are final.
    """
    for attempt in range(1, tries + 1):
        try:
            found = list(call(requests))
        except TryAgain as e:
            error = str(e) or "The service asked to try again."
            if attempt < tries:
                sleep(attempt * wait if e.after is None else e.after)
            continue
        except Exception as e:  # noqa: BLE001  the user's function may raise anything; its message is the result
            return [{}] * len(requests), attempt, (str(e) or type(e).__name__)[:ERROR_CHARS]
        if len(found) != len(requests):
            return [{}] * len(requests), attempt, f"{len(requests)} asked, {len(found)} answered."
        return [a or {} for a in found], attempt, None
    return [{}] * len(requests), tries, error[:ERROR_CHARS]


def from_function(call: Callable[[list[dict]], list[dict]], answer: str, keys: list[str], group: list[str] = (), size: int = QUESTIONS, tries: int = TRIES, wait: float = WAIT) -> Provider:
    """A provider that hands `call` up to `size` requests (as dicts) of one `group` at a time and takes a dict for each.

    answer: the DDL of the answer's columns; keys: the columns that name a request. The dicts hold the
    answer's columns, and model, prompt_tokens and completion_tokens if known; a dict may bring an
    `error` of its own. The calls run in tasks on sorted partitions, so no group is held whole. A
    request that fails keeps its row, with the error in place of the answer.
    """

    def provide(requests: DataFrame) -> DataFrame:
        group_, names = list(group), requests.columns
        schema = ", ".join([typed(requests, keys), answer, COUNTED])
        columns = [f.name for f in requests.sparkSession.createDataFrame([], schema).schema]

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held: list[dict] = []

            def flush() -> pd.DataFrame:
                found, attempts, error = ask(call, held, tries, wait)
                rows = [{**a, **{k: r[k] for k in keys}, "attempts": attempts, "error": error or a.get("error")} for r, a in zip(held, found, strict=True)]
                held.clear()
                return pd.DataFrame([[r.get(c) for c in columns] for r in rows], columns=columns, dtype=object)

            for batch in batches:
                for values in batch.astype(object).where(batch.notna(), None).itertuples(index=False, name=None):
                    row = dict(zip(names, values, strict=True))
                    if held and (len(held) >= size or any(held[0][g] != row[g] for g in group_)):
                        yield flush()
                    held.append(row)
            if held:
                yield flush()

        dealt = requests.repartition(*group_) if group_ else requests
        return dealt.sortWithinPartitions(*(group_ or keys), *keys).mapInPandas(run, schema)

    return provide


def from_table(answers: DataFrame, on: list[str]) -> Provider:
    """A provider that looks requests up in a table, unique on `on`; a request without a row has the error NO_ANSWER."""

    def provide(requests: DataFrame) -> DataFrame:
        rest = [c for c in answers.columns if c not in on]
        put = [F.col(c) if c in rest else F.lit(None).cast(kind).alias(c) for c, kind in (x.split() for x in COUNTED.split(", ")) if c not in ("attempts", "error")]
        found = requests.join(answers.withColumn("__known", F.lit(True)), on, "left")
        told = F.when(F.col("__known").isNull(), NO_ANSWER)
        error = F.coalesce(F.col("error"), told) if "error" in rest else told
        shown = [c for c in rest if c not in COUNTED.replace(",", " ").split()]
        return found.select(*requests.columns, *[c for c in shown if c not in requests.columns], *put, F.lit(1).alias("attempts"), error.alias("error"))

    return provide


def vectors_of(inputs: DataFrame, provider: Provider) -> DataFrame:
    """input, embedding, error of the different texts of inputs (a column `input`): trimmed, blank ones left out, each asked for once."""
    texts = inputs.select(F.regexp_replace("input", r"^\s+|\s+$", "").alias("input")).where("input <> ''").distinct()
    return provider(texts).select("input", "embedding", "error")


def usage_of(answers: DataFrame, action: str, *keys: str) -> DataFrame:
    """Usage events (keys, action, model, prompt_tokens, completion_tokens) of answers that name their model; failed ones gave none."""
    known = answers.where("model is not null and error is null")
    return known.select(*keys, F.lit(action).alias("action"), "model", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("prompt_tokens", "completion_tokens")])
