"""Model usage: costs by model, appended events, roll-ups by job and action."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The price list's version, and US dollars a million tokens (model, input, output).
PRICING_VERSION = "2025-07"
PRICES = {"gpt-4o": (2.5, 10.0), "gpt-4o-mini": (0.15, 0.6), "text-embedding-3-small": (0.02, 0.0)}
#: Models of other names are priced by how the name begins, then by what it holds.
BY_PREFIX = (("gpt-4o-mini", "gpt-4o-mini"), ("gpt-4o", "gpt-4o"))
BY_PART = (("embedding", "text-embedding-3-small"),)


def price_overrides(text: str | None) -> dict[str, tuple[float, float]]:
    """{model: (input, output)} of a JSON object {model: {inputPerMillion, outputPerMillion}}; bad JSON gives none."""
    try:
        given = json.loads(text or "{}")
        return {m: (float(p.get("inputPerMillion") or 0), float(p.get("outputPerMillion") or 0)) for m, p in given.items()}
    except (ValueError, AttributeError, TypeError):
        return {}


def cost_usd(model: Column, prompt_tokens: Column, completion_tokens: Column, overrides: dict | None = None) -> Column:
    """Dollars to six places, decimal(20,6); 0 for a model without a price."""
    name = F.trim(F.coalesce(model, F.lit("")))
    tests = [(name == m, p) for m, p in {**PRICES, **(overrides or {})}.items()]
    tests += [(name.startswith(start), PRICES[m]) for start, m in BY_PREFIX]
    tests += [(F.contains(name, F.lit(part)), PRICES[m]) for part, m in BY_PART]

    def rate(i: int) -> Column:
        out = F.lit(0)
        for test, prices in reversed(tests):
            out = F.when(test, F.lit(str(prices[i])).cast("decimal(12,6)")).otherwise(out)
        return out.cast("decimal(12,6)")

    tokens = lambda c: F.coalesce(c, F.lit(0)).cast("decimal(18,0)")
    micros = F.round(tokens(prompt_tokens) * rate(0) + tokens(completion_tokens) * rate(1), 0)
    return (micros.cast("decimal(26,0)") * F.lit("0.000001").cast("decimal(7,6)")).cast("decimal(20,6)")


def token_counts(payload: Column) -> Column:
    """struct<prompt_tokens, completion_tokens, total_tokens> of an answer's JSON; a missing total is their sum."""
    n = lambda key: F.coalesce(F.get_json_object(payload, f"$.usage.{key}").try_cast("long"), F.lit(0))
    total = F.coalesce(F.nullif(n("total_tokens"), F.lit(0)), n("prompt_tokens") + n("completion_tokens"))
    return F.struct(n("prompt_tokens").alias("prompt_tokens"), n("completion_tokens").alias("completion_tokens"), total.alias("total_tokens"))


def usage_rows(events: DataFrame) -> DataFrame:
    """Events fit to be appended: those with an owner and an action, metadata (map) with the price list's version under what they bring."""
    version = F.create_map(F.lit("pricingVersion"), F.lit(PRICING_VERSION))
    own = F.coalesce("metadata", F.create_map().cast("map<string,string>"))
    merged = F.map_concat(F.map_filter(version, lambda k, v: ~F.map_contains_key(own, k)), own)
    return events.where("owner_id <> '' and action <> ''").withColumn("metadata", merged)


def append_usage(events: DataFrame, path: str) -> None:
    """Appends a batch's usage_rows to the Parquet table at `path`."""
    usage_rows(events).write.mode("append").parquet(path)


def _sums() -> list[Column]:
    total = F.coalesce(F.nullif(F.col("total_tokens"), F.lit(0)), F.col("prompt_tokens") + F.col("completion_tokens"))
    return [F.count(F.lit(1)).alias("calls"), F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"), F.sum(total).alias("total_tokens"), F.sum("cost").alias("cost")]


def priced(events: DataFrame, overrides: dict | None = None) -> DataFrame:
    """events with `cost`, and total_tokens (0) where they lack it."""
    rows = events if "total_tokens" in events.columns else events.withColumn("total_tokens", F.lit(0).cast("long"))
    return rows.withColumn("cost", cost_usd(F.col("model"), F.col("prompt_tokens"), F.col("completion_tokens"), overrides))


def usage_rollup(events: DataFrame, overrides: dict | None = None) -> DataFrame:
    """Calls, tokens and cost by owner, job and action, with a total for each job (action null, is_total true)."""
    rows = priced(events, overrides)
    out = rows.groupingSets([["owner_id", "job_id", "action"], ["owner_id", "job_id"]], "owner_id", "job_id", "action").agg(*_sums(), (F.grouping("action") == 1).alias("is_total"))
    return out.withColumn("cost", F.col("cost").cast("double"))


def usage_summaries(events: DataFrame, overrides: dict | None = None) -> DataFrame:
    """owner_id, job_id, pricing_version, by_action (map of action to its sums), totals of every job."""
    each = priced(events, overrides).groupBy("owner_id", "job_id", "action").agg(*_sums())
    names = ["calls", "prompt_tokens", "completion_tokens", "total_tokens", "cost"]
    bucket = F.struct("action", F.struct(*names).alias("sums"))
    sums = [F.sum(c).alias(c) for c in names[1:3]] + [(F.sum("prompt_tokens") + F.sum("completion_tokens")).alias("total_tokens"), F.sum("cost").alias("cost")]
    per = each.groupBy("owner_id", "job_id").agg(F.map_from_entries(F.sort_array(F.collect_list(bucket))).alias("by_action"), *sums)
    return per.select("owner_id", "job_id", F.lit(PRICING_VERSION).alias("pricing_version"), "by_action", F.struct(*[s for s in names[1:]]).alias("totals"))


def usage_by_action(events: DataFrame, now: Column | None = None, days: int | None = 30, overrides: dict | None = None) -> DataFrame:
    """Sums by owner and action, dearest first, over the `days` before `now` (default: the current time); days None: of all time."""
    rows = events if days is None else events.where(F.col("created_at") > (F.current_timestamp() if now is None else now) - F.make_dt_interval(F.lit(days)))
    return priced(rows, overrides).groupBy("owner_id", "action").agg(*_sums()).orderBy("owner_id", F.desc("cost"), "action")


def last_years(n: int = 10) -> Column:
    """The current year and those before it, newest first; its first is a new paper's year."""
    year = F.year(F.current_date())
    return F.sequence(year, year - (n - 1), F.lit(-1))
