"""Operators over run events and usage records: rollups, budgets, ladders, gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Smallest gap between requests to one host, in milliseconds, and the retry policy.
HOST_INTERVALS = {"export.arxiv.org": 3100, "arxiv.org": 1500, "api.semanticscholar.org": 1100, "api.openalex.org": 250}
DEFAULT_INTERVAL = 1500
MAX_BACKOFF = 60_000
#: Fixed value: finished items before a remaining time is told.
MIN_SAMPLES = 3


def usage_rollup(usage: DataFrame, step: str, measures: list[str], tokens: str, cost: str) -> DataFrame:
    """Sums per step and, with a null step, in total; ``unpriced``: any row with tokens and no cost."""
    unpriced = F.bool_or((F.coalesce(tokens, F.lit(0)) > 0) & (F.coalesce(cost, F.lit(0)) == 0)).alias("unpriced")
    return usage.rollup(step).agg(*[F.coalesce(F.sum(m), F.lit(0)).alias(m) for m in measures], F.count("*").alias("n_rows"), unpriced)


def turn_budget(turns: DataFrame, key: str, order: list[str], most: int, ratio: float) -> DataFrame:
    """``turns`` with ``turn_no`` and ``action``: steer once at the soft limit, abort at the hard one."""
    soft = min(max(1, int(most * ratio)), most - 1 or 1)
    n = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    action = F.when(F.col("turn_no") == most, "abort").when((F.col("turn_no") == soft) & F.lit(soft < most), "steer").otherwise("continue")
    return turns.withColumn("turn_no", n).withColumn("action", action)


def failure_budget(results: DataFrame, key: str, order: list[str], failed: Column, budget: int) -> DataFrame:
    """``results`` with ``failures`` before each row and whether it was still ``scheduled``."""
    before = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return results.withColumn("failures", F.coalesce(F.sum(failed.cast("int")).over(before), F.lit(0))).withColumn("scheduled", F.col("failures") < budget)


def host_interval(host: Column) -> Column:
    result = F.lit(DEFAULT_INTERVAL)
    for name, ms in HOST_INTERVALS.items():
        result = F.when(host == name, ms).otherwise(result)
    return result


def retry_wait(attempt: Column, asked_ms: Column, interval: Column) -> Column:
    """Milliseconds before an attempt (from 1): what the server asked, else doubling, at least the host's interval."""
    backoff = F.least(F.lit(float(MAX_BACKOFF)), 1000 * F.pow(F.lit(2.0), attempt - 1))
    return F.greatest(F.coalesce(asked_ms.cast("double"), backoff), interval.cast("double"))


def retryable(status: Column) -> Column:
    return status.isin(408, 429) | status.between(500, 599)


def too_close(requests: DataFrame, host: str, order: list[str], end: str, interval_ms: Column, start: str = "start") -> DataFrame:
    """Requests that began sooner after the previous one's end than their host's interval."""
    w = Window.partitionBy(host).orderBy(*order)
    gap = F.timestamp_diff("MICROSECOND", F.lag(end).over(w), F.col(start)) / 1000
    return requests.withColumn("gap_ms", gap).where(F.col("gap_ms") < interval_ms)


def gaps(events: DataFrame, key: str, at: str, order: list[str], seconds: float) -> DataFrame:
    """Silences of at least ``seconds`` within a key: (key, last_at, next_at, gap_s)."""
    rows = events.withColumn("last_at", F.lag(at).over(Window.partitionBy(key).orderBy(*order)))
    rows = rows.withColumn("gap_s", F.timestamp_diff("MICROSECOND", F.col("last_at"), F.col(at)) / 1e6)
    return rows.where(F.col("gap_s") >= seconds).select(key, "last_at", F.col(at).alias("next_at"), "gap_s")


def remaining(progress: DataFrame, key: str, order: list[str], elapsed_ms: str, total: str) -> DataFrame:
    """``progress`` with ``done`` and ``left_ms``, the mean-rate estimate; null while there is no honest one."""
    done = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    rows = progress.withColumn("done", done)
    known = (F.col("done") >= MIN_SAMPLES) & (F.col("done") < F.col(total)) & (F.col(elapsed_ms) > 0)
    return rows.withColumn("left_ms", F.when(known, (F.col(total) - F.col("done")) * F.col(elapsed_ms) / F.col("done")))


def backend_failures(results: DataFrame, query: str, backend: str, error: str, found: str) -> tuple[DataFrame, DataFrame]:
    """(failures per backend, queries no backend answered)."""
    failed = results.where(F.col(error).isNotNull()).groupBy(backend).agg(F.count("*").alias("n_failed"))
    silent = results.groupBy(query).agg(F.bool_and(F.col(error).isNotNull()).alias("all_failed"), F.sum(found).alias("n_found")).where("all_failed AND n_found = 0").select(query)
    return failed, silent
