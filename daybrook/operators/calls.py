"""Metrics over the model call log: ``run, account, ts, label, model, prompt_tokens,
completion_tokens, total_tokens, latency_sec, attempts, fallback_used, ok, error``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import RATE_WINDOW
from ..functions.core import to_int
from . import ordered


def _tokens() -> dict[str, Column]:
    p, c, t = to_int("prompt_tokens"), to_int("completion_tokens"), to_int("total_tokens")
    return {"p": p, "c": c, "t": F.when(t != 0, t).otherwise(p + c)}


def summary(calls: DataFrame) -> DataFrame:
    """Calls, outcomes, tokens and latency by label and model with all subtotals."""
    t = _tokens()
    return calls.rollup("label", "model").agg(
        F.count("*").alias("calls"), F.count_if("ok").alias("ok"), F.count_if(~F.col("ok")).alias("degraded"),
        F.count_if("fallback_used").alias("fallbacks"), F.sum(t["p"]).alias("prompt_tokens"),
        F.sum(t["c"]).alias("completion_tokens"), F.sum(t["t"]).alias("total_tokens"),
        F.round(F.sum("latency_sec"), 3).alias("latency_sec"), F.grouping_id().cast("int").alias("level"))


def over_rate(calls: DataFrame, per_minute: int, *, key: str = "account", tie: str = "call_id",
              window_sec: float = RATE_WINDOW, bucket_sec: float = 3600.0) -> DataFrame:
    """Calls of an account in the trailing window and the wait the limit would have asked for.

    ``wait_sec`` is how long the call should have waited for the ``per_minute``-th call
    before it to leave the window; 0 when there was room.
    """
    us = F.unix_micros("ts")
    cut = ordered.with_lookback(calls, F.col("ts"), window_sec, bucket_sec)
    seq = Window.partitionBy(key, "_bucket").orderBy("ts", tie)
    nth = F.lag(us, per_minute).over(seq)
    age = (us - nth) / 1e6
    wait = F.when(age < window_sec, window_sec - age).otherwise(F.lit(0.0))
    waited = cut.withColumn("wait_sec", F.coalesce(wait, F.lit(0.0))).where(~F.col("_lent")).drop("_bucket", "_lent")
    return ordered.trailing_count(waited, [key], F.col("ts"), F.col(tie), window_sec, "in_window",
                                  bucket_sec=bucket_sec, closed=False)


def is_rate_limit(error: Column) -> Column:
    low = F.lower(F.coalesce(error, F.lit("")))
    return low.contains("429") | low.contains("rate-limit") | low.contains("rate limit")


def after_breaker(calls: DataFrame) -> DataFrame:
    """Calls that still went to a model after its first throttling in the run."""
    first = calls.where(is_rate_limit(F.col("error"))).groupBy("run", "model").agg(F.min("ts").alias("tripped_at"))
    return calls.join(first, ["run", "model"]).where(F.col("ts") > F.col("tripped_at"))


# Verdict classes and their exit codes (0 ok, 1 hard, 2 rate limited, 3 no key).
VERDICTS = (("no_key", 3), ("rate_limited", 2), ("auth", 1), ("config", 1), ("unreachable", 1), ("failed", 1))


def error_class(error: Column) -> Column:
    low = F.lower(F.coalesce(error, F.lit("")))

    def has(*words: str) -> Column:
        hit = F.lit(False)
        for w in words:
            hit = hit | low.contains(w)
        return hit
    return F.when(has("no api key"), F.lit("no_key")).when(has("http 429", "rate-limit", "rate limit"), F.lit("rate_limited")) \
        .when(has("http 401", "http 403"), F.lit("auth")).when(has("http 404"), F.lit("config")) \
        .when(has("network", "urlopen", "refused", "timed out"), F.lit("unreachable")).otherwise(F.lit("failed"))


def exit_code(ok: Column, error: Column) -> Column:
    code = F.lit(1)
    kind = error_class(error)
    for name, value in VERDICTS:
        code = F.when(kind == name, F.lit(value)).otherwise(code)
    return F.when(ok, F.lit(0)).otherwise(code)


def overall_exit(calls: DataFrame, key: str = "run") -> DataFrame:
    """One code per run: any success wins, then no key, hard, rate limited."""
    rank = F.create_map(*[F.lit(v) for pair in ((0, 0), (3, 1), (1, 2), (2, 3)) for v in pair])
    code = exit_code(F.col("ok"), F.col("error"))
    return calls.groupBy(key).agg(F.min_by(code, rank[code]).alias("exit_code"))
