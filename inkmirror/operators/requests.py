"""Attempt logs: resolved requests and pacing."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rules import over_quota, parsed_body, request_outcome, retryable_status
from ..functions.times import BACKOFF_BASE_MS, BACKOFF_CAP_MS, DEFAULT_QPS, MAX_RETRIES, retry_delay_ms, schedule_interval


def classify(attempts: DataFrame) -> DataFrame:
    """Outcome, quota test and retry test of each logged attempt."""
    body = parsed_body("payload")
    return attempts.withColumns(
        {
            "outcome": request_outcome("status", "payload"),
            "quota_body": over_quota(body["code"], body["msg"]),
            "retryable": retryable_status("status"),
        }
    )


def resolve(attempts: DataFrame, max_retries: int = MAX_RETRIES) -> DataFrame:
    """Final outcome of each request: the first terminal attempt within the limit,
    else ``failed``; with the attempts made and the time waited between them."""
    allowed = attempts.where(F.col("attempt") <= max_retries + 1)
    terminal = F.col("outcome") != "retryable"
    per_request = allowed.groupBy("request_id").agg(
        F.min(F.when(terminal, F.struct("attempt", "outcome"))).alias("first_terminal"),
        F.max("attempt").alias("last_attempt"),
    )
    return with_waits(
        per_request.select(
            "request_id",
            F.coalesce(F.col("first_terminal.outcome"), F.lit("failed")).alias("resolution"),
            F.coalesce(F.col("first_terminal.attempt"), F.col("last_attempt")).alias("attempts_made"),
        )
    )


def with_waits(resolved: DataFrame) -> DataFrame:
    """Resolved requests with the time waited between their attempts."""
    made = F.col("attempts_made")
    waits = F.aggregate(
        F.when(made > 1, F.sequence(F.lit(1), made - 1)).otherwise(F.array().cast("array<int>")),
        F.lit(0).cast("bigint"),
        lambda total, retry: total + retry_delay_ms(retry),
    )
    return resolved.withColumn("waited_ms", waits)


def delays_ms(attempts: int) -> list[int]:
    """Backoff after each of the first attempts."""
    return [min(BACKOFF_BASE_MS * 2**n, BACKOFF_CAP_MS) for n in range(attempts)]


def pacing(requests: DataFrame, client: str, time: str, qps: float = DEFAULT_QPS) -> DataFrame:
    """Requests per client that follow the previous one in less than the minimum gap.

    Within a slot one gap wide every request after the first is too close; the
    first of a slot is compared with the last of the slot before. So per-slot
    aggregates suffice, and a busy client is spread over its slots.
    """
    gap_micros = math.ceil(1000 / qps) * 1000
    micros = F.unix_micros(F.col(time).cast("timestamp"))
    slots = (
        requests.select(F.col(client).alias("client"), micros.alias("at"))
        .groupBy("client", F.floor(F.col("at") / gap_micros).alias("slot"))
        .agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first_at"), F.max("at").alias("last_at"))
    )
    previous = slots.select("client", (F.col("slot") + 1).alias("slot"), F.col("last_at").alias("before_at"))
    linked = slots.join(previous, ["client", "slot"], "left")
    first_close = F.coalesce((F.col("first_at") - F.col("before_at") < gap_micros).cast("int"), F.lit(0))
    return linked.groupBy("client").agg(
        F.sum("n").alias("requests"), F.sum(F.col("n") - 1 + first_close).alias("too_close")
    )


def due_runs(activity: DataFrame, client: str, time: str, value: Column, unit: Column) -> DataFrame:
    """``client, interval_ms, clamped, due``: runs that each client's schedule starts from its
    first activity to its last, the first one interval after the start. Combined minima and
    maxima per client; the settings are expressions on the client."""
    spans = activity.select(F.col(client).alias("client"), F.unix_micros(F.col(time).cast("timestamp")).alias("at"))
    spans = spans.groupBy("client").agg(F.min("at").alias("first_at"), F.max("at").alias("last_at"))
    interval, clamped = schedule_interval(value, unit)
    timed = spans.select("client", interval.alias("interval_ms"), clamped.alias("clamped"), (F.col("last_at") - F.col("first_at")).alias("span"))
    return timed.select("client", "interval_ms", "clamped", F.expr("span div (interval_ms * 1000)").alias("due"))
