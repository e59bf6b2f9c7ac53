"""Alerts folded by second, level and addresses, and the dashboard questions asked of that table instead of the log.

``second`` is the last whole second at or before an alert and ``whole`` says that the alert came right on it, so ranges
that end at whole seconds, open or closed, are exact. Rows of several micro-batches for one second simply add up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .dashboards import RANGE_SECONDS, trailing_rates

ROLLUP = "second bigint, whole boolean, level string, src_ip string, dst_ip string, n bigint, scored bigint, score_sum double"
KEYS = ["second", "whole", "level", "src_ip", "dst_ip"]


def fold_alerts(alerts: DataFrame) -> DataFrame:
    """The rollup rows of alerts with an event time; those without one are left out."""
    timed = alerts.where(F.col("ts").isNotNull()).withColumn("second", F.unix_seconds("ts"))
    whole = F.unix_micros("ts") == F.col("second") * F.lit(1_000_000)
    return timed.withColumn("whole", whole).groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("n"), F.count("score").alias("scored"), F.coalesce(F.sum("score"), F.lit(0.0)).alias("score_sum"))


def merge_rollups(rollup: DataFrame) -> DataFrame:
    """One row per key; a rollup may be merged at any time without changing an answer."""
    return rollup.groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in ("n", "scored", "score_sum")])


def _ended() -> Column:
    """The whole second at or after the alerts of a row."""
    return F.col("second") + F.when(F.col("whole"), 0).otherwise(1)


def in_range(rollup: DataFrame, seconds: int, as_of: int | None = None) -> DataFrame:
    """Rows of (as_of - seconds, as_of]; ``as_of`` is a whole epoch second, by default that after the newest alert."""
    end = rollup.agg(F.max(_ended())).scalar() if as_of is None else F.lit(as_of)
    # The plain bounds on ``second`` reach the scan.
    rows = rollup if as_of is None else rollup.where(F.col("second").between(as_of - seconds, as_of))
    return rows.where((_ended() > end - seconds) & (_ended() <= end))


def alert_rate(rollup: DataFrame, seconds: int = RANGE_SECONDS, level: str | None = None, as_of: int | None = None) -> DataFrame:
    """Alerts per second over the trailing range."""
    wanted = F.col("n") if level is None else F.when(F.col("level") == level, F.col("n"))
    return in_range(rollup, seconds, as_of).agg((F.coalesce(F.sum(wanted), F.lit(0)) / F.lit(float(seconds))).alias("rate"))


def _step(step_seconds: int) -> Column:
    start = F.col("second") - F.pmod(F.col("second"), F.lit(step_seconds))
    return F.timestamp_seconds(start).alias("step")


def level_series(rollup: DataFrame, step_seconds: int) -> DataFrame:
    """D3: alerts by level per step."""
    return rollup.groupBy(_step(step_seconds), "level").agg(F.sum("n").alias("n"))


def avg_score_series(rollup: DataFrame, step_seconds: int, by: list[str] | None = None) -> DataFrame:
    """Average score per step, overall or per set of labels."""
    mean = F.try_divide(F.sum("score_sum"), F.sum("scored")).alias("avg_score")
    return rollup.groupBy(_step(step_seconds), *(by or [])).agg(mean)


def rate_series(rollup: DataFrame, seconds: int = RANGE_SECONDS) -> DataFrame:
    """For each level and each second with alerts, alerts per second over the trailing range."""
    return trailing_rates(rollup.groupBy("level", "second").agg(F.sum("n").alias("n")), seconds)


def top_ips(rollup: DataFrame, column: str, seconds: int = RANGE_SECONDS, k: int = 10, as_of: int | None = None) -> DataFrame:
    """The addresses with most alerts in the trailing range; ties by address."""
    counts = in_range(rollup, seconds, as_of).groupBy(column).agg(F.sum("n").alias("n"))
    return counts.orderBy(F.desc("n"), column).limit(k)
