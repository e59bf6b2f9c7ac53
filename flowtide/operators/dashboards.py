"""Questions asked of an alert table with an event time ``ts``: rates, series, averages, top addresses, latest lines.

``as_of`` is the time of the question (default: the newest alert); a range of r seconds is (as_of - r, as_of].
"""

from __future__ import annotations

import math
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

RANGE_SECONDS = 300
CHUNK_SECONDS = 3600


def _as_of(alerts: DataFrame, as_of: datetime | None) -> Column:
    return alerts.agg(F.max("ts")).scalar() if as_of is None else F.lit(as_of).cast("timestamp")


def newest(alerts: DataFrame) -> datetime | None:
    """Time of the newest alert of a log stored by day; only the newest day is read."""
    day = alerts.agg(F.max("day")).first()[0]
    return None if day is None else alerts.where(F.col("day") == F.lit(day)).agg(F.max("ts")).first()[0]


def in_range(alerts: DataFrame, seconds: int, as_of: datetime | None = None) -> DataFrame:
    """Alerts of the trailing range. With a given time, a log that is stored by day opens only the range's days."""
    end = _as_of(alerts, as_of)
    start = end - F.make_dt_interval(secs=F.lit(seconds))
    if as_of is not None and "day" in alerts.columns:
        # A day more on either side, so that the time zone of the session does not matter.
        first, last = as_of.date() - timedelta(days=1 + -(-seconds // 86_400)), as_of.date() + timedelta(days=1)
        alerts = alerts.where(F.col("day").between(F.lit(first), F.lit(last)))
    return alerts.where((F.col("ts") > start) & (F.col("ts") <= end))


def by_level(alerts: DataFrame, levels: list[str] | None = None) -> DataFrame:
    """The multi-select level filter; None or an empty list means all."""
    return alerts.where(F.col("level").isin(levels)) if levels else alerts


def level_values(alerts: DataFrame) -> DataFrame:
    """The levels that occur."""
    return alerts.select("level").distinct()


def alert_rate(
    alerts: DataFrame, seconds: int = RANGE_SECONDS, level: str | None = None, as_of: datetime | None = None
) -> DataFrame:
    """Alerts per second over the trailing range; the range ends at the newest alert of any level."""
    wanted = F.lit(True) if level is None else F.col("level") == level
    return in_range(alerts, seconds, as_of).agg((F.count_if(wanted) / F.lit(float(seconds))).alias("rate"))


def _step(step_seconds: int) -> Column:
    return F.window("ts", f"{step_seconds} seconds")["start"].alias("step")


def level_series(alerts: DataFrame, step_seconds: int) -> DataFrame:
    """D3: alerts by level per step."""
    return alerts.groupBy(_step(step_seconds), "level").agg(F.count(F.lit(1)).alias("n"))


def avg_score_series(alerts: DataFrame, step_seconds: int, by: list[str] | None = None) -> DataFrame:
    """Average score per step, overall or per set of labels."""
    return alerts.groupBy(_step(step_seconds), *(by or [])).agg(F.avg("score").alias("avg_score"))


def rate_series(alerts: DataFrame, seconds: int = RANGE_SECONDS) -> DataFrame:
    """For each level and each second with alerts, alerts per second over the trailing range.

    Alerts fold into seconds first. Seconds are cut into chunks that also hold the range before them, so the sort
    groups of the frame have a fixed greatest size and a busy level spreads over many tasks.
    """
    seconds_seen = alerts.groupBy("level", F.unix_seconds("ts").alias("second")).agg(F.count(F.lit(1)).alias("n"))
    return trailing_rates(seconds_seen, seconds)


def trailing_rates(seconds_seen: DataFrame, seconds: int) -> DataFrame:
    """Trailing rates from (level, second, n), one row per level and second."""
    chunk_len = max(CHUNK_SECONDS, seconds)
    own = F.floor(F.col("second") / F.lit(chunk_len)).cast("bigint")
    reach = F.floor((F.col("second") + F.lit(seconds - 1)) / F.lit(chunk_len)).cast("bigint")
    spread = seconds_seen.withColumn("own", own).withColumn("chunk", F.explode(F.sequence(F.col("own"), reach)))
    frame = Window.partitionBy("level", "chunk").orderBy("second").rangeBetween(1 - seconds, 0)
    rated = spread.withColumn("rate", F.sum("n").over(frame) / F.lit(float(seconds)))
    return rated.where(F.col("own") == F.col("chunk")).select("level", "second", "rate")


#: Addresses that a sketch of frequent ones tracks, and candidates of which the exact counts are taken, for each wanted one.
TRACKED, CANDIDATES_EACH = 8192, 64


def frequent_values(rows: DataFrame, column: str, n: int) -> tuple[list, float]:
    """The n values that a sketch takes for the most frequent, and the most rows that any other value can have.

    Tasks send sketches of bounded size, never their values. The sketch's counts are never too low, and its error is at
    most 3.5 / (size of its table) of all rows.
    """
    size = 1 << math.ceil(math.log2(math.ceil(TRACKED / 0.75)))
    found, total = rows.agg(F.expr(f"approx_top_k(`{column}`, {n}, {TRACKED})"), F.count(F.lit(1))).first()
    least = found[-1]["count"] if len(found) == n else 0
    return [f["item"] for f in found], max(3.5 / size * total, least)


def top_ips(
    alerts: DataFrame, column: str, seconds: int = RANGE_SECONDS, k: int = 10, as_of: datetime | None = None
) -> DataFrame:
    """The addresses with most alerts in the trailing range; ties by address.

    A first pass finds candidates by a sketch and a second one counts those exactly, so addresses are not shuffled. Only if
    the last of the k does not stand above what any other address can have are all of them counted.
    """
    rows = in_range(alerts, seconds, as_of)
    values, bound = frequent_values(rows, column, min(TRACKED, CANDIDATES_EACH * k))

    def top(of: DataFrame) -> DataFrame:
        return of.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column).limit(k)

    known = rows.sparkSession.createDataFrame([(v,) for v in values], T.StructType([T.StructField("_v", rows.schema[column].dataType)]))
    first = top(rows.join(F.broadcast(known), F.col(column).eqNullSafe(F.col("_v")), "left_semi"))
    counts = [r["n"] for r in first.collect()]
    complete = counts[-1] > bound if len(counts) == k else bound < 1
    return first if complete else top(rows)


def alert_line() -> Column:
    """an alert as one line of text."""
    return F.format_string(
        "%s %s %s:%d -> %s:%d score=%s protocol=%s",
        "timestamp", "level", "src_ip", "src_port", "dst_ip", "dst_port", F.col("score").cast("string"), "protocol",
    )


def last_alerts(alerts: DataFrame, hours: int = 6, n: int = 200, as_of: datetime | None = None) -> DataFrame:
    """The newest alerts of the last hours, newest first, with their ``line``."""
    recent = in_range(alerts, hours * 3600, as_of)
    order = [F.desc("ts"), "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "score"]
    return recent.orderBy(*order).limit(n).withColumn("line", alert_line())
