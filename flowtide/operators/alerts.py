"""Scored flows to alerts: levels, alert rows, score statistics, thresholds."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import ALERT

# Thresholds used where none are stored.
DEFAULT_RED = -0.25
DEFAULT_YELLOW = 0.0


def level_column(score: Column, red, yellow) -> Column:
    """RED below the red threshold, else YELLOW below the yellow one, else null."""
    return F.when(score < F.lit(yellow), F.when(score < F.lit(red), "RED").otherwise("YELLOW"))


def iso_utc(ts: Column) -> Column:
    """ISO-8601 text in UTC with microseconds and offset, whatever the session time zone."""
    wall = F.to_utc_timestamp(ts, F.current_timezone())
    return F.concat(F.date_format(wall, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+00:00"))


def detection_time(as_of: str | None = None) -> str:
    """The one time that all alerts of a batch carry, in all its outputs: the given one, else now."""
    return datetime.now(timezone.utc).isoformat(timespec="microseconds") if as_of is None else as_of


def to_alerts(scored: DataFrame, red: float, yellow: float, as_of: Column | str | None = None) -> DataFrame:
    """Alert rows of the flows with ``score`` below yellow; all of a batch carry one detection time."""
    if as_of is None:
        as_of = iso_utc(F.current_timestamp())
    elif isinstance(as_of, str):
        as_of = F.lit(as_of)
    rows = scored.withColumn("level", level_column(F.col("score"), red, yellow)).where(F.col("level").isNotNull())
    fields = {f.name: F.col(f.name).cast(f.dataType) for f in ALERT if f.name != "timestamp"}
    return rows.select(as_of.alias("timestamp"), *[c.alias(n) for n, c in fields.items()])


def score_stats(scored: DataFrame) -> DataFrame:
    """A4: count, least, mean and greatest score, one row."""
    return scored.agg(
        F.count("score").alias("n"),
        F.min("score").alias("min_score"),
        F.avg("score").alias("mean_score"),
        F.max("score").alias("max_score"),
    )


def log_line(alerts: DataFrame) -> DataFrame:
    """the log message of each alert as ``line``."""
    word = F.when(F.col("level") == "RED", "ANOMALY RED").otherwise("Anomaly YELLOW")
    return alerts.withColumn(
        "line",
        F.format_string(
            "%s %s:%d -> %s:%d %s score=%.4f",
            word, "src_ip", "src_port", "dst_ip", "dst_port", F.upper("protocol"), "score",
        ),
    )


def threshold_columns(
    document: Column, red_override: Column | None = None, yellow_override: Column | None = None
) -> list[Column]:
    """Thresholds of a JSON document held as text.

    A valid override wins; a missing key has its default; a document with a bad value (null too) is not used at all.
    """
    stored = F.from_json(document, "red_threshold string, yellow_threshold string")
    named = [("red_threshold", DEFAULT_RED, red_override), ("yellow_threshold", DEFAULT_YELLOW, yellow_override)]
    keys = F.json_object_keys(document)
    present = {n: F.coalesce(F.array_contains(keys, n), F.lit(False)) for n, _, _ in named}
    value = {n: stored[n].try_cast("double") for n, _, _ in named}
    usable = F.lit(True)
    for n in present:
        usable = usable & (~present[n] | value[n].isNotNull())
    out = []
    for name, default, override in named:
        column = F.coalesce(F.when(usable, value[name]), F.lit(default))
        if override is not None:
            column = F.coalesce(F.btrim(override).try_cast("double"), column)
        out.append(column.alias(name))
    return out


def resolve_threshold(stored: float, override: str | float | None) -> float:
    """A job parameter replaces the stored threshold if it is a number."""
    try:
        return stored if override is None else float(override)
    except ValueError:
        return stored
