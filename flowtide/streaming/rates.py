"""Trailing alert rates as a stream."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.dashboards import CHUNK_SECONDS, RANGE_SECONDS


def stream_rate_series(alerts: DataFrame, seconds: int = RANGE_SECONDS, watermark: str = "5 minutes",
                       chunk_seconds: int = CHUNK_SECONDS) -> DataFrame:
    """For each level and each second with alerts, alerts per second over the trailing range; append mode.

    Alerts fold into seconds within sliding windows of a chunk and the range before it, so a group holds at most an entry for
    each second of a window, however many alerts there are, and a level spreads over its chunks. A window's rates are given
    out when the watermark passes its end.
    """
    span = F.window("ts", f"{chunk_seconds + seconds} seconds", f"{chunk_seconds} seconds").alias("span")
    counted = alerts.withWatermark("ts", watermark).groupBy(span, "level", F.unix_seconds("ts").alias("second")).agg(
        F.count("level").alias("n"))
    listed = counted.groupBy("span", "level").agg(
        F.sort_array(F.collect_list(F.struct("second", "n"))).alias("seen"), F.sum("n").alias("alerts"))
    own = F.unix_seconds("span.end") - F.lit(chunk_seconds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for level, start, seen in zip(*(batch.column(c) for c in ("level", "own", "seen"))):
                at = np.array([s["second"] for s in seen.as_py()], np.int64)
                before = np.concatenate([[0], np.cumsum([s["n"] for s in seen.as_py()])])
                mine = np.flatnonzero(at >= start.as_py())
                rates = (before[mine + 1] - before[np.searchsorted(at, at[mine] - seconds, "right")]) / float(seconds)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([level.as_py()] * len(mine), pa.string()), pa.array(at[mine]), pa.array(rates, pa.float64())],
                    ["level", "second", "rate"])

    # A row that only moves the watermark has no level. The test is on a sum, so it stays behind the watermark.
    given = listed.where("alerts > 0").select("level", own.alias("own"), "seen")
    return given.mapInArrow(run, "level string, second bigint, rate double")
