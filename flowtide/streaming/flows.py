"""Packet streams to flow streams."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.flows import (
    GAP_SUMS,
    SECOND,
    SLICE_SECONDS,
    STATE_SUMS,
    add_up,
    orient,
    packet_sums,
    state_features,
    window_index,
)
from ..schemas import FLOW_KEY
from ..sources.packets import with_event_time
from ..storage import move_into_place


def _gap_state(stamps: Column) -> dict[str, Column]:
    """Gap sums of the distinct, sorted time stamps of a slice."""
    n = F.size(stamps)
    later, earlier = F.slice(stamps, F.lit(2), n), F.slice(stamps, F.lit(1), n - 1)
    squares = F.zip_with(later, earlier, lambda b, a: (b - a) * (b - a))
    return {
        "gap_sum": F.element_at(stamps, -1) - F.element_at(stamps, 1),
        "gap_sq": F.aggregate(squares, F.lit(0).cast("bigint"), lambda s, x: s + x).cast("decimal(38,0)"),
    }


def _edges(slices: Column) -> Column:
    """Gaps from each slice to the next, in time order."""
    n = F.size(slices)
    later, earlier = F.slice(slices, F.lit(2), n), F.slice(slices, F.lit(1), n - 1)
    return F.zip_with(later, earlier, lambda b, a: (b["first_us"] - a["last_us"]).cast("decimal(18,0)"))


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("decimal(38,0)"), lambda s, x: (s + x).cast("decimal(38,0)"))


def stored_base(spark: SparkSession, checkpoint: str) -> int | None:
    """The time base that is kept with a checkpoint."""
    try:
        return spark.read.schema("base_us bigint").json(f"{checkpoint}/time-base").first()[0]
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def stream_base(packets: DataFrame, checkpoint: str, wait_seconds: float | None = None) -> int:
    """The time base of a stream: the first time in its first micro-batch with packets, found once.

    It is kept below ``checkpoint``, so that a restart goes on with the same windows. The stream is read by a query of its
    own until the base is found; with ``wait_seconds`` it is an error if no packet comes for so long.
    """
    spark = packets.sparkSession
    base = stored_base(spark, checkpoint)
    if base is not None:
        return base

    def look(batch: DataFrame, _: int) -> None:
        first = batch.agg(F.min("ts_us")).first()[0]
        if first is not None:
            found = spark.createDataFrame([(first,)], "base_us bigint").coalesce(1)
            found.write.mode("overwrite").json(f"{checkpoint}/time-base-aside")
            move_into_place(spark, f"{checkpoint}/time-base-aside", f"{checkpoint}/time-base")

    probe = packets.select("ts_us").writeStream.foreachBatch(look).option("checkpointLocation", f"{checkpoint}/base-probe").start()
    try:
        waited = 0.0
        while (base := stored_base(spark, checkpoint)) is None:
            if probe.awaitTermination(0.2) or (wait_seconds is not None and (waited := waited + 0.2) > wait_seconds):
                raise TimeoutError("no packet came that could set the time base")
    finally:
        probe.stop()
    return base


def stream_flow_states(
    packets: DataFrame, window_seconds: int, watermark: str, base_us: int = 0, direction: str = "uni"
) -> DataFrame:
    """One state per flow and closed window (append mode).

    Packets first fold by exact time stamp with map-side combining, gaps are taken in slices of one second (a list of at
    most 10^6 distinct stamps), and the slices of a longer window are joined at their edges. A packet that comes after its window was closed by the watermark is dropped and counted by Spark.
    """
    width = window_seconds * SECOND
    long = window_seconds > SLICE_SECONDS
    keyed = orient(packets, direction)
    keyed = (keyed if "ts" in keyed.columns else with_event_time(keyed)).withWatermark("ts", watermark)
    span = F.window("ts", f"{window_seconds} seconds", startTime=f"{base_us % width} microseconds").alias("span")
    cut = [F.expr(f"ts_us div {SLICE_SECONDS * SECOND}").alias("slice")] if long else []
    stamps = keyed.groupBy(span, *FLOW_KEY, *cut, "ts_us").agg(*packet_sums(F.col("frame_len")))
    inner = ["span", *FLOW_KEY, *(["slice"] if long else [])]
    listed = stamps.groupBy(*inner).agg(*add_up(STATE_SUMS), F.sort_array(F.collect_list("ts_us")).alias("stamps"))
    states = listed.withColumns(
        {
            **_gap_state(F.col("stamps")),
            "gaps": F.col("packets") - 1,
            "first_us": F.element_at("stamps", 1),
            "last_us": F.element_at("stamps", -1),
        }
    )
    whole = _join_slices(states) if long else states
    window = window_index(F.unix_micros("span.start"), F.lit(base_us).cast("bigint"), window_seconds)
    # Rows that only move the watermark hold no packets. The test is on a sum, so it stays behind the watermark.
    real = whole.where("packets > 0")
    return real.select(window.alias("window"), *FLOW_KEY, *STATE_SUMS, *GAP_SUMS, "first_us", "last_us")


def with_heartbeat(packets: DataFrame) -> DataFrame:
    """Add one empty row per second at the wall-clock time, which closes windows while no packets come.

    For live captures, whose packet times are wall-clock times. The flows stay on the windowed path of
    ``stream_flows``: no Python state, and no second row for a flow of the same window.
    """
    rate = packets.sparkSession.readStream.format("rate").option("rowsPerSecond", 1).load()
    empty = {f.name: F.lit(None).cast(f.dataType) for f in packets.schema}
    beats = empty | {"ts_us": F.unix_micros("timestamp")} | ({"ts": F.col("timestamp")} if "ts" in empty else {})
    return packets.unionByName(rate.select(*[c.alias(n) for n, c in beats.items()]))


def _join_slices(states: DataFrame) -> DataFrame:
    """The slices of a flow as one state; the list of their edges has at most an entry for each second of the window."""
    ends = F.sort_array(F.collect_list(F.struct("first_us", "last_us")))
    joined = states.groupBy("span", *FLOW_KEY).agg(
        *add_up([*STATE_SUMS, "gaps", "gap_sum"]),
        F.sum("gap_sq").cast("decimal(38,0)").alias("gap_sq"),
        ends.alias("ends"),
    )
    squares = F.transform("edges", lambda e: (e * e).cast("decimal(38,0)"))
    return joined.withColumn("edges", _edges(F.col("ends"))).withColumns(
        {
            "gaps": F.col("gaps") + F.size("edges"),
            "gap_sum": F.col("gap_sum") + _total(F.col("edges")).cast("bigint"),
            "gap_sq": F.col("gap_sq") + _total(squares),
            "first_us": F.element_at("ends", 1)["first_us"],
            "last_us": F.element_at("ends", -1)["last_us"],
        }
    )


def stream_flows(
    packets: DataFrame,
    window_seconds: int = 5,
    watermark: str = "5 seconds",
    base_us: int | None = 0,
    direction: str = "uni",
    feature_set: str = "extended",
    checkpoint: str | None = None,
) -> DataFrame:
    """Flows of closed windows as a stream. Without a base the first packets set it, as kept in ``checkpoint``."""
    if base_us is None:
        if checkpoint is None:
            raise ValueError("name the checkpoint folder that is to keep the time base")
        base_us = stream_base(packets, checkpoint)
    return state_features(stream_flow_states(packets, window_seconds, watermark, base_us, direction), feature_set)
