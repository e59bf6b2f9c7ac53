"""Flows given out by idle timers: state per slice of a flow, joined when the whole flow is idle.

Two keyed operators with state and timers follow one another. The first one holds the packets of the slices of flows,
folded by time stamp; a slice that has been idle leaves one state row, with exact gaps whatever the order of arrival. The
second one collects the slices of flows and joins them at their edges when no slice has come for a while.

Both are keyed by buckets, to which slices and flows are dealt by a hash: a call of a task takes all rows of a bucket at
once, as arrays, so its cost is that of the rows and not that of the keys, of which there may be one for each packet. A
hot flow is spread over the buckets of its slices. Rows leave at the ticks of a clock that is the same for all buckets,
``TICKS`` to the idle time, so that what stays is not written again with every trigger.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.flows import GAP_SUMS, SECOND, STATE_SUMS, state_features, window_index
from ..schemas import FLOW_KEY

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE = [*STATE_SUMS, *GAP_SUMS, "first_us", "last_us"]
FLOW_STATE = T.StructType([
    T.StructField("window", T.LongType()),
    *[T.StructField(k, T.IntegerType() if k.endswith("port") else T.StringType()) for k in FLOW_KEY],
    *[T.StructField(n, T.DecimalType(38, 0) if n == "gap_sq" else T.LongType()) for n in STATE],
])
SLICE_STATE = T.StructType([*FLOW_STATE.fields[:6], T.StructField("slice", T.LongType()), *FLOW_STATE.fields[6:]])
#: Most slices that a window is cut into; a slice is one second at least.
SLICES = 24
#: Groups that the live packets are dealt to, and rows of one entry of their state.
BUCKETS, ENTRY_ROWS = 256, 50_000
#: Times in an idle time at which a bucket looks for rows that leave.
TICKS = 8


@contextmanager
def rocksdb_state(spark: SparkSession):
    """Queries that start inside keep their state in RocksDB, which named states and timers need."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


def folded(ts: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """Rows (time stamp, sums) of the distinct stamps, in order."""
    stamps, at = np.unique(ts, return_inverse=True)
    out = np.zeros((len(stamps), sums.shape[1] + 1), np.int64)
    out[:, 0] = stamps
    np.add.at(out[:, 1:], at, sums)
    return out


def packet_table(part: pd.DataFrame, tcp: bool) -> np.ndarray:
    """Packets as rows (time stamp, packets, bytes, squared bytes, syn, fin, rst), folded by time stamp."""
    size = part["frame_len"].to_numpy(np.int64)
    flags = [part[f].fillna(0).to_numpy(np.int64) * int(tcp) for f in ("syn", "fin", "rst")]
    sums = np.stack([np.ones(len(part), np.int64), size, size * size, *flags], 1)
    return folded(part["ts_us"].to_numpy(np.int64), sums)


def slice_states(table: np.ndarray, begin: np.ndarray) -> list[np.ndarray]:
    """The states of slices, column by column, from their rows by time stamp; the slices ``begin`` at these places.

    Gaps are those between the distinct time stamps of a slice; equal stamps have gaps of zero.
    """
    sums = np.add.reduceat(table[:, 1:], begin, axis=0)
    first, last = table[begin, 0], table[np.append(begin[1:], len(table)) - 1, 0]
    gaps = np.diff(table[:, 0], prepend=table[0, 0])
    gaps[begin] = 0
    # Squares of slices up to 3,000 seconds fit 64 bits; longer ones are added as whole numbers of any size.
    wide = gaps.astype(object) if (last - first).max() >= 3e9 else gaps
    return [*sums.T, sums[:, 0] - 1, np.add.reduceat(gaps, begin), _decimals(np.add.reduceat(wide * wide, begin)), first, last]


def flow_states(columns: list[np.ndarray], begin: np.ndarray) -> list[np.ndarray]:
    """The states of flows, column by column, from those of their slices by first time stamp, with the gap from each slice
    to the next (never below zero)."""
    *sums, squares, first, last = columns
    edges = np.zeros(len(first), np.int64)
    edges[1:] = np.maximum(first[1:] - last[:-1], 0)
    edges[begin] = 0
    out = [np.add.reduceat(c, begin) for c in sums]
    slices = np.diff(np.append(begin, len(first)))
    wide = edges.astype(object)
    whole = np.array([int(x) for x in squares], object)
    n = len(STATE_SUMS)
    return [*out[:n], out[n] + slices - 1, out[n + 1] + np.add.reduceat(edges, begin),
            _decimals(np.add.reduceat(whole + wide * wide, begin)), first[begin], np.maximum.reduceat(last, begin)]


def _decimals(numbers: np.ndarray) -> np.ndarray:
    out = np.empty(len(numbers), object)
    out[:] = [Decimal(int(x)) for x in numbers]
    return out


def _single(columns: list[np.ndarray]) -> list:
    return [c[0] if isinstance(c[0], Decimal) else int(c[0]) for c in columns]


def slice_state(table: np.ndarray) -> list:
    """The state of one slice."""
    return _single(slice_states(table, np.zeros(1, int)))


def joined(slices: list[tuple]) -> list:
    """The state of one flow from those of its slices."""
    columns = zip(*sorted(slices, key=lambda s: s[-2]))
    return _single(flow_states([np.array(c, object if isinstance(c[0], Decimal) else np.int64) for c in columns], np.zeros(1, int)))


def _order(codes: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of rows by group and value, and where in it the groups begin."""
    order = np.lexsort((values, codes))
    ordered = codes[order]
    return order, np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))


def _entries(rows: pd.DataFrame) -> list[tuple]:
    """Rows as entries of a list state."""
    out = []
    for at in range(0, len(rows), ENTRY_ROWS):
        table = pa.Table.from_pandas(rows.iloc[at:at + ENTRY_ROWS], preserve_index=False)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as writer:
            writer.write_table(table)
        out.append((sink.getvalue().to_pybytes(),))
    return out


class _Idle(StatefulProcessor):
    """Keeps the rows of a bucket until none of their group (of equal ``KEYS``) has come for ``idle_ms``, then gives out
    what ``finish`` makes of them, at the next tick."""

    KEYS: list[str] = []

    def __init__(self, idle_ms: int, names: list[str]):
        self.idle_ms, self.names = idle_ms, names
        self.tick = max(1, idle_ms // TICKS)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getListState("kept", "rows binary")
        self.timer = handle.getValueState("timer", "at_ms bigint")

    def leaves(self, seen_ms):
        """When groups leave that were last seen then."""
        return -(-(seen_ms + self.idle_ms) // self.tick) * self.tick

    def keep(self, rows: pd.DataFrame, wake_ms: int) -> None:
        self.kept.appendList(_entries(rows))
        if not self.timer.exists():
            self.timer.update((wake_ms,))
            self.handle.registerTimer(wake_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        taken = pd.concat(rows, ignore_index=True).drop(columns="bucket")
        self.keep(self.fold(taken.assign(seen_ms=now)), self.leaves(now))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        rows = pd.concat([pa.ipc.open_stream(k[0]).read_pandas() for k in self.kept.get()], ignore_index=True)
        self.kept.clear()
        self.timer.clear()
        codes = rows.groupby(self.KEYS, sort=False, dropna=False).ngroup().to_numpy()
        seen = np.zeros(codes.max() + 1, np.int64)
        np.maximum.at(seen, codes, rows["seen_ms"].to_numpy())
        out = self.leaves(seen)[codes]
        due = out <= timerValues.getCurrentProcessingTimeInMs()
        if not due.all():
            self.keep(self.fold(rows[~due]), int(out[~due].min()))
        if due.any():
            yield self.finish(rows[due], codes[due])[self.names]

    def fold(self, rows: pd.DataFrame) -> pd.DataFrame:
        return rows

    def close(self) -> None:
        pass


class SliceFold(_Idle):
    KEYS = [*SLICE_STATE.names[:7]]

    def fold(self, rows: pd.DataFrame) -> pd.DataFrame:
        """Packets of one time stamp of a slice as one row."""
        stamp = [*self.KEYS, "ts_us"]
        if not rows.duplicated(stamp).any():
            return rows
        sums = dict.fromkeys(STATE_SUMS, "sum") | {"seen_ms": "max"}
        return rows.groupby(stamp, sort=False, dropna=False, as_index=False).agg(sums)

    def finish(self, rows: pd.DataFrame, codes: np.ndarray) -> pd.DataFrame:
        order, begin = _order(codes, rows["ts_us"].to_numpy())
        table = rows[["ts_us", *STATE_SUMS]].to_numpy(np.int64)[order]
        keys = rows[self.KEYS].iloc[order[begin]].reset_index(drop=True)
        return keys.assign(**dict(zip(STATE, slice_states(table, begin))))


class FlowJoin(_Idle):
    KEYS = [*FLOW_STATE.names[:6]]

    def finish(self, rows: pd.DataFrame, codes: np.ndarray) -> pd.DataFrame:
        order, begin = _order(codes, rows["first_us"].to_numpy())
        columns = [rows[c].to_numpy()[order] for c in STATE]
        keys = rows[self.KEYS].iloc[order[begin]].reset_index(drop=True)
        return keys.assign(**dict(zip(STATE, flow_states(columns, begin))))


def live_states(packets: DataFrame, window_seconds: int = 5, base_us: int = 0, idle_seconds: float | None = None,
                slice_seconds: int | None = None, join_seconds: float | None = None, buckets: int = BUCKETS) -> DataFrame:
    """States of flows once they have been idle, by the wall clock, for max(2, window) seconds.

    ``slice_seconds``: how long a slice is (default: a window has at most 24). ``join_seconds``: how long a flow waits for
    further slices; the default is long enough for packets that come as fast as their time stamps run. ``buckets``: how
    many groups the live packets are dealt to; a task holds one at a time.
    """
    idle_ms = int(1000 * (idle_seconds or max(2, window_seconds)))
    cut = slice_seconds or max(1, window_seconds // SLICES)
    join_ms = idle_ms + idle_ms // TICKS + 1000 * cut if join_seconds is None else int(1000 * join_seconds)
    window = window_index(F.col("ts_us"), F.lit(base_us).cast("bigint"), window_seconds)
    keys = ["window", *FLOW_KEY]
    sliced = packets.withColumns({
        "window": window, "slice": F.expr(f"ts_us div {cut * SECOND}"), "protocol": F.lower("protocol")})
    size, tcp = F.col("frame_len").cast("bigint"), (F.col("protocol") == "tcp").cast("bigint")
    flags = [(F.coalesce(F.col(f).cast("bigint"), F.lit(0)) * tcp).alias(f) for f in ("syn", "fin", "rst")]
    counted = sliced.select(*keys, "slice", "ts_us", F.lit(1).cast("bigint").alias("packets"), size.alias("bytes"),
                            (size * size).alias("bytes_sq"), *flags)
    slices = _dealt(counted, [*keys, "slice"], buckets).transformWithStateInPandas(
        SliceFold(idle_ms, SLICE_STATE.names), SLICE_STATE, "Append", "ProcessingTime")
    return _dealt(slices.drop("slice"), keys, buckets).transformWithStateInPandas(
        FlowJoin(join_ms, FLOW_STATE.names), FLOW_STATE, "Append", "ProcessingTime")


def _dealt(rows: DataFrame, keys: list[str], buckets: int):
    return rows.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")).groupBy("bucket")


def live_flows(packets: DataFrame, window_seconds: int = 5, base_us: int = 0, idle_seconds: float | None = None,
               slice_seconds: int | None = None, join_seconds: float | None = None, feature_set: str = "extended",
               buckets: int = BUCKETS) -> DataFrame:
    """Flows given out once they have been idle (see ``live_states``). Start the query inside ``rocksdb_state``.

    A flow that goes on after it was given out starts anew, as a second row.
    """
    states = live_states(packets, window_seconds, base_us, idle_seconds, slice_seconds, join_seconds, buckets)
    return state_features(states, feature_set)
