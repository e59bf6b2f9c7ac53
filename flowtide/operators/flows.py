"""Packets to flows: keys, windows, inter-arrival gaps and mergeable flow states.

Sizes and gaps are kept as exact integer sums (count, sum, sum of squares), so a result never depends on how the
rows were partitioned. Three facts keep hot flows in bounds:

* packets are shuffled once, by flow and time slice; those of one time stamp have no gap between them and fold;
* gaps are taken inside time slices of one second, so a sort group holds at most 10^6 microsecond stamps
  (and the sum of its squared gaps stays below 10^12);
* a slice leaves one state, and the gap between two slices is the distance of their edges, so joining the slices of a
  flow sorts at most a row for each second of the window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.addresses import address_key
from ..functions.coerce import MIN_DURATION
from ..schemas import FLOW_KEY, feature_columns

SECOND = 1_000_000
SLICE_SECONDS = 1

STATE_SUMS = ["packets", "bytes", "bytes_sq", "syn", "fin", "rst"]
GAP_SUMS = ["gaps", "gap_sum", "gap_sq"]


def canonicalise(packets: DataFrame) -> DataFrame:
    """Order the two endpoints of each packet by (ip version, address, port) and lower-case the protocol."""
    keyed = packets.withColumns({"_src": address_key(F.col("src_ip")), "_dst": address_key(F.col("dst_ip"))})
    same = F.col("_src") == F.col("_dst")
    swap = (F.col("_src") > F.col("_dst")) | (same & (F.col("src_port") > F.col("dst_port")))

    def either(a: str, b: str) -> Column:
        return F.when(F.col("_swap"), F.col(a)).otherwise(F.col(b))

    ends = {
        "a_ip": either("dst_ip", "src_ip"),
        "a_port": either("dst_port", "src_port"),
        "b_ip": either("src_ip", "dst_ip"),
        "b_port": either("src_port", "dst_port"),
        "protocol": F.lower("protocol"),
    }
    return keyed.withColumn("_swap", swap).withColumns(ends).drop("_src", "_dst", "_swap")


def orient(packets: DataFrame, direction: str = "uni") -> DataFrame:
    """Packets keyed as seen (``uni``) or by their canonical endpoints (``bi``)."""
    if direction == "uni":
        return packets
    if direction != "bi":
        raise ValueError(f"direction must be 'uni' or 'bi', not {direction!r}")
    ends = {"a_ip": "src_ip", "a_port": "src_port", "b_ip": "dst_ip", "b_port": "dst_port"}
    return canonicalise(packets).drop(*ends.values()).withColumnsRenamed(ends)


def window_index(ts_us: Column, base_us: Column, window_seconds: int) -> Column:
    """Number of the window of a packet, counted from the base time."""
    width = F.lit(window_seconds * SECOND).cast("bigint")
    offset = ts_us - base_us
    return F.call_function("div", offset - F.pmod(offset, width), width)


def base_time(packets: DataFrame) -> Column:
    """The time of the first packet, as a scalar subquery."""
    return packets.agg(F.min("ts_us")).scalar()


def with_window(packets: DataFrame, window_seconds: int = 5, base_us: int | None = None) -> DataFrame:
    """Add the window index; without a base the first packet sets it."""
    base = base_time(packets) if base_us is None else F.lit(base_us).cast("bigint")
    return packets.withColumn("window", window_index(F.col("ts_us"), base, window_seconds))


def active_flows(windowed: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """A5: flows of the newest window, one row; those are the ones that may still grow."""
    newest = windowed.agg(F.max("window")).scalar()
    current = windowed.where(F.col("window") == newest).select(*(keys or FLOW_KEY)).distinct()
    return current.agg(F.count(F.lit(1)).alias("active_flows"))


def bounded(packets: DataFrame, minutes: float, base_us: int | None = None) -> DataFrame:
    """Packets of the first minutes only."""
    base = base_time(packets) if base_us is None else F.lit(base_us).cast("bigint")
    return packets.where(F.col("ts_us") < base + F.lit(int(minutes * 60 * SECOND)))


def packet_sums(counted: Column | None = None) -> list[Column]:
    """The order-free sums of a flow; flags count for tcp only. Rows count as packets, or those with ``counted``."""
    tcp = F.lower("protocol") == "tcp"
    size = F.col("frame_len").cast("bigint")
    flags = [F.sum(F.when(tcp, F.col(f).cast("bigint")).otherwise(0)).alias(f) for f in ("syn", "fin", "rst")]
    return [
        F.count(F.lit(1) if counted is None else counted).alias("packets"),
        F.sum(size).alias("bytes"),
        F.sum(size * size).alias("bytes_sq"),
        *flags,
    ]


def add_up(names: list[str]) -> list[Column]:
    return [F.sum(n).alias(n) for n in names]


def _stamp_gaps(stamps: DataFrame, inner: list[str]) -> DataFrame:
    """Gap of each distinct time stamp to the one before it in the same slice; null for the first."""
    previous = F.lag("ts_us").over(Window.partitionBy(*inner).orderBy("ts_us"))
    return stamps.withColumn("gap", F.col("ts_us") - previous)


def packet_gaps(packets: DataFrame, keys: list[str], tie: str) -> DataFrame:
    """Time since the previous packet of the same window and flow, as ``iat_us``; null for the first.

    Of packets with the same time stamp the least ``tie`` comes first and the others have gap 0. Distinct stamps are
    ordered slice by slice, with the last stamp of the slice before handed on, so no task sorts a whole flow; the join
    back has one row per stamp on one side, which lets the engine split a hot stamp on the other.
    """
    inner = [*keys, "slice"]
    cut = F.expr(f"ts_us div {SLICE_SECONDS * SECOND}").alias("slice")
    stamps = packets.groupBy(*keys, cut, "ts_us").agg(F.min(tie).alias("_first"))
    ends = stamps.groupBy(*inner).agg(F.max("ts_us").alias("ts_us"))
    following = F.lead("slice").over(Window.partitionBy(*keys).orderBy("slice"))
    nothing = F.lit(None).cast(packets.schema[tie].dataType).alias("_first")
    handed = ends.withColumn("slice", following).where("slice IS NOT NULL").select(*inner, "ts_us", nothing)
    gaps = _stamp_gaps(stamps.unionByName(handed), inner).where("_first IS NOT NULL").drop("slice")
    gap = F.when(F.col(tie) == F.col("_first"), F.col("gap")).otherwise(F.lit(0).cast("bigint"))
    return packets.join(gaps, [*keys, "ts_us"]).withColumn("iat_us", gap).select(*packets.columns, "iat_us")


def flow_states(windowed: DataFrame, window_seconds: int = 5, keys: list[str] | None = None) -> DataFrame:
    """One mergeable state per flow and window from packets that have a ``window``."""
    keys = keys or ["window", *FLOW_KEY]
    inner = [*keys, "slice"]
    sliced = windowed.withColumn("slice", F.expr(f"ts_us div {SLICE_SECONDS * SECOND}"))
    # Dealt by flow and slice, the rows serve the fold, the gaps and the sums without moving again.
    stamps = sliced.repartition(*inner).groupBy(*inner, "ts_us").agg(*packet_sums())
    states = (
        _stamp_gaps(stamps, inner)
        .groupBy(*inner)
        .agg(
            *add_up(STATE_SUMS),
            (F.sum("packets") - F.lit(1)).alias("gaps"),
            F.coalesce(F.sum("gap"), F.lit(0)).cast("bigint").alias("gap_sum"),
            F.coalesce(F.sum(F.col("gap") * F.col("gap")), F.lit(0)).cast("decimal(38,0)").alias("gap_sq"),
            F.min("ts_us").alias("first_us"),
            F.max("ts_us").alias("last_us"),
        )
    )
    return join_slices(states.drop("slice"), keys)


def join_slices(states: DataFrame, keys: list[str]) -> DataFrame:
    """A3: merge states whose time ranges do not overlap, counting the gap from each to the next."""
    previous = F.lag("last_us").over(Window.partitionBy(*keys).orderBy("first_us"))
    edge = (F.col("first_us") - previous).cast("decimal(18,0)")
    stitched = states.withColumn("edge", edge).withColumns(
        {
            "gaps": F.col("gaps") + F.when(F.col("edge").isNull(), 0).otherwise(1),
            "gap_sum": F.col("gap_sum") + F.coalesce(F.col("edge").cast("bigint"), F.lit(0)),
            "gap_sq": F.col("gap_sq") + F.coalesce(F.col("edge") * F.col("edge"), F.lit(0)),
        }
    )
    return merge_flow_states(stitched, keys)


def merge_flow_states(partials: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Merge partial states of a flow: sums and gap lists add up, first is the least, last the greatest time."""
    keys = keys or ["window", *FLOW_KEY]
    return partials.groupBy(*keys).agg(
        *add_up(STATE_SUMS),
        F.sum("gaps").alias("gaps"),
        F.sum("gap_sum").alias("gap_sum"),
        F.sum(F.col("gap_sq")).cast("decimal(38,0)").alias("gap_sq"),
        F.min("first_us").alias("first_us"),
        F.max("last_us").alias("last_us"),
    )


def population_std(n: Column, total: Column, squares: Column) -> Column:
    """Population standard deviation from exact sums: sqrt(n * squares - total^2) / n, 0 without values.

    Where the exact difference has more than 38 digits, doubles do: sqrt(squares / n - mean^2).
    """
    wide, count = total.cast("decimal(19,0)"), n.cast("decimal(19,0)")
    exact = F.try_subtract(F.try_multiply(count, squares.cast("decimal(38,0)")), F.try_multiply(wide, wide))
    mean = total.cast("double") / n
    rough = F.sqrt(F.greatest(squares.cast("double") / n - mean * mean, F.lit(0.0)))
    fine = F.sqrt(F.greatest(exact, F.lit(0)).cast("double")) / n
    return F.when(n > 0, F.coalesce(fine, rough)).otherwise(F.lit(0.0))


def state_features(states: DataFrame, feature_set: str = "extended", keys: list[str] | None = None) -> DataFrame:
    """The features of finished states; times in seconds."""
    keys = keys or ["window", *FLOW_KEY]
    n, size = F.col("packets"), F.col("bytes")
    duration = F.greatest((F.col("last_us") - F.col("first_us")) / F.lit(1e6), F.lit(MIN_DURATION))
    features = {
        "bidirectional_packets": n,
        "bidirectional_bytes": size,
        "mean_packet_size": size / n,
        "std_packet_size": population_std(n, size, F.col("bytes_sq")),
        "flow_duration": duration,
    }
    if feature_set == "extended":
        gaps = F.col("gaps")
        features |= {
            "tcp_syn_count": F.col("syn"),
            "tcp_fin_count": F.col("fin"),
            "tcp_rst_count": F.col("rst"),
            "iat_mean": F.when(gaps > 0, F.col("gap_sum") / gaps / F.lit(1e6)).otherwise(F.lit(0.0)),
            "iat_std": population_std(gaps, F.col("gap_sum"), F.col("gap_sq")) / F.lit(1e6),
            "bytes_per_packet": size / n,
            "packets_per_second": n / duration,
        }
    return states.select(*keys, *[features[c].alias(c) for c in feature_columns(feature_set)])


def flows(
    packets: DataFrame,
    window_seconds: int = 5,
    direction: str = "uni",
    feature_set: str = "extended",
    base_us: int | None = None,
) -> DataFrame:
    """A1/A2: flow table of a packet table.

    The minimal feature set needs no gaps, so it is one aggregation with map-side combining.
    """
    keyed = with_window(orient(packets, direction), window_seconds, base_us)
    if feature_set == "extended":
        return state_features(flow_states(keyed, window_seconds), feature_set)
    times = [F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us")]
    return state_features(keyed.groupBy("window", *FLOW_KEY).agg(*packet_sums(), *times), feature_set)
