"""Packet lines: batch and streaming scans, parsing, rejects and ingest counters.

A line holds eleven comma-separated fields without header or quotes: epoch seconds, source and destination address,
tcp source and destination port, udp source and destination port, frame length, syn, fin, rst.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

from ..functions.coerce import flag_to_int, strip

FIELDS = 11
# Packet times lie within the calendar years 1 to 9999; with that, sums of squared gaps stay exact in 38 digits.
FIRST_US, LAST_US = -62_135_596_800_000_000, 253_402_300_799_999_999
# Prefixes of capture-tool messages that are not packets.
STATUS_PREFIXES = ["Capturing on", "tshark:"]


def read_packet_lines(spark: SparkSession, path) -> DataFrame:
    """The lines of one or many decoded capture files (path, glob or list)."""
    return spark.read.text(path)


def read_packet_lines_stream(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """Lines of files dropped into a folder, unbounded."""
    reader = spark.readStream
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.text(path)


def read_packet_lines_kafka(spark: SparkSession, servers: str, topic: str) -> DataFrame:
    """Lines from a Kafka topic (needs the Kafka connector on the class path)."""
    source = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic)
    return source.load().select(F.col("value").cast("string").alias("value"))


def _epoch_micros(text: Column) -> Column:
    """Exact micro-seconds of epoch seconds; text that is no number of a calendar time gives null."""
    micros = F.try_multiply(strip(text).try_cast("decimal(24,6)"), F.lit(1000000)).try_cast("bigint")
    return F.when(micros.between(FIRST_US, LAST_US), micros)


def _whole_or_zero(text: Column) -> Column:
    return F.when(text == "", F.lit(0)).otherwise(strip(text).try_cast("int"))


def data_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Drop blank lines and status messages; they are neither data nor counted."""
    ignored = r"^\s*($|" + "|".join(STATUS_PREFIXES) + ")"
    return lines.where(~F.col(column).rlike(ignored))


def parse_packets(lines: DataFrame, column: str = "value") -> DataFrame:
    """One row per data line with ``valid``; the packet fields of a rejected line are not to be used.

    Other columns of the input are kept, so that a line can carry an arrival number.
    """
    rest = [c for c in lines.columns if c != column]
    parts = F.split(strip(F.col(column)), ",", -1)
    field = [F.get(F.col("_parts"), F.lit(i)) for i in range(FIELDS)]
    _, src, dst, tcp_sp, tcp_dp, udp_sp, udp_dp, length = field[:8]

    is_tcp = (tcp_sp != "") | (tcp_dp != "")
    is_udp = (udp_sp != "") | (udp_dp != "")

    def port(tcp: Column, udp: Column) -> Column:
        return F.when(is_tcp, _whole_or_zero(tcp)).when(is_udp, _whole_or_zero(udp))

    # The generator keeps the optimiser from copying the split into every field that uses it.
    split = data_lines(lines, column).select(*rest, F.explode(F.array(parts)).alias("_parts"))
    typed = split.select(
        *rest,
        _epoch_micros(field[0]).alias("ts_us"),
        F.when(src != "", src).alias("src_ip"),
        F.when(dst != "", dst).alias("dst_ip"),
        port(tcp_sp, udp_sp).alias("src_port"),
        port(tcp_dp, udp_dp).alias("dst_port"),
        F.when(is_tcp, "tcp").when(is_udp, "udp").alias("protocol"),
        _whole_or_zero(length).alias("frame_len"),
        *[flag_to_int(f).alias(n) for f, n in zip(field[8:], ["syn", "fin", "rst"])],
        (F.size("_parts") >= FIELDS).alias("_enough"),
    )
    needed = ["ts_us", "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "frame_len"]
    valid = F.col("_enough")
    for name in needed:
        valid = valid & F.col(name).isNotNull()
    return typed.withColumn("valid", F.coalesce(valid, F.lit(False))).drop("_enough")


def valid_packets(parsed: DataFrame) -> DataFrame:
    """The accepted packets."""
    return parsed.where("valid").drop("valid")


def read_packets(spark: SparkSession, path) -> DataFrame:
    """Accepted packets of one or many files."""
    return valid_packets(parse_packets(read_packet_lines(spark, path)))


def transport_packets(packets: DataFrame) -> DataFrame:
    """P5: tcp and udp only."""
    return packets.where(F.lower("protocol").isin("tcp", "udp"))


def with_event_time(packets: DataFrame) -> DataFrame:
    """Add ``ts``, the packet time as a timestamp, for watermarks."""
    return packets.withColumn("ts", F.timestamp_micros("ts_us"))


def _counters() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("total_lines"),
        F.coalesce(F.sum(F.col("valid").cast("bigint")), F.lit(0)).alias("parsed"),
        F.coalesce(F.sum((~F.col("valid")).cast("bigint")), F.lit(0)).alias("skipped"),
    ]


def ingest_stats(parsed: DataFrame) -> DataFrame:
    """A5: total, parsed and skipped lines, one row."""
    return parsed.agg(*_counters())


def observe_ingest(parsed: DataFrame, name: str = "ingest") -> DataFrame:
    """The same counters per micro-batch, delivered to an ``IngestListener``."""
    return parsed.observe(name, *_counters())


class IngestListener(StreamingQueryListener):
    """Running totals of the ingest counters of a streaming query, and of what its state holds and dropped."""

    def __init__(self, name: str = "ingest"):
        self.name = name
        self.totals = {"total_lines": 0, "parsed": 0, "skipped": 0}
        self.state_rows = 0
        self.late_rows = 0

    def onQueryStarted(self, event):
        pass

    def onQueryProgress(self, event):
        row = event.progress.observedMetrics.get(self.name)
        if row is not None:
            for key in self.totals:
                self.totals[key] += row[key] or 0
        operators = event.progress.stateOperators
        self.state_rows = sum(o.numRowsTotal for o in operators)
        self.late_rows += sum(o.numRowsDroppedByWatermark for o in operators)

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        pass
