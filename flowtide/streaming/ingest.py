"""Packet intake as tables keyed by micro-batch: accepted packets, late ones, metrics and the time base.

The intake decides which packets are late, once and for all, and writes the others where the flow stream reads them. Its
watermark only uses earlier micro-batches, as the flow stream's does, and so never runs behind it: no packet that was
accepted is dropped later. A micro-batch is written aside and then moved into place, one folder per table; if it is run
again after a failure it gives the same rows, and what is in place stays. So every reader sees each batch once and whole.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.flows import SECOND, flow_states, merge_flow_states, orient, state_features, window_index
from ..schemas import PACKET
from ..sources.packets import parse_packets
from ..storage import move_into_place

METRICS = (
    "batch_id bigint, base_us bigint, newest_us bigint, watermark_us bigint, total_lines bigint, parsed bigint, "
    "skipped bigint, late bigint"
)


def read_batches(spark: SparkSession, path: str, schema) -> DataFrame:
    """A table of one folder per micro-batch; empty before the first one was written."""
    try:
        return spark.read.schema(schema).parquet(f"{path}/batch_id=*")
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error.getCondition()):
            raise
        return spark.createDataFrame([], schema)


def ingest_metrics(spark: SparkSession, out: str) -> DataFrame:
    """One row per micro-batch that had lines: lines, parsed and skipped ones, late packets, times."""
    return read_batches(spark, f"{out}/metrics", METRICS)


def accepted_packets(spark: SparkSession, out: str) -> DataFrame:
    """The packets that were not late, as a stream for ``stream_flows``."""
    return spark.readStream.schema(PACKET).parquet(f"{out}/accepted")


def late_packets(spark: SparkSession, out: str) -> DataFrame:
    """T5: the packets that came after their window was closed."""
    return read_batches(spark, f"{out}/late", PACKET)


def start_ingest(lines: DataFrame, out: str, checkpoint: str, window_seconds: int = 5, delay_seconds: float = 5,
                 trigger: dict | None = None) -> StreamingQuery:
    """Parse each micro-batch of lines into ``accepted`` and ``late`` packets and a row of ``metrics``.

    The time base is that of the first packet of the first micro-batch that has one. A packet is late when its window
    ended at or before the newest time of the earlier micro-batches, less the delay. The default trigger is that of the
    periodic counters, max(5, window) seconds.
    """
    spark = lines.sparkSession
    delay = int(delay_seconds * SECOND)

    def sink(batch: DataFrame, batch_id: int) -> None:
        before = ingest_metrics(spark, out).where(F.col("batch_id") < batch_id).agg(
            F.min_by("base_us", F.when(F.col("base_us").isNotNull(), F.col("batch_id"))).alias("base"),
            F.max("newest_us").alias("newest")).first()
        parsed = parse_packets(batch)
        base = before["base"]
        if base is None:
            base = parsed.where("valid").agg(F.min("ts_us")).first()[0]
        watermark = None if before["newest"] is None else before["newest"] - delay
        late = F.lit(False)
        if watermark is not None:
            end = (window_index(F.col("ts_us"), F.lit(base).cast("bigint"), window_seconds) + 1) * (window_seconds * SECOND)
            late = end + F.lit(base) <= F.lit(watermark)
        seen, valid = Observation(), F.col("valid")
        judged = parsed.withColumn("late", valid & late).observe(
            seen, F.count(F.lit(1)).alias("total_lines"), F.count(F.when(valid, 1)).alias("parsed"),
            F.count(F.when(F.col("late"), 1)).alias("late"), F.max(F.when(valid, F.col("ts_us"))).alias("newest"))
        aside = f"{out}/staged/batch_id={batch_id}"
        packets = judged.where("valid").select(*PACKET.names, "late")
        packets.write.mode("overwrite").partitionBy("late").parquet(f"{aside}/packets")
        counts = seen.get
        if not counts["total_lines"]:
            return
        row = (batch_id, base, counts["newest"], watermark, counts["total_lines"], counts["parsed"],
               counts["total_lines"] - counts["parsed"], counts["late"])
        spark.createDataFrame([row], METRICS).coalesce(1).write.mode("overwrite").parquet(f"{aside}/metrics")
        for name, part in (("metrics", "metrics"), ("late", "packets/late=true"), ("accepted", "packets/late=false")):
            move_into_place(spark, f"{aside}/{part}", f"{out}/{name}/batch_id={batch_id}")

    writer = lines.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"processingTime": f"{max(5, window_seconds)} seconds"})).start()


def late_states(spark: SparkSession, out: str, window_seconds: int, base_us: int, direction: str = "uni") -> DataFrame:
    """T5: the state that the late packets of each flow and window add to what was given out."""
    keyed = orient(late_packets(spark, out), direction)
    window = window_index(F.col("ts_us"), F.lit(base_us).cast("bigint"), window_seconds)
    return flow_states(keyed.withColumn("window", window), window_seconds)


def corrected_states(given: DataFrame, late: DataFrame) -> DataFrame:
    """T5: one state per flow and window with all its packets: those given out in time and the late ones.

    Sums, first and last times are those of all packets. Gaps add up as those of partial states do: late packets have
    gaps among themselves. ``revised`` tells which flows have late packets.
    """
    marked = given.withColumn("late", F.lit(0)).unionByName(late.withColumn("late", F.lit(1)))
    keys = [c for c in given.columns if c in ("window", "src_ip", "dst_ip", "src_port", "dst_port", "protocol")]
    revised = marked.groupBy(*keys).agg((F.max("late") == 1).alias("revised"))
    return merge_flow_states(marked.drop("late"), keys).join(revised, keys)


def corrections(given: DataFrame, late: DataFrame, feature_set: str = "extended") -> DataFrame:
    """T5: the whole flows, anew, of those that late packets belong to; each replaces the row that was given out."""
    keys = [c for c in given.columns if c in ("window", "src_ip", "dst_ip", "src_port", "dst_port", "protocol")]
    return state_features(corrected_states(given.join(late, keys, "left_semi"), late).drop("revised"), feature_set)
