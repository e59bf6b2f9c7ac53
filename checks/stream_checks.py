"""Streaming queries, run as bounded replays of the event table."""

from __future__ import annotations

import time
from contextlib import contextmanager
from functools import partial

from pyspark.sql import functions as F

from flowtide.schemas import ALERT, PACKET
from flowtide.sources.packets import IngestListener, observe_ingest, parse_packets, read_packet_lines_stream, valid_packets
from flowtide.sources.tables import read_alerts, read_alerts_stream, with_alert_time
from flowtide.storage import fresh_dir
from flowtide.streaming.alert_tail import start_alert_tail, tail_alerts, tail_progress
from flowtide.streaming.detect import start_detection, stream_alert_counts
from flowtide.streaming.flows import stream_flow_states, stream_flows
from flowtide.streaming.idle import live_flows, rocksdb_state
from flowtide.streaming.ingest import accepted_packets, corrected_states, ingest_metrics, late_states, start_ingest
from flowtide.streaming.rates import stream_rate_series
from flowtide.streaming.replay import end_marker, replay

from .adapters import (
    ALERTS, AS_OF, FLOW_SELECT, KEY, LINES, PACKETS, ROUNDED, UNI, UNI_SQL, WINDOW, alert_rows, fixed_model, flows_cte,
    packet_files, packet_lines, packets, windowed,
)
from .model_checks import ALERT_SQL, FIXED_YELLOW, SCORED
from .registry import check, rounded, sql_r4

DELAY = "1 hour"
# Seconds after which a stream that should have given out all its flows has failed.
IDLE_DEADLINE = 600


@contextmanager
def state_partitions(spark):
    """As many state partitions as there are cores; they are fixed for the life of a streaming query."""
    name = "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(int(before), spark.sparkContext.defaultParallelism)))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _halves(rows, marked: bool = False):
    """The rows in two steps by time, the second with an end marker if wanted."""
    middle = rows.agg(F.expr("(min(ts_us) + max(ts_us)) div 2")).first()[0]
    late = rows.where(F.col("ts_us") >= middle)
    return [rows.where(F.col("ts_us") < middle), late.unionByName(end_marker(rows, 3 * WINDOW)) if marked else late]


def _base(rows) -> int:
    return rows.agg(F.min("ts_us")).first()[0]


@check("stream_flow_windows", UNI_SQL)
def stream_flow_windows(spark, sf):
    """Streamed flows of all windows equal the batch flows; the first micro-batch sets the time base, a restart keeps it."""
    rows = packets(spark, sf)
    build = partial(stream_flows, window_seconds=WINDOW, watermark=DELAY, base_us=None, checkpoint=fresh_dir(spark, "base"))
    with state_partitions(spark):
        out = replay(spark, _halves(rows, True), build)
    return rounded(out.drop("batch_id"), ROUNDED)


CLOSED = f"""{FLOW_SELECT} WHERE ("window" + 1) * {WINDOW}000000 + (SELECT min(ts_us) FROM packets) <= (SELECT max(ts_us) // 1000 * 1000 FROM packets) - 3600000000"""


@check("stream_flow_append", f"{UNI} {CLOSED}")
def stream_flow_append(spark, sf):
    """Without an end marker only windows behind the watermark are given out."""
    rows = packets(spark, sf)
    build = partial(stream_flows, window_seconds=WINDOW, watermark=DELAY, base_us=_base(rows))
    with state_partitions(spark):
        out = replay(spark, _halves(rows), build)
    return rounded(out.drop("batch_id"), ROUNDED)


@check("stream_idle_flush", UNI_SQL)
def stream_idle_flush(spark, sf):
    """All packets arrive at once and then none: every flow is given out by its idle timer."""
    rows = packets(spark, sf)
    source, sink, checkpoint = (fresh_dir(spark, f"idle-{n}") for n in ("packets", "flows", "checkpoint"))
    rows.write.parquet(source)
    base, total = rows.agg(F.min("ts_us"), F.count(F.lit(1))).first()
    seen = []

    def keep(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{sink}/batch_id={batch_id}")
        done = spark.read.schema(batch.schema).parquet(f"{sink}/batch_id={batch_id}")
        seen.append(done.agg(F.sum("bidirectional_packets")).first()[0] or 0)

    with state_partitions(spark), rocksdb_state(spark):
        stream = spark.readStream.schema(rows.schema).parquet(source)
        flows = live_flows(stream, WINDOW, base, idle_seconds=3, join_seconds=2)
        writer = flows.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint)
        query = writer.trigger(processingTime="1 second").start()
        try:
            deadline = time.monotonic() + IDLE_DEADLINE
            while sum(seen) < total and not query.awaitTermination(1):
                if time.monotonic() > deadline:
                    raise TimeoutError(f"{sum(seen)} of {total} packets were given out")
        finally:
            query.stop()
    return rounded(spark.read.schema(flows.schema).parquet(f"{sink}/*"), ROUNDED)


LATE = "syn = 1"
LATE_SOURCE = f"""{windowed('packets', name='allw')}, windowed AS (
  SELECT * FROM allw WHERE NOT ({LATE}) OR ("window" + 1) * {WINDOW}000000 + (SELECT min(ts_us) FROM packets)
    > (SELECT max(ts_us) // 1000 * 1000 FROM packets WHERE NOT ({LATE})) - 3600000000
)"""


@check("stream_late_data", f"WITH {PACKETS}, {LATE_SOURCE}, {flows_cte()} {FLOW_SELECT}")
def stream_late_data(spark, sf):
    """Signups come last: those of closed windows are dropped, those of open windows join their flow."""
    rows = packets(spark, sf)
    steps = [rows.where(f"NOT ({LATE})"), rows.where(LATE).unionByName(end_marker(rows, 3 * WINDOW))]
    build = partial(stream_flows, window_seconds=WINDOW, watermark=DELAY, base_us=_base(rows))
    with state_partitions(spark):
        out = replay(spark, steps, build)
    return rounded(out.drop("batch_id"), ROUNDED)


# Lines whose packets come in a second step: those with an even number and the signups.
SECOND_STEP = "(seq % 2 = 0 OR syn = 1)"
STEPS = LINES.replace("lines AS (\n  SELECT ", f"lines AS (\n  SELECT CAST({SECOND_STEP} AS BIGINT) AS step, ").replace(
    "SELECT seq, string_split", "SELECT seq, step, string_split").replace("SELECT seq, CASE WHEN regexp", "SELECT seq, step, CASE WHEN regexp")
BASE = "(SELECT min(ts_us) FROM judged WHERE valid AND step = 0)"
NEWEST = "(SELECT max(ts_us) FROM judged WHERE valid AND step = 0)"
NUMBER = f"CAST(floor((ts_us - {BASE}) / {WINDOW}000000.0) AS BIGINT)"


def _ingested(spark, sf) -> str:
    """All lines through the intake, in two steps with a restart between them."""
    source, out, checkpoint = (fresh_dir(spark, f"intake-{n}") for n in ("lines", "out", "checkpoint"))
    for wanted in (f"NOT {SECOND_STEP}", SECOND_STEP):
        packet_lines(spark, sf, wanted).write.mode("append").text(source)
        stream = read_packet_lines_stream(spark, source)
        start_ingest(stream, out, checkpoint, WINDOW, 3600, {"availableNow": True}).awaitTermination()
    return out


@check(
    "stream_ingest_stats",
    f"""WITH {STEPS} SELECT step AS batch_id, count(*) AS total_lines, count(*) FILTER (valid) AS parsed,
          count(*) FILTER (NOT valid) AS skipped, {BASE} AS base_us, max(ts_us) FILTER (valid) AS newest_us,
          count(*) FILTER (valid AND step = 1 AND ({NUMBER} + 1) * {WINDOW}000000 + {BASE} <= {NEWEST} - 3600000000) AS late
        FROM judged GROUP BY step""",
)
def stream_ingest_stats(spark, sf):
    """The counters of each micro-batch, as a table, over a restart."""
    rows = ingest_metrics(spark, _ingested(spark, sf))
    return rows.select("batch_id", "total_lines", "parsed", "skipped", "base_us", "newest_us", "late")


@check(
    "stream_late_corrections",
    f"""WITH {STEPS}, rows AS (SELECT {NUMBER} AS "window", * FROM judged WHERE valid)
        SELECT "window", {KEY}, count(*) AS packets, CAST(sum(frame_len) AS BIGINT) AS bytes,
          CAST(sum(CASE WHEN protocol = 'tcp' THEN syn ELSE 0 END) AS BIGINT) AS syn, min(ts_us) AS first_us, max(ts_us) AS last_us,
          bool_or(step = 1 AND ("window" + 1) * {WINDOW}000000 + {BASE} <= {NEWEST} - 3600000000) AS revised
        FROM rows GROUP BY ALL""",
)
def stream_late_corrections(spark, sf):
    """T5: flows given out in time, joined with what came late: every packet counts once, over restarts."""
    out = _ingested(spark, sf)
    base = ingest_metrics(spark, out).agg(F.min("base_us")).first()[0]
    sink, checkpoint = fresh_dir(spark, "flows"), fresh_dir(spark, "flows-checkpoint")
    accepted = spark.read.schema(PACKET).parquet(f"{out}/accepted/*")
    with state_partitions(spark):
        for step in range(2):
            if step:
                end_marker(accepted, 3 * WINDOW).write.parquet(f"{out}/accepted/batch_id=1000000")
            states = stream_flow_states(accepted_packets(spark, out), WINDOW, DELAY, base)
            writer = states.writeStream.format("parquet").option("checkpointLocation", checkpoint)
            writer.trigger(availableNow=True).start(sink).awaitTermination()
    whole = corrected_states(spark.read.parquet(sink), late_states(spark, out, WINDOW, base))
    return whole.select("window", *KEY.split(", "), "packets", "bytes", "syn", "first_us", "last_us", "revised")


def _detected(spark, sf) -> str:
    """Packets to flows to alerts in one stream of several micro-batches, restarted between two of them."""
    rows = packets(spark, sf)
    source, out, checkpoint = (fresh_dir(spark, f"live-{n}") for n in ("packets", "out", "checkpoint"))
    base = _base(rows)
    first, last = _halves(rows, True)
    with state_partitions(spark):
        for step in (first, last):
            step.write.mode("append").parquet(source)
            stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 4).parquet(source)
            flows = stream_flows(stream, WINDOW, DELAY, base)
            query = start_detection(flows, fixed_model(), out, checkpoint, as_of=AS_OF, trigger={"availableNow": True})
            query.awaitTermination()
    return out


@check("stream_detect", ALERT_SQL)
def stream_detect(spark, sf):
    """The alerts of the stream equal those of the batch job."""
    return rounded(read_alerts(spark, f"{_detected(spark, sf)}/alerts_json").select(*ALERT.names), ["score"])


@check("stream_detect_csv", ALERT_SQL)
def stream_detect_csv(spark, sf):
    return rounded(read_alerts(spark, f"{_detected(spark, sf)}/alerts_csv", "csv").select(*ALERT.names), ["score"])


@check(
    "stream_score_stats",
    f"""{UNI}, {SCORED} SELECT count(*) AS n, {sql_r4("min(score)", "min_score")}, {sql_r4("max(score)", "max_score")},
          count(*) FILTER (score < {FIXED_YELLOW}) AS log_lines FROM scored""",
)
def stream_score_stats(spark, sf):
    """Score statistics and log lines of all micro-batches."""
    out = _detected(spark, sf)
    stats = spark.read.schema("n bigint, min_score double, mean_score double, max_score double").json(f"{out}/score_stats")
    total = stats.agg(F.sum("n").alias("n"), F.min("min_score").alias("min_score"), F.max("max_score").alias("max_score"))
    lines = spark.read.schema("value string").text(f"{out}/log").agg(F.count(F.lit(1)).alias("log_lines"))
    return rounded(total, ["min_score", "max_score"]).withColumn("log_lines", lines.scalar())


@check(
    "stream_rate_series",
    f"""WITH {ALERTS}, seconds AS (SELECT level, ts_us // 1000000 AS second, count(*) AS n FROM alerts GROUP BY 1, 2)
        SELECT level, second, sum(n) OVER (PARTITION BY level ORDER BY second RANGE BETWEEN 6999 PRECEDING AND CURRENT ROW) / 7000.0 AS rate FROM seconds""",
)
def stream_rate_series_query(spark, sf):
    """Trailing rates of a stream that is restarted, closed by a row far behind the last alert."""
    rows = with_alert_time(alert_rows(spark, sf)).select("ts", "level")
    last = rows.agg((F.max("ts") + F.expr("INTERVAL 100 DAYS")).alias("ts")).select("ts", F.lit(None).cast("string").alias("level"))
    steps = [rows.where("level = 'RED'"), rows.where("level <> 'RED'").unionByName(last)]
    with state_partitions(spark):
        out = replay(spark, steps, lambda alerts: stream_rate_series(alerts, 7000, "60 days"), name="rates")
    return out.drop("batch_id")


BROKEN = "src_port % 50 = 7"


@check(
    "stream_alert_counts",
    f"""WITH {ALERTS} SELECT ts_us // 3600000000 * 3600 AS step, level, count(*) AS n FROM alerts WHERE NOT ({BROKEN}) GROUP BY 1, 2
        UNION ALL SELECT NULL, 'broken', count(*) FROM alerts WHERE {BROKEN}""",
)
def stream_alert_counts_query(spark, sf):
    """A growing folder of JSON lines, some of them cut off, in two runs with a restart. Update mode: the last count given
    out for a step and level is the final one; the progress table counts the broken lines."""
    log, out, counts, *checkpoints = (fresh_dir(spark, f"log-{n}") for n in ("lines", "out", "counts", "c1", "c2"))
    rows = alert_rows(spark, sf)
    line = F.to_json(F.struct(*ALERT.names))
    text = rows.select(F.when(F.expr(BROKEN), F.substring(line, 1, 40)).otherwise(line).alias("value"), "level")

    def keep(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{counts}/batch_id={batch_id}")

    with state_partitions(spark):
        for wanted in ("level = 'RED'", "level <> 'RED'"):
            text.where(wanted).select("value").write.mode("append").text(log)
            series = stream_alert_counts(read_alerts_stream(spark, log), 3600, "60 days")
            writer = series.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", checkpoints[0])
            writer.trigger(availableNow=True).start().awaitTermination()
            start_alert_tail(tail_alerts(spark, log), out, checkpoints[1], {"availableNow": True}).awaitTermination()
    given = spark.read.parquet(counts)
    last = given.groupBy("step", "level").agg(F.max_by("n", "batch_id").alias("n"))
    broken = tail_progress(spark, out).agg(F.sum("broken").alias("n"))
    none = F.lit(None).cast("bigint").alias("step")
    return last.withColumn("step", F.unix_seconds("step")).unionByName(broken.select(none, F.lit("broken").alias("level"), "n"))


@check(
    "stream_packet_parse",
    f"WITH {LINES} SELECT protocol, count(*) AS n, CAST(sum(frame_len) AS BIGINT) AS bytes, min(ts_us) AS first_us FROM judged WHERE valid GROUP BY protocol",
)
def stream_packet_parse(spark, sf):
    """Text files read as a stream, parsed, counted by a listener and stored."""
    sink, checkpoint = fresh_dir(spark, "parsed"), fresh_dir(spark, "parsed-checkpoint")
    listener = IngestListener()
    spark.streams.addListener(listener)
    try:
        parsed = observe_ingest(parse_packets(read_packet_lines_stream(spark, packet_files(spark, sf))))
        writer = valid_packets(parsed).writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
        writer.format("parquet").start(sink).awaitTermination()
    finally:
        spark.streams.removeListener(listener)
    out = spark.read.schema(PACKET).parquet(sink)
    return out.groupBy("protocol").agg(F.count(F.lit(1)).alias("n"), F.sum("frame_len").alias("bytes"), F.min("ts_us").alias("first_us"))
