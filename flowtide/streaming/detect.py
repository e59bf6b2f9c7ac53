"""Streaming detection and alert counts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.alerts import detection_time, log_line, resolve_threshold, score_stats, to_alerts
from ..plans.detect import score_expression
from ..schemas import FLOW_KEY
from ..sources.registry import Model
from ..sources.tables import batch_folder, write_alerts


def run_name(spark: SparkSession, checkpoint: str) -> str:
    """The name of a stream's run: kept beside its checkpoint, so that a restart goes on with it and a new one differs."""
    path = f"{checkpoint}/alert-run"
    names = spark.createDataFrame([(uuid.uuid4().hex,)], "value string")
    names.coalesce(1).write.mode("ignore").text(path)
    return spark.read.text(path).first()[0]


def start_detection(
    flows: DataFrame,
    model: Model,
    out: str,
    checkpoint: str,
    red=None,
    yellow=None,
    as_of=None,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Score each micro-batch of flows once; write its alerts as JSON lines and CSV, its log lines as text and
    its score statistics as JSON (``alerts_json``, ``alerts_csv``, ``log``, ``score_stats`` below ``out``).

    A batch that is run again after a failure replaces its own folder, so alerts are written exactly once; runs with
    another checkpoint have other folders. A batch without flows writes nothing, one without alerts its statistics only.
    The forest is broadcast once per run. The default trigger is half a five-second window.
    """
    limits = resolve_threshold(model.red, red), resolve_threshold(model.yellow, yellow)
    score = score_expression(flows.sparkSession, model)
    run = run_name(flows.sparkSession, checkpoint)

    def put(table: DataFrame, name: str, fmt: str, batch_id: int) -> None:
        folder, mode = batch_folder(f"{out}/{name}", batch_id, run)
        table.write.mode(mode).format(fmt).save(folder)

    def sink(batch: DataFrame, batch_id: int) -> None:
        scored = batch.select(*FLOW_KEY, score.alias("score")).persist()
        try:
            if scored.isEmpty():
                return
            put(score_stats(scored).coalesce(1), "score_stats", "json", batch_id)
            alerts = to_alerts(scored, *limits, detection_time(as_of))
            if not alerts.isEmpty():
                write_alerts(alerts, f"{out}/alerts_json", "json", batch_id, run)
                write_alerts(alerts, f"{out}/alerts_csv", "csv", batch_id, run)
                put(log_line(alerts).select("line"), "log", "text", batch_id)
        finally:
            scored.unpersist()

    writer = flows.writeStream.outputMode("append").foreachBatch(sink).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"processingTime": "2 seconds"})).start()


def stream_alert_counts(alerts: DataFrame, step_seconds: int = 60, watermark: str = "5 minutes") -> DataFrame:
    """Alerts by level per step as a stream."""
    counts = alerts.withWatermark("ts", watermark).groupBy(F.window("ts", f"{step_seconds} seconds"), "level")
    return counts.agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("step"), "level", "n")
