"""Alert logs followed as they grow: rollups for the dashboards, lines that are no alerts, and progress per file.

Each micro-batch is written aside and moved into place, one folder per table; a batch that is run again changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators.rollup import ROLLUP, fold_alerts
from ..schemas import ALERT
from ..sources.tables import with_alert_time
from ..storage import move_into_place
from .ingest import read_batches

PROGRESS = "source_file string, alerts bigint, broken bigint, untimed bigint, newest timestamp"
BROKEN = "source_file string, line string"


def tail_alerts(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """A growing folder of JSON lines as alerts with ``ts``, the ``source_file``, and in ``broken`` the text of a line
    that is no alert (its other fields are null)."""
    schema = T.StructType([*ALERT.fields, T.StructField("broken", T.StringType())])
    reader = spark.readStream.schema(schema).option("columnNameOfCorruptRecord", "broken")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return with_alert_time(reader.json(path).withColumn("source_file", F.col("_metadata.file_path")))


def start_alert_tail(tail: DataFrame, out: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Fold each micro-batch into ``rollup``, keep its ``broken`` lines, and count it in ``progress``."""
    spark = tail.sparkSession

    def sink(batch: DataFrame, batch_id: int) -> None:
        rows = batch.persist()
        try:
            if rows.isEmpty():
                return
            broken = F.col("broken").isNotNull()
            progress = rows.groupBy("source_file").agg(
                F.count_if(~broken).alias("alerts"), F.count_if(broken).alias("broken"),
                F.count_if(~broken & F.col("ts").isNull()).alias("untimed"), F.max("ts").alias("newest"))
            parts = {
                "broken": rows.where(broken).select("source_file", F.col("broken").alias("line"), "level").drop("level"),
                "progress": progress,
                "rollup": fold_alerts(rows.where(~broken)),
            }
            for name, part in parts.items():
                aside = f"{out}/staged/batch_id={batch_id}/{name}"
                part.write.mode("overwrite").parquet(aside)
                move_into_place(spark, aside, f"{out}/{name}/batch_id={batch_id}")
        finally:
            rows.unpersist()

    writer = tail.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"processingTime": "5 seconds"})).start()


def read_rollup(spark: SparkSession, out: str) -> DataFrame:
    return read_batches(spark, f"{out}/rollup", ROLLUP)


def tail_progress(spark: SparkSession, out: str) -> DataFrame:
    return read_batches(spark, f"{out}/progress", PROGRESS)


def broken_lines(spark: SparkSession, out: str) -> DataFrame:
    return read_batches(spark, f"{out}/broken", BROKEN)
