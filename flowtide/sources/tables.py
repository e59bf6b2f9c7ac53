"""Flow tables and alert logs on storage."""

from __future__ import annotations

import uuid
from datetime import date

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import ALERT, FLOW_LABELLED
from ..storage import move_into_place


def write_flows(
    flows: DataFrame, path: str, label: int | None = None, fmt: str = "parquet", mode: str = "errorifexists"
) -> None:
    """Write a flow table, CSV with a header or parquet, optionally with a constant label."""
    table = flows if label is None else flows.withColumn("label", F.lit(int(label)))
    table.write.mode(mode).option("header", True).format(fmt).save(path)


def read_flows(spark: SparkSession, path: str, fmt: str = "parquet", schema: T.StructType | None = None) -> DataFrame:
    """Read a flow table; without rows it is an error. CSV columns are found by name, in any order.

    Columns that a CSV file lacks (the label, the window, the extended features) are left out; others are not read. Text
    that is no number of its column's kind gives null.
    """
    if fmt == "csv":
        text = spark.read.option("header", True).csv(path)
        found = {c.strip().lower(): c for c in text.columns}
        table = text.select(*[
            F.col(f"`{found[f.name]}`").try_cast(f.dataType).alias(f.name)
            for f in (schema or FLOW_LABELLED) if f.name in found
        ])
        if not table.columns:
            raise ValueError(f"{path} has no flow columns")
    else:
        table = spark.read.format(fmt).load(path)
    if table.isEmpty():
        raise ValueError(f"{path} holds no flows")
    return table


def batch_folder(path: str, batch_id: int | None, run: str | None = None) -> tuple[str, str]:
    """Folder and write mode: of a batch of a run its own folder, replaced if the batch is run again; else appended."""
    if batch_id is None:
        return path, "append"
    return (f"{path}/run={run}/batch_id={batch_id}" if run else f"{path}/batch_id={batch_id}"), "overwrite"


def write_alerts(
    alerts: DataFrame, path: str, fmt: str = "json", batch_id: int | None = None, run: str | None = None
) -> None:
    """K2/K3: append alerts as CSV with header or JSON lines.

    With a batch number the rows go to their own folder, replaced as a whole if the batch is run again. Batch numbers
    start anew with every checkpoint, so a stream also names its run: earlier runs' alerts stay.
    """
    rows = alerts.select([F.col(f.name).cast(f.dataType) for f in ALERT])
    target, mode = batch_folder(path, batch_id, run)
    rows.write.mode(mode).option("header", True).format(fmt).save(target)


def write_alerts_by_level(alerts: DataFrame, path: str, mode: str = "append") -> None:
    """K4: parquet partitioned by level, sorted by address so that row groups can be skipped.

    The range shuffle splits a hot address over many files.
    """
    order = ["level", "src_ip", "dst_ip", "timestamp"]
    alerts.repartitionByRange(*order).sortWithinPartitions(*order).write.mode(mode).partitionBy("level").parquet(path)


def store_alerts(alerts: DataFrame, path: str, mode: str = "append") -> None:
    """K4: parquet with ``ts``, partitioned by day (UTC) and level, so that a question of minutes opens one day."""
    rows = alerts if "ts" in alerts.columns else with_alert_time(alerts)
    rows = rows.withColumn("day", F.to_date(F.date_format(F.to_utc_timestamp("ts", F.current_timezone()), "yyyy-MM-dd")))
    order = ["day", "level", "ts"]
    rows.repartitionByRange(*order).sortWithinPartitions(*order).write.mode(mode).partitionBy("day", "level").parquet(path)


COMMIT = "gen string, file string"


def _commits(spark: SparkSession, path: str) -> DataFrame:
    """(gen, file): which generations of rewritten files are valid, and the files that each replaces."""
    try:
        return spark.read.schema(COMMIT).parquet(f"{path}_commits/*")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], COMMIT)


def _store_files(spark: SparkSession, path: str) -> DataFrame:
    """Stored alerts with the ``_file`` that holds them: appended ones and those of valid generations, less replaced files."""
    def placed(rows: DataFrame) -> DataFrame:
        return rows.select("*", F.col("_metadata.file_path").alias("_file"))

    commits = _commits(spark, path)
    gens = [r["gen"] for r in commits.select("gen").distinct().collect()]
    rows = placed(spark.read.parquet(path))
    if not gens:
        return rows
    rewritten = placed(spark.read.parquet(f"{path}_compacted").where(F.col("gen").isin(gens))).drop("gen")
    return rows.unionByName(rewritten).join(commits.select(F.col("file").alias("_file")), "_file", "left_anti")


def read_alert_store(spark: SparkSession, path: str) -> DataFrame:
    """The stored alerts, with ``ts``, ``day`` and ``level``; each once, whether their day was compacted or not."""
    return _store_files(spark, path).drop("_file").withColumn("day", F.col("day").cast("date"))


def compact_store(spark: SparkSession, path: str, day: date, fresh: str | None = None) -> int:
    """K4: rewrite the many files of a day as a few, sorted ones; says how many files they replace.

    The new files lie beside the store and count for nothing until a commit names them and what they replace; it is moved
    into place as a whole, so a reader sees the old files or the new ones, never both. Replaced files stay for readers that
    have begun; ``replaced_files`` lists them.
    """
    gen = fresh or uuid.uuid4().hex
    old = _store_files(spark, path).where(F.col("day") == F.lit(day))
    files = [r["_file"] for r in old.select("_file").distinct().collect()]
    if len(files) < 2:
        return 0
    order = ["level", "ts"]
    new = old.drop("_file").withColumn("gen", F.lit(gen)).repartitionByRange(*order).sortWithinPartitions(*order)
    new.write.mode("append").partitionBy("gen", "day", "level").parquet(f"{path}_compacted")
    commit = spark.createDataFrame([(gen, f) for f in files], COMMIT)
    commit.coalesce(1).write.mode("overwrite").parquet(f"{path}_aside/{gen}")
    move_into_place(spark, f"{path}_aside/{gen}", f"{path}_commits/{gen}")
    return len(files)


def replaced_files(spark: SparkSession, path: str) -> DataFrame:
    """K4: the files that no reader of the store opens any more once it has begun anew."""
    return _commits(spark, path).select("file").distinct()


def read_alerts(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Alerts with ``ts``, their event time."""
    reader = spark.read.schema(ALERT)
    if fmt == "csv":
        reader = reader.option("header", True)
    return with_alert_time(reader.format(fmt).load(path).select(*ALERT.names))


def read_alerts_stream(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """The same from a growing folder of JSON lines."""
    reader = spark.readStream.schema(ALERT)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return with_alert_time(reader.json(path))


def parse_alert_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Alerts from JSON text; a line that is no JSON object gives nulls."""
    return with_alert_time(lines.withColumn("_a", F.from_json(column, ALERT)).select("_a.*"))


def with_alert_time(alerts: DataFrame) -> DataFrame:
    """add ``ts`` from the ISO-8601 text; text without an offset is in UTC."""
    text = F.col("timestamp")
    zoned = F.when(text.rlike(r"(Z|[+-][0-9]{2}:?[0-9]{2})$"), text).otherwise(F.concat(text, F.lit("+00:00")))
    return alerts.withColumn("ts", F.try_to_timestamp(zoned))
