"""Bounded replay: feed stored rows to a streaming query step by step, then close all windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import fresh_dir


def replay(
    spark: SparkSession,
    steps: list[DataFrame],
    build: Callable[[DataFrame], DataFrame],
    mode: str = "append",
    name: str = "replay",
) -> DataFrame:
    """Run a stream over the steps, one after the other, and return all that it gave out.

    Each step is written to the watched folder and the query is restarted from its checkpoint until it has read all,
    so state is carried over restarts. Each micro-batch goes to its own folder; the column ``batch_id`` tells which.
    """
    source, sink, checkpoint = (fresh_dir(spark, f"{name}-{part}") for part in ("source", "sink", "checkpoint"))
    schema = None

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink}/batch_id={batch_id}")

    for step in steps:
        step.write.mode("append").parquet(source)
        stream = build(spark.readStream.schema(step.schema).parquet(source))
        schema = stream.schema
        writer = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint)
        writer.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(T.StructType([*schema.fields, T.StructField("batch_id", T.LongType())])).parquet(sink)


def end_marker(packets: DataFrame, beyond_seconds: int) -> DataFrame:
    """T4: one packet far behind the last one; it moves the watermark, so that all windows before it are given out.

    It holds no packet (all other fields are null), so it never shows in a result.
    """
    last = packets.agg((F.max("ts_us") + F.lit(beyond_seconds * 1_000_000)).alias("ts_us"))
    rest = [F.lit(None).cast(f.dataType).alias(f.name) for f in packets.schema if f.name != "ts_us"]
    return last.select("ts_us", *rest).select(*packets.columns)
