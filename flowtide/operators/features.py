"""Feature matrix, scaling and outlier injection."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.hashing import uniform
from .quantiles import exact_quantiles


def clean(column: Column) -> Column:
    """As a double, with missing and non-finite values as 0.0."""
    x = column.cast("double")
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))), F.lit(0.0)).otherwise(x)


def select_features(flows: DataFrame, columns: list[str], keep: list[str] | None = None) -> DataFrame:
    """The features in order as clean doubles, behind the columns to keep."""
    missing = [c for c in columns if c not in flows.columns]
    if missing:
        raise ValueError(f"flows lack the features {missing}")
    return flows.select(*(keep or []), *[clean(F.col(c)).alias(c) for c in columns])


@dataclass(frozen=True)
class Scaler:
    """Mean and population standard deviation per feature; a constant feature has scale 1."""

    columns: list[str]
    mean: list[float]
    scale: list[float]

    def table(self, spark: SparkSession) -> DataFrame:
        rows = list(zip(self.columns, self.mean, self.scale))
        return spark.createDataFrame(rows, "feature string, mean double, scale double")


def scaler_row(features: DataFrame, columns: list[str]) -> DataFrame:
    """One row with ``mean_x`` and ``scale_x`` of each feature, from one aggregation."""
    std = {c: F.coalesce(F.stddev_pop(c), F.lit(0.0)) for c in columns}
    return features.agg(
        *[F.avg(c).alias(f"mean_{c}") for c in columns],
        *[F.when(std[c] == 0.0, F.lit(1.0)).otherwise(std[c]).alias(f"scale_{c}") for c in columns],
    )


def fit_scaler(features: DataFrame, columns: list[str]) -> Scaler:
    """The scaler as driver values (two numbers per feature)."""
    row = scaler_row(features, columns).first()
    return Scaler(list(columns), [row[f"mean_{c}"] for c in columns], [row[f"scale_{c}"] for c in columns])


def scaled_columns(scaler: Scaler) -> list[Column]:
    return [
        ((F.col(c) - F.lit(m)) / F.lit(s)).alias(c) for c, m, s in zip(scaler.columns, scaler.mean, scaler.scale)
    ]


def scale_features(features: DataFrame, scaler: Scaler, keep: list[str] | None = None) -> DataFrame:
    """M1: standardised features behind the columns to keep."""
    return features.select(*(keep or []), *scaled_columns(scaler))


def feature_quantiles(features: DataFrame, columns: list[str], probabilities=(0.05, 0.95), **limits) -> DataFrame:
    """A row per feature and probability."""
    found = exact_quantiles(features, {c: list(probabilities) for c in columns}, **limits)
    rows = [(c, float(p), v) for c in columns for p, v in zip(probabilities, found[c])]
    return features.sparkSession.createDataFrame(rows, "feature string, probability double, value double")


def outlier_count(rows: int, ratio: float) -> int:
    """M2: outliers added to so many rows."""
    return max(1, int(rows * ratio)) if ratio > 0 and rows > 0 else 0


def outlier_rows(
    spark: SparkSession, n: int, columns: list[str], low: list[float], high: list[float], seed: int = 42
) -> DataFrame:
    """M2: ``n`` rows far above the 95th percentile; every feature is drawn on its own."""
    ids = spark.range(n)
    draws = [
        (F.lit(hi) + F.lit(5.0 * max(1e-9, hi - lo)) * uniform(seed, "outlier", F.col("id"), c)).alias(c)
        for c, lo, hi in zip(columns, low, high)
    ]
    return ids.select(F.col("id").alias("outlier_id"), *draws)


def inject_outliers(
    scaled: DataFrame,
    columns: list[str],
    ratio: float = 0.02,
    seed: int = 42,
    label: str | None = None,
    rows: int | None = None,
) -> DataFrame:
    """Append ``max(1, floor(ratio * rows))`` outliers; a label column gets 1 for them.

    Other columns of the input are null in the new rows; ``outlier_id`` is null in the old ones.
    """
    marked = scaled.withColumn("outlier_id", F.lit(None).cast("bigint"))
    rows = scaled.count() if rows is None else rows
    if outlier_count(rows, ratio) == 0:
        return marked
    bounds = exact_quantiles(scaled, {c: [0.05, 0.95] for c in columns}, rows)
    low, high = ([bounds[c][i] for c in columns] for i in (0, 1))
    extra = outlier_rows(scaled.sparkSession, outlier_count(rows, ratio), columns, low, high, seed)
    if label is not None:
        kind = scaled.schema[label].dataType if label in scaled.columns else T.IntegerType()
        extra = extra.withColumn(label, F.lit(1).cast(kind))
    return marked.unionByName(extra, allowMissingColumns=True)
