"""Model storage: parquet tables per version, and a ``meta`` table whose row commits a version."""

from __future__ import annotations

from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..operators.alerts import DEFAULT_RED, DEFAULT_YELLOW, resolve_threshold, threshold_columns
from ..operators.features import Scaler
from ..operators.forest import NODE_SCHEMA, Forest

META_SCHEMA = "version string, created_us bigint, sample int, offset double, columns array<string>"


@dataclass(frozen=True)
class Model:
    """Scaler, forest, decision offset and thresholds, with the facts of the model card."""

    scaler: Scaler
    forest: Forest
    offset: float
    red: float = DEFAULT_RED
    yellow: float = DEFAULT_YELLOW
    card: dict = field(default_factory=dict)

    @property
    def columns(self) -> list[str]:
        return self.scaler.columns


CARD_SCHEMA = (
    "version string, feature_set string, contamination_config double, contamination_used double, "
    "n_estimators int, train_rows bigint, columns_numeric array<string>"
)


def model_card(spark: SparkSession, model: Model) -> DataFrame:
    """K7: the facts of a training run, one row."""
    return spark.createDataFrame([model.card], CARD_SCHEMA)


def save_model(spark: SparkSession, model: Model, folder: str, version: str) -> str:
    """K5-K7: write all tables of a version, then the meta row; a version without that row does not exist."""
    home = f"{folder}/version={version}"
    model.scaler.table(spark).write.mode("overwrite").parquet(f"{home}/scaler")
    spark.createDataFrame(model.forest.nodes, NODE_SCHEMA).write.mode("overwrite").parquet(f"{home}/forest")
    write_thresholds(spark, home, model.red, model.yellow)
    model_card(spark, model).write.mode("overwrite").json(f"{home}/card")
    now = spark.sql("SELECT unix_micros(current_timestamp())").first()[0]
    row = (version, now, int(model.forest.sample), float(model.offset), model.columns)
    spark.createDataFrame([row], META_SCHEMA).write.mode("append").parquet(f"{folder}/meta")
    return home


def latest_versions(meta: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The newest version (of each group): the greatest creation time, ties to the greater name."""
    newest = F.max(F.struct("created_us", "version")).alias("m")
    return meta.groupBy(*(by or [])).agg(newest).select(*(by or []), "m.version", "m.created_us")


def load_model(spark: SparkSession, folder: str, version: str | None = None) -> Model:
    """The named version, else the newest; none is an error."""
    try:
        meta = spark.read.schema(META_SCHEMA).parquet(f"{folder}/meta")
        wanted = meta if version is None else meta.where(F.col("version") == version)
        row = wanted.orderBy(F.desc("created_us"), F.desc("version")).limit(1).collect()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        row = []
    if not row:
        raise FileNotFoundError(f"no model {version or ''} in {folder}; train one first")
    meta_row = row[0]
    home = f"{folder}/version={meta_row.version}"
    columns = list(meta_row["columns"])
    scaler = spark.read.parquet(f"{home}/scaler").toPandas().set_index("feature").loc[columns]
    nodes: pd.DataFrame = spark.read.schema(NODE_SCHEMA).parquet(f"{home}/forest").toPandas()
    red, yellow = load_thresholds(spark, home)
    card = spark.read.schema(CARD_SCHEMA).json(f"{home}/card").first().asDict()
    return Model(
        Scaler(columns, scaler["mean"].tolist(), scaler["scale"].tolist()),
        Forest.from_nodes(nodes, columns, meta_row.sample),
        meta_row.offset,
        red,
        yellow,
        card,
    )


def write_thresholds(spark: SparkSession, home: str, red: float, yellow: float) -> None:
    """K6: one JSON document."""
    rows = spark.createDataFrame([(float(red), float(yellow))], "red_threshold double, yellow_threshold double")
    rows.write.mode("overwrite").json(f"{home}/thresholds")


def load_thresholds(spark: SparkSession, home: str, red=None, yellow=None) -> tuple[float, float]:
    """Stored thresholds or the defaults; valid overrides win."""
    try:
        text = spark.read.text(f"{home}/thresholds", wholetext=True)
        row = text.select(*threshold_columns(F.col("value"))).first()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        row = None
    stored = (DEFAULT_RED, DEFAULT_YELLOW) if row is None else tuple(row)
    return resolve_threshold(stored[0], red), resolve_threshold(stored[1], yellow)
