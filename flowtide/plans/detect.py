"""The batch detection job, from a flow table to alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.alerts import detection_time, resolve_threshold, score_stats, to_alerts
from ..operators.features import clean
from ..operators.forest import score_column
from ..schemas import FLOW_KEY
from ..sources.registry import Model
from ..sources.tables import write_alerts
from ..storage import materialise


def score_expression(spark: SparkSession, model: Model) -> Column:
    """M1/M4/M5: the score of a flow as a column; holds the broadcast forest, so it can be used for many tables."""
    s = model.scaler
    inputs = [(clean(F.col(c)) - F.lit(m)) / F.lit(d) for c, m, d in zip(s.columns, s.mean, s.scale)]
    return score_column(spark, model.forest, inputs) - F.lit(model.offset)


def score_flows(flows: DataFrame, model: Model) -> DataFrame:
    """M1/M4/M5: add ``score``; below 0 is an anomaly. Uses the features the model was fitted on; no shuffle."""
    missing = [c for c in model.columns if c not in flows.columns]
    if missing:
        raise ValueError(f"flows lack the features {missing}")
    return flows.withColumn("score", score_expression(flows.sparkSession, model))


def detect(flows: DataFrame, model: Model, red=None, yellow=None, as_of=None) -> DataFrame:
    """Alert rows of a flow table; threshold overrides that are no numbers are ignored."""
    limits = resolve_threshold(model.red, red), resolve_threshold(model.yellow, yellow)
    return to_alerts(score_flows(flows, model), *limits, as_of)


def detect_batch(
    flows: DataFrame, model: Model, out: str, red=None, yellow=None, as_of=None, batch_id: int | None = None
) -> dict:
    """Score once, write the alerts as JSON lines and CSV, and return the score statistics and the alert count.

    The scores are written to the shared folder, so that statistics and alerts come from the same pass.
    """
    limits = resolve_threshold(model.red, red), resolve_threshold(model.yellow, yellow)
    scored = materialise(score_flows(flows, model).select(*FLOW_KEY, "score"), "scored")
    stats = score_stats(scored).first().asDict()
    alerts = to_alerts(scored, *limits, detection_time(as_of))
    write_alerts(alerts, f"{out}/alerts_json", "json", batch_id)
    write_alerts(alerts, f"{out}/alerts_csv", "csv", batch_id)
    stats["alerts"] = scored.where(F.col("score") < F.lit(limits[1])).count()
    return stats
