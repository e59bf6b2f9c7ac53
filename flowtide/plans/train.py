"""M9: the training job, from a flow table to a model."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.alerts import DEFAULT_YELLOW
from ..operators.calibration import calibration_table, decision_offsets, red_threshold
from ..operators.features import fit_scaler, inject_outliers, outlier_count, scale_features, select_features
from ..operators.forest import SAMPLE, TREES, Forest, fit_forest, score_rows
from ..operators.sampling import number_rows, stratified_split
from ..schemas import feature_columns, present_features
from ..sources.registry import Model
from ..storage import materialise


@dataclass(frozen=True)
class TrainParams:
    feature_set: str = "extended"
    contamination: float = 0.02
    outlier_ratio: float = 0.02
    validation: float = 0.2
    trees: int = TREES
    sample: int = SAMPLE
    seed: int = 42


def _fit(data: DataFrame, columns: list[str], p: TrainParams, rows: int) -> Forest:
    return fit_forest(data, columns, p.trees, p.sample, p.seed, key=["row_id"], rows=rows)


def calibrate(data: DataFrame, columns: list[str], p: TrainParams, candidates: list[float] | None = None) -> float:
    """M6: the contamination with the best F1 on held-out rows.

    Contamination only moves the offset, so one forest and one scoring pass serve all candidates.
    """
    split = stratified_split(data, "label", p.validation, p.seed, key=["row_id"])
    fitted = split.where(~F.col("is_val"))
    rows = fitted.count()
    forest = _fit(fitted, columns, p, rows)
    scored = materialise(score_rows(split, forest).select("raw_score", "label", "is_val"), "calibration")
    return calibration_table(scored, candidates, rows).where("chosen").first()["contamination"]


def train(
    flows: DataFrame, params: TrainParams | None = None, label: str | None = "label", version: str = "unnamed"
) -> Model:
    """Fit scaler and forest on the flows plus injected outliers, calibrate with labels if there are any.

    The feature set "adaptive" (P7) is the base features and those extended ones that the table has.
    """
    p = params or TrainParams()
    adaptive = p.feature_set == "adaptive"
    columns = present_features(flows.columns) if adaptive else feature_columns(p.feature_set)
    labelled = label is not None and label in flows.columns
    keep = [F.col(label).cast("int").alias("label")] if labelled else []
    features = select_features(flows, columns, keep=keep)
    # Numbers follow from the rows' content, so the same data give the same model, however they are partitioned.
    features = materialise(number_rows(features, "row_id"), "features")
    rows = features.count()
    if rows == 0:
        raise ValueError("the flow table is empty, nothing to train on")

    scaler = fit_scaler(features, columns)
    rest = ["row_id"] + (["label"] if labelled else [])
    scaled = scale_features(features, scaler, keep=rest)
    injected = inject_outliers(scaled, columns, p.outlier_ratio, p.seed, "label" if labelled else None, rows)
    injected = injected.withColumn("row_id", F.coalesce("row_id", -1 - F.col("outlier_id")))

    used = calibrate(injected, columns, p) if labelled else p.contamination
    total = rows + outlier_count(rows, p.outlier_ratio)
    forest = _fit(injected, columns, p, total)
    kept = ["outlier_id", "raw_score"] + (["label"] if labelled else [])
    scored = materialise(score_rows(injected, forest).select(*kept), "scores")
    offset = decision_offsets(scored, [used], rows=total)[used]
    decisions = scored.where("outlier_id IS NULL").withColumn("score", F.col("raw_score") - F.lit(offset))
    red = red_threshold(decisions, "label" if labelled else None, rows=rows)
    card = {
        "version": version,
        "feature_set": p.feature_set,
        "contamination_config": p.contamination,
        "contamination_used": used,
        "n_estimators": p.trees,
        "train_rows": rows,
        "columns_numeric": columns,
    }
    return Model(scaler, forest, offset, red, DEFAULT_YELLOW, card)
