import pytest
from pyspark.sql import functions as F

from flowtide.operators.calibration import best_contamination, f1_table, red_threshold
from flowtide.plans.detect import detect, detect_batch, score_flows
from flowtide.plans.train import TrainParams, train
from flowtide.schemas import FEATURES_EXTENDED, FEATURES_MINIMAL
from flowtide.sources.registry import latest_versions, load_model, load_thresholds, save_model, write_thresholds
from flowtide.sources.synthetic import synthetic_flows
from flowtide.sources.tables import read_alerts


@pytest.fixture(scope="module")
def flows(spark):
    return synthetic_flows(spark, 3000, 60, 40, seed=5).cache()


@pytest.fixture(scope="module")
def model(flows):
    return train(flows, TrainParams(trees=60), version="v1")


def test_training(model, flows):
    assert model.columns == FEATURES_EXTENDED and model.forest.trees == 60
    assert model.card["train_rows"] == 3100 and model.card["contamination_used"] in (0.005, 0.01, 0.02, 0.05)
    assert model.red <= -0.02 and model.yellow == 0.0 and -1 < model.offset < 0
    scored = score_flows(flows, model)
    means = {r.kind: r.s for r in scored.withColumn("kind", F.expr("label + int(bidirectional_packets >= 1000)")).groupBy("kind").agg(F.avg("score").alias("s")).collect()}
    assert means[2] < 0 < means[0]
    benign_red = scored.where(f"label = 0 AND score < {model.red}").count()
    assert benign_red <= 30


def test_unlabelled_and_minimal(flows):
    m = train(flows.drop("label"), TrainParams(feature_set="minimal", trees=20, contamination=0.03, outlier_ratio=0.0))
    assert m.columns == FEATURES_MINIMAL and m.card["contamination_used"] == 0.03
    least = score_flows(flows, m).agg(F.min("score")).first()[0]
    assert m.red == pytest.approx(least - 0.05)
    flagged = score_flows(flows, m).where("score < 0").count()
    assert flagged == pytest.approx(0.03 * 3100, abs=3)


def test_label_column_without_attacks(flows):
    m = train(flows.where("label = 0"), TrainParams(trees=10))
    assert m.card["train_rows"] == 3000


def test_empty_table_is_an_error(flows):
    with pytest.raises(ValueError):
        train(flows.limit(0))


def test_registry(spark, model, flows, tmp_path):
    folder = str(tmp_path / "models")
    with pytest.raises(FileNotFoundError):
        load_model(spark, folder)
    save_model(spark, model, folder, "v1")
    other = train(flows.drop("label"), TrainParams(trees=5), version="v2")
    save_model(spark, other, folder, "v2")
    assert load_model(spark, folder).forest.trees == 5
    back = load_model(spark, folder, "v1")
    assert (back.offset, back.red, back.yellow, back.card) == (model.offset, model.red, model.yellow, model.card)
    a, b = (sorted(r.score for r in score_flows(flows.limit(200), m).collect()) for m in (model, back))
    assert a == pytest.approx(b, rel=1e-12)
    with pytest.raises(FileNotFoundError):
        load_model(spark, folder, "v3")


def test_latest(spark):
    meta = spark.createDataFrame([("a", 1), ("b", 3), ("c", 3), ("d", 2)], "version string, created_us bigint")
    assert latest_versions(meta).first().version == "c"


def test_stored_thresholds(spark, tmp_path):
    assert load_thresholds(spark, str(tmp_path)) == (-0.25, 0.0)
    write_thresholds(spark, str(tmp_path), -0.1, -0.05)
    assert load_thresholds(spark, str(tmp_path)) == (-0.1, -0.05)
    assert load_thresholds(spark, str(tmp_path), red="-0.2", yellow="invalid") == (-0.2, -0.05)


def test_detection_job(spark, model, flows, tmp_path):
    out = str(tmp_path / "out")
    stats = detect_batch(flows, model, out, as_of="2025-01-01T00:00:00")
    assert stats["n"] == 3100 and stats["min_score"] < stats["mean_score"] < stats["max_score"]
    as_json, as_csv = read_alerts(spark, f"{out}/alerts_json"), read_alerts(spark, f"{out}/alerts_csv", "csv")
    assert stats["alerts"] == as_json.count() == as_csv.count() == detect(flows, model).count() > 0
    assert detect(flows, model, red="1", yellow="2").where("level = 'RED'").count() == 3100
    assert detect(flows, model, yellow="-2").count() == 0


def test_scoring_needs_the_features_of_the_model(model, flows):
    with pytest.raises(ValueError):
        score_flows(flows.drop("iat_std"), model)


def test_missing_values_count_as_zero(model, flows):
    holed = flows.withColumn("iat_std", F.lit(None).cast("double"))
    filled = flows.withColumn("iat_std", F.lit(0.0))
    a, b = (sorted(r.score for r in score_flows(f, model).collect()) for f in (holed, filled))
    assert a == b


def test_f1_and_ties(spark):
    rows = [(-0.9, 1), (-0.8, 1), (-0.7, 0), (-0.3, 0), (-0.2, 1)]
    scored = spark.createDataFrame(rows, "raw_score double, label int")
    table = f1_table(scored, {0.1: -0.75, 0.2: -0.75, 0.3: -0.5, 0.4: -1.0})
    by = {r.contamination: r for r in table.collect()}
    assert (by[0.1].tp, by[0.1].fp, by[0.1].fn) == (2, 0, 1) and by[0.1].f1 == pytest.approx(0.8)
    assert (by[0.3].tp, by[0.3].fp, by[0.3].fn) == (2, 1, 1)
    assert (by[0.4].precision, by[0.4].recall, by[0.4].f1) == (0, 0, 0)
    assert best_contamination(table) == 0.1


def test_red_threshold(spark):
    rows = [(-0.5, 1), (-0.3, 0), (-0.1, 0), (0.2, 0)]
    table = spark.createDataFrame(rows, "score double, label int")
    assert red_threshold(table, "label") == pytest.approx(-0.3 + 0.2 * 0.02 - 0.001)
    assert red_threshold(table) == pytest.approx(-0.55)
    assert red_threshold(table.where("label = 1"), "label") == pytest.approx(-0.55)
    assert red_threshold(table.withColumn("score", F.col("score") + 5), "label") == -0.02
    assert red_threshold(table.limit(0)) == -0.1
