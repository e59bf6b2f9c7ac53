"""Features, forest, calibration, thresholds, registry, training and detection jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowtide.operators.alerts import log_line, score_stats, threshold_columns, to_alerts
from flowtide.operators.calibration import CANDIDATES, calibration_table, decision_offsets, f1_table, red_threshold
from flowtide.operators.features import feature_quantiles, fit_scaler, inject_outliers, scale_features, scaler_row, select_features
from flowtide.operators.forest import fit_forest, forest_nodes, score_rows
from flowtide.operators.sampling import stratified_split
from flowtide.plans.detect import detect_batch, score_flows
from flowtide.plans.train import TrainParams, train
from flowtide.functions.hashing import uniform
from flowtide.schemas import ALERT, FEATURES_EXTENDED, FLOW_KEY, present_features
from flowtide.sources.registry import latest_versions, load_model, save_model
from flowtide.sources.tables import read_alerts
from flowtide.storage import fresh_dir, materialise

from .adapters import (
    AS_OF,
    FIXED_RED,
    FIXED_YELLOW,
    KEY,
    LABELLED,
    SCORED,
    UNI,
    fixed_model,
    scored_flows,
    table,
    uni_flows,
    with_label,
)
from .registry import check, rounded, sql_hash60, sql_r4, sql_uniform

ID = ["window", *FLOW_KEY]
FEATURES = FEATURES_EXTENDED


def _features(spark, sf):
    return select_features(uni_flows(spark, sf), FEATURES, keep=ID)


@check("feature_matrix", f"""{UNI} SELECT "window", {KEY}, {", ".join(sql_r4(f"CAST({c} AS DOUBLE)", c) for c in FEATURES)} FROM flows""")
def feature_matrix(spark, sf):
    return rounded(_features(spark, sf), FEATURES)


LACKING = ["iat_std", "tcp_rst_count", "packets_per_second"]
ADAPTED = [c for c in FEATURES if c not in LACKING]


@check("feature_matrix_adaptive", f"""{UNI} SELECT "window", {KEY}, {", ".join(sql_r4(f"CAST({c} AS DOUBLE)", c) for c in ADAPTED)} FROM flows""")
def feature_matrix_adaptive(spark, sf):
    """Of the extended features those that a table has, after the base ones."""
    flows = uni_flows(spark, sf).drop(*LACKING)
    columns = present_features(flows.columns)
    return rounded(select_features(flows, columns, keep=ID), columns)


SCALER_COLUMNS = ", ".join(
    f"{sql_r4(f'avg({c})', f'mean_{c}')}, {sql_r4(f'CASE WHEN stddev_pop({c}) = 0 THEN 1 ELSE stddev_pop({c}) END', f'scale_{c}')}" for c in FEATURES
)


@check("scaler_fit", f"{UNI} SELECT {SCALER_COLUMNS} FROM flows")
def scaler_fit(spark, sf):
    row = scaler_row(_features(spark, sf), FEATURES)
    return rounded(row, row.columns)


def scaled_cte(name: str = "scaled") -> str:
    exprs = ", ".join(f"({c} - (SELECT avg({c}) FROM flows)) / (SELECT CASE WHEN stddev_pop({c}) = 0 THEN 1 ELSE stddev_pop({c}) END FROM flows) AS {c}" for c in FEATURES)
    return f"""{name} AS (SELECT "window", {KEY}, {exprs} FROM flows)"""


@check("scaled_features", f"""{UNI}, {scaled_cte()} SELECT "window", {KEY}, {", ".join(sql_r4(c, c) for c in FEATURES)} FROM scaled""")
def scaled_features(spark, sf):
    features = _features(spark, sf)
    return rounded(scale_features(features, fit_scaler(features, FEATURES), keep=ID), FEATURES)


QUANTILES = " UNION ALL ".join(
    f"SELECT '{c}' AS feature, CAST({p} AS DOUBLE) AS probability, {sql_r4(f'quantile_cont(CAST({c} AS DOUBLE), {p})', 'value')} FROM flows" for c in FEATURES for p in (0.05, 0.95)
)


@check("feature_quantiles", f"{UNI} {QUANTILES}")
def feature_quantile_query(spark, sf):
    return rounded(feature_quantiles(_features(spark, sf), FEATURES), ["value"])


@check("feature_quantiles_bracketed", f"{UNI} {QUANTILES}")
def feature_quantiles_bracketed(spark, sf):
    """The form for long columns: sketch, count, read the bracket."""
    features = materialise(_features(spark, sf), "features")
    return rounded(feature_quantiles(features, FEATURES, direct_rows=100, bracket_rows=50), ["value"])


INJECTED = ", ".join(
    f"q95_{c} + 5.0 * greatest(1e-9, q95_{c} - q05_{c}) * {sql_uniform(repr('42'), repr('outlier'), 'CAST(id AS VARCHAR)', repr(c))} AS {c}" for c in FEATURES
)
INJECT_SQL = f"""{UNI}, {scaled_cte()}, q AS (
  SELECT {", ".join(f"quantile_cont({c}, 0.05) AS q05_{c}, quantile_cont({c}, 0.95) AS q95_{c}" for c in FEATURES)}, count(*) AS n FROM scaled
), extra AS (SELECT id AS outlier_id, {INJECTED} FROM q, range(CAST(greatest(1, floor(n * 0.02)) AS BIGINT)) AS r(id))
SELECT outlier_id, CAST(outlier_id IS NOT NULL AS INTEGER) AS label, {", ".join(sql_r4(c, c) for c in FEATURES)}
FROM (SELECT CAST(NULL AS BIGINT) AS outlier_id, {", ".join(FEATURES)} FROM scaled UNION ALL SELECT outlier_id, {", ".join(FEATURES)} FROM extra)"""


@check("inject_outliers", INJECT_SQL)
def inject_outlier_query(spark, sf):
    features = materialise(_features(spark, sf).select(F.lit(0).alias("label"), *FEATURES), "features")
    scaled = scale_features(features, fit_scaler(features, FEATURES), keep=["label"])
    return rounded(inject_outliers(scaled, FEATURES, label="label").select("outlier_id", "label", *FEATURES), FEATURES)


SPLIT_KEY = ", ".join(f"CAST({c} AS VARCHAR)" for c in ['"window"', *FLOW_KEY])


@check(
    "stratified_split",
    f"""{UNI}, {SCORED}, {LABELLED}, ranked AS (
          SELECT *, row_number() OVER (PARTITION BY label ORDER BY {sql_hash60("'42'", SPLIT_KEY)}) AS rank, count(*) OVER (PARTITION BY label) AS n FROM labelled)
        SELECT "window", {KEY}, CAST(label AS INTEGER) AS label, rank <= floor(n * 0.2) AS is_val FROM ranked""",
)
def split_query(spark, sf):
    flows = materialise(with_label(uni_flows(spark, sf)).select(*ID, "label"), "labelled")
    return stratified_split(flows, "label", key=ID)


@check("score_fixed_forest", f"""{UNI}, {SCORED} SELECT "window", {KEY}, {sql_r4("score", "score")} FROM scored""")
def score_fixed_forest(spark, sf):
    return rounded(scored_flows(spark, sf).select(*ID, "score"), ["score"])


@check(
    "score_stats",
    f"""{UNI}, {SCORED} SELECT count(*) AS n, {sql_r4("min(score)", "min_score")}, {sql_r4("avg(score)", "mean_score")}, {sql_r4("max(score)", "max_score")} FROM scored""",
)
def score_stats_query(spark, sf):
    return rounded(score_stats(scored_flows(spark, sf)), ["min_score", "mean_score", "max_score"])


ALERT_SQL = f"""{UNI}, {SCORED} SELECT '{AS_OF}' AS "timestamp", {KEY}, {sql_r4("score", "score")},
  CASE WHEN score < {FIXED_RED} THEN 'RED' ELSE 'YELLOW' END AS level FROM scored WHERE score < {FIXED_YELLOW}"""


@check("alert_levels", ALERT_SQL)
def alert_levels(spark, sf):
    return rounded(to_alerts(scored_flows(spark, sf), FIXED_RED, FIXED_YELLOW, AS_OF), ["score"])


@check(
    "alert_log_lines",
    f"""{UNI}, {SCORED} SELECT CASE WHEN score < {FIXED_RED} THEN 'ANOMALY RED ' ELSE 'Anomaly YELLOW ' END || src_ip || ':' || src_port
        || ' -> ' || dst_ip || ':' || dst_port || ' ' || upper(protocol) || ' score=' || printf('%.4f', score) AS line FROM scored WHERE score < {FIXED_YELLOW}""",
)
def alert_log_lines(spark, sf):
    return log_line(to_alerts(scored_flows(spark, sf), FIXED_RED, FIXED_YELLOW, AS_OF)).select("line")


@check("detect_batch", ALERT_SQL)
def detect_batch_query(spark, sf):
    out = fresh_dir(spark, "detect")
    detect_batch(uni_flows(spark, sf), fixed_model(), out, as_of=AS_OF)
    return rounded(read_alerts(spark, f"{out}/alerts_json").select(*ALERT.names), ["score"])


OFFSETS = " UNION ALL ".join(f"SELECT CAST({c} AS DOUBLE) AS contamination, quantile_cont(score, {c}) AS cut FROM scored" for c in CANDIDATES)


@check("decision_offset", f"{UNI}, {SCORED}, cuts AS ({OFFSETS}) SELECT contamination, {sql_r4('cut', 'cut')} FROM cuts")
def decision_offset(spark, sf):
    found = decision_offsets(scored_flows(spark, sf), CANDIDATES, "score")
    return rounded(spark.createDataFrame(list(found.items()), "contamination double, cut double"), ["cut"])


# Scores of a small forest repeat, so the cuts of this query lie between the values they may take.
CUTS = {0.005: -0.12, 0.01: -0.07, 0.02: 0.01, 0.05: 0.05}
F1_ROWS = " UNION ALL ".join(
    f"""SELECT CAST({c} AS DOUBLE) AS contamination, count(*) FILTER (score < {cut} AND label = 1) AS tp,
        count(*) FILTER (score < {cut} AND label = 0) AS fp, count(*) FILTER (score >= {cut} AND label = 1) AS fn FROM labelled"""
    for c, cut in CUTS.items()
)


@check(
    "f1_by_contamination",
    f"""{UNI}, {SCORED}, {LABELLED}, counts AS ({F1_ROWS}), rates AS (
          SELECT *, tp / greatest(1, tp + fp) AS p, tp / greatest(1, tp + fn) AS r FROM counts)
        SELECT contamination, tp, fp, fn, {sql_r4("p", "precision")}, {sql_r4("r", "recall")},
               {sql_r4("CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END", "f1")} FROM rates""",
)
def f1_by_contamination(spark, sf):
    scored = with_label(scored_flows(spark, sf))
    return rounded(f1_table(scored, CUTS, score="score"), ["precision", "recall", "f1"])


# Scores of the small forest with a little noise, so that no two are equal at a cut; a fifth of each label is held out.
NOISY_KEY = ", ".join(f"CAST({c} AS VARCHAR)" for c in ['"window"', *FLOW_KEY])
NOISY = f"""noisy AS (
  SELECT *, score + 0.01 * {sql_uniform("'42'", "'noise'", NOISY_KEY)} AS raw_score,
    row_number() OVER (PARTITION BY label ORDER BY {sql_hash60("'42'", NOISY_KEY)}) <= floor(count(*) OVER (PARTITION BY label) * 0.2) AS is_val
  FROM labelled)"""
TRIED = " UNION ALL ".join(f"SELECT {i} AS place, CAST({c} AS DOUBLE) AS contamination, quantile_cont(raw_score, {c}) AS cut FROM noisy WHERE NOT is_val" for i, c in enumerate(CANDIDATES))


@check(
    "calibration_choice",
    f"""{UNI}, {SCORED}, {LABELLED}, {NOISY}, tried AS ({TRIED}), counts AS (
          SELECT place, contamination, cut, count(*) FILTER (raw_score < cut AND label = 1) AS tp,
            count(*) FILTER (raw_score < cut AND label = 0) AS fp, count(*) FILTER (raw_score >= cut AND label = 1) AS fn
          FROM tried, noisy WHERE is_val GROUP BY ALL),
        rates AS (SELECT *, tp / greatest(1, tp + fp) AS p, tp / greatest(1, tp + fn) AS r FROM counts),
        scores AS (SELECT *, CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END AS f1 FROM rates)
        SELECT contamination, {sql_r4("cut", "cut")}, tp, fp, fn, {sql_r4("f1", "f1")},
          row_number() OVER (ORDER BY f1 DESC, place) = 1 AS chosen FROM scores""",
)
def calibration_choice(spark, sf):
    """M6: offsets on the fitted rows, F1 on the held-out ones, and the choice."""
    flows = with_label(scored_flows(spark, sf))
    noise = uniform("42", "noise", *[F.col(c).cast("string") for c in ID])
    rows = materialise(flows.select(*ID, "label", (F.col("score") + 0.01 * noise).alias("raw_score")), "noisy")
    table = calibration_table(stratified_split(rows, "label", key=ID))
    return rounded(table.withColumnRenamed("offset", "cut"), ["cut", "f1"]).select("contamination", "cut", "tp", "fp", "fn", "f1", "chosen")


@check(
    "red_threshold",
    f"""{UNI}, {SCORED}, {LABELLED}
        SELECT {sql_r4("least(quantile_cont(score, 0.01) FILTER (label = 0) - 0.001, -0.02)", "labelled")},
               {sql_r4("min(score) - 0.05", "unlabelled")} FROM labelled""",
)
def red_threshold_query(spark, sf):
    scored = materialise(with_label(scored_flows(spark, sf)).select("score", "label"), "scored")
    row = (red_threshold(scored, "label"), red_threshold(scored))
    return rounded(spark.createDataFrame([row], "labelled double, unlabelled double"), ["labelled", "unlabelled"])


THRESHOLD_TEXT = {
    "doc": """CASE event_type WHEN 'view' THEN concat('{"red_threshold": -0.', user_id % 10, ', "yellow_threshold": "0.0', user_id % 10, '"}')
      WHEN 'click' THEN concat('{"red_threshold": ', '-0.1}') WHEN 'error' THEN 'not json' WHEN 'purchase' THEN '{"yellow_threshold": "low"}' WHEN 'signup' THEN '{"red_threshold": null, "yellow_threshold": 0.5}' END""",
    "red": "CASE user_id % 4 WHEN 0 THEN ' -0.2 ' WHEN 1 THEN 'not_a_number' WHEN 2 THEN '' END",
    "yellow": "CASE user_id % 3 WHEN 0 THEN '-0.15' WHEN 1 THEN 'invalid' END",
}


@check(
    "thresholds_load",
    f"""SELECT event_id, coalesce(TRY_CAST(trim(red) AS DOUBLE), CASE event_type WHEN 'view' THEN CAST('-0.' || (user_id % 10) AS DOUBLE) WHEN 'click' THEN -0.1 END, -0.25) AS red_threshold,
          coalesce(TRY_CAST(trim(yellow) AS DOUBLE), CASE event_type WHEN 'view' THEN CAST('0.0' || (user_id % 10) AS DOUBLE) END, 0.0) AS yellow_threshold
        FROM (SELECT event_id, user_id, event_type, {THRESHOLD_TEXT['red']} AS red, {THRESHOLD_TEXT['yellow']} AS yellow FROM events)""",
)
def thresholds_load(spark, sf):
    ev = table(spark, sf, "events")
    doc, red, yellow = (F.expr(THRESHOLD_TEXT[n]) for n in ("doc", "red", "yellow"))
    return ev.select("event_id", *threshold_columns(doc, red, yellow))


@check(
    "model_latest",
    """SELECT o_custkey, version, epoch_us(o_orderdate) AS created_us FROM (
         SELECT o_custkey, 'v' || o_orderkey AS version, o_orderdate,
                row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, 'v' || o_orderkey DESC) AS rank FROM orders) WHERE rank = 1""",
)
def model_latest(spark, sf):
    """orders as a registry of many model folders, one per customer."""
    orders = table(spark, sf, "orders")
    created = F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("created_us")
    return latest_versions(orders.select("o_custkey", F.expr("concat('v', o_orderkey)").alias("version"), created), ["o_custkey"])


@check(
    "forest_fit",
    f"""{UNI}, n AS (SELECT count(*) AS n FROM flows) SELECT CAST(tree AS INTEGER) AS tree, CAST(least(256, n) AS BIGINT) AS root_rows,
        CAST(least(256, n) AS BIGINT) AS leaf_rows, TRUE AS within_limit, TRUE AS binary FROM n, range(200) AS t(tree)""",
)
def forest_fit(spark, sf):
    """The grown forest, checked tree by tree: rows at the root, rows over the leaves, depth limit, two children per split."""
    data = materialise(_features(spark, sf), "features")
    nodes = forest_nodes(data, FEATURES, data.count(), key=ID)
    leaf = F.col("feature") < 0
    return nodes.groupBy("tree").agg(
        F.max(F.when(F.col("node") == 0, F.col("size"))).cast("bigint").alias("root_rows"),
        F.sum(F.when(leaf, F.col("size"))).alias("leaf_rows"),
        (F.max("depth") <= 8).alias("within_limit"),
        (F.count_if(leaf) == F.count_if(~leaf) + 1).alias("binary"),
    )


@check("forest_scores")
def forest_scores(spark, sf):
    """Every flow scored by a forest grown on the same flows."""
    features = materialise(_features(spark, sf), "features")
    scaled = scale_features(features, fit_scaler(features, FEATURES), keep=ID)
    forest = fit_forest(scaled, FEATURES, key=ID)
    return rounded(score_rows(scaled, forest).select(*ID, "raw_score"), ["raw_score"])


def _train(spark, sf):
    flows = with_label(uni_flows(spark, sf))
    return train(flows, TrainParams(), label="label", version="check")


@check("train_model")
def train_model(spark, sf):
    model = _train(spark, sf)
    row = (model.offset, model.red, model.yellow, model.card["contamination_used"], model.card["train_rows"], model.forest.trees)
    return spark.createDataFrame([row], "offset double, red double, yellow double, contamination double, train_rows bigint, trees int")


# Flows by which the partitions of this query multiply.
PART_FLOWS = 250_000


@check(
    "train_properties",
    f"""{UNI}, n AS (SELECT count(*) AS n FROM flows) SELECT n AS train_rows, TRUE AS scores_in_range, TRUE AS red_below_limit,
        TRUE AS candidate_chosen, TRUE AS same_for_any_partitioning FROM n""",
)
def train_properties(spark, sf):
    """What must hold of any trained model, whatever its trees."""
    flows = materialise(with_label(uni_flows(spark, sf)), "flows")
    params = TrainParams(trees=20)
    parts = 1 + flows.count() // PART_FLOWS
    model, again = (train(flows.repartition(n * parts), params, version="check") for n in (3, 5))
    raw = F.col("score") + F.lit(model.offset)
    scores = score_flows(flows, model).agg(F.bool_and((raw > -1) & (raw < 0))).first()[0]
    row = (
        model.card["train_rows"],
        scores,
        model.red <= -0.02,
        model.card["contamination_used"] in CANDIDATES,
        abs(model.offset - again.offset) < 1e-9 and abs(model.red - again.red) < 1e-9,
    )
    names = ["scores_in_range", "red_below_limit", "candidate_chosen", "same_for_any_partitioning"]
    return spark.createDataFrame([row], ", ".join(["train_rows bigint", *[f"{n} boolean" for n in names]]))


@check("model_card", f"""{UNI} SELECT 'check' AS version, 'extended' AS feature_set, CAST(0.02 AS DOUBLE) AS contamination_config, CAST(20 AS INTEGER) AS n_estimators,
  count(*) AS train_rows, '{",".join(FEATURES)}' AS columns_numeric FROM flows""")  # fmt: skip
def model_card_query(spark, sf):
    """Train a small unlabelled model, save it, load it as the latest, and read its card."""
    folder = fresh_dir(spark, "models")
    model = train(uni_flows(spark, sf), TrainParams(trees=20), label=None, version="check")
    save_model(spark, model, folder, "check")
    card = load_model(spark, folder).card
    names = ["version", "feature_set", "contamination_config", "n_estimators", "train_rows"]
    row = [card[n] for n in names] + [",".join(card["columns_numeric"])]
    schema = "version string, feature_set string, contamination_config double, n_estimators int, train_rows bigint, columns_numeric string"
    return spark.createDataFrame([row], schema)


@check("train_and_detect")
def train_and_detect(spark, sf):
    """Train on the flows, then score the same flows into alerts."""
    flows = materialise(with_label(uni_flows(spark, sf)), "flows")
    model = train(flows, TrainParams(), version="check")
    return rounded(to_alerts(score_flows(flows, model), model.red, model.yellow, AS_OF), ["score"])
