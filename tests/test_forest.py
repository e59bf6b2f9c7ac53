import math

import numpy as np
import pandas as pd
import pytest

from flowtide.operators.features import fit_scaler, inject_outliers, scale_features, select_features
from flowtide.operators.forest import Forest, average_path, fit_forest, forest_nodes, grow_tree, score_rows, tree_samples
from flowtide.schemas import feature_columns, present_features

COLUMNS = ["a", "b"]


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(2)
    frame = pd.DataFrame({"id": range(4000), "a": rng.normal(size=4000), "b": rng.normal(size=4000)})
    frame.loc[0, COLUMNS] = [9.0, -9.0]
    frame.loc[1, COLUMNS] = [0.0, 0.0]
    return spark.createDataFrame(frame).cache()


def test_average_path():
    assert average_path([0, 1, 2]).tolist() == [0.0, 0.0, 1.0]
    assert float(average_path(256)) == pytest.approx(2 * (math.log(255) + 0.5772156649) - 2 * 255 / 256)


def plain_score(nodes, point, sample):
    total = 0.0
    for _, tree in nodes.groupby("tree"):
        by = tree.set_index("node")
        n = by.loc[0]
        while n.feature >= 0:
            n = by.loc[int(n.left if point[int(n.feature)] <= n.threshold else n.right)]
        total += n.depth + float(average_path(n["size"]))
    return -(2 ** (-total / nodes["tree"].nunique() / float(average_path(sample))))


def test_walk_equals_a_plain_walk(cloud):
    forest = fit_forest(cloud, COLUMNS, trees=15, key=["id"])
    points = np.random.default_rng(3).normal(size=(40, 2)) * 3
    want = [plain_score(forest.nodes, p, forest.sample) for p in points]
    assert forest.score(points).tolist() == pytest.approx(want, rel=1e-12)


def test_scores_order_and_bounds(cloud):
    forest = fit_forest(cloud, COLUMNS, trees=60, key=["id"])
    scores = {r.id: r.raw_score for r in score_rows(cloud, forest).collect()}
    assert len(scores) == 4000 and all(-1 < s < 0 for s in scores.values())
    assert scores[0] == min(scores.values()) and scores[0] < scores[1] - 0.2


def test_same_seed_same_trees_in_any_partitioning(cloud):
    a = fit_forest(cloud, COLUMNS, trees=12, key=["id"]).nodes
    b = fit_forest(cloud.repartition(11), COLUMNS, trees=12, key=["id"]).nodes
    c = fit_forest(cloud, COLUMNS, trees=12, key=["id"], seed=7).nodes
    order = ["tree", "node"]
    same = [d.sort_values(order).reset_index(drop=True) for d in (a, b, c)]
    pd.testing.assert_frame_equal(same[0], same[1])
    assert not same[0].equals(same[2])


@pytest.mark.parametrize("rows", [1, 2, 5, 100, 256, 257, 900])
def test_small_inputs(cloud, rows):
    part = cloud.where(f"id < {rows}")
    forest = fit_forest(part, COLUMNS, trees=10, key=["id"])
    roots = forest.nodes[forest.nodes.node == 0]
    assert len(roots) == 10 and set(roots["size"]) == {min(256, rows)}
    assert forest.nodes.depth.max() <= max(1, math.ceil(math.log2(max(min(256, rows), 2))))


def test_draws_are_uniform_and_bounded(cloud):
    """Each tree draws about factor * sample rows, a row at most once per tree, and all rows are as likely."""
    draws = tree_samples(cloud.selectExpr("*", "id AS row"), [*COLUMNS, "row"], 4000, 200, 256, 42, ["id"], 1.5).toPandas()
    sizes = draws.groupby("tree").size()
    assert len(sizes) == 200 and sizes.min() > 256 and sizes.max() < 600
    assert not draws.duplicated(["tree", "row"]).any()
    per_row = draws.groupby("row").size().reindex(range(4000), fill_value=0)
    assert abs(per_row.mean() - 19.2) < 1 and per_row.max() <= 21


def test_sampling_of_many_rows(spark):
    wide = spark.range(400_000).selectExpr("id", "cast(id % 97 as double) a", "cast(id % 89 as double) b")
    sizes = tree_samples(wide, COLUMNS, 400_000, 200, 256, 42, ["id"], 1.5).groupBy("tree").count().toPandas()["count"]
    assert len(sizes) == 200 and sizes.min() >= 256 and sizes.max() < 600


def test_copies_without_a_key_are_told_apart(spark):
    """Half of the rows are equal; the sample holds its fair part of them."""
    table = spark.range(20_000).selectExpr("cast(if(id % 2 = 0, 1, id) as double) a", "cast(if(id % 2 = 0, 1, id) as double) b")
    draws = tree_samples(table, COLUMNS, 20_000, 50, 256, 1, None, 1.5).toPandas()
    assert 0.45 < (draws.a == 1).mean() < 0.55
    assert fit_forest(table, COLUMNS, trees=5).nodes.tree.nunique() == 5


def test_a_wrong_row_count_is_an_error(spark):
    table = spark.range(1000).selectExpr("id", "cast(id as double) a", "cast(id as double) b")
    with pytest.raises(ValueError):
        fit_forest(table, COLUMNS, trees=5, sample=2000, key=["id"], rows=20_000)


def test_constant_columns_make_a_single_leaf():
    nodes = grow_tree(np.ones((30, 3)), 8, np.random.default_rng(0))
    assert nodes == [(0, -1, 0.0, -1, -1, 30, 0)]
    forest = Forest.from_nodes(pd.DataFrame([(0, *nodes[0])], columns=["tree", "node", "feature", "threshold", "left", "right", "size", "depth"]), COLUMNS, 30)
    assert forest.score(np.zeros((2, 2))).tolist() == pytest.approx([-0.5, -0.5])


def test_leaves_hold_all_rows(cloud):
    nodes = forest_nodes(cloud, COLUMNS, 4000, trees=20, key=["id"]).toPandas()
    assert (nodes[nodes.feature < 0].groupby("tree")["size"].sum() == 256).all()


def test_scoring_plan_has_no_shuffle(cloud):
    plan = score_rows(cloud, fit_forest(cloud, COLUMNS, trees=3, key=["id"]))._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "Exchange" not in plan


def test_scaler_and_missing_values(spark):
    table = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (4.0, None), (float("nan"), float("inf"))], "a double, b double")
    clean = select_features(table, COLUMNS)
    assert [tuple(r) for r in clean.collect()] == [(1, 5), (2, 5), (4, 0), (0, 0)]
    scaler = fit_scaler(clean.where("b = 5"), COLUMNS)
    assert scaler.mean == [1.5, 5.0] and scaler.scale == [0.5, 1.0]
    assert [tuple(r) for r in scale_features(clean, scaler).collect()][0] == (-1.0, 0.0)
    with pytest.raises(ValueError):
        select_features(table, ["a", "c"])


def test_inject_outliers(cloud):
    out = inject_outliers(cloud, COLUMNS, ratio=0.01).toPandas()
    new = out[out.outlier_id.notna()]
    assert len(new) == 40 and new.id.isna().all() and len(out) == 4040
    old = cloud.toPandas()
    for c in COLUMNS:
        lo, hi = old[c].quantile([0.05, 0.95])
        assert new[c].between(hi, hi + 5 * (hi - lo)).all()
    assert inject_outliers(cloud, COLUMNS, ratio=0).count() == 4000
    assert inject_outliers(cloud.limit(0), COLUMNS).count() == 0
    assert inject_outliers(cloud.limit(3), COLUMNS).count() == 4


def test_feature_lists():
    assert len(feature_columns("extended")) == 12 and len(feature_columns("minimal")) == 5
    assert feature_columns("unheard of") == feature_columns("minimal")
    assert present_features(["iat_std", "x", "tcp_syn_count"]) == feature_columns("minimal") + ["tcp_syn_count", "iat_std"]
