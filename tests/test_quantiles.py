import numpy as np
import pytest

from flowtide.operators.quantiles import exact_quantiles

PS = [0.0, 0.005, 0.01, 0.05, 0.31, 0.5, 0.95, 0.999, 1.0]


def columns():
    rng = np.random.default_rng(1)
    n = 30_000
    hot = rng.normal(size=n)
    hot[: n // 3] = 0.25
    return {
        "normal": rng.normal(size=n),
        "heavy_tail": np.exp(rng.normal(size=n) * 6),
        "third_is_one_value": hot,
        "constant": np.full(n, 4.0),
        "two_values": (rng.random(n) < 0.05).astype(float),
        "integers": rng.integers(0, 50, n).astype(float),
        "almost_all_same": np.where(np.arange(n) < 3, np.arange(n) - 10.0, 7.0),
    }


@pytest.fixture(scope="module")
def table(spark):
    import pandas as pd

    return spark.createDataFrame(pd.DataFrame(columns())).repartition(6).cache()


@pytest.mark.parametrize("limits", [{}, {"direct_rows": 10, "bracket_rows": 500}, {"direct_rows": 10, "bracket_rows": 1}])
def test_equals_numpy(table, limits):
    data = columns()
    got = exact_quantiles(table, {c: PS for c in data}, **limits)
    for c, values in data.items():
        assert got[c] == pytest.approx(list(np.quantile(values, PS)), rel=1e-12, abs=1e-12), c


def test_nulls_and_nothing(spark):
    table = spark.createDataFrame([(1.0, None), (None, None), (3.0, None)], "a double, b double")
    for limits in ({}, {"direct_rows": 0, "bracket_rows": 1}):
        assert exact_quantiles(table, {"a": [0.5], "b": [0.5]}, **limits) == {"a": [2.0], "b": [None]}
