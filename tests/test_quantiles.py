import numpy as np
import pytest

from surveylens.operators import quantiles as Q
from surveylens.operators.quantiles import exact_quantiles

PROBS = {"q0": 0.0, "q13": 1 / 3, "q25": 0.25, "q50": 0.5, "q67": 2 / 3, "q100": 1.0}


def _frame(spark, groups, parts):
    rows = [(g, float(v)) for g, vals in groups.items() for v in vals]
    return spark.createDataFrame(rows, "g string, v double").repartition(parts)


@pytest.mark.parametrize("method", ["exact", "countmap"])
@pytest.mark.parametrize("parts", [1, 4, 17])
def test_matches_numpy_linear(spark, method, parts):
    rng = np.random.default_rng(3)
    groups = {"a": rng.normal(size=301).round(3), "b": rng.integers(0, 5, size=57),
              "c": [7.0], "hot": rng.exponential(size=900).round(4)}
    out = {r.g: r for r in exact_quantiles(_frame(spark, groups, parts), "v", PROBS, by=["g"],
                                           method=method).collect()}
    assert set(out) == set(groups)
    for g, vals in groups.items():
        for name, p in PROBS.items():
            assert out[g][name] == pytest.approx(float(np.quantile(vals, p)), rel=1e-12, abs=1e-12)


def test_global_and_nulls(spark):
    df = spark.createDataFrame([(1.0,), (None,), (3.0,), (float("nan"),), (2.0,), (4.0,)], "v double")
    r = exact_quantiles(df, "v", {"m": 0.5, "q": 0.25}).collect()[0]
    assert r.m == 2.5 and r.q == 1.75


def test_tertiles_of_1_to_6(spark):
    df = spark.createDataFrame([(float(x),) for x in range(1, 7)], "v double")
    r = exact_quantiles(df, "v", {"a": 1 / 3, "b": 2 / 3}).collect()[0]
    assert r.a == pytest.approx(2 + 2 / 3) and r.b == pytest.approx(4 + 1 / 3)


def test_more_groups_and_values_than_parts(spark, monkeypatch):
    # every interval needs several passes, and no number of groups is special
    monkeypatch.setattr(Q, "BUCKETS", 3)
    monkeypatch.setattr(Q, "HELD_ROWS", 5)
    rng = np.random.default_rng(5)
    groups = {f"g{i}": rng.normal(size=1 + i % 7) for i in range(40)} | {"wide": rng.normal(size=200)}
    out = {r.g: r for r in exact_quantiles(_frame(spark, groups, 3), "v", PROBS, by=["g"]).collect()}
    assert set(out) == set(groups)
    for g, vals in groups.items():
        for name, p in PROBS.items():
            assert out[g][name] == pytest.approx(float(np.quantile(vals, p)), rel=1e-12, abs=1e-12)


def test_hot_value_is_exact(spark):
    # one value holds 40 % of the rows of a continuous group
    rng = np.random.default_rng(11)
    vals = np.concatenate([np.zeros(4000), rng.normal(size=6000)])
    df = spark.createDataFrame([("g", float(v)) for v in vals], "g string, v double").repartition(6)
    out = exact_quantiles(df, "v", PROBS, by=["g"]).collect()[0]
    for name, p in PROBS.items():
        assert out[name] == pytest.approx(float(np.quantile(vals, p)), rel=1e-12, abs=1e-12)


def test_long_tails_and_infinities(spark):
    vals = [float("-inf"), -1e308, -3.0, 0.0, 1e-300, 2e-300, 5.0, 6.0, 1e300, 1e308, float("inf")]
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    probs = {f"r{i}": i / 10 for i in range(11)}
    r = exact_quantiles(df, "v", probs).collect()[0]
    assert [r[f"r{i}"] for i in range(11)] == vals


def test_approx_route_is_close(spark):
    rng = np.random.default_rng(8)
    vals = rng.normal(size=2000)
    df = spark.createDataFrame([(float(v),) for v in vals], "v double")
    r = exact_quantiles(df, "v", {"m": 0.5}, method="approx").collect()[0]
    assert abs(r.m - float(np.median(vals))) < 0.05
    with pytest.raises(ValueError):
        exact_quantiles(df, "v", {"m": 0.5}, method="bogus")


def test_null_group_key(spark):
    rows = [(None, float(i % 3)) for i in range(30)] + [("w", float(i)) for i in range(50)]
    df = spark.createDataFrame(rows, "g string, v double")
    out = {r.g: r.m for r in exact_quantiles(df, "v", {"m": 0.5}, by=["g"]).collect()}
    assert out == {None: 1.0, "w": 24.5}
