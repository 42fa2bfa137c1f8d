import math

import pytest

from surveylens.operators import describe


def test_describe_golden(spark):
    df = spark.createDataFrame([(float(x),) for x in [5, 10, 15, 20, 27, 33, 40, 45]] + [(None,)],
                               "x double")
    r = describe.describe_numeric(df, ["x"]).collect()[0]
    assert r["count"] == 8 and r["missing"] == 1
    assert r["mean"] == 24.375
    assert r["std"] == pytest.approx(14.342120783602004, rel=1e-12)
    assert (r["min"], r["q25"], r["q50"], r["q75"], r["max"]) == (5, 13.75, 23.5, 34.75, 45)


def test_pairwise_correlation(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 4.0), (3.0, 7.0), (None, 1.0)], "a double, b double")
    out = {(r.var_a, r.var_b): r.r for r in describe.correlation_matrix(df, ["a", "b"]).collect()}
    assert out[("a", "b")] == pytest.approx(0.9933992677987827, rel=1e-12)
    assert out[("b", "a")] == out[("a", "b")]
    assert out[("a", "a")] == 1.0


def test_histogram_last_bin_closed(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (4.0,)], "x double")
    out = describe.histogram(df, "x", bins=3).orderBy("bin").collect()
    assert [r.n for r in out] == [1, 1, 2]
    assert [round(r.lo, 9) for r in out] == [1.0, 2.0, 3.0]


def test_value_counts_null_level(spark):
    df = spark.createDataFrame([("a",), ("a",), (None,), ("b",)], "c string")
    out = {r.value: (r.n, r.proportion) for r in describe.value_counts(df).collect()}
    assert out == {"a": (2, 0.5), None: (1, 0.25), "b": (1, 0.25)}


def test_nonresponse(spark):
    df = spark.createDataFrame([("No response", "x"), ("a", "No response"), ("b", None),
                                (None, "y")], "g string, h string")
    out = describe.nonresponse_table(df, ["g", "h", "missing"]).collect()
    assert [(r.variable, r.n_total, r.n_no_response) for r in out] == [("g", 3, 1), ("h", 3, 1)]
    assert out[0].pct_no_response == pytest.approx(100 / 3)


def test_box_stats(spark):
    df = spark.createDataFrame([(float(v), "m" if v % 2 else "f", "No response" if v == 9 else "x")
                                for v in range(1, 11)], "y double, g string, h string")
    out = {(r.factor, r.level): r for r in describe.box_stats(df, ["g", "h"], "y").collect()}
    assert set(out) == {("g", "m"), ("g", "f"), ("h", "x")}
    m = out[("g", "m")]
    assert (m["count"], m["min"], m["q1"], m["median"], m["q3"], m["max"]) == (5, 1, 3, 5, 7, 9)
    assert out[("h", "x")]["count"] == 9


def test_density_integrates_to_one(spark):
    df = spark.createDataFrame([(float(x),) for x in [1, 2, 2, 3, 5, 8]], "x double")
    out = describe.density_curve(df, "x", grid=400, bandwidth=1.0, lo=-6, hi=15).collect()
    step = 21 / 399
    assert sum(r.density for r in out) * step == pytest.approx(1.0, abs=1e-3)
    assert math.isfinite(out[0].x)


def test_correlation_many_columns_long_path(spark):
    import numpy as np
    rng = np.random.default_rng(4)
    data = rng.normal(size=(200, 9))
    data[:, 1] += data[:, 0]
    cols = [f"v{i}" for i in range(9)]
    df = spark.createDataFrame([tuple(map(float, r)) for r in data], ", ".join(f"{c} double" for c in cols))
    out = {(r.var_a, r.var_b): r.r for r in describe.correlation_matrix(df, cols).collect()}
    ref = np.corrcoef(data.T)
    assert len(out) == 81
    for i in range(9):
        for j in range(9):
            assert out[(cols[i], cols[j])] == pytest.approx(ref[i, j], rel=1e-9, abs=1e-12)
