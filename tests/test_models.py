import numpy as np
import pytest

from surveylens.operators import models, scale


def _linear_frame(spark, n=300, noise=0.0, seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        s, d = float(rng.normal()), float(rng.normal())
        g = ["Female", "Male", "Other"][i % 3]
        y = 1.0 + 0.6 * s + 0.9 * d + (0.5 if g == "Male" else 0.0) + noise * float(rng.normal())
        rows.append((i, y, s, d, g))
    return spark.createDataFrame(rows, "id long, y double, s double, d double, g string")


def test_ols_recovers_coefficients(spark):
    res = models.ols(_linear_frame(spark), "y", ["s", "d"], ["g"])
    coef = {r.term: r.coef for r in res.coefficients.collect()}
    assert coef["Intercept"] == pytest.approx(1.0, abs=1e-8)
    assert coef["s"] == pytest.approx(0.6, abs=1e-8)
    assert coef["d"] == pytest.approx(0.9, abs=1e-8)
    assert coef["g[T.Male]"] == pytest.approx(0.5, abs=1e-8)
    assert coef["g[T.Other]"] == pytest.approx(0.0, abs=1e-8)
    assert res.nobs == 300


def test_ols_closed_form_two_predictors(spark):
    df = _linear_frame(spark, noise=0.3, seed=4)
    pdf = df.toPandas()
    X = np.column_stack([np.ones(len(pdf)), pdf.s, pdf.d])
    beta = np.linalg.lstsq(X, pdf.y, rcond=None)[0]
    res = models.ols(df, "y", ["s", "d"])
    coef = {r.term: r for r in res.coefficients.collect()}
    assert [coef[t].coef for t in ("Intercept", "s", "d")] == pytest.approx(list(beta), rel=1e-8)
    resid = pdf.y - X @ beta
    sigma2 = (resid ** 2).sum() / (len(pdf) - 3)
    se = np.sqrt(np.diag(sigma2 * np.linalg.inv(X.T @ X)))
    assert coef["s"].se == pytest.approx(se[1], rel=1e-6)
    assert coef["s"].ci_lower < coef["s"].coef < coef["s"].ci_upper
    summary = models.coef_summary(res.coefficients)
    assert summary.columns == ["term", "coef", "ci_lower", "ci_upper"]
    assert "Intercept" not in {r.term for r in summary.collect()}


def test_hash_split_partition_invariant(spark):
    df = spark.range(5000).withColumnRenamed("id", "k")
    a = {r.k for r in models.hash_split(df.repartition(1), ["k"]).where("is_test").collect()}
    b = {r.k for r in models.hash_split(df.repartition(17), ["k"]).where("is_test").collect()}
    assert a == b and 800 < len(a) < 1200


def test_weights_inverse_frequency(spark):
    df = spark.createDataFrame([("a",), ("a",), ("a",), ("b",), (None,)], "g string")
    out = sorted((r.g or "", r.weight) for r in scale.inverse_frequency_weights(df, "g").collect())
    assert out == [("", 1.0), ("a", 4 / 3), ("a", 4 / 3), ("a", 4 / 3), ("b", 4.0)]
    assert scale.inverse_frequency_weights(df, "absent").first().weight == 1.0


def test_one_hot_drop_first(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",), (None,)], "g string")
    out = scale.one_hot(df, ["g"])
    assert out.columns == ["g_b", "g_c"]
    assert sorted(tuple(r) for r in out.collect()) == [(0, 0), (0, 0), (0, 1), (1, 0)]


def test_standardize_population_std(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (3.0, 5.0)], "a double, c double")
    out = scale.standardize(df, ["a", "c", "absent"]).orderBy("a").collect()
    assert [round(r.a_std, 12) for r in out] == [round(-1 / np.sqrt(2 / 3), 12), 0.0,
                                                 round(1 / np.sqrt(2 / 3), 12)]
    assert [r.c_std for r in out] == [0.0, 0.0, 0.0]


def test_three_models_and_importances(spark):
    df = _linear_frame(spark, noise=0.5, seed=9).withColumnRenamed("g", "gender_clean")
    design, train, test = models.model_inputs(df, "y", ["s", "d"], ["gender_clean"], key=["id"])
    _, lin = models.fit_linear(train, test)
    rf_model, rf = models.fit_random_forest(train, test, num_trees=10, max_depth=5)
    _, gb = models.fit_gbt(train, test, max_iter=10)
    for p in (lin, rf, gb):
        assert p.r2_test > 0
    imp = models.importances(rf_model, design.feature_names, spark).collect()
    assert sum(r.importance for r in imp) == pytest.approx(1.0, abs=1e-6)
    assert all(r.importance >= 0 for r in imp)
    assert [r.importance for r in imp] == sorted([r.importance for r in imp], reverse=True)


def test_importance_plot_data(spark):
    imp = spark.createDataFrame([("a", 0.5), ("b", 0.3), ("c", 0.2)], "feature string, importance double")
    out = [r.feature for r in models.importance_plot_data(imp, 2).collect()]
    assert out == ["b", "a"]


def test_model_weights_use_filtered_rows(spark):
    rows = [(i, float(i), float(i % 5), "Male" if i % 4 else "Female") for i in range(40)]
    rows += [(100 + i, 1.0, 1.0, "No response") for i in range(10)]
    rows += [(200, 1.0, None, "Male")]
    df = spark.createDataFrame(rows, "id long, y double, x double, gender_clean string")
    design, train, test = models.model_inputs(df, "y", ["x"], ["gender_clean"], key=["id"])
    w = {r.id: r.weight for r in design.frame.select("id", "weight").collect()}
    assert len(w) == 40                      # "No response" and the null-x row are gone
    assert w[1] == 40 / 30 and w[0] == 40 / 10


def test_boosting_learns_from_cells_what_it_learns_from_rows(spark):
    """Rows of equal features go as one, with their number and mean: the same trees as of MLlib on the rows."""
    from pyspark.ml.regression import GBTRegressor
    df = spark.range(4000).selectExpr("id", "cast(id * 7 % 10 as double) AS a", "cast(id * 3 % 8 as double) AS b").selectExpr(
        "*", "a * 2 + b * b + sin(id) AS y")
    frame = models.design_frame(df, "y", ["a", "b"], []).frame
    cells = models.feature_cells(frame)
    assert cells.count() == frame.distinct().select("features").distinct().count() < 100
    assert cells.agg({"weight": "sum"}).first()[0] == 4000 and cells.rdd.getNumPartitions() == 1
    cells.unpersist()
    model, perf = models.fit_gbt(frame, frame, max_iter=5)
    plain = GBTRegressor(maxIter=5, stepSize=0.1, maxDepth=3, maxBins=64, seed=42).fit(frame)
    want = plain.transform(frame).selectExpr("features", "prediction AS p")
    got = model.transform(frame).join(want.distinct(), "features")
    assert got.selectExpr("max(abs(prediction - p))").first()[0] < 1e-6


def test_cells_in_partitions_of_bounded_size(spark, monkeypatch):
    """However few the files, a task of a boosting round goes over ``CELL_ROWS`` rows at most."""
    monkeypatch.setattr(models, "CELL_ROWS", 300)
    df = spark.range(0, 3000, 1, 1).selectExpr("cast(id as double) AS a", "cast(id % 7 as double) AS y")
    cells = models.feature_cells(models.design_frame(df, "y", ["a"], []).frame)
    sizes = cells.rdd.glom().map(len).collect()
    assert sum(sizes) == 3000 and len(sizes) >= 10 and max(sizes) <= 400
    cells.unpersist()
