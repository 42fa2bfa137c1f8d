"""Public helpers not used by the registered queries."""

import pytest

from surveylens.operators import bins, clean, describe, models, scale


def test_recode_with_dimension(spark):
    df = spark.createDataFrame([(1,), (2,), (9,), (None,)], "code int")
    dim = spark.createDataFrame([(1, "one"), (2, "two")], "k int, label string")
    out = {r.code: r.lab for r in clean.recode_with_dimension(df, "code", dim, "k", "label", "lab").collect()}
    assert out == {1: "one", 2: "two", 9: None, None: None}


def test_keep_in_range_and_drop_rows(spark):
    df = spark.createDataFrame([(1.0, 2.0), (0.5, 3.0), (None, 4.0), (7.0, 7.0)], "a double, b double")
    assert clean.keep_in_range(df, ["a", "b", "absent"], 1, 7).count() == 2
    assert clean.drop_rows_with_nulls(df, ["a"]).count() == 3
    assert clean.drop_rows_with_nulls(df).count() == 3


def test_full_summary_and_casts(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "a")], "x int, s string")
    out = describe.full_summary(df, normalize=True)
    assert set(out) == {"numeric_summary", "categorical_counts", "categorical_proportions"}
    assert out["numeric_summary"].first()["q50"] == 2.0
    props = {r.value: r.proportion for r in out["categorical_proportions"].collect()}
    assert props == {"a": pytest.approx(2 / 3), None: pytest.approx(1 / 3)}
    assert dict(scale.to_double(df, ["x"]).dtypes)["x"] == "double"
    sev = bins.add_severity(spark.createDataFrame([(13,), (15,)], "dassanxiety int"))
    assert [r.anxiety_severity for r in sev.collect()] == ["Normal", "Mild"]


def test_compare_models_and_metrics(spark):
    rows = [(i, float(i % 7), float(i % 5), "a" if i % 2 else "b",
             2.0 * (i % 7) - (i % 5) + (0.1 if i % 3 else -0.1)) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, x1 double, x2 double, gender_clean string, y double")
    comp = models.compare_models(df, rf_trees=5, rf_depth=4, target="y", numeric=["x1", "x2"],
                                 categorical=["gender_clean"], key=["id"])
    names = [r.name for r in comp.models.collect()]
    assert names == ["Linear Regression", "Random Forest", "Gradient Boosting"]
    design = models.design_frame(df, "y", ["x1", "x2"], [])
    m = models.LinearRegression(solver="normal").fit(design.frame)
    one = models.metrics_frame(m.transform(design.frame)).first()
    assert one.n == 200 and one.r2 == pytest.approx(m.summary.r2)
    assert one.rmse == pytest.approx(m.summary.rootMeanSquaredError)
