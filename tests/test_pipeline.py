import os

import pytest
from pyspark.sql import functions as F

from surveylens.functions import presets as P
from surveylens.operators import models
from surveylens.plans import survey_run
from surveylens.sources.countries import country_dimension

from .survey_fixture import AS_OF_YEAR, iso_dim, raw_frame


def test_clean_bundle(spark):
    raw = raw_frame(spark)
    b = survey_run.clean_survey(raw, AS_OF_YEAR, iso_dim(spark))
    n_clean, n_valid = b.clean_df.count(), b.clean_valid_df.count()
    n_an, n_std = b.analysis_df.count(), b.analysis_standardized_df.count()
    assert raw.count() > n_clean >= n_valid == n_an == n_std > 0
    # sparse free-text column removed, its neighbour's nulls removed rows
    assert "free_text" not in b.clean_df.columns
    assert "Upset by trivial things" in b.clean_df.columns
    assert set(b.analysis_df.columns) <= {*P.ANALYSIS_COLUMNS, "row_id"}
    assert {"dassanxiety", "Emotional Stability", "continent", "vcl_valid"} <= set(b.analysis_df.columns)
    assert "dassanxiety_std" in b.analysis_standardized_df.columns
    assert b.analysis_df.where("vcl_valid = false").count() == 0
    assert b.analysis_df.where("age_clean < 10 OR age_clean > 100").count() == 0
    conts = {r.continent for r in b.analysis_df.select("continent").distinct().collect()}
    assert "Unknown" in conts and "Africa" in conts  # NONE/ZZ unknown, NA = Namibia kept


def test_core_tables_and_publish(spark, tmp_out):
    b = survey_run.clean_survey(raw_frame(spark, n=300, seed=11), AS_OF_YEAR, iso_dim(spark))
    tables = survey_run.core_tables(b, rf_trees=5, rf_depth=4, gbt_iter=5)
    expected = {"anxiety_severity_summary", "anxiety_severity_by_gender_counts",
                "anxiety_severity_by_gender_percent", "anxiety_severity_by_agegroup_counts",
                "anxiety_severity_by_agegroup_percent", "mean_anxiety_by_continent",
                "top10_mean_anxiety_by_country", "top10_countries_by_participants",
                "anova_demographics_summary", "anova_personality_summary",
                "rf_feature_importances", "model_comparison"}
    assert expected == set(tables)
    sev = tables["anxiety_severity_summary"].collect()
    assert sum(r.n for r in sev) <= b.analysis_df.count()
    ages = tables["anxiety_severity_by_agegroup_counts"].collect()
    assert {r.age_group for r in ages} == set(P.AGE_LABELS)
    assert tables["model_comparison"].count() == 3
    paths = survey_run.export_all_core_tables(b, tmp_out, with_models=False)
    assert os.path.isdir(paths["anxiety_severity_summary"])
    assert os.path.isdir(paths["analysis_df"])
    assert spark.read.parquet(paths["analysis_df"]).count() == b.analysis_df.count()


def test_regression_models(spark):
    b = survey_run.clean_survey(raw_frame(spark, n=300, seed=5), AS_OF_YEAR, iso_dim(spark))
    res = survey_run.regression_models(b.analysis_standardized_df)
    assert set(res) == {"psychological", "demographic_psych", "full"}
    terms = [r.term for r in res["full"].coefficients.collect()]
    assert "Emotional Stability" in terms and any(t.startswith("gender_clean[T.") for t in terms)
    assert res["psychological"].coefficients.count() == 3


def test_severity_by_trait(spark):
    b = survey_run.clean_survey(raw_frame(spark, n=200, seed=2), AS_OF_YEAR, iso_dim(spark))
    out = survey_run.severity_by_trait(b.analysis_df, ["Extraversion", "Openness"])
    assert set(out) == {"anxiety_severity_by_extraversion_counts",
                        "anxiety_severity_by_extraversion_percent",
                        "anxiety_severity_by_openness_counts", "anxiety_severity_by_openness_percent"}
    rows = out["anxiety_severity_by_extraversion_counts"].collect()
    assert {r["Extraversion_group"] for r in rows} == {"Low", "Medium", "High"}
    total = sum(sum(v for k, v in r.asDict().items() if k != "Extraversion_group") for r in rows)
    assert total == b.analysis_df.where("dassanxiety BETWEEN 0 AND 56").count()


def test_staged_analysis_table(spark, tmp_out):
    import os
    raw = raw_frame(spark, n=150, seed=8)
    a = survey_run.clean_survey(raw, AS_OF_YEAR, iso_dim(spark))
    b = survey_run.clean_survey(raw, AS_OF_YEAR, iso_dim(spark),
                                stage_to=os.path.join(tmp_out, "analysis"))
    cols = sorted(a.analysis_df.columns)
    assert sorted(b.analysis_df.columns) == cols
    key = lambda r: tuple(map(repr, r))
    assert sorted(map(key, a.analysis_df.select(*[f"`{c}`" for c in cols]).collect())) == \
        sorted(map(key, b.analysis_df.select(*[f"`{c}`" for c in cols]).collect()))


def test_countries_without_a_given_dimension(spark):
    b = survey_run.clean_survey(raw_frame(spark, n=120, seed=4), AS_OF_YEAR)
    assert {"country_name", "continent"} <= set(b.analysis_df.columns)
    assert "mean_anxiety_by_continent" in survey_run.geo_tables(b.analysis_df)
    dim = {r.alpha2: r for r in country_dimension(spark).collect()}
    assert (dim["NA"].alpha3, dim["NA"].name, dim["NA"].continent) == ("NAM", "Namibia", "Africa")
    assert (dim["KR"].name, dim["BR"].continent, dim["US"].alpha3) == ("Korea, Republic of", "South America", "USA")
    assert 240 < len(dim) < 260 and sum(r.continent is None for r in dim.values()) < 10
    with pytest.raises(ValueError, match="dimension"):
        survey_run.create_clean_df(raw_frame(spark, n=20, seed=4), AS_OF_YEAR, None)


def test_equal_rows_are_split_by_row(spark):
    rows = spark.createDataFrame([(1.0, 2.0, "a")] * 600, "y double, x double, g string")
    rows = rows.withColumn("row_id", F.monotonically_increasing_id())
    design, train, test = models.model_inputs(rows, "y", ["x"], [], weight_col=None)
    assert 80 < test.count() < 160
    design.frame.unpersist()
    with pytest.raises(ValueError, match="key"):
        models.model_inputs(rows.drop("row_id"), "y", ["x"], [], weight_col=None)


def test_run_all_from_csv(spark, tmp_out):
    import json
    raw = raw_frame(spark, n=250, seed=21)
    src = os.path.join(tmp_out, "raw.csv")
    raw.toPandas().to_csv(src, index=False, sep=";")
    iso = os.path.join(tmp_out, "iso.csv")
    with open(iso, "w") as fh:
        fh.write("alpha2,alpha3,name,continent\n")
        for r in __import__("tests.survey_fixture", fromlist=["ISO_ROWS"]).ISO_ROWS:
            fh.write(",".join("" if v is None else v for v in r) + "\n")
    world = os.path.join(tmp_out, "world.geojson")
    with open(world, "w") as fh:
        json.dump({"type": "FeatureCollection", "features": [
            {"type": "Feature", "properties": {"ISO_A3": "USA"}, "geometry": None},
            {"type": "Feature", "properties": {"ISO_A3": "FRA"}, "geometry": None}]}, fh)
    paths = survey_run.run_all(spark, src, os.path.join(tmp_out, "out"), AS_OF_YEAR, iso, world,
                               rf_trees=5, rf_depth=4)
    for name in ("anxiety_histogram", "anxiety_box_by_demographic", "anxiety_box_by_trait_tertile",
                 "severity_crosstab_gender", "severity_crosstab_agegroup",
                 "tipi_dass_correlation", "forest_plot_coefficients", "rf_importances_top15",
                 "choropleth", "nonresponse", "model_comparison", "analysis_df"):
        assert os.path.isdir(paths[name]), name
    hist = spark.read.option("header", True).csv(paths["anxiety_histogram"])
    assert hist.count() == 43
    corr = spark.read.option("header", True).csv(paths["tipi_dass_correlation"])
    assert corr.count() == 81
