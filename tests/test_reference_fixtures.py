"""The small frames the source test-suite uses (FIXTURES.md §3), run through our operators."""

import pytest

from surveylens.functions import presets as P
from surveylens.operators import anova, bins, crosstab, describe, geo, models
from surveylens.plans import survey_run

LABELS = {
    "gender_clean": ["Male", "Female", "Other"],
    "orientation_clean": ["Heterosexual", "Bisexual", "Homosexual"],
    "married_clean": ["Never married", "Currently married", "Previously married"],
    "urban_clean": ["Rural", "Suburban", "Urban"],
    "race_clean": ["Asian", "White", "Other"],
    "education_clean": ["High school", "University degree", "Graduate degree"],
    "religion_clean": ["Atheist", "Hindu", "Other"],
}


def _export_frame(spark):
    # three respondents: every level is a one-row group
    rows = []
    for i, y in enumerate([10.0, 20.0, 30.0]):
        r = [y] + [LABELS[c][i] for c in LABELS] + [15 + 20 * i] + [1.0 + 2 * i] * 5
        rows.append(tuple(r))
    schema = ("dassanxiety double, " + ", ".join(f"{c} string" for c in LABELS)
              + ", age_clean int, " + ", ".join(f"`{t}` double" for t in P.TRAITS))
    return spark.createDataFrame(rows, schema)


def test_export_tables_with_one_row_groups(spark):
    df = _export_frame(spark)
    tables = survey_run.anova_tables(df)
    demo = {r.factor: r for r in tables["anova_demographics_summary"].collect()}
    assert set(demo) == set(P.DEMOGRAPHIC_FACTORS)
    assert all(r.F is None and r.p_value is None for r in demo.values())
    assert tables["anova_personality_summary"].count() == 5
    sev = survey_run.severity_tables(df)
    assert {r.anxiety_severity: r.n for r in sev["anxiety_severity_summary"].collect()} == {
        "Normal": 1, "Mild": 0, "Moderate": 1, "Severe": 1, "Extremely Severe": 0}


def test_geography_fixture(spark):
    rows = [(5 * i + 3, c, "Europe") for i, c in
            enumerate(["France", "Germany", "France", "Italy", "Spain", "Spain", "Portugal", "France"])]
    df = spark.createDataFrame(rows, "dassanxiety int, country_name string, continent string")
    means = geo.mean_by(df, "country_name")
    assert means.count() == 5 and means.select("country_name").distinct().count() == 5
    dim = spark.createDataFrame([("France", "FRA"), ("Germany", "DEU"), ("Spain", "ESP")],
                                "name string, alpha3 string")
    coded = {r.country_name: r.iso_alpha_3 for r in geo.attach_codes(means, dim).collect()}
    assert coded["France"] == "FRA" and coded["Italy"] is None
    cont = geo.mean_by(df, "continent", with_count=True, count_out="count").collect()
    assert [(r.continent, r["count"]) for r in cont] == [("Europe", 8)]


def test_trait_tertiles_are_ordered_labels(spark):
    rows = [(float(y), float(t)) for y, t in zip(range(12), [1, 1.5, 2, 3, 3.5, 4, 4, 5, 5.5, 6, 7, 7])]
    df = spark.createDataFrame(rows, "dassanxiety double, Extraversion double")
    g = bins.quantile_groups(df, ["Extraversion"], ties="keep",
                             names={"Extraversion": "Extraversion_group"})
    labels = {r.Extraversion_group for r in g.collect()}
    assert labels <= {"Low", "Medium", "High"} and len(labels) == 3
    box = describe.box_stats(g, ["Extraversion_group"], "dassanxiety").collect()
    assert sum(r["count"] for r in box) == 12


def test_age_groups_non_null(spark):
    df = spark.createDataFrame([(a,) for a in [16, 22, 28, 35, 42, 55, 19, 31]], "age_clean int")
    assert bins.add_age_group(df).where("age_group IS NULL").count() == 0


def test_nonresponse_fixture(spark):
    rows = [tuple("No response" if (i + j) % 4 == 0 else "x" for j in range(13)) for i in range(4)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in P.NONRESPONSE_VARIABLES))
    out = describe.nonresponse_table(df).collect()
    assert len(out) == 13 and all(r.pct_no_response == 25.0 for r in out)


def test_regression_fixture_terms(spark):
    import numpy as np
    rng = np.random.default_rng(0)
    rows = []
    for i in range(120):
        s, d = float(rng.normal()), float(rng.normal())
        pick = lambda opts: opts[int(rng.integers(0, len(opts)))]
        rows.append((0.5 * s + 0.8 * d + float(rng.normal(scale=0.1)), s, d,
                     pick(["Male", "Female"]), pick(["High school", "Graduate degree"]),
                     pick(["Rural", "Urban"]), pick(["Never married", "Currently married"]),
                     pick(["Atheist", "Hindu", "Other"]), pick(["Asian", "White"]),
                     *[float(rng.integers(1, 8)) for _ in range(5)]))
    schema = ("dassanxiety double, dassstress double, dassdepression double, gender_clean string, "
              "education_clean string, urban_clean string, married_clean string, "
              "religion_clean string, race_clean string, "
              + ", ".join(f"`{t}` double" for t in P.TRAITS))
    df = spark.createDataFrame(rows, schema)
    res = survey_run.regression_models(df)
    assert res["psychological"].nobs == 120
    assert res["demographic_psych"].coefficients.count() > 3
    assert res["full"].coefficients.count() > 5
    summary = models.coef_summary(res["full"].coefficients)
    assert set(summary.columns) == {"term", "coef", "ci_lower", "ci_upper"}
    cx = crosstab.band_distribution(df, "dassanxiety", P.SEVERITY_EDGES, P.SEVERITY_LABELS)
    assert cx.count() == 5
    a, _ = anova.one_way_anova(df, "dassanxiety", ["gender_clean"])
    by_gender = {}
    for r in df.select("gender_clean", "dassanxiety").collect():
        by_gender.setdefault(r.gender_clean, []).append(r.dassanxiety)
    groups = [np.array(v) for v in by_gender.values()]
    grand = np.concatenate(groups).mean()
    ssb = sum(len(g) * (g.mean() - grand) ** 2 for g in groups)
    ssw = sum(((g - g.mean()) ** 2).sum() for g in groups)
    assert a.first().f == pytest.approx(ssb / (len(groups) - 1) / (ssw / (120 - len(groups))))


def test_collinear_design_is_fitted(spark):
    """Two factors that say the same: the shortest solution gives each half of what one alone has."""
    rows = [(float(i), float(i % 3), "a" if i % 2 else "b", "x" if i % 2 else "y") for i in range(30)]
    df = spark.createDataFrame(rows, "y double, s double, g string, h string")
    both = {r.term: r.coef for r in models.ols(df, "y", ["s"], ["g", "h"]).coefficients.collect()}
    one = {r.term: r.coef for r in models.ols(df, "y", ["s"], ["g"]).coefficients.collect()}
    assert abs(both["g[T.b]"] - one["g[T.b]"] / 2) < 1e-9 and abs(both["h[T.y]"] - both["g[T.b]"]) < 1e-9
    assert abs(both["s"] - one["s"]) < 1e-9 and abs(both["Intercept"] - one["Intercept"]) < 1e-9

