from surveylens.functions import presets as P
from surveylens.operators import crosstab


def _dist(spark):
    rows = list(zip([5, 10, 15, 20, 27, 33, 40, 45],
                    ["Male", "Female", "Male", "Female", "Male", "Female", "Male", "Male"],
                    [16, 22, 28, 35, 42, 55, 19, 31]))
    return spark.createDataFrame(rows, "dassanxiety int, gender_clean string, age_clean int")


def test_severity_counts_golden(spark):
    out = crosstab.band_distribution(_dist(spark), "dassanxiety", P.SEVERITY_EDGES,
                                     P.SEVERITY_LABELS, band="sev", digits=2).collect()
    assert [(r.sev, r.n) for r in out] == [("Normal", 2), ("Mild", 1), ("Moderate", 1),
                                           ("Severe", 2), ("Extremely Severe", 2)]
    assert [r.pct for r in out] == [25.0, 12.5, 12.5, 25.0, 25.0]


def test_unbinned_rows_stay_in_denominator(spark):
    df = spark.createDataFrame([(5,), (60,), (None,), (20,)], "dassanxiety int")
    out = crosstab.band_distribution(df, "dassanxiety", P.SEVERITY_EDGES, P.SEVERITY_LABELS).collect()
    assert sum(r.n for r in out) == 2
    assert out[0].pct == 25.0


def test_complete_crosstab_keeps_zero_cells_and_empty_levels(spark):
    df = _dist(spark)
    out = crosstab.crosstab_bands(df, "gender_clean", "dassanxiety", P.SEVERITY_EDGES,
                                  P.SEVERITY_LABELS, complete=True,
                                  row_levels=["Male", "Female", "Other"]).collect()
    assert len(out) == 15
    other = [r for r in out if r.gender_clean == "Other"]
    assert all(r.n == 0 and r.row_pct is None for r in other)
    male = {r.band: r.n for r in out if r.gender_clean == "Male"}
    assert male == {"Normal": 1, "Mild": 1, "Moderate": 0, "Severe": 1, "Extremely Severe": 2}
    assert sum(r.n for r in out) == 8


def test_observed_crosstab_drops_empty_bands(spark):
    df = spark.createDataFrame([(5, "a"), (6, "a"), (40, "b")], "dassanxiety int, g string")
    out = crosstab.crosstab_bands(df, "g", "dassanxiety", P.SEVERITY_EDGES, P.SEVERITY_LABELS,
                                  complete=False).collect()
    assert {(r.g, r.band, r.n) for r in out} == {("a", "Normal", 2), ("a", "Extremely Severe", 0),
                                                 ("b", "Normal", 0), ("b", "Extremely Severe", 1)}


def test_crosstab_columns(spark):
    df = spark.createDataFrame([("x", "p"), ("x", "q"), ("y", "p"), (None, "p")], "r string, c string")
    out = {(r.r, r.c): (r.n, r.row_pct) for r in
           crosstab.crosstab_observed(df, "r", "c", normalize=True).collect()}
    assert out == {("x", "p"): (1, 50.0), ("x", "q"): (1, 50.0), ("y", "p"): (1, 100.0),
                   ("y", "q"): (0, 0.0)}


def test_labels_with_quotes(spark):
    df = spark.createDataFrame([(1,), (5,)], "x int")
    out = crosstab.band_distribution(df, "x", [0, 2, 6], ["it's low", 'say "high"']).collect()
    assert [(r.band, r.n) for r in out] == [("it's low", 1), ('say "high"', 1)]


def test_edges_and_labels_must_agree(spark):
    import pytest
    df = spark.createDataFrame([(1,)], "x int")
    with pytest.raises(ValueError):
        crosstab.band_distribution(df, "x", [0, 1, 2], ["a"])
    with pytest.raises(ValueError):
        crosstab.band_distribution(df, "x", [0, 2, 1], ["a", "b"])
