from pyspark.sql import functions as F

from surveylens.functions import expressions as E
from surveylens.functions import presets as P


def _col(spark, values, typ="double"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {typ}")


def test_severity_bands_golden(spark):
    vals = [-1.0, 0.0, 14.0, 14.5, 18.0, 19.0, 56.0, 57.0, None]
    df = _col(spark, vals).select("i", E.fixed_bins("x", P.SEVERITY_EDGES, P.SEVERITY_LABELS)
                                  .alias("b")).orderBy("i")
    got = [r.b for r in df.collect()]
    assert got == [None, "Normal", "Normal", "Mild", "Mild", "Moderate", "Extremely Severe",
                   None, None]


def test_age_bands_golden(spark):
    labels = ["a", "b", "c", "d", "e"]
    df = _col(spark, [12, 13, 17, 18, 24, 25, 100, 11, 101], "int")
    got = [r.b for r in df.select("i", E.fixed_bins("x", P.AGE_EDGES, labels).alias("b"))
           .orderBy("i").collect()]
    assert got == ["a", "a", "a", "b", "b", "c", "e", None, None]


def test_null_skipping_sum(spark):
    df = spark.createDataFrame([(0, 1, 2), (1, None, 3), (2, None, None)], "i int, a int, b int")
    got = [r.s for r in df.select("i", E.null_skipping_sum(["a", "b"]).alias("s"))
           .orderBy("i").collect()]
    assert got == [3, 3, 0]


def test_not_label_keeps_null(spark):
    df = spark.createDataFrame([(0, "b"), (1, "a"), (2, "b"), (3, None), (4, "z")], "i int, x string")
    got = [r.x for r in df.where(E.not_label("x", "z")).orderBy("i").collect()]
    assert got == ["b", "a", "b", None]


def test_recode_unmapped_and_null(spark):
    df = spark.createDataFrame([(0, 1), (1, 0), (2, 9), (3, None)], "i int, g int")
    got = [r.l for r in df.select("i", E.recode("g", P.GENDER_MAP).alias("l")).orderBy("i").collect()]
    assert got == ["Male", "No response", None, None]


def test_age_from_year(spark):
    df = spark.createDataFrame([(0, 1900), (1, 2015), (2, 2016), (3, 35)], "i int, a int")
    got = [r.x for r in df.select("i", E.age_from_year_or_age("a", 2025).alias("x"))
           .orderBy("i").collect()]
    assert got == [125, 10, 2016, 35]


def test_group_labels(spark):
    df = spark.createDataFrame([(0, "Hindu"), (1, "Atheist"), (2, "Other"), (3, "No response"),
                                (4, None)], "i int, r string")
    got = [r.g for r in df.select("i", E.group_labels("r", P.RELIGION_GROUPS).alias("g"))
           .orderBy("i").collect()]
    assert got == ["Religious", "Non-religious", "Unspecified", None, None]


def test_bin_index_matches_labels(spark):
    df = _col(spark, [0.0, 10.0, 10.5, 50.0, 51.0])
    edges = [0, 10, 20, 30, 40, 50]
    got = [r.k for r in df.select("i", E.fixed_bin_index("x", edges).alias("k")).orderBy("i").collect()]
    assert got == [0, 0, 1, 4, None]
    assert F is not None
