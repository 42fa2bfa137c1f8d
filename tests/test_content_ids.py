import numpy as np
from pyspark.sql import functions as F

from surveylens.operators import clean, describe, models


def test_same_ids_and_test_rows_from_any_partitions(spark):
    """1, 7 and 211 partitions, and another order of the rows; a third of them are equal, null is no text."""
    rows = [(i % 50, "x" if i % 3 else None) for i in range(300)] + [(0, "hot")] * 150 + [(1, "-"), (1, None), (1, "")]
    seen = set()
    for parts, order in ((1, 1), (7, -1), (211, 1)):
        df = spark.createDataFrame(rows[::order], "a int, b string").repartition(parts)
        out = models.hash_split(clean.content_ids(df), ["row_id"])
        assert out.columns == ["a", "b", "row_id", "is_test"]
        got = sorted(map(tuple, out.collect()), key=repr)
        assert len({r[2] for r in got}) == len(rows)
        seen.add(repr(got))
    assert len(seen) == 1


def test_ids_of_an_empty_table_and_of_chosen_columns(spark):
    df = spark.createDataFrame([], "a int")
    assert clean.content_ids(df).collect() == []
    df = spark.createDataFrame([(1, 2), (1, 3)], "a int, b int")
    ids = sorted(r.id for r in clean.content_ids(df, "id", ["a"]).collect())
    assert [i[-2:] for i in ids] == ["-0", "-1"] and ids[0][:-2] == ids[1][:-2]


def test_density_of_a_continuous_column(spark):
    x = np.concatenate([np.random.default_rng(0).normal(size=3000), [1e6]])  # one value far off
    df = spark.createDataFrame([(float(v),) for v in x], "x double").repartition(5)
    out = describe.density_curve(df, "x", grid=60, bandwidth=0.1, lo=-3.0, hi=3.0).orderBy("i").collect()
    points = np.linspace(-3, 3, 60)
    expected = np.exp(-0.5 * ((points[:, None] - x) / 0.1) ** 2).sum(axis=1) / (len(x) * 0.1 * np.sqrt(2 * np.pi))
    np.testing.assert_allclose([r.density for r in out], expected, rtol=1e-9)
    assert df.agg(F.count("x")).first()[0] == 3001
