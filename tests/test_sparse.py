import numpy as np
from pyspark.sql import functions as F

from surveylens.operators import models, scale


def test_positions_follow_the_order(spark):
    rng = np.random.default_rng(0)
    words = ["".join(chr(97 + c) for c in rng.integers(0, 26, 3)) for _ in range(3000)] + ["é", "", "Z"]
    df = spark.createDataFrame([(w,) for w in words] + [(None,)], "w string").repartition(7)
    out = {r.level: r.position for r in scale.level_positions(df, "w").collect()}
    assert out == {w: i for i, w in enumerate(sorted(set(words), key=lambda x: x.encode()))}


def test_same_design_as_dense(spark):
    rows = [(float(i), f"g{i % 5}", "ab"[i % 2], "only", float(i * i % 17), i) for i in range(60)]
    rows += [(None, "g1", "a", "only", 1.0, 90), (1.0, None, "a", "only", 1.0, 91), (1.0, "No response", "a", "only", 1.0, 92)]
    df = spark.createDataFrame(rows, "x double, g string, h string, o string, y double, id int")
    dense = models.design_frame(df, "y", ["x"], ["g", "h", "o"], passthrough=["id"])
    sparse = models.sparse_design(df, "y", ["x"], ["g", "h", "o"], passthrough=["id"])
    a = {r.id: (r.features.toArray().tolist(), r.label) for r in dense.frame.collect()}
    out = sparse.frame.collect()
    assert {r.id: (r.features.toArray().tolist(), r.label) for r in out} == a
    assert [r.term for r in sparse.terms.orderBy("position").collect()] == dense.feature_names and sparse.size == len(dense.feature_names)
    for r in out:
        assert [k for k in r.columns] == [k for k, v in enumerate(r.features.toArray()) if k and v]


def test_a_factor_of_many_levels_is_fitted(spark):
    """20,000 levels, three rows each: the slope equals that of the rows less their level's means."""
    n = 20_000
    df = spark.range(3 * n).select(F.concat(F.lit("l"), F.col("id") % n).alias("level"), (F.hash("id") % 1000 / 500).alias("x")).withColumn(
        "y", 2 * F.col("x") + F.hash("level") % 100 / 20 + F.hash("x", "level") % 100 / 1000)
    design = models.sparse_design(df, "y", ["x"], ["level"])
    assert design.size == n and design.terms.count() == n
    model, perf = models.fit_linear(design.frame, design.frame)
    within = df.join(df.groupBy("level").agg(F.avg("x").alias("mx"), F.avg("y").alias("my")), "level")
    slope = within.agg((F.sum((F.col("x") - F.col("mx")) * (F.col("y") - F.col("my"))) / F.sum((F.col("x") - F.col("mx")) ** 2)).alias("b")).first().b
    assert abs(model.coefficients[0] - slope) < 1e-3 and perf.r2_train > 0.99
