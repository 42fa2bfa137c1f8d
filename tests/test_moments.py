import numpy as np
import pytest

from surveylens.operators import models, moments


def table(n=400, p=5, seed=0, missing=0.1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, p)) * [1, 10, 0.1, 1e3, 1][:p] + [0, 1e4, -5, 3, 1e5][:p]
    x[:, 2] += x[:, 0]
    if missing:
        x[rng.random((n, p)) < missing] = np.nan
    return x


def pairs(x):
    """Two-pass co-moments of every pair."""
    p, out = x.shape[1], {}
    for i in range(p):
        for j in range(i, p):
            v = x[~np.isnan(x[:, i]) & ~np.isnan(x[:, j])][:, [i, j]]
            d = v - v.mean(axis=0)
            out[i, j] = [len(v), *v.mean(axis=0), *(d * d).sum(axis=0), (d[:, 0] * d[:, 1]).sum()]
    return out


@pytest.mark.parametrize("cuts", [[], [1], [3, 3, 200], list(range(0, 400, 7))])
def test_merge_equals_two_passes(cuts):
    x = table()
    total = None
    for part in np.split(x, cuts):
        if len(part):
            own = moments.batch_moments(part)
            total = own if total is None else moments.merged(total, own)
    for (i, j), expected in pairs(x).items():
        np.testing.assert_allclose(total[:, i, j], expected, rtol=1e-9, atol=1e-6)


@pytest.mark.parametrize("partitions", [1, 7, 40])
def test_co_moments_of_a_frame(spark, partitions):
    x = table(300)
    df = spark.createDataFrame([tuple(None if np.isnan(v) and k % 2 else float(v) for k, v in enumerate(r)) for r in x],
                               "a double, b double, c double, d double, e double").repartition(partitions)
    rows = moments.co_moments(df, [df[c] for c in "abcde"]).collect()
    expected = pairs(x)
    assert len(rows) == len(expected) == 15
    for r in rows:
        np.testing.assert_allclose([r[f] for f in moments.FIELDS], expected[r.i, r.j], rtol=1e-9, atol=1e-6)


def test_empty_frame(spark):
    df = spark.createDataFrame([], "a double, b double")
    assert moments.co_moments(df, [df.a, df.b]).collect() == []


def pinv_fit(x, y):
    """The usual result: pseudo-inverse of the design with an intercept, rank for the degrees of freedom."""
    design = np.column_stack([np.ones(len(x)), x])
    inverse = np.linalg.pinv(design, rcond=1e-12)
    beta = inverse @ y
    rank = np.linalg.matrix_rank(design, tol=1e-9 * np.linalg.norm(design))
    e = y - design @ beta
    variance = e @ e / (len(y) - rank)
    return beta, np.sqrt(np.diag(inverse @ inverse.T) * variance), rank


def designs():
    rng = np.random.default_rng(2)
    a, b, c = rng.normal(size=(3, 200))
    level = rng.integers(0, 3, 200)
    dummies = np.eye(3)[level]
    return {"regular": np.column_stack([a, b]), "repeated": np.column_stack([a, b, a]), "scaled": np.column_stack([a, 3 * a, b]),
            "all dummies": np.column_stack([dummies, c]), "constant": np.column_stack([a, np.full(200, 5.0), b]),
            "sums": np.column_stack([a, b, a + b, a - 2 * b + 1]), "zero": np.column_stack([a, np.zeros(200)])}


@pytest.mark.parametrize("name", sorted(designs()))
def test_least_norm_is_the_pseudo_inverse(name):
    x = designs()[name]
    y = 2 + x @ np.arange(1, x.shape[1] + 1) + np.random.default_rng(3).normal(size=len(x))
    m = moments.batch_moments(np.column_stack([x, y]))
    fit = moments.least_norm(len(x), np.diag(m[1]).copy(), m[5])
    beta, se, rank = pinv_fit(x, y)
    assert fit.rank == rank and fit.dof == len(x) - rank
    np.testing.assert_allclose([fit.intercept, *fit.coefficients], beta, rtol=1e-7, atol=1e-8)
    np.testing.assert_allclose(np.sqrt(np.diag(fit.covariance)), se, rtol=1e-6, atol=1e-8)


def test_ols_on_collinear_dummies(spark):
    """Two factors with the same levels under other names, and a constant column."""
    rng = np.random.default_rng(4)
    level = rng.integers(0, 3, 300)
    x, y = rng.normal(size=300), rng.normal(size=300)
    y = y + 2 * x + level
    df = spark.createDataFrame([(float(a), float(b), f"l{k}", f"m{k}", 1.5) for a, b, k in zip(x, y, level)],
                               "x double, y double, f string, g string, one double")
    res = models.ols(df, "y", ["x", "one"], ["f", "g"])
    dummies = np.eye(3)[level][:, 1:]
    beta, se, rank = pinv_fit(np.column_stack([x, np.full(300, 1.5), dummies, dummies]), y)
    rows = res.coefficients.collect()
    assert [r.term for r in rows] == ["Intercept", "x", "one", "f[T.l1]", "f[T.l2]", "g[T.m1]", "g[T.m2]"]
    np.testing.assert_allclose([r.coef for r in rows], beta, rtol=1e-7)
    np.testing.assert_allclose([r.se for r in rows], se, rtol=1e-6)
    assert res.dof == 300 - rank and all(r.ci_lower < r.coef < r.ci_upper for r in rows)
    same = models.ols(df, "y", ["x"], ["f"])
    assert abs(same.r2 - res.r2) < 1e-12
    pred = res.model.transform(models.design_frame(df, "y", ["x", "one"], ["f", "g"]).frame)
    e = np.array([r.label - r.prediction for r in pred.collect()])
    assert abs(1 - (e @ e) / ((y - y.mean()) @ (y - y.mean())) - res.r2) < 1e-9
