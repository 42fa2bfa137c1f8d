import numpy as np
import pytest
from pyspark.ml.linalg import Vectors

from surveylens.operators import ensembles


def best_cut(codes, w, y):
    """Every cut of every feature, by hand."""
    def spread(at):
        return (w[at] * (y[at] - np.average(y[at], weights=w[at])) ** 2).sum() if w[at].sum() else 0.0
    best = (0.0, -1, 0)
    for f in range(codes.shape[1]):
        for c in np.unique(codes[:, f])[:-1]:
            low = codes[:, f] <= c
            gain = spread(np.ones(len(y), bool)) - spread(low) - spread(~low)
            if gain > best[0] * (1 + 1e-9) + 1e-9:
                best = (gain, f, int(c))
    return best


def grown_by_hand(codes, w, y, depth=None):
    """Leaf values of a full tree, by recursion."""
    out = np.empty(len(y))

    def grow(rows, left):
        gain, f, c = best_cut(codes[rows], w[rows], y[rows])
        if f < 0 or left == 0:
            out[rows] = np.average(y[rows], weights=w[rows])
            return
        low = codes[rows, f] <= c
        grow(rows[low], None if left is None else left - 1)
        grow(rows[~low], None if left is None else left - 1)
    grow(np.arange(len(y)), depth)
    return out


def data(n=200, seed=0):
    rng = np.random.default_rng(seed)
    codes = rng.integers(0, 6, (n, 3)).astype(np.uint8)
    codes = codes[np.unique(codes, axis=0, return_index=True)[1]]
    y = codes[:, 0] * 2.0 - (codes[:, 1] > 2) * codes[:, 2] + rng.normal(size=len(codes))
    return codes, rng.integers(1, 4, len(codes)).astype(float), y


@pytest.mark.parametrize("depth", [0, 1, 3, None])
def test_tree_equals_recursion(depth):
    codes, w, y = data()
    y = y - np.average(y, weights=w)
    tree = ensembles.grow_tree(codes, w, w * y, depth)
    np.testing.assert_allclose(tree.value[tree.walk(codes)], grown_by_hand(codes, w, y, depth), atol=1e-9)
    gain, f, c = best_cut(codes, w, y)
    if depth != 0:
        assert (tree.feature[0], tree.cut[0]) == (f, c) and abs(tree.gain[0] - gain) < 1e-6


def frame(spark, n=600, seed=1, parts=3):
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.integers(0, 9, n) * 1.5, rng.normal(size=n).round(3), rng.integers(0, 2, n)])
    y = 3 * x[:, 0] + np.sin(3 * x[:, 1]) * 4 + x[:, 2] * x[:, 0] + rng.normal(size=n) * 0.1
    rows = [(Vectors.dense(a), float(b), float(1 + k % 3)) for k, (a, b) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, ["features", "label", "weight"]).repartition(parts), x, y


def test_top_levels_from_histograms_give_the_same_trees(spark):
    """Nodes split by tasks and driver, and nodes grown in one group: the same predictions and importances."""
    df = frame(spark)[0].cache()
    whole = ensembles.fit_stored_forest(df, 4, 3, weight_col="weight")
    parts = ensembles.fit_stored_forest(df, 4, 2, weight_col="weight", local_rows=60)
    assert all(len(t.feature) == 1 for t in whole.tops) and all(len(t.feature) > 9 for t in parts.tops)
    rows = df.selectExpr("monotonically_increasing_id() AS id", "features").checkpoint()
    a, b = ({r.id: r.prediction for r in f.predict(rows, "id").collect()} for f in (whole, parts))
    assert set(a) == set(b) and len(a) == 600
    assert max(abs(a[i] - b[i]) for i in a) < 1e-6
    # equal gains of two features are told apart by rounding, in nodes of a few rows
    np.testing.assert_allclose(whole.importance, parts.importance, atol=1e-4)
    assert abs(whole.importance.sum() - 1) < 1e-12 and whole.importance[0] == whole.importance.max()


def test_forest_predicts(spark):
    df, x, y = frame(spark)
    forest = ensembles.fit_stored_forest(df, 20, 8)
    assert forest.num_trees == 20 and forest.subtrees().count() == 20
    rows = df.selectExpr("monotonically_increasing_id() AS id", "features", "label").checkpoint()
    both = rows.join(forest.predict(rows, "id"), "id").collect()
    e = np.array([r.label - r.prediction for r in both])
    assert len(both) == 600 and 1 - (e @ e) / ((y - y.mean()) @ (y - y.mean())) > 0.97


def test_draws_are_a_bootstrap():
    rows = np.arange(200_000)
    k = ensembles.draws(rows, 3, 42)
    assert abs(k.mean() - 1) < 0.01 and abs(k.var() - 1) < 0.02 and abs((k == 0).mean() - np.exp(-1)) < 0.005
    assert abs(np.corrcoef(k, ensembles.draws(rows, 4, 42))[0, 1]) < 0.01
    assert (ensembles.draws(rows[::-1], 3, 42)[::-1] == k).all()


def test_cut_points(spark):
    df = spark.createDataFrame([([float(k % 5), float(k), 1.0],) for k in range(1000)], "_x array<double>")
    few, many, one = ensembles.cut_points(df, 3, 16)
    assert few.tolist() == [0.5, 1.5, 2.5, 3.5] and len(many) == 15 and len(one) == 0
    assert np.abs(many - np.arange(1, 16) * 62.5).max() < 3


def test_bad_sizes(spark):
    df = frame(spark)[0]
    for kw in ({"num_trees": 0}, {"num_trees": 1, "batch_trees": 0}, {"num_trees": 1, "max_bins": 300}):
        with pytest.raises(ValueError):
            ensembles.fit_stored_forest(df, **kw)
    with pytest.raises(ValueError):
        ensembles.fit_stored_forest(df.limit(0), 1)


def test_best_splits(spark):
    codes, w, y = data(80, 5)
    df = spark.createDataFrame([(*map(float, c), float(a), float(b)) for c, a, b in zip(codes, w, y)],
                               "a double, b double, c double, w double, y double")
    out = {r.feature: r for r in ensembles.best_splits(df, ["a", "b", "c"], "y", "w").collect()}
    for k, f in enumerate("abc"):
        gain, _, c = best_cut(codes[:, [k]], w, y)
        above = codes[codes[:, k] > c, k].min()
        assert out[f].threshold == (c + above) / 2 and abs(out[f].gain - gain / w.sum()) < 1e-9
        low = codes[:, k] <= c
        assert abs(out[f].left_mean - np.average(y[low], weights=w[low])) < 1e-9 and out[f].n_left == low.sum()


def test_a_tree_takes_cells_not_rows(spark):
    """Rows of equal codes are summed before they leave their task, in whatever partitions they came."""
    rng = np.random.default_rng(2)
    n, cells = 6000, 12
    x = rng.integers(0, [4, 3], (n, 2))
    y = x[:, 0] * 2.0 + (x[:, 1] == 1) + rng.normal(size=n)
    rows = [(k, float(k % 3 + 1), float(v), bytes(c)) for k, (c, v) in enumerate(zip(x.astype(np.uint8), y))]
    coded = spark.createDataFrame(rows, "_row long, _w double, _wy double, code binary").repartition(16)
    chunks = ensembles._chunks(coded, n, 2).checkpoint()
    parts = chunks.rdd.getNumPartitions()
    leaf = ensembles.Tree(np.array([-1]), np.zeros(1, np.int64), np.array([-1]), np.zeros(1), np.zeros(1))
    out = ensembles._batch_rows(chunks, {3: leaf, 4: leaf}, 42, 2).collect()
    for tree in (3, 4):
        mine = [r for r in out if r.tree == tree]
        assert cells <= sum(r.n for r in mine) < cells + parts
        codes = np.concatenate([np.frombuffer(r.codes, np.uint8).reshape(-1, 2) for r in mine])
        sums = np.concatenate([np.frombuffer(r.sums).reshape(2, -1) for r in mine], axis=1)
        k = ensembles.draws(np.arange(n), tree, 42).astype(float)
        for code in np.unique(x, axis=0):
            own, got = (x == code).all(axis=1), (codes == code).all(axis=1)
            w = np.arange(n) % 3 + 1
            np.testing.assert_allclose(sums[:, got].sum(axis=1), [(k * w)[own].sum(), (k * y)[own].sum()], atol=1e-8)


def test_cells_decide_what_a_group_grows(spark):
    """Many rows of few codes need no histograms: one group grows the tree."""
    rng = np.random.default_rng(3)
    rows = [(Vectors.dense(float(a)), float(a + e), 1.0) for a, e in zip(rng.integers(0, 5, 2000), rng.normal(size=2000))]
    df = spark.createDataFrame(rows, ["features", "label", "weight"])
    forest = ensembles.fit_stored_forest(df, 2, local_rows=200)
    assert all(len(t.feature) == 1 for t in forest.tops)
