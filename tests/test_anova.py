import numpy as np
import pytest

from surveylens.functions.special import f_sf
from surveylens.operators import anova, bins


def _f_oneway(groups):
    allv = np.concatenate(groups)
    grand = allv.mean()
    ssb = sum(len(g) * (g.mean() - grand) ** 2 for g in groups)
    ssw = sum(((g - g.mean()) ** 2).sum() for g in groups)
    k, n = len(groups), len(allv)
    return (ssb / (k - 1)) / (ssw / (n - k)), k - 1, n - k


def test_one_way_matches_closed_form(spark):
    rng = np.random.default_rng(1)
    levels = {"a": rng.normal(10, 2, 40), "b": rng.normal(11, 2, 25), "c": rng.normal(9, 3, 31)}
    rows = [(float(v), lv, "x" if i % 2 else "y") for lv, vals in levels.items()
            for i, v in enumerate(vals)]
    rows.append((5.0, "No response", "x"))
    rows.append((None, "a", "x"))
    df = spark.createDataFrame(rows, "y double, f string, g string")
    res, groups = anova.one_way_anova(df, "y", ["f", "g"])
    out = {r.factor: r for r in res.collect()}
    f, d1, d2 = _f_oneway(list(levels.values()))
    assert out["f"].f == pytest.approx(f, rel=1e-10)
    assert (out["f"].df_between, out["f"].df_within) == (d1, d2)
    assert out["f"].p_value == pytest.approx(f_sf(f, d1, d2), rel=1e-12)
    gs = {r.level: r for r in groups.where("factor = 'f'").collect()}
    assert set(gs) == {"a", "b", "c"}
    assert gs["a"]["count"] == 40 and gs["a"]["std"] == pytest.approx(np.std(levels["a"], ddof=1))


def test_one_row_groups_give_null_f(spark):
    df = spark.createDataFrame([(10.0, "a"), (20.0, "b"), (30.0, "c")], "y double, f string")
    r = anova.one_way_anova(df, "y", ["f"])[0].collect()[0]
    assert r.f is None and r.p_value is None and r.df_within == 0


def test_personality_anova_skips_tied_trait(spark):
    rng = np.random.default_rng(2)
    rows = [(float(rng.normal()), float(x), 1.0 if i < 5 else 2.0)
            for i, x in enumerate(rng.integers(1, 8, 80))]
    df = spark.createDataFrame(rows, "dassanxiety double, T1 double, Tied double")
    res, _ = anova.personality_anova(df, ["T1", "Tied", "Absent"])
    assert [r.factor for r in res.collect()] == ["T1"]


def test_quantile_groups_golden(spark):
    df = spark.createDataFrame([(float(x),) for x in range(1, 7)], "t double")
    got = [r.t_group for r in bins.quantile_groups(df, ["t"]).orderBy("t").collect()]
    assert got == ["Low", "Low", "Medium", "Medium", "High", "High"]
    tied = spark.createDataFrame([(float(x),) for x in [1, 1, 1, 1, 2, 3]], "t double")
    assert "t_group" not in bins.quantile_groups(tied, ["t"]).columns
    kept = bins.quantile_groups(tied, ["t"], ties="keep", suffix="_g")
    assert [r.t_g for r in kept.orderBy("t").collect()] == ["Low"] * 4 + ["High", "High"]


def test_demographic_anova_creates_factors(spark):
    rows = [(float(i % 7), "Hindu" if i % 3 else "Atheist", 15 + i) for i in range(60)]
    df = spark.createDataFrame(rows, "dassanxiety double, religion_clean string, age_clean int")
    res, _ = anova.demographic_anova(df, ["religion_grouped", "age_group"])
    assert {r.factor for r in res.collect()} == {"religion_grouped", "age_group"}
