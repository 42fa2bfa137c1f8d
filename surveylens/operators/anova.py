"""One-way ANOVA: A19–A23, F5, P13 via A22.

All factors are tested in one job: the factors are unpivoted to
``(factor, level, y)``, aggregated to ``(n, mean, var)`` per level with
map-side partial aggregation (a hot level never sits in one task), and then
reduced per factor. ``SSW = sum((n_g - 1) * var_g)`` avoids the cancellation
of ``sum(y^2) - ...``. The p-value is a vectorised finisher on the few
result rows.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from ..functions import presets as P
from ..functions.special import f_sf
from .bins import add_age_group, ensure_regrouped, quantile_groups


@pandas_udf(T.DoubleType())
def f_pvalue(f: pd.Series, dfn: pd.Series, dfd: pd.Series) -> pd.Series:
    vals = []
    for a, b, c in zip(f, dfn, dfd):
        ok = not (pd.isna(a) or pd.isna(b) or pd.isna(c))
        vals.append(f_sf(float(a), float(b), float(c)) if ok else None)
    return pd.Series(vals, dtype="float64")


def level_stats(df: DataFrame, dependent: str, factors: Sequence[str],
                exclude: Sequence[str] | None = (P.NO_RESPONSE,)) -> DataFrame:
    """Per (factor, level): n, mean, sample variance of the dependent (A19 inputs)."""
    missing = [c for c in [dependent, *factors] if c not in df.columns]
    if missing:
        raise ValueError(f"Column(s) {missing} not found in DataFrame.")
    sel = [F.col(f"`{dependent}`").cast("double").alias("_y")] + [
        F.col(f"`{f}`").cast("string").alias(f) for f in factors]
    longf = df.select(*sel).unpivot("_y", list(factors), "factor", "level")
    cond = F.col("level").isNotNull() & F.col("_y").isNotNull() & ~F.isnan("_y")
    if exclude:
        cond = cond & ~F.col("level").isin(list(exclude))
    return (longf.where(cond).groupBy("factor", "level")
                 .agg(F.count(F.lit(1)).alias("n"), F.avg("_y").alias("mean"),
                      F.var_samp("_y").alias("var")))


def anova_from_stats(stats: DataFrame, with_p: bool = True) -> DataFrame:
    """``(factor, k, n, df_between, df_within, ssb, ssw, f[, p_value])`` from level stats.

    F is NULL when it is undefined: fewer than two levels, n = k, or SSW = 0.
    """
    # the grand mean goes back to the level rows: partial sums per task, no list of levels
    grand = stats.groupBy("factor").agg((F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("grand"))
    away = F.col("mean") - F.col("grand")
    per = stats.join(grand, "factor").groupBy("factor").agg(
        F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"),
        F.sum((F.col("n") - 1) * F.coalesce(F.col("var"), F.lit(0.0))).alias("ssw"),
        F.sum(F.col("n") * away * away).alias("ssb"))
    out = (per.withColumn("df_between", (F.col("k") - 1).cast("bigint"))
              .withColumn("df_within", (F.col("n") - F.col("k")).cast("bigint")))
    msb = F.try_divide(F.col("ssb"), F.col("df_between"))
    msw = F.try_divide(F.col("ssw"), F.col("df_within"))
    f = F.when((F.col("k") >= 2) & (F.col("df_within") > 0), F.try_divide(msb, msw))
    out = out.withColumn("f", f).select("factor", F.col("k").cast("bigint").alias("k"),
                                        F.col("n").cast("bigint").alias("n"), "df_between",
                                        "df_within", "ssb", "ssw", "f")
    if with_p:
        out = out.withColumn("p_value", f_pvalue("f", "df_between", "df_within"))
    return out


def one_way_anova(df: DataFrame, dependent: str, factors: Sequence[str],
                  exclude: Sequence[str] | None = (P.NO_RESPONSE,),
                  with_p: bool = True, digits: int | None = None) -> tuple[DataFrame, DataFrame]:
    """A20 / A21 for several factors at once.

    Returns ``(anova, group_stats)``; ``group_stats`` is
    ``(factor, level, mean, std, count)``, rounded half-even to ``digits``
    when given (the published tables use 2).
    """
    stats = level_stats(df, dependent, factors, exclude)
    mean, std = F.col("mean"), F.sqrt("var")
    if digits is not None:
        mean, std = F.bround(mean, digits), F.bround(std, digits)
    groups = stats.select("factor", "level", mean.alias("mean"), std.alias("std"),
                          F.col("n").alias("count"))
    return anova_from_stats(stats, with_p=with_p), groups


def demographic_anova(df: DataFrame, factors: Sequence[str] = P.DEMOGRAPHIC_FACTORS,
                      dependent: str = "dassanxiety", with_p: bool = True):
    """Creates ``religion_grouped`` / ``age_group`` on demand, then A20 per factor."""
    if "religion_grouped" in factors and "religion_grouped" not in df.columns:
        df = ensure_regrouped(df)
    if "age_group" in factors and "age_group" not in df.columns:
        df = add_age_group(df)
    return one_way_anova(df, dependent, factors, with_p=with_p)


def personality_anova(df: DataFrame, traits: Sequence[str] = P.TRAITS, n_groups: int = 3,
                      dependent: str = "dassanxiety", method: str = "exact",
                      with_p: bool = True):
    """Quantile groups per trait (skipping traits that cannot be cut), then A20.

    The result's ``factor`` column holds the trait name.
    """
    grouped = quantile_groups(df, traits, n_groups=n_groups, ties="skip", method=method)
    made = [t for t in traits if f"{t}_group" in grouped.columns and t in df.columns]
    if not made:
        spark = df.sparkSession
        empty = spark.createDataFrame([], "factor string, k bigint, n bigint, df_between bigint, "
                                          "df_within bigint, ssb double, ssw double, f double")
        return empty, spark.createDataFrame([], "factor string, level string, mean double, "
                                                "std double, count bigint")
    anova, groups = one_way_anova(grouped, dependent, [f"{t}_group" for t in made],
                                  with_p=with_p)
    strip = F.regexp_replace("factor", "_group$", "")
    return anova.withColumn("factor", strip), groups.withColumn("factor", strip)


def anova_summary(anova: DataFrame, key: str = "factor") -> DataFrame:
    """``(factor|trait, F, p_value)``."""
    return anova.select(F.col("factor").alias(key), F.col("f").alias("F"), "p_value")
