"""Descriptive statistics: A9–A19, T3 (and the data behind the plots).

Each table is one (or two) partial+final aggregates over an unpivoted long
form, so the number of jobs does not grow with the number of columns.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import expressions as E
from ..functions import presets as P
from .moments import co_moments
from .quantiles import exact_quantiles

#: Values whose kernels a task evaluates at once.
KERNEL_BLOCK = 1024

_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType,
            T.DecimalType)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, _NUMERIC)]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def _long(df: DataFrame, cols: Sequence[str], cast: str) -> DataFrame:
    sel = [F.col(f"`{c}`").cast(cast).alias(c) for c in cols]
    return df.select(*sel).unpivot([], list(cols), "variable", "value")


def describe_numeric(df: DataFrame, cols: Sequence[str] | None = None,
                     method: str = "exact") -> DataFrame:
    """Count, mean, sample std, min, 25/50/75 % (interpolated), max, missing.

    NaN counts as missing. One row per column: ``(variable, count, mean, std,
    min, q25, q50, q75, max, missing)``, also when the table is empty.
    """
    cols = list(cols) if cols is not None else numeric_columns(df)
    longf = _long(df, cols, "double").withColumn("value", E.clean_double("value"))
    stats = longf.groupBy("variable").agg(
        F.count("value").alias("count"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        F.count_if(F.col("value").isNull()).alias("missing"))
    qs = exact_quantiles(longf, "value", {"q25": 0.25, "q50": 0.5, "q75": 0.75},
                         by=["variable"], method=method)
    names = df.sparkSession.createDataFrame([(c,) for c in cols], "variable string")
    return (names.join(stats, "variable", "left").join(qs, "variable", "left")
            .select("variable", F.coalesce("count", F.lit(0)).alias("count"), "mean", "std", "min", "q25", "q50",
                    "q75", "max", F.coalesce("missing", F.lit(0)).alias("missing")))


def value_counts(df: DataFrame, cols: Sequence[str] | None = None,
                 normalize: bool = True) -> DataFrame:
    """Counts per value of each string column, NULL kept as a level.

    ``(variable, value, n[, proportion])``; proportion is over all rows.
    """
    cols = list(cols) if cols is not None else string_columns(df)
    out = _long(df, cols, "string").groupBy("variable", "value").agg(
        F.count(F.lit(1)).alias("n"))
    if normalize:
        # a column may have as many values as rows: take the per-variable total
        # from its own aggregate (one row per listed column, so a safe broadcast)
        # instead of a window that would pull all values of a column into one task
        totals = out.groupBy("variable").agg(F.sum("n").alias("_tot"))
        out = (out.join(F.broadcast(totals), "variable")
                  .withColumn("proportion", F.col("n") / F.col("_tot")).drop("_tot"))
    return out


def full_summary(df: DataFrame, normalize: bool = False, method: str = "exact") -> dict:
    """Bundle of the numeric summary and the categorical counts."""
    out = {"numeric_summary": describe_numeric(df, method=method),
           "categorical_counts": value_counts(df, normalize=False)}
    if normalize:
        out["categorical_proportions"] = value_counts(df, normalize=True).drop("n")
    return out


def nonresponse_table(df: DataFrame, variables: Sequence[str] = P.NONRESPONSE_VARIABLES,
                      label: str = P.NO_RESPONSE, top_n: int | None = None) -> DataFrame:
    """Per variable, non-NULL count, label count and percent (0 when empty).

    Unknown columns are skipped; sorted by percent descending (name breaks ties).
    """
    present = [c for c in variables if c in df.columns]
    if not present:
        return df.sparkSession.createDataFrame(
            [], "variable string, n_total bigint, n_no_response bigint, pct_no_response double")
    aggs = []
    for i, c in enumerate(present):
        aggs.append(F.count(F.col(f"`{c}`")).alias(f"t{i}"))
        aggs.append(F.count_if(F.col(f"`{c}`").cast("string") == F.lit(label)).alias(f"r{i}"))
    one = df.agg(*aggs)
    stack = E.rows_of(["variable", "n_total", "n_no_response"],
                      [(F.lit(c), F.col(f"t{i}"), F.col(f"r{i}")) for i, c in enumerate(present)])
    out = one.select(stack).select(
        "variable", F.col("n_total").cast("bigint").alias("n_total"),
        F.col("n_no_response").cast("bigint").alias("n_no_response"),
        F.when(F.col("n_total") > 0, F.col("n_no_response") * 100.0 / F.col("n_total"))
         .otherwise(F.lit(0.0)).alias("pct_no_response"))
    out = out.orderBy(F.desc("pct_no_response"), "variable")
    return out.limit(top_n) if top_n is not None else out


def group_stats(df: DataFrame, factor: str, value: str) -> DataFrame:
    """Mean, sample std (NULL for one row) and count of ``value`` per level."""
    y = E.clean_double(value)
    return (df.where(F.col(factor).isNotNull()).groupBy(factor)
              .agg(F.avg(y).alias("mean"), F.stddev_samp(y).alias("std"),
                   F.count(y).alias("count")))


def box_stats(df: DataFrame, factors: Sequence[str], value: str,
              exclude: Sequence[str] = (P.NO_RESPONSE,), method: str = "exact") -> DataFrame:
    """Per factor level: count, mean, std, min, q1, median, q3, max of ``value``.

    All factors in one pass over an unpivoted ``(factor, level, value)``
    form; rows with NULL level or value, or an excluded level, are dropped.
    """
    sel = [F.col(value).cast("double").alias("_y")] + [
        F.col(f"`{f}`").cast("string").alias(f) for f in factors]
    longf = (df.select(*sel).unpivot("_y", list(factors), "factor", "level")
               .where(F.col("level").isNotNull() & F.col("_y").isNotNull()
                      & ~F.isnan("_y") & ~F.col("level").isin(list(exclude))))
    stats = longf.groupBy("factor", "level").agg(
        F.count(F.lit(1)).alias("count"), F.avg("_y").alias("mean"),
        F.stddev_samp("_y").alias("std"), F.min("_y").alias("min"), F.max("_y").alias("max"))
    qs = exact_quantiles(longf, "_y", {"q1": 0.25, "median": 0.5, "q3": 0.75},
                         by=["factor", "level"], method=method)
    return stats.join(qs, ["factor", "level"], "left").select(
        "factor", "level", "count", "mean", "std", "min", "q1", "median", "q3", "max")


def box_stats_global(df: DataFrame, value: str, method: str = "exact") -> DataFrame:
    """Mean, median, q25, q75, min, max (and count) of one column."""
    base = df.select(F.col(value).cast("double").alias("_y")).where(
        F.col("_y").isNotNull() & ~F.isnan("_y"))
    stats = base.agg(F.count(F.lit(1)).alias("count"), F.avg("_y").alias("mean"),
                     F.min("_y").alias("min"), F.max("_y").alias("max"))
    qs = exact_quantiles(base, "_y", {"q25": 0.25, "median": 0.5, "q75": 0.75}, method=method)
    row = qs.collect()
    q = row[0].asDict() if row else {"q25": None, "median": None, "q75": None}
    return stats.select("count", "mean", F.lit(q["median"]).cast("double").alias("median"),
                        F.lit(q["q25"]).cast("double").alias("q25"),
                        F.lit(q["q75"]).cast("double").alias("q75"), "min", "max")


def histogram(df: DataFrame, value: str, bins: int = 43) -> DataFrame:
    """Equal-width bins over [min, max]; the last bin is right-closed.

    ``(bin, lo, hi, n)`` with every bin present. The range is one small
    aggregate; binning and counting is a partial+final aggregate.
    """
    x = F.col(value).cast("double")
    base = df.select(x.alias("_x")).where(F.col("_x").isNotNull() & ~F.isnan("_x"))
    r = base.agg(F.min("_x").alias("lo"), F.max("_x").alias("hi")).collect()[0]
    lo, hi = r["lo"], r["hi"]
    spark = df.sparkSession
    if lo is None:
        return spark.createDataFrame([], "bin int, lo double, hi double, n bigint")
    if lo == hi:
        lo, hi = lo - 0.5, hi + 0.5
    width = (hi - lo) / bins
    idx = F.least(F.floor((F.col("_x") - F.lit(lo)) * F.lit(bins) / F.lit(hi - lo)),
                  F.lit(bins - 1)).cast("int")
    counts = base.select(idx.alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    dom = spark.range(bins).select(F.col("id").cast("int").alias("bin"))
    return (dom.join(counts, "bin", "left")
               .select("bin", (F.lit(lo) + F.col("bin") * F.lit(width)).alias("lo"),
                       (F.lit(lo) + (F.col("bin") + 1) * F.lit(width)).alias("hi"),
                       F.coalesce("n", F.lit(0)).cast("bigint").alias("n")))


def density_curve(df: DataFrame, value: str, grid: int = 200, bandwidth: float | None = None,
                  lo: float | None = None, hi: float | None = None) -> DataFrame:
    """Gaussian kernel density on an evenly spaced grid.

    Each task adds its values' kernels up on the grid, in blocks of different values (beyond 38
    bandwidths a kernel is 0 in double), and gives one row per grid point; no row or value is expanded
    or shuffled. Defaults: Scott's bandwidth ``std * n^(-1/5)``, grid over
    [min, max]. Output ``(i, x, density)``.
    """
    xv = F.col(value).cast("double")
    base = df.select(xv.alias("_x")).where(F.col("_x").isNotNull() & ~F.isnan("_x"))
    r = base.agg(F.count(F.lit(1)).alias("n"), F.stddev_samp("_x").alias("s"),
                 F.min("_x").alias("lo"), F.max("_x").alias("hi")).collect()[0]
    n = r["n"]
    spark = df.sparkSession
    if not n:
        return spark.createDataFrame([], "i int, x double, density double")
    h = bandwidth if bandwidth is not None else (r["s"] or 0.0) * n ** (-0.2)
    if not h or h <= 0:
        raise ValueError("bandwidth must be positive")
    glo = lo if lo is not None else r["lo"]
    ghi = hi if hi is not None else r["hi"]
    step = (ghi - glo) / (grid - 1) if grid > 1 else 0.0
    points = glo + np.arange(grid) * step

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(grid)
        for batch in batches:
            x, times = np.unique(batch.column(0).to_numpy(), return_counts=True)
            for at in range(0, len(x), KERNEL_BLOCK):
                block = slice(at, at + KERNEL_BLOCK)
                # the grid points that these values reach
                first, last = np.searchsorted(points, [x[block][0] - 39 * h, x[block][-1] + 39 * h])
                z = (points[None, first:last] - x[block, None]) / h
                total[first:last] += times[block] @ np.exp(-0.5 * z * z)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(grid, dtype=np.int32)), pa.array(total)], ["i", "_k"])

    norm = 1.0 / (n * h * math.sqrt(2.0 * math.pi))
    dens = base.mapInArrow(run, "i int, _k double")
    return (dens.groupBy("i").agg(F.sum("_k").alias("_s"))
                .select(F.col("i").cast("int").alias("i"),
                        (F.lit(glo) + F.col("i") * F.lit(step)).alias("x"),
                        (F.col("_s") * F.lit(norm)).alias("density")))


def correlation_matrix(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Pairwise-complete Pearson correlations, long ``(var_a, var_b, r)``.

    One pass of mergeable co-moments over all pairs (``moments.co_moments``): a task gives one row
    per pair, whatever the number of its rows. NaN is missing. The diagonal is 1 for a
    column with variance, the mirror is copied.
    """
    cols = [c for c in (cols if cols is not None else numeric_columns(df)) if c in df.columns]
    if not cols:
        return df.sparkSession.createDataFrame([], "var_a string, var_b string, r double")
    names = F.array(*[F.lit(c) for c in cols])
    agg = co_moments(df, [E.clean_double(f"`{c}`") for c in cols])
    varied = (F.col("n") > 1) & (F.col("sxx") > 0) & (F.col("syy") > 0)
    own = F.when(F.col("i") == F.col("j"), F.lit(1.0)).otherwise(F.col("sxy") / F.sqrt(F.col("sxx")) / F.sqrt(F.col("syy")))
    agg = agg.select(names[F.col("i")].alias("_a"), names[F.col("j")].alias("_b"), F.when(varied, own).alias("r"))
    pair = F.struct(F.col("_a").alias("var_a"), F.col("_b").alias("var_b"), F.col("r"))
    mirror = F.struct(F.col("_b").alias("var_a"), F.col("_a").alias("var_b"), F.col("r"))
    return agg.select(F.inline(F.when(F.col("_a") == F.col("_b"), F.array(pair)).otherwise(F.array(pair, mirror))))
