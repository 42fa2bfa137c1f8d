"""Band distributions and cross-tabulations: A5–A8, J7, T6.

Counting is one partial+final hash aggregate with one conditional count per
band, so zero cells exist without any cross join; empty row levels come from
a left join on a small level domain. Row totals are the sum of a row's cells.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import expressions as E


def _maybe_round(c, digits: int | None, half_even: bool = True):
    if digits is None:
        return c
    return F.bround(c, digits) if half_even else F.round(c, digits)


def band_distribution(df: DataFrame, source: str, edges: Sequence[float],
                      labels: Sequence[str], band: str = "band", digits: int | None = None,
                      half_even: bool = True) -> DataFrame:
    """A5: count per band in band order, zero bands kept; percent of ALL rows.

    Rows whose value falls in no band stay in the denominator.
    Output: ``(ord, <band>, n, pct)`` ordered by ``ord``.
    """
    idx = E.fixed_bin_index(source, edges, labels)
    # one global aggregate: total rows and one conditional count per band
    aggs = [F.count(F.lit(1)).alias("_all")]
    aggs += [F.count_if(F.col("_i") == F.lit(i)).alias(f"_c{i}") for i in range(len(labels))]
    one = df.select(idx.alias("_i")).agg(*aggs)
    stack = E.rows_of(["ord", band, "n"],
                      [(F.lit(i), F.lit(lab), F.col(f"_c{i}")) for i, lab in enumerate(labels)])
    out = one.select("_all", stack)
    pct = F.try_divide(F.col("n") * F.lit(100.0), F.col("_all"))
    return out.select(F.col("ord").cast("int").alias("ord"), band,
                      F.col("n").cast("bigint").alias("n"),
                      _maybe_round(pct, digits, half_even).alias("pct")).orderBy("ord")


def crosstab_bands(df: DataFrame, row: str, source: str, edges: Sequence[float],
                   labels: Sequence[str], band: str = "band", complete: bool = True,
                   row_levels: Sequence[str] | None = None, digits: int | None = None,
                   half_even: bool = True) -> DataFrame:
    """A6 / A7 (``complete=True``) and A8 (``complete=False``) in long form.

    Output ``(<row>, ord, <band>, n, row_pct)``: counts of ``row`` level x band
    and percentages of the row total (NULL for an empty row).

    * complete: every band of the domain for every level (levels from
      ``row_levels`` if given, else the non-NULL levels present), zeros kept.
    * observed (crosstab): only levels and bands that have at least one
      binned row; zero cells inside that rectangle are kept.
    """
    binned = df.select(F.col(row).alias("_lvl"),
                       E.fixed_bin_index(source, edges, labels).alias("_ord"))
    binned = binned.where(F.col("_lvl").isNotNull())
    if not complete:
        binned = binned.where(F.col("_ord").isNotNull())
    ords = list(range(len(labels)))
    # one partial+final aggregate: a conditional count per band (zeros come for free)
    wide = binned.groupBy("_lvl").agg(
        *[F.count_if(F.col("_ord") == F.lit(o)).alias(f"_c{o}") for o in ords])
    if row_levels is not None:
        spark = df.sparkSession
        dom = spark.createDataFrame([(lv,) for lv in row_levels], "_lvl string")
        wide = dom.join(wide, "_lvl", "left").fillna(0, subset=[f"_c{o}" for o in ords])
    total = reduce(lambda a, b: a + b, [F.col(f"_c{o}") for o in ords])
    stack = E.rows_of(["_o", "_n"], [(F.lit(o), F.col(f"_c{o}")) for o in ords])
    longf = wide.select("_lvl", total.alias("_rt"), stack)
    if not complete:
        # drop bands never observed in any level
        seen = longf.groupBy(F.col("_o").alias("_so")).agg(F.sum("_n").alias("_bt")).where("_bt > 0")
        longf = longf.join(seen, F.col("_o") == F.col("_so"), "left_semi")
    band_map = E.lookup_map({i: lab for i, lab in enumerate(labels)})
    pct = F.try_divide(F.col("_n") * F.lit(100.0), F.col("_rt"))
    return longf.select(
        F.col("_lvl").alias(row), F.col("_o").cast("int").alias("ord"),
        F.try_element_at(band_map, F.col("_o").cast("int")).alias(band),
        F.col("_n").cast("bigint").alias("n"),
        _maybe_round(pct, digits, half_even).alias("row_pct"))


def crosstab_observed(df: DataFrame, row: str, col: str, normalize: bool = False,
                      digits: int | None = None) -> DataFrame:
    """A8 on two categorical columns: observed levels only, zeros inside kept.

    Long form ``(<row>, <col>, n[, row_pct])``. Pairs are counted by one partial
    + final aggregate; the rectangle of row levels and column levels, which is
    the result's size, is completed from the counted pairs alone.
    """
    pairs = df.select(F.col(row).alias("_r"), F.col(col).alias("_c")).where(
        F.col("_r").isNotNull() & F.col("_c").isNotNull()).groupBy("_r", "_c").agg(F.count(F.lit(1)).alias("n"))
    rows = pairs.groupBy("_r").agg(F.sum("n").alias("_rt"))
    domain = rows.crossJoin(pairs.select("_c").distinct())
    out = domain.join(pairs, ["_r", "_c"], "left").select(
        F.col("_r").alias(row), F.col("_c").alias(col), F.coalesce("n", F.lit(0)).cast("bigint").alias("n"), "_rt")
    if normalize:
        out = out.withColumn("row_pct", _maybe_round(F.try_divide(F.col("n") * 100.0, F.col("_rt")), digits))
    return out.drop("_rt")


def to_wide(longf: DataFrame, row: str, band: str, value: str, labels: Sequence[str]) -> DataFrame:
    """Long crosstab -> one row per level with one column per band (publishing shape)."""
    return longf.groupBy(row).pivot(band, list(labels)).agg(F.first(value))
