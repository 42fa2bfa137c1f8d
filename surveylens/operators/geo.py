"""Geographic tables: A1–A4, T1, T2, J3, J4.

Aggregate first (one row per country or continent), then look up codes on
the aggregated table, so the lookup never touches respondent rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import presets as P
from ..functions.expressions import clean_double


def mean_by(df: DataFrame, key: str, value: str = "dassanxiety", out: str = "mean_anxiety",
            with_count: bool = False, count_out: str = "n") -> DataFrame:
    """A1 / A2 / A3: mean (and count) of ``value`` per ``key``, descending by mean.

    NULL keys are not a group; ties are broken by the key.
    """
    y = clean_double(value)
    aggs = [F.avg(y).alias(out)]
    if with_count:
        aggs.append(F.count(y).alias(count_out))
    return (df.where(F.col(key).isNotNull()).groupBy(key).agg(*aggs)
              .orderBy(F.desc(out), F.asc(key)))


def count_by(df: DataFrame, key: str, out: str = "n_participants") -> DataFrame:
    """A4: rows per non-NULL key, descending (key breaks ties)."""
    return (df.where(F.col(key).isNotNull()).groupBy(key)
              .agg(F.count(F.lit(1)).alias(out)).orderBy(F.desc(out), F.asc(key)))


def top_k(df: DataFrame, order_col: str, key: str, k: int = 10) -> DataFrame:
    """The k largest by ``order_col`` (key as tie-break) — a TakeOrderedAndProject."""
    if k <= 0:
        raise ValueError("k must be positive")
    return df.orderBy(F.desc(order_col), F.asc(key)).limit(k)


def _caseless(name) -> Column:
    return F.lower(F.trim(name))


def alias_table(dim: DataFrame, aliases: Sequence[str], code: str) -> DataFrame:
    """``alias, code``: every name under which a row of ``dim`` can be asked for, in lower case and without
    blanks around it. Of codes that share an alias, the one from the column named first in
    ``aliases`` counts, then the smallest."""
    rows = F.array(*[F.struct(F.lit(k).alias("place"), _caseless(F.col(f"`{c}`").cast("string")).alias("alias"),
                              F.col(f"`{code}`").alias("code")) for k, c in enumerate(aliases)])
    return dim.select(F.inline(rows)).where("alias <> '' AND code IS NOT NULL").groupBy("alias").agg(
        F.min(F.struct("place", "code")).alias("first")).select("alias", "first.code")


def attach_codes(agg: DataFrame, dim: DataFrame, name_col: str = "country_name",
                 dim_name: str = "name", dim_code: str = "alpha3",
                 out: str = "iso_alpha_3", aliases: Sequence[str] = ()) -> DataFrame:
    """Country name -> alpha-3 code on an aggregated table (unmatched -> NULL;
    a name that repeats gets its smallest code). With ``aliases``, columns of ``dim``, a
    name may be any of them in any case (``alias_table``)."""
    if aliases:
        d = alias_table(dim, aliases, dim_code).select(F.col("alias").alias("_nm"), F.col("code").alias(out))
        return agg.join(d, _caseless(agg[name_col]) == d["_nm"], "left").drop("_nm")
    d = dim.groupBy(F.col(dim_name).alias("_nm")).agg(F.min(dim_code).alias(out))
    return agg.join(d, agg[name_col] == d["_nm"], "left").drop("_nm")


def detect_key(columns: Sequence[str], candidates: Sequence[str] = P.GEO_KEY_CANDIDATES) -> str | None:
    """First candidate key present in a boundary table's columns (None if none)."""
    for c in candidates:
        if c in columns:
            return c
    return None


def choropleth_table(world: DataFrame, means: DataFrame, means_key: str = "iso_alpha_3",
                     key: str | None = None) -> DataFrame | None:
    """Every feature of the boundary table with its mean (NULL when no match).

    Returns None when no key column can be found (the map is skipped).
    """
    key = key or detect_key(world.columns)
    if key is None:
        return None
    m = means.withColumnRenamed(means_key, "_mk")
    return world.join(m, world[key] == m["_mk"], "left").drop("_mk")
