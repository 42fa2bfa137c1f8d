"""Standardising, dummy coding, casts and weights: P15–P17, A26 / J5."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import presets as P
from ..functions.expressions import clean_double
from ..session import ensure_checkpoint_dir


def standardize(df: DataFrame, cols: Sequence[str] = P.STANDARDIZE_COLUMNS,
                suffix: str = "_std") -> DataFrame:
    """``<c>_std = (x - mean) / std_pop``; a constant column gives 0.

    One aggregate computes every mean and population std; the moments (two
    numbers per column) are then applied as literals, so the transform is
    a narrow projection.
    """
    present = [c for c in cols if c in df.columns]
    if not present:
        return df
    aggs = []
    for i, c in enumerate(present):
        x = clean_double(f"`{c}`")
        aggs += [F.avg(x).alias(f"m{i}"), F.stddev_pop(x).alias(f"s{i}")]
    row = df.agg(*aggs).collect()[0]
    exprs = {}
    for i, c in enumerate(present):
        m, s = row[f"m{i}"], row[f"s{i}"]
        scale = s if (s is not None and s > 0) else 1.0
        if m is None:
            exprs[f"{c}{suffix}"] = F.lit(None).cast("double")
        else:
            exprs[f"{c}{suffix}"] = (clean_double(f"`{c}`") - F.lit(m)) / F.lit(scale)
    return df.withColumns(exprs)


def category_levels(df: DataFrame, cols: Sequence[str]) -> dict:
    """Sorted non-NULL levels of categorical columns: one distributed distinct over
    ``(column, level)`` for all of them. Each level becomes a column of the
    result, so they are read to the driver as any schema is."""
    if not cols:
        return {}
    longf = df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in cols]).unpivot([], list(cols), "c", "level")
    out = {c: [] for c in cols}
    for r in longf.where(F.col("level").isNotNull()).distinct().collect():
        out[r["c"]].append(r["level"])
    return {c: sorted(levels) for c, levels in out.items()}


def level_positions(df: DataFrame, col: str) -> DataFrame:
    """``level, position``: the non-NULL levels of a column as text, in order, counted from 0.

    Any number of levels: they are sorted by ranges, numbered within each, and the ranges' sizes (one
    row per partition) make the offsets.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    levels = df.select(F.col(f"`{col}`").cast("string").alias("level")).where("level IS NOT NULL").distinct()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # the id's upper bits are the partition, its lower 33 the place in it
    numbered = levels.repartitionByRange(parts, "level").sortWithinPartitions("level").withColumn(
        "_id", F.monotonically_increasing_id()).checkpoint()
    placed = numbered.select("level", F.shiftright("_id", 33).alias("_part"), F.col("_id").bitwiseAND((1 << 33) - 1).alias("_place"))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select("_part", F.coalesce(before, F.lit(0)).alias("_before"))
    return placed.join(F.broadcast(offsets), "_part").select("level", (F.col("_before") + F.col("_place")).alias("position"))


def dummy_columns(cols_levels: dict, drop_first: bool = True, sep: str = "_",
                  name_style: str = "plain") -> list[tuple[str, object]]:
    """``[(name, Column)]`` of 0/1 indicators; the first sorted level is the reference."""
    out = []
    for c, levels in cols_levels.items():
        use = levels[1:] if drop_first else levels
        for lv in use:
            name = f"{c}[T.{lv}]" if name_style == "formula" else f"{c}{sep}{lv}"
            out.append((name, F.when(F.col(f"`{c}`").cast("string") == F.lit(lv), F.lit(1)).otherwise(F.lit(0))))
    return out


def one_hot(df: DataFrame, cols: Sequence[str], drop_first: bool = True, sep: str = "_",
            keep_source: bool = False, levels: dict | None = None) -> DataFrame:
    """Indicator columns ``<col>_<level>`` (int 0/1), first sorted level dropped.

    Levels are those present in the rows (one small aggregate), so a label
    filtered out earlier does not create an all-zero column.
    """
    present = [c for c in cols if c in df.columns]
    levels = levels if levels is not None else category_levels(df, present)
    dummies = dummy_columns({c: levels[c] for c in present}, drop_first, sep)
    out = df.withColumns({n: e for n, e in dummies}) if dummies else df
    return out if keep_source else out.drop(*present)


def to_double(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Cast numeric columns to double."""
    return df.withColumns({c: F.col(f"`{c}`").cast("double") for c in cols if c in df.columns})


def inverse_frequency_weights(df: DataFrame, col: str = "gender_clean", out: str = "weight") -> DataFrame:
    """``w = N / n_level`` over non-NULL levels; NULL level or absent column -> 1.0.

    Level counts are one partial + final aggregate, their total the sum of that
    small frame; a plain join brings the weights back (the planner and AQE choose
    its form by bytes) — no window over a hot level.
    """
    if col not in df.columns:
        return df.withColumn(out, F.lit(1.0))
    counts = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("_cnt"))
    total = counts.agg(F.sum("_cnt").alias("_total"))  # one row
    w = counts.join(F.broadcast(total)).select(F.col(f"`{col}`"), (F.col("_total") / F.col("_cnt")).alias("_w"))
    # USING-join on the level column (the count table is derived from df itself)
    return (df.join(w, on=[col], how="left")
              .withColumn(out, F.coalesce(F.col("_w"), F.lit(1.0))).drop("_w"))
