"""Binning and regrouping: P9, P11–P14, A25.

Fixed-edge bins are a single ``CASE`` expression. Quantile bins need one
aggregate pass (edges and distinct counts for every column together) and
then the same ``CASE`` with the edges as literals.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import expressions as E
from ..functions import presets as P
from .quantiles import exact_quantiles


def regroup_labels(df: DataFrame, source: str = "religion_clean", out: str = "religion_grouped",
                   groups: Mapping[str, Sequence[str]] = P.RELIGION_GROUPS) -> DataFrame:
    """Many labels -> one group label; everything else (incl. "No response") -> NULL."""
    if source not in df.columns:
        raise ValueError(f"Column '{source}' not found in DataFrame.")
    return df.withColumn(out, E.group_labels(source, groups))


def ensure_regrouped(df: DataFrame, source: str = "religion_clean",
                     out: str = "religion_grouped",
                     groups: Mapping[str, Sequence[str]] = P.RELIGION_GROUPS) -> DataFrame:
    return df if out in df.columns else regroup_labels(df, source, out, groups)


def add_bands(df: DataFrame, source: str, out: str, edges: Sequence[float],
              labels: Sequence[str], require: bool = True) -> DataFrame:
    """Right-closed fixed bins, lowest edge included; outside -> NULL."""
    if source not in df.columns:
        if require:
            raise ValueError(f"Column '{source}' not found in DataFrame.")
        return df
    return df.withColumn(out, E.fixed_bins(source, edges, labels))


def add_age_group(df: DataFrame, source: str = "age_clean", out: str = "age_group",
                  require: bool = True) -> DataFrame:
    return add_bands(df, source, out, P.AGE_EDGES, P.AGE_LABELS, require=require)


def add_severity(df: DataFrame, source: str = "dassanxiety", out: str = "anxiety_severity",
                 edges: Sequence[float] = P.SEVERITY_EDGES,
                 labels: Sequence[str] = P.SEVERITY_LABELS) -> DataFrame:
    return add_bands(df, source, out, edges, labels)


def long_values(df: DataFrame, cols: Sequence[str], variable: str = "variable",
                value: str = "value") -> DataFrame:
    """Unpivot numeric ``cols`` to ``(variable, value)`` as doubles."""
    return df.select(*[F.col(f"`{c}`").cast("double").alias(c) for c in cols]).unpivot(
        [], list(cols), variable, value)


def quantile_edges(df: DataFrame, cols: Sequence[str], n_groups: int,
                   method: str = "exact", with_nunique: bool = True) -> dict[str, dict]:
    """Pass 1 for quantile bins: edges at k/n, per column, and whether the column
    has ``n_groups`` distinct values (``enough``).

    All columns at once over the unpivoted form; returns
    ``{col: {"edges": [...], "enough": bool}}``. The gate looks for the next larger value
    ``n_groups - 1`` times, a minimum per column each time, so no distinct values are shuffled.
    """
    if not cols:
        return {}
    longf = long_values(df, cols).where(F.col("value").isNotNull() & ~F.isnan("value"))
    probs = {f"e{k}": k / n_groups for k in range(n_groups + 1)}
    q = exact_quantiles(longf, "value", probs, by=["variable"], method=method)
    out = {r["variable"]: {"edges": [r[f"e{k}"] for k in range(n_groups + 1)], "enough": True}
           for r in q.collect()}
    if with_nunique:
        # n strictly increasing edges and values beyond the first edge: distinct minima, one aggregate each
        last = {c: meta["edges"][0] for c, meta in out.items()}
        for _ in range(n_groups - 1):
            if not last:
                break
            aggs = [F.min(F.when(E.clean_double(f"`{c}`") > F.lit(v), F.col(f"`{c}`").cast("double"))).alias(f"m{i}")
                    for i, (c, v) in enumerate(last.items())]
            row = df.agg(*aggs).first()
            following = {c: row[f"m{i}"] for i, c in enumerate(last)}
            for c in [c for c, v in following.items() if v is None]:
                out[c]["enough"] = False
            last = {c: v for c, v in following.items() if v is not None}
    return out


def quantile_groups(df: DataFrame, cols: Sequence[str], n_groups: int = 3,
                    labels: Sequence[str] | None = None, ties: str = "skip",
                    suffix: str = "_group", names: Mapping[str, str] | None = None,
                    method: str = "exact", require: bool = False) -> DataFrame:
    """Quantile bins per column.

    ``ties="skip"``: a column is skipped (no output column) when it is absent,
    has fewer than ``n_groups`` distinct values, or its edges tie.
    ``ties="keep"``: bins are built from the edges anyway (``x <= q1`` is the
    first label, ``x <= q2`` the second, ...), an empty column is an error.
    """
    labels = list(labels) if labels is not None else P.quantile_labels(n_groups)
    if len(labels) != n_groups:
        raise ValueError("need one label per group")
    present = [c for c in cols if c in df.columns]
    if require and len(present) != len(cols):
        raise ValueError(f"Column(s) {sorted(set(cols) - set(present))} not found in DataFrame.")
    info = quantile_edges(df, present, n_groups, method=method, with_nunique=(ties == "skip"))
    exprs = {}
    for c in present:
        out = (names or {}).get(c, f"{c}{suffix}")
        meta = info.get(c)
        if meta is None:
            if ties == "keep":
                raise ValueError(f"No valid values for {c}.")
            continue
        edges = meta["edges"]
        if ties == "skip":
            if not meta["enough"] or any(b <= a for a, b in zip(edges, edges[1:])):
                continue
            exprs[out] = E.fixed_bins(F.col(f"`{c}`"), edges, labels)
        else:
            x = F.col(f"`{c}`")
            expr = None
            for i, lab in enumerate(labels[:-1]):
                cond = x <= F.lit(edges[i + 1])
                expr = F.when(cond, F.lit(lab)) if expr is None else expr.when(cond, F.lit(lab))
            expr = F.when(x.isNull() | F.isnan(x), F.lit(None).cast("string")).otherwise(
                expr.otherwise(F.lit(labels[-1])))
            exprs[out] = expr
    return df.withColumns(exprs) if exprs else df
