"""Mergeable co-moments of many columns in one pass, and least squares from them.

A task turns its Arrow batches into matrices and keeps, for every pair of columns, the count, both means
and the (co)variation sums over the rows where both are present. Two tables of co-moments merge by
the usual update (Chan, Golub and LeVeque), so nothing cancels however far the columns lie from
0. One row per task and pair of columns reaches the final merge; no input row is expanded.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FIELDS = ("n", "mean_x", "mean_y", "sxx", "syy", "sxy")
PAIR_SCHEMA = "i int, j int, " + ", ".join(f"{f} double" for f in FIELDS)


def batch_moments(values: np.ndarray) -> np.ndarray:
    """``(6, p, p)`` co-moments of the rows of a matrix, NaN being missing."""
    known = ~np.isnan(values)
    # a shift near the data keeps the sums small, and is exact for a constant; the result does not depend on it
    low = np.where(known, values, np.inf).min(axis=0)
    high = np.where(known, values, -np.inf).max(axis=0)
    middle = np.where(known, values, 0.0).sum(axis=0) / np.maximum(known.sum(axis=0), 1)
    shift = np.where(known.any(axis=0), np.where(low == high, high, middle), 0.0)
    x, m = np.where(known, values - shift, 0.0), known.astype(np.float64)
    n = m.T @ m
    sx = x.T @ m  # sum of column i over the rows where j is known too
    safe = np.maximum(n, 1.0)
    sxx = (x * x).T @ m - sx * sx / safe
    sxy = x.T @ x - sx * sx.T / safe
    return np.stack([n, sx / safe + shift[:, None], sx.T / safe + shift[None, :], sxx, sxx.T, sxy])


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Co-moments of the rows of both."""
    n = a[0] + b[0]
    share, cross = b[0] / np.maximum(n, 1.0), a[0] * b[0] / np.maximum(n, 1.0)
    dx, dy = b[1] - a[1], b[2] - a[2]
    return np.stack([n, a[1] + dx * share, a[2] + dy * share, a[3] + b[3] + dx * dx * cross,
                     a[4] + b[4] + dy * dy * cross, a[5] + b[5] + dx * dy * cross])


def co_moments(df: DataFrame, columns: Sequence) -> DataFrame:
    """``i, j, n, mean_x, mean_y, sxx, syy, sxy`` for all pairs of ``columns`` (expressions), ``i <= j``."""
    p = len(columns)
    upper = np.triu_indices(p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if batch.num_rows:
                values = np.column_stack([c.fill_null(np.nan).to_numpy(zero_copy_only=False) for c in batch.columns])
                own = batch_moments(values)
                held = own if held is None else merged(held, own)
        if held is not None:
            task = np.full(len(upper[0]), TaskContext.get().partitionId(), np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(task), *(pa.array(k.astype(np.int32)) for k in upper),
                                              *(pa.array(x[upper]) for x in held)], ["task", "i", "j", *FIELDS])

    def finish(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        # every task gives all pairs; merged in the order of the tasks, not of arrival
        rows = rows.sort_values(["task", "j"])
        parts = rows[list(FIELDS)].to_numpy().reshape(-1, p - key[0], len(FIELDS))
        total = parts[0].T
        for part in parts[1:]:
            total = merged(total, part.T)
        return pd.DataFrame({"i": key[0], "j": np.arange(key[0], p), **dict(zip(FIELDS, total))})

    wide = df.select(*[c.cast("double").alias(f"x{k}") for k, c in enumerate(columns)])
    return wide.mapInArrow(run, f"task int, {PAIR_SCHEMA}").groupBy("i").applyInPandas(finish, PAIR_SCHEMA)


@dataclass
class LeastNorm:
    """Least squares of smallest norm: an intercept and one coefficient per column."""

    intercept: float
    coefficients: np.ndarray
    covariance: np.ndarray  # of (intercept, coefficients)
    nobs: int
    rank: int               # with the intercept
    r2: float

    @property
    def dof(self) -> int:
        return self.nobs - self.rank


#: Directions with less than this share of the largest variation (all columns scaled to 1) count as none.
TOLERANCE = 1e-10


def least_norm(n: float, mean: np.ndarray, s: np.ndarray, tolerance: float = TOLERANCE) -> LeastNorm:
    """Fit from the co-moments of ``p`` columns and, last, the response.

    The columns may be collinear or constant: the solution is the pseudo-inverse's, the shortest of all
    that fit equally well, and its covariance is the residual variance times the pseudo-inverse of X'X.
    """
    p = len(mean) - 1
    sxx, sxy, syy = s[:p, :p], s[:p, p], s[p, p]
    # a constant column has rounding errors for variation
    flat = np.diag(sxx) <= n * np.square(mean[:p] * 1e-12)
    scale = np.where(flat, 0.0, 1.0 / np.sqrt(np.where(flat, 1.0, np.diag(sxx))))
    values, vectors = np.linalg.eigh(sxx * scale[:, None] * scale[None, :])
    real = values > tolerance * max(values.max(initial=0.0), 1e-300)
    inner = scale[:, None] * vectors[:, real]
    inverse = inner / values[real] @ inner.T
    slope = inverse @ sxy
    full = np.empty((p + 1, p + 1))
    full[1:, 1:] = inverse
    full[0, 1:] = full[1:, 0] = -(inverse @ mean[:p])
    full[0, 0] = 1.0 / n + mean[:p] @ inverse @ mean[:p]
    beta = np.concatenate([[mean[p] - mean[:p] @ slope], slope])
    # directions that change no fitted value: combinations of columns that are constant, against the intercept
    idle = vectors[:, ~real] * np.where(flat, 1.0, scale)[:, None]
    if idle.shape[1]:
        basis, _ = np.linalg.qr(np.vstack([-(mean[:p] @ idle)[None, :], idle]))
        keep = np.eye(p + 1) - basis @ basis.T
        beta, full = keep @ beta, keep @ full @ keep.T
    rank = int(real.sum()) + 1
    sse = max(float(syy - sxy @ slope), 0.0)
    variance = sse / (n - rank) if n > rank else float("nan")
    return LeastNorm(float(beta[0]), beta[1:], full * variance, int(n), rank, 1.0 - sse / syy if syy > 0 else float("nan"))


def fit_least_norm(frame: DataFrame, size: int, features: str = "features", label: str = "label") -> LeastNorm:
    """``least_norm`` over a vector column. The normal matrix (``size`` squared) is what reaches the driver."""
    from pyspark.ml.functions import vector_to_array
    arrays = frame.select(vector_to_array(features).alias("_x"), F.col(label).alias("_y"))
    rows = co_moments(arrays, [*[F.col("_x")[k] for k in range(size)], F.col("_y")]).collect()
    s, mean, n = np.zeros((size + 1, size + 1)), np.zeros(size + 1), 0.0
    for r in rows:
        s[r.i, r.j] = s[r.j, r.i] = r.sxy
        if r.i == r.j:
            mean[r.i], n = r.mean_x, r.n
    if not rows:
        raise ValueError("no rows to fit on")
    return least_norm(n, mean, s)
