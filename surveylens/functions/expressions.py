"""Column-expression builders (JVM-side, codegen friendly).

Every helper returns a ``Column``; nothing here triggers a job.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def col_of(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean_double(c: str | Column) -> Column:
    """``c`` as double with NaN as NULL: NaN stands for a missing value."""
    return F.nanvl(col_of(c).cast("double"), F.lit(None).cast("double"))


def missing_as(c: str | Column, value) -> Column:
    """``c`` in its own type, with NULL and NaN replaced by ``value``."""
    x = col_of(c)
    return F.when(x.isNull() | F.isnan(x.cast("double")), F.lit(value)).otherwise(x)


def lookup_map(mapping: Mapping) -> Column:
    """Literal map column built from a small, fixed dictionary."""
    items = []
    for k, v in mapping.items():
        items.append(F.lit(k))
        items.append(F.lit(v))
    return F.create_map(*items)


def recode(c: str | Column, mapping: Mapping) -> Column:
    """Code -> label; an unmapped or null code gives NULL (ANSI-safe lookup)."""
    return F.try_element_at(lookup_map(mapping), col_of(c))


def fixed_bins(c: str | Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Right-closed bins with the lowest edge included; outside or null -> NULL.

    Bin 0 is ``edges[0] <= x <= edges[1]``, bin i is ``edges[i] < x <= edges[i+1]``.
    """
    if len(edges) != len(labels) + 1:
        raise ValueError("need exactly one more edge than labels")
    if any(b <= a for a, b in zip(edges, edges[1:])):
        raise ValueError("bin edges must increase strictly")
    x = col_of(c)
    expr = None
    for i, label in enumerate(labels):
        lo, hi = edges[i], edges[i + 1]
        cond = ((x >= F.lit(lo)) if i == 0 else (x > F.lit(lo))) & (x <= F.lit(hi))
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr


def fixed_bin_index(c: str | Column, edges: Sequence[float],
                    labels: Sequence[str] | None = None) -> Column:
    """Same bins as :func:`fixed_bins` but returns the 0-based bin number."""
    if labels is not None and len(edges) != len(labels) + 1:
        raise ValueError("need exactly one more edge than labels")
    if any(b <= a for a, b in zip(edges, edges[1:])):
        raise ValueError("bin edges must increase strictly")
    x = col_of(c)
    expr = None
    for i in range(len(edges) - 1):
        lo, hi = edges[i], edges[i + 1]
        cond = ((x >= F.lit(lo)) if i == 0 else (x > F.lit(lo))) & (x <= F.lit(hi))
        expr = F.when(cond, F.lit(i)) if expr is None else expr.when(cond, F.lit(i))
    return expr


def null_skipping_sum(cols: Iterable[str | Column]) -> Column:
    """Row-wise sum that treats NULL and NaN as 0; an all-NULL row sums to 0."""
    parts = [missing_as(c, 0) for c in cols]
    if not parts:
        return F.lit(0)
    return reduce(lambda a, b: a + b, parts)


def reverse_score(c: str | Column, scale_min: int, scale_max: int) -> Column:
    """Reverse a Likert item: ``(min + max) - x``."""
    return F.lit(scale_min + scale_max) - col_of(c)


def pair_mean(a: str | Column, b: str | Column) -> Column:
    """Null-propagating mean of two items."""
    return (col_of(a) + col_of(b)) / F.lit(2)


def all_between(cols: Iterable[str | Column], lo: float, hi: float) -> Column:
    """True when every column lies in [lo, hi]; a NULL makes the row fail."""
    conds = [col_of(c).between(lo, hi) for c in cols]
    if not conds:
        return F.lit(True)
    return F.coalesce(reduce(lambda p, q: p & q, conds), F.lit(False))


def not_label(c: str | Column, label: str) -> Column:
    """``c != label`` that keeps NULL rows (pandas semantics of ``!=``)."""
    # as text: a label never equals a number, and the comparison must not cast it to one
    return ~col_of(c).cast("string").eqNullSafe(F.lit(label))


def group_labels(c: str | Column, groups: Mapping[str, Sequence[str]]) -> Column:
    """Many labels -> one group label; anything else -> NULL."""
    x = col_of(c)
    expr = None
    for group, members in groups.items():
        cond = x.isin(list(members))
        expr = F.when(cond, F.lit(group)) if expr is None else expr.when(cond, F.lit(group))
    return expr if expr is not None else F.lit(None).cast("string")


def age_from_year_or_age(c: str | Column, as_of_year: int, min_year: int = 1900,
                         min_age: int = 10) -> Column:
    """A value that looks like a birth year becomes an age; other values pass through."""
    x = col_of(c)
    return F.when(x.between(min_year, as_of_year - min_age), F.lit(as_of_year) - x).otherwise(x)


def rows_of(fields: Sequence[str], rows: Sequence[Sequence]) -> Column:
    """Generator column turning one wide row into several narrow ones.

    ``rows`` holds one tuple of Columns (or literals) per output row, in the
    order of ``fields``; use with ``select(..., rows_of(...))``. Labels are
    passed as literals, so any text (quotes, spaces) is safe.
    """
    structs = []
    for row in rows:
        parts = [(v if isinstance(v, Column) else F.lit(v)).alias(f) for f, v in zip(fields, row)]
        structs.append(F.struct(*parts))
    return F.inline(F.array(*structs))
