"""Exact, linearly interpolated quantiles (A24) — the building block of
describe, box statistics and quantile groups.

Method ``"exact"`` (the default) finds order statistics in two scans: a sketch of every group
brackets each wanted share, a count of what lies below, inside and above the brackets gives the
values (``_bracketed``). Ranks that this leaves open, in very large groups or by a sketch that
is off, are found by counting passes. Each pass divides every
interval that still holds a wanted rank into up to ``BUCKETS`` parts and counts
its rows per part, with the smallest and largest value of each; the part that
holds the rank is the next interval. An interval of one value is an answer, so
a value that is a third of all rows ends its search at once; an interval of at most
``BUCKETS`` rows is counted value by value, which ends it too. Counting is a
partial + final hash aggregate: what is shuffled is at most tasks x intervals
x parts, whatever the number of rows; nothing is sorted, no group meets in one
task, and the intervals are rows of a DataFrame joined back by group, so the
number of groups has no bound. Only those intervals (one row per group and
wanted rank) are kept between passes, many of them in the checkpoint folder.

``"countmap"`` is Spark's exact ``percentile`` aggregate: one pass, memory
grows with a group's distinct values, right for coded answers. ``"approx"`` is
``percentile_approx`` (bounded memory, rank error ``1/accuracy``).

Interpolation follows the usual definition: with ``n`` sorted values and
``pos = p * (n - 1)``, the result is ``x[floor] + (pos - floor) * (x[ceil] - x[floor])``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import clean_double
from ..session import MAX_BROADCAST_BYTES, ensure_checkpoint_dir, table_size

# Parts that a pass divides an interval into.
BUCKETS = 4096
# Intervals that are kept as a local relation between passes.
HELD_ROWS = 4096
# A sketch's marks are off by one part in ACCURACY of the rows at most; brackets reach twice as far.
ACCURACY = 10_000
MARGIN = 2 / ACCURACY
# Groups of more rows have too many values in a bracket for one array: it is divided like any interval.
VALUE_ROWS = BUCKETS * ACCURACY // 8


def exact_quantiles(df: DataFrame, value: str, probs: Mapping[str, float],
                    by: Sequence[str] = (), method: str = "exact",
                    accuracy: int = 10_000) -> DataFrame:
    """Quantiles of ``value`` per ``by`` group, one output column per entry of ``probs``.

    NULL and NaN values are ignored; a group with no values is absent; a NULL
    group is a group.
    """
    by = list(by)
    base = df.select(*[F.col(c) for c in by], clean_double(value).alias("_v")).where(F.col("_v").isNotNull())
    if method == "countmap":
        return base.groupBy(*by).agg(*[F.percentile("_v", float(p)).alias(n) for n, p in probs.items()])
    if method == "approx":
        return base.groupBy(*by).agg(
            *[F.percentile_approx("_v", float(p), accuracy).alias(n) for n, p in probs.items()])
    if method != "exact":
        raise ValueError(f"unknown quantile method {method!r}")
    return _counted(base, by, probs)


def _same_group(left: DataFrame, right: DataFrame, by: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [left[c].eqNullSafe(right[f"_g_{c}"]) for c in by], F.lit(True))


def _renamed(frame: DataFrame, by: Sequence[str]) -> DataFrame:
    return frame.withColumnsRenamed({c: f"_g_{c}" for c in by})


def _part(lo: Column, hi: Column, k: Column, by_magnitude: bool) -> Column:
    """Number of the part of [lo, hi] that ``_v`` falls in; never decreases with
    ``_v``, and lo and hi fall in different parts. Equal widths of the values, or of
    their logarithms (long tails), by turns."""
    def scaled(x: Column) -> Column:
        finite = F.greatest(F.least(x, F.lit(1.7e308)), F.lit(-1.7e308))
        return F.signum(finite) * F.log1p(F.abs(finite)) if by_magnitude else finite / 2
    width = scaled(hi) - scaled(lo)
    inside = F.floor((scaled(F.col("_v")) - scaled(lo)) / width * k)
    part = F.when(width > 1e-9 if by_magnitude else width > 0, F.least(inside, k - 1))
    half = F.floor((F.col("_v") / 2 - lo / 2) / (hi / 2 - lo / 2) * k)
    fallback = F.when(hi / 2 - lo / 2 > 0, F.least(half, k - 1)).otherwise((F.col("_v") > lo).cast("bigint"))
    return F.when(F.col("_v") >= hi, k - 1).otherwise(F.coalesce(part, fallback)).cast("bigint")


def _held(df: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame | None]:
    """The intervals, cut from their lineage, and those of them that still hold several
    values (None: no more). A small table (``HELD_ROWS``) becomes a local relation, without
    files or further jobs; a larger one is written to the checkpoint folder."""
    keys = [*by, "lo", "hi", "rows"]
    table = df.limit(HELD_ROWS + 1).toArrow()
    if table.num_rows <= HELD_ROWS:
        spans = table.filter(pc.less(table["lo"], table["hi"])).group_by(keys).aggregate([])
        held = df.sparkSession.createDataFrame(table, df.schema)
        if not spans.num_rows:
            return held, None
        return held, F.broadcast(df.sparkSession.createDataFrame(spans, df.select(*keys).schema))
    held = df.checkpoint()
    # several ranks of a group may share an interval; intervals of a group do not overlap
    spans = held.where("lo < hi").select(*keys).distinct()
    n_spans, n_bytes = table_size(spans)
    if not n_spans:
        return held, None
    return held, F.broadcast(spans) if n_bytes <= MAX_BROADCAST_BYTES else spans


def _kept(df: DataFrame) -> tuple[DataFrame, bool]:
    """A small table as a local relation (True), a larger one in the checkpoint folder."""
    table = df.limit(HELD_ROWS + 1).toArrow()
    if table.num_rows <= HELD_ROWS:
        return df.sparkSession.createDataFrame(table, df.schema), True
    return df.checkpoint(), False


def _bracketed(base: DataFrame, by: list[str], probs: Mapping[str, float]) -> DataFrame:
    """``by, n, lo, hi, before, rows, rank`` after two scans: one sketch of every group, whose marks on both
    sides of each wanted share bracket it, and one count. The rows inside a bracket are counted value by
    value, those between brackets as one part each; so a rank inside its bracket is found (lo = hi),
    and should a sketch be off, its rank lies in a part that the counting passes divide further."""
    ensure_checkpoint_dir(base.sparkSession)
    marks = [x for p in probs.values() for x in (max(0.0, p - MARGIN), min(1.0, p + MARGIN))]
    sketch = F.percentile_approx("_v", F.array(*[F.lit(float(x)) for x in marks]), ACCURACY)
    groups, small = _kept(base.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), sketch.alias("marks")).where("n > 0"))
    right = _renamed(groups, by)
    if small or table_size(groups.drop("marks"))[1] * len(marks) <= MAX_BROADCAST_BYTES:
        right = F.broadcast(right)
    rows = base.join(right, _same_group(base, right, by))
    v = F.col("_v")
    pairs = [(F.col("marks")[k], F.col("marks")[k + 1]) for k in range(0, len(marks), 2)]
    inside = reduce(lambda x, y: x | y, [v.between(lo, hi) for lo, hi in pairs])
    # a step function of the value: between two steps lie no marks
    step = reduce(lambda x, y: x + y, [(v >= lo).cast("int") + (v > hi).cast("int") for lo, hi in pairs])
    exact = F.when(inside & (F.col("n") <= VALUE_ROWS), v)
    keys = [f"_g_{c}" for c in by]
    cells = rows.select(*keys, "n", "_v", step.alias("step"), exact.alias("value")).groupBy(*keys, "n", "step", "value").agg(
        F.count(F.lit(1)).alias("count"), F.min("_v").alias("next_lo"), F.max("_v").alias("next_hi"))
    whole = cells.groupBy(*keys, "n").agg(F.array_sort(F.collect_list(F.struct("next_lo", "next_hi", "count"))).alias("parts"))
    # ranks below and above every wanted position, counted from 0
    ranks = F.array_distinct(F.array(*[
        r for p in probs.values() for r in (
            F.floor(F.lit(float(p)) * (F.col("n") - 1)), F.ceil(F.lit(float(p)) * (F.col("n") - 1)))]))
    asked = whole.select(*[F.col(f"_g_{c}").alias(c) for c in by], "n", "parts", F.explode(ranks).alias("rank"))
    nothing = F.lit(0).cast("bigint")
    start = F.struct(nothing.alias("before"), F.lit(False).alias("found"), F.lit(0.0).alias("lo"), F.lit(0.0).alias("hi"), nothing.alias("rows"))
    held = _holding(start)
    return asked.select(*by, "n", held.alias("_h"), "rank").select(*by, "n", "_h.lo", "_h.hi", "_h.before", "_h.rows", "rank")


def _holding(start: Column) -> Column:
    """Walk over ``parts`` in order: the one that holds ``rank``, and the rows before it."""
    return F.aggregate("parts", start, lambda a, x: F.when(a["found"], a).when(
        a["before"] + x["count"] > F.col("rank"),
        F.struct(a["before"].alias("before"), F.lit(True).alias("found"),
                 x["next_lo"].alias("lo"), x["next_hi"].alias("hi"), x["count"].alias("rows"))).otherwise(
        F.struct((a["before"] + x["count"]).alias("before"), F.lit(False).alias("found"),
                 a["lo"].alias("lo"), a["hi"].alias("hi"), a["rows"].alias("rows"))))


def _counted(base: DataFrame, by: list[str], probs: Mapping[str, float]) -> DataFrame:
    open_, spans = _held(_bracketed(base, by, probs), by)
    done = [open_.where("lo >= hi")]
    by_magnitude = False
    while spans is not None:
        spans = _renamed(spans, by)
        rows = base.join(spans, _same_group(base, spans, by) & base["_v"].between(spans["lo"], spans["hi"]))
        keys = [f"_g_{c}" for c in by] + ["lo", "hi"]
        part = F.when(F.col("rows") <= BUCKETS, F.col("_v")).otherwise(
            _part(F.col("lo"), F.col("hi"), F.lit(BUCKETS), by_magnitude).cast("double"))
        parts = rows.select(*keys, "_v", part.alias("part")).groupBy(
            *keys, "part").agg(F.count(F.lit(1)).alias("count"), F.min("_v").alias("next_lo"), F.max("_v").alias("next_hi"))
        open_, spans = _held(_narrowed(open_.where("lo < hi"), parts, by), by)
        done.append(open_.where("lo >= hi"))
        by_magnitude = not by_magnitude
    return _interpolated(reduce(DataFrame.unionByName, done), by, probs)


def _narrowed(open_: DataFrame, parts: DataFrame, by: list[str]) -> DataFrame:
    """The part of each open interval that holds its rank. An interval's parts
    (at most ``BUCKETS``) are put in order as one array."""
    keys = [f"_g_{c}" for c in by] + ["lo", "hi"]
    ordered = parts.groupBy(*keys).agg(F.array_sort(F.collect_list(
        F.struct("part", "count", "next_lo", "next_hi"))).alias("parts"))
    own = ordered.withColumnsRenamed({"lo": "_lo", "hi": "_hi"})
    joined = open_.join(own, _same_group(open_, own, by) & (open_["lo"] == own["_lo"]) & (open_["hi"] == own["_hi"]))
    # walk over the parts: rows before the part that holds the rank, and its range
    start = F.struct(F.col("before").alias("before"), F.lit(False).alias("found"),
                     F.col("lo").alias("lo"), F.col("hi").alias("hi"), F.col("rows").alias("rows"))
    held = _holding(start)
    return joined.select(*by, "n", held.alias("_h"), "rank").select(
        *by, "n", "_h.lo", "_h.hi", "_h.before", "_h.rows", "rank")


def _interpolated(found: DataFrame, by: list[str], probs: Mapping[str, float]) -> DataFrame:
    aggs = []
    for i, p in enumerate(probs.values()):
        position = F.lit(float(p)) * (F.col("n") - 1)
        aggs += [F.max(F.when(F.col("rank") == F.floor(position), F.col("lo"))).alias(f"_a{i}"),
                 F.max(F.when(F.col("rank") == F.ceil(position), F.col("lo"))).alias(f"_b{i}"),
                 F.max(position - F.floor(position)).alias(f"_f{i}")]
    wide = found.groupBy(*by).agg(*aggs)
    return wide.select(*by, *[
        F.when(F.col(f"_a{i}") == F.col(f"_b{i}"), F.col(f"_a{i}")).otherwise(
            F.col(f"_a{i}") + F.col(f"_f{i}") * (F.col(f"_b{i}") - F.col(f"_a{i}"))).alias(name)
        for i, name in enumerate(probs)])
