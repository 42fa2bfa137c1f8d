"""Same results for 1, 4 and 17 input partitions; empty inputs give empty (or zero) results."""

import math

import pytest

from surveylens.functions import presets as P
from surveylens.operators import anova, crosstab, describe, geo
from surveylens.operators.quantiles import exact_quantiles

ORDERS = "/root/testdata/sf0.001/orders.parquet"


def _canon(df):
    def norm(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else f"{v:.10g}"
        return repr(v)
    cols = sorted(df.columns)
    return sorted(tuple(norm(r[c]) for c in cols) for r in df.collect())


OPS = {
    "crosstab": lambda o: crosstab.crosstab_bands(o, "o_orderpriority", "o_totalprice",
                                                  [0, 1e5, 2e5, 3e5, 4e5, 5e5],
                                                  ["a", "b", "c", "d", "e"]),
    "describe": lambda o: describe.describe_numeric(o, ["o_totalprice", "o_orderkey"]),
    "box": lambda o: describe.box_stats(o, ["o_orderpriority", "o_orderstatus"], "o_totalprice"),
    "anova": lambda o: anova.one_way_anova(o, "o_totalprice", ["o_orderpriority"])[0],
    "values": lambda o: describe.value_counts(o, ["o_orderstatus", "o_orderpriority"]),
    "means": lambda o: geo.mean_by(o, "o_orderpriority", "o_totalprice", with_count=True),
}


@pytest.mark.parametrize("op", sorted(OPS))
def test_partition_invariance(spark, op):
    base = spark.read.parquet(ORDERS)
    results = [_canon(OPS[op](base.repartition(n))) for n in (1, 4, 17)]
    assert results[0] == results[1] == results[2]
    assert results[0]


def test_empty_inputs(spark):
    empty = spark.read.parquet(ORDERS).where("o_totalprice < 0")
    # a global aggregate over no rows is one row of NULL (as in SQL)
    assert [r.m for r in exact_quantiles(empty, "o_totalprice", {"m": 0.5}).collect()] == [None]
    assert exact_quantiles(empty, "o_totalprice", {"m": 0.5}, by=["o_orderstatus"]).count() == 0
    d = describe.describe_numeric(empty, ["o_totalprice"]).collect()
    assert d[0]["count"] == 0 and d[0]["q50"] is None
    dist = crosstab.band_distribution(empty, "o_totalprice", P.SEVERITY_EDGES,
                                      P.SEVERITY_LABELS).collect()
    assert [r.n for r in dist] == [0] * 5 and all(r.pct is None for r in dist)
    assert anova.one_way_anova(empty, "o_totalprice", ["o_orderstatus"])[0].count() == 0
    assert describe.histogram(empty, "o_totalprice").count() == 0
