import math
import os
import subprocess
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
import __spark_entry__ as entry  # noqa: E402
from surveylens.plans.catalog import QUERIES  # noqa: E402

SF = "/root/testdata/sf0.001"
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "labels"]

def test_entry_smoke(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert len(rows) == 15
    assert df.columns == ["l_returnflag", "ord", "band", "n", "row_pct"]


def test_every_query_has_an_oracle():
    q, s = entry.queries(), entry.oracle_sql()
    assert set(s) <= set(q)
    assert set(QUERIES) <= set(s)


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9))
    return repr(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, duck, name):
    sdf = entry.queries()[name](spark, SF)
    scols = sdf.columns
    srows = sdf.collect()
    res = duck.execute(entry.oracle_sql()[name])
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    assert sorted(scols) == sorted(dcols)
    so = sorted(range(len(scols)), key=lambda i: scols[i])
    do = sorted(range(len(dcols)), key=lambda i: dcols[i])
    sv = sorted(tuple(_norm(r[i]) for i in so) for r in srows)
    dv = sorted(tuple(_norm(r[i]) for i in do) for r in drows)
    assert sv == dv


def test_survey_queries_without_the_libraries_of_the_others():
    """Another process in which ``xxhash`` cannot be imported."""
    code = ("import sys, warnings; sys.modules['xxhash'] = None; warnings.simplefilter('ignore'); "
            "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))")
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=os.path.dirname(entry.__file__))
    assert done.stdout.split() == [str(len(QUERIES))] * 2, done.stderr
