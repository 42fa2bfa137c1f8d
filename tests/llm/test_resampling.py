import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from surveylens.llm import resampling

from .helpers import documents, empty, frame, prose, text_of

LABELS = "/root/testdata/sf0.01/labels.parquet"


def test_good_stay_and_bad_go(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = {r.doc_id: r for r in resampling.resample(docs, spark.read.parquet(LABELS)).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(LABELS).collect()}
    assert len(out) == docs.count()
    assert all(out[i].kept for i, q in labels.items() if q == 1)
    assert np.mean([out[i].kept for i, q in labels.items() if q == 0]) < 0.05


def brute_weights(rows, good, buckets):
    raw, target, per = np.ones(buckets), np.ones(buckets), {}
    for i, t in rows:
        data = np.frombuffer((t or "").encode(), np.uint8)
        bucket, _ = resampling.ngrams(data, np.array([0, len(data)]), resampling.WordTable(), buckets)
        per[i] = np.bincount(bucket, minlength=buckets)
        raw += per[i]
        target += per[i] * (i in good)
    ratio = np.log(target / target.sum()) - np.log(raw / raw.sum())
    return {i: (int(c.sum()), float(c @ ratio)) for i, c in per.items()}


def test_weights_by_brute_force(spark):
    rows = text_of(spark)
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    good = {r.doc_id for r in labels.filter("quality = 1").collect()}
    want = brute_weights(rows, good, resampling.BUCKETS)
    for r in resampling.resample(documents(spark), labels).collect():
        assert r.n_ngrams == want[r.doc_id][0] and r.log_weight == pytest.approx(want[r.doc_id][1], abs=1e-6)


def test_given_k_and_ties(spark):
    rows = [(i, prose(i, 40)) for i in range(30)] + [(100 + i, prose(i, 20).upper() + " !!") for i in range(10)]
    labels = spark.createDataFrame([(i, 1) for i in range(15)] + [(100 + i, 0) for i in range(5)], "doc_id long, quality int")
    for k in (0, 1, 7, 40, 99):
        out = resampling.resample(frame(spark, rows), labels, k=k).collect()
        assert sum(r.kept for r in out) == min(k, 40)
        keys = sorted((r.gumbel_key for r in out), reverse=True)
        assert all(r.kept == (r.gumbel_key >= keys[min(k, 40) - 1]) for r in out if k)
    twice = frame(spark, rows + rows[:1])
    assert sum(r.kept for r in resampling.resample(twice, labels, k=1).collect()) in (1, 2)


def test_awkward_rows(spark):
    rows = [(1, None), (2, ""), (3, "  "), (4, prose(1, 5000)), (None, "a b"), (4, prose(1, 5000))]
    none = spark.createDataFrame([], "doc_id long, quality int")
    odd = spark.createDataFrame([(4, None), (None, 1), (77, 1), (4, 1), (4, 0)], "doc_id long, quality int")
    for labels in (none, odd):
        out = resampling.resample(frame(spark, rows), labels).collect()
        assert len(out) == 6 and all(r.kept for r in out)
    kept = resampling.keep_sampled(frame(spark, rows), none)
    assert kept.count() == 6 and kept.columns == frame(spark, rows).columns
    assert resampling.resample(empty(spark), odd).collect() == []


@pytest.mark.parametrize("k", [1, 2, 5, 400, 999, 1000, 1001])
def test_kth_largest(spark, k):
    rng = np.random.default_rng(7)
    values = np.concatenate([rng.integers(-(1 << 62), 1 << 62, 700), rng.integers(-5, 5, 300)])
    df = spark.createDataFrame(pd.DataFrame({"v": values}))
    want = int(np.sort(values)[-k]) if k <= len(values) else None
    assert resampling.kth_largest(df, "v", k) == want


def test_gumbel_is_standard(spark):
    g = np.array([r[0] for r in spark.range(20000).select(F.col("id").alias("doc_id")).select(resampling.gumbel()).collect()])
    assert abs(g.mean() - 0.5772) < 0.04 and abs(g.var() - np.pi ** 2 / 6) < 0.1
