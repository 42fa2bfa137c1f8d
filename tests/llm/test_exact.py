import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from surveylens.llm import exact

from .helpers import documents, empty, frame, text_of


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    return sorted((i, max((x for x in groups[t or ""] if x is not None), default=None), len(groups[t or ""]),
                   i == max((x for x in groups[t or ""] if x is not None), default=None),
                   hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows)


def result(df, **settings):
    return sorted((r.doc_id, r.keep_id, r.group_size, r.kept, bytes(r.digest).hex())
                  for r in exact.mark_copies(df, **settings).collect())


def test_whole_table(spark):
    assert result(documents(spark)) == brute(text_of(spark))


@pytest.mark.parametrize("history", ["true", "false", "doc_id < 4", "doc_id % 2 = 0"])
def test_any_history_gives_the_same_groups(spark, history):
    rows = [(1, "a"), (2, None), (3, "a"), (4, "b"), (5, ""), (6, "a "), (7, "a"), (8, "é"), (9, "é"), (1 << 60, "b")]
    assert result(frame(spark, rows), is_history=F.expr(history)) == brute(rows)


def test_empty_table_null_ids_and_repeats(spark):
    assert result(empty(spark)) == [] and exact.drop_copies(empty(spark)).collect() == []
    rows = [(None, "a"), (5, "a"), (5, "a"), (None, "only")]
    out = exact.mark_copies(frame(spark, rows)).collect()
    assert {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in out} == {
        (None, 5, 3, False), (5, 5, 3, True), (None, None, 1, True)}
    kept = exact.drop_copies(frame(spark, rows))
    assert sorted((r.doc_id or 0, r.text) for r in kept.collect()) == [(0, "only"), (5, "a")]
    assert kept.columns == frame(spark, rows).columns


def test_hash_is_minimal_and_rejects_nonmembers():
    digest = np.frombuffer(b"".join(hashlib.sha256(str(i).encode()).digest() for i in range(3000)), np.uint8).reshape(-1, 32)
    levels = exact.build_hash(digest[:2000])
    assert sorted(exact.slots_of(digest[:2000], levels)) == list(range(2000))
    other = exact.slots_of(digest[2000:], levels)
    assert (other < 2000).all() and (other >= 0).any()  # they hash to slots: the bytes must be compared
    with pytest.raises(ValueError):
        exact.build_hash(np.concatenate([digest[:5], digest[:5]]))


def test_small_shards(spark):
    rows = [(i, f"text {i % 37}") for i in range(200)]
    groups = exact.copy_groups(exact.digests(frame(spark, rows)), F.col("doc_id") < 90, shard_keys=5).collect()
    assert len(groups) == 37 and sum(g.group_size for g in groups) == 200
    assert {g.keep_id for g in groups} == set(range(163, 200))


def test_shards_follow_the_larger_side(spark, monkeypatch):
    asked, lookup = [], exact.lookup
    monkeypatch.setattr(exact, "lookup", lambda new, index, shards: asked.append(shards) or lookup(new, index, shards))
    # one far smaller id: it is the whole history
    rows = [(-10**12, "text 0")] + [(i, f"text {i % 50}") for i in range(100)]
    out = exact.copy_groups(exact.digests(frame(spark, rows), "doc_id", "text"), F.col("doc_id") < 0, shard_keys=10).collect()
    assert asked == [5]
    assert sorted((r.keep_id, r.group_size) for r in out) == [(50 + i, 3 if i == 0 else 2) for i in range(50)]


def test_clashing_names_and_null_beside_empty(spark):
    """Columns named like helpers of the operator; (5, null) and (5, '') are one document."""
    rows = [(5, None, 1, 2), (5, "", 1, 2), (6, "x", 1, 2), (7, "x", 1, 2), (7, "x", 1, 2), (7, "y", 1, 2), (None, "z", 1, 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _digest int, _keep int")
    out = exact.drop_copies(df)
    assert out.columns == df.columns
    assert sorted(((r.doc_id, r.text or "") for r in out.collect()), key=repr) == sorted(
        [(5, ""), (7, "x"), (7, "y"), (None, "z")], key=repr)
