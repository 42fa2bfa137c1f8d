import contextlib
import io

from surveylens.session import bounded_broadcast, ensure_checkpoint_dir


def _plan(df):
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain()
    return buf.getvalue()


def test_bounded_broadcast_hint_only_within_bound(spark):
    big = spark.range(1000).withColumnRenamed("id", "k")
    small = spark.range(10).withColumnRenamed("id", "k")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        hinted = big.join(bounded_broadcast(small, 10 * 24), "k")
        assert "BroadcastHashJoin" in _plan(hinted)
        unhinted = big.join(bounded_broadcast(small, 10 * 24 - 1), "k")
        assert "BroadcastHashJoin" not in _plan(unhinted)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_broadcast_size_counts_the_bytes_of_texts(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        wide = spark.createDataFrame([(1, "x" * 1000)], "k long, t string")
        big = spark.range(10).withColumnRenamed("id", "k")
        assert "BroadcastHashJoin" not in _plan(big.join(bounded_broadcast(wide, 1000), "k"))
        assert "BroadcastHashJoin" in _plan(big.join(bounded_broadcast(wide, 1024), "k"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_checkpoint_dir_is_set(spark):
    assert ensure_checkpoint_dir(spark)
