import os

from surveylens.streaming import clean_stream

from .survey_fixture import AS_OF_YEAR, iso_dim, raw_frame


def test_stream_matches_batch(spark, tmp_out):
    raw = raw_frame(spark, n=120, seed=3).drop("free_text", "device")
    src = os.path.join(tmp_out, "src")
    raw.coalesce(2).write.option("header", True).csv(src)
    schema = raw.schema
    q = clean_stream.start_clean_stream(spark, src, schema, os.path.join(tmp_out, "sink"),
                                        os.path.join(tmp_out, "ckpt"), AS_OF_YEAR,
                                        iso_dim(spark), trigger_once=True)
    q.awaitTermination(120)
    streamed = spark.read.parquet(os.path.join(tmp_out, "sink"))
    batch = clean_stream.clean_rows(raw, AS_OF_YEAR, iso_dim(spark))
    cols = sorted(batch.columns)
    assert sorted(streamed.columns) == cols
    a = sorted(tuple(map(repr, r)) for r in streamed.select(*cols).collect())
    b = sorted(tuple(map(repr, r)) for r in batch.select(*cols).collect())
    assert a == b and len(a) > 0
