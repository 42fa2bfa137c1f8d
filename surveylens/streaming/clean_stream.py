"""The row-wise part of the survey cleaning, applied to a stream of raw files.

The source pipeline is batch only. Its row-wise steps (recode, age, lookup
of country and continent, scale sums, traits, validity screen) are
stateless column expressions and one stream-static broadcast join, so they
run unchanged on a streaming DataFrame. The data-dependent steps (column
drop by null ratio, quantile bins, standardising) need the whole table and
stay in the batch run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..functions import presets as P
from ..operators import clean


def clean_rows(df: DataFrame, as_of_year: int, iso_dim: DataFrame | None = None,
               keep_valid_only: bool = True) -> DataFrame:
    """Stateless cleaning chain; works for batch and streaming DataFrames alike."""
    out = clean.recode_categorical(df)
    out = clean.clean_age(out, as_of_year)
    if iso_dim is not None and "country" in out.columns:
        out = clean.attach_geography(out, iso_dim)
    out = clean.score_scales(out)
    out = clean.score_traits(out)
    out = clean.score_validity(out)
    if keep_valid_only:
        out = clean.screen_valid(out)
    return clean.select_existing(out, P.ANALYSIS_COLUMNS)


def read_raw_stream(spark: SparkSession, path: str, schema: T.StructType | str,
                    fmt: str = "csv", sep: str = ",", max_files_per_trigger: int | None = None
                    ) -> DataFrame:
    """File-source stream of raw survey rows (schema required for streams)."""
    reader = spark.readStream.schema(schema).format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True).option("sep", sep)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.load(path)


def start_clean_stream(spark: SparkSession, source: str, schema: T.StructType | str,
                       sink: str, checkpoint: str, as_of_year: int,
                       iso_dim: DataFrame | None = None, fmt: str = "csv",
                       trigger_once: bool = False):
    """Clean new raw files as they arrive and append them to a Parquet table.

    ``checkpoint`` must be on shared storage; the file sink plus the
    checkpoint give exactly-once output across restarts.
    """
    stream = clean_rows(read_raw_stream(spark, source, schema, fmt), as_of_year, iso_dim)
    writer = (stream.writeStream.format("parquet").option("path", sink)
              .option("checkpointLocation", checkpoint).outputMode("append"))
    if trigger_once:
        writer = writer.trigger(availableNow=True)
    return writer.start()
