"""Sinks: S6–S9.

Large tables are written in parallel (one file per task, Parquet by
default); summary tables, which are a few rows, may be written as a single
CSV part.
"""

from __future__ import annotations

import os
from collections.abc import Mapping

from pyspark.sql import DataFrame


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                single_file: bool = False, header: bool = True,
                partition_by: list[str] | None = None) -> str:
    """Write one table; ``single_file`` only for small summaries."""
    out = df.coalesce(1) if single_file else df
    w = out.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    fmt = fmt.lower()
    if fmt == "csv":
        w.option("header", header).csv(path)
    elif fmt == "parquet":
        w.parquet(path)
    elif fmt == "json":
        w.json(path)
    elif fmt == "orc":
        w.orc(path)
    else:
        raise ValueError(f"Unsupported format {fmt!r}.")
    return path


def publish(tables: Mapping[str, DataFrame], out_dir: str, fmt: str = "csv",
            large: Mapping[str, DataFrame] | None = None, large_fmt: str = "parquet") -> dict:
    """Write every named summary table (single part) and every large table
    (parallel) under ``out_dir``; returns ``{name: path}``."""
    paths = {}
    for name, df in (large or {}).items():
        paths[name] = write_table(df, os.path.join(out_dir, "large", name), fmt=large_fmt)
    for name, df in tables.items():
        paths[name] = write_table(df, os.path.join(out_dir, "tables", name), fmt=fmt,
                                  single_file=True)
    return paths
