"""Sources: S1–S3 (delimited / JSON / Parquet tables) and S5 (boundary GeoJSON).

Scans are lazy; only the delimiter probe (the head of the first file) and
the GeoJSON key probe (schema metadata) run before the plan is built.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import presets as P

DELIMITERS = [",", ";", "\t"]


#: Bytes at the beginning of a file by which its delimiter is told.
HEAD_BYTES = 1 << 16


def _head(spark: SparkSession, path: str) -> tuple[str, bool]:
    """The first bytes of the first file under ``path`` as text, and whether they are all of it."""
    files = sorted(spark.read.text(path).inputFiles())
    if not files:
        return "", True
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(files[0]))
    stream = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(where)
    try:
        data = bytes(stream.readNBytes(HEAD_BYTES))
    finally:
        stream.close()
    return data.decode("utf-8", "ignore").removeprefix("\ufeff"), len(data) < HEAD_BYTES


def _records(head: str, whole: bool, sep: str) -> list[list[str]]:
    """Records of the head, quotes understood; one that may be cut off does not count."""
    rows = [r for r in csv.reader(io.StringIO(head, newline=""), delimiter=sep) if r]
    return rows if whole or len(rows) < 2 else rows[:-1]


def sniff_format(spark: SparkSession, path: str, candidates: Sequence[str] = DELIMITERS) -> tuple[str, bool]:
    """The delimiter of a file, and whether quoted fields hold line ends.

    Of the delimiters that give every record of the file's head the same number of fields, the one that gives
    most; if none does, the one whose header has most fields. A delimiter inside quotes parts nothing.
    """
    head, whole = _head(spark, path)
    parsed = {d: _records(head, whole, d) for d in candidates}
    counts = {d: [len(r) for r in rows] or [0] for d, rows in parsed.items()}
    even = [d for d in candidates if len(set(counts[d])) == 1 and counts[d][0] > 1]
    best = max(even or candidates, key=lambda d: counts[d][0])
    return best, any("\n" in v or "\r" in v for r in parsed[best] for v in r)


def sniff_delimiter(spark: SparkSession, path: str,
                    candidates: Sequence[str] = DELIMITERS) -> str:
    """The delimiter of a delimited file (``sniff_format``)."""
    return sniff_format(spark, path, candidates)[0]


def read_delimited(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
                   sep: str | None = None, na_tokens: Sequence[str] = P.DEFAULT_NA_TOKENS,
                   keep_literal: Sequence[str] = ("country",), infer: bool = True) -> DataFrame:
    """Header CSV/TSV scan with missing-value tokens.

    Columns are read as strings, missing-value tokens become NULL (except in
    ``keep_literal`` columns, so the country code ``NA`` survives), then
    each column is cast to ``schema`` (or, without a schema, to an inferred
    type when ``infer``). Quotes are doubled inside quoted fields. Files are read in splits unless the first
    one's head shows quoted line ends. Every file's header must be the first one's: files with
    another delimiter or other columns raise when they are read.
    """
    told, lines = sniff_format(spark, path)
    sep = sep or told
    raw = (spark.read.option("header", True).option("sep", sep).option("encoding", "UTF-8").option("escape", '"')
           .option("multiLine", lines).option("enforceSchema", False).option("inferSchema", False).csv(path))
    tokens = list(na_tokens)
    exprs = []
    for c in raw.columns:
        x = F.col(f"`{c}`")
        if c not in keep_literal and tokens:
            x = F.when(F.trim(x).isin(tokens) | x.isNull(), F.lit(None).cast("string")).otherwise(x)
        exprs.append(x.alias(c))
    df = raw.select(*exprs)
    if schema is not None:
        st = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
        casts = []
        for f in st.fields:
            if f.name in df.columns:
                casts.append(F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name))
        rest = [F.col(f"`{c}`") for c in df.columns if c not in set(st.fieldNames())]
        return df.select(*casts, *rest)
    if infer:
        return infer_numeric(df)
    return df


_NUMBER = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


def infer_numeric(df: DataFrame) -> DataFrame:
    """Cast string columns whose values all read as numbers (integers first).

    The decision is one aggregate over the whole table (every value is
    checked, as a whole-file reader would); the casts themselves stay lazy.
    Suffixes that a cast would accept ("1d", "2f") make a column text.
    """
    cols = df.columns
    if not cols:
        return df
    aggs = []
    for i, c in enumerate(cols):
        x = F.col(f"`{c}`")
        aggs += [F.count(x).alias(f"n{i}"),
                 F.count(F.when(x.rlike(r"^\s*[+-]?[0-9]+\s*$"), x.try_cast("bigint"))).alias(f"i{i}"),
                 F.count(F.when(x.rlike(_NUMBER), x.try_cast("double"))).alias(f"d{i}")]
    r = df.agg(*aggs).collect()[0]
    out = []
    for i, c in enumerate(cols):
        n = r[f"n{i}"]
        if n and r[f"i{i}"] == n:
            out.append(F.col(f"`{c}`").try_cast("bigint").alias(c))
        elif n and r[f"d{i}"] == n:
            out.append(F.col(f"`{c}`").try_cast("double").alias(c))
        else:
            out.append(F.col(f"`{c}`"))
    return df.select(*out)


def read_table(spark: SparkSession, source: str = "local", path: str | None = None,
               fmt: str | None = None, **options) -> DataFrame:
    """S3: dispatch by source / format; anything unknown is a ``ValueError``.

    ``local`` (the reference's only source) reads a delimited file;
    ``parquet``, ``json``, ``csv`` and ``orc`` use the matching reader.
    """
    if path is None:
        raise ValueError("a path is required")
    kind = (fmt or source).lower()
    if kind in ("local", "csv", "tsv", "delimited"):
        return read_delimited(spark, path, **options)
    if kind == "parquet":
        return spark.read.parquet(path)
    if kind == "orc":
        return spark.read.orc(path)
    if kind == "json":
        return spark.read.options(**options).json(path)
    raise ValueError(f"Unsupported source {source!r}.")


def read_geojson_features(spark: SparkSession, path: str) -> DataFrame:
    """One row per feature with its properties flattened; geometry kept as JSON text."""
    doc = spark.read.option("multiLine", True).json(path)
    feats = doc.select(F.explode("features").alias("f"))
    names = feats.schema["f"].dataType.fieldNames()
    sel = []
    prop_names = []
    if "properties" in names:
        sel.append("f.properties.*")
        prop_names = feats.schema["f"].dataType["properties"].dataType.fieldNames()
    if "id" in names and "id" not in prop_names:
        sel.append("f.id AS id")
    if "geometry" in names:
        gtype = feats.schema["f"].dataType["geometry"].dataType
        nested = isinstance(gtype, (T.StructType, T.ArrayType, T.MapType))
        sel.append("to_json(f.geometry) AS geometry" if nested
                   else "CAST(f.geometry AS STRING) AS geometry")
    else:
        sel.append("CAST(NULL AS STRING) AS geometry")
    return feats.selectExpr(*sel)


def read_iso_dimension(spark: SparkSession, path: str, sep: str | None = None) -> DataFrame:
    """Country dimension ``(alpha2, alpha3, name, continent)`` from a delimited file."""
    return read_delimited(spark, path, schema="alpha2 string, alpha3 string, name string, "
                                              "continent string", sep=sep, keep_literal=(
        "alpha2", "alpha3", "name", "continent"))
