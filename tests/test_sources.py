import json
import os

import pytest

from surveylens.operators import geo
from surveylens.sources import readers, writers


def test_delimited_semicolon_and_na_tokens(spark, tmp_out):
    p = os.path.join(tmp_out, "raw.csv")
    with open(p, "w", encoding="utf-8") as fh:
        fh.write("gender;age;country;note\n1;25;NA;NA\n2;N/A;NONE;x\n;30;US;null\n")
    df = readers.read_table(spark, "local", p)
    rows = [tuple(r) for r in df.orderBy("age").collect()]
    assert dict(df.dtypes)["gender"] == "bigint" and dict(df.dtypes)["age"] == "bigint"
    assert ("1" if False else 1, 25, "NA", None) in rows      # Namibia survives, NA note -> null
    assert (2, None, "NONE", "x") in rows
    assert (None, 30, "US", None) in rows


def test_tab_separated_with_schema(spark, tmp_out):
    p = os.path.join(tmp_out, "raw.tsv")
    with open(p, "w", encoding="utf-8") as fh:
        fh.write("a\tb\n1\t2.5\n3\tnan\n")
    df = readers.read_delimited(spark, p, schema="a int, b double")
    assert [tuple(r) for r in df.orderBy("a").collect()] == [(1, 2.5), (3, None)]


def test_unknown_source(spark):
    with pytest.raises(ValueError):
        readers.read_table(spark, "remote", "/x")


def test_geojson_and_choropleth(spark, tmp_out):
    p = os.path.join(tmp_out, "world.geojson")
    doc = {"type": "FeatureCollection", "features": [
        {"type": "Feature", "properties": {"ISO_A3": "FRA", "name": "France"},
         "geometry": {"type": "Point", "coordinates": [1, 2]}},
        {"type": "Feature", "properties": {"ISO_A3": "XXX", "name": "Nowhere"},
         "geometry": {"type": "Point", "coordinates": [3, 4]}}]}
    with open(p, "w") as fh:
        json.dump(doc, fh)
    world = readers.read_geojson_features(spark, p)
    assert geo.detect_key(world.columns) == "ISO_A3"
    means = spark.createDataFrame([("France", 30.0, "FRA")], "country_name string, "
                                  "mean_anxiety double, iso_alpha_3 string")
    out = {r.name: r.mean_anxiety for r in geo.choropleth_table(world, means).collect()}
    assert out == {"France": 30.0, "Nowhere": None}
    assert geo.choropleth_table(world.drop("ISO_A3"), means) is None


def test_write_table_formats(spark, tmp_out):
    df = spark.createDataFrame([(1, "a")], "x int, y string")
    for fmt in ("csv", "parquet", "json"):
        path = writers.write_table(df, os.path.join(tmp_out, fmt), fmt=fmt, single_file=True)
        assert os.path.isdir(path)
    with pytest.raises(ValueError):
        writers.write_table(df, os.path.join(tmp_out, "bad"), fmt="xls")
