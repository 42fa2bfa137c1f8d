from surveylens.operators import geo
from surveylens.sources.countries import ALIASES, country_dimension


def test_any_alias_in_any_case(spark):
    dim = country_dimension(spark)
    asked = ["germany", "DE", "deu", " GERMANY ", "Viet nam", "vietnam", "VNM", "Bolivia", "bolivia, plurinational state of",
             "NA", "nam", "Türkiye", "TURKEY", "Nowhere", "", None, "côte d'ivoire"]
    df = spark.createDataFrame([(a,) for a in asked], "country_name string")
    out = {r.country_name: r.iso_alpha_3 for r in geo.attach_codes(df, dim, aliases=[a for a in ALIASES if a in dim.columns]).collect()}
    assert len(out) == len(asked)
    assert [out[a] for a in asked] == ["DEU"] * 4 + ["VNM"] * 3 + ["BOL"] * 2 + ["NAM"] * 2 + ["TUR"] * 2 + [None] * 3 + ["CIV"]


def test_conflicts_go_to_the_first_column_then_the_smallest_code(spark):
    dim = spark.createDataFrame([("x", "Y", "c3"), ("y", "Z", "c2"), ("w", "z", "c1"), (None, "v", None)], "name string, short string, code string")
    out = {r.alias: r.code for r in geo.alias_table(dim, ["name", "short"], "code").collect()}
    assert out == {"x": "c3", "y": "c2", "w": "c1", "z": "c1"}
    out = {r.alias: r.code for r in geo.alias_table(dim, ["short", "name"], "code").collect()}
    assert out == {"x": "c3", "y": "c3", "w": "c1", "z": "c1"}
