"""Registered queries: every survey operator run over the driver's tables.

Each query reads whole tables (``sf_dir/<table>.parquet``), applies the
library operators with parameters that fit the table, and returns a lazy
DataFrame. ``ORACLE_SQL`` holds the equivalent DuckDB SQL. Tree models are
stated by what SQL can say of them (ranges, sums); the tests hold them
against closed forms.

Floating results are rounded to a fixed number of digits on both sides so
that summation order cannot change the comparison.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import expressions as E
from ..functions import presets as P
from ..operators import anova, bins, clean, crosstab, describe, geo, models, scale

R = 6  # digits kept for floating comparisons

# Parameters of the registered queries (bands for the TPC-H-like columns)
QTY_EDGES = [0, 10, 20, 30, 40, 50]
QTY_LABELS = ["q00_10", "q10_20", "q20_30", "q30_40", "q40_50"]
SIZE_EDGES = [0, 14, 18, 26, 34, 45]
STATUS_MAP = {"F": "Finished", "O": "Open"}
SEGMENT_GROUPS = {"Consumer": ["AUTOMOBILE", "HOUSEHOLD"], "Business": ["BUILDING", "MACHINERY"]}
AS_OF_YEAR = 2026


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _r(c, digits: int = R):
    return F.round(c, digits)


def _status_labels(orders: DataFrame) -> DataFrame:
    """F -> "No response", O -> "Open", P -> NULL (an unmapped code)."""
    return orders.withColumn("status_label", E.recode("o_orderstatus",
                                                      {"F": P.NO_RESPONSE, "O": "Open"}))


# --- crosstabs and bands ---------------------------------------------------------

def q_severity_by_group(spark, d):
    li = _t(spark, d, "lineitem")
    out = crosstab.crosstab_bands(li, "l_returnflag", "l_quantity", QTY_EDGES, QTY_LABELS,
                                  band="band", complete=True)
    return out.withColumn("row_pct", _r(F.col("row_pct")))


def q_severity_summary(spark, d):
    part = _t(spark, d, "part")
    out = crosstab.band_distribution(part, "p_size", SIZE_EDGES, P.SEVERITY_LABELS, band="band")
    return out.withColumn("pct", _r(F.col("pct")))


def q_crosstab_observed(spark, d):
    o = _t(spark, d, "orders")
    out = crosstab.crosstab_observed(o, "o_orderpriority", "o_orderstatus", normalize=True)
    return out.withColumn("row_pct", _r(F.col("row_pct")))


def q_age_bands(spark, d):
    part = _t(spark, d, "part").select("p_partkey", "p_size")
    return bins.add_age_group(part, source="p_size", out="age_group")


# --- row-wise cleaning ---------------------------------------------------------------

def q_recode_labels(spark, d):
    o = _t(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    return clean.recode_categorical(o, {"o_orderstatus": (STATUS_MAP, "status_label")})


def q_regroup_labels(spark, d):
    c = _t(spark, d, "customer").select("c_custkey", "c_mktsegment")
    return bins.regroup_labels(c, "c_mktsegment", "segment_group", SEGMENT_GROUPS)


def q_age_or_year(spark, d):
    o = _t(spark, d, "orders")
    raw = F.when(F.pmod(F.col("o_orderkey"), F.lit(2)) == 0,
                 F.year("o_orderdate").cast("bigint")).otherwise(
        F.pmod(F.col("o_orderkey"), F.lit(120)))
    base = o.select("o_orderkey", raw.cast("bigint").alias("raw_value"))
    out = clean.clean_age(base, AS_OF_YEAR, source="raw_value", out="age_clean")
    return out.withColumn("age_clean", F.col("age_clean").cast("bigint"))


def _nation_dim(spark, d) -> DataFrame:
    n, r = _t(spark, d, "nation"), _t(spark, d, "region")
    return n.join(r, n.n_regionkey == r.r_regionkey).select(
        "n_nationkey", "n_name", "r_name")


def q_geo_lookup(spark, d):
    # codes that no dimension row has, and NULL codes, besides the matching ones
    code = F.when(F.col("s_suppkey") % 10 == 3, F.col("s_nationkey") + 100).when(
        F.col("s_suppkey") % 10 != 7, F.col("s_nationkey"))
    s = _t(spark, d, "supplier").select("s_suppkey", code.alias("s_code"))
    return clean.attach_geography(s, _nation_dim(spark, d), code_col="s_code", dim_code="n_nationkey",
                                  dim_name="n_name", dim_continent="r_name",
                                  case_insensitive=False)


def _lineitem_items(spark, d):
    li = _t(spark, d, "lineitem")
    return li.select("l_orderkey", "l_linenumber", "l_quantity",
                     F.nullif("l_tax", F.lit(0.0)).alias("tax_item"),
                     F.nullif("l_discount", F.lit(0.0)).alias("disc_item"))


def q_scale_sums(spark, d):
    base = _lineitem_items(spark, d)
    out = clean.score_scales(base, {"s1": ["l_quantity", "tax_item"], "s2": ["disc_item"]},
                             total="s_all")
    return out.select("l_orderkey", "l_linenumber", _r(F.col("s1")).alias("s1"),
                      _r(F.col("s2")).alias("s2"), _r(F.col("s_all")).alias("s_all"))


def q_reverse_pair_mean(spark, d):
    li = _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber",
                                         (F.col("l_quantity") / 5).alias("qty5"))
    out = clean.score_traits(li, reverse={"l_linenumber": "line_rev"},
                             pairs={"trait": ("line_rev", "qty5")}, scale_min=1, scale_max=7)
    return out.select("l_orderkey", "l_linenumber", "line_rev", _r(F.col("trait")).alias("trait"))


def q_validity_screen(spark, d):
    lab = _t(spark, d, "labels")
    out = clean.score_validity(lab, real_items=["quality"], fake_items=["toxic"])
    return clean.screen_valid(out).select("doc_id", "vcl_score", "vcl_invalid", "vcl_valid")


def q_drop_missing(spark, d):
    ev = _t(spark, d, "events").select(
        "event_id", "user_id", "event_type", "value",
        F.when(F.col("value") >= 20, F.col("props")).alias("sparse_note"),
        F.when(F.col("value") >= 1, F.col("event_type")).alias("near_full"))
    return clean.drop_sparse_columns(ev, threshold=0.20)


def q_exclude_label_keep_null(spark, d):
    o = _status_labels(_t(spark, d, "orders")).select("o_orderkey", "status_label")
    return clean.exclude_label_keep_null(o, ["status_label"])


def q_exclude_label_notnull(spark, d):
    o = _status_labels(_t(spark, d, "orders")).select("o_orderkey", "status_label")
    return clean.exclude_labels_not_null(o, "status_label")


def q_select_rename(spark, d):
    c = _t(spark, d, "customer")
    out = clean.select_existing(c, ["c_custkey", "c_name", "c_acctbal", "c_not_there"])
    return clean.rename_columns(out, {"c_name": "customer_name", "c_acctbal": "balance"})


# --- data-dependent transforms --------------------------------------------------------------

def q_quantile_groups(spark, d):
    c = _t(spark, d, "customer").select("c_custkey", "c_acctbal")
    g = bins.quantile_groups(c, ["c_acctbal"], n_groups=3, ties="skip")
    return g.groupBy("c_acctbal_group").agg(
        F.count(F.lit(1)).alias("n"), F.min("c_acctbal").alias("min_bal"),
        F.max("c_acctbal").alias("max_bal"))


def q_severity_by_tertile(spark, d):
    li = _t(spark, d, "lineitem").select("l_extendedprice", "l_quantity")
    g = bins.quantile_groups(li, ["l_extendedprice"], n_groups=3, ties="keep",
                             names={"l_extendedprice": "price_group"})
    out = crosstab.crosstab_bands(g, "price_group", "l_quantity", QTY_EDGES, QTY_LABELS,
                                  band="band", complete=True, row_levels=P.TERTILE_LABELS)
    return out.withColumn("row_pct", _r(F.col("row_pct")))


def q_standardize(spark, d):
    c = _t(spark, d, "customer").select("c_custkey", "c_acctbal")
    out = scale.standardize(c, ["c_acctbal"])
    return out.select("c_custkey", _r(F.col("c_acctbal_std")).alias("c_acctbal_std"))


def q_one_hot(spark, d):
    c = _t(spark, d, "customer").select("c_custkey", "c_mktsegment")
    return scale.one_hot(c, ["c_mktsegment"])


def q_inverse_freq_weights(spark, d):
    o = _t(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    out = scale.inverse_frequency_weights(o, "o_orderpriority", "weight")
    return out.select("o_orderkey", _r(F.col("weight")).alias("weight"))


# --- geography-style aggregates ----------------------------------------------------------------

def q_group_means(spark, d):
    o = _t(spark, d, "orders").select("o_custkey", "o_totalprice")
    c = _t(spark, d, "customer").select("c_custkey", "c_nationkey")
    rows = (o.join(c, o.o_custkey == c.c_custkey)
             .join(_nation_dim(spark, d), F.col("c_nationkey") == F.col("n_nationkey")))
    out = geo.mean_by(rows, "r_name", "o_totalprice", "mean_totalprice", with_count=True)
    return out.withColumn("mean_totalprice", _r(F.col("mean_totalprice")))


def _customer_nations(spark, d) -> DataFrame:
    c = _t(spark, d, "customer").select("c_nationkey", "c_acctbal")
    n = _t(spark, d, "nation").select("n_nationkey", "n_name")
    return c.join(n, c.c_nationkey == n.n_nationkey)


def q_country_mean_iso(spark, d):
    means = geo.mean_by(_customer_nations(spark, d), "n_name", "c_acctbal", "mean_acctbal")
    dim = _t(spark, d, "nation")
    out = geo.attach_codes(means, dim, name_col="n_name", dim_name="n_name",
                           dim_code="n_nationkey", out="n_nationkey")
    return out.select("n_name", _r(F.col("mean_acctbal")).alias("mean_acctbal"), "n_nationkey")


def q_country_alias(spark, d):
    """Nations asked for by name or by a short form that several share, in any case, with blanks."""
    nation = _t(spark, d, "nation").withColumn("short", F.substring("n_name", 1, 3))
    asked = nation.select(F.inline(F.array(*[F.struct(x.alias("asked")) for x in (
        F.lower("n_name"), F.concat(F.lit("  "), F.col("n_name"), F.lit(" ")), F.initcap("short"), F.concat("n_name", F.lit("?")))])))
    out = geo.attach_codes(asked.distinct(), nation, "asked", dim_code="n_nationkey", out="n_nationkey", aliases=["n_name", "short"])
    return out.select("asked", "n_nationkey")


def q_choropleth_table(spark, d):
    means = geo.mean_by(_t(spark, d, "customer"), "c_nationkey", "c_acctbal", "mean_acctbal")
    nations = _t(spark, d, "nation").select("n_nationkey", "n_name")
    # features without a mean, besides the matching ones
    world = nations.unionByName(nations.select((F.col("n_nationkey") + 100).alias("n_nationkey"), "n_name"))
    out = geo.choropleth_table(world, means, means_key="c_nationkey", key="n_nationkey")
    return out.select("n_nationkey", "n_name", _r(F.col("mean_acctbal")).alias("mean_acctbal"))


def q_top10_mean(spark, d):
    means = geo.mean_by(_customer_nations(spark, d), "n_name", "c_acctbal", "mean_acctbal")
    out = geo.top_k(means, "mean_acctbal", "n_name", 10)
    return out.select("n_name", _r(F.col("mean_acctbal")).alias("mean_acctbal"))


def q_top10_count(spark, d):
    counts = geo.count_by(_customer_nations(spark, d), "n_name", "n_customers")
    return geo.top_k(counts, "n_customers", "n_name", 10)


# --- descriptive --------------------------------------------------------------------------------

LI_NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def q_describe_numeric(spark, d):
    li = _t(spark, d, "lineitem")
    out = describe.describe_numeric(li, LI_NUMERIC)
    return out.select("variable", "count", *[_r(F.col(c)).alias(c) for c in
                                             ["mean", "std", "min", "q25", "q50", "q75", "max"]],
                      "missing")


def q_value_counts(spark, d):
    o = _status_labels(_t(spark, d, "orders"))
    out = describe.value_counts(o, ["status_label", "o_orderpriority"])
    return out.withColumn("proportion", _r(F.col("proportion")))


def _label_orders(spark, d):
    o = _status_labels(_t(spark, d, "orders"))
    return o.withColumn("priority_label", F.when(F.col("o_orderpriority") == "5-LOW",
                                                 F.lit(P.NO_RESPONSE))
                        .otherwise(F.col("o_orderpriority")))


def q_nonresponse(spark, d):
    o = _label_orders(spark, d)
    out = describe.nonresponse_table(o, ["status_label", "priority_label", "missing_label"])
    return out.withColumn("pct_no_response", _r(F.col("pct_no_response")))


def q_box_stats(spark, d):
    o = _t(spark, d, "orders")
    out = describe.box_stats(o, ["o_orderpriority", "o_orderstatus"], "o_totalprice")
    return out.select("factor", "level", "count", *[_r(F.col(c)).alias(c) for c in
                                                    ["mean", "std", "min", "q1", "median",
                                                     "q3", "max"]])


def q_box_stats_global(spark, d):
    o = _t(spark, d, "orders")
    out = describe.box_stats_global(o, "o_totalprice")
    return out.select("count", *[_r(F.col(c)).alias(c) for c in
                                 ["mean", "median", "q25", "q75", "min", "max"]])


def q_histogram(spark, d):
    li = _t(spark, d, "lineitem")
    out = describe.histogram(li, "l_quantity", bins=43)
    return out.select("bin", _r(F.col("lo")).alias("lo"), _r(F.col("hi")).alias("hi"), "n")


def q_density_curve(spark, d):
    part = _t(spark, d, "part")
    out = describe.density_curve(part, "p_size", grid=50, bandwidth=2.0)
    return out.select("i", _r(F.col("x")).alias("x"), _r(F.col("density"), 9).alias("density"))


def q_density_continuous(spark, d):
    """A column of almost as many values as rows."""
    out = describe.density_curve(_t(spark, d, "lineitem"), "l_extendedprice", grid=40)
    return out.select("i", _r(F.col("x"), 4).alias("x"), (F.round(F.col("density") * 1e9, 4)).alias("density"))


CORR_COLUMNS = LI_NUMERIC + ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "taxed"]


def q_corr_matrix(spark, d):
    # nine columns, one of them with NULL and NaN
    li = _t(spark, d, "lineitem")
    taxed = F.when(F.col("l_tax") == 0, F.lit(float("nan"))).when(F.col("l_tax") < 0.08, F.col("l_tax"))
    out = describe.correlation_matrix(li.withColumn("taxed", taxed), CORR_COLUMNS)
    return out.withColumn("r", _r(F.col("r")))


def q_group_stats(spark, d):
    o = _t(spark, d, "orders")
    out = describe.group_stats(o, "o_orderpriority", "o_totalprice")
    return out.select("o_orderpriority", _r(F.col("mean")).alias("mean"),
                      _r(F.col("std")).alias("std"), "count")


# --- ANOVA ---------------------------------------------------------------------------------------

def _anova_cols(a: DataFrame) -> DataFrame:
    return a.select("factor", "k", "n", "df_between", "df_within", _r(F.col("f")).alias("f"))


def q_anova_f(spark, d):
    o = _t(spark, d, "orders")
    a, _ = anova.one_way_anova(o, "o_totalprice", ["o_orderpriority", "o_orderstatus"],
                               with_p=False)
    return _anova_cols(a)


def q_anova_group_stats(spark, d):
    o = _t(spark, d, "orders")
    _, g = anova.one_way_anova(o, "o_totalprice", ["o_orderpriority", "o_orderstatus"],
                               with_p=False)
    return g.select("factor", "level", _r(F.col("mean")).alias("mean"),
                    _r(F.col("std")).alias("std"), "count")


def q_anova_p(spark, d):
    o = _t(spark, d, "orders")
    a, _ = anova.one_way_anova(o, "o_totalprice", ["o_orderpriority", "o_orderstatus"])
    return a.select("factor", _r(F.col("f")).alias("f"), _r(F.col("p_value")).alias("p_value"))


def q_anova_summary(spark, d):
    o = _t(spark, d, "orders")
    a, _ = anova.one_way_anova(o, "o_totalprice", ["o_orderpriority", "o_orderstatus"])
    out = anova.anova_summary(a, "trait")
    return out.select("trait", _r(F.col("F")).alias("F"), _r(F.col("p_value")).alias("p_value"))


def q_anova_tertiles(spark, d):
    li = _t(spark, d, "lineitem").select("l_quantity", "l_extendedprice")
    a, _ = anova.personality_anova(li, ["l_quantity"], n_groups=3,
                                   dependent="l_extendedprice", with_p=False)
    return _anova_cols(a)


# --- models ----------------------------------------------------------------------------------------

def _with_missing(li: DataFrame) -> DataFrame:
    """Lineitem whose discount has NULL (0.00) among its values."""
    return li.withColumn("disc", F.nullif("l_discount", F.lit(0.0)))


def q_ols_two_predictor(spark, d):
    res = models.ols(_with_missing(_t(spark, d, "lineitem")), "l_extendedprice", ["l_quantity", "disc"])
    return _coefficients(res)


def _coefficients(res) -> DataFrame:
    return res.coefficients.select("term", *[F.round(c, 4).alias(c) for c in ("coef", "se", "t", "ci_lower", "ci_upper")],
                                   F.round("p_value", 7).alias("p_value"))


def q_ols_collinear(spark, d):
    """A predictor that comes twice: the shortest solution halves its coefficient; rank and t stay."""
    li = _with_missing(_t(spark, d, "lineitem")).withColumn("quantity_again", F.col("l_quantity"))
    return _coefficients(models.ols(li, "l_extendedprice", ["l_quantity", "disc", "quantity_again"]))


def q_sparse_design(spark, d):
    """A factor of many levels as sparse rows: the column that each order is 1 in (none for the first level)."""
    orders = _t(spark, d, "orders").withColumn("customer", F.col("o_custkey").cast("string"))
    design = models.sparse_design(orders, "o_totalprice", [], ["customer", "o_orderpriority"], passthrough=["o_orderkey"])
    return design.frame.select("o_orderkey", F.array_join("columns", ",").alias("columns"), _r(F.col("label")).alias("label"))


def q_ols_full(spark, d):
    """Normal-equation residuals of the fit: each regressor's mean product with the residuals is 0."""
    li = _with_missing(_t(spark, d, "lineitem"))
    numeric, categorical = ["l_quantity", "disc", "l_tax"], ["l_returnflag", "l_linestatus"]
    res = models.ols(li, "l_extendedprice", numeric, categorical)
    design = models.design_frame(li, "l_extendedprice", numeric, categorical, name_style="formula")
    pred = res.model.transform(design.frame).select(
        vector_to_array("features").alias("x"), (F.col("label") - F.col("prediction")).alias("e"))
    scale_ = F.avg(F.abs("e"))
    one = pred.agg(*[(F.avg(F.col("x")[i] * F.col("e")) / scale_).alias(f"m{i}") for i in range(len(design.feature_names))])
    rows = one.select(E.rows_of(["term", "moment"], [(F.lit(t), F.col(f"m{i}")) for i, t in enumerate(design.feature_names)]))
    return rows.select("term", (F.round("moment", 6) + F.lit(0.0)).alias("moment"))


def q_forest_plot(spark, d):
    """M5 / T5: which family every term belongs to, and that coefficients ascend within it."""
    res = models.ols(_t(spark, d, "lineitem"), "l_extendedprice", ["l_quantity", "l_discount", "l_tax"], ["l_returnflag"])
    data = models.forest_plot_data(res.coefficients, ["l_quantity", "l_discount", "l_tax"])
    return data.select("term", "term_family", "rank", (F.col("ci_lower") < F.col("coef")).cast("int").alias("lower_below"),
                       (F.col("ci_upper") > F.col("coef")).cast("int").alias("upper_above"))


def q_hash_split(spark, d):
    o = _t(spark, d, "orders").select("o_orderkey")
    s = models.hash_split(o, ["o_orderkey"], seed=42, test_fraction=0.2)
    return s.select("o_orderkey", "is_test")


def q_content_split(spark, d):
    """The split by ids made from the rows' content, among many equal rows."""
    rows = clean.content_ids(_t(spark, d, "orders").select("o_orderstatus", "o_orderpriority"))
    split = models.hash_split(rows, ["row_id"])
    return split.groupBy("o_orderstatus", "o_orderpriority").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("row_id").alias("ids"), F.sum(F.col("is_test").cast("int")).alias("tests"))


def q_linear_metrics(spark, d):
    li = _t(spark, d, "lineitem")
    design = models.design_frame(li, "l_extendedprice", ["l_quantity"], [])
    _, perf = models.fit_linear(design.frame, design.frame)
    return spark.createDataFrame([(round(perf.r2_train, 6), round(perf.rmse_train, 4))], "r2 double, rmse double")


_MODEL = {"target": "l_extendedprice", "numeric": ["l_quantity", "l_discount", "l_tax"],
          "categorical": ["l_returnflag", "l_linestatus"], "weight_col": "l_returnflag", "key": ["l_orderkey", "l_linenumber"]}


def q_rf_importance(spark, d):
    """Importances of a forest of 500 full trees: in descending order, not negative, 1 in sum. Quantity
    has most values to cut between, so it comes first."""
    design, train, _ = models.model_inputs(_t(spark, d, "lineitem"), **_MODEL)
    forest = models.fit_stored_forest(train, models.FOREST_TREES, weight_col="weight")
    design.frame.unpersist()
    imp = models.importances(forest, design.feature_names, spark)
    order = Window.orderBy(F.desc("importance"), "feature")  # one row per feature
    whole = Window.partitionBy()
    return imp.select(
        F.row_number().over(order).alias("rank"),
        F.when(F.row_number().over(order) == 1, F.col("feature")).alias("first"),
        (F.coalesce(F.lag("importance").over(order), F.lit(1.0)) >= F.col("importance")).cast("int").alias("descends"),
        (F.col("importance") >= 0).cast("int").alias("not_negative"), F.round(F.sum("importance").over(whole), 9).alias("total"))


def q_model_comparison(spark, d):
    """Three full-size models on one split. The linear row is exact; no model of these predictors can
    explain more of the training rows than the means of their combinations (``cells_r2``)."""
    li = _t(spark, d, "lineitem")
    done = models.compare_models(li, **_MODEL)
    done.importances.count()
    cells = ["l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]
    train = models.hash_split(li, _MODEL["key"]).where(~F.col("is_test")).where(F.col("l_returnflag") != P.NO_RESPONSE)
    sums = train.dropna(subset=[*cells, "l_extendedprice"]).groupBy(*cells).agg(
        F.count(F.lit(1)).alias("n"), F.avg("l_extendedprice").alias("m"), F.var_pop("l_extendedprice").alias("v"))
    n, mean = F.sum("n"), F.sum(F.col("n") * F.col("m")) / F.sum("n")
    within = F.sum(F.col("n") * F.col("v"))
    one = sums.agg(within.alias("w"), n.alias("n"), mean.alias("mean"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("s"))
    one = one.select((1 - F.col("w") / (F.col("w") + F.col("s") - F.col("n") * F.col("mean") ** 2)).alias("cells_r2"))
    linear = F.col("name") == "Linear Regression"
    return done.models.join(F.broadcast(one)).select(
        "name", *[F.when(linear, F.round(c, 6)).alias(c) for c in ("r2_train", "r2_test")],
        *[F.when(linear, F.round(c, 4)).alias(c) for c in ("rmse_train", "rmse_test")],
        F.round("cells_r2", 6).alias("cells_r2"), (F.col("r2_train") <= F.col("cells_r2") + 1e-9).cast("int").alias("below_cells"),
        ((F.col("r2_train") > 0) & (F.col("rmse_train") > 0)).cast("int").alias("in_range"))


def q_tree_split(spark, d):
    """Best weighted cut of every predictor, and the one that a tree of depth 1 chose, with its leaves."""
    li = _t(spark, d, "lineitem").withColumn("flag_r", (F.col("l_returnflag") == "R").cast("double"))
    names = ["l_quantity", "l_discount", "l_tax", "flag_r"]
    design = models.design_frame(li, "l_extendedprice", names, [], passthrough=["l_linenumber"])
    forest = models.fit_stored_forest(design.frame, 1, seed=None, weight_col="l_linenumber", max_depth=1)
    tree = forest.subtrees().select(F.explode(F.arrays_zip("feature", "cut", "left", "value")).alias("x")).select("x.*").collect()
    root, low, high = tree[0], tree[1], tree[2]
    best = models.best_splits(li, names, "l_extendedprice", "l_linenumber")
    chosen = F.col("feature") == names[root.feature]
    return best.select(
        "feature", _r(F.col("threshold"), 4).alias("threshold"), _r(F.col("gain"), 2).alias("gain"),
        _r(F.col("left_mean"), 4).alias("left_mean"), _r(F.col("right_mean"), 4).alias("right_mean"), "n_left",
        chosen.cast("int").alias("chosen"),
        F.when(chosen, F.round(F.lit(float(forest.cuts[root.feature][root.cut])), 4)).alias("tree_threshold"),
        F.when(chosen, F.round(F.lit(low.value + forest.mean), 4)).alias("tree_left"),
        F.when(chosen, F.round(F.lit(high.value + forest.mean), 4)).alias("tree_right"))


def q_boost_rounds(spark, d):
    """Two boosting rounds of depth 1: each round's cut and leaf values."""
    names = ["l_quantity", "l_discount", "l_tax"]
    design = models.design_frame(_t(spark, d, "lineitem"), "l_extendedprice", names, [])
    out = models.boosted_stumps(design.frame, names, 2)
    return out.select("round", "feature", *[_r(F.col(c), 4).alias(c) for c in ("threshold", "left_mean", "right_mean")])


# --- missing values, zero cells and other branches ------------------------------------------------

def _spotty(spark, d) -> DataFrame:
    """Orders with a price that is NaN below 20,000 and NULL above 300,000."""
    p = F.col("o_totalprice")
    return _t(spark, d, "orders").withColumn("price", F.when(p < 20000, F.lit(float("nan"))).when(p <= 300000, p))


def q_missing_group_stats(spark, d):
    out = describe.group_stats(_spotty(spark, d), "o_orderpriority", "price")
    return out.select("o_orderpriority", _r(F.col("mean")).alias("mean"), _r(F.col("std")).alias("std"), "count")


def q_missing_mean_by(spark, d):
    out = geo.mean_by(_spotty(spark, d), "o_orderstatus", "price", "mean_price", with_count=True)
    return out.withColumn("mean_price", _r(F.col("mean_price")))


def q_missing_standardize(spark, d):
    out = scale.standardize(_spotty(spark, d), ["price"])
    return out.select("o_orderkey", _r(F.col("price_std")).alias("price_std"))


def q_missing_describe(spark, d):
    out = describe.describe_numeric(_spotty(spark, d), ["price"])
    return out.select("variable", "count", *[_r(F.col(c)).alias(c) for c in
                                             ["mean", "std", "min", "q25", "q50", "q75", "max"]], "missing")


def q_numeric_label(spark, d):
    """Label filters on a numeric column: a number never equals the label."""
    li = _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    kept = clean.exclude_labels_not_null(clean.exclude_label_keep_null(li, ["l_quantity"]), "l_quantity")
    return describe.nonresponse_table(kept, ["l_quantity", "l_linenumber"])


def q_nonresponse_top(spark, d):
    out = describe.nonresponse_table(_label_orders(spark, d), ["status_label", "priority_label", "o_clerk"], top_n=2)
    return out.select(F.row_number().over(Window.orderBy(F.desc("pct_no_response"), "variable")).alias("rank"),
                      "variable", _r(F.col("pct_no_response")).alias("pct_no_response"))


def q_crosstab_zero_cells(spark, d):
    """Complete form: levels and bands that no row has, and two-digit half-even percentages."""
    li = _t(spark, d, "lineitem")
    return crosstab.crosstab_bands(li, "l_returnflag", "l_quantity", [-20, 0, 20, 50, 90], ["none", "small", "large", "huge"],
                                   complete=True, row_levels=["A", "N", "R", "X"], digits=2)


def q_crosstab_bands_observed(spark, d):
    """Observed form: bands and levels without rows are absent."""
    li = _t(spark, d, "lineitem")
    out = crosstab.crosstab_bands(li, "l_returnflag", "l_quantity", [-20, 0, 20, 50, 90], ["none", "small", "large", "huge"],
                                  complete=False)
    return out.withColumn("row_pct", _r(F.col("row_pct")))


def q_full_summary(spark, d):
    c = _t(spark, d, "customer").select("c_acctbal", "c_mktsegment")
    parts = describe.full_summary(c, normalize=True)
    numeric = parts["numeric_summary"].select("variable", F.lit(None).cast("string").alias("value"),
                                              F.col("count").alias("n"), _r(F.col("mean")).alias("figure"))
    counts = parts["categorical_counts"].select("variable", "value", "n", F.lit(None).cast("double").alias("figure"))
    shares = parts["categorical_proportions"].select(F.concat("variable", F.lit("_share")).alias("variable"), "value",
                                                     F.lit(None).cast("bigint").alias("n"), _r(F.col("proportion")).alias("figure"))
    return numeric.unionByName(counts).unionByName(shares)


def q_to_double(spark, d):
    p = _t(spark, d, "part").select("p_partkey", "p_size")
    return scale.to_double(p, ["p_size"])


def q_quantile_skip(spark, d):
    """Columns that cannot be cut are skipped: too few distinct values, or edges that tie."""
    li = _t(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_quantity", (F.col("l_orderkey") % 2).alias("two"),
        F.when(F.col("l_linenumber") < 3, F.lit(1)).otherwise(F.lit(0) * F.col("l_quantity")).alias("tied"))
    out = bins.quantile_groups(li, ["l_quantity", "two", "tied", "absent"], n_groups=3, ties="skip")
    made = F.lit(",".join(c for c in out.columns if c.endswith("_group")))
    return out.groupBy("l_quantity_group").agg(F.count(F.lit(1)).alias("n")).withColumn("made", made)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "severity_by_group": q_severity_by_group,
    "severity_summary": q_severity_summary,
    "crosstab_observed": q_crosstab_observed,
    "recode_labels": q_recode_labels,
    "regroup_labels": q_regroup_labels,
    "age_or_year": q_age_or_year,
    "geo_lookup": q_geo_lookup,
    "scale_sums": q_scale_sums,
    "reverse_pair_mean": q_reverse_pair_mean,
    "validity_screen": q_validity_screen,
    "drop_missing": q_drop_missing,
    "exclude_label_keep_null": q_exclude_label_keep_null,
    "exclude_label_notnull": q_exclude_label_notnull,
    "select_rename": q_select_rename,
    "age_bands": q_age_bands,
    "quantile_groups": q_quantile_groups,
    "severity_by_tertile": q_severity_by_tertile,
    "standardize": q_standardize,
    "one_hot": q_one_hot,
    "group_means": q_group_means,
    "country_mean_iso": q_country_mean_iso,
    "country_alias": q_country_alias,
    "choropleth_table": q_choropleth_table,
    "top10_mean": q_top10_mean,
    "top10_count": q_top10_count,
    "describe_numeric": q_describe_numeric,
    "value_counts": q_value_counts,
    "nonresponse": q_nonresponse,
    "box_stats": q_box_stats,
    "box_stats_global": q_box_stats_global,
    "histogram": q_histogram,
    "density_curve": q_density_curve,
    "density_continuous": q_density_continuous,
    "corr_matrix": q_corr_matrix,
    "group_stats": q_group_stats,
    "anova_f": q_anova_f,
    "anova_group_stats": q_anova_group_stats,
    "anova_p": q_anova_p,
    "anova_tertiles": q_anova_tertiles,
    "inverse_freq_weights": q_inverse_freq_weights,
    "ols_two_predictor": q_ols_two_predictor,
    "ols_full": q_ols_full,
    "hash_split": q_hash_split,
    "linear_metrics": q_linear_metrics,
    "content_split": q_content_split,
    "ols_collinear": q_ols_collinear,
    "sparse_design": q_sparse_design,
    "tree_split": q_tree_split,
    "boost_rounds": q_boost_rounds,
    "rf_importance": q_rf_importance,
    "model_comparison": q_model_comparison,
    "anova_summary": q_anova_summary,
    "forest_plot": q_forest_plot,
    "missing_group_stats": q_missing_group_stats,
    "missing_mean_by": q_missing_mean_by,
    "missing_standardize": q_missing_standardize,
    "missing_describe": q_missing_describe,
    "numeric_label": q_numeric_label,
    "nonresponse_top": q_nonresponse_top,
    "crosstab_zero_cells": q_crosstab_zero_cells,
    "crosstab_bands_observed": q_crosstab_bands_observed,
    "full_summary": q_full_summary,
    "to_double": q_to_double,
    "quantile_skip": q_quantile_skip,
}
