"""DuckDB SQL equivalents of the registered queries (same column names and types).

Of full tree ensembles SQL states what holds for any right fit (order, sums, the bound of the cell
means); single splits and boosting rounds are stated exactly.
"""

from __future__ import annotations


_LINEAR = ["l_quantity", "l_discount", "l_tax"]


def _dummies() -> list[tuple[str, str]]:
    """Name and 0/1 expression of the dummies of the two flag columns; the levels are those of the generated tables."""
    return [(f"{c}[T.{v}]", f"(CASE WHEN {c} = '{v}' THEN 1.0 ELSE 0.0 END)")
            for c, levels in (("l_returnflag", "NR"), ("l_linestatus", "O")) for v in levels]


def _solved(x: list[tuple[str, str]], y: str, source: str) -> str:
    """``term, coef`` of the least squares of ``y`` on the named expressions, without the intercept: Gauss-Jordan
    elimination of the normal matrix, written out one pivot at a time."""
    p = len(x)
    cols = [e for _, e in x] + [y]
    covs = ", ".join(f"covar_pop({cols[i]}, {cols[j]}) AS a0_{i}_{j}" for i in range(p) for j in range(p + 1))
    steps, last = [f"s0 AS (SELECT {covs} FROM {source})"], "s0"
    for k in range(p):
        out = []
        for i in range(p):
            for j in range(p + 1):
                pivot = f"a{k}_{k}_{j} / a{k}_{k}_{k}"
                out.append((pivot if i == k else f"a{k}_{i}_{j} - a{k}_{i}_{k} * {pivot}") + f" AS a{k + 1}_{i}_{j}")
        steps.append(f"s{k + 1} AS (SELECT {', '.join(out)} FROM {last})")
        last = f"s{k + 1}"
    rows = " UNION ALL ".join(f"SELECT '{name}' AS term, a{p}_{i}_{p} AS coef FROM {last}" for i, (name, _) in enumerate(x))
    return f"WITH {', '.join(steps)} {rows}"


def _forest_plot_coefficients() -> str:
    x = [(c, c) for c in _LINEAR] + _dummies()[:2]
    return f"SELECT *, CASE WHEN term LIKE '%[%' THEN 'demographic' ELSE 'psych' END AS term_family FROM ({_solved(x, 'l_extendedprice', 'lineitem')})"


def _model_comparison(test: str) -> str:
    x = [(c, c) for c in _LINEAR] + _dummies()
    fit = _solved(x, "l_extendedprice", "(SELECT * FROM d WHERE NOT test)")
    line = " + ".join(f"max(CASE WHEN term = '{n}' THEN coef END) AS b{i}" for i, (n, _) in enumerate(x)).replace(" + ", ", ")
    score = " + ".join(f"b{i} * {e}" for i, (_, e) in enumerate(x))
    means = ", ".join(f"avg({e}) AS m{i}" for i, (_, e) in enumerate(x))
    intercept = " - ".join(["my", *[f"b{i} * m{i}" for i in range(len(x))]])
    return f"""
WITH d AS (SELECT *, {test} AS test FROM lineitem),
f AS (SELECT {line} FROM ({fit})),
m AS (SELECT avg(l_extendedprice) AS my, {means} FROM d WHERE NOT test),
e AS (SELECT test, avg((l_extendedprice - ({intercept}) - ({score})) ** 2) AS mse, var_pop(l_extendedprice) AS vy FROM d, f, m GROUP BY test),
p AS (
  SELECT max(CASE WHEN NOT test THEN 1 - mse / vy END) AS r2_train, max(CASE WHEN test THEN 1 - mse / vy END) AS r2_test,
         max(CASE WHEN NOT test THEN sqrt(mse) END) AS rmse_train, max(CASE WHEN test THEN sqrt(mse) END) AS rmse_test FROM e),
c AS (SELECT sum(n * v) AS within FROM (
  SELECT count(*) AS n, var_pop(l_extendedprice) AS v FROM d WHERE NOT test
  GROUP BY l_quantity, l_discount, l_tax, l_returnflag, l_linestatus)),
t AS (SELECT 1 - within / (SELECT count(*) * var_pop(l_extendedprice) FROM d WHERE NOT test) AS cells FROM c)
SELECT 'Linear Regression' AS name, round(r2_train, 6) AS r2_train, round(r2_test, 6) AS r2_test, round(rmse_train, 4) AS rmse_train,
       round(rmse_test, 4) AS rmse_test, round(cells, 6) AS cells_r2, 1 AS below_cells, 1 AS in_range FROM p, t
UNION ALL SELECT unnest(['Random Forest', 'Gradient Boosting']), NULL, NULL, NULL, NULL, round(cells, 6), 1, 1 FROM t"""


def _case_bins(col: str, edges: list[float]) -> str:
    parts = []
    for i in range(len(edges) - 1):
        lo, hi = edges[i], edges[i + 1]
        op = ">=" if i == 0 else ">"
        parts.append(f"WHEN {col} {op} {lo} AND {col} <= {hi} THEN {i}")
    return "CASE " + " ".join(parts) + " END"


def _case_labels(col: str, edges: list[float], labels: list[str]) -> str:
    parts = []
    for i in range(len(edges) - 1):
        lo, hi = edges[i], edges[i + 1]
        op = ">=" if i == 0 else ">"
        lab = labels[i].replace("'", "''")
        parts.append(f"WHEN {col} {op} {lo} AND {col} <= {hi} THEN '{lab}'")
    return "CASE " + " ".join(parts) + " END"


def _domain(labels: list[str]) -> str:
    rows = ", ".join(f"({i}, '{lab}')" for i, lab in enumerate(labels))
    return f"(VALUES {rows}) AS dom(ord, band)"


def build() -> dict[str, str]:
    from ..functions import presets as P
    from .catalog import QTY_EDGES, QTY_LABELS, SIZE_EDGES
    sql: dict[str, str] = {}

    sql["severity_by_group"] = f"""
WITH b AS (
  SELECT l_returnflag, {_case_bins('l_quantity', QTY_EDGES)} AS ord
  FROM lineitem WHERE l_returnflag IS NOT NULL),
lv AS (SELECT DISTINCT l_returnflag FROM b),
c AS (SELECT l_returnflag, ord, count(*) AS n FROM b WHERE ord IS NOT NULL GROUP BY 1, 2),
g AS (
  SELECT lv.l_returnflag, dom.ord, dom.band, coalesce(c.n, 0) AS n
  FROM lv CROSS JOIN {_domain(QTY_LABELS)}
  LEFT JOIN c ON c.l_returnflag = lv.l_returnflag AND c.ord = dom.ord)
SELECT l_returnflag, CAST(ord AS INTEGER) AS ord, band, CAST(n AS BIGINT) AS n,
       round(CAST(n AS DOUBLE) * 100.0 / nullif(sum(n) OVER (PARTITION BY l_returnflag), 0), 6)
         AS row_pct
FROM g"""

    sql["severity_summary"] = f"""
WITH b AS (SELECT {_case_bins('p_size', SIZE_EDGES)} AS ord FROM part),
c AS (SELECT ord, count(*) AS n FROM b WHERE ord IS NOT NULL GROUP BY ord)
SELECT CAST(dom.ord AS INTEGER) AS ord, dom.band, CAST(coalesce(c.n, 0) AS BIGINT) AS n,
       round(CAST(coalesce(c.n, 0) AS DOUBLE) * 100.0 / (SELECT count(*) FROM part), 6) AS pct
FROM {_domain(P.SEVERITY_LABELS)} LEFT JOIN c ON c.ord = dom.ord"""

    sql["crosstab_observed"] = """
WITH c AS (
  SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders
  WHERE o_orderpriority IS NOT NULL AND o_orderstatus IS NOT NULL GROUP BY 1, 2),
r AS (SELECT DISTINCT o_orderpriority FROM c),
s AS (SELECT DISTINCT o_orderstatus FROM c),
g AS (SELECT r.o_orderpriority, s.o_orderstatus, coalesce(c.n, 0) AS n
      FROM r CROSS JOIN s LEFT JOIN c USING (o_orderpriority, o_orderstatus))
SELECT o_orderpriority, o_orderstatus, CAST(n AS BIGINT) AS n,
       round(CAST(n AS DOUBLE) * 100.0 / sum(n) OVER (PARTITION BY o_orderpriority), 6) AS row_pct
FROM g"""

    sql["recode_labels"] = """
SELECT o_orderkey, o_orderstatus,
       CASE o_orderstatus WHEN 'F' THEN 'Finished' WHEN 'O' THEN 'Open' END AS status_label
FROM orders"""

    sql["regroup_labels"] = """
SELECT c_custkey, c_mktsegment,
       CASE WHEN c_mktsegment IN ('AUTOMOBILE', 'HOUSEHOLD') THEN 'Consumer'
            WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'Business' END AS segment_group
FROM customer"""

    sql["age_or_year"] = """
WITH b AS (
  SELECT o_orderkey,
         CAST(CASE WHEN o_orderkey % 2 = 0 THEN year(o_orderdate) ELSE o_orderkey % 120 END
              AS BIGINT) AS raw_value
  FROM orders),
a AS (
  SELECT o_orderkey, raw_value,
         CAST(CASE WHEN raw_value BETWEEN 1900 AND 2016 THEN 2026 - raw_value ELSE raw_value END
              AS BIGINT) AS age_clean
  FROM b)
SELECT * FROM a WHERE age_clean BETWEEN 10 AND 100"""

    sql["geo_lookup"] = """
WITH dim AS (
  SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey),
s AS (
  SELECT s_suppkey, CASE WHEN s_suppkey % 10 = 3 THEN s_nationkey + 100
                         WHEN s_suppkey % 10 <> 7 THEN s_nationkey END AS s_code FROM supplier)
SELECT s_suppkey, s_code, dim.n_name AS country_name,
       CASE WHEN dim.n_name IS NULL THEN 'Unknown' ELSE coalesce(dim.r_name, 'Unknown') END
         AS continent
FROM s LEFT JOIN dim ON s_code = dim.n_nationkey"""

    sql["scale_sums"] = """
WITH b AS (
  SELECT l_orderkey, l_linenumber, l_quantity, nullif(l_tax, 0.0) AS tax_item,
         nullif(l_discount, 0.0) AS disc_item FROM lineitem),
s AS (
  SELECT l_orderkey, l_linenumber, coalesce(l_quantity, 0) + coalesce(tax_item, 0) AS s1,
         coalesce(disc_item, 0) AS s2 FROM b)
SELECT l_orderkey, l_linenumber, round(s1, 6) AS s1, round(s2, 6) AS s2,
       round(coalesce(s1, 0) + coalesce(s2, 0), 6) AS s_all
FROM s"""

    sql["reverse_pair_mean"] = """
WITH b AS (
  SELECT l_orderkey, l_linenumber, 8 - l_linenumber AS line_rev, l_quantity / 5 AS qty5
  FROM lineitem),
t AS (SELECT *, (line_rev + qty5) / 2 AS trait FROM b)
SELECT l_orderkey, l_linenumber, CAST(line_rev AS INTEGER) AS line_rev, round(trait, 6) AS trait
FROM t WHERE trait BETWEEN 1 AND 7"""

    sql["validity_screen"] = """
SELECT doc_id, CAST(coalesce(quality, 0) AS INTEGER) AS vcl_score,
       CAST(coalesce(toxic, 0) AS INTEGER) AS vcl_invalid,
       coalesce(toxic, 0) = 0 AS vcl_valid
FROM labels WHERE coalesce(toxic, 0) = 0"""

    # sparse_note is NULL for about a third of the rows -> dropped as a column;
    # near_full is NULL for about 2 % -> kept, and its NULL rows are dropped.
    sql["drop_missing"] = """
WITH e AS (
  SELECT event_id, user_id, event_type, value,
         CASE WHEN value >= 1 THEN event_type END AS near_full FROM events)
SELECT * FROM e
WHERE event_id IS NOT NULL AND user_id IS NOT NULL AND event_type IS NOT NULL
  AND value IS NOT NULL AND near_full IS NOT NULL"""

    status = ("CASE o_orderstatus WHEN 'F' THEN 'No response' WHEN 'O' THEN 'Open' END")
    sql["exclude_label_keep_null"] = f"""
WITH o AS (SELECT o_orderkey, {status} AS status_label FROM orders)
SELECT * FROM o WHERE status_label IS DISTINCT FROM 'No response'"""

    sql["exclude_label_notnull"] = f"""
WITH o AS (SELECT o_orderkey, {status} AS status_label FROM orders)
SELECT * FROM o WHERE status_label IS NOT NULL AND status_label NOT IN ('No response')"""

    sql["select_rename"] = """
SELECT c_custkey, c_name AS customer_name, c_acctbal AS balance FROM customer"""

    age_case = _case_labels("p_size", P.AGE_EDGES, P.AGE_LABELS)
    sql["age_bands"] = f"SELECT p_partkey, p_size, {age_case} AS age_group FROM part"

    sql["quantile_groups"] = """
WITH q AS (
  SELECT min(c_acctbal) AS e0,
         quantile_cont(c_acctbal, CAST(1 AS DOUBLE) / 3) AS e1,
         quantile_cont(c_acctbal, CAST(2 AS DOUBLE) / 3) AS e2,
         max(c_acctbal) AS e3
  FROM customer WHERE c_acctbal IS NOT NULL AND NOT isnan(c_acctbal)),
g AS (
  SELECT c_acctbal,
         CASE WHEN c_acctbal >= e0 AND c_acctbal <= e1 THEN 'Low'
              WHEN c_acctbal > e1 AND c_acctbal <= e2 THEN 'Medium'
              WHEN c_acctbal > e2 AND c_acctbal <= e3 THEN 'High' END AS c_acctbal_group
  FROM customer, q)
SELECT c_acctbal_group, count(*) AS n, min(c_acctbal) AS min_bal, max(c_acctbal) AS max_bal
FROM g GROUP BY c_acctbal_group"""

    sql["severity_by_tertile"] = f"""
WITH q AS (
  SELECT quantile_cont(l_extendedprice, CAST(1 AS DOUBLE) / 3) AS e1,
         quantile_cont(l_extendedprice, CAST(2 AS DOUBLE) / 3) AS e2
  FROM lineitem WHERE l_extendedprice IS NOT NULL AND NOT isnan(l_extendedprice)),
b AS (
  SELECT CASE WHEN l_extendedprice IS NULL OR isnan(l_extendedprice) THEN NULL
              WHEN l_extendedprice <= e1 THEN 'Low' WHEN l_extendedprice <= e2 THEN 'Medium'
              ELSE 'High' END AS price_group,
         {_case_bins('l_quantity', QTY_EDGES)} AS ord
  FROM lineitem, q),
c AS (SELECT price_group, ord, count(*) AS n FROM b WHERE price_group IS NOT NULL
      GROUP BY 1, 2),
lv AS (SELECT * FROM (VALUES ('Low'), ('Medium'), ('High')) AS t(price_group)),
g AS (
  SELECT lv.price_group, dom.ord, dom.band, coalesce(c.n, 0) AS n
  FROM lv CROSS JOIN {_domain(QTY_LABELS)}
  LEFT JOIN c ON c.price_group = lv.price_group AND c.ord = dom.ord)
SELECT price_group, CAST(ord AS INTEGER) AS ord, band, CAST(n AS BIGINT) AS n,
       round(CAST(n AS DOUBLE) * 100.0 / nullif(sum(n) OVER (PARTITION BY price_group), 0), 6)
         AS row_pct
FROM g"""

    sql["standardize"] = """
WITH m AS (SELECT avg(c_acctbal) AS mu, stddev_pop(c_acctbal) AS sd FROM customer)
SELECT c_custkey,
       round((c_acctbal - mu) / CASE WHEN sd > 0 THEN sd ELSE 1 END, 6) AS c_acctbal_std
FROM customer, m"""

    sql["one_hot"] = """
SELECT c_custkey,
       CASE WHEN c_mktsegment = 'BUILDING' THEN 1 ELSE 0 END AS c_mktsegment_BUILDING,
       CASE WHEN c_mktsegment = 'FURNITURE' THEN 1 ELSE 0 END AS c_mktsegment_FURNITURE,
       CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN 1 ELSE 0 END AS c_mktsegment_HOUSEHOLD,
       CASE WHEN c_mktsegment = 'MACHINERY' THEN 1 ELSE 0 END AS c_mktsegment_MACHINERY
FROM customer"""

    sql["group_means"] = """
SELECT r_name, round(avg(o_totalprice), 6) AS mean_totalprice, count(*) AS n
FROM orders JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
GROUP BY r_name"""

    sql["country_mean_iso"] = """
WITH m AS (
  SELECT n_name, avg(c_acctbal) AS mean_acctbal FROM customer
  JOIN nation ON c_nationkey = n_nationkey WHERE n_name IS NOT NULL GROUP BY n_name)
SELECT m.n_name, round(mean_acctbal, 6) AS mean_acctbal, nation.n_nationkey
FROM m LEFT JOIN nation ON m.n_name = nation.n_name"""

    sql["country_alias"] = """
WITH a AS (
  SELECT 0 AS place, lower(trim(n_name)) AS alias, n_nationkey AS code FROM nation
  UNION ALL SELECT 1, lower(trim(substr(n_name, 1, 3))), n_nationkey FROM nation),
f AS (SELECT alias, code FROM a QUALIFY row_number() OVER (PARTITION BY alias ORDER BY place, code) = 1),
q AS (
  SELECT lower(n_name) AS asked FROM nation UNION SELECT '  ' || n_name || ' ' FROM nation
  UNION SELECT upper(substr(n_name, 1, 1)) || lower(substr(n_name, 2, 2)) FROM nation UNION SELECT n_name || '?' FROM nation)
SELECT asked, f.code AS n_nationkey FROM q LEFT JOIN f ON lower(trim(asked)) = f.alias"""

    sql["choropleth_table"] = """
WITH m AS (
  SELECT c_nationkey, avg(c_acctbal) AS mean_acctbal FROM customer
  GROUP BY c_nationkey),
w AS (SELECT n_nationkey, n_name FROM nation UNION ALL SELECT n_nationkey + 100, n_name FROM nation)
SELECT n_nationkey, n_name, round(mean_acctbal, 6) AS mean_acctbal
FROM w LEFT JOIN m ON n_nationkey = m.c_nationkey"""

    sql["top10_mean"] = """
SELECT n_name, round(avg(c_acctbal), 6) AS mean_acctbal
FROM customer JOIN nation ON c_nationkey = n_nationkey
GROUP BY n_name ORDER BY avg(c_acctbal) DESC, n_name LIMIT 10"""

    sql["top10_count"] = """
SELECT n_name, count(*) AS n_customers
FROM customer JOIN nation ON c_nationkey = n_nationkey
GROUP BY n_name ORDER BY n_customers DESC, n_name LIMIT 10"""

    parts = []
    for c in ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]:
        parts.append(f"""
SELECT '{c}' AS variable, count({c}) AS count, round(avg({c}), 6) AS mean,
       round(stddev_samp({c}), 6) AS std, round(min({c}), 6) AS min,
       round(quantile_cont({c}, 0.25), 6) AS q25, round(quantile_cont({c}, 0.5), 6) AS q50,
       round(quantile_cont({c}, 0.75), 6) AS q75, round(max({c}), 6) AS max,
       count(*) - count({c}) AS missing
FROM lineitem""")
    sql["describe_numeric"] = " UNION ALL ".join(parts)

    sql["value_counts"] = f"""
WITH l AS (
  SELECT 'status_label' AS variable, {status} AS value FROM orders
  UNION ALL SELECT 'o_orderpriority', o_orderpriority FROM orders),
c AS (SELECT variable, value, count(*) AS n FROM l GROUP BY variable, value)
SELECT variable, value, n, round(n / sum(n) OVER (PARTITION BY variable), 6) AS proportion
FROM c"""

    sql["nonresponse"] = f"""
WITH o AS (
  SELECT {status} AS status_label,
         CASE WHEN o_orderpriority = '5-LOW' THEN 'No response' ELSE o_orderpriority END
           AS priority_label
  FROM orders),
t AS (
  SELECT 'status_label' AS variable, count(status_label) AS n_total,
         count(*) FILTER (WHERE status_label = 'No response') AS n_no_response FROM o
  UNION ALL
  SELECT 'priority_label', count(priority_label),
         count(*) FILTER (WHERE priority_label = 'No response') FROM o)
SELECT variable, n_total, n_no_response,
       round(CASE WHEN n_total > 0 THEN n_no_response * 100.0 / n_total ELSE 0.0 END, 6)
         AS pct_no_response
FROM t"""

    box = []
    for f in ["o_orderpriority", "o_orderstatus"]:
        box.append(f"""
SELECT '{f}' AS factor, {f} AS level, count(*) AS count, round(avg(o_totalprice), 6) AS mean,
       round(stddev_samp(o_totalprice), 6) AS std, round(min(o_totalprice), 6) AS min,
       round(quantile_cont(o_totalprice, 0.25), 6) AS q1,
       round(quantile_cont(o_totalprice, 0.5), 6) AS median,
       round(quantile_cont(o_totalprice, 0.75), 6) AS q3, round(max(o_totalprice), 6) AS max
FROM orders WHERE {f} IS NOT NULL AND {f} <> 'No response' AND o_totalprice IS NOT NULL
GROUP BY {f}""")
    sql["box_stats"] = " UNION ALL ".join(box)

    sql["box_stats_global"] = """
SELECT count(*) AS count, round(avg(o_totalprice), 6) AS mean,
       round(quantile_cont(o_totalprice, 0.5), 6) AS median,
       round(quantile_cont(o_totalprice, 0.25), 6) AS q25,
       round(quantile_cont(o_totalprice, 0.75), 6) AS q75,
       round(min(o_totalprice), 6) AS min, round(max(o_totalprice), 6) AS max
FROM orders WHERE o_totalprice IS NOT NULL"""

    sql["histogram"] = """
WITH r AS (SELECT min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem),
b AS (
  SELECT CAST(least(floor((l_quantity - lo) * 43 / (hi - lo)), 42) AS INTEGER) AS bin
  FROM lineitem, r WHERE l_quantity IS NOT NULL),
c AS (SELECT bin, count(*) AS n FROM b GROUP BY bin),
d AS (SELECT CAST(range AS INTEGER) AS bin FROM range(43))
SELECT d.bin, round(lo + d.bin * ((hi - lo) / 43), 6) AS lo,
       round(lo + (d.bin + 1) * ((hi - lo) / 43), 6) AS hi, coalesce(c.n, 0) AS n
FROM d LEFT JOIN c ON c.bin = d.bin, r"""

    sql["density_curve"] = """
WITH s AS (SELECT count(*) AS n, min(p_size) AS lo, max(p_size) AS hi FROM part),
x AS (SELECT CAST(p_size AS DOUBLE) AS x, count(*) AS c FROM part GROUP BY 1),
g AS (SELECT CAST(range AS INTEGER) AS i FROM range(50)),
k AS (
  SELECT g.i, lo + g.i * ((hi - lo) / 49.0) AS gx,
         sum(c * exp(-0.5 * ((lo + g.i * ((hi - lo) / 49.0) - x) / 2.0)
                          * ((lo + g.i * ((hi - lo) / 49.0) - x) / 2.0))) AS ssum, n
  FROM g, x, s GROUP BY g.i, lo, hi, n)
SELECT i, round(gx, 6) AS x, round(ssum / (n * 2.0 * sqrt(2 * pi())), 9) AS density FROM k"""

    cols = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_orderkey", "l_partkey", "l_suppkey",
            "l_linenumber", "taxed"]
    items = "(SELECT *, CASE WHEN l_tax <> 0 AND l_tax < 0.08 THEN l_tax END AS taxed FROM lineitem)"
    corr = []
    for i, a in enumerate(cols):
        corr.append(f"SELECT '{a}' AS var_a, '{a}' AS var_b, "
                    f"CASE WHEN stddev_samp({a}) > 0 THEN 1.0 END AS r FROM {items}")
        for b in cols[i + 1:]:
            corr.append(f"SELECT '{a}', '{b}', round(corr({a}, {b}), 6) FROM {items}")
            corr.append(f"SELECT '{b}', '{a}', round(corr({a}, {b}), 6) FROM {items}")
    sql["corr_matrix"] = " UNION ALL ".join(corr)

    sql["group_stats"] = """
SELECT o_orderpriority, round(avg(o_totalprice), 6) AS mean,
       round(stddev_samp(o_totalprice), 6) AS std, count(o_totalprice) AS count
FROM orders WHERE o_orderpriority IS NOT NULL GROUP BY o_orderpriority"""

    anova = []
    for f in ["o_orderpriority", "o_orderstatus"]:
        anova.append(f"""
SELECT '{f}' AS factor, {f} AS level, count(*) AS n, avg(o_totalprice) AS mean,
       var_samp(o_totalprice) AS var
FROM orders WHERE {f} IS NOT NULL AND {f} <> 'No response' AND o_totalprice IS NOT NULL
GROUP BY {f}""")
    sql["anova_f"] = _anova_sql(" UNION ALL ".join(anova))

    gstats = []
    for f in ["o_orderpriority", "o_orderstatus"]:
        gstats.append(f"""
SELECT '{f}' AS factor, {f} AS level, round(avg(o_totalprice), 6) AS mean,
       round(stddev_samp(o_totalprice), 6) AS std, count(*) AS count
FROM orders WHERE {f} IS NOT NULL AND {f} <> 'No response' AND o_totalprice IS NOT NULL
GROUP BY {f}""")
    sql["anova_group_stats"] = " UNION ALL ".join(gstats)

    sql["anova_tertiles"] = _anova_sql("""
WITH q AS (
  SELECT min(l_quantity) AS e0, quantile_cont(l_quantity, CAST(1 AS DOUBLE) / 3) AS e1,
         quantile_cont(l_quantity, CAST(2 AS DOUBLE) / 3) AS e2, max(l_quantity) AS e3
  FROM lineitem WHERE l_quantity IS NOT NULL),
g AS (
  SELECT l_extendedprice,
         CASE WHEN l_quantity >= e0 AND l_quantity <= e1 THEN 'Low'
              WHEN l_quantity > e1 AND l_quantity <= e2 THEN 'Medium'
              WHEN l_quantity > e2 AND l_quantity <= e3 THEN 'High' END AS level
  FROM lineitem, q)
SELECT 'l_quantity' AS factor, level, count(*) AS n, avg(l_extendedprice) AS mean,
       var_samp(l_extendedprice) AS var
FROM g WHERE level IS NOT NULL AND l_extendedprice IS NOT NULL GROUP BY level""")

    sql["inverse_freq_weights"] = """
WITH c AS (SELECT o_orderpriority, count(*) AS n FROM orders
           WHERE o_orderpriority IS NOT NULL GROUP BY 1),
t AS (SELECT o_orderpriority, CAST(sum(n) OVER () AS DOUBLE) / n AS w FROM c)
SELECT o_orderkey, round(coalesce(t.w, 1.0), 6) AS weight
FROM orders LEFT JOIN t USING (o_orderpriority)"""

    # t(0.975) by its expansion about the normal quantile; the tail by Simpson's rule over the density
    inference = """,
k AS (SELECT *, coef / se AS t, (SELECT n - 3 FROM m) AS v, 1.959963984540054::DOUBLE AS z FROM r),
q AS (SELECT *, z + (z ** 3 + z) / (4 * v) + (5 * z ** 5 + 16 * z ** 3 + 3 * z) / (96 * v * v) AS tq,
             exp(lgamma((v + 1) / 2.0) - lgamma(v / 2.0)) / sqrt(v * pi()) AS c0 FROM k),
p AS (
  SELECT term, sum(CASE WHEN i = 0 OR i = 4000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END
                   * c0 * (1 + (i * least(abs(t), 40) / 4000.0) ** 2 / v) ** (-(v + 1) / 2.0)) * max(least(abs(t), 40)) / 12000.0 AS half
  FROM q, generate_series(0, 4000) AS g(i) GROUP BY term)
SELECT term, round(coef, 4) AS coef, round(se, 4) AS se, round(t, 4) AS t, round(coef - tq * se, 4) AS ci_lower,
       round(coef + tq * se, 4) AS ci_upper, round(greatest(1 - 2 * half, 0.0), 7) AS p_value FROM q JOIN p USING (term)"""
    two = """
WITH d AS (
  SELECT l_extendedprice AS y, l_quantity AS x1, nullif(l_discount, 0.0) AS x2 FROM lineitem),
u AS (SELECT * FROM d WHERE y IS NOT NULL AND x1 IS NOT NULL AND x2 IS NOT NULL),
m AS (
  SELECT count(*) AS n, avg(y) AS my, avg(x1) AS m1, avg(x2) AS m2, var_pop(y) AS vy,
         covar_pop(x1, x1) AS c11, covar_pop(x2, x2) AS c22, covar_pop(x1, x2) AS c12,
         covar_pop(x1, y) AS c1y, covar_pop(x2, y) AS c2y FROM u),
b AS (
  SELECT *, c11 * c22 - c12 * c12 AS det, (c1y * c22 - c2y * c12) / (c11 * c22 - c12 * c12) AS b1,
         (c2y * c11 - c1y * c12) / (c11 * c22 - c12 * c12) AS b2 FROM m),
s AS (SELECT *, n * (vy - b1 * c1y - b2 * c2y) / (n - 3) AS s2 FROM b),
r AS (
  SELECT 'Intercept' AS term, my - b1 * m1 - b2 * m2 AS coef,
         sqrt(s2 / n * (1 + (m1 * m1 * c22 - 2 * m1 * m2 * c12 + m2 * m2 * c11) / det)) AS se FROM s
  UNION ALL SELECT {first}, sqrt(s2 / n * c22 / det){half} FROM s{again}
  UNION ALL SELECT 'disc', b2, sqrt(s2 / n * c11 / det) FROM s)"""
    sql["ols_two_predictor"] = two.format(first="'l_quantity', b1", half="", again="") + inference
    # x1 twice: each half has half the coefficient and half its standard error
    sql["ols_collinear"] = two.format(
        first="'l_quantity', b1 / 2", half=" / 2",
        again=" UNION ALL SELECT 'quantity_again', b1 / 2, sqrt(s2 / n * c22 / det) / 2 FROM s") + inference

    sql["sparse_design"] = """
WITH c AS (SELECT o_orderkey, o_totalprice, dense_rank() OVER (ORDER BY CAST(o_custkey AS VARCHAR)) - 1 AS a,
                  dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS b FROM orders
           WHERE o_custkey IS NOT NULL AND o_orderpriority IS NOT NULL AND o_totalprice IS NOT NULL),
n AS (SELECT *, max(a) OVER () AS k FROM c)
SELECT o_orderkey, concat_ws(',', CASE WHEN a > 0 THEN a - 1 END, CASE WHEN b > 0 THEN k + b - 1 END) AS columns,
       round(o_totalprice, 6) AS label FROM n"""

    splits = """
l AS (SELECT feature, value, sum(w) AS w, sum(w * y) AS wy, sum(w * y * y) AS wyy, count(*) AS n FROM x GROUP BY 1, 2),
g AS (SELECT feature, (value + lead(value) OVER o) / 2 AS threshold, sum(w) OVER o AS lw, sum(wy) OVER o AS ly, sum(wyy) OVER o AS lyy,
             sum(n) OVER o AS n_left, sum(w) OVER f AS tw, sum(wy) OVER f AS ty, sum(wyy) OVER f AS tyy
      FROM l WINDOW o AS (PARTITION BY feature ORDER BY value), f AS (PARTITION BY feature)),
h AS (SELECT feature, threshold, ly / lw AS left_mean, (ty - ly) / (tw - lw) AS right_mean, n_left,
             (tyy - ty * ty / tw - (lyy - ly * ly / lw) - (tyy - lyy - (ty - ly) ** 2 / (tw - lw))) / tw AS gain
      FROM g WHERE threshold IS NOT NULL),
best AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY feature ORDER BY gain DESC, threshold) = 1)"""
    sql["tree_split"] = f"""
WITH x AS (
  SELECT unnest(['l_quantity', 'l_discount', 'l_tax', 'flag_r']) AS feature,
         unnest([l_quantity, l_discount, l_tax, CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END]::DOUBLE[]) AS value,
         l_linenumber::DOUBLE AS w, l_extendedprice::DOUBLE AS y FROM lineitem),{splits},
c AS (SELECT *, row_number() OVER (ORDER BY gain DESC) = 1 AS chosen FROM best)
SELECT feature, round(threshold, 4) AS threshold, round(gain, 2) AS gain, round(left_mean, 4) AS left_mean,
       round(right_mean, 4) AS right_mean, n_left, chosen::INT AS chosen, CASE WHEN chosen THEN round(threshold, 4) END AS tree_threshold,
       CASE WHEN chosen THEN round(left_mean, 4) END AS tree_left, CASE WHEN chosen THEN round(right_mean, 4) END AS tree_right FROM c"""
    columns = "unnest(['l_quantity', 'l_discount', 'l_tax']) AS feature, unnest([l_quantity, l_discount, l_tax]::DOUBLE[]) AS value, 1.0 AS w"
    value = "CASE feature WHEN 'l_quantity' THEN l_quantity WHEN 'l_discount' THEN l_discount ELSE l_tax END::DOUBLE"
    one = f"(WITH x AS (SELECT {columns}, l_extendedprice::DOUBLE AS y FROM lineitem),{splits} SELECT * FROM best ORDER BY gain DESC LIMIT 1)"
    rest = (f"2 * (l_extendedprice::DOUBLE - CASE WHEN {value} <= threshold THEN left_mean ELSE right_mean END)")
    two_ = f"""(WITH first AS {one},
z AS (SELECT lineitem.*, {rest} AS y FROM lineitem, first),
x AS (SELECT {columns}, y FROM z),{splits} SELECT * FROM best ORDER BY gain DESC LIMIT 1)"""
    sql["boost_rounds"] = " UNION ALL ".join(
        f"SELECT {k} AS round, feature, round(threshold, 4) AS threshold, round(left_mean, 4) AS left_mean, round(right_mean, 4) AS right_mean FROM {q}"
        for k, q in ((1, one), (2, two_)))

    levels = []
    for c in ["l_returnflag", "l_linestatus"]:
        levels.append(f"""
SELECT '{c}[T.' || {c} || ']' AS term, 0.0::DOUBLE AS moment FROM (
  SELECT DISTINCT {c}, min({c}) OVER () AS first FROM lineitem
  WHERE l_discount <> 0 AND l_quantity IS NOT NULL AND l_tax IS NOT NULL AND l_extendedprice IS NOT NULL)
WHERE {c} <> first""")
    sql["ols_full"] = """
SELECT 'l_quantity' AS term, 0.0::DOUBLE AS moment UNION ALL SELECT 'disc', 0.0::DOUBLE
UNION ALL SELECT 'l_tax', 0.0::DOUBLE UNION ALL """ + " UNION ALL ".join(levels)

    # a family's terms in order of their coefficients: the group means do not give them, the normal equations do
    sql["forest_plot"] = """
SELECT term, term_family, row_number() OVER (PARTITION BY term_family ORDER BY coef, term)::INT AS rank, 1 AS lower_below, 1 AS upper_above
FROM ({coefficients})""".replace("{coefficients}", _forest_plot_coefficients())

    split = "('0x' || substr(md5(concat_ws('|', {key}, '42')), 1, 8))::BIGINT % 10000 >= 8000"
    sql["content_split"] = f"""
WITH r AS (
  SELECT o_orderstatus, o_orderpriority, md5(concat_ws('|', coalesce(length(o_orderstatus) || ':' || o_orderstatus, '-'),
         coalesce(length(o_orderpriority) || ':' || o_orderpriority, '-'))) || '-' ||
         (row_number() OVER (PARTITION BY o_orderstatus, o_orderpriority) - 1) AS row_id FROM orders)
SELECT o_orderstatus, o_orderpriority, count(*) AS n, count(DISTINCT row_id) AS ids,
       sum(CASE WHEN {split.format(key='row_id')} THEN 1 ELSE 0 END)::BIGINT AS tests FROM r GROUP BY 1, 2"""
    sql["density_continuous"] = """
WITH m AS (
  SELECT count(l_extendedprice) AS n, stddev_samp(l_extendedprice) * count(l_extendedprice) ** (-0.2) AS h,
         min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem),
g AS (SELECT i::INT AS i, lo + i * (hi - lo) / 39 AS x, n, h FROM m, generate_series(0, 39) AS s(i)),
k AS (SELECT i, x, sum(exp(-0.5 * ((x - l_extendedprice) / h) ** 2)) / any_value(n * h * sqrt(2 * pi())) AS density FROM g, lineitem GROUP BY i, x)
SELECT i, round(x, 4) AS x, round(density * 1e9, 4) AS density FROM k"""
    sql["hash_split"] = f"SELECT o_orderkey, {split.format(key='o_orderkey')} AS is_test FROM orders"

    sql["rf_importance"] = """
SELECT i::INT AS rank, CASE WHEN i = 1 THEN 'l_quantity' END AS first, 1 AS descends, 1 AS not_negative, 1.0::DOUBLE AS total
FROM generate_series(1, (SELECT 3 + count(DISTINCT l_returnflag) - 1 + count(DISTINCT l_linestatus) - 1 FROM lineitem)) AS g(i)"""

    sql["model_comparison"] = _model_comparison(split.format(key="concat_ws('|', l_orderkey, l_linenumber)"))

    sql["linear_metrics"] = """
WITH r AS (
  SELECT regr_r2(l_extendedprice, l_quantity) AS r2, var_pop(l_extendedprice) AS vp
  FROM lineitem WHERE l_extendedprice IS NOT NULL AND l_quantity IS NOT NULL)
SELECT round(r2, 6) AS r2, round(sqrt((1 - r2) * vp), 4) AS rmse FROM r"""

    price = "CASE WHEN o_totalprice BETWEEN 20000 AND 300000 THEN o_totalprice END"
    spotty = f"WITH o AS (SELECT *, {price} AS price FROM orders)"
    sql["missing_group_stats"] = f"""
{spotty} SELECT o_orderpriority, round(avg(price), 6) AS mean, round(stddev_samp(price), 6) AS std,
       count(price) AS count FROM o WHERE o_orderpriority IS NOT NULL GROUP BY o_orderpriority"""
    sql["missing_mean_by"] = f"""
{spotty} SELECT o_orderstatus, round(avg(price), 6) AS mean_price, count(price) AS n FROM o
WHERE o_orderstatus IS NOT NULL GROUP BY o_orderstatus"""
    sql["missing_standardize"] = f"""
{spotty}, m AS (SELECT avg(price) AS mu, stddev_pop(price) AS sd FROM o)
SELECT o_orderkey, round((price - mu) / CASE WHEN sd > 0 THEN sd ELSE 1 END, 6) AS price_std FROM o, m"""
    sql["missing_describe"] = f"""
{spotty} SELECT 'price' AS variable, count(price) AS count, round(avg(price), 6) AS mean,
       round(stddev_samp(price), 6) AS std, round(min(price), 6) AS min, round(quantile_cont(price, 0.25), 6) AS q25,
       round(quantile_cont(price, 0.5), 6) AS q50, round(quantile_cont(price, 0.75), 6) AS q75,
       round(max(price), 6) AS max, count(*) - count(price) AS missing FROM o"""
    sql["numeric_label"] = """
SELECT 'l_quantity' AS variable, count(l_quantity) AS n_total, 0::BIGINT AS n_no_response, 0.0::DOUBLE AS pct_no_response
FROM lineitem WHERE l_quantity IS NOT NULL
UNION ALL SELECT 'l_linenumber', count(l_linenumber), 0::BIGINT, 0.0::DOUBLE FROM lineitem WHERE l_quantity IS NOT NULL"""
    sql["nonresponse_top"] = f"""
WITH t AS (
  SELECT 'status_label' AS variable, count(*) FILTER (WHERE {status} = 'No response') * 100.0 / count({status}) AS pct
  FROM orders
  UNION ALL SELECT 'priority_label', count(*) FILTER (WHERE o_orderpriority = '5-LOW') * 100.0 / count(o_orderpriority)
  FROM orders),
r AS (SELECT row_number() OVER (ORDER BY pct DESC, variable) AS rank, variable, pct FROM t)
SELECT rank::INTEGER AS rank, variable, round(pct, 6)::DOUBLE AS pct_no_response FROM r WHERE rank <= 2"""
    band = ("CASE WHEN l_quantity >= -20 AND l_quantity <= 0 THEN 0 WHEN l_quantity > 0 AND l_quantity <= 20 THEN 1 "
            "WHEN l_quantity > 20 AND l_quantity <= 50 THEN 2 WHEN l_quantity > 50 AND l_quantity <= 90 THEN 3 END")
    sql["crosstab_zero_cells"] = f"""
WITH dom AS (
  SELECT * FROM (SELECT unnest(['A', 'N', 'R', 'X']) AS l_returnflag),
                (SELECT unnest([0, 1, 2, 3]) AS ord, unnest(['none', 'small', 'large', 'huge']) AS band)),
c AS (SELECT l_returnflag, {band} AS ord, count(*) AS n FROM lineitem GROUP BY 1, 2),
j AS (SELECT dom.l_returnflag, dom.ord, dom.band, coalesce(c.n, 0) AS n FROM dom LEFT JOIN c USING (l_returnflag, ord)),
t AS (SELECT *, sum(n) OVER (PARTITION BY l_returnflag) AS total FROM j)
SELECT l_returnflag, ord::INTEGER AS ord, band, n::BIGINT AS n,
       round_even((CASE WHEN total > 0 THEN n * 100.0 / total END)::DOUBLE, 2) AS row_pct FROM t"""
    sql["crosstab_bands_observed"] = f"""
WITH b AS (SELECT l_returnflag, {band} AS ord FROM lineitem),
k AS (SELECT * FROM b WHERE l_returnflag IS NOT NULL AND ord IS NOT NULL),
dom AS (SELECT * FROM (SELECT DISTINCT l_returnflag FROM k), (SELECT DISTINCT ord FROM k)),
c AS (SELECT l_returnflag, ord, count(*) AS n FROM k GROUP BY 1, 2),
j AS (SELECT l_returnflag, ord, coalesce(n, 0) AS n FROM dom LEFT JOIN c USING (l_returnflag, ord))
SELECT l_returnflag, ord::INTEGER AS ord, ['none', 'small', 'large', 'huge'][ord + 1] AS band, n::BIGINT AS n,
       round((n * 100.0 / sum(n) OVER (PARTITION BY l_returnflag))::DOUBLE, 6) AS row_pct FROM j"""
    sql["full_summary"] = """
SELECT 'c_acctbal' AS variable, NULL::VARCHAR AS value, count(c_acctbal) AS n, round(avg(c_acctbal), 6) AS figure FROM customer
UNION ALL SELECT 'c_mktsegment', c_mktsegment, count(*), NULL FROM customer GROUP BY c_mktsegment
UNION ALL SELECT 'c_mktsegment_share', c_mktsegment, NULL, round(count(*) / sum(count(*)) OVER (), 6)
FROM customer GROUP BY c_mktsegment"""
    sql["to_double"] = "SELECT p_partkey, p_size::DOUBLE AS p_size FROM part"
    sql["quantile_skip"] = """
WITH q AS (
  SELECT min(l_quantity) AS e0, quantile_cont(l_quantity, CAST(1 AS DOUBLE) / 3) AS e1,
         quantile_cont(l_quantity, CAST(2 AS DOUBLE) / 3) AS e2, max(l_quantity) AS e3 FROM lineitem),
g AS (
  SELECT CASE WHEN l_quantity <= e1 THEN 'Low' WHEN l_quantity <= e2 THEN 'Medium' WHEN l_quantity <= e3 THEN 'High' END
           AS l_quantity_group FROM lineitem, q)
SELECT l_quantity_group, count(*) AS n, 'l_quantity_group' AS made FROM g GROUP BY l_quantity_group"""
    tail = """
SELECT {factor} AS {name}, f AS {f}, round(CASE WHEN df_between = 2 THEN pow(1 - x, df_within / 2)
            WHEN df_between = 4 THEN pow(1 - x, df_within / 2) * (1 + df_within / 2 * x) END, 6) AS p_value
FROM (SELECT factor, f, df_between, df_within::DOUBLE AS df_within,
             df_between * raw / (df_between * raw + df_within) AS x FROM a)"""
    raw = sql["anova_f"].replace("AS f\nFROM", "AS f,\n       (ssb / (k - 1)) / nullif(ssw / (n - k), 0) AS raw\nFROM")
    sql["anova_p"] = f"WITH a AS ({raw})" + tail.format(factor="factor", name="factor", f="f")
    sql["anova_summary"] = f"WITH a AS ({raw})" + tail.format(factor="factor", name="trait", f="F")
    return sql


def _anova_sql(level_sql: str) -> str:
    return f"""
WITH s AS ({level_sql}),
p AS (
  SELECT factor, count(*) AS k, sum(n) AS n, sum(n * mean) / sum(n) AS grand,
         sum((n - 1) * coalesce(var, 0)) AS ssw FROM s GROUP BY factor),
b AS (
  SELECT s.factor, sum(s.n * (s.mean - p.grand) * (s.mean - p.grand)) AS ssb
  FROM s JOIN p USING (factor) GROUP BY s.factor)
SELECT p.factor, CAST(k AS BIGINT) AS k, CAST(n AS BIGINT) AS n,
       CAST(k - 1 AS BIGINT) AS df_between, CAST(n - k AS BIGINT) AS df_within,
       round(CASE WHEN k >= 2 AND n - k > 0 AND ssw > 0
                  THEN (ssb / (k - 1)) / (ssw / (n - k)) END, 6) AS f
FROM p JOIN b USING (factor)"""


ORACLE_SQL = build()
