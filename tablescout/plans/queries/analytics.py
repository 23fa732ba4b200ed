from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from tablescout.operators import anomaly as A
from tablescout.operators import causal as U
from tablescout.operators import correlate as X
from tablescout.operators import drivers as D
from tablescout.operators import impact as M
from tablescout.operators import semantics as S
from tablescout.operators import validation as V
from tablescout.operators.aggregate import daily_panel, daily_series
from tablescout.operators.joins import star_join
from tablescout.plans import gates
from tablescout.plans.discovery import analyse_tables
from tablescout.plans.queries.base import Registry, rounded, table, tables, union_all
from tablescout.plans.queries.relations import EDGES, joined_star, star_tables

R = Registry()

_Z = """WITH g AS (SELECT event_type, avg(value) AS m, stddev_samp(value) AS s FROM events GROUP BY 1),
        z AS (SELECT e.event_type, event_id, value, m, abs(value - m) / s AS score FROM events e JOIN g USING (event_type) WHERE abs(value - m) / s > 3)"""
_Z_SEVERITY = "CASE WHEN score > 5 THEN 'critical' WHEN score > 4 THEN 'high' ELSE 'medium' END"
_Q = """WITH g AS (SELECT event_type, quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.5) AS m, quantile_cont(value, 0.75) AS b FROM events GROUP BY 1),
        z AS (SELECT e.event_type, event_id, value, m, abs(value - m) / (b - a) AS score, (CASE WHEN value < a - 1.5 * (b - a) THEN a - 1.5 * (b - a) - value
              ELSE value - b - 1.5 * (b - a) END) / (b - a) AS far FROM events e JOIN g USING (event_type)
              WHERE value < a - 1.5 * (b - a) OR value > b + 1.5 * (b - a))"""
_Q_SEVERITY = "CASE WHEN far > 3 THEN 'critical' WHEN far > 2 THEN 'high' WHEN far > 1.5 THEN 'medium' ELSE 'low' END"


def _jb(c: str) -> str:
    g1 = f"(skewness({c}) * (count({c}) - 2) / sqrt(count({c}) * (count({c}) - 1.0)))"
    return f"(count({c}) / 6.0 * (power({g1}, 2) + power(kurtosis_pop({c}), 2) / 4))"


# Two-sided tail of Student's t by Simpson's rule: a table x(t, df) gives p per key k.
_T_TAIL = """, grid AS (SELECT k, t, df, i, CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END AS w FROM x, range(0, 2001) r(i)),
    tails AS (SELECT k, greatest(0.0, 1 - 2 * sum(w * power(1 + power(abs(t) * i / 2000.0, 2) / df, -(df + 1) / 2)) * abs(t) / 6000.0
              * exp(lgamma((df + 1) / 2) - lgamma(df / 2)) / sqrt(df * pi())) AS p FROM grid GROUP BY k, t, df)"""


@R.add(f"{_Z} SELECT event_type, event_id, value, round(m, 5) AS expected_value, round(value - m, 5) AS deviation, {_Z_SEVERITY} AS severity, round(score, 6) AS anomaly_score FROM z")
def m1_zscore_anomalies(spark, d):
    out = A.zscore_anomalies(table(spark, d, "events"), "value", ["event_type"], ["event_id"]).drop("method")
    return rounded(out, 6, expected_value=5, deviation=5)


@R.add(f"{_Q} SELECT event_type, event_id, value, round(m, 6) AS expected_value, {_Q_SEVERITY} AS severity, round(score, 6) AS anomaly_score FROM z")
def m2_iqr_anomalies(spark, d):
    out = A.iqr_anomalies(table(spark, d, "events"), "value", ["event_type"], ["event_id"])
    return rounded(out.drop("method", "deviation"))


@R.add()
def m3_isolation_anomalies(spark, d):
    """Isolation forest over all events; the trees are random, so there is no SQL counterpart."""
    return A.isolation_anomalies(table(spark, d, "events"), "value", ["event_id"])


_MEASURES = [("customer", "c_acctbal"), ("supplier", "s_acctbal"), ("part", "p_retailprice"), ("events", "value"), ("orders", "o_totalprice")]


@R.add("WITH s AS (" + union_all(f"SELECT '{t}' AS dataset, '{c}' AS \"column\", count({c}) AS n, exp(-{_jb(c)} / 2) AS p FROM {t}" for t, c in _MEASURES) + """)
       SELECT dataset, "column", n, CASE WHEN n >= 5000 OR (n >= 20 AND p > 0.05) THEN 'zscore' ELSE 'iqr' END AS method FROM s""")
def m4_method_choice(spark, d):
    frames = [A.normality(table(spark, d, t), [c]).select(
        F.lit(t).alias("dataset"), "column", "n", A.choose_method(F.col("n"), F.col("p_value")).alias("method")) for t, c in _MEASURES]
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


@R.add(f"{_Z} SELECT event_type, {_Z_SEVERITY} AS severity, count(*) AS n FROM z GROUP BY 1, 2")
def m5_zscore_severity(spark, d):
    out = A.zscore_anomalies(table(spark, d, "events"), "value", ["event_type"], ["event_id"])
    return out.groupBy("event_type", "severity").agg(F.count(F.lit(1)).alias("n"))


@R.add(f"{_Q} SELECT event_type, {_Q_SEVERITY} AS severity, count(*) AS n FROM z GROUP BY 1, 2")
def m6_iqr_severity(spark, d):
    out = A.iqr_anomalies(table(spark, d, "events"), "value", ["event_type"], ["event_id"])
    return out.groupBy("event_type", "severity").agg(F.count(F.lit(1)).alias("n"))


@R.add()
def m7_forest_severity(spark, d):
    out = A.isolation_anomalies(table(spark, d, "orders"), "o_totalprice", ["o_orderkey"])
    return out.groupBy("severity").agg(F.count(F.lit(1)).alias("n"))


@R.add(f"""{_Q} SELECT count(*) FILTER ({_Q_SEVERITY} = 'low') AS low, count(*) FILTER ({_Q_SEVERITY} = 'medium') AS medium,
           count(*) FILTER ({_Q_SEVERITY} = 'high') AS high, count(*) FILTER ({_Q_SEVERITY} = 'critical') AS critical, count(*) AS total,
           round(count(*) / (SELECT count(value) FROM events), 6) AS anomaly_rate FROM z""")
def m8_severity_breakdown(spark, d):
    events = table(spark, d, "events")
    found = A.iqr_anomalies(events, "value", ["event_type"], ["event_id"])
    return rounded(A.severity_breakdown(found, events.where("value is not null").count()))


_SCANNED = {"events": ["event_id", "user_id", "value"], "customer": ["c_custkey", "c_nationkey", "c_acctbal"],
            "part": ["p_partkey", "p_size", "p_retailprice"], "labels": ["doc_id", "quality", "toxic"]}


@R.add("WITH s AS (" + union_all(f"""SELECT '{t}' AS dataset, '{c}' AS col, count({c}) AS n, exp(-{_jb(c)} / 2) AS p, avg({c}) AS m, stddev_samp({c}) AS sd,
    quantile_cont({c}::DOUBLE, 0.25) AS a, quantile_cont({c}::DOUBLE, 0.75) AS b FROM {t}""" for t, cs in _SCANNED.items() for c in cs) + "), v AS ("
    + union_all(f"SELECT '{t}' AS dataset, '{c}' AS col, {c}::DOUBLE AS x FROM {t}" for t, cs in _SCANNED.items() for c in cs) + """),
    c AS (SELECT dataset, col, any_value(n) AS n, any_value(CASE WHEN n >= 5000 OR (n >= 20 AND p > 0.05) THEN 'zscore' ELSE 'iqr' END) AS method,
          count(*) FILTER (sd > 0 AND abs(x - m) / sd > 3) AS z, count(*) FILTER (x < a - 1.5 * (b - a) OR x > b + 1.5 * (b - a)) AS q
          FROM v JOIN s USING (dataset, col) GROUP BY 1, 2)
    SELECT dataset, col AS "column", method, n AS n_values, CASE WHEN method = 'zscore' THEN z ELSE q END AS num_anomalies,
    round(CASE WHEN method = 'zscore' THEN z ELSE q END / n, 6) AS anomaly_rate FROM c""")
def m9_anomaly_scan(spark, d):
    out = A.anomaly_scan(tables(spark, d, *_SCANNED))
    return rounded(out.select("dataset", "column", "method", "n_values", "num_anomalies", "anomaly_rate"))


@R.add(union_all(f"""SELECT '{t}' AS dataset, '{c}' AS "column", count({c}) AS n, round({_jb(c)}, 3) AS jarque_bera, round(exp(-{_jb(c)} / 2), 6) AS p_value,
    exp(-{_jb(c)} / 2) > 0.05 AS is_normal FROM {t}""" for t, c in _MEASURES))
def m10_normality(spark, d):
    frames = [A.normality(table(spark, d, t), [c]).select(F.lit(t).alias("dataset"), "column", "n", "jarque_bera", "p_value", "is_normal") for t, c in _MEASURES]
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return rounded(out, 6, jarque_bera=3)


_LINE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]


@R.add(union_all(f"SELECT '{a}' AS var1, '{b}' AS var2, count(*) AS n, round(corr({a}, {b}), 6) AS correlation FROM lineitem" for a, b in combinations(_LINE, 2)))
def m11_correlations(spark, d):
    return rounded(X.correlations(table(spark, d, "lineitem"), _LINE))


_DERIVED = "(SELECT *, l_extendedprice * (1 - l_discount) AS revenue, l_extendedprice * l_discount AS rebate FROM lineitem)"


@R.add("SELECT * FROM (" + union_all(f"""SELECT '{a}' AS var1, '{b}' AS var2, round(corr({a}, {b}), 6) AS correlation FROM {_DERIVED}"""
       for a, b in combinations(["l_extendedprice", "l_discount", "revenue", "rebate"], 2)) + ") WHERE abs(correlation) > 0.3")
def m12_moderate_pairs(spark, d):
    price, discount = F.col("l_extendedprice"), F.col("l_discount")
    df = table(spark, d, "lineitem").select("l_extendedprice", "l_discount", (price * (1 - discount)).alias("revenue"), (price * discount).alias("rebate"))
    return rounded(X.correlations(df).where(F.abs("correlation") > X.MODERATE).select("var1", "var2", "correlation"))


_STAR = """lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey
           JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""


# Columns of the joined star: name there, name in SQL, table.
_ACROSS = [("l_quantity", "l_quantity", "lineitem"), ("l_extendedprice", "l_extendedprice", "lineitem"), ("orders_o_totalprice", "o_totalprice", "orders"),
           ("part_p_retailprice", "p_retailprice", "part"), ("customer_c_acctbal", "c_acctbal", "customer"), ("supplier_s_acctbal", "s_acctbal", "supplier")]


@R.add("SELECT * FROM (" + union_all(f"""SELECT '{a[0]}' AS var1, '{b[0]}' AS var2, '{a[2]}' AS table1, '{b[2]}' AS table2, round(corr({a[1]}, {b[1]}), 6) AS correlation FROM {_STAR}"""
       for a, b in combinations(_ACROSS, 2) if a[2] != b[2]) + ") WHERE abs(correlation) > 0.002")
def m13_cross_table_correlations(spark, d):
    """The given columns are independent, so the limit is lowered from 0.7 to show pairs."""
    star = star_join(star_tables(spark, d), EDGES, "lineitem")
    out = X.cross_table_correlations(star.df, star.lineage, [c for c, _, _ in _ACROSS], limit=0.002)
    return rounded(out.select("var1", "var2", "table1", "table2", "correlation"))


_TRENDS = [("orders", "o_orderdate", "o_totalprice"), ("lineitem", "l_shipdate", "l_extendedprice"), ("events", "ts", "value"), ("events", "ts", "event_id")]


@R.add("WITH r AS (" + union_all(f"""SELECT '{t}.{m}' AS k, CAST(regr_count({m}, epoch({c}) - 946684800) AS BIGINT) AS n, regr_slope({m}, epoch({c}) - 946684800) AS slope,
    corr({m}, epoch({c}) - 946684800) AS r FROM {t}""" for t, c, m in _TRENDS) + "), x AS (SELECT k, r * sqrt((n - 2) / (1 - r * r)) AS t, n - 2.0 AS df FROM r)"
    + _T_TAIL + """ SELECT r.k AS series, n, round(slope * 86400, 6) AS slope_per_day, round(r, 6) AS correlation, round(greatest(p, 0), 5) AS p_value, p < 0.05 AS is_significant,
    CASE WHEN slope > 0 THEN 'increasing' ELSE 'decreasing' END AS direction, CASE WHEN abs(r) > 0.7 THEN 'strong' ELSE 'moderate' END AS strength FROM r JOIN tails USING (k)""")
def m14_linear_trend(spark, d):
    frames = [X.linear_trend(table(spark, d, t), c, [m]).select(
        F.concat(F.lit(f"{t}."), "metric").alias("series"), "n", (F.col("slope") * 86400).alias("slope_per_day"), "correlation", "p_value",
        "is_significant", "direction", "strength") for t, c, m in _TRENDS]
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return rounded(out, 6, p_value=5)


@R.add(f"""SELECT 'sales_with_growth' AS metric, round(corr(l_extendedprice + date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) * 10,
           epoch(o_orderdate) - 946684800), 6) AS correlation, 'increasing' AS direction FROM {_STAR}""")
def m15_cross_table_trend(spark, d):
    joined = joined_star(spark, d)
    days = F.datediff(F.col("orders_o_orderdate").cast("date"), F.lit("1995-01-01").cast("date"))
    df = joined.select("orders_o_orderdate", (F.col("l_extendedprice") + days * 10).alias("sales_with_growth"),
                       F.col("part_p_retailprice").alias("unit_cost"))
    return rounded(X.headline_trend(df, "orders_o_orderdate").select("metric", "correlation", "direction"))


def _impact(rows: str, by: str) -> str:
    """Impact statistics in SQL over rows with group k, value v and side after."""
    return f"""WITH s AS (SELECT {by} AS k, count(v) FILTER (NOT after) AS n1, count(v) FILTER (after) AS n2, avg(v) FILTER (NOT after) AS m1, avg(v) FILTER (after) AS m2,
        var_samp(v) FILTER (NOT after) AS v1, var_samp(v) FILTER (after) AS v2 FROM ({rows}) GROUP BY 1),
    q AS (SELECT *, sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)) AS sp, sqrt(v1 / n1 + v2 / n2) AS se, n1 + n2 - 2.0 AS df, 1.959963984540054 AS z FROM s),
    x AS (SELECT k, (m2 - m1) / (sp * sqrt(1.0 / n1 + 1.0 / n2)) AS t, df FROM q){_T_TAIL},
    f AS (SELECT q.*, x.t, p, z + (power(z, 3) + z) / (4 * q.df) + (5 * power(z, 5) + 16 * power(z, 3) + 3 * z) / (96 * q.df * q.df)
          + (3 * power(z, 7) + 19 * power(z, 5) + 17 * power(z, 3) - 15 * z) / (384 * power(q.df, 3)) AS tq
          FROM q JOIN x USING (k) JOIN tails USING (k))"""


_IMPACT_OUT = """ SELECT k, n1 AS n_before, n2 AS n_after, round(m2 - m1, 4) AS estimated_impact, round(t, 4) AS t_statistic, round(p, 5) AS p_value, p < 0.05 AS is_significant,
    round(m2 - m1 - tq * se, 3) AS ci_low, round(m2 - m1 + tq * se, 3) AS ci_high, round((m2 - m1) / sp, 5) AS cohens_d, round((m2 - m1) / m1 * 100, 4) AS percent_change,
    CASE WHEN abs((m2 - m1) / sp) < 0.2 THEN 'negligible' WHEN abs((m2 - m1) / sp) < 0.5 THEN 'small' WHEN abs((m2 - m1) / sp) < 0.8 THEN 'medium' ELSE 'large' END AS effect_size FROM f"""
_IMPACT_COLUMNS = ("n_before", "n_after", "estimated_impact", "t_statistic", "p_value", "is_significant", "ci_low", "ci_high", "cohens_d", "percent_change", "effect_size")


def _impact_frame(out, key):
    return rounded(out.select(F.col(key).alias("k"), *_IMPACT_COLUMNS), 4, p_value=5, ci_low=3, ci_high=3, cohens_d=5)


@R.add(_impact("SELECT o_orderpriority, o_totalprice AS v, o_orderstatus = 'F' AS after FROM orders", "o_orderpriority") + _IMPACT_OUT)
def m16_impact(spark, d):
    return _impact_frame(M.estimate_impact(table(spark, d, "orders"), "o_totalprice", F.col("o_orderstatus") == "F", ["o_orderpriority"]), "o_orderpriority")


@R.add(_impact("SELECT event_type, value + CASE WHEN ts >= TIMESTAMP '2024-01-16' THEN 30 ELSE 0 END AS v, ts >= TIMESTAMP '2024-01-16' AS after FROM events", "event_type") + _IMPACT_OUT)
def m17_time_split_impact(spark, d):
    events = table(spark, d, "events")
    lifted = events.withColumn("value", F.col("value") + F.when(F.col("ts") >= F.lit("2024-01-16").cast("timestamp_ntz"), 30).otherwise(0))
    return _impact_frame(M.time_split_impact(lifted, "ts", "value", "2024-01-16", ["event_type"]), "event_type")


@R.add(_impact("SELECT s_nationkey, l_quantity + CASE WHEN l_returnflag = 'A' THEN l_suppkey % 15 ELSE 0 END AS v, l_returnflag = 'A' AS after FROM lineitem JOIN supplier ON l_suppkey = s_suppkey",
               "s_nationkey") + """ SELECT k, CASE WHEN abs((m2 - m1) / sp) < 0.2 THEN 'negligible' WHEN abs((m2 - m1) / sp) < 0.5 THEN 'small'
       WHEN abs((m2 - m1) / sp) < 0.8 THEN 'medium' ELSE 'large' END AS effect_size FROM f""")
def m18_effect_size(spark, d):
    df = table(spark, d, "lineitem").join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    returned = F.col("l_returnflag") == "A"
    df = df.withColumn("v", F.col("l_quantity") + F.when(returned, F.col("l_suppkey") % 15).otherwise(0))
    return M.estimate_impact(df, "v", returned, ["s_nationkey"]).select(F.col("s_nationkey").alias("k"), "effect_size")


@R.add("""WITH e AS (SELECT value AS v, ts >= TIMESTAMP '2024-01-16' AS after FROM events), md AS (SELECT median(v) FILTER (NOT after) AS a, median(v) FILTER (after) AS b FROM e),
          z AS (SELECT after, abs(v - CASE WHEN after THEN b ELSE a END) AS z FROM e, md),
          s AS (SELECT count(*) FILTER (NOT after) AS n1, count(*) FILTER (after) AS n2, avg(z) FILTER (NOT after) AS m1, avg(z) FILTER (after) AS m2,
                var_samp(z) FILTER (NOT after) AS v1, var_samp(z) FILTER (after) AS v2, avg(z) AS m FROM z),
          f AS (SELECT n1, n2, (n1 + n2 - 2) * (n1 * power(m1 - m, 2) + n2 * power(m2 - m, 2)) / ((n1 - 1) * v1 + (n2 - 1) * v2) AS w FROM s),
          x AS (SELECT 1 AS k, sqrt(w) AS t, n1 + n2 - 2.0 AS df FROM f)""" + _T_TAIL +
       " SELECT n1 AS n_before, n2 AS n_after, round(w, 5) AS statistic, round(p, 5) AS p_value, p > 0.05 AS equal_variance FROM f, tails")
def m19_levene(spark, d):
    after = F.col("ts") >= F.lit("2024-01-16").cast("timestamp_ntz")
    return rounded(M.levene(table(spark, d, "events"), "value", after), 5)


@R.add("WITH e AS (SELECT s_nationkey AS k, s_acctbal AS v, s_suppkey % 4 = 0 AS after FROM supplier), s AS (SELECT k, count(v) FILTER (NOT after) AS n1, count(v) FILTER (after) AS n2 "
       "FROM e GROUP BY 1) SELECT k, n1 + n2 AS sample_size, n1 >= 30 AND n2 >= 30 AS sample_size_adequate FROM s WHERE n1 >= 2 AND n2 >= 2")
def m20_impact_validation(spark, d):
    out = M.estimate_impact(table(spark, d, "supplier"), "s_acctbal", F.col("s_suppkey") % 4 == 0, ["s_nationkey"])
    return M.validate_impact(out).select(F.col("s_nationkey").alias("k"), "sample_size", "sample_size_adequate")


@R.add(_impact(f"SELECT r_name, l_extendedprice AS v, o_orderdate >= TIMESTAMP '1998-06-01' AS after FROM {_STAR}", "r_name") + _IMPACT_OUT)
def m21_cross_table_impact(spark, d):
    return _impact_frame(M.time_split_impact(joined_star(spark, d), "orders_o_orderdate", "l_extendedprice", "1998-06-01", ["region_r_name"]), "region_r_name")


def daily_orders(spark, d):
    df = table(spark, d, "orders").select("o_orderdate", F.col("o_totalprice").alias("revenue"), F.col("o_custkey").cast("double").alias("customers"),
                                          F.lit(1.0).alias("orders"))
    return df


_DAILY = """WITH s AS (SELECT CAST(o_orderdate AS DATE) AS day, sum(o_totalprice) AS revenue, sum(o_custkey) AS customers, count(*) AS orders FROM orders GROUP BY 1)"""


def _lag1(cause: str, effect: str) -> str:
    """F statistic of lag 1 from three correlations."""
    return f"""SELECT '{cause}' AS cause, '{effect}' AS effect, t, ((1 - a * a) - (1 - ru)) / ((1 - ru) / (t - 3)) AS f FROM (
        SELECT *, (a * a + b * b - 2 * a * b * c) / (1 - c * c) AS ru FROM (
        SELECT count(*) AS t, corr(y, y1) AS a, corr(y, x1) AS b, corr(y1, x1) AS c FROM (
        SELECT {effect} AS y, lag({effect}) OVER (ORDER BY day) AS y1, lag({cause}) OVER (ORDER BY day) AS x1 FROM s) WHERE y1 IS NOT NULL))"""


def _lag1_pairs(pairs) -> str:
    return _DAILY + ", g AS (" + union_all(_lag1(a, b) for a, b in pairs) + "), x AS (SELECT concat(cause, effect) AS k, sqrt(greatest(f, 0)) AS t, t - 3.0 AS df FROM g)" + _T_TAIL


@R.add(_lag1_pairs([("customers", "revenue")]) + " SELECT cause, effect, CAST(1 AS BIGINT) AS lag, round(f, 5) AS f_statistic, round(p, 5) AS p_value FROM g JOIN tails ON k = concat(cause, effect)")
def m31_granger_lag(spark, d):
    panel = daily_panel(daily_orders(spark, d), "o_orderdate", ["customers", "revenue"], "orders")
    pair = spark.createDataFrame([("orders", "customers", "revenue")], "dataset string, cause string, effect string")
    return rounded(U.granger_lags(panel, pair, 1).select("cause", "effect", "lag", "f_statistic", "p_value"), 5)


@R.add()
def m31_granger_all_lags(spark, d):
    """All lags up to 12; least squares of that size is tested against numpy instead of SQL."""
    panel = daily_panel(daily_orders(spark, d), "o_orderdate", ["customers", "revenue"], "orders")
    pair = spark.createDataFrame([("orders", "customers", "revenue")], "dataset string, cause string, effect string")
    return rounded(U.granger_lags(panel, pair, 12))


@R.add(_DAILY + """, l AS (SELECT revenue, lag(customers, 5) OVER (ORDER BY day) AS x FROM s)
       SELECT 'customers' AS cause, 'revenue' AS effect, 5 AS lag, round(corr(revenue, x), 6) AS correlation FROM l""")
def m32_lagged_correlation(spark, d):
    daily = daily_series(daily_orders(spark, d), "o_orderdate", ["customers", "revenue"])
    return rounded(U.lagged_correlation(daily, "customers", "revenue", 5))


_CAUSES = ["customers", "orders"]


@R.add(_lag1_pairs([("customers", "revenue"), ("orders", "revenue"), ("revenue", "customers"), ("revenue", "orders")]) +
       " SELECT cause, effect, CASE WHEN p >= 0.05 THEN 'none' WHEN p < 0.01 THEN 'strong' ELSE 'moderate' END AS strength FROM g JOIN tails ON k = concat(cause, effect)")
def m33_causal_strength(spark, d):
    panel = daily_panel(daily_orders(spark, d), "o_orderdate", ["customers", "revenue", "orders"], "orders")
    pairs = [("orders", a, b) for a, b in [("customers", "revenue"), ("orders", "revenue"), ("revenue", "customers"), ("revenue", "orders")]]
    frame = spark.createDataFrame(pairs, "dataset string, cause string, effect string")
    return U.best_lag(U.granger_lags(panel, frame, 1)).select("cause", "effect", "strength")


@R.add(_lag1_pairs([(c, "revenue") for c in _CAUSES]) + """ SELECT cause, effect, round(f, 5) AS f_statistic, round(p, 5) AS p_value, p < 0.05 AS is_significant,
       2 AS total_tested FROM g JOIN tails ON k = concat(cause, effect)""")
def m34_many_causes(spark, d):
    out = U.causes_of(daily_orders(spark, d), "o_orderdate", _CAUSES, "revenue", "orders", 1)
    return rounded(out.select("cause", "effect", "f_statistic", "p_value", "is_significant", "total_tested"), 5)


@R.add(_lag1_pairs(list(combinations(["revenue", "customers", "orders"], 2))) + """ SELECT 'orders' AS dataset, cause, effect, round(f, 5) AS f_statistic, round(p, 5) AS p_value,
       p < 0.05 AS is_significant FROM g JOIN tails ON k = concat(cause, effect)""")
def m35_all_pairs_causal(spark, d):
    out = U.all_causes(daily_orders(spark, d), "o_orderdate", ["revenue", "customers", "orders"], "orders", 1, significant_only=False)
    return rounded(out.select("dataset", "cause", "effect", "f_statistic", "p_value", "is_significant"), 5)


@R.add()
def m36_likely_cause(spark, d):
    """Best correlated pair, then up to 10 lags on daily sums."""
    return rounded(U.likely_cause(daily_orders(spark, d), "o_orderdate", ["revenue", "customers", "orders"], "orders"))


@R.add()
def m36_cross_table_cause(spark, d):
    joined = joined_star(spark, d).select("orders_o_orderdate", F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("revenue"))
    return rounded(U.cross_table_cause(joined, "orders_o_orderdate"))


@R.add("""WITH r AS (SELECT count(*) AS n, corr(y, x1) AS a, corr(y, x2) AS b, corr(x1, x2) AS c, stddev_pop(y) AS s FROM (
            SELECT l_extendedprice * (1 - l_discount) AS y, l_extendedprice AS x1, l_discount AS x2 FROM lineitem)),
          k AS (SELECT *, (a - b * c) / (1 - c * c) AS p, (b - a * c) / (1 - c * c) AS q FROM r)
          SELECT 'l_extendedprice' AS feature, round(p * s, 3) AS coefficient, round(p * p / (p * p + q * q), 6) AS contribution, p > 0 AS is_positive,
          round(p * a + q * b, 6) AS r_squared, n FROM k UNION ALL
          SELECT 'l_discount', round(q * s, 3), round(q * q / (p * p + q * q), 6), q > 0, round(p * a + q * b, 6), n FROM k""")
def m37_linear_drivers(spark, d):
    df = table(spark, d, "lineitem").select("l_extendedprice", "l_discount", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"))
    out = D.linear_drivers(df, ["l_extendedprice", "l_discount"], "revenue")
    return rounded(out.select("feature", "coefficient", "contribution", "is_positive", "r_squared", "n"), 6, coefficient=3)


@R.add()
def m38_forest_drivers(spark, d):
    df = table(spark, d, "lineitem").select("l_quantity", "l_extendedprice", "l_discount", "l_tax",
                                            (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"))
    return rounded(D.forest_drivers(df, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], "revenue"))


_FACTORS = [(m, c) for m in ("l_quantity", "l_extendedprice", "l_discount") for c in ("l_returnflag", "l_linestatus")]


@R.add(union_all(f"""SELECT '{m}' AS metric, '{c}' AS factor, count(*) AS levels, sum(n)::BIGINT AS n,
    round(sum(n * power(a - g, 2)) / (sum(n * power(a - g, 2)) + sum(n * v)), 8) AS variance_explained FROM (
    SELECT count({m}) AS n, avg({m}) AS a, var_pop({m}) AS v FROM lineitem GROUP BY {c}), (SELECT avg({m}) AS g FROM lineitem)""" for m, c in _FACTORS))
def m39_categorical_drivers(spark, d):
    return rounded(D.categorical_drivers(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"]), 8)


@R.add(f"""WITH v AS (SELECT l_extendedprice * (1 - l_discount) AS y, l_quantity AS x1, l_extendedprice AS x2, l_discount AS x3 FROM {_STAR}),
           c AS (SELECT count(*) AS n, corr(x1, x2) AS a, corr(x1, x3) AS b, corr(x2, x3) AS c, corr(y, x1) AS p, corr(y, x2) AS q, corr(y, x3) AS r FROM v),
           k AS (SELECT n, 1 + 2 * a * b * c - a * a - b * b - c * c AS det, p * (1 - c * c) + q * (b * c - a) + r * (a * c - b) AS k1,
                 p * (b * c - a) + q * (1 - b * b) + r * (a * b - c) AS k2, p * (a * c - b) + q * (a * b - c) + r * (1 - a * a) AS k3 FROM c),
           s AS (SELECT *, k1 * k1 + k2 * k2 + k3 * k3 AS t FROM k)
           SELECT 'quantity' AS feature, round(k1 * k1 / t, 6) AS contribution, n FROM s UNION ALL SELECT 'list', round(k2 * k2 / t, 6), n FROM s UNION ALL
           SELECT 'discount', round(k3 * k3 / t, 6), n FROM s""")
def m41_cross_table_drivers(spark, d):
    joined = joined_star(spark, d).select(
        F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("list"), F.col("l_discount").alias("discount"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"))
    return rounded(D.cross_table_drivers(joined).select("feature", "contribution", "n"))


@R.add()
def m42_segmentation(spark, d):
    features = ["orders", "revenue", "balance"]
    orders = table(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).cast("double").alias("orders"), F.sum("o_totalprice").alias("revenue"))
    customers = table(spark, d, "customer").join(orders, F.col("c_custkey") == F.col("o_custkey")).withColumnRenamed("c_acctbal", "balance")
    return rounded(D.segment_profile(D.segment(customers, features), features), 3)


_PANEL = """WITH m AS (SELECT o_orderpriority AS k, CAST(date_trunc('month', o_orderdate) AS DATE) AS day, sum(round(o_totalprice)) AS v FROM orders GROUP BY 1, 2),
    l AS (SELECT k, v, lag(v) OVER w AS b, lag(v, 12) OVER w AS c FROM m WINDOW w AS (PARTITION BY k ORDER BY day)),
    r AS (SELECT k, count(b) AS n, regr_slope(v - b, b) AS s, regr_sxx(v - b, b) AS sxx, regr_syy(v - b, b) AS syy, corr(v, c) AS ac, count(*) AS rows FROM l GROUP BY k),
    a AS (SELECT k, rows, ac, s / sqrt((syy - s * s * sxx) / (n - 2) / sxx) AS t, -2.86154 - 2.8903 / n - 4.234 / (n * n) - 40.04 / (n * n * n) AS crit FROM r)"""


def monthly_panel(spark, d):
    return table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("k"), F.trunc("o_orderdate", "month").alias("day")).agg(
        F.sum(F.round("o_totalprice")).alias("value"))


def _level(score: str) -> str:
    return f"CASE WHEN {score} >= 0.9 THEN 'VERY_HIGH' WHEN {score} >= 0.7 THEN 'HIGH' WHEN {score} >= 0.5 THEN 'MEDIUM' WHEN {score} >= 0.3 THEN 'LOW' ELSE 'VERY_LOW' END"


@R.add(_PANEL + f""", s AS (SELECT *, round(1 - CASE WHEN t < crit THEN 0 ELSE 0.1 END, 6) AS score FROM a)
       SELECT k, t < crit AS is_stationary, abs(ac) > 0.3 AS is_seasonal, true AS is_valid, score AS confidence_score, {_level('score')} AS confidence_level,
       rows AS sample_size, CAST(30 AS BIGINT) AS min_required_sample FROM s""")
def v1_forecast_validation(spark, d):
    out = V.validate_forecast(monthly_panel(spark, d), ["k"], "day", horizon=6)
    return rounded(out.select("k", "is_stationary", "is_seasonal", "is_valid", "confidence_score", "confidence_level", "sample_size", "min_required_sample"))


@R.add(_DAILY + """, c AS (SELECT abs(corr(customers, revenue)) AS r, count(*) AS n FROM s) SELECT 'customers -> revenue' AS pair, r > 0.1 AS has_correlation,
       n >= 60 AS is_valid, n AS sample_size, CAST(60 AS BIGINT) AS min_required_sample FROM c""")
def v2_causal_validation(spark, d):
    daily = daily_series(daily_orders(spark, d), "o_orderdate", ["customers", "revenue"])
    return V.validate_causal(daily, "customers", "revenue", "day").select("pair", "has_correlation", "is_valid", "sample_size", "min_required_sample")


@R.add("""WITH s AS (SELECT count(*) AS n, abs(corr(l_extendedprice, l_extendedprice * (1 - l_discount))) AS r, var_samp(l_quantity) AS v FROM lineitem)
          SELECT 'l_quantity' AS target, r <= 0.9 AS low_multicollinearity, v > 0 AS target_has_variance, n >= 30 AS is_valid,
          CASE WHEN r > 0.9 THEN 'multicollinearity in 2 pairs' ELSE '' END AS warnings, round(CASE WHEN r > 0.9 THEN 0.9 ELSE 1.0 END, 6) AS confidence_score, n AS sample_size FROM s""")
def v3_regression_validation(spark, d):
    df = table(spark, d, "lineitem").select("l_quantity", "l_extendedprice", "l_tax", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net"))
    out = V.validate_regression(df, ["l_extendedprice", "l_tax", "net"], "l_quantity")
    return rounded(out.select("target", "low_multicollinearity", "target_has_variance", "is_valid", "warnings", "confidence_score", "sample_size"))


_CHECKED = [("customer", "c_acctbal"), ("region", "r_regionkey"), ("nation", "n_regionkey"), ("events", "value")]


def _anomaly_check(t: str, c: str) -> str:
    return f"""SELECT '{t}' AS dataset, '{c}' AS "column", count({c}) AS n, exp(-{_jb(c)} / 2) > 0.05 AS normal_distribution, stddev_samp({c}) > 0 AS has_variance FROM {t}"""


_SCORED = "WITH c AS (" + union_all(_anomaly_check(t, c) for t, c in _CHECKED) + """), s AS (SELECT *, greatest(0, (1 - CASE WHEN n < 30 THEN 0.3 ELSE 0 END
    - CASE WHEN normal_distribution THEN 0 ELSE 0.1 END) * CASE WHEN n < 30 THEN n / 30 ELSE 1 END) AS score FROM c)"""


def _anomaly_validation(spark, d):
    frames = [V.validate_anomaly(table(spark, d, t), [c]).select(F.lit(t).alias("dataset"), "*") for t, c in _CHECKED]
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


@R.add(_SCORED + ' SELECT dataset, "column", normal_distribution, has_variance, n >= 30 AS is_valid, n AS sample_size FROM s')
def v4_anomaly_validation(spark, d):
    return _anomaly_validation(spark, d).select("dataset", "column", "normal_distribution", "has_variance", "is_valid", "sample_size")


@R.add(_SCORED + ' SELECT dataset, "column", round(score, 6) AS confidence_score FROM s')
def v5_confidence_score(spark, d):
    return rounded(_anomaly_validation(spark, d).select("dataset", "column", "confidence_score"))


@R.add(_SCORED + f""" SELECT dataset, "column", {_level('round(score, 9)')} AS confidence_level FROM s""")
def v6_confidence_level(spark, d):
    return _anomaly_validation(spark, d).select("dataset", "column", "confidence_level")


_ALL = ("region", "nation", "customer", "orders", "lineitem", "events", "labels")
_ANALYSES = "(VALUES " + ", ".join(f"('{a[0]}', {a[3]})" for a in V.ANALYSES) + ") v(analysis, needed)"


@R.add(f"""SELECT t.dataset, v.analysis, v.needed AS min_observations FROM ({union_all(f"SELECT '{t}' AS dataset, count(*) AS n FROM {t}" for t in _ALL)}) t, {_ANALYSES} WHERE n >= v.needed""")
def v7_analysis_catalog(spark, d):
    """Analyses that each table has enough rows for."""
    sizes = S.dataset_sizes(tables(spark, d, *_ALL))
    catalog = V.analysis_catalog(spark).select("analysis", "min_observations")
    return sizes.join(catalog, F.col("row_count") >= F.col("min_observations")).select("dataset", "analysis", "min_observations")


_SHAPES = [("region", 1, 0), ("nation", 2, 0), ("customer", 3, 0), ("orders", 3, 1), ("lineitem", 8, 1), ("events", 3, 1), ("labels", 3, 0)]
_SHAPE_SQL = union_all(f"SELECT '{t}' AS dataset, count(*) AS n, {m} AS nums, {c} AS dates FROM {t}" for t, m, c in _SHAPES)


@R.add(f"""WITH t AS ({_SHAPE_SQL}), r AS (SELECT dataset, 'anomaly_detection' AS analysis, 1 AS priority, 0 AS o FROM t WHERE nums >= 1 AND n >= 30 UNION ALL
           SELECT dataset, 'trend_analysis', 2, 1 FROM t WHERE dates > 0 AND n >= 20 UNION ALL
           SELECT dataset, 'causal_analysis', 1, 2 FROM t WHERE dates > 0 AND n >= 20 AND nums >= 2)
           SELECT dataset, analysis, priority, row_number() OVER (PARTITION BY dataset ORDER BY priority, o) AS rank FROM r QUALIFY rank <= 2""")
def v8_analysis_selection(spark, d):
    return V.select_analyses(tables(spark, d, *_ALL), most=2).select("dataset", "analysis", "priority", F.col("rank").cast("long").alias("rank"))


@R.add(f"""WITH t AS ({_SHAPE_SQL}), a AS (SELECT * FROM (VALUES ('time_series_forecast', 20), ('causal_analysis', 50)) v(analysis, needed))
           SELECT dataset, analysis, CASE WHEN dates = 0 THEN 'no date column' ELSE concat('needs ', needed, ' observations, has ', n) END AS reason
           FROM t, a WHERE dates = 0 OR n < needed""")
def v9_skipped_analyses(spark, d):
    return V.explain_skipped(tables(spark, d, *_ALL)).select("dataset", "analysis", "reason")


@R.add("""SELECT 'o_orderdate' AS "column", count(*) AS n_rows, count(DISTINCT CAST(o_orderdate AS DATE)) AS dates,
          date_diff('day', CAST(min(o_orderdate) AS DATE), CAST(max(o_orderdate) AS DATE)) AS span_days, 'o_totalprice' AS key_metrics FROM orders UNION ALL
          SELECT 'ts', count(*), count(DISTINCT CAST(ts AS DATE)), date_diff('day', CAST(min(ts) AS DATE), CAST(max(ts) AS DATE)), 'value' FROM events""")
def v10_time_series_profile(spark, d):
    a = S.time_series_profile(table(spark, d, "orders"), "o_orderdate")
    b = S.time_series_profile(table(spark, d, "events"), "ts")
    return a.unionByName(b).select("column", F.col("rows").alias("n_rows"), "dates", F.col("span_days").cast("long").alias("span_days"), "key_metrics")


# Number of columns and of days by date column, as the plan of analyses sees them.
_PLANNED = {"region": (["r_regionkey"], None), "nation": (["n_nationkey", "n_regionkey"], None), "labels": (["doc_id", "quality", "toxic"], None),
            "events": (["event_id", "user_id", "value"], "ts"), "orders": (["o_orderkey", "o_custkey", "o_totalprice"], "o_orderdate")}


def _issues(*pairs: tuple[str, str]) -> str:
    return "concat_ws('; ', " + ", ".join(f"CASE WHEN {when} THEN '{text}' END" for when, text in pairs) + ")"


_PLAN_SQL = union_all(
    [f"""SELECT 'anomaly_detection' AS analysis, '{t}' AS dataset, '{c}' AS subject, count({c}) AS sample_size, CAST(30 AS BIGINT) AS min_required_sample,
        {_issues((f"count({c}) < 30", "sample too small"), (f"stddev_samp({c}) = 0", "no variance"))} AS critical_issues FROM {t}"""
     for t, (cs, _) in _PLANNED.items() for c in cs]
    + [f"""SELECT 'time_series_forecast', '{t}', '{c}', count(DISTINCT CAST({d} AS DATE)), CAST(30 AS BIGINT),
        {_issues((f"count(DISTINCT CAST({d} AS DATE)) < 30", "sample too small"))} FROM {t} WHERE {c} IS NOT NULL"""
       for t, (cs, d) in _PLANNED.items() if d for c in cs]
    + [f"""SELECT 'causal_analysis', '{t}', '{a} -> {b}', least(count(DISTINCT CASE WHEN {a} IS NOT NULL THEN CAST({d} AS DATE) END),
        count(DISTINCT CASE WHEN {b} IS NOT NULL THEN CAST({d} AS DATE) END)) AS n, CAST(60 AS BIGINT), CASE WHEN n < 60 THEN 'sample too small' ELSE '' END FROM {t}"""
       for t, (cs, d) in _PLANNED.items() if d for a, b in combinations(cs, 2)])


@R.add(_PLAN_SQL)
def v8_analysis_plan(spark, d):
    """What the checks say about every column, daily series and pair of series before any analysis runs."""
    checks = gates.analysis_plan(tables(spark, d, *_PLANNED)).checks
    return checks.select("analysis", "dataset", "subject", "sample_size", "min_required_sample", "critical_issues")


@R.add(f"""WITH p AS ({_PLAN_SQL}), r AS (SELECT *, critical_issues = '' AS ok FROM p),
       n AS ({union_all(f"SELECT '{t}' AS dataset, count(*) AS n, {bool(x[1])} AS dated FROM {t}" for t, x in _PLANNED.items())})
       SELECT 'anomaly' AS result, dataset, subject, 'ran' AS state FROM r WHERE analysis = 'anomaly_detection' AND ok UNION ALL
       SELECT 'forecast', dataset, subject, 'ran' FROM r WHERE analysis = 'time_series_forecast' AND ok UNION ALL
       SELECT 'skipped', dataset, concat(analysis, ': ', subject), critical_issues FROM r WHERE NOT ok UNION ALL
       SELECT 'skipped', dataset, concat(a, ': *'), CASE WHEN NOT dated THEN 'no date column' ELSE concat('needs ', need, ' observations, has ', n) END
       FROM n, (VALUES ('time_series_forecast', 20), ('causal_analysis', 50)) v(a, need) WHERE NOT dated OR n < need""")
def v9_gated_analyses(spark, d):
    """What the flow over tables computed and what it skipped, with the reason."""
    out = analyse_tables(tables(spark, d, *_PLANNED))
    ran = [out[k].select(F.lit(k).alias("result"), "dataset", F.col(c).alias("subject"), F.lit("ran").alias("state")).distinct()
           for k, c in (("anomaly", "column"), ("forecast", "metric")) if k in out]
    skipped = out["skipped"].select(F.lit("skipped").alias("result"), "dataset", F.concat("skipped_analysis", F.lit(": "), "subject").alias("subject"),
                                    F.col("reason").alias("state"))
    for frame in ran:
        skipped = skipped.unionByName(frame)
    return skipped


QUERIES, ORACLES = R.queries, R.oracles
