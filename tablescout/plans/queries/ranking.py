from __future__ import annotations

from pyspark.sql import functions as F

from tablescout.operators import aggregate as G
from tablescout.operators import anomaly as A
from tablescout.operators import causal as U
from tablescout.operators import correlate as X
from tablescout.operators import drivers as D
from tablescout.operators import insight as I
from tablescout.operators import windows as W
from tablescout.plans.queries.base import Registry, rounded, table, union_all

R = Registry()
_ORDER = ["o_orderdate", "o_orderkey"]


def monthly_totals(spark, d):
    """Order totals per priority and month, in whole units."""
    df = table(spark, d, "orders")
    month = F.trunc("o_orderdate", "month").alias("month")
    return df.groupBy("o_orderpriority", month).agg(F.sum(F.round("o_totalprice")).alias("total"))


_MONTHLY = """WITH m AS (SELECT o_orderpriority, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, sum(round(o_totalprice)) AS total
              FROM orders GROUP BY 1, 2)"""


@R.add("""SELECT o_custkey, o_orderkey, sum(CAST(o_totalprice * 100 AS BIGINT)) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey
          ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS cumulative FROM orders""")
def w1_cumulative_sum(spark, d):
    df = table(spark, d, "orders").withColumn("cents", F.round(F.col("o_totalprice") * 100).cast("long"))
    return W.cumulative_sum(df, "cents", ["o_custkey"], _ORDER).select("o_custkey", "o_orderkey", "cumulative")


@R.add("""SELECT o_custkey, o_orderkey, round(CASE WHEN count(o_totalprice) OVER w = 4 THEN avg(o_totalprice) OVER w END, 4) AS rolling_mean FROM orders
          WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)""")
def w2_rolling_mean(spark, d):
    out = W.rolling_mean(table(spark, d, "orders"), "o_totalprice", ["o_custkey"], _ORDER)
    return rounded(out.select("o_custkey", "o_orderkey", "rolling_mean"), 4)


@R.add("""WITH y AS (SELECT o_orderpriority, year(o_orderdate) AS year, sum(round(o_totalprice)) AS total FROM orders GROUP BY 1, 2)
          SELECT o_orderpriority, year, total, round((total - lag(total) OVER w) * 100 / lag(total) OVER w, 6) AS pct_change FROM y
          WINDOW w AS (PARTITION BY o_orderpriority ORDER BY year)""")
def w3_pct_change(spark, d):
    df = table(spark, d, "orders").groupBy("o_orderpriority", F.year("o_orderdate").cast("long").alias("year")).agg(
        F.sum(F.round("o_totalprice")).alias("total"))
    return rounded(W.pct_change(df, "total", ["o_orderpriority"], ["year"]))


@R.add("""SELECT user_id, event_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id
          ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_purchase FROM events""")
def w4_forward_fill(spark, d):
    df = table(spark, d, "events").withColumn("last_purchase", F.when(F.col("event_type") == "purchase", F.col("value")))
    return W.forward_fill(df, ["last_purchase"], ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "last_purchase")


@R.add(_MONTHLY + """ SELECT o_orderpriority, CAST(month AS VARCHAR) AS month, total, lag(total, 3) OVER (PARTITION BY o_orderpriority ORDER BY month) AS lagged FROM m""")
def w5_lagged_series(spark, d):
    out = W.lagged(monthly_totals(spark, d), "total", ["o_orderpriority"], ["month"], 3)
    return out.withColumn("month", F.col("month").cast("string"))


@R.add(_MONTHLY + """, s AS (SELECT o_orderpriority, total, lag(total, 12) OVER (PARTITION BY o_orderpriority ORDER BY month) AS b FROM m)
       SELECT o_orderpriority, count(*) AS n, round(corr(total, b), 6) AS autocorrelation, abs(corr(total, b)) > 0.3 AS is_seasonal FROM s GROUP BY 1""")
def w6_autocorrelation(spark, d):
    return rounded(W.autocorrelation(monthly_totals(spark, d), "total", ["o_orderpriority"], ["month"]))


@R.add("""SELECT o_custkey, o_orderkey, coalesce(date_diff('day', lag(o_orderdate) OVER w, o_orderdate), -1) AS gap_days FROM orders
          WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""")
def w7_date_gaps(spark, d):
    out = W.date_gaps(table(spark, d, "orders"), "o_orderdate", ["o_custkey"], ["o_orderkey"])
    return out.select("o_custkey", "o_orderkey", F.coalesce(F.col("gap_days").cast("long"), F.lit(-1)).alias("gap_days"))


@R.add("""SELECT o_custkey, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS first_order, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS last_order
          FROM orders GROUP BY 1""")
def w8_keep_first_last(spark, d):
    df = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    first = W.keep_first(df, ["o_custkey"], _ORDER).select("o_custkey", F.col("o_orderkey").alias("first_order"))
    last = W.keep_last(df, ["o_custkey"], _ORDER).select("o_custkey", F.col("o_orderkey").alias("last_order"))
    return first.join(last, "o_custkey")


@R.add("""WITH s AS (SELECT o_orderpriority, o_orderdate AS dt, sum(round(o_totalprice)) AS t FROM orders GROUP BY 1, 2)
          SELECT o_orderpriority, arg_min(t, dt) AS first_value, arg_max(t, dt) AS last_value FROM s GROUP BY 1""")
def w9_first_last_by_date(spark, d):
    df = table(spark, d, "orders").withColumn("total", F.round("o_totalprice"))
    return W.first_last(df, "total", "o_orderdate", ["o_orderpriority"])


@R.add("SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey")
def t1_sort(spark, d):
    return table(spark, d, "customer").select("c_custkey", "c_acctbal").orderBy(F.desc("c_acctbal"), "c_custkey")


@R.add("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def t2_largest(spark, d):
    return G.largest(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", 25, ["o_orderkey"])


@R.add("""WITH q AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.5) AS m, quantile_cont(value, 0.75) AS b FROM events),
          s AS (SELECT event_id, value, abs(value - m) / (b - a) AS score, (CASE WHEN value < a - 1.5 * (b - a) THEN a - 1.5 * (b - a) - value
                ELSE value - b - 1.5 * (b - a) END) / (b - a) AS far FROM events, q WHERE value < a - 1.5 * (b - a) OR value > b + 1.5 * (b - a)),
          c AS (SELECT *, CASE WHEN far > 3 THEN 'critical' WHEN far > 2 THEN 'high' WHEN far > 1.5 THEN 'medium' ELSE 'low' END AS severity FROM s)
          SELECT event_id, value, severity, round(score, 6) AS anomaly_score FROM c ORDER BY CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3
          WHEN 'medium' THEN 2 ELSE 1 END DESC, score DESC, event_id LIMIT 5""")
def t4_worst_anomalies(spark, d):
    found = A.iqr_anomalies(table(spark, d, "events"), "value", ids=["event_id"])
    return rounded(I.worst_anomalies(found, ["event_id"]).select("event_id", "value", "severity", "anomaly_score"))


_CV = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]


@R.add("SELECT * FROM (" + union_all(f"""SELECT '{c}' AS "column", round(stddev_samp({c}) / (abs(avg({c})) + 1e-10), 6) AS variation FROM lineitem""" for c in _CV)
       + ") ORDER BY variation DESC LIMIT 2")
def t5_variation_ranking(spark, d):
    return rounded(G.variation_ranking(table(spark, d, "lineitem"), _CV).select("column", "variation"))


@R.add("""SELECT 'l_quantity' AS var1, 'discount_value' AS var2, round(corr(l_quantity, l_extendedprice * l_discount), 6) AS correlation FROM lineitem
          UNION ALL SELECT 'l_extendedprice', 'discount_value', round(corr(l_extendedprice, l_extendedprice * l_discount), 6) FROM lineitem
          ORDER BY abs(correlation) DESC LIMIT 1""")
def t6_strongest_pair(spark, d):
    df = table(spark, d, "lineitem").select("l_quantity", "l_extendedprice", (F.col("l_extendedprice") * F.col("l_discount")).alias("discount_value"))
    return rounded(X.strongest_pair(X.correlations(df)).select("var1", "var2", "correlation"))


@R.add()
def t7_best_lag(spark, d):
    """The lag with the smallest p-value; the F tail has no SQL counterpart."""
    df = table(spark, d, "orders").select("o_orderdate", "o_totalprice", F.col("o_custkey").cast("double").alias("customers"))
    lags = U.granger_lags(G.daily_panel(df, "o_orderdate", ["customers", "o_totalprice"], "orders"),
                          spark.createDataFrame([("orders", "customers", "o_totalprice")], "dataset string, cause string, effect string"), 6)
    return rounded(U.best_lag(lags))


@R.add("""WITH v AS (SELECT l_extendedprice * (1 - l_discount) * (1 + l_tax) AS y, l_extendedprice AS x1, l_discount AS x2, l_tax AS x3 FROM lineitem),
          c AS (SELECT corr(x1, x2) AS a, corr(x1, x3) AS b, corr(x2, x3) AS c, corr(y, x1) AS p, corr(y, x2) AS q, corr(y, x3) AS r FROM v),
          k AS (SELECT p * (1 - c * c) + q * (b * c - a) + r * (a * c - b) AS k1, p * (b * c - a) + q * (1 - b * b) + r * (a * b - c) AS k2,
                p * (a * c - b) + q * (a * b - c) + r * (1 - a * a) AS k3 FROM c),
          o AS (SELECT unnest(['l_extendedprice', 'l_discount', 'l_tax']) AS x, unnest([k1 * k1, k2 * k2, k3 * k3]) AS s FROM k)
          SELECT string_agg(x, ', ' ORDER BY s DESC) AS features, round(sum(s * 100 / (SELECT sum(s) FROM o)), 6) AS total_pct FROM o""")
def t8_top_drivers(spark, d):
    price, discount, tax = (F.col(c) for c in ("l_extendedprice", "l_discount", "l_tax"))
    df = table(spark, d, "lineitem").select("l_extendedprice", "l_discount", "l_tax", (price * (1 - discount) * (1 + tax)).alias("charge"))
    return rounded(D.top_drivers(D.linear_drivers(df, ["l_extendedprice", "l_discount", "l_tax"], "charge")))


QUERIES, ORACLES = R.queries, R.oracles
