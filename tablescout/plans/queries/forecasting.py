from __future__ import annotations

from pyspark.sql import functions as F

from tablescout.operators import forecast as T
from tablescout.operators import validation as V
from tablescout.plans.queries.analytics import _PANEL, monthly_panel
from tablescout.plans.queries.base import Registry, rounded, table, tables

R = Registry()

# The most usual gap between neighbouring days of a series ``s(k, day)``, of equally usual ones the shorter, and its letter.
RHYTHM = """, g AS (SELECT k, date_diff('day', lag(day) OVER (PARTITION BY k ORDER BY day), day) AS gap FROM s),
    u AS (SELECT k, gap, count(*) AS n FROM g WHERE gap IS NOT NULL GROUP BY k, gap QUALIFY row_number() OVER (PARTITION BY k ORDER BY n DESC, gap) = 1),
    f AS (SELECT k, CASE WHEN gap = 1 THEN 'D' WHEN gap = 7 THEN 'W' WHEN gap BETWEEN 28 AND 31 THEN 'M' WHEN gap BETWEEN 90 AND 92 THEN 'Q'
                         WHEN gap BETWEEN 365 AND 366 THEN 'Y' ELSE 'M' END AS frequency FROM u)"""

_OUT = ("step", "day", "prediction", "lower", "upper", "model", "frequency")


def order_panel(spark, d):
    """Daily order totals per priority."""
    df = table(spark, d, "orders").select("o_orderdate", F.col("o_orderpriority").alias("k"), F.col("o_totalprice").alias("revenue"))
    return df.groupBy("k", F.col("o_orderdate").cast("date").alias("day")).agg(F.sum("revenue").alias("value"))


@R.add()
def m22_additive_forecast(spark, d):
    """Least squares on trend and waves per series; checked by accuracy bounds in the tests."""
    return rounded(T.forecast(order_panel(spark, d), ["k"], 7, "additive").select("k", *_OUT), 4)


@R.add()
def m23_arima_forecast(spark, d):
    return rounded(T.forecast(monthly_panel(spark, d), ["k"], 6, "arima").select("k", *_OUT), 4)


@R.add("""WITH s AS (SELECT o_orderpriority AS k, count(DISTINCT CAST(o_orderdate AS DATE)) AS n FROM orders GROUP BY 1 UNION ALL
          SELECT concat('year-', o_orderpriority), count(DISTINCT year(o_orderdate)) FROM orders GROUP BY 1)
          SELECT k, n, CASE WHEN n >= 24 THEN 'additive' ELSE 'arima' END AS model FROM s""")
def m24_model_choice(spark, d):
    days = order_panel(spark, d).groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    years = table(spark, d, "orders").groupBy(F.concat(F.lit("year-"), "o_orderpriority").alias("k")).agg(F.count_distinct(F.year("o_orderdate")).alias("n"))
    return days.unionByName(years).withColumn("model", T.choose_model(F.col("n")))


@R.add()
def m25_backtest(spark, d):
    out = T.forecast(order_panel(spark, d), ["k"], 7).where("step = 1")
    return rounded(out.select("k", "model", "mape", "mae", "rmse"), 4)


@R.add("""WITH s AS (SELECT o_orderpriority AS k, CAST(date_trunc('month', o_orderdate) AS DATE) AS day, sum(round(o_totalprice)) AS v FROM orders GROUP BY 1, 2),
          l AS (SELECT k, arg_max(v, day) AS current_value, avg(v) AS f FROM s GROUP BY 1)
          SELECT k, current_value, round((f - current_value) * 100 / current_value, 6) AS growth_rate FROM l""")
def m26_growth_rate(spark, d):
    """Growth from the last month to the mean month, the simplest forecast."""
    ends = monthly_panel(spark, d).groupBy("k").agg(F.max_by("value", "day").alias("current_value"), F.avg("value").alias("f"))
    return rounded(ends.select("k", "current_value", T.growth_rate(F.col("current_value"), F.col("f")).alias("growth_rate")))


@R.add("""WITH s AS (SELECT DISTINCT o_orderpriority AS k, CAST(date_trunc('month', o_orderdate) AS DATE) AS day FROM orders UNION
          SELECT DISTINCT concat('day-', event_type), CAST(ts AS DATE) FROM events)""" + RHYTHM + " SELECT k, frequency FROM f")
def m27_frequency(spark, d):
    months = T.forecast(monthly_panel(spark, d), ["k"], 1).select("k", "frequency")
    events = table(spark, d, "events")
    days = events.groupBy(F.concat(F.lit("day-"), "event_type").alias("k"), F.col("ts").cast("date").alias("day")).agg(F.sum("value").alias("value"))
    return months.unionByName(T.forecast(days, ["k"], 1).select("k", "frequency"))


@R.add("""SELECT event_type AS k, CAST(i AS INTEGER) AS step, CAST(CAST(max(ts) AS DATE) + CAST(i AS INTEGER) AS VARCHAR) AS day FROM events, range(1, 8) r(i) GROUP BY 1, i""")
def m28_future_calendar(spark, d):
    events = table(spark, d, "events")
    days = events.groupBy(F.col("event_type").alias("k"), F.col("ts").cast("date").alias("day")).agg(F.sum("value").alias("value"))
    return T.future_calendar(days, ["k"], 7).withColumn("day", F.col("day").cast("string"))


@R.add()
def m29_forecast_all(spark, d):
    """Every numeric column by every date column of three tables, one grouped job."""
    out = T.forecast_all(tables(spark, d, "orders", "lineitem", "events"), 7)
    return rounded(out.select("dataset", "date_column", "metric", *_OUT), 4)


@R.add(_PANEL + """ SELECT k, rows - 1 AS n, round(t, 5) AS t_statistic, round(crit, 6) AS critical_5pct, t < crit AS is_stationary FROM a""")
def m30_stationarity(spark, d):
    out = V.stationarity(monthly_panel(spark, d), ["k"], "day")
    return rounded(out.select("k", F.col("n").cast("long").alias("n"), "t_statistic", "critical_5pct", "is_stationary"), 6, t_statistic=5)


QUERIES, ORACLES = R.queries, R.oracles
