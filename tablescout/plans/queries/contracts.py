"""What results of random or iterative models must satisfy, as queries with SQL.

The models themselves have no SQL counterpart (their own entries return what they give, and the tests compare them with
brute force); these entries hold the parts of their results that follow from the tables.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tablescout import sources as S
from tablescout.operators import anomaly as A
from tablescout.operators import drivers as D
from tablescout.operators import forecast as T
from tablescout.operators import insight as I
from tablescout.plans.queries.base import Registry, rounded, table
from tablescout.plans.queries.forecasting import RHYTHM
from tablescout.plans.queries.text import _analyses

R = Registry()


def event_days(spark, d):
    events = table(spark, d, "events")
    return events.groupBy(F.col("event_type").alias("k"), F.col("ts").cast("date").alias("day")).agg(F.sum("value").alias("value"))


_AHEAD = """SELECT event_type AS k, CAST(i AS INTEGER) AS step, CAST(CAST(max(ts) AS DATE) + CAST(i AS INTEGER) AS VARCHAR) AS day, true AS within
            FROM events, range(1, 8) r(i) GROUP BY 1, i"""


def _ahead(spark, d, model):
    within = (F.col("lower") <= F.col("prediction")) & (F.col("prediction") <= F.col("upper"))
    return T.forecast(event_days(spark, d), ["k"], 7, model).select("k", "step", F.col("day").cast("string").alias("day"), within.alias("within"))


@R.add(_AHEAD)
def m22_additive_contract(spark, d):
    """Every series has its next seven days, and predictions lie inside their intervals."""
    return _ahead(spark, d, "additive")


@R.add(_AHEAD)
def m23_arima_contract(spark, d):
    return _ahead(spark, d, "arima")


@R.add("SELECT event_type AS k, true AS ordered FROM events GROUP BY 1")
def m25_backtest_contract(spark, d):
    """The mean absolute error never exceeds the root of the mean square."""
    out = T.forecast(event_days(spark, d), ["k"], 7).where("step = 1")
    return out.select("k", ((F.col("mae") <= F.col("rmse") + 1e-9) & (F.col("mae") >= 0)).alias("ordered"))


@R.add("""SELECT 'Historical' AS part, CAST(CAST(ts AS DATE) AS VARCHAR) AS x, round(sum(value), 4) AS y FROM events GROUP BY 2""")
def i7_forecast_chart_history(spark, d):
    days = table(spark, d, "events").groupBy(F.lit("events").alias("k"), F.col("ts").cast("date").alias("day")).agg(F.sum("value").alias("value"))
    chart = I.forecast_chart(days, T.forecast(days, ["k"], 7))
    return rounded(chart.where("series = 'Historical'").select(F.col("series").alias("part"), "x", "y"), 4)


@R.add("""SELECT 'l_extendedprice' AS strongest, 1.0 AS total, 4::BIGINT AS features FROM lineitem HAVING corr(l_extendedprice, l_extendedprice * (1 - l_discount)) >
            greatest(abs(corr(l_quantity, l_extendedprice * (1 - l_discount))), abs(corr(l_discount, l_extendedprice * (1 - l_discount))),
                     abs(corr(l_tax, l_extendedprice * (1 - l_discount))))""")
def m38_forest_contract(spark, d):
    """Shares sum to one, and the feature that goes with the target most is the strongest."""
    df = table(spark, d, "lineitem").select("l_quantity", "l_extendedprice", "l_discount", "l_tax",
                                            (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"))
    out = D.forest_drivers(df, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], "revenue")
    return rounded(out.agg(F.max_by("feature", "contribution").alias("strongest"), F.sum("contribution").alias("total"), F.count(F.lit(1)).alias("features")))


@R.add("""SELECT count(*) AS customers, 4::BIGINT AS segments, round(avg(orders), 6) AS orders FROM (SELECT o_custkey, count(*) AS orders FROM orders GROUP BY 1)""")
def m42_segmentation_contract(spark, d):
    """Every customer is in one of four segments, and the segments' means weigh up to the whole."""
    orders = table(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).cast("double").alias("orders"), F.sum("o_totalprice").alias("revenue"))
    out = D.segment_profile(D.segment(orders, ["orders", "revenue"]), ["orders", "revenue"])
    return rounded(out.agg(F.sum("n").alias("customers"), F.count(F.lit(1)).alias("segments"),
                           (F.sum(F.col("n") * F.col("mean_orders")) / F.sum("n")).alias("orders")))


@R.add("SELECT count(*) AS events, true AS share_fits, true AS extremes_found FROM events")
def m3_isolation_contract(spark, d):
    """At most a tenth of the values is flagged, with the largest one among them."""
    events = table(spark, d, "events")
    found = A.isolation_anomalies(events, "value", ["event_id"]).agg(F.count(F.lit(1)).alias("flagged"), F.max("value").alias("top"))
    whole = events.agg(F.count("value").alias("events"), F.max("value").alias("largest"))
    return whole.join(found).select("events", ((F.col("flagged") > 0) & (F.col("flagged") <= 0.1 * F.col("events") + 1)).alias("share_fits"),
                                    (F.col("top") == F.col("largest")).alias("extremes_found"))


@R.add("""SELECT least(count(*), 10000) * 0.9 < 10000 AS near_cap, true AS subset FROM lineitem""")
def s12_sample_contract(spark, d):
    """A sample has about as many rows as asked for, all from the table."""
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    sample = S.sample_rows(rows, cap=10_000)
    whole, size = rows.count(), sample.count()
    fits = 0.9 * min(whole, 10_000) <= size <= 1.1 * min(whole, 10_000)
    stray = sample.exceptAll(rows).limit(1).agg(F.count(F.lit(1)).alias("n"))
    return stray.select(F.lit(fits).alias("near_cap"), (F.col("n") == 0).alias("subset"))


_SERIES = [("orders", "o_orderdate", "o_orderkey"), ("orders", "o_orderdate", "o_custkey"), ("orders", "o_orderdate", "o_totalprice"),
           ("events", "ts", "event_id"), ("events", "ts", "user_id"), ("events", "ts", "value")]


@R.add("WITH s AS (" + " UNION ".join(f"SELECT DISTINCT '{t}.{d}.{m}' AS k, CAST({d} AS DATE) AS day FROM {t} WHERE {m} IS NOT NULL" for t, d, m in _SERIES) + ")" + RHYTHM
       + """, e AS (SELECT k, max(day) AS last, count(*) AS n FROM s GROUP BY k)
       SELECT split_part(k, '.', 1) AS dataset, split_part(k, '.', 2) AS date_column, split_part(k, '.', 3) AS metric, CAST(i AS INTEGER) AS step,
       CAST(CAST(CASE frequency WHEN 'D' THEN last + to_days(CAST(i AS INTEGER)) WHEN 'W' THEN last + to_days(CAST(7 * i AS INTEGER)) WHEN 'M' THEN last + to_months(CAST(i AS INTEGER))
            WHEN 'Q' THEN last + to_months(CAST(3 * i AS INTEGER)) ELSE last + to_years(CAST(i AS INTEGER)) END AS DATE) AS VARCHAR) AS day,
       CASE WHEN n >= 24 THEN 'additive' ELSE 'arima' END AS model FROM e JOIN f USING (k), range(1, 8) r(i) WHERE n > 10""")
def m29_forecast_contract(spark, d):
    """Every metric by every date column has its next seven dates, in the rhythm of the series, and the model its length asks for."""
    out = T.forecast_all({t: table(spark, d, t) for t in ("orders", "events")}, 7)
    return out.select("dataset", "date_column", "metric", "step", F.col("day").cast("string").alias("day"), "model")


def _spread(t: str, c: str) -> str:
    g1 = f"(skewness({c}) * (count({c}) - 2) / sqrt(count({c}) * (count({c}) - 1.0)))"
    jb = f"(count({c}) / 6.0 * (power({g1}, 2) + power(kurtosis_pop({c}), 2) / 4))"
    return f"""(SELECT CASE WHEN n >= 5000 OR (n >= 20 AND p > 0.05) THEN count(*) FILTER (abs(x - m) / sd > 3) ELSE
        count(*) FILTER (x < a - 1.5 * (b - a) OR x > b + 1.5 * (b - a)) END FROM (SELECT {c} AS x FROM {t}), (SELECT count({c}) AS n, exp(-{jb} / 2) AS p, avg({c}) AS m,
        stddev_samp({c}) AS sd, quantile_cont({c}, 0.25) AS a, quantile_cont({c}, 0.75) AS b FROM {t}) GROUP BY n, p)"""


def _between(t: str, c: str, by: str) -> str:
    """The share of the variance of a column that lies between the levels of another."""
    return f"""(SELECT sum(n * power(m - (SELECT avg({c}) FROM {t} WHERE {by} IS NOT NULL), 2)) / (sum(n * power(m - (SELECT avg({c}) FROM {t} WHERE {by} IS NOT NULL), 2)) + sum(n * v))
        FROM (SELECT count({c}) AS n, avg({c}) AS m, var_pop({c}) AS v FROM {t} WHERE {by} IS NOT NULL GROUP BY {by}))"""


@R.add(f"""SELECT 'anomalies' AS analysis, CAST({_spread("orders", "o_totalprice")} > 0 AS BIGINT) + CAST({_spread("events", "value")} > 0 AS BIGINT) AS n UNION ALL
           SELECT 'forecasts', 7 * ((SELECT count(*) FROM (SELECT 1 FROM orders HAVING count(DISTINCT CAST(o_orderdate AS DATE)) > 10 AND count(o_totalprice) > 20))
                                  + (SELECT count(*) FROM (SELECT 1 FROM events HAVING count(DISTINCT CAST(ts AS DATE)) > 10 AND count(value) > 20))) UNION ALL
           SELECT 'drivers', CAST({_between("orders", "o_totalprice", "o_orderstatus")} > 0.2 AS BIGINT) + CAST({_between("events", "value", "event_type")} > 0.2 AS BIGINT)""")
def a28_summary_contract(spark, d):
    """What the summary counts, but for the causes, whose p-values have no SQL counterpart."""
    return I.analytics_summary(*_analyses(spark, d)).where("analysis <> 'relationships'")


@R.add(f"""SELECT 'anomaly' AS analysis, 'orders' AS dataset, 'o_totalprice' AS metric, CAST({_spread("orders", "o_totalprice")} AS DOUBLE) AS figure UNION ALL
           SELECT 'anomaly', 'events', 'value', {_spread("events", "value")} UNION ALL
           SELECT 'driver', 'orders', 'o_totalprice', round({_between("orders", "o_totalprice", "o_orderstatus")}, 6) UNION ALL
           SELECT 'driver', 'events', 'value', round({_between("events", "value", "event_type")}, 6)""")
def i8_roll_up_contract(spark, d):
    anomalies, _, _, factors = _analyses(spark, d)
    out = I.roll_up(anomaly=anomalies.select("dataset", F.col("column").alias("metric"), F.col("num_anomalies").cast("double").alias("figure")),
                    driver=factors.select("dataset", "metric", F.col("variance_explained").alias("figure")))
    return rounded(out)


QUERIES, ORACLES = R.queries, R.oracles
