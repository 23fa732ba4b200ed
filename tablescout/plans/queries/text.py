from __future__ import annotations

from pyspark.sql import functions as F

from tablescout.operators import anomaly as A
from tablescout.operators import catalog as C
from tablescout.operators import causal as U
from tablescout.operators import drivers as D
from tablescout.operators import forecast as T
from tablescout.operators import insight as I
from tablescout.operators import kpi as K
from tablescout.operators import profile as P
from tablescout.operators import relate as X
from tablescout.operators import semantics as S
from tablescout.operators import windows as W
from tablescout.plans.queries.base import Registry, rounded, table, tables, union_all
from tablescout.plans.queries.kpis import business
from tablescout.plans.queries.relations import joined_star
from tablescout.session import durable, scratch_path

R = Registry()

_LINES = """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents)"""


@R.add(_LINES + """ SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, regexp_replace(CASE WHEN contains(line, 'FINDING:') THEN replace(line, 'FINDING:', '') ELSE line END, '^\\s+|\\s+$', '', 'g') AS finding FROM l
       WHERE contains(line, 'FINDING:') OR (regexp_matches(line, '[$%]') AND regexp_matches(line, '[0-9]'))""")
def i1_extract_findings(spark, d):
    return I.extract_findings(table(spark, d, "documents"), "doc_id", "text")


@R.add("""WITH b AS (SELECT l_orderkey, l_partkey, l_linenumber, 'Breakdown by part' AS title, concat('Part ', l_partkey) AS part,
            CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS DOUBLE) AS price, round(l_discount * 100) AS discount FROM lineitem)
          SELECT l_orderkey, CAST(2 AS INTEGER) AS line_no, title, part AS label, price AS value FROM b UNION ALL
          SELECT l_orderkey, 3, title, 'Discount', discount FROM b""")
def i2_extract_listings(spark, d):
    """A short listing written from each order line, and read back."""
    price = F.col("l_extendedprice").cast("decimal(18,2)").cast("string")
    text = F.concat_ws("\n", F.lit("order line"), F.lit("Breakdown by part"), F.concat(F.lit("Part "), F.col("l_partkey").cast("string"), F.lit(": $"), price),
                       F.concat(F.lit("Discount | "), F.round(F.col("l_discount") * 100).cast("int").cast("string"), F.lit("%")), F.lit("no figures here"))
    lines = table(spark, d, "lineitem").select("l_orderkey", F.monotonically_increasing_id().alias("row"), text.alias("text"))
    listed = I.extract_listings(lines.select(F.struct("l_orderkey", "row").alias("key"), "text"), "key", "text")
    return listed.select("key.l_orderkey", "line_no", "title", "label", "value")


@R.add(r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents),
          m AS (SELECT doc_id, line_no, line, regexp_matches(line, '(?i)(Top \d+|by \w+|average|total|breakdown)') AS h FROM l
                WHERE regexp_matches(line, '(?i)(Top \d+|by \w+|average|total|breakdown)') OR regexp_matches(line, '[$%]')),
          t AS (SELECT *, last_value(CASE WHEN h THEN regexp_replace(line, '^\s+|\s+$', '', 'g') END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS title,
                regexp_split_to_array(line, '[:|-]') AS parts FROM m)
          SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, title, regexp_replace(parts[1], '^\s+|\s+$', '', 'g') AS label,
          try_cast(nullif(regexp_extract(replace(parts[-1], ',', ''), '[0-9]+\.?[0-9]*'), '') AS DOUBLE) AS value FROM t
          WHERE NOT h AND title IS NOT NULL AND len(parts) >= 2 AND regexp_matches(replace(parts[-1], ',', ''), '[0-9]')""")
def i2_listings_in_documents(spark, d):
    return I.extract_listings(table(spark, d, "documents"), "doc_id", "text")


_CHANGES = """WITH y AS (SELECT c_mktsegment AS segment, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, sum(round(o_totalprice)) AS total
                FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
          c AS (SELECT concat(segment, ' ', strftime(month, '%Y-%m')) AS title, total, lag(total) OVER (PARTITION BY segment ORDER BY month) AS before FROM y),
          i AS (SELECT title, CASE WHEN before IS NULL THEN '' WHEN total < before * 0.8 THEN 'Decline of revenue against the month before'
                WHEN total > before * 1.2 THEN 'Growth of a high value segment' ELSE 'Steady' END AS narrative,
                CASE WHEN total > 6000000 THEN 'High' ELSE 'Medium' END AS priority FROM c)"""


def monthly_insights(spark, d):
    """One sentence per market segment and month, written from the change of its order total."""
    orders = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    months = orders.groupBy(F.col("c_mktsegment").alias("segment"), F.trunc("o_orderdate", "month").alias("month")).agg(F.sum(F.round("o_totalprice")).alias("total"))
    change = W.lagged(months, "total", ["segment"], ["month"], 1, "before")
    total, before = F.col("total"), F.col("before")
    return change.select(
        F.concat_ws(" ", "segment", F.date_format("month", "yyyy-MM")).alias("title"),
        F.when(before.isNull(), "").when(total < before * 0.8, "Decline of revenue against the month before")
        .when(total > before * 1.2, "Growth of a high value segment").otherwise("Steady").alias("narrative"),
        F.when(total > 6000000, "High").otherwise("Medium").alias("priority"))


def _rule(words, action: str, impact: str | None, urgency: str, number: int) -> str:
    test = " OR ".join("(" + " AND ".join(f"contains(t, '{w}')" for w in group) + ")" for group in words)
    return f"""SELECT title, {number} AS rule, concat('{action}: ', title) AS action, narrative AS rationale, {f"'{impact}'" if impact else 'priority'} AS impact,
               '{urgency}' AS urgency FROM (SELECT *, lower(narrative) AS t FROM i) WHERE {test}"""


@R.add(_CHANGES + " " + union_all(_rule(w, a, i, u, n) for n, (w, a, i, u, _) in enumerate(I.RECOMMENDATIONS, 1)))
def i3_recommendations(spark, d):
    return I.recommend(monthly_insights(spark, d), "title", "title", "narrative", priority="priority")


_TOPIC = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower(text), '{w}')" for w in words) + f" THEN '{name}'" for name, words in I.TOPICS) + f" ELSE '{I.OTHER_TOPIC}' END"


@R.add(f"SELECT role, {_TOPIC} AS topic, count(*) AS n FROM conversations GROUP BY 1, 2")
def i4_topics(spark, d):
    return table(spark, d, "conversations").groupBy("role", I.topic("text").alias("topic")).agg(F.count(F.lit(1)).alias("n"))


_EXPLORED = {"customer": ["c_custkey", "c_nationkey", "c_acctbal"], "part": ["p_partkey", "p_size", "p_retailprice"]}


@R.add(union_all(f"""SELECT '{t}' AS dataset, '{c}' AS "column", round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, round(min({c})::DOUBLE, 4) AS min, round(max({c})::DOUBLE, 4) AS max,
    round(quantile_cont({c}::DOUBLE, 0.5), 4) AS q50, count(DISTINCT {c}) AS "distinct" FROM {t}""" for t, cs in _EXPLORED.items() for c in cs))
def i5_exploration_pass(spark, d):
    frames = [P.numeric_summary(df).select(F.lit(n).alias("dataset"), "column", "mean", "std", "min", "max", "q50", "distinct")
              for n, df in tables(spark, d, *_EXPLORED).items()]
    return rounded(frames[0].unionByName(frames[1]), 4)


_Q = """WITH g AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM events)"""


@R.add(_Q + """ SELECT 'anomaly' AS chart, 'Values' AS series, CAST(event_id AS VARCHAR) AS x, value AS y FROM events UNION ALL
       SELECT 'anomaly', 'Anomalies', CAST(event_id AS VARCHAR), value FROM events, g WHERE value < a - 1.5 * (b - a) OR value > b + 1.5 * (b - a)""")
def i7_anomaly_chart(spark, d):
    events = table(spark, d, "events").select("event_id", "value")
    return I.anomaly_chart(events, A.iqr_anomalies(events, "value", ids=["event_id"]), "event_id", "value")


@R.add()
def i7_forecast_chart(spark, d):
    events = table(spark, d, "events")
    days = events.groupBy(F.lit("events").alias("k"), F.col("ts").cast("date").alias("day")).agg(F.sum("value").alias("value"))
    return rounded(I.forecast_chart(days, T.forecast(days, ["k"], 7)), 4)


@R.add("""SELECT 'impact' AS chart, 'Average Value' AS series, 'Before' AS x, round(avg(value) FILTER (ts < TIMESTAMP '2024-01-16'), 6) AS y FROM events UNION ALL
          SELECT 'impact', 'Average Value', 'After', round(avg(value) FILTER (ts >= TIMESTAMP '2024-01-16'), 6) FROM events""")
def i7_impact_chart(spark, d):
    from tablescout.operators.impact import time_split_impact

    return rounded(I.impact_chart(time_split_impact(table(spark, d, "events"), "ts", "value", "2024-01-16")))


@R.add("""WITH v AS (SELECT l_extendedprice * (1 - l_discount) AS y, l_quantity AS x1, l_extendedprice AS x2, l_discount AS x3 FROM lineitem),
          c AS (SELECT corr(x1, x2) AS a, corr(x1, x3) AS b, corr(x2, x3) AS c, corr(y, x1) AS p, corr(y, x2) AS q, corr(y, x3) AS r FROM v),
          k AS (SELECT p * (1 - c * c) + q * (b * c - a) + r * (a * c - b) AS k1, p * (b * c - a) + q * (1 - b * b) + r * (a * b - c) AS k2,
                p * (a * c - b) + q * (a * b - c) + r * (1 - a * a) AS k3 FROM c),
          s AS (SELECT *, k1 * k1 + k2 * k2 + k3 * k3 AS t FROM k),
          o AS (SELECT 'l_quantity' AS x, k1 * k1 / t * 100 AS y FROM s UNION ALL SELECT 'l_extendedprice', k2 * k2 / t * 100 FROM s
                UNION ALL SELECT 'l_discount', k3 * k3 / t * 100 FROM s)
          SELECT 'drivers' AS chart, 'Contribution to Variance' AS series, x, round(y, 6) AS y FROM o""")
def i7_driver_chart(spark, d):
    df = table(spark, d, "lineitem").select("l_quantity", "l_extendedprice", "l_discount", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"))
    return rounded(I.driver_chart(D.linear_drivers(df, ["l_quantity", "l_extendedprice", "l_discount"], "revenue")))


def _analyses(spark, d):
    """Results of the four analyses over two tables, materialised once."""
    two = {n: df for n, df in tables(spark, d, "orders", "events").items()}
    money = {"orders": ["o_totalprice"], "events": ["value"]}
    small = {n: df.select(*money[n], *[c for c in df.columns if c in ("o_orderdate", "ts", "o_orderstatus", "event_type")]) for n, df in two.items()}
    orders = two["orders"].select("o_orderdate", "o_totalprice", F.col("o_custkey").cast("double").alias("customers"))
    causes = U.all_causes(orders, "o_orderdate", ["customers", "o_totalprice"], "orders", 3, significant_only=False)
    factors = [D.categorical_drivers(small[n], money[n], [c]).select(F.lit(n).alias("dataset"), "*")
               for n, c in (("orders", "o_orderstatus"), ("events", "event_type"))]
    return (A.anomaly_scan(small), T.forecast_all(small, 7, money), causes, factors[0].unionByName(factors[1]))


@R.add()
def i8_roll_up(spark, d):
    anomalies, forecasts, causes, factors = _analyses(spark, d)
    out = I.roll_up(
        anomaly=anomalies.select("dataset", F.col("column").alias("metric"), F.col("num_anomalies").cast("double").alias("figure"), F.col("method").alias("detail")),
        forecast=forecasts.select("dataset", "metric", F.col("prediction").alias("figure"), F.col("model").alias("detail")),
        causal=causes.select("dataset", F.col("effect").alias("metric"), F.col("p_value").alias("figure"), F.col("cause").alias("detail")),
        driver=factors.select("dataset", "metric", F.col("variance_explained").alias("figure"), F.col("factor").alias("detail")))
    return rounded(out, 4)


@R.add()
def a28_analytics_summary(spark, d):
    return I.analytics_summary(*_analyses(spark, d))


@R.add("""SELECT 'columns' AS stored, count(*) * 0 + 11 AS n FROM customer UNION ALL SELECT 'relationships', 1 FROM (SELECT count(*) FROM orders) UNION ALL
          SELECT 'kpis', 4 FROM (SELECT count(*) FROM part) UNION ALL SELECT 'datasets', 2 FROM (SELECT count(*) FROM orders)""")
def c1_metadata_tables(spark, d):
    """Catalog rows of two tables, their edge and the figures of the order lines, stored and read back."""
    root = scratch_path(spark, "catalog")
    two = tables(spark, d, "customer", "orders")
    columns = durable(S.column_catalog(two))
    C.save(columns, root, "columns")
    C.save(S.dataset_sizes(two).withColumnRenamed("row_count", "row_count"), root, "datasets")
    C.save(X.detect_relationships(two, columns.where("semantic_type = 'key'")), root, "relationships")
    df = business(spark, d)
    C.save(K.kpi_report(df, K.applicable_kpis(df.columns, "Finance")).withColumn("dataset", F.lit("business")), root, "kpis")
    out = None
    for name in ("columns", "relationships", "kpis", "datasets"):
        frame = C.read(spark, root, name).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("stored"), "n")
        out = frame if out is None else out.unionByName(frame)
    return out


_ADHOC = """SELECT c.c_mktsegment AS segment, count(DISTINCT o.o_custkey) AS buyers, count(*) AS n_orders, round(avg(o.o_totalprice), 4) AS mean_order
            FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey GROUP BY c.c_mktsegment"""


@R.add(_ADHOC.format(orders="orders", customer="customer"))
def c5_adhoc_query(spark, d):
    return C.query(spark, tables(spark, d, "orders", "customer"), _ADHOC)


_STAR = """lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey"""


def sales(spark, d):
    joined = joined_star(spark, d)
    return joined.select(
        F.col("customer_c_name").alias("customer"), F.col("part_p_brand").alias("brand"), F.col("orders_o_orderdate").cast("date").alias("order_date"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"), (F.col("part_p_retailprice") * F.col("l_quantity")).alias("cost"),
        (F.col("l_extendedprice") * F.col("l_discount")).alias("spend"))


_SALES = f"""WITH s AS (SELECT c_name AS customer, p_brand AS brand, CAST(o_orderdate AS DATE) AS order_date, l_extendedprice * (1 - l_discount) AS revenue,
             p_retailprice * l_quantity AS cost, l_extendedprice * l_discount AS spend FROM {_STAR})"""


@R.add(_SALES + " SELECT customer, round(sum(revenue), 4) AS revenue, count(*) AS lines FROM s GROUP BY 1 ORDER BY sum(revenue) DESC, 1 LIMIT 10")
def c6_top_customers(spark, d):
    """The customers with the highest revenue, over the joined star."""
    return rounded(C.query(spark, {"joined": sales(spark, d)}, C.top_customers_sql("customer", "revenue")), 4)


@R.add(_SALES + " SELECT brand AS product, round(sum(revenue), 4) AS revenue, round((sum(revenue) - sum(cost)) / sum(revenue) * 100, 5) AS margin_pct FROM s GROUP BY 1 ORDER BY 3 DESC, 1 LIMIT 10")
def c6_best_margins(spark, d):
    return rounded(C.query(spark, {"joined": sales(spark, d)}, C.best_margins_sql("brand", "revenue", "cost")), 5, revenue=4)


@R.add(_SALES + """ SELECT customer, CAST(max(order_date) AS VARCHAR) AS last_date, count(*) AS lines, date_diff('day', max(order_date), (SELECT max(order_date) FROM s)) AS idle_days
       FROM s GROUP BY 1 HAVING idle_days > 180""")
def c6_churn_risk(spark, d):
    out = C.query(spark, {"joined": sales(spark, d)}, C.churn_risk_sql("customer", "order_date"))
    return out.withColumns({"last_date": F.col("last_date").cast("string"), "idle_days": F.col("idle_days").cast("long")})


@R.add(_SALES + " SELECT strftime(order_date, '%Y-%m') AS month, round(sum(revenue), 4) AS revenue, round(sum(spend), 4) AS spend, round(sum(revenue) / sum(spend), 6) AS roi FROM s GROUP BY 1")
def c6_monthly_return(spark, d):
    return rounded(C.query(spark, {"joined": sales(spark, d)}, C.monthly_return_sql("order_date", "revenue", "spend")), 6, revenue=4, spend=4)


QUERIES, ORACLES = R.queries, R.oracles
