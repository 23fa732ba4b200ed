from __future__ import annotations

from pyspark.sql import functions as F

from tablescout.functions import parse_date, parse_measure
from tablescout.operators import clean as C
from tablescout.operators import windows as W
from tablescout.operators.insight import column_text, insight_text
from tablescout.plans.queries.base import DIRTY, Registry, dirty_orders, rounded, table

R = Registry()

_DATE = "CAST(coalesce(try_strptime(trim(date_text), '%Y-%m-%d'), try_strptime(trim(date_text), '%m/%d/%Y')) AS DATE)"
_PRICE = "try_cast(trim(translate(price_text, '$,%', '')) AS DOUBLE)"

MEANINGS = {
    "o_orderkey": C.ColumnMeaning("key", is_primary_key=True, business_meaning="order key"),
    "o_custkey": C.ColumnMeaning("key", is_foreign_key=True, business_meaning="customer key"),
    "price_text": C.ColumnMeaning("measure", business_meaning="price of the order"),
    "date_text": C.ColumnMeaning("date", business_meaning="date of the order"),
    "priority": C.ColumnMeaning("dimension", business_meaning="priority"),
    "sparse": C.ColumnMeaning("dimension", business_meaning="status"),
    "amount": C.ColumnMeaning("measure", business_meaning="revenue of the order"),
}
EDGES = [{"from_dataset": "dirty", "from_column": "o_custkey", "to_dataset": "customer", "to_column": "c_custkey"}]


@R.add(f"{DIRTY} SELECT o_orderkey, CAST({_DATE} AS VARCHAR) AS order_date FROM dirty")
def p1_date_coercion(spark, d):
    return dirty_orders(spark, d).select("o_orderkey", parse_date("date_text").cast("date").cast("string").alias("order_date"))


@R.add(f"{DIRTY} SELECT o_orderkey, {_PRICE} AS price FROM dirty")
def p2_measure_coercion(spark, d):
    return dirty_orders(spark, d).select("o_orderkey", parse_measure("price_text").alias("price"))


@R.add(f"{DIRTY} SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey FROM dirty")
def p3_key_to_string(spark, d):
    out, _ = C.convert_types(dirty_orders(spark, d).select("o_orderkey", "o_custkey"), MEANINGS)
    return out


@R.add(f"{DIRTY} SELECT o_orderkey, o_custkey, amount FROM dirty WHERE o_custkey IS NOT NULL")
def p4_drop_missing_keys(spark, d):
    df = dirty_orders(spark, d).select("o_orderkey", "o_custkey", "amount")
    return C.drop_missing_keys(df, C.key_columns(EDGES, "dirty"))


@R.add(f"{DIRTY} SELECT o_orderkey, priority, amount FROM dirty")
def p5_drop_sparse_columns(spark, d):
    df = dirty_orders(spark, d).select("o_orderkey", "priority", "sparse", "amount")
    return C.drop_sparse(df, ["o_custkey"], C.null_rates(df))[0]


@R.add(f"{DIRTY} SELECT o_orderkey, coalesce(amount, 0) AS amount FROM dirty")
def p6_fill_measures(spark, d):
    return C.fill_missing(dirty_orders(spark, d).select("o_orderkey", "amount"), MEANINGS, [])


@R.add(f"{DIRTY} SELECT o_orderkey, coalesce(priority, 'Unknown') AS priority FROM dirty")
def p7_fill_dimensions(spark, d):
    return C.fill_missing(dirty_orders(spark, d).select("o_orderkey", "priority"), MEANINGS, [])


@R.add(f"""{DIRTY} SELECT coalesce(o_custkey, -1) AS o_custkey, o_orderkey, CAST(last_value({_DATE} IGNORE NULLS) OVER (PARTITION BY o_custkey ORDER BY o_orderkey
           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS VARCHAR) AS order_date FROM dirty""")
def p8_forward_fill_dates(spark, d):
    df = dirty_orders(spark, d).select("o_custkey", "o_orderkey", parse_date("date_text").cast("date").alias("order_date"))
    out = W.forward_fill(df, ["order_date"], ["o_custkey"], ["o_orderkey"])
    return out.select(F.coalesce("o_custkey", F.lit(-1)).alias("o_custkey"), "o_orderkey", F.col("order_date").cast("string").alias("order_date"))


@R.add("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice FROM (SELECT *, row_number() OVER (
          PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS rn
          FROM lineitem) WHERE rn = 1""")
def p9_dedup_keep_first(spark, d):
    df = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity",
                                            "l_extendedprice", "l_shipdate")
    return C.remove_duplicates(df, ["l_orderkey", "l_linenumber"], ["l_shipdate"]).drop("l_shipdate")


@R.add("""WITH a AS (SELECT trim(CAST(o_custkey AS VARCHAR)) AS k, count(*) AS n FROM orders GROUP BY 1),
          b AS (SELECT trim(concat(' ', CAST(c_custkey AS VARCHAR), ' ')) AS k FROM customer)
          SELECT k AS customer, n AS n_orders FROM a JOIN b USING (k)""")
def p10_standardise_keys(spark, d):
    orders = C.standardise_keys(table(spark, d, "orders").select("o_custkey"), ["o_custkey"])
    padded = table(spark, d, "customer").select(F.concat(F.lit(" "), F.col("c_custkey").cast("string"), F.lit(" ")).alias("c_custkey"))
    customers = C.standardise_keys(padded, ["c_custkey"])
    counts = orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n_orders"))
    return counts.join(customers, F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_custkey").alias("customer"), "n_orders")


@R.add("""WITH q AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM events)
          SELECT event_id, value, value < a - 3 * (b - a) OR value > b + 3 * (b - a) AS value_is_outlier FROM events, q""")
def p11_flag_outliers(spark, d):
    return C.flag_outliers(table(spark, d, "events").select("event_id", "value"), ["value"])[0]


@R.add(rf"{DIRTY} SELECT o_orderkey, regexp_replace(chr(9) || priority || ' ' || chr(13) || chr(10), '^\s+|\s+$', '', 'g') AS priority FROM dirty")
def p12_trim_text(spark, d):
    padded = F.concat(F.lit("\t"), F.col("priority"), F.lit(" \r\n")).alias("priority")
    return C.trim_text(dirty_orders(spark, d).select("o_orderkey", padded))


@R.add(f"{DIRTY} SELECT o_orderkey, upper(trim(priority)) AS priority FROM dirty")
def p13_majority_case(spark, d):
    df = C.trim_text(dirty_orders(spark, d).select("o_orderkey", "priority"))
    return C.standardise_case(df, ["priority"])[0]


@R.add(f"""{DIRTY}, s AS (SELECT count(*) FILTER (o_orderkey IS NULL) AS a, count(*) FILTER (o_custkey IS NULL) AS b,
           count(*) FILTER (amount - 300000 < 0) AS c FROM dirty)
           SELECT 'issue' AS severity, 'o_orderkey' AS "column", 'missing key' AS problem, a AS n, 'has_issues' AS flag FROM s UNION ALL
           SELECT 'issue', 'o_custkey', 'missing key', b, 'has_issues' FROM s UNION ALL
           SELECT 'warning', 'amount', 'negative value', c, 'has_issues' FROM s""")
def p14_quality_checks(spark, d):
    df = dirty_orders(spark, d).select("o_orderkey", "o_custkey", (F.col("amount") - 300000).alias("amount"))
    checks = C.quality_checks(df, MEANINGS)
    return checks.withColumn("flag", C.quality_flag([r.asDict() for r in checks.collect()]))


@R.add(f"""{DIRTY}, s AS (SELECT count(*) AS n, count(o_custkey) AS k FROM dirty)
           SELECT 'type_conversion' AS step, 'columns_converted' AS measure, 4 AS n FROM s UNION ALL
           SELECT 'missing_values', 'rows_removed', n - k FROM s UNION ALL
           SELECT 'missing_values', 'columns_dropped', 1 FROM s UNION ALL
           SELECT 'missing_values', 'columns_filled', 4 FROM s UNION ALL
           SELECT 'remove_duplicates', 'rows_removed', 0 FROM s UNION ALL
           SELECT 'standardise_keys', 'columns_standardised', 1 FROM s UNION ALL
           SELECT 'handle_outliers', 'columns_flagged', 0 FROM s UNION ALL
           SELECT 'standardise_formats', 'columns_standardised', 1 FROM s""")
def p15_cleaning_report(spark, d):
    _, report = C.clean_table(dirty_orders(spark, d), MEANINGS, EDGES, "dirty", order=["o_orderkey"])
    return report.frame(spark).select("step", "measure", "n")


@R.add("""SELECT DISTINCT l_orderkey, l_partkey, l_quantity, round(l_extendedprice / l_quantity, 6) AS unit_price,
          round(l_discount * 100, 6) AS discount_pct FROM lineitem WHERE l_quantity > 45 ORDER BY l_orderkey DESC, l_partkey""")
def p17_filter_derive_sort(spark, d):
    df = table(spark, d, "lineitem").where("l_quantity > 45")
    out = df.select("l_orderkey", "l_partkey", "l_quantity", (F.col("l_extendedprice") / F.col("l_quantity")).alias("unit_price"),
                    (F.col("l_discount") * 100).alias("discount_pct"))
    return rounded(out).dropDuplicates().orderBy(F.desc("l_orderkey"), "l_partkey")


@R.add(f"""{DIRTY} SELECT coalesce(year({_DATE}), 0) AS y, coalesce(quarter({_DATE}), 0) AS q, coalesce(month({_DATE}), 0) AS m, count(*) AS n, count({_PRICE}) AS priced
           FROM dirty GROUP BY 1, 2, 3""")
def p18_date_parts(spark, d):
    date = parse_date("date_text")
    df = dirty_orders(spark, d).select(F.coalesce(F.year(date).cast("long"), F.lit(0)).alias("y"),
                                       F.coalesce(F.quarter(date).cast("long"), F.lit(0)).alias("q"),
                                       F.coalesce(F.month(date).cast("long"), F.lit(0)).alias("m"), parse_measure("price_text").alias("p"))
    return df.groupBy("y", "q", "m").agg(F.count(F.lit(1)).alias("n"), F.count("p").alias("priced"))


@R.add("""SELECT doc_id, concat('Domain: ', source, ' | Insight: ', text) AS insight_text,
          concat('Column: ', lang, ' | Type: ', source, ' | Meaning: ', text) AS column_text FROM documents""")
def p19_embedding_texts(spark, d):
    df = table(spark, d, "documents")
    return df.select("doc_id", insight_text("source", "text").alias("insight_text"), column_text("lang", "source", "text").alias("column_text"))


QUERIES, ORACLES = R.queries, R.oracles
