from __future__ import annotations

from pyspark.sql import functions as F

from tablescout.operators import aggregate as G
from tablescout.operators import profile as P
from tablescout.operators import semantics as S
from tablescout.plans.queries.base import Registry, dirty_orders, DIRTY, rounded, table, tables, union_all

R = Registry()
_LINE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@R.add(union_all([
    f"SELECT '{c}' AS \"column\", '{k}' AS kind FROM (SELECT count(*) FROM documents)" for c, k in [("doc_id", "numeric"), ("n_chars", "numeric")]] + [
    f"SELECT '{c}', CASE WHEN avg(length({c})) > 50 THEN 'text' ELSE 'categorical' END FROM documents" for c in ("text", "lang", "source")]))
def a1_column_kinds(spark, d):
    return P.column_kinds(table(spark, d, "documents")).select("column", "kind")


@R.add(union_all(f"""SELECT '{t}' AS dataset, '{c}' AS "column", round(avg(length({c})), 6) AS avg_length, avg(length({c})) > 50 AS is_text FROM {t}"""
                 for t, c in [("documents", "text"), ("documents", "lang"), ("documents", "source"), ("conversations", "role"), ("conversations", "text"), ("benchmark", "text")]))
def a2_text_columns(spark, d):
    frames = [P.column_kinds(df).where("avg_length is not null").select(
        F.lit(n).alias("dataset"), "column", "avg_length", (F.col("kind") == "text").alias("is_text"))
        for n, df in tables(spark, d, "documents", "conversations", "benchmark").items()]
    out = frames[0].unionByName(frames[1]).unionByName(frames[2])
    return rounded(out)


@R.add(union_all(f"""SELECT '{c}' AS "column", round(avg({c}), 5) AS mean, round(stddev_samp({c}), 5) AS std, min({c}) AS min, max({c}) AS max,
    round(quantile_cont({c}, 0.25), 6) AS q25, round(quantile_cont({c}, 0.5), 6) AS q50, round(quantile_cont({c}, 0.75), 6) AS q75,
    count(DISTINCT {c}) AS "distinct", count(*) - count({c}) AS missing FROM lineitem""" for c in _LINE))
def a3_numeric_summary(spark, d):
    return rounded(P.numeric_summary(table(spark, d, "lineitem"), _LINE), 6, mean=5, std=5)


def _cat(c: str, t: str = "lineitem") -> str:
    top = f"(SELECT {c} AS v, count(*) AS n FROM {t} WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY n DESC, v LIMIT 5)"
    return f"""SELECT '{c}' AS "column", (SELECT count(*) - count({c}) FROM {t}) AS missing, (SELECT count(DISTINCT {c}) FROM {t}) AS "distinct",
        (SELECT v FROM {top} ORDER BY n DESC, v LIMIT 1) AS most_common, (SELECT max(n) FROM {top}) AS most_common_freq,
        (SELECT string_agg(concat(v, '=', n), ', ' ORDER BY n DESC, v) FROM {top}) AS top"""


@R.add(union_all(_cat(c) for c in ("l_returnflag", "l_linestatus")))
def a4_categorical_summary(spark, d):
    return P.categorical_summary(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"])


@R.add("SELECT o_orderpriority, count(*) AS freq FROM orders GROUP BY 1")
def a5_frequency(spark, d):
    return P.frequency(table(spark, d, "orders"), "o_orderpriority")


_ORDERS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]


@R.add(union_all(f"""SELECT '{c}' AS "column", count(*) AS n_rows, count(DISTINCT {c}) AS "distinct",
    round(count(DISTINCT {c}) / count(*), 6) AS distinct_ratio FROM orders""" for c in _ORDERS))
def a6_distinct_counts(spark, d):
    return rounded(P.distinct_counts(table(spark, d, "orders")).withColumnRenamed("rows", "n_rows"))


_DIRTY = ["o_orderkey", "o_custkey", "price_text", "date_text", "priority", "sparse", "amount"]


@R.add(DIRTY + " " + union_all(f"""SELECT '{c}' AS "column", count(*) - count({c}) AS nulls,
    round((count(*) - count({c})) * 100.0 / count(*), 6) AS null_pct, count({c}) = 0 AS all_null FROM dirty""" for c in _DIRTY))
def a7_null_profile(spark, d):
    return rounded(P.null_counts(dirty_orders(spark, d)).drop("rows"))


@R.add(DIRTY + ", n AS (SELECT count(*) AS r, " + " + ".join(f"(count(*) - count({c}))" for c in _DIRTY) + """ AS x FROM dirty)
       SELECT r AS n_rows, x AS null_cells, round(x / (r * 7), 6) AS missing_rate, round(1 - x / (r * 7), 6) AS completeness,
       'amount, date_text, o_custkey, price_text, priority, sparse' AS columns_with_nulls FROM n""")
def a7_table_completeness(spark, d):
    out = P.table_quality(dirty_orders(spark, d))
    return rounded(out.select(F.col("rows").alias("n_rows"), "null_cells", "missing_rate", "completeness",
                              F.array_join("columns_with_nulls", ", ").alias("columns_with_nulls")))


@R.add("""SELECT count(*) AS n_rows, count(*) - (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_returnflag FROM lineitem)) AS duplicate_rows,
          round(1 - (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_returnflag FROM lineitem)) / count(*), 6) AS duplicate_pct FROM lineitem""")
def a8_duplicate_rows(spark, d):
    out = P.duplicate_rows(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag"))
    return rounded(out.withColumnRenamed("rows", "n_rows"))


@R.add("""SELECT 'era' AS "column", '19' AS value FROM (SELECT count(*) FROM lineitem) UNION ALL
          SELECT 'flag', min(l_returnflag) FROM lineitem WHERE l_returnflag = 'A'""")
def a9_constant_columns(spark, d):
    df = table(spark, d, "lineitem").where("l_returnflag = 'A'")
    return P.constant_columns(df.select(F.col("l_returnflag").alias("flag"), F.lit("19").alias("era"), "l_quantity", "l_shipdate"))


_OUT = {"events": ["value", "user_id"], "part": ["p_retailprice", "p_size"]}


@R.add(union_all(f"""SELECT '{t}' AS dataset, '{c}' AS "column", n, outliers, round(outliers / n, 6) AS share, n >= 4 AND outliers > 0 AS has_outliers,
    n >= 10 AND outliers / n > 0.05 AS is_outlier_column FROM (SELECT count({c}) AS n, count(*) FILTER ({c} < a - 1.5 * (b - a) OR {c} > b + 1.5 * (b - a)) AS outliers
    FROM {t}, (SELECT quantile_cont({c}, 0.25) AS a, quantile_cont({c}, 0.75) AS b FROM {t}))""" for t, cs in _OUT.items() for c in cs))
def a10_outlier_columns(spark, d):
    frames = [P.outlier_columns(table(spark, d, t), cs).select(F.lit(t).alias("dataset"), "column", "n", "outliers", "share",
                                                               "has_outliers", "is_outlier_column") for t, cs in _OUT.items()]
    return rounded(frames[0].unionByName(frames[1]))


@R.add(union_all(f"""SELECT '{t}' AS dataset, '{c}' AS "column", d AS "distinct", round(d / n, 6) AS distinct_ratio FROM (
    SELECT count(DISTINCT {c}) AS d, count(*) AS n FROM {t}) WHERE d / n > 0.5 AND d > 100""" for t, c in [
    ("customer", "c_name"), ("customer", "c_mktsegment"), ("documents", "text"), ("documents", "lang"), ("documents", "source"), ("pages", "url"), ("pages", "html")]))
def a11_high_cardinality(spark, d):
    frames = [P.high_cardinality(df).select(F.lit(n).alias("dataset"), "column", "distinct", "distinct_ratio")
              for n, df in tables(spark, d, "customer", "documents", "pages").items()]
    return rounded(frames[0].unionByName(frames[1]).unionByName(frames[2]))


@R.add(union_all(f"""SELECT '{t}' AS dataset, '{c}' AS "column", count({c}) AS n, round(skewness({c}), 5) AS skew, abs(skewness({c})) > 1 AS is_skewed FROM {t}"""
                 for t, c in [("events", "value"), ("events", "user_id"), ("documents", "n_chars"), ("documents", "doc_id")]))
def a12_skewed_columns(spark, d):
    a = P.skewed_columns(table(spark, d, "events"), ["value", "user_id"]).select(F.lit("events").alias("dataset"), "*")
    b = P.skewed_columns(table(spark, d, "documents"), ["n_chars", "doc_id"]).select(F.lit("documents").alias("dataset"), "*")
    return rounded(a.unionByName(b), 5)


@R.add("""SELECT 'good' AS "column", count(*) FILTER (quality = 1) AS true_count, count(*) FILTER (quality = 0) AS false_count, round(avg(quality), 6) AS true_pct FROM labels
          UNION ALL SELECT 'harmful', count(*) FILTER (toxic = 1), count(*) FILTER (toxic = 0), round(avg(toxic), 6) FROM labels""")
def a13_boolean_stats(spark, d):
    df = table(spark, d, "labels").select((F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("harmful"))
    return rounded(P.boolean_stats(df))


@R.add(union_all(f"""SELECT '{t}' AS dataset, '{c}' AS "column", strftime(min({c}), '%Y-%m-%d %H:%M:%S') AS first, strftime(max({c}), '%Y-%m-%d %H:%M:%S') AS last,
    CAST(floor(epoch(max({c}) - min({c})) / 86400) AS BIGINT) AS range_days FROM {t}""" for t, c in [("orders", "o_orderdate"), ("lineitem", "l_shipdate"), ("events", "ts")]))
def a14_datetime_stats(spark, d):
    frames = [P.datetime_stats(df).select(F.lit(n).alias("dataset"), "*") for n, df in tables(spark, d, "orders", "lineitem", "events").items()]
    out = frames[0].unionByName(frames[1]).unionByName(frames[2])
    stamp = "yyyy-MM-dd HH:mm:ss"
    return out.withColumns({"first": F.date_format("first", stamp), "last": F.date_format("last", stamp)})


@R.add(union_all(f"""SELECT '{t}' AS dataset, '{c}' AS "column", (SELECT count(*) FROM {t}) AS n_rows, (SELECT count(DISTINCT CAST({c} AS DATE)) FROM {t}) AS dates,
    gap_days, CASE WHEN gap_days = 1 THEN 'daily' WHEN gap_days = 7 THEN 'weekly' WHEN gap_days BETWEEN 28 AND 31 THEN 'monthly' END AS granularity FROM (
    SELECT gap_days, count(*) AS k FROM (SELECT date_diff('day', lag(day) OVER (ORDER BY day), day) AS gap_days FROM (SELECT DISTINCT {e} AS day FROM {t}))
    WHERE gap_days IS NOT NULL GROUP BY 1 ORDER BY k DESC, gap_days LIMIT 1)""" for t, c, e in [
    ("orders", "o_orderdate", "CAST(o_orderdate AS DATE)"), ("events", "ts", "CAST(ts AS DATE)")]))
def a15_temporal_granularity(spark, d):
    frames = [P.temporal_granularity(df, c).select(F.lit(n).alias("dataset"), "column", F.col("rows").alias("n_rows"), "dates",
                                                   F.col("gap_days").cast("long").alias("gap_days"), "granularity")
              for (n, df), c in zip(tables(spark, d, "orders", "events").items(), ("o_orderdate", "ts"))]
    return frames[0].unionByName(frames[1])


_SIZES = ("region", "nation", "benchmark", "labels", "customer", "lineitem")


@R.add(union_all(f"""SELECT '{t}' AS dataset, count(*) AS n_rows, CASE WHEN count(*) < 30 THEN 'very_low' WHEN count(*) < 100 THEN 'low'
    WHEN count(*) < 1000 THEN 'medium' ELSE 'high' END AS confidence FROM {t}""" for t in _SIZES))
def a16_sample_confidence(spark, d):
    sizes = S.dataset_sizes(tables(spark, d, *_SIZES))
    return sizes.select("dataset", F.col("row_count").alias("n_rows"), P.sample_confidence(F.col("row_count")).alias("confidence"))


def _role(t: str, c: str) -> str:
    return f"""SELECT '{t}' AS dataset, '{c}' AS "column", CASE WHEN count(DISTINCT {c}) = count(*) THEN 'primary_key' ELSE 'foreign_key' END AS role,
               count(DISTINCT {c}) AS cardinality FROM {t}"""


@R.add(union_all([_role("customer", "c_custkey"), _role("customer", "c_nationkey"), _role("labels", "doc_id"), _role("events", "event_id"),
                  _role("events", "user_id")]))
def a17_join_readiness(spark, d):
    return S.join_readiness(tables(spark, d, "customer", "labels", "events"), exact=True).drop("is_common_dimension")


def _use(c: str, role: str, use: str) -> str:
    return f"SELECT '{c}' AS \"column\", '{role}' AS role, {use} AS \"use\" FROM lineitem"


@R.add(union_all([_use(c, "measure", "'sum, mean, min, max, count'") + " HAVING count(*) > 0" for c in ["l_linenumber", *_LINE]]
                 + [_use("l_shipdate", "time", "'day, week, month, quarter, year'") + " HAVING count(*) > 0"]
                 + [_use(c, "dimension", f"concat(count(DISTINCT {c}), ' groups')") for c in ("l_returnflag", "l_linestatus")]
                 + [_use("l_suppkey", "dimension", "concat(count(DISTINCT l_suppkey), ' groups')") + " HAVING count(DISTINCT l_suppkey) <= 100"]))
def a18_aggregation_potential(spark, d):
    return S.aggregation_potential(tables(spark, d, "lineitem")).select("column", "role", "use")


@R.add("""SELECT 'orders' AS dataset, count(*) AS n_rows, CAST(1 AS BIGINT) AS measures, true AS has_time, '' AS dimensions, CAST(2 AS BIGINT) AS links, false AS all_have_time,
            'region, status' AS all_dimensions FROM orders UNION ALL
          SELECT 'lineitem', count(*), 5, true, 'status', 1, false, 'region, status' FROM lineitem UNION ALL
          SELECT 'customer', count(*), 1, false, 'region', 1, false, 'region, status' FROM customer""")
def a19_cross_table_context(spark, d):
    three = tables(spark, d, "orders", "lineitem", "customer")
    three["lineitem"] = three["lineitem"].withColumnRenamed("l_linestatus", "status")
    three["customer"] = three["customer"].withColumnRenamed("c_mktsegment", "region")
    edges = [{"from_dataset": "lineitem", "to_dataset": "orders"}, {"from_dataset": "orders", "to_dataset": "customer"}]
    return S.cross_table_context(three, edges).withColumnRenamed("rows", "n_rows").withColumn("links", F.col("links").cast("long"))


@R.add("""SELECT l_returnflag, l_linestatus, sum(l_quantity) AS total, round(avg(l_extendedprice), 4) AS mean_price, count(*) AS n,
          min(l_extendedprice) AS low, max(l_extendedprice) AS high FROM lineitem GROUP BY 1, 2""")
def a20_grouped_aggregates(spark, d):
    return rounded(G.aggregate_by(
        table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], total=F.sum("l_quantity"), mean_price=F.avg("l_extendedprice"),
        n=F.count(F.lit(1)), low=F.min("l_extendedprice"), high=F.max("l_extendedprice")), 4)


@R.add("""SELECT l_suppkey, round(max(l_extendedprice) - min(l_extendedprice), 4) AS "range", round(sum(l_quantity) * 100 / count(*), 4) AS sum_per_row_pct
          FROM lineitem GROUP BY 1""")
def a21_group_range(spark, d):
    df = table(spark, d, "lineitem")
    return rounded(df.groupBy("l_suppkey").agg(
        (F.max("l_extendedprice") - F.min("l_extendedprice")).alias("range"),
        F.try_divide(F.sum("l_quantity") * 100.0, F.count(F.lit(1))).alias("sum_per_row_pct")), 4)


@R.add("""SELECT l_shipmonth, coalesce(sum(l_quantity) FILTER (l_returnflag = 'A'), 0) AS A, coalesce(sum(l_quantity) FILTER (l_returnflag = 'N'), 0) AS N,
          coalesce(sum(l_quantity) FILTER (l_returnflag = 'R'), 0) AS R FROM (SELECT *, strftime(l_shipdate, '%Y-%m') AS l_shipmonth FROM lineitem) GROUP BY 1""")
def a22_pivot_table(spark, d):
    df = table(spark, d, "lineitem").withColumn("l_shipmonth", F.date_format("l_shipdate", "yyyy-MM"))
    return G.pivot_sum(df, ["l_shipmonth"], "l_returnflag", "l_quantity", ["A", "N", "R"])


@R.add("""SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS F, count(*) FILTER (o_orderstatus = 'O') AS O,
          count(*) FILTER (o_orderstatus = 'P') AS P FROM orders GROUP BY 1""")
def a23_crosstab(spark, d):
    return G.crosstab(table(spark, d, "orders"), "o_orderpriority", "o_orderstatus")


@R.add("""SELECT o_custkey, round(sum(o_totalprice), 2) AS total, round(avg(o_totalprice), 4) AS mean, count(*) AS n FROM orders GROUP BY 1
          ORDER BY sum(o_totalprice) DESC, 1 LIMIT 10""")
def a24_top_groups(spark, d):
    return rounded(G.top_groups(table(spark, d, "orders"), ["o_custkey"], "o_totalprice"), 4, total=2)


@R.add("""SELECT strftime(o_orderdate, '%Y-%m-%d') AS day, round(sum(o_totalprice), 2) AS o_totalprice FROM orders GROUP BY 1""")
def a25_daily_series(spark, d):
    out = rounded(G.daily_series(table(spark, d, "orders"), "o_orderdate", ["o_totalprice"]), 2)
    return out.withColumn("day", F.col("day").cast("string"))


@R.add("""WITH s AS (SELECT CAST(o_orderdate AS DATE) AS day, sum(o_totalprice) FILTER (o_orderstatus = 'P') AS p, sum(o_totalprice) FILTER (o_orderstatus = 'F') AS f
          FROM orders GROUP BY 1) SELECT CAST(day AS VARCHAR) AS day, round(coalesce(last_value(p IGNORE NULLS) OVER w, 0), 2) AS pending,
          round(coalesce(last_value(f IGNORE NULLS) OVER w, 0), 2) AS finished FROM s WINDOW w AS (ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def a26_filled_daily_series(spark, d):
    price = F.col("o_totalprice")
    df = table(spark, d, "orders").select("o_orderdate", F.when(F.col("o_orderstatus") == "P", price).alias("pending"),
                                          F.when(F.col("o_orderstatus") == "F", price).alias("finished"))
    out = rounded(G.filled_daily_series(df, "o_orderdate", ["pending", "finished"]), 2)
    return out.withColumn("day", F.col("day").cast("string"))


@R.add("""WITH y AS (SELECT o_orderpriority, year(o_orderdate) AS y, sum(o_totalprice) AS t FROM orders GROUP BY 1, 2),
          e AS (SELECT o_orderpriority, arg_min(t, y) AS s, arg_max(t, y) AS e, max(y) - min(y) AS n FROM y GROUP BY 1)
          SELECT o_orderpriority, round(s, 1) AS start_value, round(e, 1) AS end_value, n AS years, round((pow(e / s, 1.0 / n) - 1) * 100, 6) AS cagr_pct FROM e""")
def a29_cagr(spark, d):
    out = G.cagr(table(spark, d, "orders"), ["o_orderpriority"], "o_orderdate", "o_totalprice")
    return rounded(out.withColumn("years", F.col("years").cast("long")), 6, start_value=1, end_value=1)


QUERIES, ORACLES = R.queries, R.oracles
