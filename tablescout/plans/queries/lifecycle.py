from __future__ import annotations

from pyspark.sql import functions as F

from tablescout.operators import lifecycle as L
from tablescout.plans.queries.base import Registry, rounded, table
from tablescout.session import scratch_path
from tablescout.sources import replace_table
from tablescout.sources.sinks import read_current

R = Registry()


def _split(spark, d):
    """Events before and after noon of 16 January, where the new part repeats the days from the 11th on."""
    events = table(spark, d, "events")
    cut = lambda s: F.lit(s).cast("timestamp_ntz")
    return events.where(F.col("ts") < cut("2024-01-16 12:00:00")), events.where(F.col("ts") >= cut("2024-01-11"))


_OLD = "(SELECT * FROM events WHERE ts < TIMESTAMP '2024-01-16 12:00:00')"
_NEW = "(SELECT * FROM events WHERE ts >= TIMESTAMP '2024-01-11')"


@R.add("""SELECT 'same' AS compared, true AS matches, count(*) AS n_rows FROM events UNION ALL SELECT 'flagged', true, count(*) FROM events UNION ALL
          SELECT 'renamed', false, count(*) FROM events UNION ALL SELECT 'other', false, count(*) FROM orders""")
def u1_schema_match(spark, d):
    events = table(spark, d, "events")
    against = {"same": events, "flagged": events.withColumn("_data_quality_flag", F.lit("clean")),
               "renamed": events.withColumnRenamed("value", "amount"), "other": table(spark, d, "orders")}
    frames = [df.agg(F.count(F.lit(1)).alias("n_rows")).select(
        F.lit(name).alias("compared"), F.lit(L.schemas_match(events, df)).alias("matches"), "n_rows") for name, df in against.items()]
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def _overlap_sql(method: str, compared: str, value: str, new: str = _NEW, old: str = _OLD) -> str:
    return f"""SELECT '{method}' AS method, '{compared}' AS compared, count(*) AS new_values, count(o.v) AS known_values,
        round(count(o.v) / count(*), 6) AS overlap FROM (SELECT DISTINCT {value} AS v FROM {new}) n LEFT JOIN (SELECT DISTINCT {value} AS v FROM {old}) o USING (v)"""


@R.add(_overlap_sql("date", "ts", "CAST(ts AS DATE)"))
def u2_date_overlap(spark, d):
    old, new = _split(spark, d)
    return rounded(L.overlap(new, old))


@R.add(_overlap_sql("id", "event_id", "CAST(event_id AS VARCHAR)"))
def u3_id_overlap(spark, d):
    old, new = _split(spark, d)
    return rounded(L.overlap(new.drop("ts"), old.drop("ts")))


@R.add(_overlap_sql("row", "*", "concat_ws('|', event_type, CAST(value AS VARCHAR), props)"))
def u4_row_overlap(spark, d):
    old, new = _split(spark, d)
    kept = ["event_type", "value", "props"]
    return rounded(L.overlap(new.select(*kept), old.select(*kept)))


@R.add(f"""SELECT 'copy' AS upload, 'DUPLICATE' AS decision, 0.95 AS confidence, false AS deduplicate, 1.0 AS overlap FROM (SELECT count(*) FROM events) UNION ALL
           SELECT 'partial', 'APPEND', 0.85, true, round(count(o.v) / count(*), 6) FROM (SELECT DISTINCT CAST(ts AS DATE) AS v FROM {_NEW}) n
             LEFT JOIN (SELECT DISTINCT CAST(ts AS DATE) AS v FROM {_OLD}) o USING (v) UNION ALL
           SELECT 'later', 'APPEND', 0.9, false, 0.0 UNION ALL SELECT 'other', 'NEW', 1.0, false, 0.0""")
def u5_upload_classification(spark, d):
    old, new = _split(spark, d)
    later = new.where(F.col("ts") >= F.lit("2024-01-17").cast("timestamp_ntz"))
    out = None
    for name, upload in {"copy": old, "partial": new, "later": later, "other": table(spark, d, "orders")}.items():
        frame = L.classify_upload(upload, {"events": old}).select(F.lit(name).alias("upload"), "decision", "confidence", "deduplicate", "overlap")
        out = frame if out is None else out.unionByName(frame)
    return rounded(out)


@R.add("""WITH old AS (SELECT o_orderkey, o_custkey, o_totalprice, 0 AS s FROM orders WHERE o_orderdate < TIMESTAMP '1999-01-01'),
          new AS (SELECT o_orderkey, o_custkey, o_totalprice + 1, 1 AS s FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01'),
          a AS (SELECT * FROM old UNION ALL SELECT * FROM new)
          SELECT o_orderkey, arg_max(o_custkey, s) AS o_custkey, round(arg_max(o_totalprice, s), 2) AS o_totalprice FROM a GROUP BY 1""")
def u6_append_dedup(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    old = orders.where(F.col("o_orderdate") < F.lit("1999-01-01").cast("timestamp_ntz")).drop("o_orderdate")
    new = orders.where(F.col("o_orderdate") >= F.lit("1998-01-01").cast("timestamp_ntz")).withColumn(
        "o_totalprice", F.col("o_totalprice") + 1).drop("o_orderdate")
    return rounded(L.append_dedup(old, new, ["o_orderkey"]), 2)


@R.add(f"SELECT event_id, user_id, event_type, value FROM {_OLD} UNION SELECT event_id, user_id, event_type, value FROM {_NEW}")
def u7_append_distinct(spark, d):
    old, new = _split(spark, d)
    kept = ["event_id", "user_id", "event_type", "value"]
    return L.append_distinct(old.select(*kept), new.select(*kept))


@R.add(f"SELECT event_type, count(*) AS n, min(event_id) AS low, max(event_id) AS high FROM {_NEW} GROUP BY 1")
def u8_replace(spark, d):
    old, new = _split(spark, d)
    root = scratch_path(spark, "lake")
    replace_table(old, root, "events")
    replace_table(new, root, "events")
    return read_current(spark, root, "events").groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.min("event_id").alias("low"), F.max("event_id").alias("high"))


@R.add("""SELECT 'orders' AS dataset, 'DUPLICATE' AS decision, count(*) AS new_values, 1.0 AS overlap FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) FROM
          (SELECT o_orderdate FROM orders ORDER BY o_orderkey LIMIT 100))""")
def u9_quick_duplicate_check(spark, d):
    orders = table(spark, d, "orders")
    return rounded(L.quick_duplicate_check(orders.orderBy("o_orderkey"), {"customer": table(spark, d, "customer"), "orders": orders}).select(
        "dataset", "decision", "new_values", "overlap"))


@R.add("""SELECT o_custkey FROM orders WHERE o_totalprice > 400000 UNION SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'
          EXCEPT SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'""")
def u13_suggested_extras(spark, d):
    orders = table(spark, d, "orders")
    selected = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return L.suggested_extras([orders.where("o_totalprice > 400000"), orders.where("o_orderpriority = '1-URGENT'")], selected, "o_custkey")


QUERIES, ORACLES = R.queries, R.oracles
