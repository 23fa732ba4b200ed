from __future__ import annotations

from pyspark.sql import functions as F

from tablescout import sources as S
from tablescout.plans.queries.base import Registry, table
from tablescout.session import scratch_path
from tablescout.sources.sinks import read_current

R = Registry()


@R.add("""SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day FROM orders""")
def s1_csv_scan(spark, d):
    path = scratch_path(spark, "orders") + ".csv"
    table(spark, d, "orders").write.option("header", True).csv(path)
    df = S.load(spark, path)
    return df.select(F.col("o_orderkey").cast("long").alias("o_orderkey"), F.col("o_custkey").cast("long").alias("o_custkey"),
                     "o_orderstatus", "o_totalprice", F.col("o_orderdate").cast("date").cast("string").alias("day"))


@R.add("SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal, c_mktsegment FROM customer")
def s2_json_scan(spark, d):
    path = scratch_path(spark, "customer") + ".json"
    table(spark, d, "customer").write.json(path)
    return S.load(spark, path).select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")


@R.add("""SELECT l_returnflag, sum(l_quantity) AS quantity, count(*) AS n FROM lineitem
          WHERE l_shipdate < TIMESTAMP '1998-01-01' GROUP BY 1""")
def s3_parquet_scan(spark, d):
    df = S.read_parquet(spark, f"{d}/lineitem.parquet")
    early = df.where(F.col("l_shipdate") < F.lit("1998-01-01").cast("timestamp_ntz"))
    return early.groupBy("l_returnflag").agg(F.sum("l_quantity").alias("quantity"), F.count(F.lit(1)).alias("n"))


@R.add("""SELECT f.format, p.n AS n_rows, f.state FROM (VALUES ('csv','read'),('json','read'),('parquet','read')) f(format, state),
          (SELECT count(*) AS n FROM part) p UNION ALL SELECT 'xml', 0, 'rejected'""")
def s4_format_dispatch(spark, d):
    part = table(spark, d, "part")
    out = None
    for fmt in ("csv", "json", "parquet", "xml"):
        path = f"{scratch_path(spark, 'part')}.{fmt}"
        if fmt != "xml":
            S.write_table(part, path.rsplit("/", 1)[0], path.rsplit("/", 1)[1], fmt)
        try:
            frame = S.load(spark, path).agg(F.count(F.lit(1)).alias("n_rows")).select(
                F.lit(fmt).alias("format"), "n_rows", F.lit("read").alias("state"))
        except ValueError:
            frame = spark.range(1).select(F.lit(fmt).alias("format"), F.lit(0).cast("long").alias("n_rows"),
                                          F.lit("rejected").alias("state"))
        out = frame if out is None else out.unionByName(frame)
    return out


@R.add("""SELECT 'customer.parquet' AS file, 'loaded' AS state, count(*) AS n_rows FROM customer UNION ALL
          SELECT 'orders.csv', 'loaded', count(*) FROM orders UNION ALL SELECT 'part.json', 'loaded', count(*) FROM part UNION ALL
          SELECT 'notes.txt', 'rejected', 0""")
def s5_directory_ingest(spark, d):
    root = scratch_path(spark, "inbox")
    S.write_table(table(spark, d, "customer"), root, "customer.parquet")
    S.write_table(table(spark, d, "orders"), root, "orders.csv", "csv")
    S.write_table(table(spark, d, "part"), root, "part.json", "json")
    S.write_table(table(spark, d, "benchmark").select("text"), root, "notes.txt", "text")
    return S.load_directory(spark, root).overview(spark).select("file", "state", F.coalesce("rows", F.lit(0)).alias("n_rows"))


@R.add("SELECT p_partkey AS part_key, p_name AS part_name, p_retailprice AS retail_price FROM part")
def s6_normalised_names(spark, d):
    path = scratch_path(spark, "part") + ".csv"
    messy = table(spark, d, "part").select(F.col("p_partkey").alias(" part-key"), F.col("p_name").alias("part name "),
                                           F.col("p_retailprice").alias("retail price"))
    messy.write.option("header", True).csv(path)
    return S.load(spark, path, ignoreLeadingWhiteSpace=False).select(
        F.col("part_key").cast("long").alias("part_key"), "part_name", "retail_price")


_MESSY = """SELECT c_custkey, CASE WHEN c_nationkey < 10 THEN CAST(c_nationkey AS VARCHAR(10)) ELSE c_name END AS mixed,
            CAST(NULL AS VARCHAR(5)) AS nothing, CAST(c_nationkey AS VARCHAR(10)) AS digits, c_acctbal FROM customer"""


@R.add(f"""WITH m AS ({_MESSY}), s AS (SELECT count(*) AS n, count(nothing) AS pn, count(try_cast(mixed AS DOUBLE)) AS mx FROM m)
           SELECT 'warning' AS severity, 'nothing' AS "column", 'all values missing' AS problem, n FROM s WHERE pn = 0 UNION ALL
           SELECT 'warning', 'mixed', 'numbers mixed with text', mx FROM s WHERE mx > 0 AND mx < 0.9 * n""")
def s7_ingest_validation(spark, d):
    messy = spark.sql(_MESSY.replace("FROM customer", "FROM {customer}"), customer=table(spark, d, "customer"))
    return S.validate_table(messy)


@R.add("""SELECT 'acme_raw_customer_accounts' AS name, c_mktsegment, count(*) AS n,
          CAST(sum(CAST(c_acctbal AS DECIMAL(18,2))) AS DOUBLE) AS balance FROM customer GROUP BY c_mktsegment""")
def s8_table_sink(spark, d):
    root, name = scratch_path(spark, "store"), S.table_name("Acme", "raw", "Customer Accounts")
    S.write_table(table(spark, d, "customer"), root, name)
    S.write_table(table(spark, d, "customer"), root, name)
    stored = S.read_stored(spark, root, name)
    return stored.groupBy("c_mktsegment").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("c_acctbal").cast("decimal(18,2)")).cast("double").alias("balance")).select(
        F.lit(name).alias("name"), "*")


@R.add("""SELECT o_orderstatus, count(*) AS n, min(o_orderkey) AS low, max(o_orderkey) AS high FROM orders
          WHERE o_orderstatus <> 'P' GROUP BY 1""")
def s9_stored_table_scan(spark, d):
    root = scratch_path(spark, "store")
    S.replace_table(table(spark, d, "orders"), root, "orders")
    S.replace_table(read_current(spark, root, "orders").where("o_orderstatus <> 'P'"), root, "orders")
    return read_current(spark, root, "orders").groupBy("o_orderstatus").agg(
        F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("low"), F.max("o_orderkey").alias("high"))


@R.add("""SELECT o_orderkey, o_totalprice, (SELECT count(*) FROM orders) AS total_rows,
          (SELECT count(*) FROM orders) > 250 AS has_more FROM orders ORDER BY o_orderkey LIMIT 50 OFFSET 200""")
def s10_paged_read(spark, d):
    return S.page(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), ["o_orderkey"], offset=200, limit=50)


@R.add("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem ORDER BY 1, 2, 3, 4 LIMIT 100")
def s11_head_sample(spark, d):
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    return S.head(table(spark, d, "lineitem").select(*keys).orderBy(*keys), 100)


@R.add()
def s12_random_sample(spark, d):
    """About 10,000 rows; random rows have no SQL counterpart."""
    return S.sample_rows(table(spark, d, "lineitem"), cap=10_000).select("l_orderkey", "l_linenumber", "l_extendedprice")


@R.add("""SELECT 'customer' AS dataset, count(*) AS n_rows FROM customer UNION ALL SELECT 'orders', count(*) FROM orders""")
def s13_owner_tables(spark, d):
    owned = [("acme", "customer"), ("acme", "orders"), ("acme", "part"), ("other", "supplier")]
    catalog = spark.createDataFrame([(o, n, f"{d}/{n}.parquet") for o, n in owned], "owner string, dataset string, path string")
    found = S.load_owner_tables(spark, catalog, "acme", exclude=["part"])
    frames = [df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(n).alias("dataset"), "n_rows") for n, df in found.items()]
    return frames[0].unionByName(frames[1])


QUERIES, ORACLES = R.queries, R.oracles
