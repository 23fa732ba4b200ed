from __future__ import annotations

from pyspark.sql import functions as F

from tablescout.operators import semantics as S
from tablescout.plans.queries.base import Registry, rounded, table, tables, union_all

R = Registry()

# Columns of the given tables: table, column, semantic type by name and kind (text is decided by data).
_COLUMNS = [
    ("customer", "c_custkey", "key"), ("customer", "c_name", "dimension"), ("customer", "c_nationkey", "key"),
    ("customer", "c_acctbal", "measure"), ("customer", "c_mktsegment", "dimension"),
    ("orders", "o_orderkey", "key"), ("orders", "o_custkey", "key"), ("orders", "o_orderstatus", "dimension"),
    ("orders", "o_totalprice", "measure"), ("orders", "o_orderdate", "date"), ("orders", "o_orderpriority", "dimension"),
    ("documents", "doc_id", "key"), ("documents", "text", "text"), ("documents", "lang", "dimension"),
    ("documents", "source", "dimension"), ("documents", "n_chars", "measure"),
]
_KEYS = [("customer", "c_custkey"), ("customer", "c_nationkey"), ("orders", "o_orderkey"), ("orders", "o_custkey"),
         ("lineitem", "l_orderkey"), ("lineitem", "l_partkey"), ("lineitem", "l_suppkey"), ("part", "p_partkey"),
         ("supplier", "s_suppkey"), ("supplier", "s_nationkey")]


@R.add(union_all(
    f"SELECT '{t}' AS dataset, '{c}' AS \"column\", " + (
        f"(SELECT CASE WHEN avg(length({c})) > 50 THEN 'text' ELSE 'dimension' END FROM {t})" if k in ("text", "dimension") else f"'{k}'"
    ) + " AS semantic_type" for t, c, k in _COLUMNS))
def y1_semantic_types(spark, d):
    return S.column_catalog(tables(spark, d, "customer", "orders", "documents")).select("dataset", "column", "semantic_type")


@R.add(union_all(
    f"""SELECT '{t}' AS dataset, '{c}' AS "column", count(DISTINCT {c}) = count(*) AS is_primary_key,
        count(DISTINCT {c}) < count(*) AS is_foreign_key FROM {t}""" for t, c in _KEYS))
def y2_key_candidates(spark, d):
    catalog = S.column_catalog(tables(spark, d, "customer", "orders", "lineitem", "part", "supplier"))
    return catalog.where("semantic_type = 'key'").select("dataset", "column", "is_primary_key", "is_foreign_key")


_PART = ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"]


@R.add(union_all(
    f"""SELECT '{c}' AS "column", count(*) - count({c}) AS nulls, round((count(*) - count({c})) * 100.0 / count(*), 6) AS null_pct,
        count(DISTINCT {c}) AS "distinct", round(count(DISTINCT {c}) * 100.0 / count(*), 6) AS distinct_pct FROM part""" for c in _PART))
def y3_column_stats(spark, d):
    return rounded(S.describe_columns(table(spark, d, "part"), "part", exact=True).select("column", "nulls", "null_pct", "distinct", "distinct_pct"))


def _line(c: str, kind: str, text: bool) -> str:
    examples = f"""CASE WHEN count(DISTINCT {c}) < 20 THEN concat(' (e.g., ', (SELECT string_agg(v, ', ' ORDER BY n DESC, v) FROM (
        SELECT {c} AS v, count(*) AS n FROM orders WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY n DESC, v LIMIT 3)), ')') ELSE '' END"""
    return f"""SELECT '{c}' AS "column", concat('{c}: {kind} (', count(DISTINCT {c}), ' unique, ',
        printf('%.1f', (count(*) - count({c})) * 100.0 / count(*)), '% null)'{', ' + examples if text else ''}) AS line FROM orders"""


@R.add(union_all(_line(c, k, k == "string") for c, k in [
    ("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"), ("o_totalprice", "double"),
    ("o_orderdate", "timestamp_ntz"), ("o_orderpriority", "string")]))
def y4_schema_summary(spark, d):
    return S.schema_summary(table(spark, d, "orders"), "orders", exact=True).select("column", "line")


def _can(t: str, name: str, columns: str) -> str:
    return f"SELECT '{t}' AS dataset, '{name}' AS capability, '{columns}' AS columns, count(*) AS n_rows FROM {t}"


@R.add(union_all([
    _can("supplier", "numeric", "s_suppkey, s_nationkey, s_acctbal"), _can("supplier", "categorical", "s_name"),
    _can("supplier", "aggregatable", "s_suppkey, s_nationkey, s_acctbal, s_name"),
    _can("supplier", "multi_numeric", "s_suppkey, s_nationkey, s_acctbal"),
    _can("orders", "numeric", "o_orderkey, o_custkey, o_totalprice"), _can("orders", "categorical", "o_orderstatus, o_orderpriority"),
    _can("orders", "aggregatable", "o_orderkey, o_custkey, o_totalprice, o_orderstatus, o_orderpriority"),
    _can("orders", "time", "o_orderdate, o_orderkey, o_custkey, o_totalprice"),
    _can("orders", "multi_numeric", "o_orderkey, o_custkey, o_totalprice"),
    _can("labels", "numeric", "doc_id, quality, toxic"), _can("labels", "multi_numeric", "doc_id, quality, toxic")]))
def y5_capabilities(spark, d):
    return S.capabilities(tables(spark, d, "supplier", "orders", "labels")).withColumnRenamed("rows", "n_rows")


def _range(c: str) -> str:
    return f"""SELECT '{c}' AS "column", 'numeric' AS kind, round(min({c}), 6) AS low, round(max({c}), 6) AS high,
               round(avg({c}), 4) AS mean, NULL AS examples, NULL AS earliest, NULL AS latest FROM events"""


@R.add(union_all([_range("event_id"), _range("user_id"), _range("value")] + [f"""
    SELECT '{c}', 'categorical', NULL, NULL, NULL, (SELECT string_agg(v, ', ' ORDER BY v) FROM (
        SELECT DISTINCT {c} AS v FROM events WHERE {c} IS NOT NULL ORDER BY v LIMIT 10)), NULL, NULL""" for c in ("event_type", "props")]
    + ["SELECT 'ts', 'datetime', NULL, NULL, NULL, NULL, CAST(CAST(min(ts) AS DATE) AS VARCHAR), CAST(CAST(max(ts) AS DATE) AS VARCHAR) FROM events"]))
def y7_context_profile(spark, d):
    out = S.context_profile(table(spark, d, "events"))
    time = F.col("kind") == "datetime"
    out = out.withColumns({"earliest": F.when(time, F.substring("low", 1, 10)), "latest": F.when(time, F.substring("high", 1, 10))})
    return rounded(out.withColumns({c: F.when(~time, F.col(c)).try_cast("double") for c in ("low", "high")}), 6, mean=4)


QUERIES, ORACLES = R.queries, R.oracles
