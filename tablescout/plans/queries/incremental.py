"""Runs that build on earlier runs: value index, commits of the catalog, uploads to known datasets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescout.operators import catalog as C
from tablescout.operators import relate as X
from tablescout.operators import semantics as S
from tablescout.operators import value_index as V
from tablescout.plans import etl
from tablescout.plans.queries.base import Registry, rounded, table, tables, union_all
from tablescout.plans.queries.relations import _ORIENT_SQL, star_catalog, star_tables
from tablescout.session import durable, scratch_path

R = Registry()
BUCKETS = 8


def _indexed(spark, tables_: dict[str, DataFrame], catalog: DataFrame) -> V.ValueIndex:
    index = V.ValueIndex(spark, scratch_path(spark, "index"), BUCKETS)
    V.put_all(index, tables_, catalog)
    return index


@R.add(_ORIENT_SQL + """, j AS (SELECT *, parent_unique AND confidence >= 0.8 AND (sim >= 0.6 OR cover >= 90)
         AND NOT (child_unique AND sim < 0.9 AND cover < 50) AS good FROM c WHERE from_dataset = 'orders' OR to_dataset = 'orders'),
       k AS (SELECT *, row_number() OVER (PARTITION BY from_dataset, from_column ORDER BY good DESC, sim DESC, cover DESC, to_dataset, to_column) AS rn FROM j)
       SELECT from_dataset, from_column, to_dataset, to_column, round(confidence, 6) AS confidence, from_values, to_values FROM (
         SELECT k.*, CASE WHEN p.from_dataset = k.from_dataset AND p.from_column = k.from_column THEN p.from_values ELSE p.to_values END AS from_values,
                CASE WHEN p.from_dataset = k.from_dataset AND p.from_column = k.from_column THEN p.to_values ELSE p.from_values END AS to_values
         FROM k JOIN p ON (p.from_dataset = k.from_dataset AND p.from_column = k.from_column AND p.to_dataset = k.to_dataset AND p.to_column = k.to_column)
                       OR (p.to_dataset = k.from_dataset AND p.to_column = k.from_column AND p.from_dataset = k.to_dataset AND p.from_column = k.to_column)
         WHERE good AND rn = 1)""")
def r11_indexed_detection(spark, d):
    """Edges of a new table to stored ones, from the stored index of values; only the new table is read for them."""
    stored, catalog = star_tables(spark, d), durable(star_catalog(spark, d))
    new = {"orders": stored.pop("orders")}
    index = _indexed(spark, stored, catalog)
    V.put_all(index, new, catalog)
    edges = X.detect_relationships(new, catalog, counted_by=index.overlap_counts)
    return rounded(edges.select(*X.PAIR, "confidence", "from_values", "to_values"))


_EVENTS = ["event_id", "user_id", "event_type", "props"]


@R.add(union_all(f"""SELECT '{c}' AS "column", count(DISTINCT CAST({c} AS VARCHAR)) AS n_values, count(DISTINCT CASE WHEN event_id % 3 = 0 THEN CAST({c} AS VARCHAR) END) AS n_before
                     FROM events""" for c in _EVENTS))
def r11_index_append(spark, d):
    """Distinct values per column before and after two appends, each of which writes only what is new."""
    events = table(spark, d, "events").select(*_EVENTS)
    index = V.ValueIndex(spark, scratch_path(spark, "index"), BUCKETS)
    index.put("events", events.where("event_id % 3 = 0"), _EVENTS)
    before = durable(index.columns().select("column", F.col("values").alias("n_before")))
    for rest in (1, 2):
        index.append("events", events.where(f"event_id % 3 = {rest}"))
    return index.columns().select("column", F.col("values").alias("n_values")).join(before, "column")


_STORED = [("customer", "c_custkey", "customer", "true"), ("customer", "c_name", "customer", "true"), ("customer", "c_mktsegment", "customer", "true"),
           ("orders", "o_orderkey", "orders", "o_orderkey % 2 = 0"), ("orders", "o_custkey", "orders", "o_orderkey % 2 = 0"),
           ("supplier", "s_suppkey", "supplier", "true"), ("supplier", "s_name", "supplier", "true")]


@R.add(union_all(f"""SELECT '{t}' AS dataset, '{c}' AS "column", count(*) AS n_rows, count(*) - count({c}) AS nulls, count(DISTINCT {c}) = count(*) AS is_unique
                     FROM {source} WHERE {where}""" for t, c, source, where in _STORED))
def c1_catalog_commits(spark, d):
    """Columns of three tables after two runs: the second replaces one table and adds another."""
    root = scratch_path(spark, "catalog")
    kept = {"customer": ["c_custkey", "c_name", "c_mktsegment"], "orders": ["o_orderkey", "o_custkey"], "supplier": ["s_suppkey", "s_name"]}
    all_tables = {n: table(spark, d, n).select(*c) for n, c in kept.items()}
    C.save(S.column_catalog({n: all_tables[n] for n in ("customer", "orders")}), root, "columns")
    C.save(S.column_catalog({"orders": all_tables["orders"].where("o_orderkey % 2 = 0"), "supplier": all_tables["supplier"]}), root, "columns")
    return C.read(spark, root, "columns").select("dataset", "column", F.col("rows").alias("n_rows"), "nulls", "is_unique")


def _edge_sql(a: str, x: str, b: str, y: str) -> str:
    return f"""SELECT '{a}' AS from_dataset, '{x}' AS from_column, '{b}' AS to_dataset, '{y}' AS to_column,
        round(100.0 * (SELECT count(*) FROM (SELECT {x} FROM {a} INTERSECT SELECT {y} FROM {b})) / count(DISTINCT {x}), 6) AS match_pct FROM {a}"""


@R.add(union_all([_edge_sql("orders", "o_custkey", "customer", "c_custkey"), _edge_sql("customer", "c_nationkey", "nation", "n_nationkey"),
                  _edge_sql("supplier", "s_nationkey", "nation", "n_nationkey")]))
def c1_edges_of_runs(spark, d):
    """Edges in the catalog after a run on customers and orders, one on nations and one on suppliers."""
    root, known = scratch_path(spark, "catalog"), {}
    index = V.ValueIndex(spark, root, BUCKETS)
    for names in (("customer", "orders"), ("nation",), ("supplier",)):
        new = tables(spark, d, *names)
        known.update(new)
        catalog = durable(S.key_catalog(known))
        V.put_all(index, new, catalog.where(F.col("dataset").isin(*names)))
        C.save(X.detect_relationships(new, catalog, counted_by=index.overlap_counts), root, "relationships", replaces=names)
    return rounded(C.read(spark, root, "relationships").select(*X.PAIR, "match_pct"))


@R.add("""SELECT 'append' AS step, count(*) AS row_count, count(DISTINCT s_suppkey) AS n_values FROM supplier UNION ALL
          SELECT 'replace', count(*), count(DISTINCT s_suppkey) FROM supplier WHERE s_suppkey % 5 = 1""")
def u8_catalog_follows(spark, d):
    """Row and value counts in the catalog after an upload was appended and after one replaced the table."""
    root, supplier = scratch_path(spark, "lake"), table(spark, d, "supplier").select("s_suppkey", "s_name")
    store = etl.catalog_folder(root)
    first = supplier.where("s_suppkey % 2 = 0")
    path = etl.sources.replace_table(first, root, "acme_supplier")
    C.save(S.column_catalog({"supplier": first}), store, "columns")
    V.put_all(V.ValueIndex(spark, store, BUCKETS), {"supplier": first}, S.column_catalog({"supplier": first}))
    C.save(spark.createDataFrame([("supplier", "acme", path, None, "ready", 0, 2)], C.SCHEMAS["datasets"]), store, "datasets")

    def state(step: str) -> DataFrame:
        counts = C.read(spark, store, "columns").where("column = 's_suppkey'").select(F.col("distinct").alias("n_values"))
        return durable(C.read(spark, store, "datasets").select(F.lit(step).alias("step"), "row_count").join(counts, F.lit(True)))

    stored = {"supplier": spark.read.parquet(path)}
    _, stored["supplier"] = etl.process_upload(supplier.where("s_suppkey % 2 = 1"), stored, root, "supplier", action="APPEND")
    after_append = state("append")
    etl.process_upload(supplier.where("s_suppkey % 5 = 1"), stored, root, "supplier", action="REPLACE")
    return after_append.unionByName(state("replace"))


QUERIES, ORACLES = R.queries, R.oracles
