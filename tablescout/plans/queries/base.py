"""Helpers of the query registry."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Query = Callable[[SparkSession, str], DataFrame]

STAR = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def tables(spark: SparkSession, folder: str, *names: str) -> dict[str, DataFrame]:
    return {n: table(spark, folder, n) for n in names}


def rounded(df: DataFrame, digits: int = 6, **special: int) -> DataFrame:
    """Round every double; results then do not depend on the order of summation."""
    return df.select(*[
        F.round(F.col(f"`{f.name}`"), special.get(f.name, digits)).alias(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f"`{f.name}`") for f in df.schema.fields])


def union_all(parts: Iterable[str]) -> str:
    return " UNION ALL ".join(parts)


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}

    def add(self, oracle: str | None = None) -> Callable[[Query], Query]:
        def register(fn: Query) -> Query:
            self.queries[fn.__name__] = fn
            if oracle is not None:
                self.oracles[fn.__name__] = oracle
            return fn

        return register


# A view of orders with everything that cleaning has to deal with, made by expressions that read the
# same in both engines: prices as text with signs, dates as text in two layouts, missing keys, a
# nearly empty column, mixed case and stray blanks.
DIRTY_SQL = """
SELECT o_orderkey,
       CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE o_custkey END AS o_custkey,
       CASE WHEN o_orderkey % 11 = 0 THEN 'n/a' WHEN o_orderkey % 13 = 0 THEN NULL
            WHEN o_orderkey % 5 = 0 THEN concat(' ', CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR(30)), '% ')
            ELSE concat('$', CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR(30))) END AS price_text,
       CASE WHEN o_orderkey % 19 = 0 THEN 'soon' WHEN o_orderkey % 23 = 0 THEN NULL
            WHEN o_orderkey % 3 = 0 THEN concat(lpad(CAST(month(o_orderdate) AS VARCHAR(2)), 2, '0'), '/',
                 lpad(CAST(day(o_orderdate) AS VARCHAR(2)), 2, '0'), '/', CAST(year(o_orderdate) AS VARCHAR(4)))
            ELSE CAST(CAST(o_orderdate AS DATE) AS VARCHAR(10)) END AS date_text,
       CASE WHEN o_orderkey % 29 = 0 THEN NULL WHEN o_orderkey % 7 = 0 THEN concat(' ', lower(o_orderpriority), ' ')
            ELSE o_orderpriority END AS priority,
       CASE WHEN o_orderkey % 50 = 0 THEN o_orderstatus END AS sparse,
       CASE WHEN o_orderkey % 31 = 0 THEN NULL ELSE o_totalprice END AS amount
FROM orders
"""


def dirty_orders(spark: SparkSession, folder: str) -> DataFrame:
    return spark.sql(DIRTY_SQL.replace("FROM orders", "FROM {orders}"), orders=table(spark, folder, "orders"))


DIRTY = f"WITH dirty AS ({DIRTY_SQL})"
