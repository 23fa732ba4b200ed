"""Stored metadata tables and queries over tables by name."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablescout.operators import commits

_S, _L, _D, _B, _I = T.StringType(), T.LongType(), T.DoubleType(), T.BooleanType(), T.IntegerType()


def _schema(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


SCHEMAS: dict[str, T.StructType] = {
    "datasets": _schema(dataset=_S, owner=_S, path=_S, domain=_S, status=_S, row_count=_L, column_count=_L),
    "columns": _schema(dataset=_S, column=_S, position=_I, type=_S, kind=_S, semantic_type=_S, is_primary_key=_B,
                       is_foreign_key=_B, is_unique=_B, rows=_L, nulls=_L, null_pct=_D, distinct=_L, distinct_pct=_D, sketch=T.BinaryType()),
    "relationships": _schema(from_dataset=_S, from_column=_S, to_dataset=_S, to_column=_S, relationship_type=_S,
                             confidence=_D, match_pct=_D, join_strategy=_S),
    "kpis": _schema(dataset=_S, name=_S, domain=_S, value=_D, unit=_S, description=_S),
    "insights": _schema(dataset=_S, analysis=_S, title=_S, finding=_S, confidence=_S),
}


def conform(df: DataFrame, table: str) -> DataFrame:
    """The columns of a metadata table in their order and types; missing ones become NULL."""
    return df.select(*[
        (F.col(f"`{f.name}`") if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in SCHEMAS[table].fields])


#: What one row stands for, where a commit does not replace all rows of a dataset.
EDGE = ("from_dataset", "from_column", "to_dataset", "to_column")


def save(df: DataFrame, root: str, table: str, replaces: Sequence[str] = ()) -> None:
    """Commit rows of a metadata table.

    They take the place of all earlier rows of the same datasets.  An edge only takes the place of the same edge, so edges
    that a later run does not look at stay.  ``replaces`` names datasets whose earlier rows, or edges on either side, are
    gone even if the commit has none for them.
    """
    commits.write(conform(df, table), f"{root.rstrip('/')}/{table}", replaces)


def read(spark: SparkSession, root: str, table: str) -> DataFrame:
    """The rows that are valid now; none if nothing was saved."""
    rows = commits.read(spark, f"{root.rstrip('/')}/{table}", SCHEMAS[table])
    if table == "relationships":
        return commits.latest(rows, ["from_dataset", "to_dataset"], EDGE)
    return commits.latest(rows, ["dataset"])


def query(spark: SparkSession, tables: Mapping[str, DataFrame], sql: str) -> DataFrame:
    """Run Spark SQL where ``{name}`` stands for a table.

    Tables are passed as parameters of the statement, so no view of the session is replaced.
    """
    return spark.sql(sql, **dict(tables))


# The questions asked of every joined table, as Spark SQL over ``{joined}``.
def top_customers_sql(customer: str, revenue: str, n: int = 10) -> str:
    return (f"SELECT {customer} AS customer, sum({revenue}) AS revenue, count(*) AS lines FROM {{joined}} "
            f"GROUP BY {customer} ORDER BY revenue DESC, customer LIMIT {n}")


def best_margins_sql(product: str, revenue: str, cost: str, n: int = 10) -> str:
    return (f"SELECT {product} AS product, sum({revenue}) AS revenue, "
            f"try_divide(sum({revenue}) - sum({cost}), sum({revenue})) * 100 AS margin_pct FROM {{joined}} "
            f"GROUP BY {product} ORDER BY margin_pct DESC, product LIMIT {n}")


def churn_risk_sql(customer: str, date: str, days: int = 180) -> str:
    return (f"SELECT {customer} AS customer, max({date}) AS last_date, count(*) AS lines, "
            f"datediff((SELECT max({date}) FROM {{joined}}), max({date})) AS idle_days FROM {{joined}} "
            f"GROUP BY {customer} HAVING idle_days > {days}")


def monthly_return_sql(date: str, revenue: str, spend: str) -> str:
    return (f"SELECT date_format({date}, 'yyyy-MM') AS month, sum({revenue}) AS revenue, sum({spend}) AS spend, "
            f"try_divide(sum({revenue}), sum({spend})) AS roi FROM {{joined}} GROUP BY 1")
