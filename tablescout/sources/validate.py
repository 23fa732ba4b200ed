"""Checks on a freshly read table."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablescout.functions import string_columns


def _finding(when: Column, severity: str, column: str, problem: str, n: Column) -> Column:
    return F.when(when, F.struct(F.lit(severity).alias("severity"), F.lit(column).alias("column"),
                                 F.lit(problem).alias("problem"), n.alias("n")))


def validate_table(df: DataFrame) -> DataFrame:
    """One row per finding: empty table, repeated names, empty columns, text mixed with numbers.

    A text column is mixed when some values are numbers but fewer than 90 % of all rows.
    """
    repeated = [n for n, times in Counter(df.columns).items() if times > 1]
    if repeated:
        return df.sparkSession.createDataFrame(
            [("issue", n, "duplicate column name", None) for n in repeated],
            "severity string, column string, problem string, n long")
    strings = set(string_columns(df))
    rows = F.count(F.lit(1))
    aggs = [rows.alias("_rows")]
    for i, c in enumerate(df.columns):
        aggs.append(F.count(F.col(c)).alias(f"p{i}"))
        if c in strings:
            aggs.append(F.count(F.trim(c).try_cast("double")).alias(f"u{i}"))
    found = [_finding(F.col("_rows") == 0, "issue", "", "no rows", F.col("_rows"))]
    for i, c in enumerate(df.columns):
        empty = (F.col("_rows") > 0) & (F.col(f"p{i}") == 0)
        found.append(_finding(empty, "warning", c, "all values missing", F.col("_rows")))
        if c in strings:
            mixed = (F.col(f"u{i}") > 0) & (F.col(f"u{i}") < F.col("_rows") * 0.9)
            found.append(_finding(mixed, "warning", c, "numbers mixed with text", F.col(f"u{i}")))
    return df.agg(*aggs).select(F.inline(F.filter(F.array(*found), lambda s: s.isNotNull())))
