"""Grouped aggregations, pivots, rankings and daily series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablescout.functions import day_of, numeric_columns


def grouped_summary(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Sum, mean, count, minimum, maximum, range and sum per row in percent, per group."""
    return df.groupBy(*by).agg(
        F.sum(value).alias("total"), F.avg(value).alias("mean"), F.count(value).alias("n"),
        F.min(value).alias("low"), F.max(value).alias("high"),
        (F.max(value) - F.min(value)).alias("range"),
        F.try_divide(F.sum(value) * 100.0, F.count(value)).alias("sum_per_row_pct"))


def aggregate_by(df: DataFrame, by: Sequence[str], **named: Column) -> DataFrame:
    """Named aggregates: ``aggregate_by(df, ["k"], total=F.sum("x"))``."""
    return df.groupBy(*by).agg(*[agg.alias(name) for name, agg in named.items()])


def pivot_sum(df: DataFrame, index: Sequence[str], columns: str, values: str, domain: Sequence | None = None) -> DataFrame:
    """Sums of ``values`` per index and column value, 0 where there is no row.

    Pass the ``domain`` when it is known; otherwise Spark looks the distinct values up first and
    refuses more than ``spark.sql.pivotMaxValues`` of them.
    """
    grouped = df.groupBy(*index)
    pivoted = grouped.pivot(columns, list(domain)) if domain is not None else grouped.pivot(columns)
    out = pivoted.agg(F.sum(values))
    return out.fillna(0, [c for c in out.columns if c not in index])


def crosstab(df: DataFrame, rows: str, columns: str, domain: Sequence | None = None) -> DataFrame:
    grouped = df.groupBy(rows)
    pivoted = grouped.pivot(columns, list(domain)) if domain is not None else grouped.pivot(columns)
    out = pivoted.agg(F.count(F.lit(1)))
    return out.fillna(0, [c for c in out.columns if c != rows])


def top_groups(df: DataFrame, by: Sequence[str], value: str, n: int = 10) -> DataFrame:
    """The groups with the largest total; equal totals are ordered by group."""
    return (df.groupBy(*by).agg(F.sum(value).alias("total"), F.avg(value).alias("mean"), F.count(value).alias("n"))
            .orderBy(F.desc("total"), *by).limit(n))


def largest(df: DataFrame, column: str, n: int, ties: Sequence[str] = ()) -> DataFrame:
    return df.orderBy(F.desc_nulls_last(column), *ties).limit(n)


def daily_series(df: DataFrame, date: str, metrics: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Sum of each metric per calendar day; rows without a date are left out."""
    return (df.where(F.col(date).isNotNull()).groupBy(*by, day_of(date).alias("day"))
            .agg(*[F.sum(m).alias(m) for m in metrics]))


def filled_daily_series(df: DataFrame, date: str, metrics: Sequence[str]) -> DataFrame:
    """Daily sums where a missing total takes the previous day's value, or 0 at the start."""
    days = daily_series(df, date, metrics)
    w = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    return days.select("day", *[F.coalesce(F.last(m, ignorenulls=True).over(w), F.lit(0.0)).alias(m) for m in metrics])


def daily_panel(df: DataFrame, date: str, metrics: Sequence[str], dataset: str = "") -> DataFrame:
    """Daily sums of all metrics as ``(dataset, metric, day, value)``, days without a value left out."""
    days = daily_series(df, date, metrics)
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])
    return (days.select(F.lit(dataset).alias("dataset"), "day", F.inline(pairs)).where("value is not null")
            .select("dataset", "metric", "day", "value"))


def cagr(df: DataFrame, by: Sequence[str], date: str, value: str) -> DataFrame:
    """Compound yearly growth between the totals of the first and the last calendar year of a group."""
    years = df.where(F.col(date).isNotNull()).groupBy(*by, F.year(date).alias("year")).agg(F.sum(value).alias("total"))
    ends = years.groupBy(*by).agg(
        F.min_by("total", "year").alias("start_value"), F.max_by("total", "year").alias("end_value"),
        (F.max("year") - F.min("year")).alias("years"))
    growth = F.pow(F.try_divide("end_value", "start_value"), F.try_divide(F.lit(1.0), "years")) - 1
    return ends.withColumn("cagr_pct", F.when((F.col("start_value") > 0) & (F.col("years") > 0), growth * 100))


def variation_ranking(df: DataFrame, columns: Sequence[str] | None = None, n: int = 2) -> DataFrame:
    """Columns with the largest coefficient of variation."""
    from tablescout.operators.profile import per_column

    out = per_column(df, columns or numeric_columns(df), lambda c: {"mean": F.avg(c), "std": F.stddev_samp(c)})
    out = out.where("std > 0").withColumn("variation", F.col("std") / (F.abs("mean") + 1e-10))
    return out.orderBy(F.desc("variation"), "column").limit(n)
