"""Column and table profiles.

Every function makes one aggregation over the table for all columns at once (for up to
``COLUMNS_PER_PASS`` of them); the wide result row is turned into one row per column afterwards.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablescout.functions import (
    boolean_columns, column_quantiles, day_of, numeric_columns, row_digest, string_columns, temporal_columns,
)
from tablescout.functions.quantiles import HELD_VALUES
from tablescout.session import durable

TEXT_LENGTH = 50
COLUMNS_PER_PASS = 200
MIN_ROWS = 10


def quoted(column: str) -> str:
    return "`" + column.replace("`", "``") + "`"


def literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def per_column(
    df: DataFrame, columns: Sequence[str], metrics: Callable[[str], dict[str, Column | str]], extra: dict[str, Column | str] | None = None,
) -> DataFrame:
    """One row per column with its ``metrics``; ``extra`` aggregates repeat on every row.

    A metric is an aggregate as a Column or as a SQL expression.
    """
    columns = list(columns)
    extra = extra or {}
    if not columns:
        raise ValueError("no column to profile")
    if len(columns) > COLUMNS_PER_PASS:
        return per_column(df, columns[:COLUMNS_PER_PASS], metrics, extra).unionByName(
            per_column(df, columns[COLUMNS_PER_PASS:], metrics, extra))

    def named(agg: Column | str, name: str) -> Column:
        return F.expr(f"{agg} AS {name}") if isinstance(agg, str) else agg.alias(name)

    wide = [named(agg, f"e_{name}") for name, agg in extra.items()]
    rows = []
    for i, column in enumerate(columns):
        found = metrics(column)
        wide += [named(agg, f"m{i}_{name}") for name, agg in found.items()]
        fields = [f"{literal(column)} AS column", *[f"e_{n} AS `{n}`" for n in extra], *[f"m{i}_{n} AS `{n}`" for n in found]]
        rows.append(f"struct({', '.join(fields)})")
    return df.agg(*wide).selectExpr(f"inline(array({', '.join(rows)}))")


def declared_kind(df: DataFrame, column: str) -> str:
    if column in temporal_columns(df):
        return "datetime"
    if column in numeric_columns(df):
        return "numeric"
    if column in boolean_columns(df):
        return "boolean"
    if column in string_columns(df):
        return "categorical"
    return "other"


def comparable_columns(df: DataFrame) -> list[str]:
    """Columns that can be counted as values (everything but maps)."""
    return [f.name for f in df.schema.fields if not isinstance(f.dataType, T.MapType)]


def column_kinds(df: DataFrame) -> DataFrame:
    """Numeric, datetime, boolean, categorical or text; text is string with a mean length over 50."""
    strings, types = set(string_columns(df)), {f.name: f.dataType.simpleString() for f in df.schema.fields}

    def metrics(c: str) -> dict[str, Column]:
        length = F.avg(F.length(quoted(c))) if c in strings else F.lit(None).cast("double")
        kind = F.lit(declared_kind(df, c))
        if c in strings:
            kind = F.when(length > TEXT_LENGTH, F.lit("text")).otherwise(kind)
        return {"type": F.lit(types[c]), "kind": kind, "avg_length": length}

    return per_column(df, df.columns, metrics)


def exact_distinct(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``column, distinct`` by grouping 128-bit digests: two numbers per value travel, never the values."""
    cells = [F.when(F.col(quoted(c)).isNotNull(), F.struct(
        F.lit(i).alias("i"), F.xxhash64(F.col(quoted(c))).alias("a"), F.xxhash64(F.lit(i + 1), F.col(quoted(c))).alias("b"))) for i, c in enumerate(columns)]
    values = df.select(F.explode_outer(F.array(*cells)).alias("v")).where("v is not null").select("v.*").distinct()
    names = F.element_at(F.array(*[F.lit(c) for c in columns]), F.col("i") + 1)
    return values.groupBy("i").agg(F.count(F.lit(1)).alias("distinct")).select(names.alias("column"), "distinct")


def distinct_counts(df: DataFrame, columns: Sequence[str] | None = None, approximate: bool = False) -> DataFrame:
    """Distinct non-null values per column and their share of all rows."""
    columns = list(columns or comparable_columns(df))
    if approximate:
        out = per_column(df, columns, lambda c: {"distinct": f"approx_count_distinct({quoted(c)})"}, {"rows": "count(1)"})
    else:
        out = per_column(df, columns, lambda c: {}, {"rows": "count(1)"}).join(exact_distinct(df, columns), "column", "left").fillna(0, ["distinct"])
    return out.withColumn("distinct_ratio", F.coalesce(F.try_divide("distinct", "rows"), F.lit(0.0)))


def null_counts(df: DataFrame) -> DataFrame:
    out = per_column(df, df.columns, lambda c: {"nulls": f"count_if({quoted(c)} IS NULL)"}, {"rows": "count(1)"})
    return (out.withColumn("null_pct", F.coalesce(F.try_divide(F.col("nulls") * 100.0, F.col("rows")), F.lit(0.0)))
            .withColumn("all_null", (F.col("nulls") == F.col("rows")) & (F.col("rows") > 0)))


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows equal to an earlier row: all rows minus distinct rows.

    Rows are counted by a 256-bit digest when they hold text, so the shuffle moves digests and hot
    copies collapse before it.
    """
    columns = comparable_columns(df)
    plain = all(isinstance(f.dataType, (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType, T.BooleanType))
                for f in df.schema.fields)
    keyed = df.select(*map(quoted, columns)) if plain else df.select(row_digest(columns).alias("_digest"))
    groups = keyed.groupBy(*map(quoted, keyed.columns)).agg(F.count(F.lit(1)).alias("_copies"))
    out = groups.agg(F.coalesce(F.sum("_copies"), F.lit(0)).alias("rows"), F.count(F.lit(1)).alias("distinct_rows"))
    return out.select(
        "rows", (F.col("rows") - F.col("distinct_rows")).alias("duplicate_rows"),
        F.coalesce(F.try_divide(F.col("rows") - F.col("distinct_rows"), F.col("rows")), F.lit(0.0)).alias("duplicate_pct"))


def sample_confidence(n: Column) -> Column:
    return (F.when(n < 30, "very_low").when(n < 100, "low").when(n < 1000, "medium").otherwise("high"))


def table_quality(df: DataFrame) -> DataFrame:
    """Completeness, columns with missing values and the confidence that the row count allows.

    One row: ``missing_rate`` is the share of empty cells, ``completeness`` the rest.
    """
    nulls = null_counts(df)
    return nulls.agg(
        F.max("rows").alias("rows"), F.count(F.lit(1)).alias("columns"), F.sum("nulls").alias("null_cells"),
        F.array_sort(F.collect_list(F.when(F.col("nulls") > 0, F.col("column")))).alias("columns_with_nulls"),
        F.array_sort(F.collect_list(F.when(F.col("all_null"), F.col("column")))).alias("columns_all_null"),
    ).withColumn("missing_rate", F.coalesce(F.try_divide(F.col("null_cells"), F.col("rows") * F.col("columns")), F.lit(0.0))
    ).withColumn("completeness", F.lit(1.0) - F.col("missing_rate")
    ).withColumn("confidence", sample_confidence(F.col("rows")))


def constant_columns(df: DataFrame) -> DataFrame:
    """Columns with exactly one distinct value; decided by minimum = maximum, without a shuffle."""
    columns = [f.name for f in df.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    out = per_column(df, columns, lambda c: {"low": F.min(quoted(c)).cast("string"), "same": F.min(quoted(c)) == F.max(quoted(c))})
    return out.where("same").select("column", F.col("low").alias("value"))


def numeric_summary(df: DataFrame, columns: Sequence[str] | None = None, exact_rows: int = HELD_VALUES) -> DataFrame:
    """Mean, sample deviation, range, quartiles, distinct and missing values per numeric column."""
    columns = list(columns or numeric_columns(df))
    quartiles = column_quantiles(df, columns, [0.25, 0.5, 0.75], exact_rows)

    def metrics(c: str) -> dict[str, str]:
        q, found = quoted(c), quartiles[c] or [None] * 3
        return {"mean": f"avg({q})", "std": f"stddev_samp({q})", "min": f"CAST(min({q}) AS DOUBLE)", "max": f"CAST(max({q}) AS DOUBLE)",
                "missing": f"count_if({q} IS NULL)",
                **{name: "CAST(NULL AS DOUBLE)" if v is None else f"{v!r}D" for name, v in zip(("q25", "q50", "q75"), found)}}

    # Counted apart: distinct counts repeat each row per column, which the other figures need not carry.
    distinct = distinct_counts(df, columns).select("column", "distinct")
    return per_column(df, columns, metrics).join(distinct, "column")


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Non-null values of several columns with their frequency, as text, in one shuffle."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(quoted(c)).cast("string").alias("value")) for c in columns])
    return (df.select(F.inline(pairs)).where(F.col("value").isNotNull())
            .groupBy("column", "value").agg(F.count(F.lit(1)).alias("freq")))


def top_values(df: DataFrame, columns: Sequence[str], k: int = 5) -> DataFrame:
    """The ``k`` most frequent values per column; equal counts are ordered by value.

    The rank filter is applied per task before the shuffle (window group limit), so a column with
    very many values does not gather in one task.
    """
    w = Window.partitionBy("column").orderBy(F.desc("freq"), F.asc("value"))
    return value_counts(df, columns).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def categorical_summary(df: DataFrame, columns: Sequence[str] | None = None, k: int = 5) -> DataFrame:
    """Distinct and missing values, most common value and its count, top ``k`` as ``value=count`` text.

    The table is read once; the counted values are materialised for the totals and the ranking.
    """
    columns = list(columns or string_columns(df))
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(quoted(c)).cast("string").alias("value")) for c in columns])
    counts = durable(df.select(F.inline(pairs)).groupBy("column", "value").agg(F.count(F.lit(1)).alias("freq")))
    totals = counts.groupBy("column").agg(
        F.count("value").alias("distinct"), F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("freq"))), F.lit(0)).alias("missing"))
    w = Window.partitionBy("column").orderBy(F.desc("freq"), F.asc("value"))
    tops = counts.where("value is not null").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    best = tops.groupBy("column").agg(
        F.min_by("value", "rank").alias("most_common"), F.max("freq").alias("most_common_freq"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "value", "freq"))),
                                 lambda s: F.concat(s["value"], F.lit("="), s["freq"].cast("string"))), ", ").alias("top"))
    return totals.join(best, "column", "left").fillna(0, ["most_common_freq"])


def frequency(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(quoted(column)).agg(F.count(F.lit(1)).alias("freq")).orderBy(F.desc("freq"), F.asc(quoted(column)))


def outlier_columns(df: DataFrame, columns: Sequence[str] | None = None, exact_rows: int = HELD_VALUES) -> DataFrame:
    """Values beyond 1.5 interquartile ranges per numeric column.

    ``has_outliers``: any, with at least 4 values.  ``is_outlier_column``: more than 5 % of at
    least 10 values.
    """
    columns = list(columns or numeric_columns(df))
    quartiles = column_quantiles(df, columns, [0.25, 0.75], exact_rows)

    def metrics(c: str) -> dict[str, Column]:
        q1, q3 = quartiles[c] or (None, None)
        spread = 1.5 * (q3 - q1) if q1 is not None else 0.0
        low, high = (q1 - spread, q3 + spread) if q1 is not None else (None, None)
        x = F.col(quoted(c))
        outside = (x < F.lit(low)) | (x > F.lit(high))
        return {"n": F.count(x), "low": F.lit(low).cast("double"), "high": F.lit(high).cast("double"),
                "outliers": F.count_if(outside)}

    return (per_column(df, columns, metrics)
            .withColumn("share", F.coalesce(F.try_divide("outliers", "n"), F.lit(0.0)))
            .withColumn("has_outliers", (F.col("n") >= 4) & (F.col("outliers") > 0))
            .withColumn("is_outlier_column", (F.col("n") >= MIN_ROWS) & (F.col("share") > 0.05)))


def high_cardinality(df: DataFrame, columns: Sequence[str] | None = None, min_distinct: int = 100) -> DataFrame:
    """Columns with more than ``min_distinct`` values that cover more than half of the rows."""
    return distinct_counts(df, columns or string_columns(df)).where(
        (F.col("distinct_ratio") > 0.5) & (F.col("distinct") > min_distinct))


def sample_skewness(column: str) -> Column:
    """Bias-corrected skewness from Spark's population skewness."""
    x = F.col(quoted(column))
    n = F.count(x).cast("double")
    return F.when(n > 2, F.skewness(x) * F.sqrt(n * (n - 1)) / (n - 2))


def skewed_columns(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    out = per_column(df, columns or numeric_columns(df), lambda c: {"n": F.count(quoted(c)), "skew": sample_skewness(c)})
    return out.withColumn("is_skewed", (F.col("n") >= MIN_ROWS) & (F.abs("skew") > 1))


def boolean_stats(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return per_column(df, columns or boolean_columns(df), lambda c: {
        "true_count": F.count_if(F.col(quoted(c))), "false_count": F.count_if(~F.col(quoted(c))),
        "true_pct": F.avg(F.col(quoted(c)).cast("int"))})


def datetime_stats(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """First and last time and the number of whole days between them."""
    return per_column(df, columns or temporal_columns(df), lambda c: {
        "first": F.min(quoted(c)).cast("timestamp_ntz"), "last": F.max(quoted(c)).cast("timestamp_ntz"),
        "range_days": F.timestamp_diff("DAY", F.min(quoted(c)), F.max(quoted(c)))})


def temporal_granularity(df: DataFrame, column: str, min_rows: int = 12) -> DataFrame:
    """The most usual gap between neighbouring dates and the rhythm it stands for.

    The window runs over distinct calendar days only, whatever the number of rows.  Equal counts
    choose the shorter gap.
    """
    days = df.select(day_of(column).alias("day")).where("day is not null").groupBy("day").agg(
        F.count(F.lit(1)).alias("rows"))
    gaps = days.withColumn("gap", F.datediff("day", F.lag("day").over(Window.orderBy("day"))))
    per_gap = gaps.groupBy("gap").agg(F.count(F.lit(1)).alias("times"), F.sum("rows").alias("rows"),
                                      F.min("day").alias("first"), F.max("day").alias("last"))
    usual = F.when(F.col("gap").isNotNull(), F.struct(-F.col("times"), F.col("gap")))
    totals = per_gap.agg(
        F.coalesce(F.sum("times"), F.lit(0)).alias("dates"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"),
        F.min("first").alias("first"), F.max("last").alias("last"), F.min_by("gap", usual).alias("gap_days"))
    gap = F.col("gap_days")
    rhythm = (F.when(gap == 1, "daily").when(gap == 7, "weekly").when(gap.between(28, 31), "monthly")
              .when(gap.between(90, 92), "quarterly").when(gap.between(365, 366), "yearly"))
    return (totals.select(F.lit(column).alias("column"), "*")
            .withColumn("granularity", rhythm)
            .withColumn("is_time_series", F.col("granularity").isNotNull() & (F.col("rows") >= min_rows)))
