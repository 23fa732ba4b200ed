"""Ordered computations per group that survive one very large group.

A window over a group sorts the group in one task.  Where a group is over ``max_rows``, or there is no group at
all, the rows are range-sorted by group and all order columns instead, whatever their types, and stored with the
number of their range; a group of any size is then spread over ranges, and so is one order value if a further
order column tells its rows apart.  Running totals, fills and positions take two steps: one value per range,
carried across the ranges of a group, and a window inside each range.  Frames that look back a fixed number of rows
are cut into blocks by position, where the last rows of a block are repeated at the start of the next.  Both ways give the
same rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablescout.functions import correlation
from tablescout.session import durable

MAX_GROUP_ROWS = 5_000_000
_RANGE, _CARRY, _POS, _BLOCK, _HALO = "_range", "_carry", "_pos", "_block", "_halo"


def order_ranges(df: DataFrame, by: Sequence[str], order: Sequence[str], max_rows: int = MAX_GROUP_ROWS) -> DataFrame | None:
    """The rows with the number of their range along groups and order, stored; None when no group is large."""
    if by:
        sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
        rows, largest = sizes.agg(F.sum("_n"), F.max("_n")).first()
    else:
        rows = largest = df.count()
    if (largest or 0) <= max_rows and by:
        return None
    pieces = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 4 * -(-(rows or 0) // max_rows))
    return durable(df.repartitionByRange(pieces, *by, *order).withColumn(_RANGE, F.spark_partition_id()))


def _with_carry(marked: DataFrame, by: Sequence[str], per_range: Column, carried: Column) -> DataFrame:
    """Attach to every row what the earlier ranges of its group hand over."""
    totals = marked.groupBy(*by, _RANGE).agg(per_range.alias(_CARRY))
    # A few values per group; without a group, one per range.
    before = Window.partitionBy(*by).orderBy(_RANGE).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*by, _RANGE, carried.over(before).alias(_CARRY))
    same = F.col(f"l.{_RANGE}") == F.col(f"r.{_RANGE}")
    for b in by:
        same = same & F.col(f"l.{b}").eqNullSafe(F.col(f"r.{b}"))
    return marked.alias("l").join(totals.alias("r"), same, "left").select("l.*", F.col(f"r.{_CARRY}"))


def _running(order: Sequence[str], *keys: str):
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)


def cumulative_sum(df: DataFrame, value: str, by: Sequence[str], order: Sequence[str], name: str = "cumulative",
                   max_rows: int = MAX_GROUP_ROWS) -> DataFrame:
    """Running total per group; give an order that is total to make it deterministic."""
    ranges = order_ranges(df, by, order, max_rows)
    if ranges is None:
        return df.withColumn(name, F.sum(value).over(_running(order, *by)))
    out = _with_carry(ranges, by, F.sum(value), F.sum(_CARRY))
    total = F.sum(value).over(_running(order, *by, _RANGE))
    both = F.when(total.isNotNull() | F.col(_CARRY).isNotNull(), F.coalesce(total, F.lit(0)) + F.coalesce(_CARRY, F.lit(0)))
    return out.withColumn(name, both).drop(_RANGE, _CARRY)


def forward_fill(df: DataFrame, columns: Sequence[str], by: Sequence[str], order: Sequence[str],
                 max_rows: int = MAX_GROUP_ROWS) -> DataFrame:
    """Replace a missing value by the last one before it in the same group."""
    ranges = order_ranges(df, by, order, max_rows)
    if ranges is None:
        return df.withColumns({c: F.last(c, ignorenulls=True).over(_running(order, *by)) for c in columns})
    out = ranges
    for c in columns:
        last = F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(*order)))
        out = _with_carry(out, by, last, F.last(_CARRY, ignorenulls=True))
        inside = F.last(c, ignorenulls=True).over(_running(order, *by, _RANGE))
        out = out.withColumn(c, F.coalesce(inside, _CARRY)).drop(_CARRY)
    return out.drop(_RANGE)


def position(df: DataFrame, by: Sequence[str], order: Sequence[str], name: str = _POS,
             max_rows: int = MAX_GROUP_ROWS) -> DataFrame:
    """Position of each row in its group, from 0."""
    ranges = order_ranges(df, by, order, max_rows)
    if ranges is None:
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1)
    return _positions(ranges, by, order, name)


def _positions(ranges: DataFrame, by: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    out = _with_carry(ranges, by, F.count(F.lit(1)), F.sum(_CARRY))
    inside = F.row_number().over(Window.partitionBy(*by, _RANGE).orderBy(*order)) - 1
    return out.withColumn(name, inside + F.coalesce(_CARRY, F.lit(0))).drop(_RANGE, _CARRY)


def _look_back(df: DataFrame, by: Sequence[str], order: Sequence[str], reach: int, name: str, expression,
               max_rows: int) -> DataFrame:
    """Apply a window expression that reads at most ``reach`` earlier rows of the group."""
    ranges = order_ranges(df, by, order, max_rows)
    if ranges is None:
        return df.withColumn(name, expression(Window.partitionBy(*by).orderBy(*order)))
    size = max(max_rows, reach + 1)
    placed = _positions(ranges, by, order, _POS)
    block = F.floor(F.col(_POS) / size)
    home = placed.withColumn(_BLOCK, block).withColumn(_HALO, F.lit(False))
    tail = placed.where(F.col(_POS) % size >= size - reach).withColumn(_BLOCK, block + 1).withColumn(_HALO, F.lit(True))
    out = home.unionByName(tail).withColumn(name, expression(Window.partitionBy(*by, _BLOCK).orderBy(_POS)))
    return out.where(~F.col(_HALO)).drop(_POS, _BLOCK, _HALO)


def rolling_mean(df: DataFrame, value: str, by: Sequence[str], order: Sequence[str], periods: int = 4,
                 name: str = "rolling_mean", max_rows: int = MAX_GROUP_ROWS) -> DataFrame:
    """Mean of the last ``periods`` values, missing until that many are there."""

    def expression(w):
        frame = w.rowsBetween(1 - periods, 0)
        return F.when(F.count(value).over(frame) == periods, F.avg(value).over(frame))

    return _look_back(df, by, order, periods - 1, name, expression, max_rows)


def lagged(df: DataFrame, value: str, by: Sequence[str], order: Sequence[str], k: int = 1, name: str = "lagged",
           max_rows: int = MAX_GROUP_ROWS) -> DataFrame:
    return _look_back(df, by, order, k, name, lambda w: F.lag(value, k).over(w), max_rows)


def pct_change(df: DataFrame, value: str, by: Sequence[str], order: Sequence[str], name: str = "pct_change",
               max_rows: int = MAX_GROUP_ROWS) -> DataFrame:
    """Change against the previous row of the group, in percent."""

    def expression(w):
        before = F.lag(value).over(w)
        return F.try_divide((F.col(value) - before) * 100.0, before)

    return _look_back(df, by, order, 1, name, expression, max_rows)


def date_gaps(df: DataFrame, date: str, by: Sequence[str], order: Sequence[str] = (), name: str = "gap_days",
              max_rows: int = MAX_GROUP_ROWS) -> DataFrame:
    """Days since the previous row of the group."""
    return _look_back(df, by, [date, *order], 1, name,
                      lambda w: F.datediff(F.col(date).cast("date"), F.lag(date).over(w).cast("date")), max_rows)


def autocorrelation(series: DataFrame, value: str, by: Sequence[str], order: Sequence[str], lag: int = 12) -> DataFrame:
    """Correlation of a series with itself ``lag`` steps earlier; seasonal beyond 0.3."""
    shifted = lagged(series, value, by, order, lag, "_before")
    return shifted.groupBy(*by).agg(correlation(F.col(value).cast("double"), F.col("_before").cast("double")).alias("autocorrelation"),
                                    F.count(value).alias("n")).withColumn(
        "is_seasonal", F.coalesce(F.abs("autocorrelation") > 0.3, F.lit(False)))


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """One row per key, the first in order.

    The rank filter runs per task before the shuffle, so a key with very many rows sends one row
    per task.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    return keep_first(df, keys, [F.desc(c) for c in order])


def first_last(df: DataFrame, value: str, date: str, by: Sequence[str] = ()) -> DataFrame:
    """First and last total by date; rows of the same date are summed first."""
    days = df.where(F.col(date).isNotNull()).groupBy(*by, date).agg(F.sum(value).alias("_total"))
    return days.groupBy(*by).agg(F.min_by("_total", date).alias("first_value"), F.max_by("_total", date).alias("last_value"))
