"""Granger causality between daily series.

The tests run on daily sums, whose length is bounded by the calendar whatever the number of rows.
Each pair of series is tested in a task of its own.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablescout.functions import correlation, f_sf, numeric_columns
from tablescout.operators.aggregate import daily_panel, filled_daily_series
from tablescout.operators.correlate import causal_pair
from tablescout.operators.windows import lagged

ALPHA = 0.05
# Words in a column name that make it an effect or a cause in a joined table.
EFFECT_WORDS = ("revenue", "sales", "profit", "value")
CAUSE_WORDS = ("cost", "price", "quantity")


def strength(p_value: Column, alpha: float = ALPHA) -> Column:
    return (F.when(p_value >= alpha, "none").when(p_value < 0.01, "strong").when(p_value < 0.05, "moderate")
            .otherwise("weak"))


def _residual_squares(design: np.ndarray, y: np.ndarray) -> float:
    solution = np.linalg.lstsq(design, y, rcond=None)[0]
    rest = y - design @ solution
    return float(rest @ rest)


def lag_statistics(x: np.ndarray, y: np.ndarray, max_lag: int) -> pd.DataFrame:
    """F statistic per lag: does the past of ``x`` improve on the past of ``y`` alone?"""
    n = len(y)
    spread = [v.std() or 1.0 for v in (x, y)]
    x, y = (x - x.mean()) / spread[0], (y - y.mean()) / spread[1]
    found = []
    for p in range(1, min(max_lag, n // 5) + 1):
        rows = n - p
        past = {name: np.column_stack([v[p - k:n - k] for k in range(1, p + 1)]) for name, v in (("x", x), ("y", y))}
        one = np.ones((rows, 1))
        own = _residual_squares(np.hstack([one, past["y"]]), y[p:])
        both = _residual_squares(np.hstack([one, past["y"], past["x"]]), y[p:])
        freedom = rows - 2 * p - 1
        if freedom > 0 and both > 0:
            found.append((p, (own - both) / p / (both / freedom), float(p), float(freedom)))
    return pd.DataFrame(found, columns=["lag", "f_statistic", "df1", "df2"])


def granger_lags(panel: DataFrame, pairs: DataFrame, max_lag: int = 12, dataset: Sequence[str] = ("dataset",)) -> DataFrame:
    """All lags of all pairs: ``cause``, ``effect``, ``lag``, ``f_statistic``, ``p_value``.

    ``panel``: daily sums ``(dataset, metric, day, value)``; ``pairs``: ``(dataset, cause, effect)``.
    """
    keys = list(dataset)
    x = panel.select(*keys, F.col("metric").alias("cause"), "day", F.col("value").alias("x"))
    y = panel.select(*keys, F.col("metric").alias("effect"), "day", F.col("value").alias("y"))
    both = pairs.join(x, [*keys, "cause"]).join(y, [*keys, "effect", "day"]).select(*keys, "cause", "effect", "day", "x", "y")
    names = [*keys, "cause", "effect"]

    def test(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("day")
        out = lag_statistics(group["x"].to_numpy("float64"), group["y"].to_numpy("float64"), max_lag)
        for i, name in enumerate(names):
            out.insert(i, name, group[name].iloc[0])
        return out

    schema = ", ".join(f"{n} string" for n in names) + ", lag long, f_statistic double, df1 double, df2 double"
    lags = both.groupBy(*names).applyInPandas(test, schema)
    return lags.withColumn("p_value", f_sf("f_statistic", "df1", "df2"))


def best_lag(lags: DataFrame, alpha: float = ALPHA, dataset: Sequence[str] = ("dataset",)) -> DataFrame:
    """The lag with the smallest p-value of each pair (the shorter one if equal) and its verdict."""
    order = F.struct("p_value", "lag")
    out = lags.groupBy(*dataset, "cause", "effect").agg(
        F.min_by("lag", order).alias("lag"), F.min_by("f_statistic", order).alias("f_statistic"),
        F.min("p_value").alias("p_value"), F.count(F.lit(1)).alias("lags_tested"))
    return out.withColumns({"is_significant": F.col("p_value") < alpha, "strength": strength(F.col("p_value"), alpha)})


def lagged_correlation(daily: DataFrame, cause: str, effect: str, lag: int) -> DataFrame:
    """Correlation of the effect with the cause ``lag`` days of the series earlier."""
    shifted = lagged(daily, cause, [], ["day"], lag, "_shifted") if lag > 0 else daily.withColumn("_shifted", F.col(cause))
    return shifted.agg(correlation(F.col("_shifted").cast("double"), F.col(effect).cast("double")).alias("correlation")).select(
        F.lit(cause).alias("cause"), F.lit(effect).alias("effect"), F.lit(lag).alias("lag"), "correlation")


def _pairs(df: DataFrame, dataset: str, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    return df.sparkSession.createDataFrame([(dataset, a, b) for a, b in pairs], "dataset string, cause string, effect string")


def causes_of(df: DataFrame, date: str, causes: Sequence[str], effect: str, dataset: str = "", max_lag: int = 12) -> DataFrame:
    """Many possible causes of one effect, the clearest first."""
    panel = daily_panel(df, date, [*causes, effect], dataset)
    out = best_lag(granger_lags(panel, _pairs(df, dataset, [(c, effect) for c in causes]), max_lag))
    return out.withColumn("total_tested", F.lit(len(causes))).orderBy("p_value", "cause")


def all_causes(df: DataFrame, date: str, columns: Sequence[str] | None = None, dataset: str = "", max_lag: int = 12,
               significant_only: bool = True, pairs: Sequence[tuple[str, str]] | None = None) -> DataFrame:
    """Every pair of numeric columns, earlier column as cause, on daily sums; ``pairs`` narrows it to some."""
    if pairs is not None:
        columns = sorted({c for p in pairs for c in p})
    columns = list(columns or numeric_columns(df))
    pairs = list(combinations(columns, 2)) if pairs is None else list(pairs)
    out = best_lag(granger_lags(daily_panel(df, date, columns, dataset), _pairs(df, dataset, pairs), max_lag))
    return out.where("is_significant") if significant_only else out


def _on_daily_sums(df: DataFrame, date: str, cause: str, effect: str, dataset: str, most: int) -> DataFrame:
    daily = filled_daily_series(df, date, [cause, effect])
    panel = daily.select(F.lit(dataset).alias("dataset"), "day", F.inline(F.array(
        F.struct(F.lit(cause).alias("metric"), F.col(cause).cast("double").alias("value")),
        F.struct(F.lit(effect).alias("metric"), F.col(effect).cast("double").alias("value")))))
    return best_lag(granger_lags(panel, _pairs(df, dataset, [(cause, effect)]), most))


def likely_cause(df: DataFrame, date: str, columns: Sequence[str] | None = None, dataset: str = "") -> DataFrame | None:
    """Granger test of the best correlated pair of columns on daily sums."""
    pair = causal_pair(df, columns)
    return None if pair is None else _on_daily_sums(df, date, *pair, dataset, 10)


def cross_table_pair(joined: DataFrame, columns: Sequence[str] | None = None) -> tuple[str, str] | None:
    """The first cost, price or quantity, and the first revenue, sales, profit or value."""
    columns = list(columns or numeric_columns(joined))
    effects = [c for c in columns if any(w in c.lower() for w in EFFECT_WORDS)]
    causes = [c for c in columns if any(w in c.lower() for w in CAUSE_WORDS) and c not in effects[:1]]
    return (causes[0], effects[0]) if effects and causes else None


def cross_table_cause(joined: DataFrame, date: str, columns: Sequence[str] | None = None, dataset: str = "joined") -> DataFrame | None:
    """Granger test of the first cost, price or quantity on the first revenue, sales, profit or value."""
    pair = cross_table_pair(joined, columns)
    return None if pair is None else _on_daily_sums(joined, date, *pair, dataset, 5)
