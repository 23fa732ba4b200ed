"""Forecasts of many daily series at once.

A panel of daily sums is bounded by the calendar per series; each series is fitted in one grouped
task.  The models need nothing but least squares, so the tasks only use numpy.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablescout.functions import numeric_columns, temporal_columns
from tablescout.operators.aggregate import daily_panel
from tablescout.operators.validation import DF_CRITICAL

MIN_ADDITIVE = 24
# Usual gap in days, its letter and the step to the next date.
RHYTHMS = ((1, 1, "D", pd.DateOffset(days=1)), (7, 7, "W", pd.DateOffset(weeks=1)), (28, 31, "M", pd.DateOffset(months=1)),
           (90, 92, "Q", pd.DateOffset(months=3)), (365, 366, "Y", pd.DateOffset(years=1)))


def _z(confidence: float) -> float:
    """Two-sided normal quantile by bisection."""
    from math import erf, sqrt

    low, high = 0.0, 10.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if erf(mid / sqrt(2)) < confidence else (low, mid)
    return (low + high) / 2


def rhythm(days: np.ndarray) -> str:
    """Letter of the most usual gap between dates; monthly when none fits."""
    gaps = np.diff(days.astype("datetime64[D]").astype("int64"))
    if not len(gaps):
        return "M"
    values, times = np.unique(gaps, return_counts=True)
    usual = values[times.argmax()]
    return next((letter for low, high, letter, _ in RHYTHMS if low <= usual <= high), "M")


def future_days(last, horizon: int, letter: str) -> list:
    step = next(s for _, _, name, s in RHYTHMS if name == letter)
    return [(pd.Timestamp(last) + step * (i + 1)).date() for i in range(horizon)]


def _design(t: np.ndarray, weekly: bool, yearly: bool, start: float, span: float) -> np.ndarray:
    columns = [np.ones_like(t), (t - start) / span]
    for use, period, order in ((weekly, 7.0, 3), (yearly, 365.25, 6)):
        if use:
            for k in range(1, order + 1):
                columns += [np.sin(2 * np.pi * k * t / period), np.cos(2 * np.pi * k * t / period)]
    return np.column_stack(columns)


def additive(t: np.ndarray, y: np.ndarray, future: np.ndarray, confidence: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Linear trend plus weekly and yearly waves by least squares, with prediction intervals."""
    span = max(t[-1] - t[0], 1.0)
    usual = np.median(np.diff(t)) if len(t) > 1 else 1.0
    weekly, yearly = usual < 7 and span >= 14 and len(y) > 16, span >= 730 and len(y) > 60
    x = _design(t, weekly, yearly, t[0], span)
    gram = x.T @ x + 1e-8 * len(y) * np.eye(x.shape[1])
    inverse = np.linalg.inv(gram)
    beta = inverse @ (x.T @ y)
    rest = y - x @ beta
    variance = float(rest @ rest) / max(len(y) - x.shape[1], 1)
    f = _design(future, weekly, yearly, t[0], span)
    point = f @ beta
    margin = _z(confidence) * np.sqrt(variance * (1 + np.einsum("ij,jk,ik->i", f, inverse, f)))
    return point, point - margin, point + margin


def is_stationary(y: np.ndarray) -> bool:
    before, change = y[:-1], np.diff(y)
    n = len(change)
    sxx = float(((before - before.mean()) ** 2).sum()) if n else 0.0
    if n < 4 or sxx == 0:
        return False
    slope = float(((before - before.mean()) * change).sum()) / sxx
    rest = change - change.mean() - slope * (before - before.mean())
    error = np.sqrt(float(rest @ rest) / (n - 2) / sxx)
    a, b, c, d = DF_CRITICAL
    return error > 0 and slope / error < a + b / n + c / n ** 2 + d / n ** 3


def _innovations(z: np.ndarray, phi: np.ndarray, theta: np.ndarray, mean: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum of squared innovations and the last innovation, for many parameters at once."""
    total, e = np.zeros_like(phi), np.zeros_like(phi)
    for i in range(1, len(z)):
        e = (z[i] - mean) - phi * (z[i - 1] - mean) - theta * e
        total += e * e
    return total, e


def arima(y: np.ndarray, horizon: int, confidence: float, d: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ARIMA(1, d, 1) by conditional least squares: a coarse grid, then three finer ones around the best."""
    d = (0 if is_stationary(y) else 1) if d is None else d
    z = np.diff(y) if d else y
    mean = float(z.mean()) if d == 0 else 0.0
    centre, width = np.zeros(2), 0.95
    for _ in range(4):
        steps = np.linspace(-width, width, 21)
        phi, theta = (g.ravel() for g in np.meshgrid(centre[0] + steps, centre[1] + steps))
        inside = (np.abs(phi) < 0.99) & (np.abs(theta) < 0.99)
        phi, theta = phi[inside], theta[inside]
        squares, _ = _innovations(z, phi, theta, np.full_like(phi, mean))
        best = int(squares.argmin())
        centre, width = np.array([phi[best], theta[best]]), width / 10
    phi, theta = centre
    squares, last = _innovations(z, np.array([phi]), np.array([theta]), np.array([mean]))
    variance = float(squares[0]) / max(len(z) - 1, 1)
    step = np.empty(horizon)
    previous = z[-1] - mean
    for h in range(horizon):
        previous = phi * previous + (theta * last[0] if h == 0 else 0.0)
        step[h] = previous + mean
    weights = np.r_[1.0, (phi + theta) * phi ** np.arange(horizon - 1)][:horizon]
    if d:
        point, weights = y[-1] + np.cumsum(step), np.cumsum(weights)
    else:
        point = step
    margin = _z(confidence) * np.sqrt(variance * np.cumsum(weights ** 2))
    return point, point - margin, point + margin


def _fit(method: str, days: np.ndarray, y: np.ndarray, future: np.ndarray, confidence: float, d: int | None = None):
    if method == "additive":
        return additive(days, y, future, confidence)
    return arima(y, len(future), confidence, d)


def backtest(method: str, days: np.ndarray, y: np.ndarray, horizon: int, confidence: float) -> tuple[float, float, float]:
    """MAPE, MAE and RMSE over the last 20 % (at least the horizon); zeros when too short."""
    test = max(horizon, int(len(y) * 0.2))
    if len(y) < test + 10:
        return 0.0, 0.0, 0.0
    predicted = _fit(method, days[:-test], y[:-test], days[-test:], confidence, 1)[0]
    error = y[-test:] - predicted
    nonzero = y[-test:] != 0
    mape = float(np.mean(np.abs(error[nonzero] / y[-test:][nonzero]))) * 100 if nonzero.any() else 0.0
    return mape, float(np.mean(np.abs(error))), float(np.sqrt(np.mean(error ** 2)))


def choose_model(n: Column) -> Column:
    return F.when(n >= MIN_ADDITIVE, "additive").otherwise("arima")


def growth_rate(current: Column, forecast: Column) -> Column:
    """Percent from the current value to the forecast; NULL when the current value is 0."""
    return F.try_divide((forecast - current) * 100.0, current)


def forecast(panel: DataFrame, by: Sequence[str], horizon: int = 6, method: str = "auto", confidence: float = 0.95,
             min_dates: int = 10) -> DataFrame:
    """One row per series and future step: prediction, bounds, model, rhythm, backtest errors, growth.

    ``panel``: the keys, ``day`` and ``value``.  Series of ``min_dates`` or fewer dates are left out.
    """
    keys = list(by)
    clean = panel.where("day is not null and value is not null").select(*keys, "day", F.col("value").cast("double").alias("value"))

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("day")
        stamps = pd.to_datetime(group["day"]).to_numpy().astype("datetime64[D]")
        y, t = group["value"].to_numpy("float64"), stamps.astype("int64").astype("float64")
        columns = [*keys, "step", "day", "prediction", "lower", "upper", "current_value", "horizon", "model", "frequency",
                   "mape", "mae", "rmse"]
        if len(y) <= min_dates:
            return pd.DataFrame(columns=columns)
        model = method if method != "auto" else ("additive" if len(y) >= MIN_ADDITIVE else "arima")
        letter = rhythm(stamps)
        dates = future_days(stamps[-1], horizon, letter)
        ahead = np.array(dates, dtype="datetime64[D]").astype("int64").astype("float64")
        point, low, high = _fit(model, t, y, ahead, confidence)
        mape, mae, rmse = backtest(model, t, y, horizon, confidence)
        out = pd.DataFrame({"step": np.arange(1, horizon + 1), "day": dates, "prediction": point, "lower": low, "upper": high})
        for i, key in enumerate(keys):
            out.insert(i, key, group[key].iloc[0])
        return out.assign(current_value=y[-1], horizon=horizon, model=model, frequency=letter, mape=mape, mae=mae, rmse=rmse)

    schema = ", ".join(f"{k} {panel.schema[k].dataType.simpleString()}" for k in keys)
    schema += (", step int, day date, prediction double, lower double, upper double, current_value double, horizon int, "
               "model string, frequency string, mape double, mae double, rmse double")
    out = clean.groupBy(*keys).applyInPandas(fit, schema)
    first = F.first("prediction").over(Window.partitionBy(*keys).orderBy("step"))
    return out.withColumn("growth_rate", growth_rate(F.col("current_value"), first))


def metric_panel(tables: Mapping[str, DataFrame], min_rows: int = 20, columns: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """Daily sums of every numeric column by every date column of every table.

    Metrics with ``min_rows`` or fewer values are left out.
    """
    frames = []
    for name, df in tables.items():
        metrics = list((columns or {}).get(name) or numeric_columns(df))
        for date in temporal_columns(df):
            counted = df.where(F.col(date).isNotNull())
            known = counted.agg(*[F.count(m).alias(m) for m in metrics]).first() if metrics else {}
            enough = [m for m in metrics if known[m] > min_rows]
            if enough:
                frames.append(daily_panel(df, date, enough, name).withColumn("date_column", F.lit(date)))
    return reduce(DataFrame.unionByName, frames)


def forecast_all(tables: Mapping[str, DataFrame], horizon: int = 7, columns: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """Forecast every metric of every table, all series in one grouped job."""
    return forecast(metric_panel(tables, columns=columns), ["dataset", "date_column", "metric"], horizon)


def future_calendar(panel: DataFrame, by: Sequence[str], horizon: int, unit: str = "day") -> DataFrame:
    """The next dates of each series."""
    step = F.expr(f"interval 1 {unit}")
    last = panel.groupBy(*by).agg(F.max("day").alias("last"))
    ahead = F.sequence(F.col("last") + step, F.col("last") + F.expr(f"interval {horizon} {unit}"), step)
    return last.select(*by, F.posexplode(ahead).alias("step", "day")).withColumn("step", F.col("step") + 1)
