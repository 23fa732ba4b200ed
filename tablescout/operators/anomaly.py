"""Anomalies by z-score, interquartile range and isolation forest."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablescout.functions import column_quantiles, group_quantiles, numeric_columns
from tablescout.functions.quantiles import EXACT_GROUP_ROWS, HELD_VALUES

# Thresholds of the methods and of the severities.
Z_LIMIT = 3.0
IQR_SPREAD = 1.5
CONTAMINATION = 0.1
TREES, TREE_ROWS = 100, 256
NORMAL_P = 0.05


def severity_z(score: Column) -> Column:
    return F.when(score > 5, "critical").when(score > 4, "high").when(score > 3, "medium").otherwise("low")


def severity_iqr(value: Column, low: Column, high: Column, iqr: Column) -> Column:
    """By the distance beyond the fence, in interquartile ranges."""
    beyond = F.when(value < low, low - value).otherwise(value - high)
    beyond = F.when(iqr > 0, beyond / iqr).otherwise(0.0)
    return F.when(beyond > 3, "critical").when(beyond > 2, "high").when(beyond > 1.5, "medium").otherwise("low")


def severity_forest(score: Column) -> Column:
    return F.when(score > 1.5, "critical").when(score > 1.0, "high").when(score > 0.5, "medium").otherwise("low")


def jarque_bera(value: Column | str) -> Column:
    """Jarque-Bera statistic; its p-value under normality is exp(-statistic / 2)."""
    value = F.col(value) if isinstance(value, str) else value
    n = F.count(value).cast("double")
    return n / 6 * (F.pow(F.skewness(value), 2) + F.pow(F.kurtosis(value), 2) / 4)


def normality(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Whether each column may be normal at the 5 % level."""
    from tablescout.operators.profile import per_column

    out = per_column(df, columns or numeric_columns(df), lambda c: {
        "n": F.count(c), "skew": F.skewness(c), "kurtosis": F.kurtosis(c), "jarque_bera": jarque_bera(c)})
    return out.withColumn("p_value", F.exp(-F.col("jarque_bera") / 2)).withColumn(
        "is_normal", F.coalesce(F.col("p_value") > NORMAL_P, F.lit(False)))


def choose_method(n: Column, p_value: Column) -> Column:
    """z-score for 5000 or more values, and for 20 or more that may be normal; else IQR."""
    return F.when((n >= 5000) | ((n >= 20) & F.coalesce(p_value > NORMAL_P, F.lit(False))), "zscore").otherwise("iqr")


def _same(by: Sequence[str]) -> Column:
    out = F.lit(True)
    for b in by:
        out = out & F.col(f"d.{b}").eqNullSafe(F.col(f"s.{b}"))
    return out


def _with_group_values(df: DataFrame, by: Sequence[str], stats: DataFrame, names: Sequence[str]) -> DataFrame:
    """Attach one row of numbers per group; without groups the numbers become literals."""
    if not by:
        row = stats.first()
        return df.withColumns({f"_{n}": F.lit(row[n] if row else None).cast("double") for n in names})
    return df.alias("d").join(stats.alias("s"), _same(by)).select("d.*", *[F.col(f"s.{n}").alias(f"_{n}") for n in names])


def _result(df: DataFrame, value: str, by: Sequence[str], ids: Sequence[str], expected: Column, score: Column,
            severity: Column, method: str, where: Column) -> DataFrame:
    kept = list(dict.fromkeys([*by, *ids]))
    x = F.col(value).cast("double")
    return df.where(where).select(
        *kept, x.alias("value"), expected.alias("expected_value"), (x - expected).alias("deviation"),
        severity.alias("severity"), score.alias("anomaly_score"), F.lit(method).alias("method"))


def zscore_anomalies(df: DataFrame, value: str, by: Sequence[str] = (), ids: Sequence[str] = (), limit: float = Z_LIMIT) -> DataFrame:
    """Values more than ``limit`` sample deviations from the mean of their group."""
    stats = df.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))
    out = _with_group_values(df, by, stats, ["mean", "std"])
    score = F.abs(F.col(value) - F.col("_mean")) / F.nullif(F.col("_std"), F.lit(0.0))
    return _result(out, value, by, ids, F.col("_mean"), score, severity_z(score), "zscore", score > limit)


def iqr_anomalies(df: DataFrame, value: str, by: Sequence[str] = (), ids: Sequence[str] = (), spread: float = IQR_SPREAD,
                  exact_rows: int | None = None) -> DataFrame:
    """Values beyond ``spread`` interquartile ranges from the quartiles of their group."""
    names = ["q1", "median", "q3"]
    if by:
        out = _with_group_values(df, by, group_quantiles(df, by, value, [0.25, 0.5, 0.75], names, exact_rows or EXACT_GROUP_ROWS), names)
    else:
        found = column_quantiles(df, [value], [0.25, 0.5, 0.75], exact_rows or HELD_VALUES)[value] or [None] * 3
        out = df.withColumns({f"_{n}": F.lit(v).cast("double") for n, v in zip(names, found)})
    q1, median, q3 = (F.col(f"_{n}") for n in names)
    iqr = q3 - q1
    low, high, x = q1 - spread * iqr, q3 + spread * iqr, F.col(value)
    score = F.when(iqr > 0, F.abs(x - median) / iqr).otherwise(0.0)
    return _result(out, value, by, ids, median, score, severity_iqr(x, low, high, iqr), "iqr", (x < low) | (x > high))


def _grow(values: np.ndarray, rng: np.random.Generator, depth: int, limit: int, low: float, high: float) -> list[tuple]:
    """Intervals of the value axis with their path length; one-dimensional isolation tree."""
    n = len(values)
    if n <= 1 or depth >= limit or values[0] == values[-1]:
        return [(low, high, depth + _average_path(n))]
    cut = rng.uniform(values[0], values[-1])
    at = int(np.searchsorted(values, cut, side="right"))
    return (_grow(values[:at], rng, depth + 1, limit, low, cut)
            + _grow(values[at:], rng, depth + 1, limit, cut, high))


def _average_path(n: int) -> float:
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (np.log(n - 1) + np.euler_gamma) - 2.0 * (n - 1) / n


def isolation_forest(df: DataFrame, value: str, ids: Sequence[str], trees: int = TREES, rows: int = TREE_ROWS,
                     seed: int = 42) -> DataFrame:
    """The intervals of all trees: ``tree``, ``low``, ``high``, ``path``.

    Every tree draws rows by one hash of tree and row, about twice as many as it needs, and keeps the first ``rows`` of them in hash
    order: the same rule for tables of every size, whatever the partitioning.  A tree is grown in a task of its own.
    """
    present = df.where(F.col(value).isNotNull())
    n = present.count()
    picks = present.select(F.col(value).cast("double").alias("x"), F.xxhash64(*ids, F.lit(seed)).alias("h"))
    range_ = 1_000_000_000
    share = int(min(1.0, 2 * rows / max(n, 1)) * range_) + 1
    drawn = F.filter(F.sequence(F.lit(0).cast("long"), F.lit(trees - 1).cast("long")),
                     lambda t: F.pmod(F.xxhash64(t, "h"), F.lit(range_)) < share)
    picks = picks.select("x", "h", F.explode_outer(drawn).alias("tree")).where("tree is not null")
    w = Window.partitionBy("tree").orderBy(F.xxhash64("h", "tree"), "x")
    picks = picks.withColumn("r", F.row_number().over(w)).where(F.col("r") <= rows).select("tree", "x")

    def grow(group: pd.DataFrame) -> pd.DataFrame:
        tree = int(group["tree"].iloc[0])
        values = np.sort(group["x"].to_numpy(dtype="float64"))
        limit = int(np.ceil(np.log2(max(len(values), 2))))
        leaves = _grow(values, np.random.default_rng([seed, tree]), 0, limit, -np.inf, np.inf)
        out = pd.DataFrame(leaves, columns=["low", "high", "path"])
        out.insert(0, "tree", tree)
        out["sample"] = len(values)
        return out

    return picks.groupBy("tree").applyInPandas(grow, "tree long, low double, high double, path double, sample long")


def forest_steps(forest: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The anomaly score as a step function of the value: cut points and scores between them.

    A forest has at most trees x 2 x rows leaves, whatever the table size.
    """
    leaves = forest.toPandas()
    trees = leaves["tree"].nunique()
    cuts = np.unique(leaves["low"][np.isfinite(leaves["low"])].to_numpy())
    change = np.zeros(len(cuts) + 1)
    for _, tree in leaves.groupby("tree"):
        ordered = tree.sort_values("low")
        change += ordered["path"].to_numpy()[np.searchsorted(ordered["low"].to_numpy()[1:], np.r_[-np.inf, cuts], side="right")]
    norm = _average_path(int(leaves["sample"].max())) if len(leaves) else 1.0
    return cuts, np.power(2.0, -(change / max(trees, 1)) / max(norm, 1e-12))


def isolation_anomalies(df: DataFrame, value: str, ids: Sequence[str], contamination: float = CONTAMINATION, seed: int = 42,
                        exact_rows: int = HELD_VALUES) -> DataFrame:
    """The share ``contamination`` of values that the forest isolates fastest."""
    cuts, scores = forest_steps(isolation_forest(df, value, ids, seed=seed))
    shared = df.sparkSession.sparkContext.broadcast((cuts, scores))

    @F.pandas_udf(T.DoubleType())
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        c, s = shared.value
        for x in batches:
            v = x.to_numpy(dtype="float64")
            yield pd.Series(np.where(np.isnan(v), np.nan, s[np.searchsorted(c, v, side="right")]))

    scored = df.where(F.col(value).isNotNull()).withColumn("_score", score(F.col(value).cast("double")))
    limit = column_quantiles(scored, ["_score"], [1.0 - contamination], exact_rows)["_score"]
    mean = df.agg(F.avg(value)).first()[0]
    s = F.col("_score")
    cut = F.lit(limit[0] if limit else None).cast("double")
    return _result(scored, value, (), ids, F.lit(mean).cast("double"), s, severity_forest(s), "isolation_forest", s > cut)


def detect_anomalies(df: DataFrame, value: str, ids: Sequence[str] = (), method: str = "auto") -> DataFrame:
    if method == "auto":
        row = normality(df, [value]).select(choose_method(F.col("n"), F.col("p_value")).alias("m")).first()
        method = row["m"]
    if method == "zscore":
        return zscore_anomalies(df, value, (), ids)
    if method == "iqr":
        return iqr_anomalies(df, value, (), ids)
    return isolation_anomalies(df, value, ids or df.columns)


def severity_breakdown(anomalies: DataFrame, n_values: Column | int) -> DataFrame:
    """Anomalies per severity, in total and as a share of all values."""
    n = F.lit(n_values) if isinstance(n_values, int) else n_values
    counts = {s: F.count_if(F.col("severity") == s).alias(s) for s in ("low", "medium", "high", "critical")}
    return anomalies.agg(*counts.values(), F.count(F.lit(1)).alias("total")).withColumn(
        "anomaly_rate", F.coalesce(F.try_divide(F.col("total").cast("double"), n), F.lit(0.0)))


def anomaly_scan(tables: Mapping[str, DataFrame], min_values: int = 10, exact_rows: int = HELD_VALUES,
                 columns: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """Every numeric column of every table: method, anomalies, rate and severities; ``columns`` narrows it to some.

    Per table: one aggregation for the moments, one for the quartiles of the columns that need
    them, one to count against the resulting bounds.
    """
    from tablescout.operators.profile import per_column

    frames = []
    for name, df in tables.items():
        chosen = numeric_columns(df) if columns is None else list(columns.get(name, ()))
        if not chosen:
            continue
        moments = per_column(df, chosen, lambda c: {
            "n": F.count(c), "mean": F.avg(c), "std": F.stddev_samp(c), "p_value": F.exp(-jarque_bera(c) / 2)})
        plan = {r["column"]: r for r in moments.withColumn("method", choose_method(F.col("n"), F.col("p_value"))).collect()
                if r["n"] > min_values}
        by_quartile = [c for c, r in plan.items() if r["method"] == "iqr"]
        quartiles = column_quantiles(df, by_quartile, [0.25, 0.5, 0.75], exact_rows, {c: plan[c]["n"] for c in by_quartile})
        if not plan:
            continue

        def metrics(c: str) -> dict[str, Column]:
            x = F.col(c)
            if plan[c]["method"] == "zscore":
                mean, std = plan[c]["mean"], plan[c]["std"]
                score = F.abs(x - F.lit(mean)) / F.nullif(F.lit(float(std or 0.0)), F.lit(0.0))
                hit, severity = score > Z_LIMIT, severity_z(score)
            else:
                q1, median, q3 = (F.lit(v) for v in quartiles[c])
                iqr = q3 - q1
                low, high = q1 - IQR_SPREAD * iqr, q3 + IQR_SPREAD * iqr
                score = F.when(iqr > 0, F.abs(x - median) / iqr).otherwise(0.0)
                hit, severity = (x < low) | (x > high), severity_iqr(x, low, high, iqr)
            return {"method": F.lit(plan[c]["method"]), "n_values": F.count(x), "num_anomalies": F.count_if(hit),
                    **{s: F.count_if(hit & (severity == s)) for s in ("low", "medium", "high", "critical")},
                    "max_score": F.max(F.when(hit, score))}

        frames.append(per_column(df, list(plan), metrics).select(F.lit(name).alias("dataset"), "*"))
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out.withColumn("anomaly_rate", F.try_divide(F.col("num_anomalies").cast("double"), F.col("n_values")))
