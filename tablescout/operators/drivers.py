"""What drives a figure: linear shares, forest shares, categorical shares, segments."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescout.functions import correlation, numeric_columns, string_columns
from tablescout.operators.causal import EFFECT_WORDS
from tablescout.operators.profile import quoted

MAX_LEVELS = 20
#: What the rows of one task may take while a forest is grown; a partition above it is dealt anew.
TASK_BYTES = 256 << 20


def linear_drivers(df: DataFrame, features: Sequence[str], target: str, missing_as_zero: bool = False) -> DataFrame:
    """Squared standardised coefficients as shares, with sign, a +-10 % interval and R squared.

    One aggregation gives all covariances; the small system of equations is solved on that one row.
    """
    features = list(features)
    names = [*features, target]
    x = df.select(*[F.col(c).cast("double").alias(c) for c in names])
    x = x.fillna(0.0) if missing_as_zero else x.dropna()
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    moments = x.agg(F.count(F.lit(1)).alias("n"), F.array(*[
        F.covar_pop(names[i], names[j]) for i, j in pairs]).alias("moments"))

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for n, values in zip(batch["n"], batch["moments"]):
                if n == 0:
                    continue
                cov = np.zeros((len(names), len(names)))
                for (i, j), v in zip(pairs, values):
                    cov[i, j] = cov[j, i] = v
                scale = np.sqrt(np.diag(cov))
                inner = np.where(scale[:-1] > 0, scale[:-1], 1.0)
                gram = cov[:-1, :-1] / np.outer(inner, inner)
                coef = np.linalg.lstsq(gram, cov[:-1, -1] / inner, rcond=None)[0]
                total = float((coef ** 2).sum()) or 1.0
                explained = float(coef @ (cov[:-1, -1] / inner)) / cov[-1, -1] if cov[-1, -1] > 0 else 0.0
                share = coef ** 2 / total
                yield pd.DataFrame({
                    "feature": features, "coefficient": coef, "contribution": share, "contribution_pct": share * 100,
                    "is_positive": coef > 0, "ci_low": share * 0.9, "ci_high": share * 1.1,
                    "r_squared": min(1.0, max(0.0, explained)), "n": n})

    return moments.mapInPandas(
        solve, "feature string, coefficient double, contribution double, contribution_pct double, is_positive boolean, "
               "ci_low double, ci_high double, r_squared double, n long")


def forest_drivers(df: DataFrame, features: Sequence[str], target: str, trees: int = 50, depth: int = 5, seed: int = 42) -> DataFrame:
    """Importance shares of a random forest over all rows; the sign is that of the correlation.

    While it grows, Spark holds for every row how often each tree draws it, which is many times what the row takes in
    its file, so one part of a file can be too much for a task: rows are then spread evenly over more tasks.
    """
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import RandomForestRegressor

    features = list(features)
    x = df.select(*[F.col(c).cast("double").alias(c) for c in [*features, target]]).dropna()
    most = max(1, TASK_BYTES // (100 + 4 * (trees + len(features))))
    largest, n = x.groupBy(F.spark_partition_id()).count().agg(F.max("count"), F.sum("count")).first()
    spread = x.repartition(-(-n // most)) if (largest or 0) > most else x
    rows = VectorAssembler(inputCols=features, outputCol="_x").transform(spread)
    model = RandomForestRegressor(featuresCol="_x", labelCol=target, numTrees=trees, maxDepth=depth, seed=seed).fit(rows)
    importance = model.featureImportances.toArray()
    total = float(importance.sum()) or 1.0
    signs = x.agg(*[correlation(F.col(f), F.col(target)).alias(f) for f in features]).first()
    out = [(f, float(v / total), float(v / total * 100), bool((signs[f] or 0.0) > 0), float(v / total * 0.9), float(v / total * 1.1))
           for f, v in zip(features, importance)]
    return df.sparkSession.createDataFrame(
        out, "feature string, contribution double, contribution_pct double, is_positive boolean, ci_low double, ci_high double")


def driver_shares(df: DataFrame, features: Sequence[str], target: str, method: str = "auto") -> DataFrame:
    """Forest shares for 30 or more rows and up to 20 features, else linear shares."""
    if method == "auto":
        enough = df.limit(30).count() >= 30
        method = "forest" if enough and len(features) <= 20 else "linear"
    return forest_drivers(df, features, target) if method == "forest" else linear_drivers(df, features, target)


def top_drivers(shares: DataFrame, n: int = 3) -> DataFrame:
    """The ``n`` largest shares with their total in percent."""
    top = shares.orderBy(F.desc("contribution"), "feature").limit(n)
    return top.agg(F.array_join(F.transform(
        F.reverse(F.array_sort(F.collect_list(F.struct("contribution", "feature")))), lambda s: s["feature"]), ", ").alias("features"),
        F.sum("contribution_pct").alias("total_pct"))


def categorical_drivers(df: DataFrame, metrics: Sequence[str] | None = None, categories: Sequence[str] | None = None,
                        max_levels: int = MAX_LEVELS, min_rows: int = 10) -> DataFrame:
    """Share of the variance of each metric that lies between the levels of each category.

    One scan serves all metrics and categories.  Categories with clearly too many levels are
    dropped by an estimate before any grouping; the exact limit is applied afterwards.
    """
    metrics = list(metrics or numeric_columns(df))
    categories = list(categories or string_columns(df))
    guess = df.agg(*[F.approx_count_distinct(quoted(c)) for c in categories]).first() if categories else ()
    categories = [c for c, levels in zip(categories, guess) if levels < 2 * max_levels]
    schema = "metric string, factor string, levels long, n long, variance_explained double"
    if not categories:
        return df.sparkSession.createDataFrame([], schema)
    aggs = []
    for i, m in enumerate(metrics):
        x = F.col(f"`{m}`").cast("double")
        aggs += [F.count(x).alias(f"n{i}"), F.avg(x).alias(f"m{i}"), F.var_pop(x).alias(f"v{i}")]
    # One scan and one grouping by (factor, level); any number of factors.
    pairs = F.array(*[F.struct(F.lit(c).alias("factor"), F.col(f"`{c}`").cast("string").alias("level")) for c in categories])
    levels = (df.select(F.inline(pairs), *[F.col(f"`{m}`") for m in metrics]).where("level is not null")
              .groupBy("factor", "level").agg(*aggs))
    cells = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"n{i}").alias("n"), F.col(f"m{i}").alias("mean"),
                               F.col(f"v{i}").alias("var")) for i, m in enumerate(metrics)])
    cells = levels.select("factor", F.inline(cells)).where("n > 0")
    n = F.col("n").cast("double")
    totals = cells.groupBy("metric", "factor").agg(
        F.count(F.lit(1)).alias("levels"), F.sum("n").alias("n"), (F.sum(n * F.col("mean")) / F.sum(n)).alias("grand"),
        F.sum(n * F.col("var")).alias("within"), F.collect_list(F.struct(n.alias("n"), "mean")).alias("parts"))
    # The estimate above keeps the list of levels short.
    between = F.aggregate("parts", F.lit(0.0), lambda total, p: total + p["n"] * F.pow(p["mean"] - F.col("grand"), F.lit(2.0)))
    out = totals.withColumn("between", between).where((F.col("levels") < max_levels) & (F.col("n") > min_rows))
    return out.select("metric", "factor", "levels", "n",
                      F.try_divide("between", F.col("between") + F.col("within")).alias("variance_explained"))


def cross_table_choice(joined: DataFrame, columns: Sequence[str] | None = None) -> tuple[list[str], str] | None:
    """The first five other numbers, and the first revenue, sales, profit or value; None without enough of them."""
    columns = list(columns or numeric_columns(joined))
    targets = [c for c in columns if any(w in c.lower() for w in EFFECT_WORDS)]
    features = [c for c in columns if c not in targets[:1]][:5]
    return (features, targets[0]) if targets and len(features) >= 3 else None


def cross_table_drivers(joined: DataFrame, columns: Sequence[str] | None = None) -> DataFrame | None:
    """Linear shares of the first five other numbers in the first revenue, sales, profit or value."""
    choice = cross_table_choice(joined, columns)
    return None if choice is None else linear_drivers(joined, *choice, missing_as_zero=True).where("n >= 30")


def segment(df: DataFrame, features: Sequence[str], k: int = 4, seed: int = 42) -> DataFrame:
    """Rows with the number of their k-means segment over standardised features."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    rows = VectorAssembler(inputCols=list(features), outputCol="_raw", handleInvalid="skip").transform(df)
    scaled = StandardScaler(inputCol="_raw", outputCol="_scaled", withMean=True).fit(rows).transform(rows)
    model = KMeans(featuresCol="_scaled", predictionCol="segment", k=k, seed=seed).fit(scaled)
    return model.transform(scaled).drop("_raw", "_scaled")


def segment_profile(segmented: DataFrame, features: Sequence[str]) -> DataFrame:
    return segmented.groupBy("segment").agg(F.count(F.lit(1)).alias("n"), *[F.avg(f).alias(f"mean_{f}") for f in features])
