"""Whether the data can carry an analysis, and which analyses suit a table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablescout.functions import correlation, numeric_columns, temporal_columns
from tablescout.operators.anomaly import NORMAL_P, jarque_bera
from tablescout.operators.windows import autocorrelation, lagged

MIN_SAMPLE = 30
# MacKinnon's response surface for the 5 % critical value of the Dickey-Fuller test
# with a constant, as published.
DF_CRITICAL = (-2.86154, -2.8903, -4.234, -40.040)


def confidence_score(critical: Column, warnings: Column, n: Column, required: Column, adequate: Column | None = None) -> Column:
    """1 less 0.3 per critical issue and 0.1 per warning, scaled down for short samples, at least 0."""
    score = 1.0 - critical * 0.3 - warnings * 0.1
    enough = (n >= required) if adequate is None else adequate
    return F.greatest(F.lit(0.0), F.when(enough, score).otherwise(score * n / required))


def confidence_level(score: Column) -> Column:
    # The small margin keeps 1 - 0.1 - 0.2 at 0.7 in binary arithmetic.
    s = score + 1e-12
    return (F.when(s >= 0.9, "VERY_HIGH").when(s >= 0.7, "HIGH").when(s >= 0.5, "MEDIUM")
            .when(s >= 0.3, "LOW").otherwise("VERY_LOW"))


def _report(df: DataFrame, n: Column, required: Column, critical: Sequence[Column], warnings: Sequence[Column],
            kept: Sequence[str]) -> DataFrame:
    def listed(items: Sequence[Column]) -> Column:
        return F.filter(F.array(*items), lambda s: s.isNotNull())

    out = df.withColumns({"sample_size": n.cast("long"), "min_required_sample": required.cast("long"),
                          "_critical": listed(critical), "_warnings": listed(warnings)})
    score = confidence_score(F.size("_critical"), F.size("_warnings"), F.col("sample_size"), F.col("min_required_sample"))
    out = out.withColumn("confidence_score", score)
    return out.select(
        *kept, (F.size("_critical") == 0).alias("is_valid"), confidence_level(F.col("confidence_score")).alias("confidence_level"),
        "confidence_score", "sample_size", "min_required_sample",
        (F.col("sample_size") >= F.col("min_required_sample")).alias("sample_size_adequate"),
        F.array_join("_warnings", "; ").alias("warnings"), F.array_join("_critical", "; ").alias("critical_issues"))


def df_critical(n: Column) -> Column:
    a, b, c, d = DF_CRITICAL
    return F.lit(a) + F.lit(b) / n + F.lit(c) / (n * n) + F.lit(d) / (n * n * n)


def stationarity(panel: DataFrame, by: Sequence[str], order: str, value: str = "value") -> DataFrame:
    """Dickey-Fuller regression per series: change on previous level; stationary below the 5 % value."""
    before = lagged(panel, value, by, [order], 1, "_before")
    x = F.col("_before").cast("double")
    change = F.when(x.isNotNull(), F.col(value) - x)
    out = before.groupBy(*by).agg(
        F.regr_slope(change, x).alias("slope"), F.regr_count(change, x).cast("double").alias("n"),
        F.regr_sxx(change, x).alias("_sxx"), F.regr_syy(change, x).alias("_syy"))
    error = (F.col("_syy") - F.col("slope") * F.col("slope") * F.col("_sxx")) / (F.col("n") - 2)
    out = out.withColumn("t_statistic", F.try_divide("slope", F.sqrt(F.try_divide(error, F.col("_sxx")))))
    out = out.withColumn("critical_5pct", df_critical(F.nullif(F.col("n"), F.lit(0.0))))
    return out.withColumn("is_stationary", F.coalesce(F.col("t_statistic") < F.col("critical_5pct"), F.lit(False))).drop("_sxx", "_syy")


def _joined(left: DataFrame, right: DataFrame, by: Sequence[str]) -> DataFrame:
    return left.join(right, list(by), "left")


def validate_forecast(panel: DataFrame, by: Sequence[str], order: str, value: str = "value", horizon: int = 6) -> DataFrame:
    """Length, stationarity, seasonality at lag 12 and missing values of each series."""
    required = max(MIN_SAMPLE, 3 * horizon)
    base = panel.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col(value).isNull().cast("int")).alias("missing_rate"))
    base = _joined(base, stationarity(panel.where(F.col(value).isNotNull()), by, order, value).select(*by, "is_stationary"), by)
    base = _joined(base, autocorrelation(panel, value, by, [order], 12).select(*by, "is_seasonal"), by)
    n = F.col("n")
    base = base.withColumns({"is_seasonal": (n >= 24) & F.col("is_seasonal"), "low_missing": F.col("missing_rate") < 0.1})
    return _report(
        base, n, F.lit(required), [F.when(n < required, F.lit("sample too small"))],
        [F.when(~F.col("is_stationary"), F.lit("not stationary")), F.when(n < 24, F.lit("too short for seasonality")),
         F.when(F.col("missing_rate") > 0.1, F.lit("many missing values"))],
        [*by, "is_stationary", "is_seasonal", "low_missing"])


def validate_causal(daily: DataFrame, cause: str, effect: str, order: str, max_lag: int = 12) -> DataFrame:
    """Length, stationarity of both series, correlation beyond 0.1 and missing values."""
    required = max(MIN_SAMPLE, 5 * max_lag)
    long = daily.select(order, F.inline(F.array(
        F.struct(F.lit("cause").alias("role"), F.col(cause).cast("double").alias("value")),
        F.struct(F.lit("effect").alias("role"), F.col(effect).cast("double").alias("value")))))
    checks = stationarity(long.where("value is not null"), ["role"], order).agg(
        F.bool_or((F.col("role") == "cause") & F.col("is_stationary")).alias("cause_stationary"),
        F.bool_or((F.col("role") == "effect") & F.col("is_stationary")).alias("effect_stationary"))
    base = daily.agg(
        F.least(F.count(cause), F.count(effect)).alias("n"), correlation(F.col(cause).cast("double"), F.col(effect).cast("double")).alias("r"),
        F.avg(F.col(cause).isNull().cast("int")).alias("m1"), F.avg(F.col(effect).isNull().cast("int")).alias("m2"))
    key = F.lit(f"{cause} -> {effect}").alias("pair")
    base = base.select(key, "*").join(checks.select(key, "*"), "pair")
    weak = F.abs("r") < 0.1
    base = base.withColumn("has_correlation", F.coalesce(F.abs("r") > 0.1, F.lit(False)))
    n = F.col("n")
    return _report(
        base, n, F.lit(required), [F.when(n < required, F.lit("sample too small"))],
        [F.when(~F.col("cause_stationary"), F.lit("cause not stationary")),
         F.when(~F.col("effect_stationary"), F.lit("effect not stationary")), F.when(weak, F.lit("very weak correlation")),
         F.when((F.col("m1") > 0.1) | (F.col("m2") > 0.1), F.lit("many missing values"))],
        ["pair", "cause_stationary", "effect_stationary", "has_correlation"])


def validate_causal_pairs(panel: DataFrame, pairs: DataFrame, max_lag: int = 12) -> DataFrame:
    """The checks of ``validate_causal`` for many pairs of daily series at once.

    ``panel``: ``dataset, metric, day, value``; ``pairs``: ``dataset, cause, effect``.
    """
    required = max(MIN_SAMPLE, 5 * max_lag)
    keys = ["dataset", "metric"]
    series = panel.groupBy(*keys).agg(F.count("value").alias("n"), F.avg(F.col("value").isNull().cast("int")).alias("missing"))
    series = _joined(series, stationarity(panel.where("value is not null"), keys, "day").select(*keys, "is_stationary"), keys)

    def side(name: str) -> DataFrame:
        return series.select("dataset", F.col("metric").alias(name), F.col("n").alias(f"{name}_n"), F.col("missing").alias(f"{name}_missing"),
                             F.coalesce("is_stationary", F.lit(False)).alias(f"{name}_stationary"))

    x = panel.select("dataset", F.col("metric").alias("cause"), "day", F.col("value").cast("double").alias("x"))
    y = panel.select("dataset", F.col("metric").alias("effect"), "day", F.col("value").cast("double").alias("y"))
    names = ["dataset", "cause", "effect"]
    together = pairs.join(x, ["dataset", "cause"]).join(y, ["dataset", "effect", "day"]).groupBy(*names).agg(correlation(F.col("x"), F.col("y")).alias("r"))
    base = pairs.join(side("cause"), ["dataset", "cause"]).join(side("effect"), ["dataset", "effect"]).join(together, names, "left")
    base = base.withColumns({"n": F.least("cause_n", "effect_n"), "has_correlation": F.coalesce(F.abs("r") > 0.1, F.lit(False))})
    n = F.col("n")
    return _report(
        base, n, F.lit(required), [F.when(n < required, F.lit("sample too small"))],
        [F.when(~F.col("cause_stationary"), F.lit("cause not stationary")), F.when(~F.col("effect_stationary"), F.lit("effect not stationary")),
         F.when(F.abs("r") < 0.1, F.lit("very weak correlation")),
         F.when((F.col("cause_missing") > 0.1) | (F.col("effect_missing") > 0.1), F.lit("many missing values"))],
        [*names, "cause_stationary", "effect_stationary", "has_correlation"])


def validate_regression(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """Rows per feature, feature pairs correlated beyond 0.9, target variance, missing values."""
    from tablescout.operators.correlate import correlations

    required = max(MIN_SAMPLE, 10 * len(features))
    missing = [F.avg(F.col(f).isNull().cast("int")) for f in features]
    base = df.agg(F.count(F.lit(1)).alias("n"), F.var_samp(target).alias("variance"),
                  F.avg(F.col(target).isNull().cast("int")).alias("target_missing"),
                  (reduce(lambda a, b: a + b, missing) / len(features)).alias("feature_missing"))
    high = correlations(df, features).agg(
        (F.count_if((F.abs("correlation") > 0.9) & (F.abs("correlation") != 1.0)) * 2).alias("collinear"))
    key = F.lit(target).alias("target")
    base = base.select(key, "*").join(high.select(key, "*"), "target")
    base = base.withColumns({"low_multicollinearity": F.col("collinear") == 0,
                             "target_has_variance": F.coalesce(F.col("variance") > 0, F.lit(False))})
    n = F.col("n")
    return _report(
        base, n, F.lit(required),
        [F.when(n < required, F.lit("sample too small")), F.when(F.col("variance") == 0, F.lit("target has no variance"))],
        [F.when(F.col("collinear") > 0, F.concat(F.lit("multicollinearity in "), F.col("collinear").cast("string"), F.lit(" pairs"))),
         F.when(F.col("feature_missing") > 0.1, F.lit("missing feature values")),
         F.when(F.col("target_missing") > 0.1, F.lit("missing target values"))],
        ["target", "low_multicollinearity", "target_has_variance"])


def validate_anomaly(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Length, normality and variance of each numeric column."""
    from tablescout.operators.profile import per_column

    base = per_column(df, columns or numeric_columns(df), lambda c: {
        "n": F.count(c), "std": F.stddev_samp(c), "p": F.exp(-jarque_bera(c) / 2)})
    normal = F.coalesce(F.col("p") > NORMAL_P, F.lit(False))
    base = base.withColumns({"normal_distribution": normal, "has_variance": F.coalesce(F.col("std") > 0, F.lit(False))})
    n = F.col("n")
    return _report(
        base, n, F.lit(MIN_SAMPLE),
        [F.when(n < MIN_SAMPLE, F.lit("sample too small")), F.when(F.col("std") == 0, F.lit("no variance"))],
        [F.when(~F.col("normal_distribution"), F.lit("not normal"))], ["column", "normal_distribution", "has_variance"])


# The analyses with name, kind of data, rows needed, columns needed, value and cost.
ANALYSES = (
    ("time_series_forecast", "Time Series Forecasting", "time_series", 20, "date/time column, numeric metric", "high", "medium"),
    ("anomaly_detection", "Anomaly Detection", "numeric", 30, "numeric columns", "high", "low"),
    ("causal_analysis", "Causal Analysis (Granger)", "time_series", 50, "date column, potential cause, potential effect", "very_high", "high"),
    ("variance_decomposition", "Variance Decomposition", "cross_sectional", 100, "target variable, 3+ feature variables", "high", "medium"),
    ("impact_analysis", "Impact Analysis", "time_series_with_intervention", 40, "date, metric, intervention indicator", "very_high", "medium"),
    ("correlation_analysis", "Correlation Analysis", "numeric", 20, "2+ numeric columns", "medium", "very_low"),
    ("segmentation_analysis", "Segmentation Analysis", "mixed", 50, "multiple features for clustering", "high", "medium"),
    ("trend_analysis", "Trend Analysis", "time_series", 12, "date column, metric", "medium", "low"),
)

# Which analyses are chosen by default: scope, analysis, rows, numeric columns, needs a
# date, priority, reason.
DEFAULT_RULES = (
    ("single_table", "anomaly_detection", 30, 1, False, 1, "Default: Checking for data quality issues"),
    ("single_table", "trend_analysis", 20, 0, True, 2, "Default: Time series data detected"),
    ("single_table", "causal_analysis", 20, 2, True, 1, "Default: Time series with multiple metrics for causal testing"),
    ("cross_table", "correlation_analysis", 0, 2, False, 1, "Default: Multiple numeric columns available"),
    ("cross_table", "causal_analysis", 20, 2, True, 1, "Default: Time series data with multiple metrics for causal testing"),
)


def analysis_catalog(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        ANALYSES, "analysis string, name string, data_type string, min_observations int, columns_needed string, value string, cost string")


def table_shapes(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Rows, numeric columns and date columns of each table."""
    return reduce(DataFrame.unionByName, [
        df.agg(F.count(F.lit(1)).alias("rows")).select(
            F.lit(name).alias("dataset"), "rows", F.lit(len(numeric_columns(df))).alias("numeric_columns"),
            F.lit(len(temporal_columns(df))).alias("date_columns"))
        for name, df in tables.items()])


def select_analyses(tables: Mapping[str, DataFrame], scope: str = "single_table", most: int = 3) -> DataFrame:
    """Default analyses per table by priority, at most ``most`` each."""
    rules = [F.struct(*[F.lit(v).alias(n) for n, v in zip(
        ("scope", "analysis", "min_rows", "min_numeric", "needs_date", "priority", "rationale", "rule"), (*rule, i))])
        for i, rule in enumerate(DEFAULT_RULES)]
    out = table_shapes(tables).select("*", F.inline(F.array(*rules))).where(
        (F.col("scope") == scope) & (F.col("rows") >= F.col("min_rows")) & (F.col("numeric_columns") >= F.col("min_numeric"))
        & (~F.col("needs_date") | (F.col("date_columns") > 0)))
    w = Window.partitionBy("dataset").orderBy("priority", "rule")
    out = out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)
    about = analysis_catalog(out.sparkSession).select("analysis", "name", "value", "cost")
    return out.join(about, "analysis").select("dataset", "rank", "analysis", "name", "priority", "rationale", "value", "cost")


def explain_skipped(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Valuable time-series analyses that a table cannot have, with the reason."""
    wanted = [a for a in ANALYSES if a[5] in ("high", "very_high") and a[2] == "time_series"]
    needs = [F.struct(F.lit(a[0]).alias("analysis"), F.lit(a[1]).alias("name"), F.lit(a[3]).alias("needed")) for a in wanted]
    out = table_shapes(tables).select("*", F.inline(F.array(*needs)))
    reason = (F.when(F.col("date_columns") == 0, "no date column")
              .when(F.col("rows") < F.col("needed"), F.format_string("needs %d observations, has %d", "needed", "rows")))
    return out.withColumn("reason", reason).where("reason is not null").select("dataset", "analysis", "name", "reason")
