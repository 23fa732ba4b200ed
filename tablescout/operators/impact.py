"""Before and after an intervention: difference of means with its uncertainty and validation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablescout.functions import column_quantiles, f_sf, t_ppf, t_two_sided
from tablescout.functions.quantiles import HELD_VALUES
from tablescout.operators.anomaly import NORMAL_P, jarque_bera
from tablescout.operators.validation import confidence_level, confidence_score

MIN_SIDE = 30


def effect_size(d: Column) -> Column:
    d = F.abs(d)
    return F.when(d < 0.2, "negligible").when(d < 0.5, "small").when(d < 0.8, "medium").otherwise("large")


def estimate_impact(df: DataFrame, value: str, is_after: Column, by: Sequence[str] = (), confidence: float = 0.95,
                    alpha: float = 0.05) -> DataFrame:
    """Difference of means after minus before, pooled t-test, interval, Cohen's d and percent change.

    One aggregation gives count, mean and deviation per side, per group if asked.  Groups with fewer
    than two values on a side are left out.
    """
    x = F.col(value).cast("double")
    side = {"before": F.when(~is_after, x), "after": F.when(is_after, x)}
    out = df.groupBy(*by).agg(*[
        agg for s, v in side.items() for agg in (
            F.count(v).alias(f"n_{s}"), F.avg(v).alias(f"{s}_mean"), F.stddev_samp(v).alias(f"{s}_std"),
            F.exp(-jarque_bera(v) / 2).alias(f"{s}_normal_p"))])
    out = out.where("n_before >= 2 and n_after >= 2")
    n1, n2 = F.col("n_before").cast("double"), F.col("n_after").cast("double")
    s1, s2 = F.pow("before_std", F.lit(2)), F.pow("after_std", F.lit(2))
    freedom = n1 + n2 - 2
    pooled = F.sqrt(((n1 - 1) * s1 + (n2 - 1) * s2) / freedom)
    impact = F.col("after_mean") - F.col("before_mean")
    out = out.withColumns({"estimated_impact": impact, "pooled_std": pooled, "freedom": freedom,
                           "se": F.sqrt(s1 / n1 + s2 / n2)})
    error = F.col("pooled_std") * F.sqrt(1 / n1 + 1 / n2)
    out = out.withColumn("t_statistic", F.try_divide("estimated_impact", error))
    out = out.withColumn("p_value", t_two_sided("t_statistic", "freedom"))
    margin = t_ppf(F.lit((1 + confidence) / 2), "freedom") * F.col("se")
    out = out.withColumn("_margin", margin)
    out = out.withColumns({
        "ci_low": F.col("estimated_impact") - F.col("_margin"), "ci_high": F.col("estimated_impact") + F.col("_margin"),
        "is_significant": F.coalesce(F.col("p_value") < alpha, F.lit(False)),
        "cohens_d": F.when(F.col("pooled_std") > 0, F.col("estimated_impact") / F.col("pooled_std")).otherwise(0.0),
        "percent_change": F.coalesce(F.try_divide(F.col("estimated_impact") * 100, F.col("before_mean")), F.lit(0.0))})
    return out.withColumn("effect_size", effect_size(F.col("cohens_d"))).drop("_margin", "pooled_std", "freedom", "se")


def time_split_impact(df: DataFrame, time: str, value: str, intervention: str, by: Sequence[str] = (), **options) -> DataFrame:
    """Before: strictly earlier than the intervention; after: from it on."""
    when = F.lit(intervention).cast(df.schema[time].dataType)
    return estimate_impact(df.where(F.col(time).isNotNull()), value, F.col(time) >= when, by, **options)


def levene(df: DataFrame, value: str, is_after: Column, exact_rows: int = HELD_VALUES) -> DataFrame:
    """Equality of variances of two sides, centred at the medians."""
    x = F.col(value).cast("double")
    sides = df.where(x.isNotNull()).select(F.when(~is_after, x).alias("before"), F.when(is_after, x).alias("after"))
    medians = column_quantiles(sides, ["before", "after"], [0.5], exact_rows)
    z = {s: F.abs(F.col(s) - F.lit(medians[s][0] if medians[s] else None).cast("double")) for s in ("before", "after")}
    out = sides.agg(*[agg for s, v in z.items() for agg in (
        F.count(v).cast("double").alias(f"n_{s}"), F.avg(v).alias(f"m_{s}"), F.var_samp(v).alias(f"v_{s}"))])
    n1, n2 = F.col("n_before"), F.col("n_after")
    grand = (n1 * F.col("m_before") + n2 * F.col("m_after")) / (n1 + n2)
    between = n1 * F.pow(F.col("m_before") - grand, 2) + n2 * F.pow(F.col("m_after") - grand, 2)
    within = (n1 - 1) * F.col("v_before") + (n2 - 1) * F.col("v_after")
    out = out.withColumn("statistic", F.try_divide((n1 + n2 - 2) * between, within))
    out = out.withColumn("p_value", f_sf("statistic", F.lit(1.0), F.col("n_before") + F.col("n_after") - 2))
    return out.select(
        F.col("n_before").cast("long").alias("n_before"), F.col("n_after").cast("long").alias("n_after"), "statistic",
        "p_value", F.coalesce(F.col("p_value") > 0.05, F.lit(False)).alias("equal_variance"))


def validate_impact(impact: DataFrame, equal_variance: Column | None = None) -> DataFrame:
    """Warnings for small sides, values that are not normal and unequal variances, with the score."""
    n1, n2 = F.col("n_before"), F.col("n_after")
    usable = (n1 >= 3) & (n2 >= 3)
    equal = F.lit(True) if equal_variance is None else equal_variance
    warnings = F.filter(F.array(
        F.when(n1 < MIN_SIDE, "before sample is small"), F.when(n2 < MIN_SIDE, "after sample is small"),
        F.when((n1 >= 3) & (F.col("before_normal_p") <= NORMAL_P), "before may not be normal"),
        F.when((n2 >= 3) & (F.col("after_normal_p") <= NORMAL_P), "after may not be normal"),
        F.when(usable & ~equal, "variances may differ")), lambda w: w.isNotNull())
    out = impact.withColumn("_warnings", warnings)
    adequate = (n1 >= MIN_SIDE) & (n2 >= MIN_SIDE)
    score = confidence_score(F.lit(0), F.size("_warnings"), F.least(n1, n2), F.lit(MIN_SIDE), adequate)
    out = out.withColumns({"warnings": F.array_join("_warnings", "; "), "sample_size": n1 + n2, "sample_size_adequate": adequate,
                           "confidence_score": score}).drop("_warnings")
    return out.withColumn("confidence_level", confidence_level(F.col("confidence_score")))
