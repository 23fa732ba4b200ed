"""From tables to joined analyses: discover edges, join, analyse, roll up."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescout.functions import numeric_columns, temporal_columns
from tablescout.operators import anomaly, causal, correlate, drivers, forecast, impact, insight, relate, semantics, validation
from tablescout.operators.aggregate import filled_daily_series, top_groups
from tablescout.operators.joins import StarJoin, base_table, star_join
from tablescout.plans import gates
from tablescout.session import durable


@dataclass
class Discovery:
    catalog: DataFrame
    edges: list[dict]
    star: StarJoin | None


def discover(tables: Mapping[str, DataFrame], keys_only: bool = False, threshold: float = relate.CONFIDENCE) -> Discovery:
    """Catalog, accepted edges and the join along them.

    ``keys_only`` profiles nothing but the columns named like keys.
    """
    catalog = durable(semantics.key_catalog(tables) if keys_only else semantics.column_catalog(tables))
    found = relate.detect_relationships(tables, catalog, threshold=threshold)
    edges = [r.asDict() for r in found.orderBy(*relate.PAIR).collect()]
    if not edges:
        return Discovery(catalog, edges, None)
    sizes = {r["dataset"]: r["rows"] for r in catalog.groupBy("dataset").agg(F.max("rows").alias("rows")).collect()}
    return Discovery(catalog, edges, star_join(tables, edges, base_table(edges, sizes)))


def top_customers(tables: Mapping[str, DataFrame], n: int = 10) -> DataFrame:
    """Customers with the highest revenue over the discovered star schema."""
    star = discover(tables, keys_only=True).star
    sales = star.df.select(F.col("customer_c_name").alias("customer"), F.col("region_r_name").alias("region"),
                           (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"))
    return top_groups(sales, ["customer", "region"], "revenue", n)


def analyse_tables(tables: Mapping[str, DataFrame], horizon: int = 7, max_lag: int = 12, most: int | None = None) -> dict[str, DataFrame]:
    """Anomalies, forecasts, causes and categorical drivers of every table, as far as its data can carry them.

    Columns, series and pairs are checked first; what is not valid is not computed, and the results say how far they can be
    relied on.  With ``most``, each table only gets the analyses that suit it best.  ``skipped`` lists what was left out.
    """
    plan = gates.analysis_plan(tables, horizon, max_lag, most)
    results: dict[str, DataFrame] = {}
    if columns := plan.columns(gates.ANOMALY, tables):
        found = anomaly.anomaly_scan({n: tables[n] for n in columns}, columns=columns)
        results["anomaly"] = plan.judged(found, gates.ANOMALY, dataset="dataset", subject="column")
    if columns := plan.columns(gates.FORECAST, tables):
        found = forecast.forecast_all({n: tables[n] for n in columns}, horizon, columns)
        results["forecast"] = plan.judged(found, gates.FORECAST, dataset="dataset", subject="metric", date_column="date_column")
    causes = [causal.all_causes(tables[n], temporal_columns(tables[n])[0], dataset=n, max_lag=max_lag, pairs=gates.pairs_of(subjects))
              for n, subjects in plan.columns(gates.CAUSAL, tables).items()]
    if causes:
        found = reduce(DataFrame.unionByName, causes).withColumn("pair", F.concat_ws(" -> ", "cause", "effect"))
        results["causal"] = plan.judged(found, gates.CAUSAL, dataset="dataset", subject="pair").drop("pair")
    shares = [drivers.categorical_drivers(df, numeric_columns(df)).select(F.lit(name).alias("dataset"), "*")
              for name, df in tables.items() if numeric_columns(df) and len(numeric_columns(df)) < len(df.columns)]
    if shares:
        results["driver"] = reduce(DataFrame.unionByName, shares)
    return {**results, "skipped": plan.skipped(tables)}


def analyse_star(star: StarJoin, intervention: str | None = None) -> dict[str, DataFrame]:
    """Correlations, trends, causes, drivers and impact across the joined tables; causes and drivers only if their data are valid."""
    df, results = star.df, {}
    keys = {c for c in df.columns if semantics.re.search(semantics.KEY_NAME, c)}
    numbers, times = [c for c in numeric_columns(df) if c not in keys], temporal_columns(df)
    if len(numbers) >= 2:
        results["correlation"] = correlate.cross_table_correlations(df, star.lineage, numbers)
    if choice := drivers.cross_table_choice(df, numbers):
        valid, verdict = gates.verdict_columns(validation.validate_regression(df, *choice))
        if valid:
            results["driver"] = drivers.cross_table_drivers(df, numbers).withColumns(verdict)
    if times:
        results["trend"] = correlate.linear_trend(df, times[0], numbers).where("is_significant")
        if pair := causal.cross_table_pair(df, numbers):
            daily = filled_daily_series(df, times[0], pair)
            valid, verdict = gates.verdict_columns(validation.validate_causal(daily, *pair, "day", 5))
            if valid:
                results["causal"] = causal.cross_table_cause(df, times[0], numbers).withColumns(verdict)
        if intervention and numbers:
            results["impact"] = impact.time_split_impact(df, times[0], numbers[0], intervention)
    return results


def report(results: Mapping[str, DataFrame]) -> DataFrame:
    return insight.roll_up(**results)
