"""What each table can carry, decided before the heavy work: selected analyses, valid columns, series and pairs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescout.functions import numeric_columns, temporal_columns
from tablescout.operators import forecast, validation
from tablescout.session import durable

VERDICT = ("is_valid", "confidence_level", "confidence_score", "sample_size", "min_required_sample", "warnings", "critical_issues")
#: Analyses that run column by column here, and their names in the list of analyses.
ANOMALY, FORECAST, CAUSAL = "anomaly_detection", "time_series_forecast", "causal_analysis"
NOT_SELECTED = "not among the selected analyses"


@dataclass
class Plan:
    """``checks``: a verdict per analysis and subject; ``valid`` and ``selected`` say what is worth running."""

    checks: DataFrame
    valid: dict[tuple[str, str], list[str]]
    selected: set[tuple[str, str]] | None

    def runs(self, analysis: str, dataset: str) -> bool:
        return self.selected is None or (dataset, analysis) in self.selected

    def columns(self, analysis: str, tables: Mapping[str, DataFrame]) -> dict[str, list[str]]:
        """Valid subjects of an analysis by table, of the tables that it is selected for."""
        return {n: self.valid[analysis, n] for n in tables if self.valid.get((analysis, n)) and self.runs(analysis, n)}

    def judged(self, results: DataFrame, analysis: str, **keys: str) -> DataFrame:
        """Results with the verdict on their subject; ``keys`` name the result's columns of ``dataset``, ``subject``, ``date_column``."""
        mine = self.checks.where(F.col("analysis") == analysis).where("is_valid").select(
            *[F.col(k).alias(v) for k, v in keys.items()], "is_valid", "confidence_level", F.col("warnings").alias("check_warnings"))
        return results.join(mine, list(keys.values()))

    def skipped(self, tables: Mapping[str, DataFrame]) -> DataFrame:
        """Subjects and whole analyses that were left out, with the reason."""
        invalid = self.checks.where("NOT is_valid").select("analysis", "dataset", "subject", F.col("critical_issues").alias("reason"))
        never = validation.explain_skipped(tables).select("analysis", "dataset", F.lit("*").alias("subject"), "reason")
        out = invalid.unionByName(never)
        if self.selected is not None:
            rest = [(a, n, "*", NOT_SELECTED) for n in tables for a in (ANOMALY, FORECAST, CAUSAL) if (n, a) not in self.selected]
            out = out.unionByName(out.sparkSession.createDataFrame(rest, "analysis string, dataset string, subject string, reason string"))
        return out.distinct().withColumnRenamed("analysis", "skipped_analysis")


def anomaly_checks(tables: Mapping[str, DataFrame]) -> list[DataFrame]:
    return [validation.validate_anomaly(df).select(
        F.lit(ANOMALY).alias("analysis"), F.lit(name).alias("dataset"), F.col("column").alias("subject"), F.lit("").alias("date_column"), *VERDICT)
        for name, df in tables.items() if numeric_columns(df)]


def series_checks(panel: DataFrame, horizon: int) -> DataFrame:
    return validation.validate_forecast(panel, ["dataset", "date_column", "metric"], "day", horizon=horizon).select(
        F.lit(FORECAST).alias("analysis"), "dataset", F.col("metric").alias("subject"), "date_column", *VERDICT)


def pair_checks(panel: DataFrame, pairs: DataFrame, max_lag: int) -> DataFrame:
    return validation.validate_causal_pairs(panel, pairs, max_lag).select(
        F.lit(CAUSAL).alias("analysis"), "dataset", F.concat_ws(" -> ", "cause", "effect").alias("subject"), F.lit("").alias("date_column"), *VERDICT)


def analysis_plan(tables: Mapping[str, DataFrame], horizon: int = 7, max_lag: int = 12, most: int | None = None) -> Plan:
    """Verdicts for all columns, daily series and pairs of series; with ``most``, also which analyses each table gets.

    One aggregate per table, and the daily sums that the forecasts start from; both are small next to what they save.
    """
    checks = anomaly_checks(tables)
    dated = {n: df for n, df in tables.items() if temporal_columns(df) and numeric_columns(df)}
    if dated:
        panel = durable(forecast.metric_panel(dated))
        checks.append(series_checks(panel, horizon))
        first = {n: temporal_columns(df)[0] for n, df in dated.items()}
        pairs = [(n, a, b) for n, df in dated.items() for a, b in combinations(numeric_columns(df), 2)]
        if pairs:
            own = reduce(lambda x, y: x | y, [(F.col("dataset") == n) & (F.col("date_column") == d) for n, d in first.items()])
            checks.append(pair_checks(panel.where(own), panel.sparkSession.createDataFrame(pairs, "dataset string, cause string, effect string"), max_lag))
    frame = durable(reduce(DataFrame.unionByName, checks))
    valid: dict[tuple[str, str], list[str]] = {}
    for r in frame.where("is_valid").select("analysis", "dataset", "subject").distinct().orderBy("subject").collect():  # a row per column, series or pair
        valid.setdefault((r.analysis, r.dataset), []).append(r.subject)
    selected = None
    if most is not None:
        chosen = validation.select_analyses(tables, most=most).select("dataset", "analysis").collect()
        selected = {(r.dataset, r.analysis) for r in chosen}
    return Plan(frame, valid, selected)


def verdict_columns(check: DataFrame) -> tuple[bool, dict]:
    """Whether a single check passes, and its verdict as columns for the results of its analysis."""
    row = check.first()
    return row.is_valid, {"is_valid": F.lit(row.is_valid), "confidence_level": F.lit(row.confidence_level), "check_warnings": F.lit(row.warnings)}


def pairs_of(subjects: Sequence[str]) -> list[tuple[str, str]]:
    return [tuple(s.split(" -> ", 1)) for s in subjects]
