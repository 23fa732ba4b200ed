"""Business figures as Spark SQL expressions, mapped to the columns a table has."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Kpi:
    """``formula`` is a Spark SQL expression per row over ``{placeholder}`` names.

    ``aggregation``: ``mean`` or ``sum`` of the row values, or ``growth`` between the totals of the
    first and last date.  The result is multiplied by ``scale``.
    """

    name: str
    domain: str
    requires: tuple[str, ...]
    formula: str
    aggregation: str
    unit: str
    description: str
    scale: float = 1.0
    mapping: Mapping[str, str] = field(default_factory=dict)

    @property
    def column(self) -> str:
        return "kpi_" + self.name.lower().replace(" ", "_")

    def row_value(self) -> Column:
        quoted = {k: f"`{v}`" for k, v in self.mapping.items()}
        return F.expr(self.formula.format(**quoted)).cast("double")


# Names, required columns, units and descriptions of the figures.
LIBRARY = (
    Kpi("Total Revenue", "Finance", ("revenue",), "{revenue}", "sum", "$", "Total revenue generated"),
    Kpi("Profit Margin", "Finance", ("revenue", "cost"), "try_divide({revenue} - {cost}, {revenue}) * 100",
        "mean", "%", "Percentage of revenue retained as profit"),
    Kpi("ROI", "Finance", ("profit", "investment"), "try_divide({profit}, {investment}) * 100",
        "mean", "%", "Return on investment percentage"),
    Kpi("Revenue Growth Rate", "Finance", ("revenue", "date"), "{revenue}",
        "growth", "%", "Period-over-period revenue growth"),
    Kpi("CTR", "Marketing", ("clicks", "impressions"), "try_divide({clicks}, {impressions}) * 100",
        "mean", "%", "Click-through rate"),
    Kpi("CPA", "Marketing", ("ad_spend", "conversions"), "try_divide({ad_spend}, {conversions})",
        "mean", "$", "Cost per acquisition"),
    Kpi("ROAS", "Marketing", ("revenue", "ad_spend"), "try_divide({revenue}, {ad_spend})",
        "mean", "x", "Return on ad spend"),
    Kpi("Conversion Rate", "Marketing", ("conversions", "visits"), "try_divide({conversions}, {visits}) * 100",
        "mean", "%", "Percentage of visits that convert"),
    Kpi("Average Deal Size", "Sales", ("deal_value",), "{deal_value}",
        "mean", "$", "Average value of closed deals"),
    Kpi("Win Rate", "Sales", ("deals_closed", "opportunities"), "try_divide({deals_closed}, {opportunities}) * 100",
        "mean", "%", "Percentage of opportunities converted"),
    Kpi("Sales Velocity", "Sales", ("revenue", "days"), "try_divide({revenue}, {days})",
        "mean", "$/day", "Revenue generated per day"),
    Kpi("Attrition Rate", "HR", ("employees_left", "total_employees"),
        "try_divide({employees_left}, {total_employees}) * 100", "mean", "%", "Employee turnover percentage"),
    Kpi("Average Tenure", "HR", ("tenure_days",), "{tenure_days}",
        "mean", "years", "Average employee tenure in years", 1 / 365),
    Kpi("Efficiency Rate", "Operations", ("actual_output", "planned_output"),
        "try_divide({actual_output}, {planned_output}) * 100", "mean", "%", "Operational efficiency percentage"),
    Kpi("Utilization Rate", "Operations", ("hours_used", "hours_available"),
        "try_divide({hours_used}, {hours_available}) * 100", "mean", "%", "Resource utilization percentage"),
)


def map_columns(columns: Sequence[str], required: Sequence[str], meanings: Mapping[str, str] | None = None) -> dict[str, str] | None:
    """Placeholder to column: the first column whose name contains it, else whose meaning does."""
    found = {}
    for name in required:
        by_name = (c for c in columns if name.lower() in c.lower())
        by_meaning = (c for c, text in (meanings or {}).items() if c in columns and name.lower() in text.lower())
        hit = next(by_name, None) or next(by_meaning, None)
        if hit is None:
            return None
        found[name] = hit
    return found


def applicable_kpis(columns: Sequence[str], domain: str | None = None, meanings: Mapping[str, str] | None = None,
                    library: Sequence[Kpi] = LIBRARY) -> list[Kpi]:
    """Figures of a domain whose required columns can all be mapped."""
    out = []
    for kpi in library:
        if domain is None or kpi.domain == domain:
            mapping = map_columns(columns, kpi.requires, meanings)
            if mapping is not None:
                out.append(replace(kpi, mapping=mapping))
    return out


def custom_kpi(name: str, formula: str, columns: Sequence[str], required: Sequence[str], aggregation: str = "mean",
               unit: str = "", description: str = "", domain: str = "Custom",
               meanings: Mapping[str, str] | None = None) -> Kpi | None:
    """A user-defined figure: a Spark SQL expression over ``{placeholder}`` names."""
    mapping = map_columns(columns, required, meanings)
    if mapping is None:
        return None
    return Kpi(name, domain, tuple(required), formula, aggregation, unit, description, mapping=mapping)


def with_kpi_columns(df: DataFrame, kpis: Sequence[Kpi]) -> DataFrame:
    """Row-level values as ``kpi_*`` columns."""
    return df.withColumns({k.column: k.row_value() for k in kpis})


def _plain(kpi: Kpi) -> Column:
    value = kpi.row_value()
    return (F.sum(value) if kpi.aggregation == "sum" else F.avg(value)) * kpi.scale


def kpi_values(df: DataFrame, kpis: Sequence[Kpi], by: Sequence[str | Column] = ()) -> DataFrame:
    """All figures of a table in one pass, one column per figure, per group if asked."""
    return df.groupBy(*by).agg(*[_plain(k).alias(k.column) for k in kpis])


def growth(df: DataFrame, kpi: Kpi, by: Sequence[str] = ()) -> DataFrame:
    """Percent change from the first to the last date's total; 0 when the first is not positive."""
    date = kpi.mapping["date"]
    days = (df.where(F.col(date).isNotNull()).groupBy(*by, F.col(date).alias("_date"))
            .agg(F.sum(kpi.row_value()).alias("_total")))
    first, last = F.min_by("_total", "_date"), F.max_by("_total", "_date")
    rate = F.when(first > 0, (last - first) / first * 100).otherwise(F.lit(0.0))
    return days.groupBy(*by).agg(rate.alias(kpi.column))


def kpi_report(df: DataFrame, kpis: Sequence[Kpi]) -> DataFrame:
    """``name``, ``domain``, ``value``, ``unit``, ``description`` of every figure; 0 when undefined."""
    plain = [k for k in kpis if k.aggregation != "growth"]
    frames = [(kpi_values(df, plain), plain)] if plain else []
    frames += [(growth(df, k), [k]) for k in kpis if k.aggregation == "growth"]
    out = None
    for wide, members in frames:
        rows = F.array(*[F.struct(
            F.lit(k.name).alias("name"), F.lit(k.domain).alias("domain"),
            F.coalesce(F.col(k.column), F.lit(0.0)).alias("value"), F.lit(k.unit).alias("unit"),
            F.lit(k.description).alias("description")) for k in members])
        part = wide.select(F.inline(rows))
        out = part if out is None else out.unionByName(part)
    return out


def definitions(spark, library: Sequence[Kpi] = LIBRARY) -> DataFrame:
    rows = [(k.name, k.domain, k.formula, k.aggregation, k.unit, k.description, ", ".join(k.requires)) for k in library]
    return spark.createDataFrame(
        rows, "name string, domain string, formula string, aggregation string, unit string, description string, requires string")
