from __future__ import annotations

from pyspark.sql import functions as F

from tablescout.operators import kpi as K
from tablescout.plans.queries.base import Registry, rounded, tables, union_all

R = Registry()

# Order lines under the column names that the figures ask for.
BUSINESS_SQL = """
SELECT l_orderkey, l_returnflag, CAST(l_shipdate AS DATE) AS ship_date, l_extendedprice * (1 - l_discount) AS revenue,
       p_retailprice * l_quantity AS unit_cost, l_extendedprice * (1 - l_discount) - p_retailprice * l_quantity AS profit,
       p_retailprice * l_quantity * 0.5 AS investment, l_quantity AS clicks, l_quantity * 20 + l_linenumber AS impressions,
       p_retailprice * l_discount AS ad_spend, l_linenumber - 1 AS conversions, l_quantity + l_linenumber AS visits,
       l_extendedprice AS deal_value, l_linenumber AS deals_closed, l_quantity AS opportunities, l_linenumber * 3 AS days,
       l_discount * 100 AS employees_left, l_quantity + 100 AS total_employees, l_quantity * 30 AS tenure_days,
       l_quantity AS actual_output, l_quantity + l_linenumber AS planned_output, l_linenumber AS hours_used, l_quantity AS hours_available
FROM lineitem JOIN part ON l_partkey = p_partkey
"""
BUSINESS = f"WITH b AS ({BUSINESS_SQL})"


def business(spark, d):
    both = tables(spark, d, "lineitem", "part")
    return spark.sql(BUSINESS_SQL.replace("FROM lineitem JOIN part", "FROM {lineitem} JOIN {part}"), **both)


def _ratio(a: str, b: str, scale: str = "") -> str:
    return f"avg(CASE WHEN {b} <> 0 THEN ({a}) / {b} END){scale}"


# Figure: query name, value in SQL, digits.
_FIGURES = {
    "Total Revenue": ("k1_total_revenue", "sum(revenue)", 1),
    "Profit Margin": ("k2_profit_margin", _ratio("revenue - unit_cost", "revenue", " * 100"), 5),
    "ROI": ("k3_roi", _ratio("profit", "investment", " * 100"), 5),
    "Revenue Growth Rate": ("k4_revenue_growth", "(SELECT (arg_max(r, d) - arg_min(r, d)) / arg_min(r, d) * 100 FROM "
                            "(SELECT ship_date AS d, sum(revenue) AS r FROM b GROUP BY 1))", 5),
    "CTR": ("k5_click_through_rate", _ratio("clicks", "impressions", " * 100"), 5),
    "CPA": ("k6_cost_per_acquisition", _ratio("ad_spend", "conversions"), 5),
    "ROAS": ("k7_return_on_ad_spend", _ratio("revenue", "ad_spend"), 5),
    "Conversion Rate": ("k8_conversion_rate", _ratio("conversions", "visits", " * 100"), 5),
    "Average Deal Size": ("k9_average_deal_size", "avg(deal_value)", 4),
    "Win Rate": ("k10_win_rate", _ratio("deals_closed", "opportunities", " * 100"), 5),
    "Sales Velocity": ("k11_sales_velocity", _ratio("revenue", "days"), 4),
    "Attrition Rate": ("k12_attrition_rate", _ratio("employees_left", "total_employees", " * 100"), 5),
    "Average Tenure": ("k13_average_tenure", "avg(tenure_days) / 365", 6),
    "Efficiency Rate": ("k14_efficiency_rate", _ratio("actual_output", "planned_output", " * 100"), 5),
    "Utilization Rate": ("k15_utilization_rate", _ratio("hours_used", "hours_available", " * 100"), 5),
}


def _register(kpi: K.Kpi) -> None:
    name, value, digits = _FIGURES[kpi.name]
    outer = f"SELECT '{kpi.name}' AS name, '{kpi.unit}' AS unit, '{kpi.description}' AS description, round({value}, {digits}) AS value"
    oracle = f"{BUSINESS} {outer}" + ("" if kpi.aggregation == "growth" else " FROM b")

    def query(spark, d):
        df = business(spark, d)
        chosen = [k for k in K.applicable_kpis(df.columns, kpi.domain) if k.name == kpi.name]
        return rounded(K.kpi_report(df, chosen).select("name", "unit", "description", "value"), digits)

    query.__name__ = name
    R.add(oracle)(query)


for _kpi in K.LIBRARY:
    _register(_kpi)


@R.add(f"""{BUSINESS} SELECT round(avg(CASE WHEN revenue <> 0 THEN (revenue - unit_cost) / revenue END) * 100, 5) AS margin,
           round(sum(revenue), 1) AS turnover FROM b""")
def k16_column_mapping(spark, d):
    """Columns whose names say nothing are found by their meaning."""
    df = business(spark, d).select(F.col("revenue").alias("f17"), F.col("unit_cost").alias("f18"))
    meanings = {"f17": "Net revenue of the line", "f18": "Cost of goods"}
    found = K.applicable_kpis(df.columns, "Finance", meanings)
    values = K.kpi_values(df, found)
    return rounded(values.select(F.col("kpi_profit_margin").alias("margin"), F.round("kpi_total_revenue", 1).alias("turnover")), 5)


@R.add(f"""{BUSINESS}, n AS (SELECT count(*) AS n FROM b) SELECT name, unit, n AS n_rows FROM n, (VALUES ('Total Revenue', '$'), ('Profit Margin', '%'),
           ('ROI', '%'), ('Revenue Growth Rate', '%')) v(name, unit)""")
def k17_applicable_kpis(spark, d):
    df = business(spark, d)
    found = K.applicable_kpis(df.columns, "Finance")
    rows = F.array(*[F.struct(F.lit(k.name).alias("name"), F.lit(k.unit).alias("unit")) for k in found])
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.inline(rows), "n_rows")


@R.add(BUSINESS + " " + union_all(
    f"SELECT '{k.name}' AS name, '{k.domain}' AS domain, round({_FIGURES[k.name][1]}, {1 if k.name == 'Total Revenue' else 4}) AS value, '{k.unit}' AS unit"
    + ("" if k.aggregation == "growth" else " FROM b") for k in K.LIBRARY))
def k18_kpi_report(spark, d):
    """All figures of all domains from one pass and one daily grouping."""
    df = business(spark, d)
    out = K.kpi_report(df, K.applicable_kpis(df.columns)).drop("description")
    # A sum of doubles depends on their order in its last digits.
    return out.withColumn("value", F.when(F.col("name") == "Total Revenue", F.round("value", 1)).otherwise(F.round("value", 4)))


@R.add(f"""{BUSINESS} SELECT l_orderkey, round(revenue, 4) AS revenue, round(CASE WHEN conversions <> 0 THEN ad_spend / conversions END, 6) AS kpi_cpa,
           round(clicks / impressions * 100, 6) AS kpi_ctr FROM b""")
def k18_kpi_columns(spark, d):
    df = business(spark, d)
    chosen = [k for k in K.applicable_kpis(df.columns, "Marketing") if k.name in ("CTR", "CPA")]
    return rounded(K.with_kpi_columns(df, chosen).select("l_orderkey", F.round("revenue", 4).alias("revenue"), "kpi_cpa", "kpi_ctr"))


@R.add(f"{BUSINESS} SELECT round(avg(revenue / (unit_cost + ad_spend)), 6) AS value, 'x' AS unit FROM b")
def k19_custom_kpi(spark, d):
    df = business(spark, d)
    kpi = K.custom_kpi("Payback", "try_divide({revenue}, {cost} + {spend})", df.columns, ["revenue", "cost", "spend"], unit="x")
    return rounded(K.kpi_report(df, [kpi]).select("value", "unit"))


@R.add(f"""{BUSINESS} SELECT l_returnflag, strftime(date_trunc('month', ship_date), '%Y-%m') AS month, round(sum(revenue), 4) AS kpi_total_revenue,
           round(avg(CASE WHEN revenue <> 0 THEN (revenue - unit_cost) / revenue END) * 100, 4) AS kpi_profit_margin FROM b GROUP BY 1, 2""")
def k20_kpi_by_period(spark, d):
    df = business(spark, d)
    plain = [k for k in K.applicable_kpis(df.columns, "Finance") if k.name in ("Total Revenue", "Profit Margin")]
    out = K.kpi_values(df, plain, ["l_returnflag", F.date_format("ship_date", "yyyy-MM").alias("month")])
    return rounded(out, 4)


QUERIES, ORACLES = R.queries, R.oracles
