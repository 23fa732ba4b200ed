"""Findings in text, rules on findings, and the tables behind charts and reports."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablescout.functions import strip

# What marks a line as a heading of a listing.
HEADING = r"(?i)(Top \d+|by \w+|average|total|breakdown)"

# Topics by the words of a question, first match wins.
TOPICS = (
    ("Performance & Trends", ("trend", "over time", "growth", "change", "increase", "decrease")),
    ("Comparisons & Segmentation", ("compare", "difference", "between", "vs", "across", "by")),
    ("Patterns & Relationships", ("relationship", "correlate", "associate", "pattern", "predict")),
)
OTHER_TOPIC = "Other Findings"

# Words that call for a recommendation, its wording, impact (None: the priority of
# the insight), urgency and the reason given when the insight has no text of its own.  All words of
# one inner tuple must occur; any inner tuple is enough.
RECOMMENDATIONS = (
    ((("high", "value"), ("top", "perform"), ("enterprise",)),
     "Focus on high-value segments identified", None, "Medium", "Target high-value customer segments"),
    ((("decline",), ("decrease",), ("drop",), ("falling",), ("churn",), ("loss",)),
     "Address decline", "High", "High", "Investigate and reverse negative trends"),
    ((("opportunit",), ("grow",), ("increas",), ("expand",), ("potential",)),
     "Capitalize on opportunity", None, "Medium", "Develop growth strategy"),
    ((("risk",), ("anomal",), ("unusual",), ("concern",), ("data quality",), ("integrity",)),
     "Investigate and mitigate", "High", "High", "Monitor and address identified risks"),
    ((("pric",), ("profit",), ("margin",), ("discount",), ("revenue",)),
     "Optimize pricing strategy", None, "Medium", "Review and optimize pricing and profitability"),
    ((("marketing",), ("traffic",), ("customer acquisition",), ("spend",)),
     "Optimize marketing investments", None, "Medium", "Refine marketing and customer acquisition strategy"),
    ((("segment",), ("industry",), ("region",), ("category",), ("group",)),
     "Tailor strategy by segment", None, "Low", "Develop segment-specific strategies"),
)

SEVERITY_RANK = {"critical": 4, "high": 3, "medium": 2, "low": 1}


def text_lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """Lines of each whole text with their number."""
    return df.select(key, F.posexplode(F.split(F.col(text), "\n")).alias("line_no", "line"))


def extract_findings(df: DataFrame, key: str, text: str) -> DataFrame:
    """Lines marked ``FINDING:``, and lines with a dollar or percent sign and a digit."""
    lines = text_lines(df, key, text)
    marked = F.col("line").contains("FINDING:")
    figures = F.col("line").rlike("[$%]") & F.col("line").rlike("[0-9]")
    finding = strip(F.when(marked, F.replace("line", F.lit("FINDING:"), F.lit(""))).otherwise(F.col("line")))
    return lines.where(marked | figures).select(key, "line_no", finding.alias("finding"))


def extract_listings(df: DataFrame, key: str, text: str) -> DataFrame:
    """``label: number`` lines under the last heading before them.

    Lines that are neither heading nor listing are dropped before the shuffle; the window then runs
    over what is left of one text.
    """
    line = F.col("line")
    heading = line.rlike(HEADING)
    parts = F.split(line, "[:|-]")
    number = F.regexp_extract(F.translate(F.element_at(parts, -1), ",", ""), r"[0-9]+\.?[0-9]*", 0)
    lines = text_lines(df, key, text).where(heading | line.rlike("[$%]"))
    marked = lines.select(key, "line_no", heading.alias("is_heading"), strip(line).alias("line"),
                          strip(parts[0]).alias("label"), F.size(parts).alias("parts"), number.try_cast("double").alias("value"))
    w = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    titled = marked.withColumn("title", F.last(F.when(F.col("is_heading"), F.col("line")), ignorenulls=True).over(w))
    return titled.where(~F.col("is_heading") & F.col("title").isNotNull() & (F.col("parts") >= 2)
                        & F.col("value").isNotNull()).select(key, "line_no", "title", "label", "value")


def _mentions(text: Column, alternatives: Sequence[Sequence[str]]) -> Column:
    clauses = [reduce(lambda a, b: a & b, [text.contains(w) for w in words]) for words in alternatives]
    return reduce(lambda a, b: a | b, clauses)


def recommend(insights: DataFrame, key: str, title: str, narrative: str, finding: str | None = None,
              impact: str | None = None, priority: str | None = None) -> DataFrame:
    """Actions that an insight calls for: one row per insight and rule, without a join."""
    parts = [F.coalesce(F.col(c), F.lit("")) for c in (narrative, finding, impact) if c]
    text = F.lower(F.concat_ws(" ", *parts))
    level = F.coalesce(F.col(priority), F.lit("Medium")) if priority else F.lit("Medium")
    said = F.coalesce(*[F.when(p != "", p) for p in parts[:2]], F.lit(None).cast("string"))
    rules = []
    for number, (words, action, fixed, urgency, default) in enumerate(RECOMMENDATIONS, 1):
        rules.append(F.when(_mentions(F.col("_text"), words), F.struct(
            F.lit(number).alias("rule"), F.concat(F.lit(action + ": "), F.col("_title")).alias("action"),
            F.coalesce(F.col("_said"), F.lit(default)).alias("rationale"),
            (F.lit(fixed) if fixed else F.col("_level")).alias("impact"), F.lit(urgency).alias("urgency"))))
    prepared = insights.select(key, text.alias("_text"), said.alias("_said"), level.alias("_level"),
                               F.coalesce(F.col(title).cast("string"), F.lit("Unknown")).alias("_title"))
    return prepared.select(key, F.inline(F.filter(F.array(*rules), lambda s: s.isNotNull())))


def topic(question: Column | str) -> Column:
    text = F.lower(F.col(question) if isinstance(question, str) else question)
    out = None
    for name, words in TOPICS:
        hit = _mentions(text, [(w,) for w in words])
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(OTHER_TOPIC)


def severity_rank(severity: Column | str) -> Column:
    severity = F.col(severity) if isinstance(severity, str) else severity
    out = F.lit(0)
    for name, rank in SEVERITY_RANK.items():
        out = F.when(severity == name, rank).otherwise(out)
    return out


def worst_anomalies(anomalies: DataFrame, ties: Sequence[str], n: int = 5) -> DataFrame:
    """The most severe anomalies, then the highest score."""
    return anomalies.orderBy(F.desc(severity_rank("severity")), F.desc("anomaly_score"), *ties).limit(n)


def chart_rows(df: DataFrame, chart: str, series: Column | str, x: Column | str, y: Column | str) -> DataFrame:
    """Points of a chart as ``chart``, ``series``, ``x``, ``y``; frames of several charts can be united."""
    series = F.lit(series) if isinstance(series, str) else series
    x = F.col(x) if isinstance(x, str) else x
    y = F.col(y) if isinstance(y, str) else y
    return df.select(F.lit(chart).alias("chart"), series.alias("series"), x.cast("string").alias("x"), y.cast("double").alias("y"))


def anomaly_chart(values: DataFrame, anomalies: DataFrame, x: str, value: str) -> DataFrame:
    return chart_rows(values, "anomaly", "Values", x, value).unionByName(
        chart_rows(anomalies, "anomaly", "Anomalies", x, "value"))


def forecast_chart(history: DataFrame, forecast: DataFrame) -> DataFrame:
    """History by day, and forecast with its bounds."""
    out = chart_rows(history, "forecast", "Historical", "day", "value")
    for series, column in (("Forecast", "prediction"), ("Lower Bound", "lower"), ("Upper Bound", "upper")):
        out = out.unionByName(chart_rows(forecast, "forecast", series, "day", column))
    return out


def driver_chart(shares: DataFrame, n: int = 10) -> DataFrame:
    top = shares.orderBy(F.desc("contribution"), "feature").limit(n)
    return chart_rows(top, "drivers", "Contribution to Variance", "feature", "contribution_pct")


def impact_chart(impact: DataFrame) -> DataFrame:
    return chart_rows(impact, "impact", "Average Value", F.lit("Before"), "before_mean").unionByName(
        chart_rows(impact, "impact", "Average Value", F.lit("After"), "after_mean"))


def pair_chart(daily: DataFrame, cause: str, effect: str) -> DataFrame:
    return chart_rows(daily, "causal", cause, "day", cause).unionByName(chart_rows(daily, "causal", effect, "day", effect))


def roll_up(**kinds: DataFrame) -> DataFrame:
    """Results of several analyses in one table, with the analysis they came from."""
    frames = [df.select(F.lit(kind).alias("analysis"), "*") for kind, df in kinds.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def analytics_summary(anomalies: DataFrame, forecasts: DataFrame, causes: DataFrame, drivers: DataFrame) -> DataFrame:
    """How many columns have anomalies, series a forecast, pairs a cause and factors a share over 20 %."""
    hits = [
        anomalies.select(F.lit("anomalies").alias("analysis"), (F.col("num_anomalies") > 0).alias("hit")),
        forecasts.select(F.lit("forecasts").alias("analysis"), F.col("prediction").isNotNull().alias("hit")),
        causes.select(F.lit("relationships").alias("analysis"), F.col("is_significant").alias("hit")),
        drivers.select(F.lit("drivers").alias("analysis"), (F.col("variance_explained") > 0.2).alias("hit")),
    ]
    return reduce(DataFrame.unionByName, hits).groupBy("analysis").agg(F.count_if("hit").alias("n"))


# The wording of the texts below is fixed: stored vectors were made from it.
def dataset_text(domain: str, department: str, description: str, entities: str) -> Column:
    unknown = F.lit("Unknown")
    return F.concat_ws(" | ",
                       F.concat(F.lit("Domain: "), F.coalesce(F.col(domain), unknown)),
                       F.concat(F.lit("Department: "), F.coalesce(F.col(department), unknown)),
                       F.concat(F.lit("Description: "), F.coalesce(F.col(description), F.lit(""))),
                       F.concat(F.lit("Entities: "), F.array_join(entities, ", ")))


def column_text(column: str, semantic_type: str, meaning: str) -> Column:
    return F.format_string("Column: %s | Type: %s | Meaning: %s", F.col(column), F.col(semantic_type), F.col(meaning))


def kpi_text(name: str, domain: str, description: str) -> Column:
    return F.format_string("KPI: %s | Domain: %s | Description: %s", F.col(name), F.col(domain), F.col(description))


def insight_text(domain: str, insight: str) -> Column:
    return F.format_string("Domain: %s | Insight: %s", F.col(domain), F.col(insight))


def schema_text(columns: DataFrame) -> DataFrame:
    """``column:type`` of all columns of a table, in order."""
    return columns.groupBy("dataset").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("position", "column", "type"))),
        lambda s: F.concat_ws(":", s["column"], s["type"])), " ").alias("schema_text"))
