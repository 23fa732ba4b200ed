"""Cleaning that keeps keys intact.

Each step is a lazy transformation; what a step must know about the data (null rates, quartiles,
majority case) comes from one aggregation.  Missing keys stay missing: text conversion never turns
NULL into a word.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablescout.functions import (
    column_quantiles, numeric_columns, parse_date, parse_measure, string_columns, strip, temporal_columns,
)
from tablescout.functions.quantiles import HELD_VALUES, quantile_start
from tablescout.operators.profile import quoted
from tablescout.operators.windows import forward_fill, keep_first
from tablescout.session import durable

SPARSE_PCT = 90.0
FLAG = "_data_quality_flag"
# Words in the meaning of a measure that must not be negative.
NON_NEGATIVE = ("price", "cost", "revenue", "quantity", "count")


@dataclass(frozen=True)
class ColumnMeaning:
    semantic_type: str
    is_primary_key: bool = False
    is_foreign_key: bool = False
    business_meaning: str = ""


Semantics = Mapping[str, ColumnMeaning]


def _typed(df: DataFrame, semantics: Semantics, *kinds: str) -> list[str]:
    return [c for c in df.columns if c in semantics and semantics[c].semantic_type in kinds]


def key_columns(edges: Sequence[Mapping], dataset: str) -> list[str]:
    """Columns of a table on either side of an edge."""
    found = {e["from_column"] for e in edges if e["from_dataset"] == dataset}
    found |= {e["to_column"] for e in edges if e["to_dataset"] == dataset}
    return sorted(found)


def convert_types(df: DataFrame, semantics: Semantics) -> tuple[DataFrame, list[str]]:
    """Dates to timestamps, text measures to numbers, keys to text."""
    strings, times = set(string_columns(df)), set(temporal_columns(df))
    changes: dict[str, Column] = {}
    for c in _typed(df, semantics, "date"):
        if c in strings:
            changes[c] = parse_date(c)
        elif c in times and isinstance(df.schema[c].dataType, T.DateType):
            changes[c] = F.col(c).cast("timestamp_ntz")
    for c in _typed(df, semantics, "measure"):
        if c in strings:
            changes[c] = parse_measure(c)
    for c in _typed(df, semantics, "key"):
        if c not in strings:
            changes[c] = F.col(c).cast("string")
    return df.withColumns(changes) if changes else df, sorted(changes)


def drop_missing_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    present = [k for k in keys if k in df.columns]
    return df.dropna("any", subset=present) if present else df


def null_rates(df: DataFrame) -> dict[str, float]:
    row = df.agg(F.count(F.lit(1)).alias("_rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns]).first()
    return {c: 100.0 * row[c] / row["_rows"] if row["_rows"] else 0.0 for c in df.columns}


def drop_sparse(df: DataFrame, keys: Sequence[str], rates: Mapping[str, float]) -> tuple[DataFrame, list[str]]:
    """Columns more than 90 % empty, except keys."""
    sparse = [c for c in df.columns if c not in keys and rates.get(c, 0.0) > SPARSE_PCT]
    return df.drop(*sparse), sparse


def fill_missing(df: DataFrame, semantics: Semantics, keys: Sequence[str]) -> DataFrame:
    """0 for measures and 'Unknown' for dimensions."""
    measures = [c for c in _typed(df, semantics, "measure") if c not in keys and c in numeric_columns(df)]
    dimensions = [c for c in _typed(df, semantics, "dimension") if c not in keys and c in string_columns(df)]
    out = df.fillna(0, measures) if measures else df
    return out.fillna("Unknown", dimensions) if dimensions else out


def dedup_keys(df: DataFrame, semantics: Semantics, pk_only: bool = False) -> list[str]:
    chosen = [c for c in df.columns if c in semantics and (
        semantics[c].is_primary_key or (not pk_only and semantics[c].semantic_type == "key"))]
    return chosen


def remove_duplicates(df: DataFrame, keys: Sequence[str], order: Sequence[str] | None = None) -> DataFrame:
    """One row per key, the first in order; whole rows when there is no key.

    Without an order every other column breaks ties, so the choice does not depend on file order.
    """
    if not keys:
        return df.dropDuplicates()
    rest = [c for c in df.columns if c not in keys and not isinstance(df.schema[c].dataType, T.MapType)]
    order = list(order or [])
    return keep_first(df, keys, [*order, *[c for c in rest if c not in order]] or list(keys))


def standardise_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    present = [k for k in keys if k in df.columns]
    return df.withColumns({k: strip(F.col(k).cast("string")) for k in present}) if present else df


QUARTILES = (0.25, 0.75)


def outlier_bounds(df: DataFrame, columns: Sequence[str], spread: float = 3.0,
                   exact_rows: int = HELD_VALUES, start: Mapping | None = None) -> dict[str, tuple[float, float]]:
    quartiles = column_quantiles(df, columns, QUARTILES, exact_rows, start=start)
    return {c: (q[0] - spread * (q[1] - q[0]), q[1] + spread * (q[1] - q[0])) for c, q in quartiles.items() if q}


def flag_outliers(df: DataFrame, columns: Sequence[str], bounds: Mapping[str, tuple[float, float]] | None = None,
                  always: bool = False) -> tuple[DataFrame, list[str]]:
    """Add ``{column}_is_outlier`` for columns with values beyond 3 interquartile ranges."""
    bounds = dict(bounds or outlier_bounds(df, columns))
    outside = {c: (F.col(c) < low) | (F.col(c) > high) for c, (low, high) in bounds.items()}
    if not outside:
        return df, []
    if not always:
        row = df.agg(*[F.coalesce(F.bool_or(x), F.lit(False)).alias(c) for c, x in outside.items()]).first()
        outside = {c: x for c, x in outside.items() if row[c]}
    flags = {f"{c}_is_outlier": F.coalesce(x, F.lit(False)) for c, x in outside.items()}
    return (df.withColumns(flags) if flags else df), sorted(outside)


def trim_text(df: DataFrame) -> DataFrame:
    strings = string_columns(df)
    return df.withColumns({c: strip(c) for c in strings}) if strings else df


def case_counts(columns: Sequence[str]) -> list[Column]:
    """Values written all in upper or all in lower case; values without letters count as neither."""
    out = []
    for c in columns:
        text = strip(F.col(quoted(c)))
        letters = F.upper(text) != F.lower(text)
        out += [F.count_if(letters & (text == F.upper(text))).alias(f"{c}__upper"),
                F.count_if(letters & (text == F.lower(text))).alias(f"{c}__lower")]
    return out


def standardise_case(df: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, dict[str, str]]:
    """Bring a dimension to the case that outnumbers the other more than two to one."""
    if not columns:
        return df, {}
    decided = decided_cases(columns, df.agg(*case_counts(columns)).first())
    return in_case(df, decided), decided


def decided_cases(columns: Sequence[str], counts: Mapping) -> dict[str, str]:
    out = {}
    for c in columns:
        upper, lower = counts[f"{c}__upper"], counts[f"{c}__lower"]
        if upper > 2 * lower:
            out[c] = "upper"
        elif lower > 2 * upper:
            out[c] = "lower"
    return out


def in_case(df: DataFrame, cases: Mapping[str, str]) -> DataFrame:
    changes = {c: (F.upper if case == "upper" else F.lower)(F.col(quoted(c))) for c, case in cases.items()}
    return df.withColumns(changes) if changes else df


def check_counts(df: DataFrame, semantics: Semantics) -> list[tuple[str, str, str, Column]]:
    """Severity, column, problem and the aggregate that counts it, for every check of a table."""
    numeric = set(numeric_columns(df))
    checks = []
    for c in df.columns:
        meaning = semantics.get(c)
        if meaning is None:
            continue
        if meaning.is_primary_key or meaning.is_foreign_key:
            checks.append(("issue", c, "missing key", F.count_if(F.col(quoted(c)).isNull())))
        words = meaning.business_meaning.lower()
        if meaning.semantic_type == "measure" and c in numeric and any(w in words for w in NON_NEGATIVE):
            checks.append(("warning", c, "negative value", F.count_if(F.col(quoted(c)) < 0)))
    return checks


def quality_checks(df: DataFrame, semantics: Semantics) -> DataFrame:
    """Missing keys and negative values where a measure cannot be negative: one row per check."""
    checks = check_counts(df, semantics)
    if not checks:
        return df.sparkSession.createDataFrame([], "severity string, column string, problem string, n long")
    wide = df.agg(*[n.alias(f"n{i}") for i, (_, _, _, n) in enumerate(checks)])
    rows = [F.struct(F.lit(s).alias("severity"), F.lit(c).alias("column"), F.lit(p).alias("problem"), F.col(f"n{i}").alias("n"))
            for i, (s, c, p, _) in enumerate(checks)]
    return wide.select(F.inline(F.array(*rows)))


def quality_flag(checks: Sequence[Mapping]) -> Column:
    bad = any(r["severity"] == "issue" and r["n"] > 0 for r in checks)
    return F.lit("has_issues" if bad else "clean")


@dataclass
class CleaningReport:
    """What each step did; ``frame`` turns it into rows."""

    steps: list[tuple[str, str, int, str]] = field(default_factory=list)

    def add(self, step: str, measure: str, n: int, detail: str = "") -> None:
        self.steps.append((step, measure, int(n), detail))

    def frame(self, spark) -> DataFrame:
        return spark.createDataFrame(self.steps, "step string, measure string, n long, detail string")


def clean_table(df: DataFrame, semantics: Semantics, edges: Sequence[Mapping] = (), dataset: str = "",
                order: Sequence[str] | None = None, pk_only: bool = False) -> tuple[DataFrame, CleaningReport]:
    """All steps in order: types, missing values, duplicates, keys, outliers, text, checks.

    The table is read once for its missing values and written once, after the duplicates are gone.  What the later steps must
    know (rows left, case of texts, ranges, check counts, sketches of the measures) is observed by that one write; only
    the exact quartiles look at the measures once more.
    """
    report = CleaningReport()
    keys = key_columns(edges, dataset)
    out, converted = convert_types(df, semantics)
    report.add("type_conversion", "columns_converted", len(converted), ", ".join(converted))

    kept = drop_missing_keys(out, keys)
    whole = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys if k in out.columns], F.lit(True))
    stats = out.agg(F.count(F.lit(1)).alias("_all"), F.count_if(whole).alias("_rows"),
                    *[F.count_if(whole & F.col(c).isNull()).alias(c) for c in out.columns]).first()
    rates = {c: 100.0 * stats[c] / stats["_rows"] if stats["_rows"] else 0.0 for c in out.columns}
    report.add("missing_values", "rows_removed", stats["_all"] - stats["_rows"], ", ".join(keys))
    kept, sparse = drop_sparse(kept, keys, rates)
    report.add("missing_values", "columns_dropped", len(sparse), ", ".join(sparse))
    filled = [c for c in _typed(kept, semantics, "measure", "dimension", "date") if c not in keys and rates[c] > 0]
    report.add("missing_values", "columns_filled", len(filled), ", ".join(filled))
    kept = fill_missing(kept, semantics, keys)
    dates = [c for c in _typed(kept, semantics, "date") if c in filled]
    if dates and order:
        kept = forward_fill(kept, dates, [], list(order))

    unique = dedup_keys(kept, semantics, pk_only)
    single = remove_duplicates(kept, unique, order)
    measures = [c for c in _typed(single, semantics, "measure") if c in numeric_columns(single) and c not in keys]
    dimensions = [c for c in _typed(single, semantics, "dimension") if c in string_columns(single) or c in keys]
    counted = check_counts(standardise_keys(single, keys), semantics)
    seen = Observation()
    ranges = [f for c in measures for f in (F.min(F.col(quoted(c)).cast("double")).alias(f"low_{c}"), F.max(F.col(quoted(c)).cast("double")).alias(f"high_{c}"))]
    deduped = durable(standardise_keys(single, keys).observe(
        seen, F.count(F.lit(1)).alias("_rows"), *case_counts(dimensions), *ranges, *quantile_start(measures, QUARTILES),
        *[n.alias(f"check_{i}") for i, (_, _, _, n) in enumerate(counted)]))
    known = seen.get
    report.add("remove_duplicates", "rows_removed", stats["_rows"] - known["_rows"], ", ".join(unique) or "all columns")

    out = deduped
    report.add("standardise_keys", "columns_standardised", len([k for k in keys if k in out.columns]), ", ".join(keys))
    bounds = outlier_bounds(out, measures, start=known) if measures else {}
    bounds = {c: (low, high) for c, (low, high) in bounds.items() if known[f"low_{c}"] < low or known[f"high_{c}"] > high}
    out, flagged = flag_outliers(out, measures, bounds, always=True) if bounds else (out, [])
    report.add("handle_outliers", "columns_flagged", len(flagged), ", ".join(flagged))
    out = trim_text(out)
    cases = decided_cases(dimensions, known)
    out = in_case(out, cases)
    report.add("standardise_formats", "columns_standardised", len(cases),
               ", ".join(f"{c}:{case}" for c, case in sorted(cases.items())))
    checks = [{"severity": s, "column": c, "problem": p, "n": known[f"check_{i}"]} for i, (s, c, p, _) in enumerate(counted)]
    for r in checks:
        if r["n"]:
            report.add("data_validation", f"{r['severity']}: {r['problem']}", r["n"], r["column"])
    return out.withColumn(FLAG, quality_flag(checks)), report


def semantics_from_catalog(catalog: DataFrame, dataset: str) -> dict[str, ColumnMeaning]:
    rows = catalog.where(F.col("dataset") == dataset).select(
        "column", "semantic_type", "is_primary_key", "is_foreign_key").collect()
    return {r["column"]: ColumnMeaning(r["semantic_type"], r["is_primary_key"], r["is_foreign_key"],
                                       r["column"].replace("_", " ")) for r in rows}
