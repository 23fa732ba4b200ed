"""What columns mean: semantic types, key candidates, what a table can be used for."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablescout.functions import numeric_columns, string_columns, temporal_columns
from tablescout.operators.profile import (
    TEXT_LENGTH, comparable_columns, declared_kind, exact_distinct, literal, per_column, quoted, sample_confidence, temporal_granularity, top_values,
)

# Name endings that mark a column to join on.
JOIN_SUFFIXES = ("_id", "_code", "_key", "id")

# Column names that describe the same thing in many tables.
COMMON_DIMENSIONS = (
    "date", "region", "country", "state", "city", "category", "type", "status", "department",
    "product_category", "customer_segment",
)

# Words in a column name that mark a headline figure.
KEY_METRIC_WORDS = ("revenue", "sales", "profit", "cost", "price", "value")

# Names of identifiers; Python and Spark read the pattern alike.
KEY_NAME = r"(?i:(^|_)(id|key|code)$|key$)|[a-z](Id|ID)$"


def _all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def semantic_type(kind: Column, name: Column) -> Column:
    return (F.when(kind == "datetime", "date").when(kind == "text", "text")
            .when(name.rlike(KEY_NAME) & kind.isin("numeric", "categorical"), "key")
            .when(kind == "numeric", "measure").otherwise("dimension"))


#: Share of the rows from which a column's estimate of distinct values calls for an exact count; estimates err by 1.6 %.
NEARLY_UNIQUE = 0.85


def _described(df: DataFrame, dataset: str, distinct: Callable[[str], dict[str, str]]) -> DataFrame:
    """What one aggregate tells about each column; ``distinct`` adds to it."""
    strings, place = set(string_columns(df)), {c: i for i, c in enumerate(df.columns)}
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}

    def metrics(c: str) -> dict[str, str]:
        q = quoted(c)
        return {"position": str(place[c]), "type": literal(types[c]), "kind": literal(declared_kind(df, c)),
                "nulls": f"count_if({q} IS NULL)", "avg_length": f"avg(length({q}))" if c in strings else "CAST(NULL AS DOUBLE)", **distinct(c)}

    return per_column(df, comparable_columns(df), metrics, {"rows": "count(1)"}).withColumn("dataset", F.lit(dataset))


def _typed(described: DataFrame) -> DataFrame:
    """Catalog rows from described columns with their ``distinct`` values."""
    typed = described.withColumn("kind", F.expr(f"CASE WHEN kind = 'categorical' AND avg_length > {TEXT_LENGTH} THEN 'text' ELSE kind END"))
    typed = typed.withColumn("semantic_type", semantic_type(F.col("kind"), F.col("column")))
    unique = "`distinct` = `rows` AND nulls = 0 AND `rows` > 0"
    return typed.selectExpr(
        "dataset", "column", "position", "type", "kind", "semantic_type",
        f"semantic_type = 'key' AND {unique} AS is_primary_key", f"semantic_type = 'key' AND NOT ({unique}) AS is_foreign_key",
        f"{unique} AS is_unique", "`rows`", "nulls", "coalesce(try_divide(nulls * 100.0D, `rows`), 0.0D) AS null_pct", "`distinct`",
        "coalesce(try_divide(`distinct` * 100.0D, `rows`), 0.0D) AS distinct_pct", *(["sketch"] if "sketch" in typed.columns else []))


def describe_columns(df: DataFrame, dataset: str, approximate: bool = False, exact: bool = False) -> DataFrame:
    """Catalog rows of one table: type, kind, semantic type, key candidates, null and distinct counts.

    Distinct counts come from sketches; see ``column_catalog``.  ``exact`` counts every column by its values instead;
    ``approximate`` only estimates, so key candidates are rough as well, but nothing runs before the result is asked for.
    """
    if exact:
        out = _described(df, dataset, lambda c: {}).join(exact_distinct(df, comparable_columns(df)), "column", "left").fillna(0, ["distinct"])
        return _typed(out)
    if approximate:
        return _typed(_described(df, dataset, lambda c: {"distinct": f"approx_count_distinct({quoted(c)})"}))
    return column_catalog({dataset: df})


def sketch_of(column: str) -> str:
    """SQL of a mergeable sketch of a column's distinct values."""
    return f"hll_sketch_agg(CASE WHEN {quoted(column)} IS NOT NULL THEN xxhash64({quoted(column)}) END)"


def column_catalog(tables: Mapping[str, DataFrame], approximate: bool = False, exact: bool = False) -> DataFrame:
    """Catalog rows of all columns of all tables.

    One aggregate per table gives null counts and a sketch of each column, from which ``distinct`` is estimated; the sketch is
    returned, so catalogs of parts of a table can be merged.  Only columns without nulls whose estimate is near the row
    count are counted by their values, so key flags are exact.  Estimates up to some hundred values are exact as well.
    """
    if approximate or exact:
        return _all([describe_columns(df, name, approximate, exact) for name, df in tables.items()])
    estimate = "least(hll_sketch_estimate(sketch), `rows` - nulls)"
    found = _all([_described(df, name, lambda c: {"sketch": sketch_of(c)}) for name, df in tables.items()]).withColumn("distinct", F.expr(estimate))
    rows = found.collect()  # one per column
    near: dict[str, list[str]] = {}
    for r in rows:
        if r["rows"] > 0 and r["nulls"] == 0 and r["distinct"] >= NEARLY_UNIQUE * r["rows"]:
            near.setdefault(r["dataset"], []).append(r["column"])
    counted = {}
    if near:
        exactly = _all([exact_distinct(tables[name], columns).withColumn("dataset", F.lit(name)) for name, columns in near.items()])
        counted = {(r["dataset"], r["column"]): r["distinct"] for r in exactly.collect()}
    place = found.columns.index("distinct")
    final = [(*r[:place], counted.get((r["dataset"], r["column"]), r["distinct"]), *r[place + 1:]) for r in rows]
    return _typed(found.sparkSession.createDataFrame(final, found.schema))


def merge_catalogs(stored: DataFrame, more: DataFrame, exactly: DataFrame | None = None) -> DataFrame:
    """Catalog rows of tables to which rows were added, from the catalog rows of both parts.

    ``exactly`` (``dataset, column, values``) gives exact distinct counts where they are known, such as those of a value
    index; other key flags hold only if both parts are unique and the sketches do not speak against it.
    """
    both = stored.withColumn("_new", F.lit(0)).unionByName(more.withColumn("_new", F.lit(1)))
    newest = lambda c: F.max_by(c, "_new").alias(c)
    merged = both.groupBy("dataset", "column").agg(
        *[newest(c) for c in ("position", "type", "kind", "semantic_type")], F.sum("rows").alias("rows"), F.sum("nulls").alias("nulls"),
        F.hll_union_agg("sketch").alias("sketch"), F.bool_and("is_unique").alias("parts"), F.count(F.lit(1)).alias("found"))
    known = (exactly if exactly is not None else both.select("dataset", "column", F.lit(None).cast("long").alias("values")).limit(0)).select("dataset", "column", "values")
    out = merged.join(known, ["dataset", "column"], "left")
    estimate = F.least(F.hll_sketch_estimate("sketch"), F.col("rows") - F.col("nulls"))
    distinct = F.coalesce("values", F.when(F.col("parts") & (estimate >= NEARLY_UNIQUE * F.col("rows")), F.col("rows")), estimate)
    return _typed(out.withColumns({"distinct": distinct, "avg_length": F.lit(None).cast("double")}))


def key_catalog(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Catalog rows of the columns named like keys only, with estimated distinct counts.

    All other columns stay unread and nothing is shuffled.  Key flags are rough here; relationship
    discovery measures uniqueness exactly from the values.
    """
    frames = []
    for name, df in tables.items():
        keys = [c for c in df.columns if re.search(KEY_NAME, c) and declared_kind(df, c) in ("numeric", "categorical")]
        if keys:
            frames.append(describe_columns(df.select(*keys), name, approximate=True))
    return _all(frames).where("semantic_type = 'key'")


def schema_summary(df: DataFrame, dataset: str = "", max_distinct: int = 20, examples: int = 3, exact: bool = False) -> DataFrame:
    """One line per column; string columns with few values show their most frequent ones."""
    columns = describe_columns(df, dataset, exact=exact)
    strings = string_columns(df)
    line = F.concat(F.col("column"), F.lit(": "), F.col("type"), F.lit(" ("), F.col("distinct").cast("string"),
                    F.lit(" unique, "), F.format_number("null_pct", 1), F.lit("% null)"))
    if not strings:
        return columns.select("column", "position", line.alias("line"))
    few = F.col("distinct") < max_distinct
    tops = top_values(df, strings, examples).groupBy("column").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "value"))), lambda s: s["value"]), ", ")
        .alias("examples"))
    return columns.join(tops, "column", "left").select(
        "column", "position",
        F.concat(line, F.when(few & F.col("examples").isNotNull(), F.concat(F.lit(" (e.g., "), F.col("examples"), F.lit(")")))
                 .otherwise(F.lit(""))).alias("line"))


def capabilities(tables: Mapping[str, DataFrame]) -> DataFrame:
    """What each table can be analysed for, with the columns it would use and its row count."""
    frames = []
    for name, df in tables.items():
        numeric, categorical, times = numeric_columns(df), string_columns(df), temporal_columns(df)
        found = []
        if numeric:
            found.append(("numeric", numeric))
        if categorical:
            found.append(("categorical", categorical))
        if numeric and categorical:
            found.append(("aggregatable", numeric + categorical))
        if times:
            found.append(("time", times[:1] + numeric))
        if len(numeric) >= 2:
            found.append(("multi_numeric", numeric))
        if found:
            rows = F.array(*[F.struct(F.lit(c).alias("capability"), F.lit(", ".join(cols)).alias("columns")) for c, cols in found])
            frames.append(df.agg(F.count(F.lit(1)).alias("rows")).select(
                F.lit(name).alias("dataset"), F.inline(rows), "rows"))
    return _all(frames)


def context_profile(df: DataFrame, examples: int = 10) -> DataFrame:
    """Example values, numeric ranges and time ranges, one row per column.

    Examples are the first distinct values in sort order, found without gathering a column.
    """
    numeric, strings, times = numeric_columns(df), string_columns(df), temporal_columns(df)
    frames = []
    if numeric:
        frames.append(per_column(df, numeric, lambda c: {
            "kind": F.lit("numeric"), "low": F.min(c).cast("string"), "high": F.max(c).cast("string"), "mean": F.avg(c),
            "examples": F.lit(None).cast("string")}))
    if times:
        frames.append(per_column(df, times, lambda c: {
            "kind": F.lit("datetime"), "low": F.min(c).cast("string"), "high": F.max(c).cast("string"),
            "mean": F.lit(None).cast("double"), "examples": F.lit(None).cast("string")}))
    for c in strings:
        few = (df.select(F.col(c).alias("value")).where("value is not null").distinct().orderBy("value").limit(examples))
        frames.append(few.agg(F.array_join(F.array_sort(F.collect_list("value")), ", ").alias("examples")).select(
            F.lit(c).alias("column"), F.lit("categorical").alias("kind"), F.lit(None).cast("string").alias("low"),
            F.lit(None).cast("string").alias("high"), F.lit(None).cast("double").alias("mean"), "examples"))
    return _all(frames)


def join_readiness(tables: Mapping[str, DataFrame], exact: bool = False) -> DataFrame:
    """How each column can serve a join: primary key, foreign key, candidate by name, or common dimension."""
    catalog = column_catalog(tables, exact=exact)
    name = F.lower("column")
    candidate = reduce(lambda a, b: a | b, [name.endswith(s) for s in JOIN_SUFFIXES])
    role = (F.when(F.col("is_primary_key"), "primary_key").when(F.col("is_foreign_key"), "foreign_key")
            .when(candidate, "join_candidate").when(name.isin(*COMMON_DIMENSIONS), "common_dimension"))
    return (catalog.withColumn("role", role).where("role is not null")
            .select("dataset", "column", "role", F.col("distinct").alias("cardinality"),
                    name.isin(*COMMON_DIMENSIONS).alias("is_common_dimension")))


def aggregation_potential(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Measures to sum, dimensions to group by (2 to 100 values, fewer than half the rows), time columns."""
    catalog = column_catalog(tables)
    name = F.lower("column")
    identifier = reduce(lambda a, b: a | b, [name.endswith(s) for s in JOIN_SUFFIXES])
    groupable = (F.col("distinct") < F.col("rows") * 0.5) & F.col("distinct").between(2, 100)
    role = (F.when((F.col("semantic_type") == "measure") | ((F.col("kind") == "numeric") & ~identifier & (F.col("semantic_type") != "key")), "measure")
            .when(F.col("kind") == "datetime", "time")
            .when((F.col("semantic_type") == "dimension") | groupable, "dimension"))
    use = (F.when(F.col("role") == "measure", "sum, mean, min, max, count")
           .when(F.col("role") == "time", "day, week, month, quarter, year")
           .otherwise(F.concat(F.col("distinct").cast("string"), F.lit(" groups"))))
    return (catalog.withColumn("role", role).where("role is not null").withColumn("use", use)
            .select("dataset", "column", "role", "use", "distinct"))


def cross_table_context(tables: Mapping[str, DataFrame], edges: Sequence[Mapping] = ()) -> DataFrame:
    """Per table what it offers a cross-table analysis, and what all tables share."""
    catalog = column_catalog(tables)
    per_table = catalog.groupBy("dataset").agg(
        F.max("rows").alias("rows"), F.count_if(F.col("semantic_type") == "measure").alias("measures"),
        F.bool_or(F.col("kind") == "datetime").alias("has_time"),
        F.array_sort(F.collect_set(F.when(F.lower("column").isin(*COMMON_DIMENSIONS), F.lower("column")))).alias("dimensions"))
    linked = [e[k] for e in edges for k in ("from_dataset", "to_dataset")]
    links = reduce(lambda acc, t: acc.when(F.col("dataset") == t, F.lit(linked.count(t))), sorted(set(linked)),
                   F.when(F.lit(False), F.lit(0))).otherwise(F.lit(0))
    # One row per table, so a window over all of them stays small.
    everything = Window.partitionBy()
    shared = F.array_sort(F.array_distinct(F.flatten(F.collect_list("dimensions").over(everything))))
    return per_table.select(
        "dataset", "rows", "measures", "has_time", F.array_join("dimensions", ", ").alias("dimensions"), links.alias("links"),
        F.bool_and("has_time").over(everything).alias("all_have_time"), F.array_join(shared, ", ").alias("all_dimensions"))


def time_series_profile(df: DataFrame, date: str) -> DataFrame:
    """Distinct dates, span, headline figures by name and the confidence the row count allows."""
    metrics = [c for c in numeric_columns(df) if any(w in c.lower() for w in KEY_METRIC_WORDS)]
    return temporal_granularity(df, date).select(
        "column", "rows", "dates", F.datediff("last", "first").alias("span_days"), "granularity",
        F.lit(", ".join(metrics[:5])).alias("key_metrics"), sample_confidence(F.col("rows")).alias("confidence"))


def dataset_sizes(tables: Mapping[str, DataFrame]) -> DataFrame:
    """``dataset`` and ``row_count`` of each table."""
    return _all([df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(n).alias("dataset"), "row_count")
                 for n, df in tables.items()])
