"""Correlations between columns and linear trends over time."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescout.functions import epoch_seconds, numeric_columns, t_two_sided
from tablescout.operators.profile import quoted

STRONG, MODERATE = 0.7, 0.3
PAIR_SCHEMA = "var1 string, var2 string, correlation double, n long"
#: Tasks that add up what all tasks found; rows whose means shift the sums.
MERGERS, FIRST_ROWS = 16, 1000
#: A shift is far off if its distance from the mean, squared, is so many variances; below so much of its squares a
#: variance is nothing but rounding.
FAR_OFF, ROUNDING = 1e6, 1e-13
# Words in a column name that mark the figures worth a trend.
TREND_WORDS = ("revenue", "sales", "profit", "cost")


def _added(batches, size: int):
    """One row with the sum of many rows of packed matrices."""
    import pyarrow as pa

    total = np.zeros(size)
    for batch in batches:
        for packed in batch.column(0).to_pylist():
            total += np.frombuffer(packed)
    yield pa.RecordBatch.from_pydict({"sums": [total.tobytes()]})


def masked_products(df: DataFrame, columns: Sequence[str], shift: Sequence[float]) -> np.ndarray:
    """Four matrices over all rows, with ``x`` the shifted values, 0 where missing, and ``m`` 1 where there is a value.

    ``m'm`` (rows that have both), ``x'm``, ``x'x`` and ``(x*x)'m``.  One scan: every task multiplies its Arrow batches and
    returns one row; ``MERGERS`` tasks add those rows and the driver adds theirs.
    """
    import pyarrow as pa

    p, origin = len(columns), np.array(shift)
    size = 4 * p * p

    def multiplied(batches):
        total = np.zeros((4, p, p))
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]).astype(float) if batch.num_rows else np.zeros((0, p))
            known = np.isfinite(x)
            m, x = known.astype(float), np.where(known, x - origin, 0.0)
            total += (m.T @ m, x.T @ m, x.T @ x, (x * x).T @ m)
        yield pa.RecordBatch.from_pydict({"sums": [total.tobytes()]})

    rows = df.select(*[F.col(quoted(c)).cast("double").alias(f"x{i}") for i, c in enumerate(columns)]).mapInArrow(multiplied, "sums binary")
    merged = rows.repartition(MERGERS).mapInArrow(lambda batches: _added(batches, size), "sums binary")
    return sum((np.frombuffer(r.sums) for r in merged.collect()), np.zeros(size)).reshape(4, p, p)


def correlations(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Pearson correlation of every pair of numeric columns over the rows that have both.

    All pairs come from one scan, whatever is missing.  Sums are taken about the means of the first rows; should those
    turn out to be far off for a column, a second scan uses the means of all rows.  NaN and infinite values are missing.
    """
    columns = list(columns or numeric_columns(df))
    pairs = list(combinations(range(len(columns)), 2))
    if not pairs:
        return df.sparkSession.createDataFrame([], PAIR_SCHEMA)
    finite = [F.when(F.abs(x) < float("inf"), x) for x in (F.col(quoted(c)).cast("double") for c in columns)]
    first = df.limit(FIRST_ROWS).agg(*[F.avg(x).alias(f"a{i}") for i, x in enumerate(finite)]).first()
    shift = [v or 0.0 for v in first]
    n, s, products, squares = masked_products(df, columns, shift)
    own = np.diagonal(n)
    mean = np.divide(np.diagonal(s), own, out=np.zeros(len(columns)), where=own > 0)
    spread = np.divide(np.diagonal(squares), own, out=np.zeros(len(columns)), where=own > 0) - mean * mean
    if np.any(mean * mean > FAR_OFF * np.maximum(spread, 0)):
        n, s, products, squares = masked_products(df, columns, [a + b for a, b in zip(shift, mean)])
    found = []
    for i, j in pairs:
        count = n[i, j]
        r = None
        if count > 0:
            u, v = squares[i, j] - s[i, j] ** 2 / count, squares[j, i] - s[j, i] ** 2 / count
            if u > ROUNDING * squares[i, j] and v > ROUNDING * squares[j, i]:
                r = float(np.clip((products[i, j] - s[i, j] * s[j, i] / count) / np.sqrt(u * v), -1, 1))
        found.append((columns[i], columns[j], r, int(count)))
    return df.sparkSession.createDataFrame(found, PAIR_SCHEMA)


def strong_pairs(df: DataFrame, columns: Sequence[str] | None = None, limit: float = STRONG) -> DataFrame:
    out = correlations(df, columns).where(F.abs("correlation") > limit)
    return out.withColumn("direction", F.when(F.col("correlation") > 0, "positive").otherwise("negative"))


def strongest_pair(pairs: DataFrame) -> DataFrame:
    """The pair with the largest absolute correlation; equal ones by name."""
    return pairs.where("correlation is not null").orderBy(F.desc(F.abs("correlation")), "var1", "var2").limit(1)


def causal_pair(df: DataFrame, columns: Sequence[str] | None = None) -> tuple[str, str] | None:
    """The pair to test for causality: the best correlated beyond 0.3, else the first two columns."""
    columns = list(columns or numeric_columns(df))
    if len(columns) < 2:
        return None
    best = strongest_pair(correlations(df, columns).where(F.abs("correlation") > MODERATE)).collect()
    return (best[0]["var1"], best[0]["var2"]) if best else (columns[0], columns[1])


def cross_table_correlations(joined: DataFrame, lineage: Mapping[str, str], columns: Sequence[str] | None = None,
                             limit: float = STRONG) -> DataFrame:
    """Strongly correlated columns that came from different tables."""
    columns = [c for c in (columns or numeric_columns(joined))]
    table = F.create_map(*[F.lit(v) for c in columns for v in (c, lineage[c])])
    out = correlations(joined, columns).withColumns(
        {"table1": F.element_at(table, F.col("var1")), "table2": F.element_at(table, F.col("var2"))})
    return out.where((F.col("table1") != F.col("table2")) & (F.abs("correlation") > limit))


def linear_trend(df: DataFrame, time: str, metrics: Sequence[str], by: Sequence[str] = (), min_rows: int = 10) -> DataFrame:
    """Regression of each metric on time in seconds: slope, correlation, p-value, direction, strength.

    Times enter relative to 2000-01-01, which leaves slope and correlation as they are and keeps
    the sums small; the intercept is given for 1970-01-01.
    """
    origin = 946_684_800.0
    timed = df.select(*by, (epoch_seconds(time) - origin).alias("_t"), *[F.col(m).cast("double").alias(m) for m in metrics])
    known = timed.where(F.col("_t").isNotNull())
    aggs, rows = [], []
    for i, m in enumerate(metrics):
        x = F.when(F.col(m).isNotNull(), F.col("_t"))
        aggs += [F.count(m).alias(f"n{i}"), F.avg(x).alias(f"t{i}"), F.avg(m).alias(f"y{i}"), F.var_pop(x).alias(f"u{i}"),
                 F.var_pop(m).alias(f"v{i}"), F.covar_pop(x, F.col(m)).alias(f"c{i}")]
        slope = F.try_divide(f"c{i}", f"u{i}")
        rows.append(F.struct(
            F.lit(m).alias("metric"), slope.alias("slope"),
            (F.col(f"y{i}") - slope * F.col(f"t{i}") - slope * origin).alias("intercept"),
            F.try_divide(F.col(f"c{i}"), F.sqrt(F.col(f"u{i}") * F.col(f"v{i}"))).alias("correlation"), F.col(f"n{i}").alias("n")))
    out = known.groupBy(*by).agg(*aggs).select(*by, F.inline(F.array(*rows)))
    r, n = F.col("correlation"), F.col("n")
    statistic = r * F.sqrt((n - 2) / F.nullif(1 - r * r, F.lit(0.0)))
    out = out.withColumn("p_value", F.when(F.abs(r) >= 1, 0.0).otherwise(t_two_sided(statistic, (n - 2).cast("double"))))
    significant = F.coalesce((n >= min_rows) & (F.col("p_value") < 0.05), F.lit(False))
    return out.withColumns({
        "is_significant": significant,
        "direction": F.when(F.col("slope") > 0, "increasing").otherwise("decreasing"),
        "strength": F.when(F.abs(r) > STRONG, "strong").otherwise("moderate")})


def headline_trend(joined: DataFrame, time: str, columns: Sequence[str] | None = None, words: Sequence[str] = TREND_WORDS) -> DataFrame:
    """The clearest significant trend among the first three headline figures."""
    chosen = [c for c in (columns or numeric_columns(joined)) if any(w in c.lower() for w in words)][:3]
    return linear_trend(joined, time, chosen).where("is_significant").orderBy(
        F.desc(F.abs("correlation")), "metric").limit(1)


