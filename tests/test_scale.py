"""How much work operators cause: scans, jobs and what travels, next to the results they must keep."""

import uuid

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablescout.functions import column_quantiles
from tablescout.operators import clean, correlate, profile


def jobs_of(spark, action):
    """Result of ``action`` and the number of jobs it started."""
    sc, group = spark.sparkContext, uuid.uuid4().hex
    sc.setJobGroup(group, group)
    try:
        out = action()
        return out, len(sc.statusTracker().getJobIdsForGroup(group))
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)


@pytest.fixture(scope="module")
def gappy():
    rng = np.random.default_rng(4)
    base = rng.normal(size=(800, 100)) @ rng.normal(size=(100, 100)) * 0.1 + rng.normal(size=(800, 1))
    x = np.where(rng.random(base.shape) < 0.2, np.nan, base * np.logspace(-3, 6, 100) + np.linspace(-1e6, 1e6, 100))
    x[:, 7], x[:, 9] = 3.25, np.nan
    return pd.DataFrame(x, columns=[f"c.{i}" for i in range(100)])


def test_all_pairs_of_gappy_columns_in_one_scan(spark, gappy):
    rows = [[None if np.isnan(v) else float(v) for v in r] for r in gappy.to_numpy()]
    df = spark.createDataFrame(rows, ", ".join(f"x{i} double" for i in range(100))).repartition(5)
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    watched = df.mapInArrow(counted, df.schema).toDF(*gappy.columns)
    out, jobs = jobs_of(spark, lambda: correlate.correlations(watched).collect())
    assert read.value <= 2 * len(gappy) and jobs <= 8  # a look at the first rows, and one scan; both shuffle first here
    assert len(out) == 4950
    x, place = gappy.to_numpy().astype(np.longdouble), {c: i for i, c in enumerate(gappy.columns)}
    for r in out:
        a, b = x[:, place[r.var1]], x[:, place[r.var2]]
        a, b = a[~np.isnan(a) & ~np.isnan(b)], b[~np.isnan(a) & ~np.isnan(b)]
        assert r.n == len(a)
        if "c.7" in (r.var1, r.var2) or "c.9" in (r.var1, r.var2):
            assert r.correlation is None
        else:
            a, b = a - a.mean(), b - b.mean()
            assert r.correlation == pytest.approx(float((a * b).sum() / np.sqrt((a * a).sum() * (b * b).sum())), abs=1e-9)


def test_a_shift_that_is_far_off_is_mended(spark):
    rng = np.random.default_rng(5)
    a = np.concatenate([np.full(1000, 1e12), rng.normal(size=4000)])
    b = np.concatenate([np.full(1000, np.nan), rng.normal(size=4000)])
    c = np.concatenate([np.full(1000, -7e11), a[1000:] + 0.1 * rng.normal(size=4000)])
    c[1000:], a[:1000] = c[1000:], a[:1000]
    pdf = pd.DataFrame({"a": np.where(np.arange(5000) < 1000, np.nan, a), "b": b, "c": np.where(np.arange(5000) < 1000, np.nan, c + 1e9)})
    df = spark.createDataFrame([tuple(None if np.isnan(v) else float(v) for v in r) for r in pdf.to_numpy()], "a double, b double, c double").coalesce(1)
    got = {(r.var1, r.var2): r.correlation for r in correlate.correlations(df).collect()}
    for (x, y), r in got.items():
        assert r == pytest.approx(pdf[x].corr(pdf[y]), abs=1e-6)


def test_infinite_and_missing_values_and_too_few_columns(spark):
    df = spark.createDataFrame([(1.0, 2.0, float("inf")), (2.0, 4.0, 1.0), (3.0, float("nan"), 5.0), (4.0, None, 2.0), (5.0, 9.0, 0.0)], "a double, b double, c double")
    got = {(r.var1, r.var2): (r.correlation, r.n) for r in correlate.correlations(df).collect()}
    pdf = pd.DataFrame({"a": [1, 2, 3, 4, 5.0], "b": [2, 4, np.nan, np.nan, 9], "c": [np.nan, 1, 5, 2, 0]})
    for (x, y), (r, n) in got.items():
        assert r == pytest.approx(pdf[x].corr(pdf[y])) and n == (pdf[x].notna() & pdf[y].notna()).sum()
    assert correlate.correlations(df, ["a"]).count() == 0
    assert [(r.correlation, r.n) for r in correlate.correlations(df.where(F.lit(False))).collect()] == [(None, 0)] * 3


PROBS = [0.0, 0.1, 0.25, 0.5, 0.75, 1.0]


@pytest.mark.parametrize("n", [1, 2, 7, 1000, 60_000, 1_000_000])
def test_quantiles_take_two_aggregates_whatever_the_size(spark, n):
    df = spark.range(n).select((F.pmod(F.xxhash64("id"), F.lit(10_007)) * 1.0).alias("a.b"), F.sin("id").alias("s"), F.floor(F.col("id") / 400).alias("ties"))
    got, jobs = jobs_of(spark, lambda: column_quantiles(df, df.columns, PROBS))
    pdf = df.toPandas()
    for c in df.columns:
        assert got[c] == pytest.approx(np.quantile(pdf[c], PROBS), rel=1e-12, abs=1e-12)
    assert jobs <= 4  # two aggregates, each a stage before and one after its exchange


def test_quantiles_narrow_brackets_that_are_too_large(spark):
    df = spark.range(40_000).select(F.exp(F.sin("id") * 9).alias("x"), F.when(F.col("id") % 9 == 0, F.lit(1.0)).otherwise(F.col("id") % 3 * 1.0).alias("few"))
    pdf = df.toPandas()
    for held in (5, 300):
        got = column_quantiles(df, ["x", "few"], PROBS, held)
        assert all(got[c] == pytest.approx(np.quantile(pdf[c], PROBS), rel=1e-12) for c in got)


def test_quantiles_of_missing_and_infinite_values(spark):
    rows = [(None, float("nan"), float("inf")), (None, 2.0, 1.0), (None, None, float("-inf")), (None, 4.0, 3.0)]
    df = spark.createDataFrame(rows, "none double, `some` double, wide double")
    got = column_quantiles(df, df.columns, [0.5, 1.0])
    assert got == {"none": None, "some": [3.0, 4.0], "wide": [2.0, float("inf")]}
    assert column_quantiles(df.where("false"), ["some"], [0.5]) == {"some": None}


def test_profiles_of_columns_with_dots(spark):
    df = spark.createDataFrame([(1, "a", 1.5, True), (2, "b", 2.5, False), (3, None, 400.0, None)] * 5, "`k.id` long, `t.x` string, `v.y` double, `b.z` boolean")
    summary = {r.column: r for r in profile.numeric_summary(df).collect()}
    assert summary["v.y"].max == 400.0 and summary["k.id"].distinct == 3 and summary["v.y"].q50 == 2.5
    assert {r.column: r.outliers for r in profile.outlier_columns(df).collect()} == {"k.id": 0, "v.y": 0}
    assert {r.column for r in profile.column_kinds(df).collect()} == set(df.columns)
    assert profile.duplicate_rows(df).first().duplicate_rows == 12
    assert profile.boolean_stats(df).first().true_count == 5
    assert {r.column: r.most_common for r in profile.categorical_summary(df).collect()} == {"t.x": "a"}
    assert profile.skewed_columns(df).count() == 2 and profile.constant_columns(df).count() == 0 and profile.frequency(df, "t.x").first().freq == 5


def test_cleaning_reads_the_table_twice(spark):
    n = 3000
    df = spark.range(n).select(
        (F.col("id") % 2900).cast("string").alias("order_id"), F.when(F.col("id") % 7 > 0, F.col("id") * 1.5).alias("total price"),
        F.when(F.col("id") % 3 > 0, "NORTH").otherwise("south").alias("region"), F.when(F.col("id") == 2500, 1e9).otherwise(F.col("id") % 10 * 1.0).alias("odd"))
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    meaning = {"order_id": clean.ColumnMeaning("key", True), "total price": clean.ColumnMeaning("measure", business_meaning="total price"),
               "region": clean.ColumnMeaning("dimension"), "odd": clean.ColumnMeaning("measure")}
    out, report = clean.clean_table(df.mapInArrow(counted, df.schema), meaning)
    assert read.value == 2 * n
    steps = {(s, m): (k, detail) for s, m, k, detail in report.steps}
    assert steps["remove_duplicates", "rows_removed"] == (100, "order_id")
    assert steps["handle_outliers", "columns_flagged"] == (1, "odd") and steps["standardise_formats", "columns_standardised"] == (1, "region:upper")
    rows = out.collect()
    assert len(rows) == 2900 and {r.region for r in rows} == {"NORTH", "SOUTH"} and sum(r.odd_is_outlier for r in rows) == 1
    assert {r._data_quality_flag for r in rows} == {"clean"}


@pytest.mark.parametrize("new", [None, ["t3", "t7"]])
def test_candidate_columns_equal_all_pairs(spark, new):
    from tablescout.functions.names import score_names
    from tablescout.operators import relate

    rng = np.random.default_rng(9)
    parts = ["customer", "order", "product", "store", "region", "amount", "date", "id", "key", "code", "name"]
    rows = []
    for t in range(25):
        for c in range(16):
            name = "_".join(rng.choice(parts, int(rng.integers(1, 4)))) + (str(c) if c % 3 == 0 else "")
            kind = str(rng.choice(["numeric", "categorical", "datetime"]))
            semantic = {"numeric": str(rng.choice(["key", "measure"])), "categorical": str(rng.choice(["key", "dimension", "text"])), "datetime": "date"}[kind]
            rows.append((f"t{t}", f"{name}{c}", semantic, float(rng.choice([0, 50, 95])), 100, 0, 100, kind))
    catalog = spark.createDataFrame(rows, "dataset string, column string, semantic_type string, null_pct double, rows long, nulls long, distinct long, kind string")
    pairs = relate.candidate_pairs(catalog, new)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    expected = {}
    for a in rows:
        for b in rows:
            kinds, keys = (a[2], b[2]), a[2] == b[2] == "key"
            stored = new is not None and (a[0] not in new or b[0] not in new)
            if a[0] < b[0] and max(a[3], b[3]) <= 90 and ((a[7] == "numeric") == (b[7] == "numeric") or stored and keys):
                if kinds in (("measure", "measure"), ("measure", "key"), ("key", "measure")) or new is not None and a[0] not in new and b[0] not in new:
                    continue
                score = score_names(a[1], b[1])
                if keys or score >= relate.NAME_GATE:
                    expected[a[0], a[1], b[0], b[1]] = score
    got = {tuple(r[c] for c in relate.PAIR): r.name_similarity for r in pairs.collect()}
    assert got.keys() == expected.keys() and all(got[k] == pytest.approx(expected[k]) for k in got)
