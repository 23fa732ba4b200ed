import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablescout.functions import (
    column_quantiles, epoch_seconds, group_quantiles, parse_date, parse_measure, row_digest,
)
from tablescout.functions.names import score_names
from tablescout.functions.tails import chi2_tail, f_tail, t_quantile, t_tail


@pytest.mark.parametrize("left, right, expected", [
    ("client_id", "user_id", 0.20), ("client_id", "customer_code", 0.30), ("user_id", "customer_code", 0.556),
    ("o_custkey", "c_custkey", 0.875), ("l_orderkey", "o_orderkey", 0.889), ("Customer-ID", "customer_id", 1.0),
])
def test_name_scores(left, right, expected):
    assert score_names(left, right) == pytest.approx(expected, abs=6e-4)


def test_tails_match_published_tables():
    assert t_quantile(0.975, 10) == pytest.approx(2.228139, abs=1e-5)
    assert t_quantile(0.975, 58) == pytest.approx(2.001717, abs=1e-5)
    assert t_tail(2.228139, 10) == pytest.approx(0.05, abs=1e-6)
    assert f_tail(4.102821, 2, 10) == pytest.approx(0.05, abs=1e-6)
    assert f_tail(3.325835, 5, 10) == pytest.approx(0.05, abs=1e-6)
    assert chi2_tail(5.991465, 2) == pytest.approx(0.05, abs=1e-6)
    assert chi2_tail(18.307038, 10) == pytest.approx(0.05, abs=1e-6)


@pytest.mark.parametrize("shape", ["normal", "ties", "heavy"])
def test_large_columns_give_the_same_quantiles(spark, shape):
    rng = np.random.default_rng(7)
    n = 60_000
    values = {"normal": rng.normal(size=n), "ties": rng.integers(0, 4, n).astype(float),
              "heavy": np.exp(rng.normal(size=n) * 8)}[shape]
    df = spark.createDataFrame(pd.DataFrame({"x": values, "g": np.where(np.arange(n) % 3 == 0, "a", "b")}))
    probs = [0.25, 0.5, 0.75, 0.9]
    expected = np.quantile(values, probs)
    got = column_quantiles(df, ["x"], probs, exact_rows=50)["x"]
    assert got == pytest.approx(expected, rel=1e-12)
    assert column_quantiles(df, ["x"], probs)["x"] == pytest.approx(expected, rel=1e-9)


@pytest.mark.parametrize("shape", ["normal", "ties"])
def test_hot_groups_give_the_same_quantiles(spark, shape):
    rng = np.random.default_rng(8)
    n = 30_000
    values = rng.normal(size=n) if shape == "normal" else rng.integers(0, 5, n).astype(float)
    group = np.where(np.arange(n) % 3 == 0, "hot1", np.where(np.arange(n) % 100 == 1, "cold", None))
    pdf = pd.DataFrame({"g": group, "x": values})
    df = spark.createDataFrame(pdf, "g string, x double")
    out = group_quantiles(df, ["g"], "x", [0.25, 0.5, 0.75], ["a", "b", "c"], exact_rows=400).toPandas()
    assert len(out) == 3
    for _, r in out.iterrows():
        mask = pdf.g.isna() if r.g is None or r.g != r.g else pdf.g == r.g
        assert [r.a, r.b, r.c] == pytest.approx(np.quantile(pdf.x[mask], [0.25, 0.5, 0.75]), rel=1e-9)


def test_scalar_parsers(spark):
    df = spark.createDataFrame([("$1,234.50", "2024-03-01"), ("12%", "03/02/2024"), ("n/a", "soon"), (None, None)],
                               "m string, d string")
    rows = df.select(parse_measure("m").alias("m"), parse_date("d").cast("string").alias("d")).collect()
    assert [r.m for r in rows] == [1234.5, 12.0, None, None]
    assert [r.d for r in rows] == ["2024-03-01 00:00:00", "2024-03-02 00:00:00", None, None]


def test_row_digest_separates_fields(spark):
    df = spark.createDataFrame([("a", "bc"), ("ab", "c"), (None, "abc"), ("-;", "abc"), ("a", "bc")], "x string, y string")
    assert df.select(row_digest(["x", "y"]).alias("d")).distinct().count() == 4


def test_epoch_seconds(spark):
    df = spark.sql("select timestamp_ntz'2001-09-09 01:46:40' as t")
    assert df.select(epoch_seconds(F.col("t")).alias("s")).first().s == 1_000_000_000
