"""Whitening against a dense decomposition of the exact covariance."""

import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablescout.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int, x int, n string, v double, component int"


def brute(vectors):
    """Exact sums and covariance of the distinct whole-number vectors; the decomposition in doubles."""
    whole = [tuple(math.floor(256 * float(np.float32(c))) for c in v) for v in vectors]
    fit = list(dict.fromkeys(whole))
    n, d = len(fit), len(fit[0])
    total = [sum(v[j] for v in fit) for j in range(d)]
    off = [[n * v[j] - total[j] for j in range(d)] for v in fit]
    cov = np.array([[float(Fraction(sum(o[i] * o[j] for o in off), n**3)) for j in range(d)] for i in range(d)])
    values, axes = np.linalg.eigh(cov)
    deviations = [sum((n * v[j] - total[j]) ** 2 for j in range(d)) for v in whole]
    centred = np.array([[float(Fraction(n * v[j] - total[j], n)) for j in range(d)] for v in whole])
    return n, deviations, values[::-1], axes[:, ::-1], centred, float(np.trace(cov))


def agree(spark, rows, usable, tolerance=1e-9):
    df = spark.createDataFrame([(i, v, 1, 2, "y", 0.5, 9) for i, v in rows], SCHEMA)
    got = whitening.whiten(df).toPandas()
    n, deviations, values, axes, centred, trace = brute([v for _, v in usable])
    k = min(4, len(values))
    assert len(got) == k * len(usable) and set(got.n) == {n} and set(got.component) == set(range(1, k + 1))
    assert sorted(got[got.component == 1].vec_id.fillna(-9)) == sorted(-9 if i is None else i for i, _ in usable)
    assert sorted(got[got.component == 1].deviation) == sorted(deviations)
    assert got.identity_error.nunique() == 1 and got.identity_error.iloc[0] <= 1e-9
    by_id = {i: (c, s) for (i, _), c, s in zip(usable, centred, deviations)}
    for j in range(k):
        part = got[got.component == j + 1]
        if values[j] <= 1e-12 * max(values[0], 1e-300):
            assert part.whitened.isna().all() and (part.explained == 0).all()
            continue
        assert np.allclose(part.explained, values[j] / trace, rtol=1e-9)
        expected = {i: c @ axes[:, j] / math.sqrt(values[j]) for i, (c, _) in by_id.items()}
        have = {(None if i != i or i is None else int(i)): w for i, w in zip(part.vec_id, part.whitened)}
        sign = np.sign(sum(have[i] * expected[i] for i in expected))
        assert max(abs(sign * have[i] - expected[i]) for i in expected) < tolerance


def test_whole_table(spark, sf_dir):
    rows = [(r.vec_id, [float(c) for c in r.embedding]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    agree(spark, rows, rows)


def test_odd_vectors_and_copies(spark):
    rng = np.random.default_rng(3)
    good = [(i, (rng.standard_normal(6) * [9, 6, 4, 2, 1, 0.5] + 3).round(3).tolist()) for i in range(300)]
    good += [(1000 + i, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0]) for i in range(400)] + [(7, good[7][1]), (None, good[8][1]), (-5, [0.0, -0.0, 1e-9, -1e-9, 0.5, -0.5])]
    bad = [(2000, None), (2001, []), (2002, [1.0, None, 0, 0, 0, 0]), (2003, [float("nan")] * 6), (2004, [float("inf"), 0, 0, 0, 0, 0]),
           (2005, [float("-inf"), 0, 0, 0, 0, 0]), (2006, [1.0]), (2007, [1.0] * 7)]
    bad = [(i, v if v is None else [None if c is None else float(c) for c in v]) for i, v in bad]
    agree(spark, good + bad, good)


@pytest.mark.parametrize("dimensions, rank", [(1, 1), (3, 3), (8, 2), (12, 12)])
def test_few_dimensions_and_low_rank(spark, dimensions, rank):
    rng = np.random.default_rng(dimensions)
    axes = rng.integers(-3, 4, (rank, dimensions))
    rows = [(i, (rng.integers(-20, 20, rank) * np.arange(1, rank + 1) @ axes).astype(float).tolist()) for i in range(200)]
    agree(spark, rows, rows)


def test_one_vector_no_vector_and_large_entries(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<double>")
    got = whitening.whiten(df).collect()
    assert [(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in got] == [(1, 0, None, 0.0, 0.0)] * 4
    assert whitening.whiten(df.where("vec_id = 3")).count() == 0
    assert whitening.whiten(df.select("vec_id", F.array().cast("array<double>").alias("embedding"))).count() == 0
    large = spark.createDataFrame([(1, [1e7, 0.0]), (2, [-1e7, 1.0]), (3, [1e12, 0.0])], "vec_id long, embedding array<double>")
    rows = {r.vec_id: r for r in whitening.whiten(large).where("component = 1").collect()}
    whole = [(2560000000, 0), (-2560000000, 256), (256 * 10**12, 0)]
    exact = [sum((3 * v[j] - sum(w[j] for w in whole)) ** 2 for j in range(2)) for v in whole]
    assert [rows[i].deviation for i in (1, 2, 3)] == [e if e < 2**63 else None for e in exact] and rows[3].whitened is not None


def test_spectra_are_combined_in_levels(spark, monkeypatch):
    monkeypatch.setattr(whitening, "FAN_IN", 2)
    rng = np.random.default_rng(8)
    rows = [(i, (rng.standard_normal(5) * [5, 4, 3, 2, 1]).tolist()) for i in range(500)]
    x = whitening.whole_numbers(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).repartition(7)
    basis = whitening.basis_of(x)
    whole = np.floor(256 * np.array([v for _, v in rows]))
    axes = np.linalg.eigh(np.cov(whole.T))[1][:, ::-1]
    assert np.allclose(np.abs(basis.T @ axes), np.eye(5), atol=1e-9)


@pytest.mark.parametrize("kind", ["plain", "steep", "copies", "integers", "few"])
def test_updates_equal_the_dense_decomposition(kind):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((600, 24))
    x = {"plain": x, "steep": x * np.logspace(0, -8, 24), "copies": np.repeat(x[:, :6], 4, axis=1), "integers": np.round(3 * x),
         "few": np.round(x[:5])[rng.integers(0, 5, 600)]}[kind] + 7
    whole = whitening.Spectrum(24)
    for i in range(0, 600, 150):
        part = whitening.Spectrum(24)
        part.add(x[i:i + 150])
        whole.merge(part) if i else whole.add(x[:150])
    scatter = (x - x.mean(0)).T @ (x - x.mean(0))
    size = np.linalg.eigvalsh(scatter).max()
    assert whole.n == 600 and np.allclose(whole.mean, x.mean(0))
    assert np.abs(whole.basis.T @ whole.basis - np.eye(24)).max() < 1e-12
    assert np.abs(scatter @ whole.basis - whole.basis * whole.values).max() < 1e-12 * size
